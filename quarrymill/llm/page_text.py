"""Problem 6: the main body of web pages. What stands there in place of content is judged in ``residue`` (problem 4).

Method: nearest-URL page differencing. Pages of a host are put in the order of their URL paths; each is
aligned with its nearest neighbours, text line by text line, by longest common subsequence, and shared lines
are struck. Neighbours share the first part of the path, or only the host where no other page shares it. What
a site prints by chance on one page only is not struck there, so what differencing finds over all pages also
trains a word model: every distinct line counts once, as furniture if it was ever struck and as own text if
never. A line that stands on thousands of pages thus weighs as much as one that stands on a single page, and
wording that is struck anywhere counts against it everywhere; no wording is listed. Lines between container
tags are judged as a block, and the main body is the best block with the good blocks next to it, less the
lines that are struck or read like page furniture.

Pages are parsed once; what is stored and moved afterwards are their lines. Model tables have a fixed number
of slots and are summed in the cluster over all pages.
"""

from __future__ import annotations

import hashlib
import html as html_
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.counts import Shared, batch_of, summed
from quarrymill.llm.encodings import SLOTS, CharModel
from quarrymill.llm.residue import ResidueModel, seed_counts
from quarrymill.llm.words import WordHash, _mix
from quarrymill.runtime import discard, slots, stored

WORDS = 1 << 18
#: Pages of a task that aligns them, and how many beyond either end it sees at first; neither changes a result.
BLOCK = 4_000
REACH = 64
STRUCK = -6.0
#: Likelihood ratio a character above which a page may still turn out to be residue, and that of a whole body below which it surely has content.
UNCLEAR, CONFIDENT = -0.8, 60.0
#: Lines of a worse score are furniture, whatever else they look like.
WORST = -3.0
#: Pages read in one go; entries a task remembers. Neither changes a result.
PAGES = 200
KNOWN = 50_000
#: Share of the pages, and least number of hosts, on which a line that is hardly ever struck counts as repeated over unrelated hosts.
REPEATED, HOSTS = 0.0002, 3
#: Rounds in which the residue model learns from the pages it marks; after the first only pages whose likelihood ratio is not clear.
ROUNDS = 3
#: What a line is: nothing to see, text, text that is all link, a container tag.
NOTHING, TEXT, LINKED, BOUNDARY = 0, 1, 3, 4
#: Codes by which a crawl says why it has no pages: fixed values of the crawl.
CODE = r"^(timeout|robots_disallowed|non_html|too_short|http_[1-5][0-9][0-9]|conn_error:[A-Za-z][A-Za-z0-9_.]*)$"

_SCORED = [pa.field("_texts", pa.list_(pa.string())), *(pa.field(c, t) for c, t in (("_kinds", pa.binary()), ("_notices", pa.list_(pa.string())), ("shared", pa.binary()), ("scores", pa.binary()), ("body", pa.binary())))]
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z!?][^>]*>", re.S)
_NAME = re.compile(r"</?\s*([A-Za-z][A-Za-z0-9]*)")
_SKIP = re.compile(r"(?i)<(script|style|title|noscript)\b.*?(?:</\1\s*>|$)")
_NOSCRIPT = re.compile(r"(?is)<noscript\b[^>]*>(.*?)(?:</noscript\s*>|$)")
_CONTAINER = frozenset("div td th tr table nav header footer main article section aside blockquote center address hr body html form head".split())
_LINK = re.compile(r"(?is)<a\b.*?</a>")
_OPENS = re.compile(r"(?i)<(script|style|noscript|title)\b(?!.*</\1)")
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[|»>:©]")


@lru_cache(maxsize=KNOWN)
def _line(bare: str) -> tuple[str, bool, bool]:
    """(visible text, boundary, links only) of a line that stands neither in the head nor in a script."""
    if "<" not in bare:
        text = " ".join((html_.unescape(bare) if "&" in bare else bare).split())
        return text, False, False
    bare = _SKIP.sub("", bare)
    text = " ".join(html_.unescape(_TAG.sub(" ", bare)).split())
    if not text:
        return "", any(n.lower() in _CONTAINER for n in _NAME.findall(bare)), False
    low = bare.lower()
    linked = "<a" in low and not re.search(r"\w", html_.unescape(_TAG.sub("", _LINK.sub("", bare))))
    return text, False, linked


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(visible text, boundary, links only) of each line of a page, head, scripts and notices without scripts left out."""
    out = []
    head = bool(re.search(r"(?i)</head\s*>|<body\b", page))
    inside = None
    for line in page.split("\n"):
        bare = line
        if inside:
            m = re.search(rf"(?i)</{inside}\s*>", bare)
            if not m:
                out.append(("", False, False))
                continue
            bare, inside = bare[m.end() :], None
        if head:
            m = re.search(r"(?i)</head\s*>|<body\b", bare)
            if not m:
                out.append(("", False, False))
                continue
            bare, head = bare[m.start() :], False
        m = _OPENS.search(bare) if "<" in bare else None
        if m:
            inside, bare = m.group(1), bare[: m.start()]
        out.append(_line(bare))
    return out


def _host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1))


def _part_of(url: Column) -> Column:
    """The first part of the path."""
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/*([^/?#]*)", 1)


def plain(text: str) -> str:
    """A line with its numbers alike."""
    return _DIGITS.sub("0", text)


def tokens_of(text: str) -> list[str]:
    return ["0" if t.isdigit() else t for t in _TOKEN.findall(text.lower())]


def line_features(lines: list[tuple[str, bool]], hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words, pairs of words and shape of each (line, links only), and the number of the line each slot is of."""
    flat, sizes, shapes = [], [], []
    for text, linked in lines:
        w = tokens_of(text)
        flat += ["^", *w, "$"]
        sizes.append(len(w) + 2)
        shapes.append(f"<{int(linked)}{min(len(text) // 40, 4)}")
    if not lines:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of = np.repeat(np.arange(len(lines)), sizes)
    h = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
    ends = np.cumsum(sizes)
    word = np.ones(len(flat), bool)
    word[ends - 1] = word[np.r_[0, ends[:-1]]] = False
    pair = np.ones(len(flat), bool)
    pair[ends - 1] = False
    one = _mix(h[word] + np.uint64(7))
    two = _mix(h[pair] * np.uint64(31) + h[1:][pair[:-1]])
    kind = _mix(np.fromiter(map(hashes.__getitem__, shapes), np.uint64, len(shapes)))
    return (np.concatenate([one, two, kind]) >> np.uint64(19)).astype(np.int64) & (WORDS - 1), np.concatenate([of[word], of[pair], np.arange(len(lines))])


def features(text: str, linked: bool, hashes: WordHash) -> np.ndarray:
    """Slots of one line; numbers count as one."""
    return line_features([(text, linked)], hashes)[0]


def common_lines(a: list[str], b: list[str]) -> tuple[set[int], float]:
    """Positions in ``a`` of a longest common subsequence with ``b``; its share of the shorter list."""
    n, m = len(a), len(b)
    if not n or not m:
        return set(), 0.0
    lo = 0
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    got = {*range(lo), *range(n - hi, n)}
    x, y = a[lo : n - hi], b[lo : m - hi]
    both = set(x) & set(y)
    xi, yi = [i for i, v in enumerate(x) if v in both], [v for v in y if v in both]
    if xi and yi:
        # Hunt and Szymanski: longest increasing run of matching places
        places: dict[str, list[int]] = {}
        for j, v in enumerate(yi):
            places.setdefault(v, []).append(j)
        import bisect

        ends: list[int] = []
        links: list[tuple | None] = []
        for i in xi:
            for j in reversed(places[x[i]]):
                k = bisect.bisect_left(ends, j)
                node = (i, links[k - 1] if k else None)
                if k == len(ends):
                    ends.append(j)
                    links.append(node)
                else:
                    ends[k], links[k] = j, node
        node = links[-1] if links else None
        while node:
            got.add(node[0] + lo)
            node = node[1]
    return got, len(got) / min(n, m)


def _copies(pages: list[tuple[str, str, str, list]]) -> list[tuple[int, int]]:
    """(first, last) of the run each page is in: neighbours of one host and first part that are all copies of each other, since the lines common to all are 95 % of each."""
    runs: list[list[int]] = []
    core, most, known = set(), 0, set()
    for i, (host, part, _, t) in enumerate(pages):
        if runs and t and (host, part) == pages[i - 1][:2]:
            head = pages[runs[-1][0]][3]
            longest = max(most, len(t))
            if len(core) >= 0.95 * longest and sum(x in known for x in t) >= 0.95 * longest:
                left = core if t == head else core & common_lines(head, t)[0]
                if len(left) >= 0.95 * longest:
                    core, most = left, longest
                    runs[-1][1] = i
                    continue
        runs.append([i, i])
        core, most, known = set(range(len(t))), len(t), set(t)
    return [(a, b) for a, b in runs for _ in range(a, b + 1)]


def _site(pages: list[tuple[str, str, str, list]], ends: tuple[bool, bool] = (True, True), wanted: list[bool] | None = None) -> list[tuple[set[int] | None, bool]]:
    """For each (host, first part of the path, url, lines), sorted, the places of lines shared with its nearest pages, None without one; whether it is settled.

    The nearest pages are those before and after it of another URL and the same first part, or of any part of
    the host where there is none; one that is a copy in all but its URL says nothing and is passed over.
    ``ends``: whether nothing comes before the first page and after the last; a page whose search runs off an
    open end is not settled. ``wanted``: the pages that are asked for, all by default; others give (None, False).
    """
    n = len(pages)
    last = list(range(n))
    for i in range(n - 2, -1, -1):
        if pages[i][:3] == pages[i + 1][:3]:
            last[i] = last[i + 1]
    first = list(range(n))
    for i in range(1, n):
        if pages[i][:3] == pages[i - 1][:3]:
            first[i] = first[i - 1]

    runs = _copies(pages)

    def nearest(i: int, step: int, whole: bool) -> tuple[set[int] | None, bool]:
        host, part, url, t = pages[i]
        j = i + step
        while 0 <= j < n:
            if pages[j][0] != host or not whole and pages[j][1] != part:
                return None, True
            if pages[j][1:3] == (part, url):
                j = (first[i] - 1) if step < 0 else last[i] + 1
                continue
            if runs[j] == runs[i]:
                j = runs[i][0] - 1 if step < 0 else runs[i][1] + 1
                continue
            shared, _ = common_lines(t, pages[j][3])
            if not t or len(shared) < 0.95 * len(t):
                return shared, True
            j += step
        return None, ends[step > 0]

    out: list[tuple[set[int] | None, bool]] = []
    for i in range(n):
        if wanted is not None and not wanted[i]:
            out.append((None, False))
            continue
        for whole in (False, True):
            sides = [nearest(i, step, whole) for step in (-1, 1)]
            got = [x for x, _ in sides if x is not None]
            settled = all(x for _, x in sides)
            if got or not settled:
                break
        out.append((set().union(*got) if got else None, settled))
    return out


def _aligned(distinct: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((host, part, url, lines, shared), the stored tables it reads): a byte per line, 1 shared with a nearest page and 0 own; null without one.

    Distinct pages are numbered in the order of host, first part and URL, and aligned in blocks of BLOCK
    numbers that also see the pages next to them. What is not settled by these is tried again with ever more
    pages around it, so that results do not depend on where blocks end, and no task gets a hot host whole.
    """
    spark = distinct.sparkSession
    by = ["host", "part", "url", "lines"]
    rows = stored(distinct.repartitionByRange(slots(spark), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "sites")
    task = F.shiftright("at", 33)
    before, total = {}, 0
    for r in sorted(rows.groupBy(task.alias("task")).count().collect()):  # one row a task
        before[r["task"]], total = total, total + r["count"]
    starts = F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(max(before, default=0) + 1)])
    todo, reach, done, steps = None, REACH, [], [rows]
    rows = rows.withColumn("at", F.element_at(starts, (task + 1).cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1))
    form = "host string, part string, url string, lines binary, at long, shared binary, settled boolean"

    while True:
        seen = rows.withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.col("at") - reach, F.lit(0)) / BLOCK), F.floor(F.least(F.col("at") + reach, F.lit(max(total - 1, 0))) / BLOCK))))
        if todo is None:
            seen = seen.withColumn("wanted", F.floor(F.col("at") / BLOCK) == F.col("block"))
        else:
            blocks = todo.select(F.floor(F.col("at") / BLOCK).alias("block")).distinct()
            seen = seen.join(blocks.hint("merge"), "block", "left_semi").join(todo.select("at", F.lit(True).alias("_open")).hint("merge"), "at", "left")
            seen = seen.withColumn("wanted", F.col("_open").isNotNull() & (F.floor(F.col("at") / BLOCK) == F.col("block"))).drop("_open")

        def align(t: pa.Table) -> pa.Table:
            t = t.sort_by("at")
            at, wanted = t.column("at").to_pylist(), t.column("wanted").to_pylist()
            raw = t.column("lines").to_pylist()
            lines = [[x[k : k + 8] for k in range(0, len(x), 8)] for x in raw]
            got = _site(list(zip(*(t.column(c).to_pylist() for c in by[:3]), lines)), (at[0] == 0, at[-1] == total - 1), wanted)
            keep = [i for i, w in enumerate(wanted) if w]
            shared = [None if got[i][0] is None else bytes(k in got[i][0] for k in range(len(lines[i]))) for i in keep]
            t = t.select([*by, "at"]).take(pa.array(keep, pa.int64()))
            return t.append_column("shared", pa.array(shared, pa.binary())).append_column("settled", pa.array([got[i][1] for i in keep], pa.bool_()))

        got = stored(seen.groupBy("block").applyInArrow(align, form), "aligned")
        steps.append(got)
        done.append(got.where("settled").select(*by, "shared"))
        todo = got.where(~F.col("settled")).select("at")
        if todo.isEmpty():
            break
        reach *= 16
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out, steps


def differenced(pages: DataFrame, keys: list[str], url: str, html: str) -> DataFrame:
    """Each page as lines: ``_texts``, ``_kinds`` (a byte per line), ``_notices`` (what shows without scripts) and ``shared``.

    ``shared`` is a byte per line: 1 struck by differencing, 0 own, 2 no page to compare with. Pages of equal
    URL and equal lines are one until the result is expanded; those without a URL meet each other as one URL.
    ``_host`` is kept. Null html has no row.
    """
    rows = pages.select(*keys, F.coalesce(F.col(url), F.lit("")).alias("_url"), F.col(html).alias("_html")).where(F.col("_html").isNotNull())
    rows = rows.withColumn("_host", _host_of(F.col("_url"))).withColumn("_part", _part_of(F.col("_url"))).withColumn("_url", F.regexp_replace(F.regexp_replace("_url", r"(?s)#.*$", ""), r"/+$", ""))
    kinds = dict(rows.dtypes)
    names = [*keys, "_host", "_part", "_url"]
    form = ", ".join(f"`{k}` {kinds[k]}" for k in names)
    strings = pa.list_(pa.string())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for b in batches:
            texts, marks, notices, lines = [], [], [], []
            for page in b.column("_html").to_pylist():
                seen = lines_of(page)
                texts.append([t for t, _, _ in seen])
                marks.append(bytes((LINKED if linked else TEXT) if t else BOUNDARY if edge else NOTHING for t, edge, linked in seen))
                notices.append(notices_of(page))
                if len(known) > KNOWN:
                    known.clear()
                hashes = []
                for t in texts[-1]:
                    if t:
                        h = known.get(t)
                        if h is None:
                            h = known[t] = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                        hashes.append(h)
                lines.append(b"".join(hashes))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(texts, strings), pa.array(marks, pa.binary()), pa.array(notices, strings), pa.array(lines, pa.binary())], [*names, "_texts", "_kinds", "_notices", "_lines"])

    rows = stored(rows.select(*names, "_html").mapInArrow(parse, f"{form}, _texts array<string>, _kinds binary, _notices array<string>, _lines binary"), "parsed")
    site = rows.select(F.col("_host").alias("host"), F.col("_part").alias("part"), F.col("_url").alias("url"), F.col("_lines").alias("lines"))
    aligned, steps = _aligned(site.distinct())
    found = aligned.select(F.col("host").alias("_host"), F.col("part").alias("_part"), F.col("url").alias("_url"), F.col("lines").alias("_lines"), F.col("shared").alias("_shared"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for kind, shared in zip(b.column("_kinds").to_pylist(), b.column("_shared").to_pylist()):
                m = np.frombuffer(kind, np.uint8) & 1
                m[m > 0] = 2 if shared is None else np.frombuffer(shared, np.uint8)
                marks.append(m.tobytes())
            rest = [*keys, "_host", "_texts", "_kinds", "_notices"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), pa.array(marks, pa.binary())], [*rest, "shared"])

    both = rows.join(found.hint("merge"), ["_host", "_part", "_url", "_lines"])
    out = both.select(*keys, "_host", "_texts", "_kinds", "_notices", "_shared").mapInArrow(mark, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _host string, _texts array<string>, _kinds binary, _notices array<string>, shared binary")
    out = stored(out, "differenced")
    discard(rows, *steps)
    return out


def notices_of(page: str) -> list[str]:
    """What a page shows only where scripts do not run."""
    if "<noscript" not in page.lower():
        return []
    return [t for x in _NOSCRIPT.findall(page) if (t := " ".join(html_.unescape(_TAG.sub(" ", x)).split()))]


class LineModel:
    """Log odds of own against shared lines, by words; positive for content."""

    def __init__(self, own: np.ndarray, shared: np.ndarray):
        a, b = own.sum() + 1, shared.sum() + 1
        self.odds = np.clip(np.log((own + 0.3) / (a + 0.3 * WORDS)) - np.log((shared + 0.3) / (b + 0.3 * WORDS)), -4, 4)
        self.odds[(own + shared) == 0] = 0
        self.hashes = WordHash()
        self.known: dict[tuple[str, bool], float] = {}

    def scores(self, lines: list[tuple[str, bool]]) -> np.ndarray:
        """The score of each (text, links only); new lines are scored in one go."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [k for k in dict.fromkeys(lines) if k not in self.known]
        if new:
            at, of = line_features([(plain(t), linked) for t, linked in new], self.hashes)
            total, n = np.bincount(of, weights=self.odds[at], minlength=len(new)), np.bincount(of, minlength=len(new))
            self.known.update(zip(new, np.clip(total / np.sqrt(n) + 0.4, -4, 4).tolist()))
        return np.array([self.known[k] for k in lines])

    def score(self, text: str, linked: bool) -> float:
        return float(self.scores([(text, linked)])[0])


def main_lines(sizes: list[int], kinds: bytes, shared: bytes, scores: np.ndarray, residue: list[float] | None = None) -> list[int]:
    """Numbers of the lines of the main body. ``residue``: the share of residue of each line, which then counts as if it were content."""
    blocks: list[list[tuple[int, float]]] = [[]]
    scores = scores.tolist()
    for i, kind in enumerate(kinds):
        if kind == BOUNDARY:
            if blocks[-1]:
                blocks.append([])
        elif kind:
            own = scores[i]
            s = STRUCK if shared[i] == 1 else own
            if residue is not None and s < 1.5 and own > WORST and residue[i] > 0.6:
                s = 1.5
            blocks[-1].append((i, s))
    half = sum(map(len, blocks)) / 2
    blocks = [part for b in blocks if b for part in (_split(b) if len(b) > half else [b])]
    if not blocks:
        return []
    # a line's weight grows with its length: prose says more than a label
    total = [_weight(b, sizes) for b in blocks]
    if max(total) <= 0:
        blocks = [part for b in blocks for part in _split(b)]
        total = [_weight(b, sizes) for b in blocks]
    best = int(np.argmax(total))
    if total[best] <= 0:
        return []
    lo = hi = best
    while lo > 0 and total[lo - 1] > 0:
        lo -= 1
    while hi + 1 < len(blocks) and total[hi + 1] > 0:
        hi += 1
    return [i for b in blocks[lo : hi + 1] for i, s in b if s > -1.0]


def _weight(block: list[tuple[int, float]], sizes: list[int], low: float = -1.5) -> float:
    """Score of a block; a bad line between good ones, such as a remark within the text, does not count against it."""
    bad = [s < low for _, s in block]
    alone = [b and not (k and bad[k - 1]) and not (k + 1 < len(bad) and bad[k + 1]) for k, b in enumerate(bad)]
    return sum(0 if a and len(block) > 1 else s * min(sizes[i], 200) ** 0.5 for (i, s), a in zip(block, alone))


def _split(block: list[tuple[int, float]], low: float = -1.5) -> list[list[tuple[int, float]]]:
    """A block cut around runs of two and more bad lines: pages without containers have no other seams."""
    out: list[list[tuple[int, float]]] = [[]]
    bad = [s < low for _, s in block]
    for k, x in enumerate(block):
        run = bad[k] and ((k > 0 and bad[k - 1]) or (k + 1 < len(block) and bad[k + 1]))
        if out[-1] and run != out[-1][-1][2]:
            out.append([])
        out[-1].append((*x, run))
    return [[(i, s) for i, s, _ in part] for part in out if part]


class Page(NamedTuple):
    """A page as lines, with the scores of its lines and its main body by them."""

    texts: list[str]
    kinds: bytes
    shared: bytes
    notices: list[str]
    scores: np.ndarray
    body: np.ndarray

    @staticmethod
    def all_of(b: pa.RecordBatch) -> list[Page]:
        cols = [b.column(c).to_pylist() for c in ("_texts", "_kinds", "shared", "_notices", "scores", "body")]
        return [Page(*x[:4], np.frombuffer(x[4], np.float32), np.frombuffer(x[5], np.int32)) for x in zip(*cols)]


def read_many(pages: list[Page], residue: ResidueModel) -> Iterator[tuple[list[int], bool]]:
    """(main body, with residue counted as content; whether that is residue) of each page."""
    seen = [[bool(t) and s > WORST for t, s in zip(p.texts, p.scores.tolist())] for p in pages]
    residue.measure([t for p, ok in zip(pages, seen) for t in [*(x for x, k in zip(p.texts, ok) if k), *p.notices]])
    for p, ok in zip(pages, seen):
        if not any(p.texts):
            yield [], residue.is_residue(p.notices)
            continue
        share = [residue.share(t) if k else 0.0 for t, k in zip(p.texts, ok)]
        if any(x > 0.6 and (s < 1.5 or m == 1) for x, s, m in zip(share, p.scores, p.shared)):
            whole = main_lines([len(t) for t in p.texts], p.kinds, p.shared, p.scores, share)
        else:
            whole = p.body.tolist()
        yield whole, residue.is_residue([p.texts[i] for i in whole])


def line_types(marked: DataFrame) -> DataFrame:
    """(line, linked, own, shared, hosts): every distinct line of the corpus, how often it was found own and struck, on how many hosts it stands unstruck."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, bool, str], list[int]] = {}
            for host, texts, kinds, shared in zip(*(b.column(c).to_pylist() for c in ("_host", "_texts", "_kinds", "shared"))):
                for t, kind, m in zip(texts, kinds, shared):
                    if t:
                        seen.setdefault((plain(t), kind == LINKED, host), [0, 0, 0])[m] += 1
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in seen], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))), *(pa.array([n[i] for n in seen.values()], pa.int64()) for i in range(3))], ["line", "linked", "host", "own", "shared", "alone"])

    got = marked.select("_host", "_texts", "_kinds", "shared").mapInArrow(run, "line string, linked boolean, host string, own long, shared long, alone long")
    # a line of every host is no hot key: it is counted by host first
    got = got.groupBy("line", "linked", "host").agg(*(F.sum(c).alias(c) for c in ("own", "shared", "alone")))
    return got.groupBy("line", "linked").agg(F.sum("own").alias("own"), F.sum("shared").alias("shared"), F.count_if(F.col("own") + F.col("alone") > 0).alias("hosts"))


def line_tables(types: DataFrame) -> dict[str, np.ndarray]:
    """Word counts over distinct own and struck lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = {"own": np.zeros(WORDS, np.int64), "shared": np.zeros(WORDS, np.int64)}, WordHash()
        for b in batches:
            line, linked, own, shared = (b.column(c).to_pylist() for c in ("line", "linked", "own", "shared"))
            for name, pick in (("shared", [s > 0 for s in shared]), ("own", [s == 0 and o > 0 for s, o in zip(shared, own)])):
                at, _ = line_features([(t, x) for t, x, p in zip(line, linked, pick) if p], hashes)
                total[name] += np.bincount(at, minlength=WORDS)
        yield batch_of(total)

    return summed(types.mapInArrow(run, "kind string, part int, at binary, n binary"), {"own": WORDS, "shared": WORDS})


def _chars(pages: DataFrame) -> np.ndarray:
    """Character counts of the main bodies of scored pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = CharModel()
        for b in batches:
            m.add_all([f" {plain(p.texts[i])} " for p in Page.all_of(b) for i in p.body])
        yield batch_of({"natural": m.counts.ravel()})

    return summed(pages.mapInArrow(run, "kind string, part int, at binary, n binary"), {"natural": 3 * SLOTS})["natural"]


def read_pages(pages: DataFrame, keys: list[str], url: str, html: str, seeds: DataFrame | None = None) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(the key columns, main array<int>: lines of the main body, residue boolean; the tables of the models).

    A page that is residue has no main body. Null html has no row, empty html one without lines; every page
    has one, copies included; an empty table gives an empty result. ``seeds``: a column of texts known to be
    residue, beside what the pages tell themselves.
    """
    spark = pages.sparkSession
    marked = differenced(pages, keys, url, html)
    types = stored(line_types(marked), "line_types")
    tables = line_tables(types)
    line_model = Shared(spark, {k: tables[k] for k in ("own", "shared")})
    kinds = dict(marked.dtypes)
    form = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    rest = [*keys, "_texts", "_kinds", "_notices", "shared"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LineModel(**line_model.value)
        for b in batches:
            texts, marks, shared = (b.column(c).to_pylist() for c in ("_texts", "_kinds", "shared"))
            scores, bodies, sizes = [], [], []
            for lo in range(0, len(texts), PAGES):
                part = list(zip(texts[lo : lo + PAGES], marks[lo : lo + PAGES], shared[lo : lo + PAGES]))
                flat = model.scores([(t, k == LINKED) for ts, ks, _ in part for t, k in zip(ts, ks) if t])
                at = 0
                for ts, ks, ms in part:
                    filled = [i for i, t in enumerate(ts) if t]
                    s = np.zeros(len(ts), np.float32)
                    s[filled] = flat[at : at + len(filled)]
                    at += len(filled)
                    body = main_lines([len(t) for t in ts], ks, ms, s)
                    scores.append(s.tobytes())
                    bodies.append(np.array(body, np.int32).tobytes())
                    sizes.append(sum(len(ts[i]) for i in body))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), pa.array(scores, pa.binary()), pa.array(bodies, pa.binary()), pa.array(sizes, pa.int32())], [*rest, "scores", "body", "size"])

    lines = "_texts array<string>, _kinds binary, _notices array<string>, shared binary, scores binary, body binary"
    scored = stored(marked.mapInArrow(score, f"{form}, {lines}, size int"), "scored")

    # natural prose is learned from the longer half of the bodies, residue first from what repeats over hosts
    steps = {r["step"]: r["count"] for r in scored.where("size > 0").groupBy(F.least(F.floor(4 * F.log2(F.col("size") + 1)), F.lit(ResidueModel.STEPS - 1)).alias("step")).count().collect()}
    half, seen = 0, 0
    for half in sorted(steps):
        seen += steps[half]
        if 2 * seen >= sum(steps.values()):
            break
    least = int(np.ceil(2 ** (half / 4))) - 1
    tables["natural"] = _chars(scored.where(F.col("size") >= least).select("_texts", "_kinds", "shared", "_notices", "scores", "body"))
    repeated = types.where((F.col("hosts") >= max(HOSTS, REPEATED * scored.count())) & (F.col("shared") * 4 <= F.col("own"))).select(F.col("line").alias("text"))
    told = scored.select(F.explode("_notices").alias("text")).unionByName(repeated)
    told = told if seeds is None else told.unionByName(seeds.toDF("text"))
    first, every = seed_counts(told), tables["natural"]
    discard(marked, types)
    tables["residue"], tables["bodies"] = first, np.zeros((2, ResidueModel.STEPS), np.int64)
    sizes = {"bad": 3 * SLOTS, "long": 3 * SLOTS, "bodies": 2 * ResidueModel.STEPS}
    clear, todo = np.zeros(2 * ResidueModel.STEPS, np.int64), scored

    for step in range(ROUNDS):
        known = Shared(spark, {k: tables[k] for k in ("natural", "residue", "bodies")})

        def learn(b: pa.RecordBatch, model: ResidueModel, counts: dict, open_: list[int] | None) -> None:
            for lo in range(0, b.num_rows, PAGES):
                part = Page.all_of(b.slice(lo, PAGES))
                bad, long = [], []
                for i, (p, (body, hit)) in enumerate(zip(part, read_many(part, model))):
                    size = sum(len(p.texts[j]) for j in body)
                    ratio = model.ratio([p.texts[j] for j in body])
                    if open_ is not None and (ratio > UNCLEAR * size or not body):
                        open_.append(lo + i)
                    elif hit or ratio < -CONFIDENT:
                        counts["bodies"][int(hit) * ResidueModel.STEPS + model.step(size)] += 1
                    if hit:
                        bad += [f" {plain(p.texts[j])} " for j in body]
                        if sum(len(p.texts[j]) for j in p.body) >= least:
                            long += [f" {plain(p.texts[j])} " for j in p.body]
                counts["bad"].add_all(bad)
                counts["long"].add_all(long)

        def fresh() -> dict:
            return {"bad": CharModel(), "long": CharModel(), "bodies": np.zeros(2 * ResidueModel.STEPS, np.int64)}

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            model, counts = ResidueModel(known.value), fresh()
            for b in batches:
                learn(b, model, counts, None)
            yield batch_of({k: getattr(v, "counts", v).ravel() for k, v in counts.items()})

        def screen(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            # the pages that are not clear go on as they are; what the clear ones add to the counts is one row of bytes
            model, counts = ResidueModel(known.value), fresh()
            for b in batches:
                open_: list[int] = []
                learn(b, model, counts, open_)
                t = b.take(pa.array(open_, pa.int64()))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.nulls(len(open_), pa.binary())], [*b.schema.names, "clear"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, b_.type) for b_ in _SCORED] + [pa.array([counts["bodies"].tobytes()], pa.binary())], [*(f.name for f in _SCORED), "clear"])

        if step == 0:
            got_ = stored(scored.select("_texts", "_kinds", "_notices", "shared", "scores", "body").mapInArrow(screen, f"{lines}, clear binary"), "unclear")
            for r in got_.where("clear is not null").select("clear").collect():  # one row a task
                clear = clear + np.frombuffer(r["clear"], np.int64)
            todo = got_.where("clear is null").drop("clear")
        got = summed(todo.mapInArrow(count, "kind string, part int, at binary, n binary"), sizes)
        tables["natural"] = np.maximum(every - got["long"], 0)
        tables["residue"] = first + got["bad"]
        tables["bodies"] = (clear + got["bodies"]).reshape(2, -1)
    discard(got_)
    last = Shared(spark, {k: tables[k] for k in ("natural", "residue", "bodies")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ResidueModel(last.value)
        for b in batches:
            got = []
            for lo in range(0, b.num_rows, PAGES):
                part = Page.all_of(b.slice(lo, PAGES))
                got += [([] if bad else p.body.tolist(), bad) for p, (_, bad) in zip(part, read_many(part, model))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([m for m, _ in got], pa.list_(pa.int32())), pa.array([r for _, r in got], pa.bool_())], [*keys, "main", "residue"])

    return scored.drop("size").mapInArrow(run, form + ", main array<int>, residue boolean"), tables


def not_codes(df: DataFrame, keys: list[str], text: str, code: str = CODE) -> DataFrame:
    """The keys and texts that are filled and do not have the form of a failure code."""
    return df.select(*keys, F.col(text).alias("_text")).where((F.length("_text") > 0) & ~F.col("_text").rlike(code))


def residue_texts(df: DataFrame, keys: list[str], text: str, tables: dict[str, np.ndarray], code: str = CODE) -> DataFrame:
    """The keys of short texts that are residue where a code should stand; null, empty and proper codes are none."""
    shared = Shared(df.sparkSession, {k: tables[k] for k in ("natural", "residue", "bodies")})

    @F.pandas_udf("boolean")
    def is_residue(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = ResidueModel(shared.value)
        for s in texts:
            shown = [html_.unescape(_TAG.sub(" ", t)) if _TAG.sub("", t).strip() else t for t in s]
            model.measure(shown)
            yield pd.Series([model.is_residue([t], even=True) for t in shown], dtype=bool)

    return not_codes(df, keys, text, code).where(is_residue("_text")).select(*keys)
