"""Problem 5: text decoded with the wrong character encoding: found, and restored where that is possible.

Method: smoothed character n-gram models are trained on clean records, and every chain of a wrong decoding
(bytes written in one encoding, read in another, once or twice) is undone on each stretch of text around
characters beyond ASCII. A stretch counts as garbled if the likeliest undone form beats the text as it is by
more than MARGIN, in nats over the stretch; or if one chain improves most of the stretches of a text it
applies to, and by more than MARGIN together. The margin is validated in the tests on clean text, on text
garbled on purpose and on look-alikes. Replacement and control characters mark text that is lost for good.

There are two rounds: the first trains on all stretches that hold no obvious damage; the second leaves out
the texts found garbled in the first, and judges again those that any chain improved at all.

Text garbled in part is found as well, and its sound stretches stay as they are. The model tables have a
fixed number of slots.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.counts import Shared, batch_of, summed
from quarrymill.runtime import stored

SLOTS = 1 << 20
MARGIN = 1.1
CONTEXT = 2
SAVED = 0.5
STEPS = 2.0
#: Encodings text was written in, and encodings it was read in by mistake.
WRITTEN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "mac-roman", "cp437", "gb18030", "shift_jis", "euc-jp", "big5", "euc-kr")
READ = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-2", "mac-roman", "cp437", "koi8-r", "iso8859-15", "cp850", "gb18030", "shift_jis", "big5", "cp866")
#: Wrong readings by which the operator is tried out.
SPOILT = (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("cp1252", "cp1251"))
SINGLE = frozenset(("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "mac-roman", "cp437"))
STRETCH = re.compile(r"[^\x00-\x7f]+(?: [^\x00-\x7f]+)*")
#: What UTF-8 read wrongly usually held: Latin letters and signs, Cyrillic, typographic signs, Han and its punctuation.
USUAL = re.compile("[\u00a0-\u017f\u0400-\u045f\u2010-\u203a\u20ac\u2122\u3000-\u303f\u4e00-\u9fff\uff00-\uffef]")
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
#: Character references, save those for the signs of markup; and those by number for ASCII, which are left as they are.
REFERENCE = r"&(?:#(?:[0-9]{3,7}(?![0-9])|[xX][0-9a-fA-F]{2,6}(?![0-9a-fA-F]))|(?!amp;|lt;|gt;|quot;|apos;|nbsp;)[A-Za-z][A-Za-z0-9]{1,31});?"
_REFERENCE = re.compile(REFERENCE)
LONGEST = 48
BATCH = 1000


def unreferenced(text: str) -> str:
    """``text`` with the references to characters beyond ASCII as these characters; all others stay."""

    def one(m: re.Match) -> str:
        c = html.unescape(m.group())
        return m.group() if c.isascii() else c

    return _REFERENCE.sub(one, text)


class _Loose:
    """Encoding back into bytes as lenient readers decode: bytes without a character are the control characters of that number."""

    def __init__(self):
        self.maps: dict[str, dict[str, int]] = {}

    def encode(self, text: str, name: str) -> bytes | None:
        if name in ("gb18030", "shift_jis", "big5"):
            try:
                return text.encode(name)
            except UnicodeEncodeError:
                return None
        table = self.maps.get(name)
        if table is None:
            table = {}
            for b in range(256):
                try:
                    table[bytes([b]).decode(name)] = b
                except UnicodeDecodeError:
                    table.setdefault(chr(b), b)
            for b in range(0x80, 0xA0):
                table.setdefault(chr(b), b)
            self.maps[name] = table
        try:
            return bytes([table[c] for c in text])
        except KeyError:
            return None


LOOSE = _Loose()


def undone(text: str) -> Iterator[tuple[str, str]]:
    """(chain, text) for each chain that could have led to ``text``, once or twice over."""
    seen = {text}
    todo = [("", text, 0)]
    while todo:
        chain, t, depth = todo.pop()
        for r in READ:
            raw = LOOSE.encode(t, r)
            if raw is None:
                continue
            for w in WRITTEN:
                if w == r or (depth and w != "utf-8"):
                    continue
                try:
                    u = raw.decode(w)
                except UnicodeDecodeError:
                    continue
                if u in seen or LOST.search(u) and not LOST.search(t):
                    continue
                seen.add(u)
                yield f"{chain}{w}>{r}", u
                if depth == 0 and w == "utf-8" and not u.isascii():
                    todo.append((f"{w}>{r},", u, 1))


def mended(text: str) -> str | None:
    """``text`` with its valid UTF-8 runs put right if bytes were lost on the way, else None: a sign of garbling that can't be undone."""
    for r in ("cp1252", "latin-1", "mac-roman", "cp437", "cp1251", "cp1250"):
        raw = LOOSE.encode(text, r)
        if raw is None:
            continue
        u = raw.decode("utf-8", "ignore")
        if u and not u.isascii() and len(re.findall(rb"[\xc2-\xf4][\x80-\xbf]", raw)) * 2 >= sum(b >= 0x80 for b in raw) * 0.6:
            return u
    return None


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _hash(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(11)) & np.uint64(SLOTS - 1)).astype(np.int64)


class CharModel:
    """Interpolated model of 1 to 3 characters, smoothed down to a uniform one."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((3, SLOTS), np.int64) if counts is None else counts

    @staticmethod
    def slots(text: str) -> list[np.ndarray]:
        c = np.r_[np.zeros(2, np.uint64), _codes(text)]
        return [_hash([c[2:]]), _hash([c[1:-1], c[2:]]), _hash([c[:-2], c[1:-1], c[2:]])]

    def add(self, text: str, times: int = 1) -> None:
        for k, s in enumerate(self.slots(text)):
            np.add.at(self.counts[k], s, times)

    def add_all(self, texts: list[str]) -> None:
        """Count many texts at once, in parts of about a million characters."""
        part, size = [], 0
        for i, t in enumerate(texts):
            part.append((t, 1))
            size += len(t)
            if size > 1_000_000 or i == len(texts) - 1:
                _add_all(self, part)
                part, size = [], 0

    def logps(self, texts: list[str]) -> np.ndarray:
        """Log probability of the characters of each text."""
        if not texts:
            return np.empty(0)
        ends = np.cumsum([len(t) + 2 for t in texts])
        each = self._logp("\0\0".join(texts) + "\0\0")
        real = np.ones(len(each), bool)
        real[ends - 1] = real[ends - 2] = False
        return np.add.reduceat(np.where(real, each, 0), np.r_[0, ends[:-1]])

    def _logp(self, text: str) -> np.ndarray:
        return self.logp_at(self.slots(text))

    def logp_at(self, slots: list[np.ndarray]) -> np.ndarray:
        """Log probability of each character, by its slots."""
        s1, s2, s3 = slots
        c1, c2, c3 = self.counts[0][s1], self.counts[1][s2], self.counts[2][s3]
        total = max(int(self.counts[0].sum()) if not hasattr(self, "total") else self.total, 1)
        b1, b2 = np.r_[0, c1[:-1]], np.r_[0, c2[:-1]]
        p = 0.6 * np.minimum(c3 / np.maximum(b2, 1), 1) + 0.3 * np.minimum(c2 / np.maximum(b1, 1), 1) + 0.09999 * (c1 / total) + 1e-7
        return np.log(p)

    def done(self) -> CharModel:
        self.total = int(self.counts[0].sum())
        return self


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches beyond ASCII, long ones in parts."""
    for m in STRETCH.finditer(text):
        i, last = m.span()
        while i < last:
            j = min(i + LONGEST, last)
            if j < last and (k := text.rfind(" ", i + 1, j)) > i:
                j = k + 1  # a cut inside a word could part the bytes of a character
            yield i, j
            i = j


def framed(text: str, start: int, end: int) -> tuple[str, str, str]:
    """A stretch with the characters around it."""
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


def suspicious(stretch: str) -> bool:
    """Whether a stretch can be left out of training: it undoes to valid UTF-8, or holds what is lost."""
    if LOST.search(stretch):
        return True
    for r in READ[:8]:
        raw = LOOSE.encode(stretch, r)
        if raw is not None:
            try:
                if all(c < "\x80" or USUAL.match(c) for c in raw.decode("utf-8")):
                    return True
            except UnicodeDecodeError:
                pass
    return False


class Verdict:
    """What the chains make of one stretch: (gain, chain, text) of each that improves it, best first; lost: nothing can."""

    __slots__ = ("gains", "lost", "open")

    def __init__(self, gains: list[tuple[float, str, str]], lost: bool):
        self.gains, self.lost = gains, lost


class Judge:
    """Verdicts on stretches; each distinct stretch is judged once, all new ones of a batch in one go."""

    def __init__(self, model: CharModel, margin: float = MARGIN):
        self.model, self.margin = model, margin
        self.verdicts: dict[tuple[str, str, str], Verdict] = {}
        self.usual: dict[str, bool] = {}

    def _known(self, text: str) -> bool:
        """Whether clean text has all of these characters."""
        for c in text:
            k = self.usual.get(c)
            if k is None:
                k = self.usual[c] = c < "\x80" or bool(self.model.counts[0][_hash([_codes(c)])[0]] > 3)
            if not k:
                return False
        return True

    def learn(self, frames: set[tuple[str, str, str]]) -> None:
        if len(self.verdicts) > 300_000:
            self.verdicts.clear()
        new = [f for f in frames if f not in self.verdicts]
        texts, who = [], []
        for i, (a, x, z) in enumerate(new):
            texts.append(a + x + z)
            who.append((i, "", x))
            for chain, u in undone(x):
                if self._known(u):
                    texts.append(a + u + z)
                    who.append((i, chain, u))
            if LOST.search(x) or not self._known(x):
                u = mended(x)
                if u is not None and self._known(u):
                    texts.append(a + u + z)
                    who.append((i, "lost", u))
        scores = self.model.logps(texts)
        own, gains = [0.0] * len(new), [[] for _ in new]
        for (i, chain, u), v in zip(who, scores.tolist()):
            if not chain:
                own[i] = v
                continue
            g = v - own[i] - SAVED * max(0, len(new[i][1]) - len(u)) - STEPS * chain.count(">") - (STEPS if chain == "lost" else 0)
            if g > -STEPS:
                gains[i].append((g, chain, u))
        for f, g in zip(new, gains):
            g.sort(key=lambda x: -x[0])
            self.verdicts[f] = Verdict(g, bool(LOST.search(f[1])))

    def judge(self, text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str | None]], bool]:
        """(start, end, restored or None if lost) of the garbled stretches of a text; whether any chain improves any."""
        v = [self.verdicts[framed(text, s, e)] for s, e in spans]
        total: dict[str, list[float]] = {}
        for x in v:
            for g, chain, _ in x.gains:
                if chain != "lost":
                    t = total.setdefault(chain, [0.0, 0, 0])
                    t[0] += g + STEPS
                    t[1] += 1
                    t[2] += g > -STEPS / 2
        # a chain that improves most of what is there, and not by one stretch alone, is taken for the whole text
        odd = len(v)
        whole = {c for c, (g, n, good) in total.items() if good >= 3 and good >= 0.6 * odd and g - STEPS > self.margin + 2}
        out, open_ = [], False
        for (s, e), x in zip(spans, v):
            open_ = open_ or x.lost or bool(x.gains)
            best = x.gains[0] if x.gains else None
            if best and best[0] > self.margin:
                out.append((s, e, None if best[1] == "lost" else best[2]))
            elif x.lost:
                out.append((s, e, None))
            else:
                pick = next((g for g in x.gains if g[1] in whole), None)
                if pick:
                    out.append((s, e, pick[2]))
        return out, open_


def judged(texts: list[str], judge: Judge) -> Iterator[tuple[list[tuple[int, int, str | None]], bool]]:
    spans = [list(stretches(t)) for t in texts]
    judge.learn({framed(t, s, e) for t, sp in zip(texts, spans) for s, e in sp})
    for t, sp in zip(texts, spans):
        yield judge.judge(t, sp)


def restored(text: str, bad: list[tuple[int, int, str | None]]) -> str | None:
    """The text with its garbled stretches put right; None if one is lost."""
    if any(u is None for _, _, u in bad):
        return None
    out, at = [], 0
    for s, e, u in bad:
        out += [text[at:s], u]
        at = e
    return "".join(out) + text[at:]


def char_counts(df: DataFrame, text: str) -> np.ndarray:
    """Counts of 1 to 3 characters in all clean stretches of all rows: three tables of SLOTS entries, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = CharModel()
        for b in batches:
            seen: dict[tuple[str, str, str], int] = {}
            for t in b.column(0).to_pylist():
                for s, e in stretches(t):
                    k = framed(t, s, e)
                    seen[k] = seen.get(k, 0) + 1
            clean = [("".join(k), n) for k, n in seen.items() if not suspicious(k[1])]
            if clean:
                _add_all(m, clean)
        yield batch_of({"chars": m.counts.ravel()})

    return summed(df.select(text).mapInArrow(run, "kind string, part int, at binary, n binary"), {"chars": 3 * SLOTS})["chars"].reshape(3, SLOTS)


def _add_all(m: CharModel, items: list[tuple[str, int]]) -> None:
    """Count many short texts at once: they are joined by the two zeros each starts with."""
    text = "\0\0".join(k for k, _ in items)
    times = np.repeat(np.array([n for _, n in items], np.int64), [len(k) + 2 for k, _ in items])[: len(text)]
    real = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") != 0
    for k, s in enumerate(m.slots(text)):
        m.counts[k] += np.bincount(s[real], weights=times[real], minlength=SLOTS).astype(np.int64)


def garbled(df: DataFrame, keys: list[str], text: str, margin: float = MARGIN, with_text: bool = False) -> DataFrame:
    """The keys of rows with garbled text, stretches int, lost int and, if asked for, restored string.

    Characters written as references are judged like any others, and ``restored`` has them as characters. It
    is null where characters are lost. Null and empty texts and those of ASCII alone are never garbled and cost
    no Python. Equal rows come out once each; nothing is cut off.
    """

    @F.pandas_udf("string")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(unreferenced, na_action="ignore")

    t = F.col(text)
    rows = df.select(*keys, F.coalesce(read(F.when(t.rlike(REFERENCE), t)), t).alias("_text"))
    rows = stored(rows.where(F.col("_text").rlike(r"[^\x00-\x7F]")), "beyond_ascii")
    names = list(keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    every = char_counts(rows, "_text")
    first = Shared(df.sparkSession, {"chars": every})

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(CharModel(first.value["chars"]).done(), margin)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                b = whole.slice(lo, BATCH)
                hit, bad = [], []
                for i, (found, open_) in enumerate(judged(b.column(b.num_columns - 1).to_pylist(), judge)):
                    if open_:
                        hit.append(i)
                        bad.append(bool(found))
                take = pa.array(hit, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(j).take(take) for j in range(b.num_columns)] + [pa.array(bad, pa.bool_())], [*names, "_text", "_bad"])

    maybe = stored(rows.mapInArrow(suspects, f"{kinds}, _text string, _bad boolean"), "suspects")
    clean = Shared(df.sparkSession, {"chars": np.maximum(every - char_counts(maybe.where("_bad"), "_text"), 0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(CharModel(clean.value["chars"]).done(), margin)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                b = whole.slice(lo, BATCH)
                hit, n_bad, n_lost, good = [], [], [], []
                texts = b.column(len(names)).to_pylist()
                for i, (bad, _) in enumerate(judged(texts, judge)):
                    if bad:
                        hit.append(i)
                        n_bad.append(len(bad))
                        n_lost.append(sum(u is None for _, _, u in bad))
                        good.append(restored(texts[i], bad) if with_text else None)
                take = pa.array(hit, pa.int64())
                cols = [b.column(j).take(take) for j in range(len(names))] + [pa.array(n_bad, pa.int32()), pa.array(n_lost, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(good, pa.string())] if with_text else []), [*names, "stretches", "lost", *(["restored"] if with_text else [])])

    return maybe.select(*names, "_text").mapInArrow(run, f"{kinds}, stretches int, lost int" + (", restored string" if with_text else ""))


def round_trip(df: DataFrame, keys: list[str], text: str, margin: float = MARGIN) -> DataFrame:
    """(keys, chain, found, restored): texts garbled on purpose, whether that is found and undone to the letter.

    Each text beyond ASCII that is not garbled itself is read wrongly in one of the ways of SPOILT, which its
    hash picks, and stands beside the texts as they are; those that cannot be read that way have no row.
    """
    t = F.col(text)
    rows = df.select(F.struct(*keys).alias("id"), t.alias("text")).where(t.rlike(r"[^\x00-\x7F]"))
    rows = rows.join(garbled(rows, ["id"], "text", margin).select("id"), "id", "left_anti")
    pick = F.pmod(F.xxhash64("text"), F.lit(len(SPOILT))).cast("int")

    @F.pandas_udf("string")
    def spoil(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(text: str, k: int) -> str | None:
            try:
                return text.encode(SPOILT[k][0]).decode(SPOILT[k][1])
            except (UnicodeEncodeError, UnicodeDecodeError):
                return None

        for texts, ks in batches:
            yield pd.Series([one(x, k) for x, k in zip(texts, ks)], dtype=object)

    bad = stored(rows.withColumn("pick", pick).withColumn("bad", spoil("text", "pick")).where("bad is not null and bad <> text"), "spoilt")
    both = rows.select("id", F.lit(False).alias("made"), "text").unionByName(bad.select("id", F.lit(True).alias("made"), F.col("bad").alias("text")))
    got = garbled(both, ["id", "made"], "text", margin, with_text=True).where("made").select("id", F.col("restored").alias("back"), F.lit(True).alias("hit"))
    chain = F.element_at(F.array(*(F.lit(f"{w}>{r}") for w, r in SPOILT)), F.col("pick") + 1)
    return bad.join(got, "id", "left").select("id.*", chain.alias("chain"), F.coalesce("hit", F.lit(False)).alias("found"), F.coalesce(F.col("back") == F.col("text"), F.lit(False)).alias("restored"))
