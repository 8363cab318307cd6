"""Problem 4: template residue, filler, error messages and script notices in place of content.

Method: character n-gram models of residue and of natural prose; windows of a text whose likelihood ratio
favours residue are marked, and a page is excluded if they cover half of its main body, so pages that mention
or quote such text stay. How long a body is counts too: pages with content have hardly ever as little text as
a message, so the ratio of a whole body and that of its length decide together where coverage does not. New
wording is found by that.

Nothing is listed but marks. The residue model starts from what the corpus itself declares to be none of its
content (the notices pages show only without scripts, lines that stand word for word on many unrelated hosts
without being part of their design, texts that stand where a code should), from shapes that fields of a record
take in templates, and from the names the standard library has for errors. In rounds it then learns from the
bodies it marks. Natural prose is learned from the longer half of all bodies, less those marked.
"""

from __future__ import annotations

import builtins
import errno
import os
import signal
from collections.abc import Iterator
from functools import lru_cache
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrymill.llm.counts import batch_of, summed
from quarrymill.llm.encodings import SLOTS, CharModel
from quarrymill.sources.records import PROFILE

WINDOW = 24
COVERAGE = 0.5
RATIO = 0.25
KNOWN = 50_000
#: Marks of filler, and how often they count, so that they weigh like the other seeds.
FILLER, TIMES = ("lorem ipsum", "placeholder"), 100
# How template languages mark a place to fill.
MARKS = ("{{ %s }}", "${%s}", "<%%= %s %%>", "[%s]", "%%(%s)s", "<<%s>>", "<%s>", "«%s»", "@@%s@@", "##%s##", "{%% %s %%}", "{%s}", "__%s__", "*|%s|*", "[[%s]]", "%%%s%%", "#{%s}")


@lru_cache(maxsize=1)
def seeds() -> list[str]:
    """Texts of residue made by rule: marked fields of a record, statuses, errors and signals by their standard names."""
    fields = [f.split()[0] for f in PROFILE.replace("array<struct<text:string,href:string>>", "x").split(", ")]
    names = [g(x) for x in fields for g in (str, str.upper, lambda x: x.replace("_", " "), lambda x: x.replace("_", " ").title())]
    places = [m % x for m in MARKS for x in dict.fromkeys(names)]
    places += [f"{a} | {b}" for a, b in zip(places, places[1:])]
    status = [s for x in HTTPStatus if x >= 400 for s in (f"{int(x)} {x.phrase}", f"Error {int(x)}: {x.phrase}", x.description) if s]
    system = [os.strerror(n) for n in sorted(errno.errorcode)] + [signal.strsignal(s) or "" for s in sorted(signal.valid_signals())]
    raised = [f"{n}:" for n in sorted(dir(builtins)) if n.endswith(("Error", "Warning", "Exception"))]
    return [*places, *status, *system, *raised, *FILLER * TIMES]


def seed_counts(texts: DataFrame) -> np.ndarray:
    """Character counts of the distinct ones of ``texts`` and of the made ones."""
    from quarrymill.llm.page_text import plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = CharModel()
        for b in batches:
            m.add_all([f" {plain(t)} " for t in b.column(0).to_pylist() if t])
        yield batch_of({"seeds": m.counts.ravel()})

    got = summed(texts.distinct().mapInArrow(run, "kind string, part int, at binary, n binary"), {"seeds": 3 * SLOTS})["seeds"]
    made = CharModel()
    made.add_all([f" {plain(t)} " for t in seeds()])
    return got + made.counts.ravel()


class ResidueModel:
    """Likelihood ratio of residue against natural prose, by windows and over whole bodies."""

    #: Steps of the length of a body, four to each doubling.
    STEPS = 128

    def __init__(self, tables: dict[str, np.ndarray]):
        self.natural = CharModel(tables["natural"].reshape(3, -1)).done()
        self.kind = CharModel(tables["residue"].reshape(3, -1)).done()
        own, bad = tables["bodies"].astype(float).reshape(2, -1)
        # how much rarer bodies up to this length are with content than without
        self.prior = None
        if bad.sum():
            up = lambda n: (np.cumsum(n) + 0.5) / (n.sum() + 1.0)
            self.prior, self.odds = np.log(up(bad) / up(own)), float(np.log((bad.sum() + 0.5) / (own.sum() + 0.5)))
        self.known: dict[str, tuple[int, int, float]] = {}

    @staticmethod
    def step(n: int) -> int:
        return min(int(4 * np.log2(n + 1)), ResidueModel.STEPS - 1)

    def marked_many(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(characters in windows that favour residue, characters, likelihood ratio of the whole) of each text, in its plain form."""
        from quarrymill.llm.page_text import plain

        if not texts:
            return []
        framed = [f" {plain(t)} " for t in texts]
        slots = CharModel.slots("\0\0".join(framed) + "\0\0")
        sizes = np.array([len(t) for t in framed])
        starts = np.r_[0, np.cumsum(sizes + 2)[:-1]]
        ends = starts + sizes
        odds = np.clip(self.kind.logp_at(slots) - self.natural.logp_at(slots), -6, 6)
        total = np.r_[0.0, np.cumsum(odds)]
        end = np.repeat(ends, sizes + 2)
        at = np.arange(len(odds))
        # windows within a text; a text shorter than a window is one
        stop = np.where(np.repeat(sizes < WINDOW, sizes + 2) & (at == np.repeat(starts, sizes + 2)), end, at + WINDOW)
        ok = stop <= end
        at, stop = at[ok], stop[ok]
        good = total[stop] - total[at] > RATIO * (stop - at)
        edge = np.bincount(at[good], minlength=len(total)) - np.bincount(stop[good], minlength=len(total))
        inside = np.r_[0, np.cumsum(np.cumsum(edge)[:-1] > 0)]
        hit = inside[ends - 1] - inside[starts + 1]
        return list(zip(hit.tolist(), (sizes - 2).tolist(), (total[ends] - total[starts]).tolist()))

    def measure(self, texts: list[str]) -> None:
        """Look at each new text, all of them in one go."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        self.known.update(zip(new, self.marked_many(new)))

    def share(self, text: str) -> float:
        hit, n, _ = self.known[text]
        return hit / n if n else 0.0

    def ratio(self, body: list[str]) -> float:
        """The likelihood ratio of measured lines."""
        return sum(self.known[t][2] for t in body)

    def is_residue(self, body: list[str], even: bool = False) -> bool:
        """Whether a body of measured lines is residue; one without lines is not. ``even``: content is no likelier there than residue."""
        if not body:
            return False
        hit, n, ratio = (sum(x) for x in zip(*(self.known[t] for t in body)))
        if hit >= COVERAGE * n:
            return True
        prior = 0.0 if self.prior is None else self.prior[self.step(sum(map(len, body)))] + (0.0 if even else self.odds)
        return prior > 0 and ratio + prior > 0
