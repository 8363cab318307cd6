"""Problem 10: how demanding a text is to read, as a band.

Method: interpolated n-gram models (1, 2 and 3 words), one per band, trained on rated texts. Each window of
a text has a surprisal under each model; the distribution of the windows over the whole text gives its
difficulty, the mean band the windows point to, and isotonic regression maps difficulty to band without
ever going down. Whether a text is English is told by two models of the same kind on characters.

The models are fitted on a bounded sample of rated rows (SAMPLE of them at most, taken by hash of the id);
scoring covers every row and the whole of each text. Model tables have twice as many slots as the sample has
different runs, or more: fuller ones give a run the counts of others, and bands look alike. As the sample is
bounded, what is broadcast never grows with the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.words import WordHash, _mix, words_of

SAMPLE = 12_000
WINDOW = 12
SLOTS = 1 << 17  # at least
SHARES = np.array([0.45, 0.33, 0.2, 0.02])  # of 3, 2, 1 words and of the uniform model
LANGUAGE_SAMPLE = 4_000
CHAR_SLOTS = 1 << 16
LEAST_WORDS = 60


def _runs(h: np.ndarray) -> list[np.ndarray]:
    """Hash of each word alone, with the one before and with the two before."""
    pad = np.r_[np.zeros(2, np.uint64), h]
    one = _mix(pad[2:] + np.uint64(1))
    two = _mix(one * np.uint64(31) + pad[1:-1])
    three = _mix(two * np.uint64(31) + pad[:-2])
    return [x >> np.uint64(13) for x in (one, two, three)]


def _ids(text: str, hashes: WordHash) -> np.ndarray:
    w = words_of(text)
    return np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))


class BandModels:
    """Interpolated word models, one per band; ``difficulty`` maps a text to a number that grows with its band."""

    def __init__(self, texts: list[np.ndarray], bands: list[int]):
        """texts: hashed words of each text; bands: its rating."""
        self.bands = sorted(set(bands))
        self.edges = np.empty(0)
        self.total = np.zeros(len(self.bands))
        at = np.array([self.bands.index(b) for b in bands])
        n = np.array([len(h) for h in texts])
        np.add.at(self.total, at, n)
        own = np.repeat(at, n)
        self.counts = []  # for runs of 1, 2 and 3 words: slots x bands
        for run in map(np.concatenate, zip(*map(_runs, texts))):
            slots = max(SLOTS, 1 << (2 * len(np.unique(run)) - 1).bit_length())
            c = np.bincount((run & np.uint64(slots - 1)).astype(np.int64) * len(self.bands) + own, minlength=slots * len(self.bands))
            self.counts.append(c.astype(np.min_scalar_type(c.max())).reshape(slots, -1))

    def surprisal(self, h: np.ndarray, minus: dict[int, int] | None = None) -> np.ndarray:
        """Surprisal of each word under each band's model, words x bands; minus: how often to leave the text itself out of a band."""
        slots = [(x & np.uint64(len(c) - 1)).astype(np.int64) for x, c in zip(_runs(h), self.counts)]
        c1, c2, c3 = (c[s].astype(np.float32) for c, s in zip(self.counts, slots))
        total = self.total.copy()
        if minus:
            times = np.array([minus.get(b, 0) for b in self.bands])
            for c, s in zip((c1, c2, c3), slots):
                _, inv, n = np.unique(s, return_inverse=True, return_counts=True)
                c -= n[inv][:, None] * times
            total -= len(h) * times
        one = (c1 + 0.01) / (total + 0.01 * len(self.counts[0]))
        none = np.zeros((1, len(self.bands)), np.float32)
        two = c2 / np.maximum(np.r_[none, c1[:-1]], 1)
        three = c3 / np.maximum(np.r_[none, c2[:-1]], 1)
        p = SHARES[0] * np.minimum(three, 1) + SHARES[1] * np.minimum(two, 1) + SHARES[2] * one + SHARES[3] / SLOTS
        return -np.log(p)

    def difficulty(self, h: np.ndarray, minus: dict[int, int] | None = None) -> float:
        """Mean over windows of the band they point to, from the distribution of their surprisals."""
        s = self.surprisal(h, minus)
        at = np.arange(0, len(s), WINDOW)
        w = np.add.reduceat(s, at, axis=0)
        n = np.diff(np.r_[at, len(s)])[:, None]
        x = -(w - w.min(axis=1, keepdims=True)) / np.sqrt(n)
        p = np.exp(x)
        p /= p.sum(axis=1, keepdims=True)
        return float((p @ np.asarray(self.bands, float) * n[:, 0]).sum() / n.sum())

    def fit_bands(self, scores: np.ndarray, bands: np.ndarray) -> None:
        """Isotonic regression of band on difficulty; kept as the difficulties at which the fit passes the middle between bands."""
        x, y = isotonic(scores, bands)
        edges = []
        for b in self.bands[:-1]:
            i = int(np.searchsorted(y, b + 0.5))
            edges.append(np.inf if i == len(y) else (x[max(i - 1, 0)] + x[i]) / 2)
        self.edges = np.array(edges)

    def band(self, score: float) -> int:
        return self.bands[int(np.searchsorted(self.edges, score, side="right"))]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: x sorted, and the non-decreasing least-squares fit of y. Ties of x are one point."""
    u, inv = np.unique(np.asarray(x, float), return_inverse=True)
    w = np.bincount(inv).astype(float)
    m = np.bincount(inv, weights=np.asarray(y, float)) / w
    value, weight, size = [], [], []
    for a, b in zip(m, w):
        value.append(a)
        weight.append(b)
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            t = weight[-2] + weight[-1]
            value[-2] = (value[-2] * weight[-2] + value[-1] * weight[-1]) / t
            weight[-2] = t
            size[-2] += size[-1]
            value.pop(), weight.pop(), size.pop()
    return u, np.repeat(value, size)


def _char_slots(text: str) -> np.ndarray:
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(a) < 4:
        return np.empty(0, np.int64)
    h = a[:-3]
    for i in (1, 2, 3):
        h = h * np.uint64(1_000_003) + a[i : len(a) - 3 + i]
    return (_mix(h) >> np.uint64(17)).astype(np.int64) & (CHAR_SLOTS - 1)


class LanguageModel:
    """Log odds of English against the rest, by runs of four characters."""

    def __init__(self):
        self.counts = np.zeros((2, CHAR_SLOTS), np.float32)

    def add(self, text: str, english: bool) -> None:
        np.add.at(self.counts[int(english)], _char_slots(text), 1)

    def done(self) -> None:
        p = (self.counts + 0.5) / (self.counts.sum(axis=1, keepdims=True) + 0.5 * CHAR_SLOTS)
        self.odds = np.clip(np.log(p[1] / p[0]), -5, 5).astype(np.float32)

    def english(self, text: str) -> bool:
        s = _char_slots(text)
        return bool(len(s)) and float(self.odds[s].mean()) > 0


def _bounded(df: DataFrame, key: str, most: int) -> pd.DataFrame:
    """About ``most`` rows and never many more, the same ones on every run: those whose hash falls into the right share."""
    n = df.count()
    return (df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(n)) < most)).toPandas().sort_values(key)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", band: str = "band", sample: int = SAMPLE) -> tuple[BandModels | None, LanguageModel]:
    """Models from at most ``sample`` rated texts and LANGUAGE_SAMPLE texts of each side of the language column.

    Texts rated twice count with each rating; what a text is like is told by the models without it and its copies. Without rated texts there is no band model and no text gets a band.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lower(lang).alias("lang")).where((F.length("text") > 0) & F.col("key").isNotNull())
    tag = F.substring("lang", 1, 2)
    model = LanguageModel()
    for english, cond in ((True, tag == "en"), (False, (tag != "en") & ~F.col("lang").isin("und", ""))):
        for t in _bounded(rows.where(cond), "key", LANGUAGE_SAMPLE)["text"]:
            model.add(t, english)
    model.done()
    rated = _bounded(labels.select(F.col(key).alias("key"), F.col(band).cast("int").alias("band")).where("key is not null and band is not null").join(rows.select("key", "text"), "key"), "key", sample)
    hashes = WordHash()
    rated["h"] = [_ids(t, hashes) if model.english(t) else None for t in rated["text"]]
    rated = rated[[h is not None and len(h) >= 20 for h in rated["h"]]]
    if not len(rated):
        return None, model
    own = rated["band"].astype(int).tolist()
    bands = BandModels(list(rated["h"]), own)
    # equal texts are left out together: a copy that stays would know the text
    of: dict[str, dict[int, int]] = {}
    for t, b in zip(rated["text"], own):
        of.setdefault(t, {})[b] = of.get(t, {}).get(b, 0) + 1
    score: dict[str, float] = {}
    for t, h in zip(rated["text"], rated["h"]):
        if t not in score:
            score[t] = bands.difficulty(h, of[t])
    bands.fit_bands(np.array([score[t] for t in rated["text"]]), rated["band"].to_numpy())
    return bands, model


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", band: str = "band", least_words: int = LEAST_WORDS) -> DataFrame:
    """key, band int, difficulty double of every English text with at least ``least_words`` words between white space.

    Null, empty, short and foreign texts have no row; equal texts get equal bands.
    """
    bands, model = fit(docs, labels, key, text, lang, band)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") >= 2 * least_words - 1)
    if bands is None:
        return rows.select(F.col("key").alias(key), F.lit(0).alias("band"), F.lit(0.0).alias("difficulty")).limit(0)
    shared = docs.sparkSession.sparkContext.broadcast((bands, model))  # tables of the bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bm, lm = shared.value
        hashes = WordHash()
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"]):
                if len(t.split()) >= least_words and lm.english(t):
                    h = _ids(t, hashes)
                    if len(h):
                        z = bm.difficulty(h)
                        out.append((k, bm.band(z), z))
            yield pd.DataFrame(out, columns=["key", "band", "difficulty"])

    return rows.mapInPandas(run, f"key {kind}, band int, difficulty double").withColumnRenamed("key", key)
