"""Problem 7: cut oversized texts into pieces at natural boundaries, with overlap.

Method: a recursive hierarchy of separators. A text over the limit is split by section (blank lines), a
part still too long by line, then sentence, clause, word and at last by character; neighbouring parts are
packed greedily up to the limit, and each following piece starts with as many whole trailing parts of the
one before as fit into the overlap.

Pieces are slices of the text: each is (start, end), starts and ends only grow, no character is lost, and
a piece never exceeds the limit. Lengths are Unicode code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
#: From coarse to fine. Each match ends a part; what it matches stays with the part before it.
LEVELS = tuple(
    re.compile(p)
    for p in (
        r"\n[^\S\n]*\n\s*",
        r"\n\s*",
        r"[.!?…][\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*",
        r"[;:,][\s]+|[；：，、]",
        r"\s+",
    )
)


def atoms(text: str, limit: int, step: int, start: int = 0, end: int | None = None, level: int = 0) -> list[tuple[int, int]]:
    """Parts of text[start:end], none longer than ``limit``, cut at the coarsest separators that do; where there are none, every ``step`` characters."""
    end = len(text) if end is None else end
    if end - start <= limit:
        return [(start, end)] if end > start else []
    if level == len(LEVELS):
        return [(i, min(i + step, end)) for i in range(start, end, step)]
    out: list[tuple[int, int]] = []
    at = start
    for m in LEVELS[level].finditer(text, start, end):
        if m.end() > at:
            out += atoms(text, limit, step, at, m.end(), level + 1)
            at = m.end()
    return out + atoms(text, limit, step, at, end, level + 1)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces; one piece for a text within the limit, none for an empty text.

    Consecutive pieces share the longest run of whole sentences or words of at most ``overlap`` characters at
    the end of the first for which there is room before the part that follows: a paragraph that fits a piece is
    never cut for the sake of an overlap. Where there is no boundary, text and overlap are cut by character.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    parts = atoms(text, limit, limit - overlap)
    out: list[tuple[int, int]] = []
    start, end = parts[0]
    for s, e in parts[1:]:
        if e - start <= limit:
            end = e
            continue
        out.append((start, end))
        start, end = _back(text, start, end, min(overlap, limit - (e - s))), e
    out.append((start, end))
    return out


def _back(text: str, start: int, end: int, overlap: int) -> int:
    """Where a piece that follows text[start:end] starts: at most ``overlap`` characters before ``end``, after a boundary if there is one."""
    low = max(start + 1, end - overlap)
    for level in (2, 4):
        for m in LEVELS[level].finditer(text, max(start, low - 4), end):
            if low <= m.end() < end:
                return m.end()
    return low if low < end else end


def split_texts(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: the key columns, piece_no from 0, n_pieces, start, piece.

    Null and empty texts give no row; a text within the limit gives one piece, itself, without leaving the
    JVM. Equal rows give equal pieces each. Columns named like the result's must be renamed before.
    """
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.length("_text") > 0)
    short = rows.where(F.length("_text") <= limit).select(*keys, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.col("_text").alias("piece"))

    @F.pandas_udf("array<struct<start:int,piece:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[{"start": s, "piece": t[s:e]} for s, e in pieces(t, limit, overlap)] for t in b])

    long = (
        rows.where(F.length("_text") > limit)
        .withColumn("_cut", cut("_text"))
        .select(*keys, F.size("_cut").alias("n_pieces"), F.posexplode("_cut").alias("piece_no", "_p"))
        .select(*keys, "piece_no", "n_pieces", F.col("_p.start").alias("start"), F.col("_p.piece").alias("piece"))
    )
    return short.unionByName(long)


def oversized(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Keys of the texts that were cut, from the pieces themselves: one row per text, copies included."""
    return split_texts(df.where(F.length(text) > limit), keys, text, limit, overlap).where("piece_no = 1").select(*keys)
