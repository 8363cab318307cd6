"""Problem 8: ids of a public tokenizer for a whole corpus, and back.

Method: the tokenizers library over Arrow batches. Offsets of ids are kept in characters of the text; the
byte-level vocabulary writes each byte as one character, so decoding reverses that table byte by byte and
joins the bytes before reading them as UTF-8, which heals characters split over several ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
BATCH_CHARS = 1_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """A vocabulary file of the public tokenizers; the folder is a parameter and never part of this repository."""
    return os.path.join(folder or os.environ.get("QUARRYMILL_TOKENIZERS", "/opt/tokenizers"), name)


def byte_characters() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file; its special tokens are plain text inside a text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about BATCH_CHARS together, so one call never holds the encodings of a large batch."""
    run: list[str] = []
    n = 0
    for t in texts:
        if run and n + len(t) > BATCH_CHARS:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def encode_column(df: DataFrame, keys: list[str], text: str, path: str | None = None, offsets: bool = False) -> DataFrame:
    """The key columns, ids array<int> and, if asked for, starts array<int>: the first character of each id.

    Empty and null texts give an empty list. Every row gives one row; other columns play no part.
    """
    file = path or tokenizer_path()
    src = df.select(*keys, F.col(text).alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", ids array<int>" + (", starts array<int>" if offsets else "")
    ints = pa.list_(pa.int32())
    names = list(src.columns[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(file)
        for b in batches:
            texts = [x or "" for x in b.column(b.num_columns - 1).to_pylist()]
            ids: list[np.ndarray] = []
            starts: list[np.ndarray] = []
            for part in _runs(texts):
                for e in tok.encode_batch_fast(part, add_special_tokens=False) if not offsets else tok.encode_batch(part, add_special_tokens=False):
                    ids.append(np.asarray(e.ids, np.int32))
                    if offsets:
                        starts.append(np.asarray([o[0] for o in e.offsets], np.int32))
            cols = [b.column(i) for i in range(b.num_columns - 1)] + [_lists(ids, ints)] + ([_lists(starts, ints)] if offsets else [])
            yield pa.RecordBatch.from_arrays(cols, [*names, "ids", *(["starts"] if offsets else [])])

    return src.mapInArrow(run, out)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32())).cast(kind)


@lru_cache(maxsize=4)
def _bytes_by_id(path: str) -> list[bytes]:
    vocab = json.load(open(path, encoding="utf-8"))
    table = byte_characters()
    out = [b""] * (1 + max([*vocab["model"]["vocab"].values(), *(a["id"] for a in vocab.get("added_tokens", []))]))
    for piece, i in vocab["model"]["vocab"].items():
        out[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
    return out


def decode_ids(ids: list[int], path: str | None = None) -> str:
    """Text of the ids; characters split over ids are whole again, bytes that are no UTF-8 become U+FFFD."""
    table = _bytes_by_id(path or tokenizer_path())
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def decode_column(df: DataFrame, keys: list[str], ids: str, path: str | None = None) -> DataFrame:
    """The key columns and text: the inverse of encode_column; a null list gives null, an empty one an empty text."""
    file = path or tokenizer_path()
    src = df.select(*keys, F.col(ids).alias("_ids"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", text string"
    names = list(src.columns[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode_ids(x, file) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string())], [*names, "text"])

    return src.mapInArrow(run, out)
