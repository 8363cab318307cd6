"""Tables of counts with a fixed number of slots: filled by tasks, added up in the cluster, sent back to tasks."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, none longer than needed, compressed."""
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if values.max(initial=0) <= np.iinfo(t).max)
    return kind[1:].encode() + zlib.compress(values.astype(kind).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[2:]), "<" + raw[:2].decode()).astype(np.int64)


def batch_of(kinds: dict[str, np.ndarray], parts: int = 64) -> pa.RecordBatch:
    """The filled places of tables of counts, by parts: their gaps and their values."""
    rows = []
    for name, v in kinds.items():
        for p, x in enumerate(np.split(v, parts)):
            at = np.flatnonzero(x)
            if len(at):
                rows.append((name, p, _packed(np.diff(at, prepend=0)), _packed(x[at])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["kind", "part", "at", "n"])


class Shared:
    """Tables of counts for every task: broadcast packed, as a filled table would go to the disk of each executor whole."""

    def __init__(self, spark: SparkSession, tables: dict[str, np.ndarray]):
        packed = {}
        for name, v in tables.items():
            at = np.flatnonzero(v)
            packed[name] = (v.shape, _packed(np.diff(at, prepend=0)), _packed(v.ravel()[at]))
        self.packed = spark.sparkContext.broadcast(packed)

    @property
    def value(self) -> dict[str, np.ndarray]:
        out = {}
        for name, (shape, at, n) in self.packed.value.items():
            out[name] = np.zeros(shape, np.int64)
            out[name].reshape(-1)[np.cumsum(_unpacked(at))] = _unpacked(n)
        return out


def summed(tables: DataFrame, sizes: dict[str, int], parts: int = 64) -> dict[str, np.ndarray]:
    """Add up (kind, part, at, n) of all tasks in the cluster; only the fixed-size sums reach the driver."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(sizes[key[0].as_py()] // parts, np.int64)
        for at, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist()):
            total[np.cumsum(_unpacked(at))] += _unpacked(n)
        at = np.flatnonzero(total)
        return pa.table({"kind": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int32()), "at": pa.array([_packed(np.diff(at, prepend=0))], pa.binary()), "n": pa.array([_packed(total[at])], pa.binary())})

    out = {k: np.zeros(v, np.int64) for k, v in sizes.items()}
    for r in tables.groupBy("kind", "part").applyInArrow(add, "kind string, part int, at binary, n binary").collect():
        out[r["kind"]][r["part"] * (sizes[r["kind"]] // parts) + np.cumsum(_unpacked(r["at"]))] = _unpacked(r["n"])
    return out
