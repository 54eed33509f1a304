"""Counting hashed keys across partitions, in compact blocks.

Documents belong to runs (a hash of the id). A task sends the distinct hashed keys of its documents in one block for
each key range ("bucket"): sorted, as differences, compressed; some 4 to 6 bytes a key. A bucket's task sums the counts and
tells each run which of its keys are held more often than once, and how often. A key that a third of all documents
hold comes once from each task and run, so no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a bucket, and text bytes of a run, on average.
BUCKET_KEYS = 1 << 20
RUN_BYTES = 8 << 20
#: Text bytes up to which runs and buckets keep these sizes. Beyond, both grow as the root of the input, so that the blocks
#: between them, whose number is that of tasks times buckets, hold more than a few keys each.
EVEN_BYTES = 1 << 40
#: Bits of a key that are exchanged.
KEY_BITS = 48

BLOCK = "bucket long, run long, n long, keys binary, runs binary, counts binary"
COUNTED = "run long, n long, keys binary, counts binary"


def spread(size: int, each: int) -> int:
    """Into how many runs or buckets of `each` bytes a corpus of `size` bytes goes."""
    return max(1, int(size / (each * max(1.0, size / EVEN_BYTES) ** 0.5)))


def pack(a: np.ndarray) -> bytes:
    """Bytes of an integer array, planes of equal significance together, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.copy()
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(b, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).reshape(n)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a.astype("<u8"), prepend=np.uint64(0)))


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, n, "<u8"), dtype="<u8")


def run_of(runs: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*(columns or ("doc_id",)), F.lit("run")), F.lit(runs)).cast("long")


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-spread 48-bit key of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(64 - KEY_BITS)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascends with the key."""
    return ((keys >> np.uint64(20)) * np.uint64(buckets)) >> np.uint64(KEY_BITS - 20)


def key_blocks(keys: np.ndarray, runs: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (key, run) pairs, each distinct pair once with its count."""
    if not len(keys):
        return
    order = np.lexsort((runs, keys))
    keys, runs = keys[order], runs[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])])
    counts = np.diff(np.r_[first, len(keys)]).astype("<u4")
    keys, runs = keys[first], runs[first].astype("<u4")
    at = bucket_of(keys, buckets)
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
    rows = [(int(at[i]), j - i, pack_sorted(keys[i:j]), pack(runs[i:j]), pack(counts[i:j])) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    for i in range(0, len(rows), 200):
        part = rows[i : i + 200]
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array([r[0] for r in part], pa.int64()),
                "run": pa.array([0] * len(part), pa.int64()),
                "n": pa.array([r[1] for r in part], pa.int64()),
                "keys": pa.array([r[2] for r in part], pa.binary()),
                "runs": pa.array([r[3] for r in part], pa.binary()),
                "counts": pa.array([r[4] for r in part], pa.binary()),
            }
        )


def tally(blocks: DataFrame, least: int = 2) -> DataFrame:
    """For each run, its keys whose total count is `least` or more, with the total, from BLOCK rows."""

    def count(rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in got])
        runs = np.concatenate([unpack(r["runs"], r["n"], "<u4") for r in got])
        counts = np.concatenate([unpack(r["counts"], r["n"], "<u4") for r in got])
        del got
        order = np.argsort(keys, kind="stable")
        keys, runs, counts = keys[order], runs[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.repeat(np.add.reduceat(counts, first), np.diff(np.r_[first, len(keys)]))
        held = total >= least
        keys, runs, total = keys[held], runs[held], np.minimum(total[held], 0xFFFFFFFF).astype("<u4")
        order = np.lexsort((keys, runs))
        keys, runs, total = keys[order], runs[order], total[order]
        if len(keys):
            once = np.r_[True, (keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])]
            keys, runs, total = keys[once], runs[once], total[once]
        edges = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1], True]) if len(runs) else np.zeros(1, int)
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.table(
            {
                "run": pa.array([int(runs[i]) for i, _ in spans], pa.int64()),
                "n": pa.array([j - i for i, j in spans], pa.int64()),
                "keys": pa.array([pack_sorted(keys[i:j]) for i, j in spans], pa.binary()),
                "counts": pa.array([pack(total[i:j]) for i, j in spans], pa.binary()),
            }
        )

    return blocks.groupBy("bucket").applyInArrow(count, COUNTED)


def counted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and totals of a run's COUNTED rows."""
    got = rows.to_pylist()
    if not got:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4")
    keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in got])
    total = np.concatenate([unpack(r["counts"], r["n"], "<u4") for r in got])
    order = np.argsort(keys, kind="stable")
    return keys[order], total[order]


def look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, missing: int = 0) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), missing, values.dtype)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], np.array(missing, values.dtype))
