"""Mixing sources to target weights: Pfair subtasks, interleaved earliest deadline first.

A source's documents are dealt, in an order given by a hash of the row, into blocks of `block_docs`. With exact weight w (a
ratio of whole numbers, never rounded), block i of a source is released at floor(i/w) and due at ceil((i+1)/w), and slots go to
released blocks, earliest deadline first. Every prefix of slots then holds each source to within less than one block of its weight,
however many slots there are.

Periods of slots are laid out by tasks that need nothing from each other. At a boundary T a source has had floor(wT) or
ceil(wT) blocks; which sources have had the larger number is what `had_at` works out, from T alone: of the blocks begun but
not yet due, those due first, as far as the slots before T can still take them after their releases. Among all choices that the slots
before T can take this one leaves the fewest blocks due by any later time, so both sides of the boundary can meet all deadlines.

When a source has run out, its slots stay empty: no document is dropped or repeated.

Behaviour: a null source is a source of its own; repeated rows each take a place; ties of the hash go by id and then
by text hash; an empty table gives an empty result; extra columns are kept whatever their names, but for columns named like the
results, which are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import isqrt, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_DOCS = 32
#: Slots that a task lays out at a time, at least.
PERIOD = 4096
#: Documents of a source that share one bucket, on average, and buckets that are summed together.
BUCKET_DOCS, BUCKET_GROUP = 500, 4096


def whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    common = lcm(*(w.denominator for w in exact.values()))
    return {k: int(w * common) for k, w in exact.items()}


def _due_within(shares: dict[str, int], rest: dict[str, int], total: int, steps: int) -> np.ndarray:
    """For s = 0 to `steps`: the blocks that are both released and due in the last s slots before a boundary."""
    small = (max(shares.values()) + 1) * (steps + 1) < 1 << 62
    s = np.arange(steps + 1, dtype=np.int64 if small else object)
    out = np.zeros(steps + 1, s.dtype)
    for k, a in shares.items():
        out += np.maximum((a * s - rest[k]) // total, 0)
    return out


def had_at(shares: dict[str, int], slot: int) -> dict[str, int]:
    """Blocks of each source in the slots before `slot`."""
    total = sum(shares.values())
    had, rest = {}, {}
    for k, a in shares.items():
        had[k], rest[k] = divmod(a * slot, total)
    more = slot - sum(had.values())
    if not more:
        return had
    begun = sorted((-(-(had[k] + 1) * total // shares[k]), k) for k in shares if rest[k])
    released = {k: had[k] * total // shares[k] for _, k in begun}
    times = sorted(set(released.values()))
    free = np.arange(slot - times[0] + 1) - _due_within(shares, rest, total, slot - times[0])
    # Slots left from each release on: the least over all times back to the release before it.
    room, after = [], times[0] - 1
    for t in times:
        room.append(int(min(free[slot - t : slot - after])))
        after = t
    left = np.array(room, np.int64)
    for _, k in begun:
        j = times.index(released[k]) + 1
        if left[:j].min() > 0:
            left[:j] -= 1
            had[k] += 1
            more -= 1
            if not more:
                return had
    raise ValueError("no fair choice at this boundary")


def lay_out(shares: dict[str, int], first: int, end: int, blocks: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """(source, block, slot) for the slots from `first` to before `end`; `blocks` says how many blocks each source has."""
    total = sum(shares.values())
    begin, stop = had_at(shares, first), had_at(shares, end)
    if blocks is not None:
        stop = {k: min(v, blocks[k]) for k, v in stop.items()}

    def block(k: str, i: int) -> tuple[int, int, str, int]:
        return max(first, i * total // shares[k]), min(end, -(-(i + 1) * total // shares[k])), k, i

    waiting = [block(k, begin[k]) for k in shares if begin[k] < stop[k]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out, slot = [], first
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, due, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, k, i))
        due, k, i = heapq.heappop(ready)
        if slot >= due:
            raise ValueError("a deadline was missed")
        out.append((k, i, slot))
        slot += 1
        if i + 1 < stop[k]:
            heapq.heappush(waiting, block(k, i + 1))
    return out


def source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def tempered_weights(sizes: dict[str, int]) -> dict[str, int]:
    """Default target: the square root of each source's number of documents, in thousandths."""
    return {k: isqrt(n * 1_000_000) for k, n in sizes.items()}


def slots_of(spark: SparkSession, shares: dict[str, int], blocks: dict[str, int], period: int) -> DataFrame:
    """_k, mix_block and mix_slot of all blocks; each task lays out periods of its own."""
    total = sum(shares.values())
    slots = max(-(-blocks[k] * total // a) for k, a in shares.items())
    # The work at a boundary is in proportion to the longest time between two blocks of a source.
    period = max(period, 2 * total // min(shares.values()))
    periods = -(-slots // period)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                got = lay_out(shares, p * period, (p + 1) * period, blocks)
                for i in range(0, len(got), 100_000):
                    k, block, slot = zip(*got[i : i + 100_000], strict=True)
                    yield pa.RecordBatch.from_pydict({"_k": pa.array(k, pa.string()), "mix_block": pa.array(block, pa.int64()), "mix_slot": pa.array(slot, pa.int64())})

    tasks = max(1, min(periods, 100_000))
    return spark.range(0, periods, 1, tasks).mapInArrow(lay, "_k string, mix_block long, mix_slot long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """`docs` with mix_block, mix_slot and mix_position (long); ascending mix_position is the mixed order.

    `weights` names the target of each source (None as key: null source); sources that it leaves out share the
    smallest weight given.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    # One row for each source comes to the driver, as the weights do.
    sizes = {r["k"]: r["count"] for r in docs.groupBy(source_key().alias("k")).count().collect()}
    if not sizes:
        return docs.withColumns({k: F.lit(None).cast("long") for k in ("mix_block", "mix_slot", "mix_position")})
    natural = tempered_weights(sizes)
    if weights is not None:
        given = {("n" if k is None else "s" + k): w for k, w in weights.items()}
        natural = {k: given.get(k, min(given.values())) for k in natural}
    slots = slots_of(spark, whole_shares(natural), {k: -(-n // block_docs) for k, n in sizes.items()}, period)

    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    buckets = max(1, sum(sizes.values()) // BUCKET_DOCS)
    # The row travels as one value, so that none of its columns meets the working columns.
    keyed = docs.select(F.struct("*").alias("row"), source_key().alias("_k"), F.xxhash64(*hashed, F.lit("mix")).alias("_h"), F.col("doc_id").alias("_id"), text.alias("_t"))
    keyed = keyed.withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(buckets))).withColumn("_g", F.floor(F.col("_b") / BUCKET_GROUP))
    counted = keyed.groupBy("_k", "_g", "_b").agg(F.count("*").alias("_n"))
    # Prefix sums in two steps, so that no task sees all buckets of a hot source.
    inner = counted.withColumn("_in", F.sum("_n").over(Window.partitionBy("_k", "_g").orderBy("_b")) - F.col("_n"))
    groups = counted.groupBy("_k", "_g").agg(F.sum("_n").alias("_n")).withColumn("_out", F.sum("_n").over(Window.partitionBy("_k").orderBy("_g")) - F.col("_n")).drop("_n")
    before = inner.join(groups, ["_k", "_g"]).select("_k", "_b", (F.col("_in") + F.col("_out")).alias("_base"))
    # Within a source and bucket only: some thousand rows, however large the source is.
    nth = F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_h", "_id", "_t")) - 1
    placed = keyed.withColumn("_nth", nth).join(before, ["_k", "_b"]).withColumn("_at", F.col("_base") + F.col("_nth"))
    out = placed.withColumn("mix_block", F.floor(F.col("_at") / block_docs).cast("long")).join(slots, ["_k", "mix_block"])
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], "mix_block", "mix_slot", (F.col("mix_slot") * block_docs + F.col("_at") % block_docs).alias("mix_position"))
