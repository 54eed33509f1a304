"""Near-duplicates by MinHash bands, with odd sketches between candidates and confirmation on the full sets.

1. Signatures. A document's set of shingles gives as many MinHash samples as bands of rows ask for (`banding`), a key for each band, and an
   odd sketch: each sample toggles one bit of a bitmap. Equal sets, by a 128-bit digest, are one set from here on.
2. Bands. In each bucket of a band all sets are compared with its pivot, the set of the least number.
3. Odd sketches. Two sketches differ in the bits that an odd number of different samples toggled. From that count a pair goes on or is
   dropped; the limit (`odd_limit`) is worked out exactly, so that a pair at the threshold is dropped with a probability under MISS.
   A second bitmap is toggled by the whole set. It never differs in more bits than the sets in members, so what it drops
   cannot link; on sets of up to some thousand shingles it is the sharper one.
4. What is left is confirmed on the full sets, which are made again from the texts of just these documents, and links make components.
5. Buckets that still lie in several components are compared by sketch across components, block by block. First each set meets the
   nearest set of the bucket's largest component and of the others, which joins most of what belongs together; then all
   pairs that are still apart and that the sketches let through are confirmed.

A pair at the threshold shares no band with a probability under BAND_MISS, and a pair above it with a lower one.

Behaviour: null and empty texts, and texts of white space, have the empty set and link with nothing; fewer words than the width make one
shingle; repeated rows are equal sets; rows of one id are one document, with the links of each; each row without an id is a document of
its own, whose component is the least id that its text links with, or null; a very long text is one set, held whole by its task; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches
from .components import components
from .ngram_join import shingles, verified

#: Chances that a pair at the threshold shares no band, and that the sketches drop it.
BAND_MISS, MISS = 1e-7, 1e-9
#: Bands at most, and bits of a sketch.
MOST_BANDS, BITS = 40, 1024
#: Sets of a bucket that one task takes; longer buckets are dealt out as pairs of pieces.
BUCKET_PIECE = 20_000
#: Digests that a task holds to tell equal sets early.
SEEN = 500_000
_U = np.uint64
SIGNED = "doc_id {id}, rid long, h long, n long, digest binary, bands binary, sketch binary"


def banding(percent: int, miss: float = BAND_MISS, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows with which `most` bands or fewer lose a pair at the threshold with a chance under `miss`."""
    best = (1, 1)
    for rows in range(1, 33):
        share = (percent / 100) ** rows
        bands = 1 if share >= 1 else math.ceil(math.log(miss) / math.log1p(-share))
        if bands > most:
            break
        best = (bands, rows)
    return best


def odd_limit(samples: int, percent: int, bits: int = BITS, miss: float = MISS) -> int:
    """The least count of differing bits that a pair at the threshold exceeds with a chance under `miss`.

    Each differing sample throws two balls into `bits` bins, and the count is that of bins with an odd number. The chance of a sample to
    differ is one less the threshold; both distributions are summed exactly.
    """
    p = 1 - percent / 100
    odd, total = np.zeros(bits + 1), np.zeros(bits + 1)
    odd[0] = 1.0
    z = np.arange(bits + 1)
    for d in range(samples + 1):
        weight = math.exp(math.lgamma(samples + 1) - math.lgamma(d + 1) - math.lgamma(samples - d + 1) + (d * math.log(p) if p else (0 if not d else -math.inf)) + (samples - d) * math.log1p(-p)) if p < 1 else float(d == samples)
        total += weight * odd
        for _ in range(2):
            up, down = odd * (bits - z) / bits, odd * z / bits
            odd = np.r_[0, up[:-1]] + np.r_[down[1:], 0]
    beyond = 1 - np.cumsum(total)
    return int(np.flatnonzero(beyond <= max(miss, 1e-13))[0])


def multipliers(samples: int) -> np.ndarray:
    """Odd 64-bit numbers from a fixed sequence of mixed counters."""
    x = (np.arange(1, samples + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) ^ _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return (x ^ (x >> _U(31))) | _U(1)


def samples_of(grams: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set: for each multiplier the least product."""
    out = np.full(len(by), np.iinfo(np.uint64).max, _U)
    for i in range(0, len(grams), 1024):
        np.minimum(out, (grams[i : i + 1024, None] * by).min(axis=0), out=out)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> _U(29))) * _U(0x165667B19E3779F9)
    return x ^ (x >> _U(32))


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band's samples; bands differ in their keys."""
    h = np.arange(1, bands + 1, dtype=_U) * _U(0xFF51AFD7ED558CCD)
    for column in samples.reshape(bands, rows).T:
        h = _mixed(h ^ column) + column
    return _mixed(h)


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A bitmap in which each sample, with its number, toggles one bit."""
    return parity(samples + np.arange(1, len(samples) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), bits)


def parity(members: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A bitmap in which each member toggles one bit."""
    return np.packbits(np.bincount((_mixed(members) % _U(bits)).astype(np.int64), minlength=bits) & 1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the sketches (64-bit words in the last axis) of each pair differ."""
    count = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], np.int64)
    for w in range(a.shape[-1]):
        count += np.bitwise_count(a[..., w] ^ b[..., w])
    return count


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.astype("<u8").tobytes(), digest_size=16).digest()


def _signed(width: int, bands: int, rows: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("rid", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid, by, seen = TaskContext.get().partitionId() << 33, multipliers(bands * rows), set()
        for b in batches:
            out: list[tuple] = []
            for doc, text, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                grams = shingles(text, width)
                rid += 1
                if not len(grams):
                    out.append((doc, rid, h, 0, None, None, None))
                    continue
                digest = _digest(grams)
                if digest in seen:
                    out.append((doc, rid, h, len(grams), digest, None, None))
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                found = samples_of(grams, by)
                out.append((doc, rid, h, len(grams), digest, band_keys(found, bands, rows).astype("<i8").tobytes(), odd_sketch(found).tobytes() + parity(grams).tobytes()))
            if out:
                yield _table(out, schema)

    return run


def sets_of(docs: DataFrame, pairs: DataFrame, signs: DataFrame, width: int) -> DataFrame:
    """sid and keys, the full sets of both sides of `pairs`, from the texts that the pairs name.

    Texts are found by a hash of id and text, and told from others of the same hash by the digest of their set.
    """
    needed = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(signs.select("sid", "h", "digest"), "sid")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sids, keys, size = [], [], 0
            for sid, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sid in seen:
                    continue
                grams = shingles(text, width)
                if _digest(grams) == digest:
                    seen.add(sid)
                    sids.append(sid)
                    keys.append(grams.astype("<u8").tobytes())
                    size += len(keys[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pydict({"sid": pa.array(sids, pa.int64()), "keys": pa.array(keys, pa.binary())})
                    sids, keys, size = [], [], 0
            if sids:
                yield pa.RecordBatch.from_pydict({"sid": pa.array(sids, pa.int64()), "keys": pa.array(keys, pa.binary())})

    found = docs.join(needed, "h").select("sid", "digest", "text").mapInArrow(made, "sid long, keys binary")
    return kept(found.dropDuplicates(["sid"]), "sets")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, key) of each band."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            keys = [np.frombuffer(x, "<i8") for x in part.column(1).to_pylist()]
            if keys:
                yield pa.RecordBatch.from_pydict({"sid": pa.array(np.repeat(part.column(0).to_numpy(), [len(k) for k in keys]), pa.int64()), "key": pa.array(np.concatenate(keys), pa.int64())})


def _words(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), "<u8").reshape(len(sketches), -1)


def alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of bitmaps (that of samples, then that of the set) and sizes: may they link, and in how many bits their sets differ."""
    half = a.shape[-1] // 2
    apart = differing(a[..., half:], b[..., half:])
    near = apart * (100 + percent) <= (na + nb) * (100 - percent)
    return near & (differing(a[..., :half], b[..., :half]) <= limit), apart


def sketched(pairs: DataFrame, signs: DataFrame, percent: int, limit: int) -> DataFrame:
    """The pairs (a, b) that their sketches let through."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                na, nb = (x.column(i).to_numpy() for i in (4, 5))
                near, _ = alike(_words(x.column(2)), _words(x.column(3)), na, nb, percent, limit)
                yield pa.RecordBatch.from_arrays([x.column(i).filter(pa.array(near)) for i in (0, 1)], names=["a", "b"])

    one = signs.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = signs.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(check, "a long, b long")


#: Buckets up to so many sets are compared by their distance in the sorted rows, all at once; longer ones block by block.
SHORT = 16


def _across(percent: int, limit: int, nearest: bool):
    """Pairs of a bucket's piece pair whose sets lie in different components and whose sizes and sketches let them link. With
    `nearest`, of long buckets only the nearest set of the largest component and of the others for each set outside it.

    Rows come sorted by bucket and piece pair: key, one, two, sid, component, n, piece, sketch.
    """

    def pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, one, two, sid, comp, n, piece = (rows.column(i).to_numpy() for i in range(7))
        words = _words(rows.column(7).combine_chunks())
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        sizes = np.diff(np.r_[first, len(key)])
        group = np.repeat(np.arange(len(first)), sizes)

        def linked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near, _ = alike(words[x], words[y], n[x], n[y], percent, limit)
            return sid[x[near]], sid[y[near]]

        def open_to(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Different components, sizes that can link, and of two pieces one row each."""
            return (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((one[x] == two[x]) | (piece[x] != piece[y]))

        short = sizes[group] <= SHORT
        for d in range(1, min(SHORT, int(sizes.max()))):
            x = np.flatnonzero(short[:-d] & (group[d:] == group[:-d]))
            x = x[open_to(x, x + d)]
            if len(x):
                yield linked(x, x + d)
        for g in np.flatnonzero(sizes > SHORT):
            mine = np.arange(first[g], first[g] + sizes[g])
            names, counts = np.unique(comp[mine], return_counts=True)
            common = comp[mine] == names[counts.argmax()]
            rare = mine[~common]
            for i in range(0, len(rare), 32):
                at = rare[i : i + 32, None]
                if nearest:
                    may, apart = alike(words[at], words[mine][None, :], n[at], n[mine][None, :], percent, limit)
                    apart = np.where(may & open_to(at, mine[None, :]), apart, BITS + 1)
                    for side in (common, ~common):
                        if side.any():
                            best = apart[:, side].argmin(axis=1)
                            x = np.flatnonzero(apart[:, side][np.arange(len(best)), best] <= BITS)
                            yield sid[at[x, 0]], sid[mine[side][best[x]]]
                    continue
                x, y = np.nonzero(open_to(at, mine[None, :]) & (common | (sid[mine] > sid[at])))
                if len(x):
                    yield linked(at[x, 0], mine[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b in pairs(pa.Table.from_batches(parts)):
                for j in range(0, len(a), 100_000):
                    one, other = a[j : j + 100_000], b[j : j + 100_000]
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(one, other), pa.int64()), "b": pa.array(np.maximum(one, other), pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            ends = np.stack([b.column(i).to_numpy() for i in range(3)])
            # Rows before the last bucket of a batch belong to buckets that are complete.
            change = np.flatnonzero((ends[:, 1:] != ends[:, :-1]).any(axis=0))
            whole = int(change[-1]) + 1 if len(change) else 0
            if last is not None and tuple(ends[:, 0]) != last:
                yield from flush(held)
                held = []
            if whole:
                yield from flush([*held, b.slice(0, whole)])
                held = []
            held.append(b.slice(whole))
            last = tuple(ends[:, -1])
        if held:
            yield from flush(held)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text); ids are whole numbers or binary.

    Two documents link when 100 * common shingles >= percent * shingles of both.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = banding(percent)
    limit = odd_limit(bands * rows, percent)
    id_type = "binary" if docs.schema["doc_id"].dataType.typeName() == "binary" else "long"
    id_kind = pa.binary() if id_type == "binary" else pa.int64()
    texts = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("h"))
    signed = kept(texts.mapInArrow(_signed(width, bands, rows, id_kind), SIGNED.format(id=id_type)), "signatures")
    texts = texts.select("h", "text").where("text is not null")

    # Equal sets are one; of each the first row that carries its signature stands for it.
    several = signed.where("digest is not null").groupBy("digest").agg(F.min(F.when(F.col("bands").isNotNull(), F.col("rid"))).alias("sid"), F.count("*").alias("c")).where("c > 1").select("digest", "sid")
    several = kept(several, "sets")
    members = kept(signed.select("doc_id", "rid", "n", "digest").join(several, "digest", "left").select("doc_id", F.coalesce("sid", "rid").alias("sid"), "rid", "n"), "members")
    first_rows = members.where("sid = rid and n > 0").select("sid")
    signs = kept(signed.where("bands is not null").select(F.col("rid").alias("sid"), "h", "n", "digest", "bands", "sketch").join(first_rows, "sid", "left_semi"), "signs")
    same = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a != z").select("doc_id", "a")
    same_id = members.join(kept(same, "ids"), "doc_id").where("sid != a").select("a", F.col("sid").alias("b")).distinct()

    entries = signs.select("sid", "bands").mapInArrow(_exploded, "sid long, key long")
    shared = entries.groupBy("key").agg(F.min("sid").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("key", "pivot")
    entries = kept(entries.join(shared, "key"), "bands")
    first = kept(entries.where("sid != pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct(), "pairs")
    near = kept(sketched(first, signs, percent, limit), "near")
    links = kept(verified(near, sets_of(texts, near, signs, width), percent).union(same_id), "links")
    found = components(links)

    tested = first
    for nearest in (True, False):
        named = entries.join(found, F.col("sid") == F.col("node"), "left").select("sid", "key", F.coalesce("component", "sid").alias("component"))
        mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x != y").select("key", (F.floor(F.col("c") / BUCKET_PIECE) + 1).alias("pieces"))
        dealt = (
            named.join(mixed, "key")
            .withColumn("piece", F.pmod(F.xxhash64("sid"), F.col("pieces")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
            .withColumns({"one": F.least("piece", "other"), "two": F.greatest("piece", "other")})
            .join(signs.select("sid", "n", "sketch"), "sid")
        )
        dealt = dealt.select("key", "one", "two", "sid", "component", "n", "piece", "sketch").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "sid")
        rest = dealt.mapInArrow(_across(percent, limit, nearest), "a long, b long").distinct()
        rest = kept(rest.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(rest)
        links = links.union(kept(verified(rest, sets_of(texts, rest, signs, width), percent), "links"))
        found = components(links)

    placed = members.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "n", F.coalesce("component", "sid").alias("component"))
    # Written, so that the sums do not lie in the tasks of the join: Spark deals out the rows of a large component anew.
    least = kept(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return placed.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
