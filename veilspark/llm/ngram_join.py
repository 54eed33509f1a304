"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and the components of those links.

Skipping by set relations, on an inverted index of prefixes:

1. Counts. The sets that hold an n-gram are counted across the data (`exchange.tally`). N-grams of one set join nothing.
2. Prefixes. A set orders its n-grams rarest first; two sets that link share one of their first n - ceil(t*n) + 1. Only
   n-grams of that prefix that several sets hold are indexed, with set size and position. Equal sets of a run are one.
3. Answers of a similar set. In each index list the set with the least share of n-grams of its own is the pivot; sets
   are compared with the pivots of their lists alone. A set that links to its pivot takes over the pivot's component,
   and so needs no comparison with any other set of it.
4. Block skipping. Lists that lie in one component are skipped whole. In the others, each set skips the blocks of
   its own component and all positions whose size or place in the prefix rules a link out; what is left is compared,
   so no link between components is lost.

N-grams are 64-bit hashes; 48 bits of them are counted and make the index lists, all 64 decide on links and sizes. Sets are
numbered within their run, so no two of them share a number.

Behaviour: null and empty texts, and texts of white space, have the empty set and link with nothing; fewer words than n make
one n-gram; repeated rows are equal sets; rows with one id are one document, with the links of each; each row without an id
is a document of its own, whose component is the least id that its text links with, or null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, shared_path, small_batches, text_bytes
from .components import components
from .exchange import BLOCK, BUCKET_KEYS, KEY_BITS, RUN_BYTES, counted, key_blocks, look_up, run_of, spread, tally
from .suffix_dedup import _BYTES, _powers

#: Entries of an index list that one task takes; longer lists are dealt out as pairs of pieces.
LIST_PIECE = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased, in order."""
    data = np.frombuffer(text.encode().translate(_LOWER), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = _WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[1]
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The ascending distinct 64-bit hashes of the n-grams of `width` words."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(width, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        x = w[i : len(w) - n + 1 + i]
        h = (h ^ (h >> np.uint64(30))) * _MIX[2] + x * _MIX[3]
    h = h * _MIX[4] + np.uint64(n)
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return np.unique(h ^ (h >> np.uint64(32)))


def list_keys(grams: np.ndarray) -> np.ndarray:
    """The bits of n-grams that are counted and indexed; they ascend with the n-grams."""
    return grams >> np.uint64(64 - KEY_BITS)


def _blocks(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs, n = [], [], 0
        for b in batches:
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = list_keys(shingles(t, width))
                if len(key):
                    keys.append(key)
                    runs.append(np.full(len(key), r, np.uint32))
                    n += len(key)
            if n > 1_200_000:
                yield from key_blocks(np.concatenate(keys), np.concatenate(runs), buckets)
                keys, runs, n = [], [], 0
        if n:
            yield from key_blocks(np.concatenate(keys), np.concatenate(runs), buckets)

    return run


INDEXED = "kind int, doc_id {id}, sid long, n long, key long, pos long, own long, keys binary"


def prefix_length(n: int, percent: int) -> int:
    """n - ceil(percent/100 * n) + 1."""
    return n - (-(-percent * n // 100)) + 1


def _index(width: int, percent: int, id_type: pa.DataType):
    """Of a run: kind 0 index entries, kind 1 sets that have entries, kind 2 documents."""

    def run(key: tuple, docs: pa.Table, repeated: pa.Table) -> pa.Table:
        me = key[0].as_py()
        known, totals = counted(repeated)
        members: list[tuple[object, int, int]] = []
        sets: list[tuple[int, int, int, bytes]] = []
        entries: list[tuple[np.ndarray, int]] = []
        numbers: dict[object, int] = {}
        for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            x = shingles(t, width)
            n = len(x)
            # Equal sets of the run are one; an empty set belongs to its row's id alone.
            same = hashlib.blake2b(x.tobytes(), digest_size=16).digest() if n else ("empty", d)
            fresh = same not in numbers
            s = numbers.setdefault(same, me << 32 | len(numbers))
            members.append((d, s, n))
            if not n or not fresh:
                continue
            keys = list_keys(x)
            df = look_up(keys, known, totals, 1)
            single = int((df < 2).sum())
            length = prefix_length(n, percent)
            if single < length:
                entries.append((keys[np.lexsort((x, df))[single:length]], single))
                sets.append((s, n, single, x.astype("<u8").tobytes()))
        lengths = [len(k) for k, _ in entries]
        spread_out = lambda values: np.repeat(np.array(values, np.int64), lengths)
        single = spread_out([o for _, o in entries])
        starts = np.cumsum([0, *lengths])
        places = np.arange(starts[-1]) - np.repeat(starts[:-1], lengths) + single
        keys = np.concatenate([k for k, _ in entries]).astype(np.int64) if entries else np.zeros(0, np.int64)
        # In the order of INDEXED, without kind.
        kinds = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def table(kind: int, n: int, columns: dict[int, object]) -> pa.Table:
            cells = [pa.array(columns[i], t) if i in columns else pa.nulls(n, t) for i, t in enumerate(kinds)]
            return pa.table([pa.array(np.full(n, kind), pa.int32()), *cells], names=["kind", "doc_id", "sid", "n", "key", "pos", "own", "keys"])

        return pa.concat_tables(
            [
                table(0, len(keys), {1: spread_out([s[0] for s in sets]), 2: spread_out([s[1] for s in sets]), 3: keys, 4: places, 5: single}),
                table(1, len(sets), {1: [s[0] for s in sets], 6: [s[3] for s in sets]}),
                table(2, len(members), {0: [m[0] for m in members], 1: [m[1] for m in members], 2: [m[2] for m in members]}),
            ]
        )

    return run


def _linkable(percent: int, n1, p1, n2, p2):
    """Can sets of these sizes, first equal at these places, link?"""
    return (100 + percent) * F.least(n1 - p1, n2 - p2) >= percent * (n1 + n2)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            a, b = [], []
            for x, y, kx, ky in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x != last:
                    last, mine = x, np.frombuffer(kx, "<u8")
                other = np.frombuffer(ky, "<u8")
                small, large = (mine, other) if len(mine) <= len(other) else (other, mine)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    one = sets.select(F.col("sid").alias("a"), F.col("keys").alias("ka"))
    two = sets.select(F.col("sid").alias("b"), F.col("keys").alias("kb"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "ka", "kb").mapInArrow(check, "a long, b long")


def _between(percent: int):
    """Pairs of one piece pair of one list whose sets lie in different components and could link."""

    def run(rows: pa.Table) -> pa.Table:
        sid, comp, n, p, piece = (rows.column(c).to_numpy() for c in ("sid", "component", "n", "pos", "piece"))
        names, counts = np.unique(comp, return_counts=True)
        rare = np.flatnonzero(comp != names[counts.argmax()])
        common = comp == names[counts.argmax()]
        two = int(piece.min()) != int(piece.max())
        a, b = [], []
        for i in rare.tolist():
            # Skip all of its own component, and what size and place rule out.
            ok = (comp != comp[i]) & (common | (sid > sid[i])) & ((100 + percent) * np.minimum(n[i] - p[i], n - p) >= percent * (n[i] + n))
            if two:
                ok &= piece != piece[i]
            at = np.flatnonzero(ok)
            b.append(sid[at])
            a.append(np.full(len(at), sid[i]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text); ids are whole numbers or binary.

    Two documents link when 100 * common n-grams >= percent * n-grams of both.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = text_bytes(docs)
    # Half of what other operators take: a run's sets, keys and index entries are held at once.
    runs = spread(size, RUN_BYTES // 2)
    buckets = spread(size, 6 * BUCKET_KEYS)
    id_type = "binary" if docs.schema["doc_id"].dataType.typeName() == "binary" else "long"
    shape = INDEXED.format(id=id_type)
    placed = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text").withColumn("run", run_of(runs, "doc_id", "text"))
    repeated = tally(placed.select("run", "text").mapInArrow(_blocks(width, buckets), BLOCK))
    made = placed.groupBy("run").cogroup(repeated.groupBy("run")).applyInArrow(_index(width, percent, pa.binary() if id_type == "binary" else pa.int64()), shape)
    path = shared_path(spark, "ngrams")
    made.write.partitionBy("kind").parquet(path)
    # kind, the folder, is read back as the last column.
    index = spark.read.schema(shape.replace("kind int, ", "") + ", kind int").parquet(path)
    entries = index.where("kind = 0").select("sid", "n", "key", "pos", "own")
    sets = index.where("kind = 1").select("sid", "keys")
    members = index.where("kind = 2").select("doc_id", "sid", "n")
    # Rows of one id are spread over the runs by their text; each of their sets is linked with the least.
    several = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a != z").select("doc_id", "a")
    same_id = members.join(kept(several, "ids"), "doc_id").where("sid != a").select("a", F.col("sid").alias("b")).distinct()

    pivots = entries.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), F.col("sid"), F.col("n"), F.col("pos"))).alias("v"), F.count("*").alias("c")).where("c > 1")
    first = (
        entries.join(pivots, "key")
        .where((F.col("sid") != F.col("v.sid")) & _linkable(percent, F.col("n"), F.col("pos"), F.col("v.n"), F.col("v.pos")))
        .select(F.col("v.sid").alias("a"), F.col("sid").alias("b"))
        .distinct()
    )
    first = kept(first, "pairs")
    links = kept(verified(first, sets, percent).union(same_id), "links")
    found = components(links)

    named = entries.join(found, F.col("sid") == F.col("node"), "left").select("sid", "n", "key", "pos", F.coalesce("component", "sid").alias("component"))
    mixed_lists = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x != y").select("key", (F.floor(F.col("c") / LIST_PIECE) + 1).alias("pieces"))
    dealt = (
        named.join(mixed_lists, "key")
        .withColumn("piece", F.pmod(F.xxhash64("sid"), F.col("pieces")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .withColumns({"one": F.least("piece", "other"), "two": F.greatest("piece", "other")})
    )
    rest = dealt.groupBy("key", "one", "two").applyInArrow(lambda rows: _between(percent)(rows), "a long, b long").distinct()
    rest = kept(rest.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    more = verified(rest, sets, percent)
    found = components(links.union(kept(more, "links")))

    placed = members.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "n", F.coalesce("component", "sid").alias("component"))
    # Written, so that the sums do not lie in the tasks of the join: Spark deals out the rows of a large component anew.
    least = kept(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return placed.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
