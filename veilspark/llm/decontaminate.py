"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words, over all documents, whose hashed words are kept for the next step.
2. A distributed randomised SVD of the TF-IDF passages of all documents and all benchmark items: tasks sum A'AX for a random
   thin X, and the Nystrom form of that sum gives the leading right singular vectors after one pass. A task adds its
   passages with random signs into `ROWS` rows, `FOLD` of them before it multiplies: each counts, and the
   expectation of the sum is that of multiplying one by one. The rank grows with the number of items.
3. Passages are overlapping windows of words, of about the length of the item that they are compared with: lengths double
   from class to class. A window's TF-IDF vector is the sum of its two halves, and so is its latent
   vector, so words are projected once. Windows whose cosine with an item reaches `COSINE` are candidates, all of them.
4. A candidate is checked by the longest common subsequence of words between the item and the window with its
   surroundings. It is contaminated if that covers `SURE` of the item, or `LIKELY` of it and also `ANSWER` of the
   item's last sentence, its answer: a paraphrase keeps the answer.

Items are the queries, and are broadcast; where they exceed `ITEM_BYTES` they are dealt into slices by a hash, which pass over the
documents one after another. Documents never meet each other.

Behaviour: null and empty documents and items match nothing; equal items all match; repeated rows are judged each; the best
match is the one with the largest share, then the least item_id; an empty table gives an empty result; extra columns
are kept by `clean` and ignored by `matches`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches
from .ngram_join import word_hashes

#: Hash buckets of words, and dimensions of the latent space: as many as items within these bounds.
DIMS, RANK, RANK_MOST, EXTRA = 1 << 15, 160, 1024, 64
#: Half a window of the passages that the projection is fitted on, and of the shortest windows searched, in words.
HALF, LEAST_HALF = 20, 5
#: Words of a text that are projected at a time, about, and words times items that are looked at together.
PART, HITS = 10240, 1 << 20
#: Words that are counted into passages at a time, in whole passages.
WORDS = 1500 * 2 * HALF
#: Rows that a task adds passages into, and passages added before they are multiplied and the rows begin anew.
ROWS, FOLD = 512, 1 << 17
#: Dimensions whose sums travel as one row.
SUM_DIMS = 256
#: Weight of the items in the matrix that is factored; beyond so many passages it grows with their number, so that items keep their share.
ITEM_WEIGHT, ITEM_PASSAGES = 6.0, 25_000
COSINE = 0.30
SURE, LIKELY, ANSWER = 0.75, 0.5, 0.8
#: Bound of the item texts of one slice (about).
ITEM_BYTES = 64 << 20


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, which is what bytes are split at."""
    return text.lower().encode("utf-8", "surrogatepass").split()


def buckets(text: str) -> np.ndarray:
    h = word_hashes(text.lower())
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64)


def distinct(h: np.ndarray) -> np.ndarray:
    """The ascending distinct buckets; numbers of 16 bits are sorted by digits."""
    h = np.sort(h.astype(np.uint16), kind="stable")
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first].astype(np.int64)


@dataclass
class Latent:
    """Projection of each bucket (idf included), the items' unit vectors, and their words."""

    project: np.ndarray
    items: np.ndarray
    ids: list[int]
    texts: list[list[bytes]]
    answers: list[list[bytes]]

    def __getstate__(self):
        # The projection travels in half precision, scaled so that its numbers lie well within it.
        scale = float(np.abs(self.project).max()) or 1.0
        return {"project": (self.project / scale).astype(np.float16), "scale": scale, "items": self.items, "ids": self.ids, "texts": self.texts, "answers": self.answers}

    def __setstate__(self, state):
        self.project = state["project"].astype(np.float32) * np.float32(state["scale"])
        self.items, self.ids, self.texts, self.answers = state["items"], state["ids"], state["texts"], state["answers"]
        self.__post_init__()

    def __post_init__(self):
        self.lengths = np.array([len(t) for t in self.texts])
        self.need = LIKELY * self.lengths
        # For each bucket, the items that hold it and how often.
        held = Counter((b, i) for i, t in enumerate(self.texts) for b in buckets(b" ".join(t).decode("utf-8", "surrogatepass")).tolist())
        rows = np.array(sorted((b, i, n) for (b, i), n in held.items()), np.int64).reshape(-1, 3)
        self.start, self.holder, self.times = np.searchsorted(rows[:, 0], np.arange(DIMS + 1)), rows[:, 1], rows[:, 2].astype(np.float32)
        self.held = self.start[1:] > self.start[:-1]
        #: Items of each length of half windows, shortest first, and the longest of them.
        halves = [half_window(len(t)) for t in self.texts]
        self.classes = {h: np.flatnonzero(np.array(halves) == h) for h in sorted(set(halves))}
        #: Words of a window with its surroundings.
        self.spans = np.array([2 * h + 2 * len(t) for h, t in zip(halves, self.texts, strict=True)])


def half_window(length: int) -> int:
    """Half the window for items of `length` words: windows have from 0.7 to 1.4 times their words, 10 at least."""
    h = LEAST_HALF
    while 2 * h < 0.7 * length:
        h *= 2
    return h


@dataclass
class Counted:
    """Documents that hold each bucket, documents and passages in all, and the hashed words of each document."""

    df: np.ndarray
    n: int
    passages: int
    words: DataFrame


def document_frequencies(docs: DataFrame) -> Counted:
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, passages = np.zeros(DIMS, np.int64), 0, 0
        for b in batches:
            hashed = [buckets(t) for t in b.column(0).to_pylist()]
            for h in hashed:
                df[distinct(h)] += 1
                passages += -(-len(h) // (2 * HALF))
            n += len(hashed)
            none = pa.nulls(len(hashed), pa.int64())
            yield pa.RecordBatch.from_pydict({"at": none, "n": none, "words": pa.array([h.astype("<u2").tobytes() for h in hashed], pa.binary())})
        at = np.flatnonzero(df)
        counts = pa.array(np.r_[df[at], n, passages], pa.int64())
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.r_[at, DIMS, DIMS + 1], pa.int64()), "n": counts, "words": pa.nulls(len(counts), pa.binary())})

    found = kept(docs.where(F.length("text") > 0).select("text").mapInArrow(count, "at long, n long, words binary"), "words")
    df = np.zeros(DIMS + 2, np.int64)
    for r in found.where("at is not null").groupBy("at").agg(F.sum("n").alias("n")).collect():
        df[r["at"]] = r["n"]
    return Counted(df[:DIMS], int(df[DIMS]), int(df[DIMS + 1]), found.where("at is null").select("words"))


def _start(width: int) -> np.ndarray:
    """The random matrix that the SVD begins with: each task draws the same."""
    return np.random.default_rng(5).standard_normal((DIMS, width), np.float32)


class Gram:
    """A'AX over passages that are added."""

    def __init__(self, idf: np.ndarray, width: int, rows: int = ROWS, fold: int = FOLD, seed: int = 0):
        self.idf, self.x, self.fold = idf, _start(width), fold
        self.rows, self.n = np.zeros((rows, DIMS), np.float32), 0
        self.total = np.zeros((DIMS, width), np.float32)
        self.signs = np.random.default_rng(seed)

    def add(self, passage: np.ndarray, h: np.ndarray, weight: float = 1.0) -> None:
        """Words `h` of passages that are numbered from 0 in `passage`; a passage counts as a unit vector times `weight`."""
        key = np.sort((passage * DIMS + h).astype(np.int32))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        p, u = np.divmod(key[first], DIMS)
        a = np.diff(np.r_[first, len(key)]) * self.idf[u]
        n = int(p[-1]) + 1
        a *= (self.signs.choice([-weight, weight], n) / (np.sqrt(np.bincount(p, a * a)) + 1e-12))[p]
        at = 0
        while at < n:
            # Passages go to the rows in turn, so those of one text are far apart and the first ones are alone.
            end = min(n, at + self.fold - self.n)
            lo, hi = np.searchsorted(p, [at, end])
            np.add.at(self.rows.reshape(-1), (self.n + p[lo:hi] - at) % len(self.rows) * DIMS + u[lo:hi], a[lo:hi].astype(np.float32))
            self.n, at = self.n + end - at, end
            if self.n == self.fold:
                self.multiply()

    def multiply(self) -> None:
        if self.n:
            used = self.rows[: self.n]
            self.total += used.T @ (used @ self.x)
            used[:] = 0
            self.n = 0


def _gram(idf: np.ndarray, width: int):
    """A'AX over a task's passages, as blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(idf, width, seed=TaskContext.get().partitionId())
        for b in batches:
            texts = [np.frombuffer(t, "<u2").astype(np.int64) for t in b.column(0).to_pylist()]
            while texts:
                # A stretch of texts of bounded words; one that is longer goes in parts of whole passages.
                some, size = [], 0
                while texts and size < WORDS:
                    some.append(texts[-1][:WORDS])
                    texts[-1] = texts[-1][WORDS:]
                    size += len(some[-1])
                    if not len(texts[-1]):
                        texts.pop()
                n = np.array([len(h) for h in some])
                per = -(-n // (2 * HALF))
                place = np.arange(size) - np.repeat(np.cumsum(n) - n, n)
                if size:
                    gram.add(np.repeat(np.cumsum(per) - per, n) + place // (2 * HALF), np.concatenate(some))
        gram.multiply()
        for i in range(0, DIMS, SUM_DIMS):
            if gram.total[i : i + SUM_DIMS].any():
                yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int64()), "v": pa.array([gram.total[i : i + SUM_DIMS].tobytes()], pa.binary())})

    return run


def _sum_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(SUM_DIMS * width), None
        for b in batches:
            for at, v in zip(b.column("at").to_pylist(), b.column("v").to_pylist(), strict=True):
                total += np.frombuffer(v, np.float32)
        yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    return run


def item_slices(bench: DataFrame) -> list[DataFrame]:
    """The items in parts of about `ITEM_BYTES`, by a hash of id and text."""
    parts = (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES + 1
    return [bench.where(F.pmod(F.xxhash64("item_id", "text", F.lit("slice")), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [bench]


def fit(docs: DataFrame, bench: DataFrame, counted: Counted | None = None) -> Latent | None:
    """The projection for the items of `bench`; `counted` is what was counted in the documents, where that is known."""
    small_batches(docs.sparkSession)
    rows = sorted((r["item_id"], r["text"]) for r in bench.where("item_id is not null and length(text) > 0").select("item_id", "text").collect())
    rows = [(i, t) for i, t in rows if words(t)]
    if not rows:
        return None
    counted = counted or document_frequencies(docs)
    idf = np.log((1 + counted.n) / (1 + counted.df))
    idf = np.maximum(idf, 0.05)
    hashed = [buckets(t) for _, t in rows]

    rank = min(max(RANK, len(rows)), RANK_MOST)
    width = rank + EXTRA
    gram = Gram(idf, width, rows=128, fold=128)
    weight = ITEM_WEIGHT * max(1.0, counted.passages / ITEM_PASSAGES) ** 0.5
    for h in hashed:
        gram.add(np.zeros(len(h), np.int64), h, weight)
    gram.multiply()
    x, total = gram.x, gram.total
    del gram
    # As few sums as keep all cores busy; the driver takes a partition of them at a time.
    parts = counted.words.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(_gram(idf, width), "at long, v binary")
    for r in parts.groupBy("at").applyInArrow(_sum_rows(width), "at long, v binary").toLocalIterator():
        total[r["at"] : r["at"] + SUM_DIMS] += np.frombuffer(r["v"], np.float32).reshape(-1, width)
    # A'A is about Y inv(X'Y) Y' for Y = A'AX; `turn` takes Y to the leading singular vectors of that.
    core, square = (x.T @ total).astype(np.float64), (total.T @ total).astype(np.float64)
    values, turn = np.linalg.eigh((core + core.T) / 2)
    turn = turn[:, ok := values > 1e-5 * values[-1]] / np.sqrt(values[ok])
    values, inner = np.linalg.eigh(turn.T @ square @ turn)
    turn = turn @ (inner / np.sqrt(np.maximum(values, 1e-12 * values[-1])))[:, ::-1][:, :rank]
    # The last row, all zero, fills up the last half window of a text.
    project = np.zeros((DIMS + 1, turn.shape[1]), np.float32)
    np.matmul(total, turn.astype(np.float32), out=project[:DIMS])
    project[:DIMS] *= idf[:, None].astype(np.float32)
    items = np.array([project[h].sum(0) for h in hashed], np.float32)
    items /= np.linalg.norm(items, axis=1, keepdims=True) + 1e-9
    split = [words(t) for _, t in rows]
    answers = [words(re.split(r"[.!?]\s+", t.strip().rstrip(".!?"))[-1]) or w for (_, t), w in zip(rows, split, strict=True)]
    return Latent(project, items, [i for i, _ in rows], split, answers)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a word of `b` at a time over a bit row of `a`."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = places.get(w)
        if hit is not None:
            u = row & hit
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def shared_words(latent: Latent, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items that share enough words with a text to be in it, and how often they hold each of its buckets.

    The rows of the last result belong to the buckets of the second.
    """
    u = distinct(h[latent.held[h]])
    n = latent.start[u + 1] - latent.start[u]
    at = np.repeat(latent.start[u] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, times = latent.holder[at], latent.times[at]
    possible = np.flatnonzero(np.bincount(item, times, len(latent.texts)) >= latent.need)
    place = np.full(len(latent.texts), -1)
    place[possible] = np.arange(len(possible))
    place = place[item]
    ok = place >= 0
    held = np.zeros((len(u), len(possible)), np.float32)
    held[np.repeat(np.arange(len(u)), n)[ok], place[ok]] = times[ok]
    return possible, u, held


def most_shared(latent: Latent, row: np.ndarray, held: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """For each place of a text and each item: how many of its words a window with its surroundings, from there on, can share.

    A word counts as often as both hold it, so no common subsequence is longer. `row` is the place in `held` of each word of the
    text, or -1. An occurrence counts for the stretches that begin after the one that is so many occurrences before it as the
    item has, and at most a stretch's length before it.
    """
    at = np.flatnonzero(row >= 0)
    at = at[np.argsort(row[at], kind="stable")]
    own = row[at]
    first = np.searchsorted(own, own)
    k, item = np.nonzero(held[own])
    before = k - held[own[k], item].astype(np.int64)
    before = np.where(before >= first[k], at[np.maximum(before, 0)], -1)
    n, size = len(possible), len(row) + 2
    begin = np.maximum(before, at[k] - latent.spans[possible][item]) + 1
    change = np.bincount(item * size + np.maximum(begin, 0), minlength=n * size) - np.bincount(item * size + at[k] + 1, minlength=n * size)
    return np.cumsum(change.reshape(n, size), axis=1)


def candidates(latent: Latent, h: np.ndarray, possible: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Half length, and arrays of first words and places in `possible`, of windows that come close to items of their length."""
    mine = np.zeros(len(latent.texts), bool)
    mine[possible] = True
    classes = {half: at[mine[at]] for half, at in latent.classes.items() if mine[at].any()}
    longest = max(classes)
    per = -(-PART // longest) * longest
    for base in range(0, len(h), per):
        part = h[base : base + per + longest]
        padded = np.full(-(-len(part) // LEAST_HALF) * LEAST_HALF, DIMS)
        padded[: len(part)] = part
        halves = np.concatenate([latent.project.take(padded[i : i + PART // 8], axis=0).reshape(-1, LEAST_HALF, latent.project.shape[1]).sum(1) for i in range(0, len(padded), PART // 8)])
        size = LEAST_HALF
        for half, at in classes.items():
            while size < half:
                if len(halves) % 2:
                    halves = np.concatenate([halves, np.zeros_like(halves[:1])])
                halves, size = halves[::2] + halves[1::2], size * 2
            z = halves[: per // half + 1]
            z = z[:-1] + z[1:] if len(z) > 1 else z
            least = COSINE * (np.sqrt(np.einsum("ij,ij->i", z, z)) + 1e-9)
            for lo in range(0, len(at), 4096):
                some = at[lo : lo + 4096]
                w, i = np.nonzero(z @ latent.items[some].T >= least[:, None])
                if len(w):
                    yield half, base + w * half, np.searchsorted(possible, some[i])


def judged(latent: Latent, text: str) -> list[tuple[int, float, float]]:
    """(item, share of the item, share of its answer) of the items that the text holds.

    A common subsequence is no longer than the words that both hold, so items and windows that share too few are passed
    over without losing any.
    """
    h = buckets(text)
    possible, u, held = shared_words(latent, h)
    if not len(possible):
        return []
    row = np.full(DIMS, -1)
    row[u] = np.arange(len(u))
    row = row[h]
    step = max(1, HITS // len(h))
    parts = [_windows(latent, h, row, held[:, i : i + step], possible[i : i + step]) for i in range(0, len(possible), step)]
    near = [x for part in parts for x in part]
    if not near:
        return []
    w, out = words(text), []
    for item, windows in near:
        target, answer = latent.texts[item], latent.answers[item]
        best = (0.0, 0.0)
        for s, end in windows:
            region = w[max(0, s - len(target)) : end + len(target)]
            share = common_subsequence(target, region) / len(target)
            if share > best[0]:
                best = (share, common_subsequence(answer, region) / len(answer))
        if best[0] >= SURE or (best[0] >= LIKELY and best[1] >= ANSWER):
            out.append((item, *best))
    return out


def _windows(latent: Latent, h: np.ndarray, row: np.ndarray, held: np.ndarray, possible: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """The candidate windows of each item, without those that share too few words."""
    shared = most_shared(latent, row, held, possible)
    enough = shared.max(1) >= latent.need[possible]
    if not enough.any():
        return []
    possible, shared = possible[enough], shared[enough]
    near: dict[int, list[tuple[int, int]]] = {}
    for half, starts, places in candidates(latent, h, possible):
        ok = shared[places, np.maximum(starts - latent.lengths[possible[places]], 0)] >= latent.need[possible[places]]
        for s, item in zip(starts[ok].tolist(), possible[places[ok]].tolist(), strict=True):
            near.setdefault(item, []).append((s, s + 2 * half))
    return list(near.items())


def _update(held):
    """Best item, its shares and the number of items of each row, taken on from the slices of items before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Latent = held.value
        for b in batches:
            rows = []
            for d, t, *last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = judged(m, t) if t else []
                best = [(share, -m.ids[i], answer) for i, share, answer in got] + ([(last[1], -last[0], last[2])] if last[3] else [])
                share, item, answer = max(best, key=lambda x: x[:2]) if best else (None, None, None)
                rows.append((d, t, None if item is None else -item, share, answer, len(got) + last[3]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), b.schema, strict=True)], schema=b.schema)

    return run


def _each_slice(docs: DataFrame, bench: DataFrame) -> Iterator[Latent]:
    counted = None
    for items in (slices := item_slices(bench)):
        counted = counted or (document_frequencies(docs) if len(slices) > 1 else None)
        latent = fit(docs, items, counted)
        if latent is not None:
            yield latent


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share, n_items: the best item of every contaminated row of `docs`."""
    spark = docs.sparkSession
    shape = "doc_id long, text string, item_id long, lcs_share double, answer_share double, n_items long"
    none = F.lit(None).cast("double")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", none.cast("long").alias("item_id"), none.alias("lcs_share"), none.alias("answer_share"), F.lit(0).cast("long").alias("n_items"))
    for k, latent in enumerate(_each_slice(docs, bench)):
        # DIMS x RANK numbers and the items of one slice; what came before it is written, so that workers hold one at a time.
        out = (kept(out, "matches") if k else out).mapInArrow(_update(spark.sparkContext.broadcast(latent)), shape)
    return out.where("n_items > 0").drop("text")


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item, all columns kept."""
    at, out = docs.columns.index("text"), docs
    for k, latent in enumerate(_each_slice(docs, bench)):
        held = docs.sparkSession.sparkContext.broadcast(latent)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [not (t and judged(held.value, t)) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        out = (kept(out, "clean") if k else out).mapInArrow(run, docs.schema)
    return out
