"""Ranked lexical search by scanning: an automaton of all query terms runs over the text of every document; no index is made.

1. Terms of the items (A-Z lower-cased, cut at other ASCII than letters and digits) make an Aho-Corasick automaton, each term
   between two blanks. Of a text all separators become blanks, so the automaton meets whole terms only. Its outputs are numbers of
   terms, and each number leads to the items that hold the term.
2. A first scan counts documents, terms, and the documents of each item term; sums are partial in the tasks, one row a term comes
   to the driver.
3. A second scan works out the scores of each document for all items at once and keeps the best of each item in the task. Two rounds of
   ranking, by item and group of tasks and then by item, leave the best of all.

The automaton goes to every worker, so items are taken in slices of about TERM_BYTES of distinct terms; each slice takes two scans.

Behaviour: documents that are null or without a term count nowhere and match nothing; repeated rows are documents of their own; a document without an id
ranks behind its equals; rows of one item id are one item with the terms of all, and so are those without an id; items without a
term, and empty tables, give no rows; a very long text is scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, small_batches

#: Bytes of the distinct terms of a slice, on average; a node of the automaton takes some 40 bytes.
TERM_BYTES = 4 << 20
#: Scores that a task holds at once, and candidates it holds for each place of a ranking before it ranks them.
CELLS, HELD = 4 << 20, 4
#: Tasks whose rankings are merged together first.
MERGED = 256
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of a byte: a lower-case letter, a digit or part of a longer character as it is, A-Z lower-cased, a blank for all else.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scanned(text: str | None) -> tuple[str, int]:
    """A text as the automaton reads it, a character for each byte, and the number of its terms."""
    data = b" %s " % (text or "").encode().translate(_BYTES)
    blank = np.frombuffer(data, np.uint8) == 32
    return data.decode("latin-1"), int(np.count_nonzero(blank[:-1] & ~blank[1:]))


def automaton(terms: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(f" {t.encode().decode('latin-1')} ", i)
    found.make_automaton()
    return found


#: The automaton that a Python worker built last, by the slice it is for: it outlives a task.
_BUILT: dict[str, object] = {}


def _automaton_of(name: str, terms: list[str]):
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = automaton(terms)
    return _BUILT[name]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _rows(batches: Iterator[pa.RecordBatch], matcher) -> Iterator[tuple[int | None, int, Counter]]:
    """(id, terms, how often each item term occurs) of the documents that have a term."""
    if matcher is None:
        return
    term = itemgetter(1)
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            line, n = scanned(text)
            if n:
                yield doc, n, Counter(map(term, matcher.iter(line)))


def _counts(docs: DataFrame, name: str, terms) -> dict[int, int]:
    """Documents of each term; under -1 documents, under -2 terms of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(terms.value), np.int64), 0, 0
        for _, n, found in _rows(batches, _automaton_of(name, terms.value)):
            n_docs, n_terms = n_docs + 1, n_terms + n
            df[list(found)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.r_[held, -1, -2], pa.int64()), "df": pa.array(np.r_[df[held], n_docs, n_terms], pa.int64())})

    sums = docs.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in sums.collect()}


class _Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 4  # item, score, is the id null, id
        self.waiting: list[list[np.ndarray]] = []
        self.n = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        at, item = np.nonzero(scores >= self.least)
        self.waiting.append([item, scores[at, item], nulls[at], ids[at]])
        self.n += len(at)
        if self.n > HELD * self.items * self.top + CELLS // 8:
            self.rank()

    def rank(self) -> None:
        item, score, null, doc = (np.concatenate(x) for x in zip(self.rows, *self.waiting, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        order, item, place = order[place < self.top], item[place < self.top], place[place < self.top]
        self.rows = [item, score[order], null[order], doc[order]]
        # Of an item with a full ranking, lower scores no longer count.
        last = place == self.top - 1
        self.least[item[last]] = self.rows[1][last]
        self.waiting, self.n = [], 0


def _scored(docs: DataFrame, name: str, known, top: int) -> DataFrame:
    """`known`: a broadcast of the slice."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        terms, weights, starts, lists, items, n_docs, n_terms = known.value
        best, step = _Best(len(items), top), max(1, CELLS // max(1, len(items)))
        ids, nulls, doc, term, tf, m = [], [], [], [], [], []

        def flush() -> None:
            where, t, f = np.repeat(np.arange(len(ids)), doc), np.array(term, np.int64), np.array(tf, np.int64)
            gain = weights[t] * (1_000_000_000 * f // (1000 * f + 20 * np.array(m, np.int64)[where]))
            # Each term of a document adds to all items that hold it.
            n = starts[t + 1] - starts[t]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[t], n)
            sums = np.zeros(len(ids) * len(items), np.int64)
            np.add.at(sums, np.repeat(where, n) * len(items) + lists[at], np.repeat(gain, n))
            best.add(sums.reshape(len(ids), len(items)), np.array(ids, np.int64), np.array(nulls, np.int64))
            for x in (ids, nulls, doc, term, tf, m):
                x.clear()

        for d, n, found in _rows(batches, _automaton_of(name, terms)):
            if not found:
                continue
            ids.append(d or 0)
            nulls.append(d is None)
            doc.append(len(found))
            term += found.keys()
            tf += found.values()
            m.append(100 - 50 + 50 * n * n_docs // n_terms)
            if len(ids) >= step or len(term) > CELLS // 16:
                flush()
        if ids:
            flush()
        best.rank()
        item, value, null, doc_id = best.rows
        group = TaskContext.get().partitionId() // MERGED
        for i in range(0, len(item), 20_000):
            j = min(i + 20_000, len(item))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([items[k] for k in item[i:j].tolist()], pa.int64()), "tasks": pa.array([group] * (j - i), pa.int64()), "doc_id": pa.array(doc_id[i:j], pa.int64(), mask=null[i:j].astype(bool)), "score": pa.array(value[i:j], pa.int64())})

    return docs.mapInArrow(score, "item_id long, tasks long, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each once."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), 1))).alias("term")).distinct()


def ranked(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item of `items` (item_id, text) among all rows of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = kept(item_terms(items), "terms")
    size = pairs.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    slices = size // TERM_BYTES + 1
    found, n_docs, n_terms = None, 0, 0
    for s in range(slices):
        held: dict[int | None, list[str]] = {}
        # A slice's size is bounded by TERM_BYTES, on average, and its largest item.
        for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).collect():
            held.setdefault(r["item_id"], []).append(r["term"])
        terms = sorted(set().union(*held.values()))
        if not terms:
            continue
        number, name = {t: i for i, t in enumerate(terms)}, uuid.uuid4().hex
        df = _counts(texts, name, spark.sparkContext.broadcast(terms))
        n_docs, n_terms = df[-1], df[-2]
        if not n_terms:
            continue
        order = list(held)
        holders: list[list[int]] = [[] for _ in terms]
        for i, item in enumerate(order):
            for t in held[item]:
                holders[number[t]].append(i)
        starts = np.r_[0, np.cumsum([len(x) for x in holders])]
        weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(terms))], np.int64)
        known = spark.sparkContext.broadcast((terms, weights, starts, np.array([i for x in holders for i in x], np.int64), order, n_docs, n_terms))
        mine = _scored(texts, name, known, top)
        found = mine if found is None else found.union(mine)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "tasks").orderBy(*by))).where(F.col("rank") <= top)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by)))
    return last.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
