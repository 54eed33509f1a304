"""LM scoring: the likelihood of a text under a lattice of subwords, all segmentations summed.

The subwords are those of an existing public vocabulary, never trained here; their log-probabilities are the relative
frequencies with which that vocabulary cuts all words of the training rows: one distribution over its pieces and the end. A word's
probability is the sum over all ways to cut it into pieces, by a forward recursion in log space; a text's is the product over
its words and the end, which is the sum over all ways to cut the whole text.

Words are the unit of exchange. Tasks send each distinct word once, with its training count and the runs that hold
it, to the bucket of its hash; a bucket sums counts and runs the recursion once for each distinct word of the corpus, and
sends the numbers to the runs that need them. Common words arrive once from each task, so none is hot.

Behaviour: null and empty texts are the end token alone; characters outside the vocabulary cost their bytes; repeated rows are
scored and counted row by row; a null id is neither held out nor lost: it trains; an empty table gives an empty
result; with no training rows counts are zero and scores stay finite; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, kept, small_batches, text_bytes
from .exchange import pack, run_of, spread, unpack
from .ngram_join import _LOWER, _WHITE, word_hashes

RUN_BYTES = 16 << 20
#: Text bytes for each bucket of words.
BUCKET_BYTES = 4 << 20
SMOOTH = 0.1
#: Distinct words that a task gathers before it sends them.
FLUSH_TOKENS = 4_000_000


class Pieces:
    """log10-probabilities of the vocabulary's pieces."""

    def __init__(self, model: str, counts: np.ndarray, ends: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        total = counts.sum() + ends + SMOOTH * (sp.get_piece_size() + 1)
        logs = np.log10((counts + SMOOTH) / total)
        self.end = float(np.log10((ends + SMOOTH) / total))
        self.logs: dict[str, float] = {}
        self.bytes = [0.0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:-1], 16)] = float(logs[i])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.logs[sp.id_to_piece(i)] = float(logs[i])
        self.table: dict[str, float | None] = {}

    def _prefixes(self) -> dict[str, float | None]:
        """Natural logarithms of the pieces, and None for each string that only begins one; built where it is used."""
        if not self.table:
            for piece in self.logs:
                for n in range(1, len(piece)):
                    self.table.setdefault(piece[:n], None)
            self.table.update((k, v * _TEN) for k, v in self.logs.items())
        return self.table

    def word(self, word: str) -> float:
        """log10 of the summed probability of all segmentations.

        `into[j]` gathers the paths that end at place j; from each place, pieces are followed only while some piece goes on.
        """
        table, text, exp = self._prefixes(), "▁" + word, math.exp
        n = len(text)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        alpha = 0.0
        for i in range(n):
            if i:
                alpha = _log_sum(into[i], exp)
            c = text[i]
            if table.get(c) is None:
                into[i + 1].append(alpha + _TEN * sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")))
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                if piece not in table:
                    break
                v = table[piece]
                if v is not None:
                    into[j].append(alpha + v)
        return _log_sum(into[n], exp) / _TEN


_TEN = math.log(10)


def _log_sum(terms: list[float], exp=math.exp) -> float:
    if len(terms) == 1:
        return terms[0]
    most, total = max(terms), 0.0
    for t in terms:
        total += exp(t - most)
    return most + math.log(total)


def distinct_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of all texts: the hash, the row and the first byte of each word, and the lower-cased bytes."""
    data = [t.encode().translate(_LOWER) for t in texts]
    hashes = [word_hashes(t) for t in texts]
    starts, base = [], 0
    for d in data:
        white = _WHITE[np.frombuffer(d, np.uint8)] if d else np.zeros(0, bool)
        starts.append(np.flatnonzero(~white & np.r_[True, white[:-1]]) + base if len(white) else np.zeros(0, np.int64))
        base += len(d) + 1
    rows = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    return np.concatenate(hashes), rows, np.concatenate(starts), b"\n".join(data) + b"\n"


def _word_at(data: bytes, start: int) -> bytes:
    # Words end at ASCII white space; split once from here, looking no further than needed.
    end = start + 64
    while True:
        piece = data[start:end]
        word = piece.split(None, 1)[0]
        if len(word) < len(piece) or end >= len(data):
            return word
        end += 4 * (end - start)


WORDS = "bucket long, n long, words binary, size long, counts binary, pairs long, at binary, runs binary"
KNOWN = "run long, n long, keys binary, counts binary, logs binary, tokens long, distinct long"


def _word_blocks(buckets: int):
    def emit(hashes: list, runs: list, train: list, words: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        h, r, t = np.concatenate(hashes), np.concatenate(runs), np.concatenate(train)
        order = np.lexsort((r, h))
        h, r, t = h[order], r[order], t[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        u, n = h[new], np.add.reduceat(t, new)
        pair = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
        word_of = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        where, pr = word_of[pair], r[pair]
        bucket = (u >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        cut = np.searchsorted(where, edges)
        for i, j, a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            text = b"\n".join([words[x] for x in u[i:j].tolist()])
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([int(bucket[i])], pa.int64()),
                    "n": pa.array([j - i], pa.int64()),
                    "words": pa.array([pa.compress(text, codec="zstd", asbytes=True)], pa.binary()),
                    "size": pa.array([len(text)], pa.int64()),
                    "counts": pa.array([pack(n[i:j].astype("<i8"))], pa.binary()),
                    "pairs": pa.array([b - a], pa.int64()),
                    "at": pa.array([pack(np.diff(where[a:b] - i, prepend=0).astype("<u4"))], pa.binary()),
                    "runs": pa.array([pack(pr[a:b].astype("<u4"))], pa.binary()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, runs, train, words, n = [], [], [], {}, 0
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            if not texts:
                continue
            h, row, start, data = distinct_words(texts)
            own = b.column(0).to_numpy(zero_copy_only=False)[row].astype(np.uint32)
            learns = b.column(1).to_numpy(zero_copy_only=False)[row].astype(np.int64)
            u, first = np.unique(h, return_index=True)
            for key, s in zip(u.tolist(), start[first].tolist(), strict=True):
                if key not in words:
                    words[key] = _word_at(data, s)
            # One entry for each word and run of the batch.
            order = np.lexsort((own, h))
            h, own, learns = h[order], own[order], learns[order]
            if len(h):
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
                hashes.append(h[new])
                runs.append(own[new])
                train.append(np.add.reduceat(learns, new))
                n += len(new)
            if n > FLUSH_TOKENS:
                yield from emit(hashes, runs, train, words)
                hashes, runs, train, words, n = [], [], [], {}, 0
        if n:
            yield from emit(hashes, runs, train, words)

    return run


def _bucket_words(rows: pa.Table) -> tuple[dict[bytes, int], list[int], list[np.ndarray]]:
    """A bucket's distinct words with their places, their training counts, and for each row the places of its words."""
    index: dict[bytes, int] = {}
    counts: list[int] = []
    own = []
    for text, size, n, packed in zip(*(rows.column(c).to_pylist() for c in ("words", "size", "n", "counts")), strict=True):
        words = pa.decompress(text, decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")
        at = np.empty(n, np.int64)
        for i, (w, c) in enumerate(zip(words, unpack(packed, n, "<i8").tolist(), strict=True)):
            k = index.get(w)
            if k is None:
                k = index[w] = len(counts)
                counts.append(c)
            else:
                counts[k] += c
            at[i] = k
        own.append(at)
    return index, counts, own


def _piece_counts(model: str):
    """How often the vocabulary's pieces cut a bucket's training words: each distinct word is cut once."""

    def run(rows: pa.Table) -> pa.Table:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        index, counts, _ = _bucket_words(rows)
        total = np.zeros(sp.get_piece_size(), np.int64)
        seen = [(w.decode(), c) for w, c in zip(index, counts, strict=True) if c]
        for i in range(0, len(seen), 20_000):
            part = seen[i : i + 20_000]
            ids = sp.encode([w for w, _ in part], num_threads=1)
            many = np.repeat([c for _, c in part], [len(x) for x in ids])
            flat = np.fromiter((y for x in ids for y in x), np.int64, len(many))
            total += np.bincount(flat, weights=many, minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        return pa.table({"piece": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


def learn_pieces(blocks: DataFrame, model: str, ends: int) -> Pieces:
    """Counts over all training words; what comes back is one number for each piece of the vocabulary."""
    import sentencepiece

    rows = blocks.groupBy("bucket").applyInArrow(_piece_counts(model), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size(), np.int64)
    for r in rows:
        counts[r["piece"]] = r["n"]
    return Pieces(model, counts, ends)


def _settle_words(held):
    """Sum the counts of a bucket's words, run the recursion for each, and tell the runs."""

    def run(rows: pa.Table) -> pa.Table:
        pieces: Pieces = held.value
        index, counts, own = _bucket_words(rows)
        at, runs = [], []
        for places, packed, sent, n in zip(own, *(rows.column(c).to_pylist() for c in ("at", "runs", "pairs")), strict=True):
            at.append(places[np.cumsum(unpack(packed, n, "<u4").astype(np.int64))])
            runs.append(unpack(sent, n, "<u4"))
        texts = [w.decode() for w in index]
        logs = np.array([pieces.word(w) for w in texts], "<f4")
        total = np.array(counts, "<i8")
        keys = np.concatenate([word_hashes(w) for w in texts])
        order = np.argsort(keys)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, total, logs = keys[order], total[order], logs[order]
        pairs = np.unique(np.concatenate(runs).astype(np.int64) << 40 | rank[np.concatenate(at)])
        own_run, where = pairs >> 40, pairs & ((1 << 40) - 1)
        edges = np.flatnonzero(np.r_[True, own_run[1:] != own_run[:-1], True])
        out = [(int(own_run[i]), j - i, pack(np.diff(keys[where[i:j]], prepend=np.uint64(0))), pack(total[where[i:j]]), pack(logs[where[i:j]]), 0, 0) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        out.append((-1, 0, b"", b"", b"", int(total.sum()), int((total > 0).sum())))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(zip(("run", "n", "keys", "counts", "logs", "tokens", "distinct"), kinds, strict=True))})

    return run


def _score(ends: int, end_log: float):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        got = known.to_pylist()
        if got:
            keys = np.concatenate([np.cumsum(unpack(r["keys"], r["n"], "<u8"), dtype=np.uint64) for r in got])
            counts = np.concatenate([unpack(r["counts"], r["n"], "<i8") for r in got])
            logs = np.concatenate([unpack(r["logs"], r["n"], "<f4") for r in got])
            order = np.argsort(keys)
            keys, counts, logs = keys[order], counts[order], logs[order].astype(np.float64)
        else:
            keys, counts, logs = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        smooth = np.log10(counts + SMOOTH)
        n_tokens, n_known, base, score = [], [], [], []
        for t in docs.column("text").to_pylist():
            h = word_hashes(t or "")
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            n_tokens.append(len(h) + 1)
            n_known.append(int((counts[at] > 0).sum()) + (ends > 0) if len(h) else int(ends > 0))
            base.append(float(smooth[at].sum() if len(h) else 0.0) + math.log10(ends + SMOOTH))
            score.append(float(logs[at].sum() if len(h) else 0.0) + end_log)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "sum_logs": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return run


def lattice_scores(docs: DataFrame, model: str) -> DataFrame:
    """Scores of all rows of `docs` (doc_id, text), learned from those outside the held-out tenth."""
    spark = docs.sparkSession
    small_batches(spark)
    size = text_bytes(docs)
    runs, buckets = spread(size, RUN_BYTES), spread(size, BUCKET_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"held_out": F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)), "run": run_of(runs, "doc_id", "text")})
    ends = rows.where(~F.col("held_out")).count()
    # Written once: the words are read for the pieces, and again for the recursion.
    blocks = kept(rows.select("run", (~F.col("held_out")).cast("int").alias("train"), "text").mapInArrow(_word_blocks(buckets), WORDS), "words")
    pieces = learn_pieces(blocks, model, ends)
    held = spark.sparkContext.broadcast(pieces)  # as many numbers as the vocabulary has pieces
    known = kept(blocks.groupBy("bucket").applyInArrow(_settle_words(held), KNOWN), "words")
    sums = known.where("run = -1").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    n_train = (sums["n"] or 0) + ends
    v = (sums["v"] or 0) + (ends > 0)
    scored = rows.groupBy("run").cogroup(known.where("run >= 0").groupBy("run")).applyInArrow(_score(ends, pieces.end), "doc_id long, held_out boolean, n_tokens long, n_known long, sum_logs double, score double")
    below = math.log10(n_train + SMOOTH * (v + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("sum_logs") - F.col("n_tokens") * below).alias("base_score"), "score")
