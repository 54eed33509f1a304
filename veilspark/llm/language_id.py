"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows; document
frequencies are counted over all training rows; a temperature is fitted on a part of the sample that did not train.

Behaviour: null texts and texts without a letter get `und` and score 0; rows without a label never train; repeated rows are
scored row by row; an empty table gives an empty result; with no labelled row every text is `und`; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches

#: Hash buckets of n-grams of 1 to 3 characters.
DIMS = 1 << 15
#: Bound of the training rows of each language (about).
PER_LANG = 600
#: Bound of the training rows of all languages (about): with many, each gives fewer.
MOST_ROWS = 6000
#: Characters whose n-grams are built at a time.
CHUNK = 1 << 20


def grams(text: str, starts: int) -> np.ndarray:
    """Bucket of each 1-, 2- and 3-gram that begins at one of the first `starts` characters; digits and marks count as spaces."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c <= 64), np.uint32(32), c)
    one = c[:starts] * np.uint32(2654435761)
    two = (c[:-1] * np.uint32(40503) + c[1:])[:starts] * np.uint32(2246822519)
    three = ((c[:-2] * np.uint32(40503) + c[1:-1]) * np.uint32(30011) + c[2:])[:starts] * np.uint32(3266489917)
    return np.concatenate([one, two, three]) >> np.uint32(17)


def counts(text: str) -> np.ndarray:
    """Counts of the n-grams of a whole text, lower-cased and with a space at each end.

    They are built piece by piece; each n-gram belongs to the piece that it begins in, so the pieces' size does not matter.
    """
    padded = f" {text.lower()} "
    out = np.zeros(DIMS, np.int64)
    for i in range(0, len(padded), CHUNK):
        out += np.bincount(grams(padded[i : i + CHUNK + 2], CHUNK), minlength=DIMS)
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, x = features(text, self.idf)
        return x @ self.weights[at] + self.bias


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = counts(text)
    at = np.flatnonzero(n)
    x = np.sqrt(n[at]) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) + 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 3) -> LanguageModel:
    """FTRL-proximal on the rows (buckets, values, lang), then a temperature on every fifth of them, which did not train."""
    langs = sorted({lang for _, _, lang in rows})
    y = {k: i for i, k in enumerate(langs)}
    data = [(at, x, y[k]) for at, x, k in rows]
    order = np.random.default_rng(7).permutation(len(data))
    held, used = order[::5], np.setdiff1d(order, order[::5])
    if not len(used):
        held, used = order, order
    k = len(langs)
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(used):
            at, x, label = data[i]
            at, x = np.append(at, DIMS), np.append(x, 0.2)
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIMS + 1))
    model = LanguageModel(langs, idf, w[:DIMS].astype(np.float32), 0.2 * w[DIMS], 1.0)
    logits = np.array([x @ model.weights[at] + model.bias for at, x, _ in (data[i] for i in held)])
    labels = np.array([data[i][2] for i in held])
    loss = lambda t: -np.mean(np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12))
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows: one vector comes from each task and they are summed in Spark."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df[counts(t) > 0] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, DIMS), pa.int32()), "n": pa.array(np.append(df[at], n), pa.int64())})

    rows = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        df[r["at"]] = r["n"]
    return df[:DIMS], int(df[DIMS])


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel | None:
    """Fit on `docs` (doc_id, text, lang): frequencies from all rows, weights from about `per_lang` rows of each language."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not n:
        return None
    df, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 1.0
    per_lang = max(1, min(per_lang, MOST_ROWS // len(n)))
    scale = 1 << 20
    share = docs.sparkSession.createDataFrame([(k, int(min(1.0, per_lang / v) * scale)) for k, v in n.items()], "lang string, _most long")
    chosen = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit("lang")), F.lit(scale)) < F.col("_most")).select("text", "lang")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, x = features(text, idf)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "at": pa.array([at.astype("<i4").tobytes()], pa.binary()), "x": pa.array([x.astype("<f4").tobytes()], pa.binary())})

    # At most DIMS numbers come from a row, however long its text is.
    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["x"])) for r in chosen.mapInArrow(sparse, "lang string, at binary, x binary").collect())
    return train([(np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4").astype(float), k) for k, at, x in rows], idf) if rows else None


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """`doc_id`, `lang_pred` and `score` of every row; only the text is read."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # DIMS numbers for each language, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            pred, score = [], []
            for t in b.column(1).to_pylist():
                if m is None or not t or not any(map(str.isalpha, t)):
                    pred.append("und")
                    score.append(0.0)
                    continue
                p = _softmax(m.logits(t) / m.temperature)
                k = int(p.argmax())
                pred.append(m.langs[k])
                score.append(float(min(1.0, p[k])))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_of(docs: DataFrame) -> DataFrame:
    """Predictions for all rows, learned from the rows outside the held-out quarter."""
    model = fit(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return predict(docs, model)
