"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back through memory maps.

Layout of a data set, a folder: for each part `<name>.bin` (ids, little-endian uint16 or uint32 by vocabulary size),
`<name>.off` (int64 offsets into the part, one more than documents), `<name>.doc` (int64 document ids) and `<name>.nul` (int64
places of the documents without an id; empty but for these), and `parts.parquet` with name, docs, tokens and base of each part in order. `base` is the prefix sum of the tokens of the parts
before it, so the global start of a document is base + offset.

Behaviour: null texts are empty and hold the end id only; repeated ids stay repeated, in text order; an empty table
gives no parts; a null id comes first and is read back as null; extra columns are ignored. A task writes under a name of its own
attempt and the manifest names the files of the attempts that succeeded, so lost executors and repeated tasks leave at most
files that nothing reads.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

END_ID = 2
#: Text bytes of one part.
PART_BYTES = 16 << 20
#: Beyond so many parts they grow instead, as one row for each comes to the driver.
MOST_PARTS = 200_000
#: Words whose ids a worker keeps in each of two generations.
CACHE_WORDS = 550_000


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary uses for each byte: printable Latin-1 stands for itself."""
    out, odd = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out.append(chr(b))
        else:
            out.append(chr(odd))
            odd += 1
    return out


class WordEncoder:
    """Ids of a text, word by word.

    The tokenizer drops white space and never joins across it, so ids of a text are the ids of its words in a row; ids
    of words are kept. Words are cut at space and newline only. A word of composed Latin letters with common marks behind it
    is what the tokenizer's own cutting makes two pieces of, lower-cased; those go to its model at once. All other words
    go through the whole tokenizer.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces = {}
            plain = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
            found = self.pieces[text] = self._bytes([t.id for t in self.model.tokenize(plain)])
        return found

    def _word(self, word: str) -> bytes:
        m = self.PLAIN.fullmatch(word)
        if m is None:
            return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return self._piece(m[1].lower()) + (self._piece(m[2]) if m[2] else b"")

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        fresh = set().union(*split) - self.known.keys()
        if len(self.known) > CACHE_WORDS:
            # Words met since the last change of generations survive, the rest goes.
            self.known, self.older = {}, self.known
            fresh = set().union(*split)
        for w in fresh:
            ids = self.older.get(w)
            self.known[w] = self._word(w) if ids is None else ids
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that its words outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, by Hadoop's names of object stores too."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class PartWriter:
    """Files of one part, written as batches come; only offsets and document ids are held."""

    def __init__(self, folder: str, name: str):
        self.store, self.root = store_of(folder)
        self.name, self.lengths, self.docs, self.nulls = name, array("q"), array("q"), array("q")
        self.stream = self.store.open_output_stream(f"{self.root}/{name}.bin")

    def add(self, doc: int | None, ids: bytes, width: int) -> None:
        self.stream.write(ids)
        if doc is None:
            self.nulls.append(len(self.docs))
        self.lengths.append(len(ids) // width)
        self.docs.append(doc or 0)

    def close(self) -> None:
        self.stream.close()
        offsets = np.zeros(len(self.lengths) + 1, "<i8")
        np.cumsum(np.array(self.lengths, "<i8"), out=offsets[1:])
        for suffix, data in ((".off", offsets), (".doc", np.array(self.docs, "<i8")), (".nul", np.array(self.nulls, "<i8"))):
            with self.store.open_output_stream(f"{self.root}/{self.name}{suffix}") as f:
                f.write(data.tobytes())


def write_tokens(docs: DataFrame, to: str, tokenizer: str, order: list[Column] | None = None, end_id: int = END_ID) -> DataFrame:
    """Write `docs` (doc_id, text) in ascending order of `order` (doc_id, then text); return the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    keys = order or [F.col("doc_id"), F.col("text")]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(size // PART_BYTES + 1, MOST_PARTS)
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    by = [f"_k{i}" for i in range(len(keys))]
    plain = order is None
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([] if plain else named))
    by = ["doc_id", "text"] if plain else by
    # Bounds between parts hold the beginning of a text only, however long it is; rows are then sorted by the whole.
    ranges = [F.col("doc_id"), F.substring("text", 1, 64)] if plain else [F.col(by[0])]
    laid = rows.repartitionByRange(int(parts), *ranges).sortWithinPartitions(*by).select("doc_id", "text")
    store, root = store_of(to)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, words = TaskContext.get(), encoder(tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        part, out = context.partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                out = PartWriter(to, f"part-{part:06d}-{uuid.uuid4().hex}")
            for d, x in zip(b.column(0).to_pylist(), words.batch(b.column(1).to_pylist()), strict=True):
                out.add(d, x + end, len(end))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [out.name], "width": [len(end)], "docs": [len(out.docs)], "tokens": [sum(out.lengths)]})

    # One row for each part comes back; their number is the data's size over PART_BYTES.
    found = laid.mapInArrow(write, "part long, name string, width long, docs long, tokens long").collect()
    found.sort(key=lambda r: r["part"])
    bases = np.concatenate([[0], np.cumsum([r["tokens"] for r in found])]).tolist()
    manifest = spark.createDataFrame([(to, r["part"], r["name"], r["width"], r["docs"], r["tokens"], b) for r, b in zip(found, bases, strict=False)], "folder string, part long, name string, width long, docs long, tokens long, base long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{to}/parts.parquet")
    return spark.read.schema(manifest.schema).parquet(f"{to}/parts.parquet")


def open_part(folder: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets, document ids and places without an id of a part: memory maps on a file system, buffers elsewhere."""
    store, root = store_of(folder)
    kinds = ((".bin", "<u2" if width == 2 else "<u4"), (".off", "<i8"), (".doc", "<i8"), (".nul", "<i8"))
    if isinstance(store, fs.LocalFileSystem):
        paths = [(f"{root}/{name}{s}", t) for s, t in kinds]
        return tuple(np.memmap(p, dtype=t, mode="r") if os.path.getsize(p) else np.zeros(0, t) for p, t in paths)
    return tuple(np.frombuffer(store.open_input_stream(f"{root}/{name}{s}").read(), t) for s, t in kinds)


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, offsets, docs, nulls = open_part(r["folder"], r["name"], r["width"])
                known = np.ones(len(docs), bool)
                known[nulls] = False
                for at in range(0, len(docs), 10_000):
                    to = min(at + 10_000, len(docs))
                    crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(at, to)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs[at:to], pa.int64(), mask=~known[at:to]), "start": pa.array(offsets[at:to] + r["base"], pa.int64()), "n_tokens": pa.array(np.diff(offsets[at : to + 1]), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    n = manifest.count()
    spread = manifest.repartition(max(1, n), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
