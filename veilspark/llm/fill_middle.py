"""Fill-in-the-middle texts: prefix, suffix and middle of a document in another order, assembled by a secondary sort.

1. `pieces` cuts a document into units (a word with the white space before it) and emits pieces of whole units, each keyed by the
   document and its position in the output.
2. One exchange by document with a sort by position inside each partition brings a document's output together, piece by
   piece. A task streams the pieces into a digest; it never holds a document.
3. The same stream is cut at the markers, which with the form is all that restoring knows. The pieces get their position in the
   original, are sorted again inside the partition (no second exchange) and streamed into the digest of the restored text.

A document's key is a digest of its id and text, and the number of the task that read it. So pieces do not depend on the order of rows, a lost
task makes the same pieces again, and copies that a third of all rows may be are dealt out by the tasks that read them.

Behaviour: null texts are empty and plain with no units; an id that is null counts as no digits behind `42:`; rows equal in id and text give a row
each; a very long text is many pieces of about CHUNK bytes, but a unit is never cut; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes
from .ngram_join import _WHITE

MARKERS = (b"<P>", b"<S>", b"<M>")
SEED = 42
#: Of 100 documents so many are transformed, and of 100 of these so many are suffix-first.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes of a piece, and text bytes of a partition.
CHUNK = 32 << 10
PART_BYTES = 16 << 20
_MARK = re.compile(b"(<[PSM]>)")
#: Sections in the order of the original.
_RANK = {b"<P>": 0, b"<M>": 1, b"<S>": 2}
PIECES = "part int, key binary, pos long, data binary, doc_id long, n long, form string, prefix_chars long, middle_chars long"
STREAMED = "part int, key binary, pos long, data binary, doc_id long, n long, form string, prefix_chars long, middle_chars long, digest string, copies long"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte ends of the units of a text: each word with the white space before it, and white space at the end."""
    if not len(data):
        return np.zeros(0, np.int64)
    white = _WHITE[data]
    ends = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    return np.r_[ends, len(data)] if white[-1] else ends


def choice(doc_id: int | None, n: int, text: bytes, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, int]:
    """Form of a document of `n` units, and where its prefix and its middle end."""
    digest = hashlib.sha256(b"%d:%s" % (seed, b"" if doc_id is None else b"%d" % doc_id)).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= rate or any(m in text for m in MARKERS):
        return "plain", a, b
    return ("spm" if h4 % 100 < suffix_first else "psm"), a, b


def _chunks(data: bytes, ends: np.ndarray, first: int, last: int) -> Iterator[bytes]:
    """Units first to last (exclusive), whole, in pieces of about CHUNK bytes."""
    at = int(ends[first - 1]) if first else 0
    while first < last:
        to = max(first + 1, min(last, int(np.searchsorted(ends, at + CHUNK, "right"))))
        end = int(ends[to - 1])
        yield data[at:end]
        first, at = to, end


def laid_out(data: bytes, ends: np.ndarray, form: str, a: int, b: int) -> Iterator[bytes]:
    """The pieces of the output in order; a marker begins the first piece of its section."""
    sections = {b"<P>": (0, a), b"<M>": (a, b), b"<S>": (b, len(ends))}
    if form == "plain":
        yield from _chunks(data, ends, 0, len(ends))
        return
    for mark in (b"<S>", b"<P>", b"<M>") if form == "spm" else (b"<P>", b"<S>", b"<M>"):
        held = mark
        for x in _chunks(data, ends, *sections[mark]):
            yield held + x
            held = b""
        if held:
            yield held


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


_LONGS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_PIECES = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("pos", pa.int64()), ("data", pa.binary()), *_LONGS])
_STREAMED = pa.schema([*_PIECES, ("digest", pa.string()), ("copies", pa.int64())])
_DIGESTS = pa.schema([*_LONGS, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


class _Out:
    """Rows gathered into batches of bounded bytes."""

    def __init__(self, schema: pa.Schema, most: int = 4 << 20):
        self.schema, self.most, self.rows, self.size = schema, most, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 100
        if self.size >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _batch(self.rows, self.schema)
        self.rows, self.size = [], 0


def pieces(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The output pieces of every row of `docs` (doc_id, text), unsorted; the first piece of a document carries what is known of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), _Out(_PIECES)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                array = np.frombuffer(data, np.uint8)
                ends = unit_ends(array)
                form, p, q = choice(doc, len(ends), data, seed, rate, suffix_first)
                key = hashlib.blake2b(data, digest_size=16, key=str(doc).encode()).digest()
                starts = np.r_[0, ends]
                chars = (None, None) if form == "plain" else (_code_points(array[: starts[p]]), _code_points(array[starts[p] : starts[q]]))
                about = (doc, len(ends), form, *chars)
                for pos, x in enumerate(laid_out(data, ends, form, p, q)):
                    yield from out.add((part, key, pos, x, *(about if not pos else (None,) * 5)), len(x))
                if not data:
                    yield from out.add((part, key, 0, b"", *about), 0)
        yield from out.rest()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def assembled(docs: DataFrame, **options: int) -> DataFrame:
    """`pieces`, each document's in one partition and in order."""
    parts = text_bytes(docs) // PART_BYTES + 1
    return pieces(docs, **options).repartition(parts, "part", "key").sortWithinPartitions("part", "key", "pos")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, int, bytes, tuple]]:
    """(document, is it its first piece, position, data, rest of the row) of sorted pieces; of equal rows' pieces each, one after the other."""
    last = None
    for b in batches:
        for part, key, pos, data, *about in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield (part, key), (part, key) != last, pos, data, tuple(about)
            last = (part, key)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each output, and its pieces at their place in the original, by form and markers alone."""
    out = _Out(_STREAMED)
    doc, about, digest, copies, place, section, met = None, (), None, 0, -1, 0, 0

    def closed() -> tuple:
        return (*doc, -1, None, *about, digest.hexdigest(), copies)

    for at, fresh, pos, data, rest in _documents(batches):
        if fresh:
            if doc is not None:
                yield from out.add(closed(), 0)
            doc, about, digest, copies, place, section, met = at, rest, hashlib.sha256(), 0, -1, 0, 0
        copies += pos == 0
        if pos == place:
            continue
        place = pos
        digest.update(data)
        for x in [data] if about[2] == "plain" else _MARK.split(data):
            if x in _RANK and about[2] != "plain":
                section = _RANK[x]
            elif x:
                yield from out.add((*doc, section << 48 | met, x, *(None,) * 5, None, None), len(x))
                met += 1
    if doc is not None:
        yield from out.add(closed(), 0)
    yield from out.rest()


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(_DIGESTS)
    about, digest, doc = None, None, None

    def closed() -> Iterator[pa.RecordBatch]:
        *known, output, copies = about
        for _ in range(copies):
            yield from out.add((*known, output, digest.hexdigest()), 0)

    for at, fresh, _, data, rest in _documents(batches):
        if fresh:
            if doc is not None:
                yield from closed()
            doc, about, digest = at, rest, hashlib.sha256()
        else:
            digest.update(data)
    if doc is not None:
        yield from closed()
    yield from out.rest()


def digests(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text restored from it."""
    streamed = assembled(docs, **options).mapInArrow(_digested, STREAMED)
    return streamed.sortWithinPartitions("part", "key", "pos").mapInArrow(_restored, DIGESTS)


def fill_in_middle(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, form and the whole output text of every row of `docs`; a task holds one document at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        doc, about, held, copies, place = None, (), [], 0, -1

        def closed() -> Iterator[pa.RecordBatch]:
            text = b"".join(held).decode()
            for _ in range(copies):
                yield from out.add((about[0], about[2], text), len(text))

        for at, fresh, pos, data, rest in _documents(batches):
            if fresh:
                if doc is not None:
                    yield from closed()
                doc, about, held, copies, place = at, rest, [], 0, -1
            copies += pos == 0
            if pos != place:
                held.append(data)
            place = pos
        if doc is not None:
            yield from closed()
        yield from out.rest()

    return assembled(docs, **options).mapInArrow(joined, "doc_id long, form string, output string")


def restored(output: str, form: str) -> str:
    """The text behind an output."""
    if form == "plain":
        return output
    sections = re.split("(<[PSM]>)", output)
    text = dict(zip(sections[1::2], sections[2::2], strict=True))
    return text["<P>"] + text["<M>"] + text["<S>"]
