"""Suffix dedup: removes every byte covered by a 100-byte string that starts earlier.

A common-prefix-aware distributed merge sort of sparse suffixes:

1. Anchors. In each 100-byte window the 32-byte string with the least hash (the leftmost of equals) is an anchor;
   equal windows have equal anchors at equal offsets, so suffixes at anchors, about one in 35 bytes, stand for all.
   Anchors' keys are counted across the data (`exchange.tally`); a suffix whose key occurs once repeats nowhere.
2. Runs. Each run of documents sorts its remaining suffixes (100 bytes to the right, then 68 to the left, reversed),
   settles equal ones on the spot, front-codes the rest and sends them to the bucket of their key: one entry for each
   distinct suffix and run, however many copies a run holds.
3. Merge. A bucket merges its front-coded runs with a loser tree over common-prefix lengths; bytes in a known common prefix
   are never compared again. Suffixes with one anchor string are neighbours; each is compared with the earlier ones of them
   to find the longest match around the anchor.
4. Keys that very many suffixes hold (`HOT`) are not brought together: their windows go out one by one, by a 128-bit
   cryptographic digest of the 100 bytes, each distinct window once for each run. Equal digests are equal windows.
5. The covered intervals go back to the runs, which cut the texts.

Behaviour: null texts are empty; texts under 100 bytes lose nothing, and no match crosses a row; rows with one doc_id are ordered
by text, and a null doc_id, as which -2^63 counts, comes before all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes
from .exchange import BLOCK, BUCKET_KEYS, RUN_BYTES, bucket_of, counted, key_blocks, look_up, mixed, pack, pack_sorted, run_of, spread, tally, unpack, unpack_sorted

LENGTH = 100
ANCHOR = 32
LEFT = LENGTH - ANCHOR
ROW = LENGTH + LEFT + 2
#: Bytes that are hashed at a time; positions in them take 20 bits.
PIECE = 1 << 19
#: Suffixes of one key beyond which its windows are dealt out one by one.
HOT = 2000
#: Rows of an anchor string beyond which windows are compared in a set, not pair by pair.
PAIRS = 12

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64) for b in (base, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each `width`-byte string of `data`, from prefix sums of a polynomial."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[width:] - sums[: len(sums) - width]) * down[: len(sums) - width]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of one piece, ascending, and their keys."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes(data, ANCHOR)
    low = np.uint64((1 << 20) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w = LENGTH - ANCHOR + 1
    pad = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(v)] = v
    grid = pad.reshape(-1, w)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(grid, axis=1).ravel()
    n = len(data) - LENGTH + 1
    at = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & low).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, mixed(h[at])


def text_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a whole text. Pieces overlap by 99 bytes, so that each window lies in one."""
    if len(data) <= PIECE:
        return anchors(data)
    parts = []
    for i in range(0, len(data) - LENGTH + 1, PIECE - LENGTH + 1):
        at, key = anchors(data[i : i + PIECE])
        parts.append((at + i, key))
    at, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    at, once = np.unique(at, return_index=True)
    return at, key[once]


def _anchor_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs, n = [], [], 0
        for b in batches:
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = text_anchors(np.frombuffer(t.encode(), np.uint8))[1] if t else ()
                if len(key):
                    keys.append(key)
                    runs.append(np.full(len(key), r, np.uint32))
                    n += len(key)
            if n > 3_000_000:
                yield from key_blocks(np.concatenate(keys), np.concatenate(runs), buckets)
                keys, runs, n = [], [], 0
        if n:
            yield from key_blocks(np.concatenate(keys), np.concatenate(runs), buckets)

    return run


SENT = "bucket long, kind long, run long, n long, a binary, b binary, c binary, d binary"


def _sent(rows: list[tuple]) -> pa.Table:
    names = ("bucket", "kind", "run", "n", "a", "b", "c", "d")
    kinds = (pa.int64(),) * 4 + (pa.binary(),) * 4
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(names, kinds, strict=True))})


def _ordered(rows: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids, texts and offsets among the rows of one id, in the order that decides which copy is earlier."""
    ids = rows.column("doc_id").to_pylist()
    texts = [(t or "").encode() for t in rows.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    base, last, out = 0, object(), []
    for i in order:
        base = base if ids[i] == last else 0
        out.append(base)
        base, last = base + len(texts[i]), ids[i]
    return np.array([np.iinfo(np.int64).min if ids[i] is None else ids[i] for i in order], np.int64), [texts[i] for i in order], np.array(out, np.int64)


def _context(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each position: 100 bytes from it, 68 before it reversed, and how many of either there are."""
    out = np.zeros((len(at), ROW), np.uint8)
    right = at[:, None] + np.arange(LENGTH)
    ok = right < len(data)
    out[:, :LENGTH] = np.where(ok, data[np.minimum(right, len(data) - 1)], 0)
    left = at[:, None] - 1 - np.arange(LEFT)
    out[:, LENGTH : LENGTH + LEFT] = np.where(left >= 0, data[np.maximum(left, 0)], 0)
    out[:, -2], out[:, -1] = ok.sum(1), (left >= 0).sum(1)
    return out


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one above."""
    out = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 20_000):
        j = min(i + 20_000, len(rows))
        differs = rows[i:j] != rows[i - 1 : j - 1]
        out[i:j] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return out


def front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    lcp = common_prefixes(rows)
    tails = rows[np.arange(rows.shape[1]) >= lcp[:, None]]
    return pack(lcp.astype(np.uint8)), pa.compress(tails.tobytes(), codec="zstd", asbytes=True)


def front_decoded(lcp: bytes, tails: bytes, n: int) -> tuple[list[bytes], list[int]]:
    lengths = unpack(lcp, n, "u1").tolist()
    raw = pa.decompress(tails, decompressed_size=sum(ROW - x for x in lengths), codec="zstd", asbytes=True)
    keys, last, at = [], b"", 0
    for x in lengths:
        last = last[:x] + raw[at : at + ROW - x]
        at += ROW - x
        keys.append(last)
    return keys, lengths


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs of (keys, common prefix with the key before): (run, index, common prefix with the last output).

    A loser tree over common-prefix lengths: of two keys the one that shares more with the last output is smaller; only
    where both share as much are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    keys = [r[0] for r in runs] + [[]] * (k - len(runs))
    at = [0] * k
    loser, shared = [0] * k, [0] * k

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """Winner, its length, loser, its length."""
        if ha != hb:
            return (a, ha, b, hb) if ha > hb else (b, hb, a, ha)
        if ha < 0:
            return a, ha, b, hb
        x, y = keys[a][at[a]], keys[b][at[b]]
        if x == y:
            return (a, ha, b, ROW) if a < b else (b, hb, a, ROW)
        p, q = x[ha:], y[ha:]
        h = ROW - ((int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length() + 7) // 8
        return (a, ha, b, h) if p < q else (b, hb, a, h)

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            s = node - k
            return s, (0 if keys[s] else -1)
        a, ha = build(2 * node)
        b, hb = build(2 * node + 1)
        w, hw, lo, hl = play(a, ha, b, hb)
        loser[node], shared[node] = lo, hl
        return w, hw

    w, h = build(1)
    while h >= 0:
        yield w, at[w], h
        at[w] += 1
        h = runs[w][1][at[w]] if at[w] < len(keys[w]) else -1
        node = (w + k) >> 1
        while node:
            lo, hl = loser[node], shared[node]
            if h > hl:
                pass
            elif h < hl:
                loser[node], shared[node] = w, h
                w, h = lo, hl
            elif h >= 0:
                w2, h2, loser[node], shared[node] = play(w, h, lo, hl)
                w, h = w2, h2
            node >>= 1


class Covered:
    """Covered intervals of one run: start and end, in the numbering of `_ordered`, by id."""

    def __init__(self):
        self.ids, self.starts, self.ends = [], [], []

    def add(self, doc: int, start: int, end: int) -> None:
        self.ids.append(doc)
        self.starts.append(start)
        self.ends.append(end)

    def add_all(self, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.ids.extend(docs.tolist())
        self.starts.extend(starts.tolist())
        self.ends.extend(ends.tolist())

    def row(self, bucket: int, run: int) -> tuple:
        ids, starts, ends = joined(np.array(self.ids, "<i8"), np.array(self.starts, "<i8"), np.array(self.ends, "<i8"))
        return (bucket, 2, run, len(ids), pack(ids), pack(starts), pack((ends - starts)), b"")


def joined(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each id that touch or overlap, as one."""
    if not len(ids):
        return ids, starts, ends
    order = np.lexsort((starts, ids))
    ids, starts, ends = ids[order], starts[order], ends[order]
    out_i, out_s, out_e = [], [], []
    for i, s, e in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if out_i and out_i[-1] == i and s <= out_e[-1]:
            if e > out_e[-1]:
                out_e[-1] = e
        else:
            out_i.append(i)
            out_s.append(s)
            out_e.append(e)
    return np.array(out_i, "<i8"), np.array(out_s, "<i8"), np.array(out_e, "<i8")


def window_digests(text: bytes) -> np.ndarray:
    """A 128-bit digest of each 100-byte window, as two numbers."""
    n = len(text) - LENGTH + 1
    return np.frombuffer(b"".join(hashlib.blake2b(text[i : i + LENGTH], digest_size=16).digest() for i in range(n)), "<u8").reshape(n, 2)


def _sort_run(buckets: int, hot: int):
    def run(key: tuple, docs: pa.Table, repeated: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _sent([])
        me = key[0].as_py()
        known, totals = counted(repeated)
        ids, texts, bases = _ordered(docs)
        rows, keys, at_doc, at_pos, heat = [], [], [], [], []
        wide_hash, wide_doc, wide_pos = [], [], []
        covered = Covered()
        for doc, text, base in zip(ids.tolist(), texts, bases.tolist(), strict=True):
            data = np.frombuffer(text, np.uint8)
            at, own = text_anchors(data)
            if not len(at):
                continue
            n = look_up(own, known, totals)
            held = n >= 2
            if not held.any():
                continue
            at, own, n = at[held], own[held], n[held]
            for i in range(0, len(at), 50_000):
                rows.append(_context(data, at[i : i + 50_000]))
            keys.append(own)
            at_doc.append(np.full(len(at), doc, np.int64))
            at_pos.append(at + base)
            heat.append(n > hot)
        if not rows:
            return _sent([])
        rows, keys, at_doc, at_pos, heat = (np.concatenate(x) for x in (rows, keys, at_doc, at_pos, heat))
        raw, width = rows.tobytes(), ROW
        suffixes = [raw[i : i + width] for i in range(0, len(raw), width)]
        order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
        del suffixes, raw
        rows, keys, at_doc, at_pos, heat = rows[order], keys[order], at_doc[order], at_pos[order], heat[order]
        same = common_prefixes(rows) == ROW
        right, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
        whole = same & (right + left >= LENGTH)
        covered.add_all(at_doc[whole], (at_pos - left)[whole], (at_pos + right)[whole])
        # The sort is stable and suffixes came in order, so the first of equals is the earliest.
        rows, keys, at_doc, at_pos, heat = rows[~same], keys[~same], at_doc[~same], at_pos[~same], heat[~same]
        out = []
        for i in np.flatnonzero(heat).tolist():
            r, n_left, n_right = rows[i], int(rows[i, -1]), int(rows[i, -2])
            text = np.concatenate([r[LENGTH : LENGTH + n_left][::-1], r[:n_right]])
            if len(text) >= LENGTH:
                h = window_digests(text.tobytes())
                wide_hash.append(h)
                wide_doc.append(np.full(len(h), at_doc[i], np.int64))
                wide_pos.append(at_pos[i] - n_left + np.arange(len(h)))
        if wide_hash:
            h, d, p = (np.concatenate(x) for x in (wide_hash, wide_doc, wide_pos))
            o = np.lexsort((p, d, h[:, 1], h[:, 0]))
            h, d, p = h[o], d[o], p[o]
            again = np.r_[False, (h[1:] == h[:-1]).all(1)]
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
            later = again & ((d != d[first]) | (p != p[first]))
            covered.add_all(d[later], p[later], p[later] + LENGTH)
            h, d, p = h[~again], d[~again], p[~again]
            b = bucket_of(h[:, 0] >> np.uint64(16), buckets)
            for v in np.unique(b).tolist():
                m = b == v
                out.append((buckets + v, 1, me, int(m.sum()), pack_sorted(h[m, 0]), pack(d[m]), pack(p[m]), h[m, 1].tobytes()))
        cold = ~heat
        rows, keys, at_doc, at_pos = rows[cold], keys[cold], at_doc[cold], at_pos[cold]
        b = bucket_of(keys, buckets)
        for v in np.unique(b).tolist():
            m = b == v
            lcp, tails = front_coded(rows[m])
            out.append((v, 0, me, int(m.sum()), lcp, tails, pack(at_doc[m]), pack(at_pos[m])))
        out.append(covered.row(-1 - me, me))
        return _sent(out)

    return run


def _prefix(a: bytes, b: bytes, most: int) -> int:
    if a[:most] == b[:most]:
        return most
    x = int.from_bytes(a[:most], "big") ^ int.from_bytes(b[:most], "big")
    return most - (x.bit_length() + 7) // 8


def _settle(group: list[tuple[int, int, int, bytes]], covered: dict[int, Covered]) -> None:
    """Suffixes (doc, pos, run, row) with one anchor string: cover what an earlier one of them holds too."""
    group.sort(key=lambda x: (x[0], x[1]))
    earlier: list[tuple[int, bytes]] = []
    seen: set[bytes] = set()
    for doc, pos, run, row in group:
        right, left = row[-2], row[-1]
        if right + left < LENGTH:
            continue
        if row in seen:
            covered[run].add(doc, pos - left, pos + right)
            continue
        seen.add(row)
        earlier.append((doc, pos, run, row))
    if len(earlier) <= PAIRS:
        for i, (doc, pos, run, row) in enumerate(earlier):
            right, left = row[-2], row[-1]
            for _, _, _, other in earlier[:i]:
                r = _prefix(row, other, min(right, other[-2]))
                l = _prefix(row[LENGTH:], other[LENGTH:], min(left, other[-1]))  # noqa: E741
                if l + r >= LENGTH:
                    covered[run].add(doc, pos - l, pos + r)
        return
    texts = [(doc, pos, run, row[LENGTH : LENGTH + row[-1]][::-1] + row[: row[-2]], row[-1]) for doc, pos, run, row in earlier]
    for back in range(LEFT + 1):
        windows: set[bytes] = set()
        for doc, pos, run, text, left in texts:
            at = left - back
            if at < 0 or at + LENGTH > len(text):
                continue
            w = text[at : at + LENGTH]
            if w in windows:
                covered[run].add(doc, pos - back, pos - back + LENGTH)
            else:
                windows.add(w)


def _merge_bucket(key: tuple, rows: pa.Table) -> pa.Table:
    bucket, got = key[0].as_py(), rows.to_pylist()
    if bucket < 0:
        return rows
    covered: dict[int, Covered] = defaultdict(Covered)
    if got[0]["kind"] == 1:
        h = np.concatenate([unpack_sorted(r["a"], r["n"]) for r in got])
        low = np.concatenate([np.frombuffer(r["d"], "<u8") for r in got])
        d = np.concatenate([unpack(r["b"], r["n"], "<i8") for r in got])
        p = np.concatenate([unpack(r["c"], r["n"], "<i8") for r in got])
        run = np.concatenate([np.full(r["n"], r["run"], np.int64) for r in got])
        o = np.lexsort((p, d, low, h))
        h, low, d, p, run = h[o], low[o], d[o], p[o], run[o]
        later = np.r_[False, (h[1:] == h[:-1]) & (low[1:] == low[:-1])]
        for v in np.unique(run[later]).tolist():
            m = later & (run == v)
            covered[v].add_all(d[m], p[m], p[m] + LENGTH)
    else:
        runs = [front_decoded(r["a"], r["b"], r["n"]) for r in got]
        docs = [unpack(r["c"], r["n"], "<i8").tolist() for r in got]
        places = [unpack(r["d"], r["n"], "<i8").tolist() for r in got]
        numbers = [r["run"] for r in got]
        group: list[tuple[int, int, int, bytes]] = []
        for s, i, shared in merged(runs):
            if shared < ANCHOR:
                if len(group) > 1:
                    _settle(group, covered)
                group = []
            group.append((docs[s][i], places[s][i], numbers[s], runs[s][0][i]))
        if len(group) > 1:
            _settle(group, covered)
    return _sent([c.row(-1 - run, run) for run, c in covered.items()])


def _cut(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    ids, texts, bases = _ordered(docs) if docs.num_rows else (np.zeros(0, np.int64), [], np.zeros(0, np.int64))
    got = found.to_pylist()
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if got:
        i, s, e = ([unpack(r[k], r["n"], "<i8") for r in got] for k in "abc")
        i, s, n = np.concatenate(i), np.concatenate(s), np.concatenate(e)
        for doc, start, end in zip(*(x.tolist() for x in joined(i, s, s + n)), strict=True):
            spans[doc].append((start, end))
    removed, runs, digests = [], [], []
    for doc, text, base in zip(ids.tolist(), texts, bases.tolist(), strict=True):
        h, at, gone, count = hashlib.sha256(), 0, 0, 0
        for start, end in spans.get(doc, ()):
            start, end = max(start - base, 0), min(end - base, len(text))
            if start < end:
                h.update(text[at:start])
                at, gone, count = end, gone + end - start, count + 1
        h.update(text[at:])
        removed.append(gone)
        runs.append(count)
        digests.append(h.hexdigest())
    none = np.iinfo(np.int64).min
    return pa.table(
        {
            "doc_id": pa.array([None if x == none else x for x in ids.tolist()], pa.int64()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(runs, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
    )


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs` (doc_id, text)."""
    small_batches(docs.sparkSession)
    size = text_bytes(docs)
    runs = spread(size, RUN_BYTES)
    buckets = spread(size, 30 * BUCKET_KEYS // 4)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("run", run_of(runs))
    blocks = placed.select("run", "text").mapInArrow(_anchor_blocks(buckets), BLOCK)
    repeated = tally(blocks)
    by_run = placed.groupBy("run")
    sent = by_run.cogroup(repeated.groupBy("run")).applyInArrow(_sort_run(buckets, hot), SENT)
    settled = sent.groupBy("bucket").applyInArrow(_merge_bucket, SENT)
    return by_run.cogroup(settled.groupBy("run")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
