import hashlib
import random

import numpy as np

from veilspark.llm import suffix_dedup as S


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return {k: sorted(v) for k, v in out.items()}


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    line = " ".join(word() for _ in range(18))
    shared = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        own = " ".join(word() for _ in range(rng.randrange(0, 80)))
        rows.append((i, rng.choice([own, own + " " + shared, shared + own, f"{own} {line} {word()} {word()} {line} {own[:50]}", shared[: rng.randrange(len(shared))] + own + shared[rng.randrange(len(shared)) :]])))
    return rows


def test_equals_brute_force(spark, table, odd):
    for seed in (1, 2):
        rows = texts(seed) + [(100 + i if i is not None else None, t[:3000] if t else t) for i, t in odd]
        assert result(S.dedup(table(rows))) == {k: sorted(v) for k, v in brute(rows).items()}


def test_hot_keys_go_out_by_window(spark, table):
    rows = texts(3)
    assert result(S.dedup(table(rows), hot=2)) == {k: sorted(v) for k, v in brute(rows).items()}


def test_empty(spark, table):
    assert S.dedup(table([])).count() == 0


def test_periodic_and_long_text(spark, table):
    rows = [(1, "ab" * 400), (2, "ab" * 300 + "c"), (3, "a" * 250)]
    assert result(S.dedup(table(rows))) == {k: sorted(v) for k, v in brute(rows).items()}
    rng = random.Random(9)
    long = "".join(rng.choice("abcd ") for _ in range(S.PIECE + 5000))
    data = np.frombuffer(long.encode(), np.uint8)
    at, key = S.text_anchors(data)
    again, same = S.text_anchors(np.frombuffer(long[1000:].encode(), np.uint8))
    inside = set((again + 1000).tolist()) ^ {int(a) for a in at if a >= 1000}
    assert len(at) == len(key) and all(abs(x - 1000) < 100 for x in inside) and len(same)


def test_loser_tree_merges_by_prefix():
    rng = random.Random(4)
    runs = []
    for _ in range(7):
        keys = sorted("".join(rng.choice("ab") for _ in range(S.ROW)).encode() for _ in range(rng.randrange(0, 40)))
        keys = sorted(k[:160] + b"a" * 10 for k in keys)
        m = np.array([list(k) for k in keys], np.uint8).reshape(-1, S.ROW)
        lcp, tails = S.front_coded(m)
        assert S.front_decoded(lcp, tails, len(keys))[0] == keys
        runs.append((keys, S.common_prefixes(m).tolist()))
    out = list(S.merged(runs))
    keys = [runs[r][0][i] for r, i, _ in out]
    assert keys == sorted(k for r in runs for k in r[0])
    for (a, b), (_, _, h) in zip(zip(keys, keys[1:], strict=False), out[1:], strict=True):
        assert h == next((i for i in range(S.ROW) if a[i] != b[i]), S.ROW)
