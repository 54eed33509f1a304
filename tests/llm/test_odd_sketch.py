import random

import numpy as np

from veilspark.llm import odd_sketch
from veilspark.llm.odd_sketch import BITS, banding, differing, multipliers, near_duplicates, odd_limit, samples_of

from .test_join import brute, near_copies


def test_equals_brute_force(spark, table, odd, monkeypatch):
    for seed, width, percent in ((1, 3, 85), (2, 5, 80), (3, 3, 60)):
        rows = near_copies(seed) + [(1000 + i, t) for i, t in odd if i is not None] + [(2, "x y z a b c d e f")]
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(table(rows), width, percent).collect())
        assert got == [(d, n, c, d == c) for d, n, c in brute(rows, width, percent)]
        monkeypatch.setattr(odd_sketch, "BUCKET_PIECE", 3)


def test_two_groups_in_one_bucket(spark, table):
    # Texts with a large common part whose own part keeps them just under the threshold, in pairs that link.
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(160))
    rows = []
    for g in range(30):
        own = [f"g{g}w{i}" for i in range(22)]
        for k in range(2):
            rows.append((len(rows), f"{common} {' '.join(own)} z{k}"))
    rng.shuffle(rows)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(table(rows), 3, 85).collect())
    assert got == brute(rows, 3, 85)
    assert len({c for _, _, c in got}) == 30


def test_empty_and_null_ids(spark, table):
    assert near_duplicates(table([])).count() == 0
    rows = [(0, ""), (None, ""), (None, None), (None, "a b c d e"), (None, "q r s t u v"), (7, "q r s t u v"), (8, "a b"), (None, "  ")]
    got = near_duplicates(table(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(0, 0, True), (7, 7, True), (8, 8, True)]
    assert sorted((str(r["component_id"]), r["kept"]) for r in got if r["doc_id"] is None) == [("7", False), *[("None", True)] * 4]


def test_samples_collide_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    by = multipliers(210)
    for share in (0.5, 0.85):
        hits = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64) * np.uint64(2)
            own = rng.integers(0, 1 << 63, (2, (400 - len(both)) // 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            hits.append(np.mean(samples_of(np.r_[both, own[0]], by) == samples_of(np.r_[both, own[1]], by)))
        assert abs(np.mean(hits) - share) < 0.02


def test_limit_is_passed_as_rarely_as_said():
    rng = np.random.default_rng(2)
    samples, miss = 210, 0.02
    limit = odd_limit(samples, 85, BITS, miss)
    beyond = 0
    for _ in range(4000):
        d = rng.binomial(samples, 0.15)
        beyond += int((np.bincount(rng.integers(0, BITS, 2 * d), minlength=BITS) & 1).sum()) > limit
    assert 0.005 < beyond / 4000 <= 0.03
    bands, rows = banding(85)
    assert (1 - 0.85**rows) ** bands < 1e-7 and bands <= odd_sketch.MOST_BANDS


def test_sketches_count_differing_samples():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = a.copy()
    b[:5] += np.uint64(1)
    words = lambda x: np.frombuffer(odd_sketch.odd_sketch(x).tobytes(), "<u8")[None, :]
    assert differing(words(a), words(a)) == 0
    assert 6 <= differing(words(a), words(b))[0] <= 10


def test_bitmaps_of_sets_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n in (1, 30, 500, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.r_[a[: n - n // 9], rng.integers(0, 1 << 63, n // 7, dtype=np.uint64)]
        words = lambda x: np.frombuffer(odd_sketch.parity(np.unique(x)).tobytes(), "<u8")[None, :]
        assert differing(words(a), words(b))[0] <= len(np.setxor1d(a, b))
