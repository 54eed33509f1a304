import random

from veilspark.llm import ngram_join
from veilspark.llm.components import components

from .conftest import words

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, width, percent):
    sets = []
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))
    shared = [word() for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(5, 150))]
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 15))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w += shared
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, table, odd):
    for seed, width, percent in ((1, 4, 85), (2, 5, 80), (3, 3, 60)):
        rows = near_copies(seed) + [(1000 + i, t) for i, t in odd if i is not None] + [(2, "x y z a b c d e f")]
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(table(rows), width, percent).collect())
        assert got == brute(rows, width, percent)


def test_long_lists_are_dealt_in_pieces(spark, table, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_PIECE", 3)
    rows = near_copies(7)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(table(rows), 4, 70).collect())
    assert got == brute(rows, 4, 70)


def test_empty_and_null_ids(spark, table):
    assert ngram_join.similar_components(table([])).count() == 0
    got = ngram_join.similar_components(table([(None, "a b c"), (None, "a b c"), (3, "z")])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in got if r["doc_id"] is not None) == [(False, 3)] and len(got) == 3
    # Rows without an id link by their texts alone, and an empty set links with nothing.
    rows = [(0, ""), (None, ""), (None, None), (None, "a b c d e"), (None, "q r s t u v"), (7, "q r s t u v"), (8, "a b"), (None, "  ")]
    got = ngram_join.similar_components(table(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(0, 0), (7, 7), (8, 8)]
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["7", "None", "None", "None", "None"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}
