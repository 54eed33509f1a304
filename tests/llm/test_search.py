import math
import random
import re

from veilspark.llm import lexical_search
from veilspark.llm.lexical_search import ranked

LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, ts in wanted.items():
        scores = []
        for d, t in held:
            m = 100 - 50 + 50 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in ts if x in df)
            if s > 0 and any(x in t for x in ts):
                scores.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "b2", "Über", "über", "漢字", "x-ray", "CAT", "cat", "cat's", "don’t", "1,000", "é", "\x7f", "tab\tbed", "the"]
    text = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", "!", "\n"]) for _ in range(rng.randrange(k)))
    return [(i, text(40)) for i in range(n)], [(i, text(8)) for i in range(12)]


def test_equals_brute_force(spark, table, odd, monkeypatch):
    for seed, top in ((1, 50), (2, 3)):
        docs, items = corpus(seed)
        docs += [(1000 + i if i is not None else None, t) for i, t in odd] + [(5, docs[5][1])] * 4
        items += [(50, None), (51, ""), (None, "cat"), (None, "the b2"), (3, "the cat"), (52, "the word alone"), (53, "missing")]
        shape = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, score int")
        got = lambda: sorted((tuple(r) for r in ranked(table(docs).repartition(5), shape, top).collect()), key=str)
        assert got() == brute(docs, items, top)
        # Small slices, small batches of scores and early ranking change nothing.
        monkeypatch.setattr(lexical_search, "TERM_BYTES", 40)
        monkeypatch.setattr(lexical_search, "CELLS", 64)
        monkeypatch.setattr(lexical_search, "MERGED", 2)
        assert got() == brute(docs, items, top)
        monkeypatch.undo()


def test_empty(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert ranked(table([(1, "cat")]), none).count() == 0
    assert ranked(table([]), some).count() == 0
    assert ranked(table([(1, None), (2, " ,")]), some).count() == 0
