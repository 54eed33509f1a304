import hashlib
import random
import re

from veilspark.llm import fill_middle
from veilspark.llm.fill_middle import digests, restored

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    hexed = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    chars = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc, n, form, *chars, sha(out), sha(text)), out


def rows_of(n):
    rng = random.Random(3)
    pieces = ["word", "Ünï", "漢字", " ", "\n", "\t\x0b", "<P", "<", ">", "P>", "<S>", "\x1f", " ", "\U0001f600"]
    return [(i, "".join(rng.choice(pieces if rng.random() < 0.1 else pieces[:8] + ["x y "]) for _ in range(rng.randrange(60)))) for i in range(100, 100 + n)]


def test_equals_brute_force(spark, table, odd, monkeypatch):
    rows = odd + rows_of(300)
    key = lambda r: tuple(str(x) for x in r)
    for chunk in (fill_middle.CHUNK, 5):
        monkeypatch.setattr(fill_middle, "CHUNK", chunk)
        got = digests(table(rows).repartition(3)).collect()
        assert sorted((tuple(r) for r in got), key=key) == sorted((brute(d, t)[0] for d, t in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_outputs_and_whole_restoring(spark, table, odd):
    rows = odd + rows_of(100)
    got = fill_middle.fill_in_middle(table(rows)).collect()
    assert sorted((str(r["doc_id"]), r["output"]) for r in got) == sorted((str(d), brute(d, t)[1]) for d, t in rows)
    texts = {(str(d), t or "") for d, t in rows}
    assert all((str(r["doc_id"]), restored(r["output"], r["form"])) in texts for r in got)


def test_all_forms_by_rate(spark, table):
    rows = [(i, f"a{i} b c d") for i in range(40)]
    assert {r["form"] for r in digests(table(rows), rate=100, suffix_first=0).collect()} == {"psm"}
    assert {r["form"] for r in digests(table(rows), rate=0).collect()} == {"plain"}


def test_empty(spark, table):
    assert digests(table([])).count() == 0


def test_one_shuffle(spark, table, monkeypatch):
    monkeypatch.setattr(fill_middle, "PART_BYTES", 1)
    plan = digests(table([(1, "a b"), (2, "c d")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(part") == 1
