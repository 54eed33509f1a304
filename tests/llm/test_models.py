import math
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from veilspark.llm import language_id, lattice_lm, quality_classifier, quality_rules, queries
from veilspark.llm.text_stats import RATIOS, with_base, with_ratios

from .conftest import crc, words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LOWER = {c: c + 32 for c in range(65, 91)}


def base(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)]


def test_base_counts(spark, table, odd, sf_dir):
    rows = odd + [(50, "a b c a b c d\n\n#x\n#x\n \n#x y"), (51, "a a a a a"), (52, "a a a"), (53, "\x0b\x0ca\x0db")]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(([-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] for r in with_base(table(rows)).collect()))
    assert got == sorted([-1 if i is None else i, *base(t)] for i, t in rows)


def test_rules_learn_and_judge(spark, table, odd):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["and", "the", "of", "house", "tree"], 80)) + f" {i}" for i in range(80)]
    junk = [" ".join(x + "#%" for x in rng.choice(["and", "the", "of", "house", "tree"], 80)) + f" {i}" for i in range(60)]
    rows = [(i, " ".join(f"{w}{j}" for j, w in enumerate(t.split()))) for i, t in enumerate(good + junk)] + [(1000 + (i or 500), t) for i, t in odd]
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(140)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learned_rules(table(rows), labels)
    assert rules and all(r.conditions for r in rules)
    out = {r["doc_id"]: r for r in quality_rules.judge(table(rows), rules).collect()}
    assert all(out[i]["kept"] for i in range(80)) and not any(out[i]["kept"] for i in range(80, 140))
    assert out[1001]["base_failed"] and not out[1001]["kept"]
    assert quality_rules.judge(table(rows), rules).columns[:8] == table(rows).columns
    # The list as numpy rules on the same statistics; columns of the input keep their names and values.
    x = with_ratios(table(rows)).select("doc_id", *RATIOS).toPandas()
    held = [r.holds({k: x[k].to_numpy() for k in RATIOS}) for r in rules]
    first = [next((k for k, h in enumerate(held, 1) if h[i]), None) for i in range(len(x))]
    assert Counter(zip(x["doc_id"], first, strict=True)) == Counter((r["doc_id"], r["rule"]) for r in quality_rules.judge(table(rows), rules).collect())
    clash = table(rows).select("doc_id", "text", F.lit(5).alias("_c"), F.lit(6).alias("upper_rate"), F.lit(7).alias("n_distinct"), F.lit(8).alias("row"), F.lit("n").alias("n_words"))
    for some in (rules, []):
        got = quality_rules.judge(clash, some).collect()
        assert {(r["_c"], r["upper_rate"], r["n_distinct"], r["row"]) for r in got} == {(5, 6, 7, 8)} and {type(r["n_words"]) for r in got} == {int}
    assert quality_rules.quality_rules(table([]), labels).count() == 0
    assert quality_rules.learned_rules(table(rows), labels.where("quality = 1")) == []


def test_rules_learn_from_every_labelled_row(spark):
    # The bad rows are those that a sample of 20,000 by hash leaves out.
    bad = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) >= F.lit(int((1 << 20) * 0.92))
    docs = spark.range(22_000).withColumnRenamed("id", "doc_id").select("doc_id", F.concat(F.lit("a house and a tree "), "doc_id", F.when(bad, "#%#").otherwise("")).alias("text"), (~bad).cast("int").alias("quality"))
    rules = quality_rules.learned_rules(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert rules
    wrong = quality_rules.judge(docs, rules).where("rule is null and quality = 0 or rule is not null and quality = 1").count()
    assert wrong == 0


def test_bins_count_every_row(spark):
    rng = np.random.default_rng(2)
    values = [{"y": int(rng.random() < 0.5), **{k: float(round(rng.random() * 3, 3)) for k in RATIOS}} for _ in range(500)]
    for k, b in zip(RATIOS, quality_rules.counted(spark.createDataFrame(values)), strict=True):
        v, y = np.array([r[k] for r in values]), np.array([r["y"] for r in values])
        cuts, at = quality_rules._cuts(b)
        assert len(cuts) == 48 and b.bad.sum() + b.good.sum() == 500
        assert [((v <= t) & (y == 0)).sum() for t in cuts] == np.cumsum(b.bad)[at].tolist()
        assert [((v <= t) & (y == 1)).sum() for t in cuts] == np.cumsum(b.good)[at].tolist()


def test_classifier_ranks_held_out(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op9_quality_classifier(spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(got[i]["score"], q) for i, q in labels.items() if got[i]["held_out"]]
    assert all(r["held_out"] == (crc(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    one, zero = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    if one and zero:
        assert np.mean([a > b for a in one for b in zero]) > 0.9


def test_classifier_handles_odd_rows(spark, table, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.quality_scores(table(odd), none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = [(i, ("junk!! " if i % 2 == 0 else "fine words ") * (10 + i)) for i in range(60)] + [(100 + (i or 50), t) for i, t in odd]
    got = quality_classifier.quality_scores(table(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    assert quality_classifier.quality_scores(table([]), labels).count() == 0
    # The Catalyst expressions against the same discriminant in numpy.
    model = quality_classifier.fit(table(rows), labels)
    x = quality_classifier.transformed(with_ratios(table(rows))).select("doc_id", *RATIOS).toPandas()
    want = 1 / (1 + np.exp(-np.clip(model.slope * model.raw(x[RATIOS].to_numpy()) + model.offset, -30, 30)))
    a = sorted((-1 if math.isnan(i) else i, round(p, 9)) for i, p in zip(x["doc_id"], want, strict=True))
    assert a == sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 9)) for r in got)


def test_language_held_out(spark, sf_dir):
    got = queries.op4_language_id(spark, sf_dir).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.95 and all(r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in got)


def test_language_odd_rows(spark, table, odd):
    rows = [(100 + i, "the cat and the dog " * 3) for i in range(20)] + odd + [(60, "123 456")]
    got = language_id.language_of(table(rows)).collect()
    assert len(got) == len(rows)
    pred = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert {(1, "und"), (2, "und"), (3, "und"), (60, "und"), (4, "en")} <= pred
    assert {r["lang_pred"] for r in language_id.predict(table(odd), None).collect()} == {"und"}
    assert language_id.language_of(table([])).count() == 0


def test_grams_in_pieces(monkeypatch):
    text = "abcde fghij " * 50
    whole = language_id.counts(text)
    assert whole.sum() == 3 * len(text) + 3
    for size in (1, 2, 63, 64, 599, 600, 601, 602, 603):
        monkeypatch.setattr(language_id, "CHUNK", size)
        assert (language_id.counts(text) == whole).all(), size


def test_lattice_sums_all_segmentations():
    import sentencepiece

    n = sentencepiece.SentencePieceProcessor(model_file=PIECES).get_piece_size()
    pieces = lattice_lm.Pieces(PIECES, np.random.default_rng(0).integers(0, 1000, n), 10)

    def brute(text):
        if not text:
            return 1.0
        total = sum(10 ** pieces.logs[text[:k]] * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces.logs)
        if text[0] not in pieces.logs:
            total += 10 ** sum(pieces.bytes[b] for b in text[0].encode()) * brute(text[1:])
        return total

    for w in ("thing", "a", "zq", "漢x", "é\U0001f600", "unhappiness"):
        assert math.isclose(pieces.word(w), math.log10(brute("▁" + w)), rel_tol=1e-9)


def test_lm_base(spark, table, odd):
    rows = [(i, t) for i, t in odd if i is not None] + [(20 + i, f"The cat sat on mat {i % 3} ZEBRA{i}") for i in range(40)]
    got = lattice_lm.lattice_scores(table(rows), PIECES).collect()
    tokens = [(i, [*words((t or "").translate(LOWER)), None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if crc(i, 10) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, crc(i, 10) == 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, w in tokens)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    # The score: pieces counted in the training words, and the sum over all segmentations of each word, by brute force.
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    count, ends = Counter(), sum(crc(i, 10) != 0 for i, _ in tokens)
    for i, ws in tokens:
        if crc(i, 10):
            for w in ws[:-1]:
                count.update(sp.encode(w))
    size = sp.get_piece_size()
    total = sum(count.values()) + ends + 0.1 * (size + 1)
    p = {sp.id_to_piece(k): (count[k] + 0.1) / total for k in range(3, size)}

    def brute(text):
        if not text:
            return 1.0
        out = sum(p[text[:k]] * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in p)
        return out + (0 if text[0] in p else math.prod(p[f"<0x{b:02X}>"] for b in text[0].encode()) * brute(text[1:]))

    for i, t in tokens[10:20]:
        want = sum(math.log10(brute("▁" + w)) for w in t[:-1]) + math.log10((ends + 0.1) / total)
        assert math.isclose(next(r["score"] for r in got if r["doc_id"] == i), want, rel_tol=1e-5)
    assert lattice_lm.lattice_scores(table([]), PIECES).count() == 0


def test_stats_use_no_python(spark, table):
    plan = with_base(table([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and F is not None
