import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veilspark.llm import mixing, token_files
from veilspark.llm.common import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark, table, odd, sf_dir):
    rows = odd + [(-1, "minus"), (20, "don't <|endoftext|> stop. É ́a ΣΑΣ, x!!"), (21, "a" * 9000)]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    manifest = token_files.write_tokens(table(rows), shared_path(spark, "tokens"), PATH)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(spark, manifest).collect()), key=lambda r: r[0])
    tok, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_tokens(spark, table):
    manifest = token_files.write_tokens(table([]), shared_path(spark, "tokens"), PATH)
    assert manifest.count() == 0 and token_files.read_tokens(spark, manifest).count() == 0


def test_fair_in_every_prefix():
    """Against the exact weights, over many periods that know nothing of each other, near the start and far from it."""
    rng = random.Random(2)
    for trial in range(80):
        n = rng.randrange(1, 14)
        kinds = (lambda: rng.random() + 0.001, lambda: rng.choice([1, 1, 2, 3, 50]), lambda: 10 ** rng.uniform(-3, 1), lambda: rng.choice([0.45, 0.1, 0.05]))
        shares = mixing.whole_shares({f"s{i}": kinds[trial % 4]() for i in range(n)})
        total, period, first = sum(shares.values()), rng.choice([1, 2, 7, 50]), rng.choice([0, rng.randrange(10**6)])
        had = mixing.had_at(shares, first * period)
        for p in range(first, first + 30):
            for slot, (k, i, at) in enumerate(mixing.lay_out(shares, p * period, (p + 1) * period), p * period):
                assert at == slot and i == had[k]
                assert i * total // shares[k] <= slot < -(-(i + 1) * total // shares[k])  # released, and not overdue
                had[k] += 1
                assert all(abs(had[s] * total - shares[s] * (slot + 1)) < total for s in shares)


def test_weights_are_exact():
    assert mixing.whole_shares({"a": 0.5, "b": 1, "c": 0.25}) == {"a": 2, "b": 4, "c": 1}
    shares = mixing.whole_shares({"a": 0.1, "b": 0.7})
    assert shares["a"] / sum(shares.values()) == 0.1 / 0.8


def test_mix_places_all(spark):
    rows = [(i, None if i % 11 == 0 else f"src{min(i % 7, 3)}") for i in range(900)] + [(5, "src3"), (5, "src3"), (None, "src1")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, {"src0": 1, "src1": 1, "src2": 1, "src3": 2, None: 1}, block_docs=4, period=60).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "") for r in got)) == sorted((d is None, d or 0, s or "") for d, s in rows)
    assert len({r["mix_position"] for r in got}) == len(rows)
    # Before the first source runs out, the order holds each source to its weight within a block.
    order = sorted(got, key=lambda r: r["mix_slot"])
    full = min(max(r["mix_slot"] for r in got if r["source"] == s) for s in ("src0", "src1", "src2"))
    share = {s: len({r["mix_block"] for r in order if r["source"] == s and r["mix_slot"] <= full}) for s in ("src0", "src3")}
    assert abs(share["src3"] - 2 * share["src0"]) <= 3


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, mix_slot long")
    assert mixing.mix(df).count() == 0


def test_mix_over_periods_keeps_to_the_weights(spark):
    df = spark.createDataFrame([(i, "a" if i < 2400 else "b") for i in range(3200)], "doc_id long, source string")
    got = mixing.mix(df, {"a": 0.74, "b": 0.26}, block_docs=1, period=16).collect()
    assert len(got) == len({r["mix_slot"] for r in got}) == 3200
    a = sorted(r["mix_slot"] for r in got if r["source"] == "a")
    assert all(abs(i + 1 - 0.74 * (s + 1)) < 1 + 1e-9 for i, s in enumerate(a))


def test_mix_equals_slot_by_slot(spark):
    """One slot after another over all blocks: each block lies between its release and its deadline, and all of them are there."""
    n = {"a": 300, "b": 77, "c": 9}
    df = spark.createDataFrame([(i, k) for k, m in n.items() for i in range(m)], "doc_id long, source string")
    got = mixing.mix(df, block_docs=2, period=8).collect()
    shares = {k[1:]: v for k, v in mixing.whole_shares(mixing.tempered_weights({"s" + k: m for k, m in n.items()})).items()}
    total, free = sum(shares.values()), {}
    for k, m in n.items():
        for i in range(-(-m // 2)):
            free[k, i] = (i * total // shares[k], -(-(i + 1) * total // shares[k]))
    slots = {(r["source"], r["mix_block"]): r["mix_slot"] for r in got}
    assert slots.keys() == free.keys() and len(set(slots.values())) == len(slots)
    assert all(release <= slots[x] < due for x, (release, due) in free.items())
    assert all(r["mix_position"] // 2 == r["mix_slot"] for r in got)


def test_mix_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "a", i + 1, i + 2, i + 3, i + 4, i + 5, "x") for i in range(9)], "doc_id long, source string, _k long, _b long, _at long, row long, _slot long, mix_slot string")
    got = mixing.mix(df, block_docs=2)
    assert got.columns == [c for c in df.columns if c != "mix_slot"] + ["mix_block", "mix_slot", "mix_position"]
    assert sorted((r["doc_id"], r["_k"], r["_b"], r["_at"], r["row"], r["_slot"]) for r in got.collect()) == [(i, i + 1, i + 2, i + 3, i + 4, i + 5) for i in range(9)]
