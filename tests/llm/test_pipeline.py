import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from veilspark.llm import mixing, ngram_join
from veilspark.llm.common import kept


def test_stages_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(C.STAGES)
    assert list(stages) == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mix", "token_files"]

    one = kept(stages["quality_rules"](spark, docs, sf_dir), "t")
    ids = {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and ids <= seen.keys()
    long_enough = [i for i, q in labels.items() if q == 1 and len(seen[i].split()) >= 60]
    assert np.mean([i in ids for i in long_enough]) > 0.95

    two = kept(stages["ngram_jaccard_join"](spark, one, sf_dir), "t")
    want = {r["component_id"] for r in ngram_join.similar_components(one, 5, 80).collect()}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(want)

    three = kept(stages["benchmark_decontamination"](spark, two, sf_dir), "t")
    left = {r["doc_id"] for r in three.collect()}
    assert left == {i for i in want if not any(b in seen[i] for b in bench)}

    four = kept(stages["source_mix"](spark, three, sf_dir), "t")
    assert sorted(map(tuple, four.collect())) == sorted(map(tuple, three.collect()))

    five = stages["token_files"](spark, four, sf_dir).collect()
    place = {r["doc_id"]: r["mix_position"] for r in mixing.mix(three).collect()}
    tok, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    by_id = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in five}
    assert len(five) == len(left)
    for i in sorted(left, key=place.__getitem__):
        x = np.array([*tok.encode(seen[i], add_special_tokens=False).ids, 2], "<u4")
        assert by_id[i] == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        out = stage(spark, kept(docs, "t"), sf_dir)
        assert out.count() == 0, name


def test_rows_without_id_and_ids_of_several_texts(spark, sf_dir):
    words = [f"w{i}" for i in range(400)]
    text = lambda a, n=60: " ".join(words[a : a + n])
    rows = [(None, text(0)), (None, text(100)), (7, text(200)), (7, text(300)), (7, text(300)), (9, text(0)), (None, text(200)), (None, ""), (3, None), (4, "")]
    docs = kept(spark.createDataFrame([(i, t, None, None, None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key int"), "t")
    stages = dict(C.STAGES)
    two = stages["ngram_jaccard_join"](spark, docs, sf_dir)
    assert two.columns == C.DOCUMENTS
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(3, None), (4, ""), (7, text(200)), (7, text(300)), (9, text(0)), (None, ""), (None, text(100))]
    assert sorted(((r["doc_id"], r["text"]) for r in two.collect()), key=key) == want
    three = kept(stages["benchmark_decontamination"](spark, kept(two, "t"), sf_dir), "t")
    four = kept(stages["source_mix"](spark, three, sf_dir), "t")
    assert sorted(((r["doc_id"], r["text"]) for r in four.collect()), key=key) == want
    five = stages["token_files"](spark, four, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in five) == ["3", "4", "7", "7", "9", "None", "None"]
    one = stages["quality_rules"](spark, docs, sf_dir).collect()
    assert {(r["doc_id"], r["text"]) for r in one} <= set(rows) and all(r["text"] for r in one)
