import pytest
from pyspark.sql import functions as F

from veilspark import __main__ as cli
from veilspark.functions.values import shifted_date
from veilspark.operators import consistency, labelling, rewrite
from veilspark.operators.decode import restored
from veilspark.plans.deidentify import Engine
from veilspark.sources import files

TEXT = "王小明先生於民國78年5月12日來電 0912-345-678，信箱 chen.yuting@gmail.com，又寄 chen.yuting@gmail.com。"


@pytest.fixture(scope="module")
def engine():
    return Engine()


def test_codes_and_restores(spark, engine):
    docs = spark.createDataFrame([(1, TEXT), (2, "無個資"), (3, "")], "doc_id int, text string")
    out, table = engine.coded(docs)
    rows = {r["doc_id"]: r for r in out.withColumn("back", restored(F.col("rewritten"), F.col("log"))).collect()}
    assert all(rows[i]["back"] == t for i, t in ((1, TEXT), (2, "無個資"), (3, "")))
    coded = rows[1]["rewritten"]
    assert coded.count("〔Email1〕") == 2 and "gmail" not in coded and "0912" not in coded and "12日" not in coded
    replies = spark.createDataFrame([(1, 9, "請寄〔Email1〕與[電話 1]。")], "doc_id int, reply_id int, text string")
    assert rewrite.restored_by_mapping(replies, table, ["doc_id"]).first()["restored"] == "請寄chen.yuting@gmail.com與0912-345-678。"


CASE = [
    (1, 1, "王小明住臺北市內湖區瑞光路99號7樓，任職澄嶼顧問股份有限公司，電話0912-345-678，生日民國78年5月12日。"),
    (2, 1, "澄嶼顧問股份有限公司通知王小明到場，0912345678 無人接聽。"),
    (3, 2, "另案電話 0912-345-678。"),
]


def test_a_case_is_consistent(spark, engine):
    docs = spark.createDataFrame(CASE, "doc_id int, case_id int, text string")
    out = {r["doc_id"]: r for r in engine.pseudonymized(docs, "case_id", "x").collect()}
    for value in ("王小明", "瑞光路", "澄嶼", "0912-345-678", "0912345678", "5月12日"):
        assert all(value not in r["rewritten"] for r in out.values()), value
    assert "臺北市內湖區" in out[1]["rewritten"] and "7樓" in out[1]["rewritten"] and "顧問股份有限公司" in out[2]["rewritten"]
    fake = {x["original"]: out[1]["rewritten"][x["start"] : x["end"]] for x in out[1]["log"]}
    again = {x["original"]: out[2]["rewritten"][x["start"] : x["end"]] for x in out[2]["log"]}
    # Each value that both documents hold has one stand-in, however much of the text around it was chosen with it.
    shared = fake.keys() & again.keys()
    assert shared and all(fake[v] == again[v] for v in shared)
    coded = {r["doc_id"]: r["rewritten"] for r in engine.coded(docs, "case_id")[0].collect()}
    assert "王小明" not in coded[1] + coded[2] and "〔電話1〕" in coded[1] and "臺北市〔地址1〕" in coded[1] and "民國78年" in coded[1] and "5月" not in coded[1]
    assert set(engine.anonymized(docs, "case_id").columns) == {"doc_id", "text"}


def test_one_long_document(spark, engine):
    """100,000 characters in pieces: what is found does not depend on where a piece ends."""
    one = CASE[0][2]
    text = (one + "其餘文字並無個資，僅供填充之用。" * 3) * 900
    assert len(text) > 80_000
    found = engine.candidates(spark.createDataFrame([(1, text)], "doc_id int, text string").repartition(1))
    emails = found.where("kind = 'num' and value = '0912-345-678'").count()
    assert emails == text.count("0912-345-678")


def test_shift_keeps_notation(spark):
    values = ["民國78年05月28日", "1989/12/30", "七十八年五月三十一日", "May 31, 1989", "31 May 1989", "2月28日", "13月45日", "x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r["o"] for r in df.select("i", shifted_date(F.col("v"), F.lit(7)).alias("o")).orderBy("i").collect()]
    assert got == ["民國78年06月4日", "1990/1/6", "七八年六月七日", "June 7, 1989", "7 June 1989", "3月6日", None, None]


def test_counties_and_free_codes(spark):
    places = spark.createDataFrame([("彰化縣", "彰化市"), ("臺北市", "中山區"), ("基隆市", "中山區")], "city string, district string")
    got = {r["address"]: r["city"] for r in labelling.counties(spark.createDataFrame([("彰化市中正路1號",), ("中山區x",), ("無",)], "address string"), places).collect()}
    assert got == {"彰化市中正路1號": "彰化縣", "中山區x": None, "無": None}
    pool = ["甲", "乙", "丙"]
    wanted = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "case_id int, rank int")
    used = spark.createDataFrame([(1, "甲")], "case_id int, code string")
    assert sorted((r["case_id"], r["rank"], r["code"]) for r in labelling.free_codes(wanted, used, pool, ["case_id"]).collect()) == [(1, 1, "乙"), (1, 2, "丙"), (2, 1, "甲")]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(TEXT, encoding="utf-8")
    source = str(tmp_path / "in/a.txt")
    cli.main([source, str(tmp_path / "out"), "--codes", "--map", str(tmp_path / "map")])
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert "〔Email1〕" in row["text"] and "gmail" not in row["text"]
    (tmp_path / "in/b.txt").write_text(row["text"], encoding="utf-8")
    cli.main([str(tmp_path / "in/b.txt"), str(tmp_path / "back"), "--restore", str(tmp_path / "map")])
    back = spark.read.parquet(str(tmp_path / "back")).first()["text"]
    assert "chen.yuting@gmail.com" in back and "0912-345-678" in back
    with pytest.raises(ValueError):
        files.read_mapping(spark, str(tmp_path / "map"), code=False)
    for bad in (["--anonymize", "--map", "x"], ["--anonymize", "--codes"], ["--restore", "m", "--codes"]):
        with pytest.raises(SystemExit):
            cli.parsed([source, "o", *bad])


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffcity,road\n臺北市,瑞光路\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv")).select("city", "road").collect()] == [("臺北市", "瑞光路")]
    (tmp_path / "d.txt").write_text("公司 900 n\n的 5000 u\n罕見 3 n\n一二三四五 900 n\n", encoding="utf-8")
    assert [r["word"] for r in files.read_dictionary(spark, str(tmp_path / "d.txt")).collect()] == ["公司"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n', encoding="utf-8")
    got = files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert sorted(((r["a"], r["bad"]) for r in got), key=str) == [(1, None), (None, "not json")]


def test_settled_and_grown(spark):
    rows = [(1, 1, 0, 3, "PERSON", "full", "王小明"), (2, 1, 0, 3, "PERSON_KEEP", "full", "王小明"), (3, 1, 0, 3, "PERSON_KEEP", "full", "陳大文"), (1, 1, 9, 18, "DATE", "date", "民國78年5月12日"), (2, 1, 9, 16, "NUMBER", "num", "0780512"), (2, 2, 9, 16, "NUMBER", "num", "0780512")]
    spans = spark.createDataFrame(rows, "doc_id int, case_id int, start int, end int, type string, kind string, value string")
    got = sorted((r["doc_id"], r["case_id"], r["start"], r["type"]) for r in consistency.settled(spans, ["case_id"]).collect())
    assert got == [(1, 1, 0, "PERSON"), (1, 1, 9, "DATE"), (2, 1, 0, "PERSON"), (2, 1, 9, "DATE"), (2, 2, 9, "NUMBER")]
    docs = spark.createDataFrame([(1, "歐陽修文到，歐陽修來")], "doc_id int, text string")
    some = spark.createDataFrame([(1, 0, 3, "PERSON", "full", "歐陽修"), (1, 6, 8, "PERSON", "full", "歐陽"), (1, 20, 23, "PERSON", "full", "歐陽修文")], "doc_id int, start int, end int, type string, kind string, value string")
    got = {r["start"]: r["value"] for r in consistency.reconciled(docs, some).collect()}
    assert got == {0: "歐陽修文", 6: "歐陽修", 20: "歐陽修文"}


def test_propagation_reaches_other_documents(spark):
    docs = spark.createDataFrame([(1, 1, "王小明到 A123456789"), (2, 1, "王 小明與王小明明，A123456789、BA1234567890"), (3, 2, "王小明")], "doc_id int, case_id int, text string")
    spans = spark.createDataFrame([(1, 1, 0, 3, "PERSON", "full", "王小明"), (1, 1, 5, 15, "CODE", "alnum", "A123456789")], "doc_id int, case_id int, start int, end int, type string, kind string, value string")
    got = sorted((r["doc_id"], r["start"], r["value"]) for r in consistency.propagated(docs, spans, ["case_id"]).collect())
    assert got == [(1, 0, "王小明"), (1, 5, "A123456789"), (2, 0, "王 小明"), (2, 5, "王小明"), (2, 10, "A123456789")]


def test_common_words(spark):
    words = spark.createDataFrame([("黃金", 900, "n"), ("黃大文", 900, "nr"), ("黃", 900, "n"), ("公司", 900, "n"), ("黃昏", 3, "n")], "word string, freq long, pos string")
    assert [r["word"] for r in consistency.common_words(words, ["黃"]).collect()] == ["黃金"]
