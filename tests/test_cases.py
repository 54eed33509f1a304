"""Cases over several runs, assignments without end, birthdays, shifts, and values found by automaton."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark import __main__ as cli
from veilspark.functions.values import day_number
from veilspark.operators import assign, birthdays, case_state, consistency, matcher, realistic, rewrite
from veilspark.plans.deidentify import Engine
from veilspark.sources import files

SPANS = "doc_id int, case_id int, start int, end int, type string, kind string, value string"
ONE = "王小明住臺北市內湖區瑞光路99號7樓，電話0912-345-678。澄嶼顧問股份有限公司到場。"


def test_matcher_equals_patterns():
    """Against the alternation of literal values, the longest first, with blanks between characters."""
    rng = random.Random(1)
    for _ in range(300):
        values = ["".join(rng.choice("ab1王小") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 8))]
        text = "".join(rng.choice("ab1王小 \n0") for _ in range(40))
        edge = lambda c, digit, letter: digit if c in "0123456789" else letter if c.isascii() else ""
        forms = [edge(v[0], "(?<![0-9０-９])", "(?<![A-Za-z0-9])") + r"[\s　]*".join(map(re.escape, v)) + edge(v[-1], "(?![0-9０-９])", "(?![A-Za-z0-9])") for v in sorted(set(values), key=lambda v: (-len(v), v))]
        want = [(m.start(), m.end(), re.sub(r"\s", "", m[0])) for m in re.finditer("|".join(forms), text)]
        assert matcher.Matcher([(v, v) for v in values]).find(text) == want, (values, text)


def test_matcher_bounds():
    find = lambda values, text, **o: [(s, e) for s, e, _ in matcher.Matcher([(v, v) for v in values], **o).find(text)]
    assert find(["王小明"], "王 小明，王  小明", blanks=1) == [(0, 4)]
    assert find(["0912345678"], "０９１２345678", fold=True) == [(0, 10)]
    assert find(["甲"], "甲到，甲方，指甲，甲 2，甲", codes=True) == [(0, 1), (13, 14)]
    assert find(["Sam"], "Sam Sample xSam Sam1") == [(0, 3)]
    assert matcher.Matcher([]).find("x") == [] and matcher.Matcher([("", "x"), (" ", "y")]).find("x y") == []
    assert matcher.Matcher([("ab", "x")]).find("ab ab", [(0, 1)]) == [(3, 5, "x")]


def test_many_values_and_hot_scopes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, 1 if i < 40 else 2, f"值{i:06d} 與值{i + 50000:06d}，值{i}x") for i in range(60)], "doc_id int, case_id int, text string")
    values = spark.range(100_000).selectExpr("1 as case_id", "concat('值', lpad(cast(id as string), 6, '0')) as written", "cast(id as string) as new")
    want = sorted((i, 2 if i < 40 else 0) for i in range(60))
    for size in (matcher.PART_BYTES, 100):
        monkeypatch.setattr(matcher, "PART_BYTES", size)
        hot = matcher.hot_scopes(docs, ["case_id"])
        assert (hot is None) == (size > 100)
        got = matcher.matched(docs, values, ["case_id"], "doc_id", hot=hot)
        assert got.columns == ["doc_id", "case_id", "text", "hits"]
        assert sorted((r["doc_id"], len(r["hits"])) for r in got.collect()) == want


def test_nothing_matches_on_kept_spans(spark):
    docs = spark.createDataFrame([(1, 1, "王小明到"), (2, 1, "法官王小明與王小明")], "doc_id int, case_id int, text string")
    spans = spark.createDataFrame([(1, 1, 0, 3, "PERSON", "full", "王小明"), (2, 1, 2, 5, "PERSON_KEEP", "full", "王小明甲")], SPANS)
    settled = consistency.settled(spans, ["case_id"], keep=True)
    got = consistency.propagated(docs, settled, ["case_id"]).where("type = 'PERSON'")
    assert sorted((r["doc_id"], r["start"]) for r in got.collect()) == [(1, 0), (2, 6)]


def test_ranks_over_buckets(spark):
    rows = spark.range(20_000).selectExpr("id % 2 as scope", "id as v")
    h = F.xxhash64("v")
    got = assign.numbered(rows, ["scope"], F.pmod(h, F.lit(16)), h).toPandas()
    for _, part in got.groupby("scope"):
        assert sorted(part["rank"]) == list(range(10_000))


def test_pools_never_end_and_never_repeat(spark):
    pool = assign.Pool((tuple("xyz"),), ("a", "b"), (2, 3))
    got = [r["v"] for r in spark.range(3 + 4 + 8).select(pool.at(F.col("id"), F.lit(77).cast("long")).alias("v")).collect()]
    assert len(set(got)) == 15 and set(got[:3]) == set("xyz") and {len(v) for v in got[3:7]} == {2} and {len(v) for v in got[7:]} == {3}


def test_thousands_of_names_in_one_scope(spark):
    """5,000 surnames and 10,000 characters of given names: no original comes through."""
    names = spark.range(10_000).selectExpr("1 as case_id", "concat(decode(unhex(hex(19968 + id % 5000)), 'UTF-16BE'), decode(unhex(hex(30000 + id)), 'UTF-16BE')) as value")
    surnames = names.select("case_id", F.substring("value", 1, 1).alias("surname"))
    m = {r["surname"]: r["fake"] for r in realistic.surname_map(surnames, ["case_id"], "s").collect()}
    assert len(m) == len(set(m.values())) == 5000 and not m.keys() & set(m.values())
    chars = {r["original"]: r["fake"] for r in realistic.characters(names.select("case_id", F.substring("value", 2, 1).alias("value")), ["case_id"], "s", realistic.GIVEN_POOL).collect()}
    assert len(chars) == len(set(chars.values())) == 10_000 and not chars.keys() & set(chars.values())


def test_false_names_avoid_the_texts(spark):
    docs = spark.createDataFrame([(1, 1, "陳大文與劉、蔡、郭邱、廖呂先生，潘朱鍾彭")], "doc_id int, case_id int, text string")
    people = spark.createDataFrame([(1, "陳大文", "full"), (1, "歐陽修", "full"), (1, "Mary Smith", "latin"), (1, "SMITH, JOHN", "latin"), (1, "小陳", "nick")], "case_id int, value string, kind string")
    got = {r["value"]: r["new"] for r in realistic.persons(people, ["case_id"], "s", None, realistic.held(docs, ["case_id"])).collect()}
    assert got["陳大文"][0] not in docs.first()["text"] and got["小陳"] == "小" + got["陳大文"][0] and got["歐陽修"][:2] not in docs.first()["text"] and len(got["歐陽修"]) == 3
    assert got["Mary Smith"].split()[1].upper() == got["SMITH, JOHN"].split(",")[0] and got["SMITH, JOHN"].isupper()
    parts = {(r["part"], r["original"]): r["fake"] for r in realistic.parts_of(realistic.persons(people, ["case_id"], "s"), ["case_id"]).collect()}
    assert {("SURNAME", "陳"), ("SURNAME", "歐陽"), ("GIVEN_CHAR", "文"), ("LATIN", "smith")} <= parts.keys()


def test_birthdays(spark):
    values = ["民國78年5月12日", "1989/05/12", "七十八年五月十二日", "May 12, 1989", "5月12日", "78年7月", "78年07月", "2月29日", "13月45日", "無"]
    df = spark.createDataFrame([(c, v) for c in (1, 2) for v in values], "case_id int, v string")
    got = {(r["case_id"], r["v"]): r["o"] for r in df.withColumn("o", birthdays.birthday(F.col("v"), F.col("case_id").cast("string"))).collect()}
    for c in (1, 2):
        m, d = map(int, re.findall("[0-9]+", got[c, "5月12日"]))
        assert (m, d) != (5, 12) and got[c, "民國78年5月12日"] == f"民國78年{m}月{d}日" and got[c, "1989/05/12"] == f"1989/{m:02d}/{d}"
        assert got[c, "78年7月"].startswith("78年") and got[c, "78年7月"] not in ("78年7月", "78年07月") and got[c, "2月29日"] != "2月29日"
        assert got[c, "13月45日"] is None and got[c, "無"] is None and got[c, "May 12, 1989"].endswith(", 1989")
    assert len({got[c, "5月12日"] for c in (1, 2)}) == 2


def test_shifts_avoid_days(spark):
    # Every multiple of seven around the event is taken, so another shift is found; with all days taken, dates move behind the last.
    dates = [(1, "DATE_EVENT", "2000年1月1日"), (2, "DATE_EVENT", "2000年1月1日"), (3, "DATE_EVENT", "1月1日"), (4, "PERSON", "王")]
    base = dt.date(2000, 1, 1)
    text = lambda n: f"{(base + dt.timedelta(days=n)).year}/{(base + dt.timedelta(days=n)).month}/{(base + dt.timedelta(days=n)).day}"
    dates += [(1, "DATE", text(n)) for n in range(-182, 183, 7)] + [(2, "DATE", text(n)) for n in range(-200, 201)]
    spans = spark.createDataFrame(dates, "case_id int, type string, value string")
    got = {r["case_id"]: r["shift"] for r in realistic.case_shifts(spans, ["case_id"], "s").collect()}
    assert got[1] % 7 and 28 <= abs(got[1]) <= 182 and got[2] > 200 and abs(got[3]) >= 28 and got.keys() == {1, 2, 3, 4}
    assert spark.range(1).select(day_number(F.lit("民國89年1月1日")).alias("n")).first()["n"] == 10957


def coded(spark, docs, spans, table):
    docs = spark.createDataFrame(docs, "doc_id int, case_id int, text string")
    spans = spark.createDataFrame(spans, SPANS)
    new, after = case_state.carried(docs, spans, case_state.empty(docs, ["case_id"]) if table is None else table, ["case_id"], ["doc_id", "start"])
    return {(r["doc_id"], r["start"]): r["new"] for r in new.collect()}, after


def test_a_case_goes_on(spark):
    first = [(1, 1, 0, 3, "PERSON", "full", "陳大文"), (1, 1, 10, 12, "PERSON", "full", "林美"), (1, 1, 20, 32, "NUMBER", "num", "0912-345-678")]
    got, table = coded(spark, [(1, 1, "")], first, None)
    assert got == {(1, 0): "甲", (1, 10): "乙", (1, 20): "〔電話1〕"}
    # In another run: old values, a part of an old name, and new ones.
    more = [(2, 1, 0, 2, "PERSON", "full", "林美"), (2, 1, 5, 6, "PERSON", "partial", "陳"), (2, 1, 9, 12, "PERSON", "full", "王一心"), (2, 1, 20, 32, "NUMBER", "num", "０９１２-345-678"), (2, 1, 40, 52, "NUMBER", "num", "0988-111-222"), (3, 2, 0, 2, "PERSON", "full", "林美")]
    got, table = coded(spark, [(2, 1, ""), (3, 2, "")], more, table)
    assert got == {(2, 0): "乙", (2, 5): "甲", (2, 9): "丙", (2, 20): "〔電話1〕", (2, 40): "〔電話2〕", (3, 0): "甲"}
    seqs = [r["seq"] for r in table.where("case_id = 1").orderBy("seq").collect()]
    assert seqs == sorted(set(seqs))
    # The next text speaks of 乙 and 〔電話1〕: both change hands, and their rows are ambiguous.
    got, table = coded(spark, [(4, 1, "乙方以〔電話1〕聯絡")], [(4, 1, 0, 2, "PERSON", "full", "林美"), (4, 1, 5, 7, "PERSON", "full", "新人"), (4, 1, 9, 21, "NUMBER", "num", "0912-345-678")], table)
    assert got == {(4, 0): "丁", (4, 5): "戊", (4, 9): "〔電話3〕"}
    rows = {(r["fake"], r["original"]): r["ambiguous"] for r in table.where("case_id = 1").collect()}
    assert rows["乙", "林美"] and not rows["丁", "林美"] and rows["〔電話1〕", "0912-345-678"] and not rows["〔電話3〕", "0912-345-678"] and not rows["甲", "陳大文"]
    back = rewrite.restored_by_mapping(spark.createDataFrame([(1, 1, "甲、乙、丁與〔電話3〕")], "case_id int, reply_id int, text string"), table, ["case_id"])
    assert back.first()["restored"] == "陳大文、乙、林美與0912-345-678"


def test_engine_continues_with_stand_ins(spark):
    engine = Engine()
    docs = lambda *t: spark.createDataFrame([(i, 1, x) for i, x in t], "doc_id int, case_id int, text string")
    first = docs((1, ONE))
    out, table = engine.continued_stand_ins(first, case_state.empty(first, ["case_id"]), "case_id", "x")
    one = out.first()["rewritten"]
    fake = one[:3]
    assert fake != "王小明" and "澄嶼" not in one and "0912" not in one.replace(fake, "")
    brand = re.search("。(..)顧問", one)[1]
    # Another salt, and a text that holds the false surname: old values stay but for the name, which is made anew.
    again, table2 = engine.continued_stand_ins(docs((2, "澄嶼顧問股份有限公司聯絡王小明，0912-345-678。")), table, "case_id", "y")
    two = again.first()["rewritten"]
    assert two.startswith(brand) and fake in two and "王小明" not in two
    third, table3 = engine.continued_stand_ins(docs((3, f"{fake[0]}先生與王小明。")), table2, "case_id", "x")
    three = third.first()["rewritten"]
    assert "王小明" not in three and fake not in three
    assert {r["ambiguous"] for r in table3.where(F.col("fake") == fake).collect()} == {True}


def test_command_line_goes_on(spark, tmp_path):
    for name, text in (("a", ONE), ("b", "另有林美美，0912-345-678，及王小明。")):
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    m = str(tmp_path / "map")
    for name in "ab":
        cli.main([str(tmp_path / f"{name}.txt"), str(tmp_path / f"out-{name}"), "--codes", "--map", m])
    a, b = (spark.read.parquet(str(tmp_path / f"out-{x}")).first()["text"] for x in "ab")
    assert a.startswith("甲住") and "〔電話1〕" in a and "〔電話1〕" in b and b.endswith("及甲。")
    assert files.versions(spark, m) == 2 and files.versions(spark, str(tmp_path / "none")) == 0
    assert files.read_mapping(spark, m, version=1).count() < files.read_mapping(spark, m).count()
    (tmp_path / "r.txt").write_text("甲的〔電話1〕", encoding="utf-8")
    cli.main([str(tmp_path / "r.txt"), str(tmp_path / "back"), "--restore", m])
    assert spark.read.parquet(str(tmp_path / "back")).first()["text"] == "王小明的0912-345-678"
    with pytest.raises(ValueError):
        cli.main([str(tmp_path / "a.txt"), str(tmp_path / "x"), "--map", m])
