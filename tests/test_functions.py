import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions import values as V
from veilspark.functions.spans import match_spans


def test_match_spans_are_pythons(spark):
    texts = ["", "a1@b.co x", "𡍼王 a@b.cc, c@d.ee" * 40, "no", None, "x" * 300 + " q@r.st"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [(x["start"], x["end"], x["value"]) for x in r["s"]] for r in df.select("i", match_spans(F.col("t"), P.EMAIL).alias("s")).collect()}
    assert got == {i: [(*m.span(), m[0]) for m in re.finditer(P.EMAIL, t or "")] for i, t in enumerate(texts)}


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_dates(spark):
    values = ["民國78年5月12日", "78/05/12", "1989-05-12", "七十八年五月十二日", "May 12, 1989", "12 March 1993", "0780512", "5月12日", "112年3月", "Oct", "x", "一一二年五月三十一日"]
    got = [r and (r["y"], r["m"], r["d"]) for r in column(spark, values, V.parse_date)]
    assert got == [(78, 5, 12), (78, 5, 12), (1989, 5, 12), (78, 5, 12), (1989, 5, 12), (1993, 3, 12), (78, 5, 12), (None, 5, 12), (112, 3, 1), (None, 10, 1), None, (112, 5, 31)]


def test_coarse_dates(spark):
    values = ["民國78年5月12日", "1989/05/12", "May 12, 1989", "5月12日", "13月1日", "密碼"]
    assert column(spark, values, lambda c: V.coarse_date(c, "year")) == ["民國78年", "1989年", "1989", None, None, None]
    assert column(spark, values, lambda c: V.coarse_date(c, "month")) == ["民國78年5月", "1989年5月", "May 1989", "5月", None, None]


def test_checksums(spark):
    assert column(spark, ["4111111111111111", "4111111111111112", "0", "", None], V.luhn_ok) == [True, False, False, False, False]
    assert column(spark, ["04595257", "04595258", "1234567", None], V.ubn_ok) == [True, False, False, False]
    assert column(spark, ["A123456789", "A123456788", "a123456789", ""], V.id_ok) == [True, False, False, False]


def test_canon_and_heads(spark):
    assert column(spark, ["０9 12　-3\n4"], V.canon) == ["0912-34"]
    assert column(spark, ["+886912345678", "013-123456789", "0000123456", "0912345678", "000000", "12"], V.keep_head) == [4, 3, 4, 2, 2, 0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aZ09-０中", max_size=12), min_size=1, max_size=20))
def test_shapes_stay(spark, values):
    def classes(s):
        return ["d" if c in "0123456789" else "f" if c in "０１２３４５６７８９" else "l" if c.isascii() and c.islower() else "u" if c.isascii() and c.isupper() else c for c in s]

    for a, b in zip(values, column(spark, values, lambda c: V.shaped(c, F.concat(c, F.lit("k")), 2)), strict=True):
        assert classes(a) == classes(b)
        heads = [[c for c in x if c.isascii() and c.isalnum() or c in "０１２３４５６７８９"][:2] for x in (a, b)]
        assert heads[0] == heads[1]


def test_names_and_words(spark):
    assert column(spark, ["０9 1^2|-3", "臺 北市"], V.unscanned) == ["0912-3", "臺北市"]
    assert column(spark, ["臺 北市"], V.place_name) == ["台北市"]
    got = column(spark, ["Huan-Tec 12", "", "陳A"], lambda c: V.pronounceable(c, c))
    assert [len(x) for x in got] == [11, 0, 2] and got[0][4] == "-" and got[0][:1].isupper() and got[0][9:].isdigit() and got[2][0] == "陳"
    df = spark.createDataFrame([(u,) for u in (0.0, 0.49, 0.5, 0.99, 1.0)], "u double")
    assert [r["x"] for r in df.select(V.sampled(F.col("u"), ["a", "b"], [5, 5]).alias("x")).collect()] == ["a", "a", "b", "b", "b"]
