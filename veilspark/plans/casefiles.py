"""Case files: Chinese documents that Spark derives from `orders` and `customer`, one for each order, one case for each
customer, with names, dates in five notations, phones, e-mails, business numbers, addresses and organisations at known places.

The expressions are SQL that Spark and DuckDB read alike, so both sides derive the same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SURNAME = "substr('陳林黃張李王吳劉蔡楊許鄭謝洪郭邱曾廖賴徐', cast(o_custkey % 20 + 1 as int), 1)"
GIVEN = "concat(substr('明雅志建淑俊怡家美文', cast(o_custkey % 10 + 1 as int), 1), substr('華婷豪宏芬傑君偉玲惠', cast(o_orderkey % 2 + o_custkey % 9 + 1 as int), 1))"
NAME = f"concat({SURNAME}, {GIVEN})"
PHONE = "concat('09', lpad(cast(o_custkey * 7919 % 100000000 as varchar(20)), 8, '0'))"
EMAIL = "concat('c', cast(o_custkey as varchar(20)), '@mail', cast(o_custkey % 97 as varchar(20)), '.tw')"
UBN = "lpad(cast(o_custkey * 104729 % 100000000 as varchar(20)), 8, '0')"
ADDRESS = "concat(case cast(o_custkey % 3 as int) when 0 then '臺北市中山區' when 1 then '臺中市西區' else '高雄市三民區' end, case cast(o_orderkey % 3 as int) when 0 then '瑞光路' when 1 then '中正路' else '民生東路' end, cast(o_custkey % 400 + 1 as varchar(20)), '號', cast(o_orderkey % 20 + 1 as varchar(20)), '樓')"
ORGANISATION = "concat(substr('澄嶼宏遠大立新和永佳', cast(o_custkey % 9 + 1 as int), 1), substr('岳昕辰恩瀚嵐', cast(o_custkey % 5 + 1 as int), 1), '科技股份有限公司')"
Y, M, D = "cast(year(o_orderdate) as int)", "cast(month(o_orderdate) as int)", "cast(day(o_orderdate) as int)"


def _s(x: str) -> str:
    return f"cast({x} as varchar(20))"


_CN = "'〇一二三四五六七八九'"
_CN_YEAR = f"concat(substr({_CN}, 1 + cast(floor(({Y} - 1911) / 10) as int), 1), substr({_CN}, 1 + ({Y} - 1911) % 10, 1))"


def _cn(x: str) -> str:
    """1 to 31 in Chinese numerals."""
    tens, ones = f"cast(floor(({x}) / 10) as int)", f"(({x}) % 10)"
    return f"concat(case when {tens} > 1 then substr({_CN}, 1 + {tens}, 1) else '' end, case when {tens} > 0 then '十' else '' end, case when {ones} > 0 then substr({_CN}, 1 + {ones}, 1) else '' end)"


_MONTH = f"case {M} " + " ".join(f"when {i} then '{m}'" for i, m in enumerate("January February March April May June July August September October November December".split(), 1)) + " end"
#: Five notations of the order's date, by order key.
DATE = f"""case cast(o_orderkey % 5 as int)
 when 0 then concat('民國', {_s(Y + " - 1911")}, '年', {_s(M)}, '月', {_s(D)}, '日')
 when 1 then concat({_s(Y)}, '/', {_s(M)}, '/', {_s(D)})
 when 2 then concat({_CN_YEAR}, '年', {_cn(M)}, '月', {_cn(D)}, '日')
 when 3 then concat({_MONTH}, ' ', {_s(D)}, ', ', {_s(Y)})
 else concat({_s(Y)}, '年', {_s(M)}, '月', {_s(D)}, '日') end"""

#: The parts of a document, in order: (tag or none, SQL).
PARTS = [
    (None, "'茲有'"),
    ("P", NAME),
    (None, "'先生於'"),
    ("DATE", DATE),
    (None, "'簽約，電話'"),
    ("TEL", PHONE),
    (None, "'，信箱 '"),
    ("MAIL", EMAIL),
    (None, "'，統編'"),
    ("ID", UBN),
    (None, "'，住'"),
    ("ADDR", ADDRESS),
    (None, "'，由'"),
    ("ORG", ORGANISATION),
    (None, "'承作'"),
    (None, "concat('，金額', cast(cast(o_orderkey % 900 + 100 as int) as varchar(20)), '元。')"),
]
TEXT = "concat(" + ", ".join(p for _, p in PARTS) + ")"
MARKED = "concat(" + ", ".join(p if t is None else f"'⟦{t}:', {p}, '⟧'" for t, p in PARTS) + ")"


def gold_columns() -> str:
    """Start and value of each tagged part, as SELECT items."""
    out, before = [], []
    for t, p in PARTS:
        if t:
            out.append(f"cast({' + '.join(before)} as int) as {t}_start, {p} as {t}_value")
        before.append(f"length({p})")
    return ", ".join(out)


#: SQL of the documents, for either engine.
DOCS_SQL = f"select o_orderkey as doc_id, o_custkey as case_id, {TEXT} as text from orders"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What texts are made of, dealt out to all tasks by the key of the document: few bytes a row here, many once the text is made. As a file
    comes it may be one row group, and so one task. By number, or adaptive execution would join the small shuffle into one task again."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate").repartition(n, "o_orderkey")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, case_id, text."""
    return orders(spark, sf_dir).selectExpr("o_orderkey as doc_id", "o_custkey as case_id", f"{TEXT} as text")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).selectExpr("o_orderkey as doc_id", f"{MARKED} as text")


def gold_sql(tags: list[str]) -> str:
    """One row for each tagged value: doc_id, case_id, start, end, tag, value."""
    inner = f"select o_orderkey as doc_id, o_custkey as case_id, {gold_columns()} from orders"
    each = [f"select doc_id, case_id, {t}_start as start, cast({t}_start + length({t}_value) as int) as \"end\", '{t}' as tag, {t}_value as value from g" for t in tags]
    return f"with g as ({inner}) " + " union all ".join(each)


def gold(spark: SparkSession, sf_dir: str, tags: list[str]) -> DataFrame:
    """The rows of `gold_sql`, all tags from one pass over the orders."""
    items = [x for x in _items() if x.rpartition(" as ")[2].rpartition("_")[0] in tags]
    found = orders(spark, sf_dir).selectExpr("o_orderkey as doc_id", "o_custkey as case_id", *items)
    each = [F.struct(F.col(f"{t}_start").alias("start"), (F.col(f"{t}_start") + F.length(f"{t}_value")).cast("int").alias("end"), F.lit(t).alias("tag"), F.col(f"{t}_value").alias("value")) for t in tags]
    return found.select("doc_id", "case_id", F.explode(F.array(*each)).alias("s")).select("doc_id", "case_id", "s.*")


def _items() -> list[str]:
    out, before = [], []
    for t, p in PARTS:
        if t:
            out += [f"cast({' + '.join(before)} as int) as {t}_start", f"{p} as {t}_value"]
        before.append(f"length({p})")
    return out
