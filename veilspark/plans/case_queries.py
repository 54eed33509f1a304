"""Queries of cases that go on over several runs, of assignments without end, and of values found by automaton; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import birthdays, case_state, consistency, gazetteer, matcher, realistic
from . import casefiles
from .catalog import PEOPLE, case_spans, query
from .shared import kept

#: The run that a document belongs to, and the documents of the second run that speak of 甲 already.
SECOND = "cast(floor(doc_id / 2) as bigint) % 2 = 1"
SPEAKS = "case_id % 5 = 0"


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The case files of the first and of the second run; some of the second have another 甲 in their text."""
    docs = casefiles.documents(spark, sf_dir)
    second = docs.where(SECOND).withColumn("text", F.expr(f"case when {SPEAKS} then concat(text, '（甲案）') else text end"))
    return docs.where(f"not ({SECOND})"), second


def continued(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons of both runs with their codes, and the case tables behind each."""
    first, second = runs(spark, sf_dir)
    people = case_spans(spark, sf_dir, ["P"]).withColumn("kind", F.lit("full"))
    before, table = case_state.carried(first, people.where(f"not ({SECOND})"), case_state.empty(first, ["case_id"]), ["case_id"], ["doc_id", "start"])
    table = kept(table, "case")
    after, last = case_state.carried(second, people.where(SECOND), table, ["case_id"], ["doc_id", "start"])
    return before.unionByName(after), table, last


#: Names in the order of a case, by run. In a case whose second run speaks of 甲, 甲's owner gets the code behind all of the first run, and so
#: on; a case that begins with the second run begins with 乙.
_NUMBERED = f"""with g as ({PEOPLE}), h as (select *, {SECOND} as second from g),
    one as (select case_id, value, row_number() over (partition by case_id order by min({{'d': doc_id, 's': start}}), value) as n from h where not second group by case_id, value),
    many as (select case_id, max(n) as n from one group by case_id),
    met as (select distinct case_id, {SPEAKS} as speaks from h where second),
    fresh as (select case_id, value, row_number() over (partition by case_id order by min({{'d': doc_id, 's': start}}), value) as m from h where second and (case_id, value) not in (select (case_id, value) from one) group by case_id, value),
    codes as (select case_id, value, n as place, false as second, case when coalesce(speaks, false) and n = 1 then true else false end as gone from one left join met using (case_id)
        union all select o.case_id, o.value, case when speaks and o.n = 1 then many.n + 1 else o.n end, true, false from one o join many using (case_id) join met using (case_id)
        union all select f.case_id, f.value, coalesce(many.n, 0) + f.m + case when speaks then 1 else 0 end, true, false from fresh f join met using (case_id) left join many using (case_id))"""


@query(f"{_NUMBERED} select h.doc_id, h.case_id, h.value as name, substr('甲乙丙丁戊庚壬癸', cast(c.place as int), 1) as code from h join codes c on c.case_id = h.case_id and c.value = h.value and c.second = h.second")
def continue_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of two runs of each case: old values keep theirs, new ones go on, and 甲 changes hands where the second run's texts hold it."""
    return continued(spark, sf_dir)[0].select("doc_id", "case_id", F.col("value").alias("name"), F.col("new").alias("code"))


@query(f"{_NUMBERED} select case_id, value as original, substr('甲乙丙丁戊庚壬癸', cast(place as int), 1) as fake, bool_or(gone) as ambiguous from codes group by all")
def continued_case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case table behind both runs: every fake that was given out, those that changed their meaning ambiguous."""
    return continued(spark, sf_dir)[2].select("case_id", "original", "fake", "ambiguous")


@query(f"""with g as ({PEOPLE}), one as (select case_id, value from g where not ({SECOND})) select g.doc_id, g.case_id, g.start, g."end", g.value from g where {SECOND} and exists (select 1 from one where one.case_id = g.case_id and one.value = g.value)""")
def mask_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first run of a case masked is found in the texts of the second, though nothing is detected there."""
    first, second = runs(spark, sf_dir)
    _, table, _ = continued(spark, sf_dir)
    none = case_spans(spark, sf_dir, ["P"]).withColumn("kind", F.lit("full")).where("false")
    found = consistency.propagated(second, none, ["case_id"], known=case_state.values(table, ["case_id"]))
    return found.select("doc_id", "case_id", "start", "end", "value")


@query("select distinct chr(cast(19968 + (c_custkey * 7) % 20000 as int)) as surname, true as other, true as one_to_one, true as no_real_one from customer")
def surnames_without_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many surnames in one scope as there are customers: each has a false one, no two the same, none a real one."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit(1).alias("scope"), F.decode(F.unhex(F.hex(19968 + F.col("c_custkey") * 7 % 20000)), "UTF-16BE").alias("surname")).distinct()
    return _checked(names, realistic.surname_map(names, ["scope"], "salt"), "surname")


@query("select distinct chr(cast(19968 + c_custkey % 20000 as int)) as original, true as other, true as one_to_one, true as no_real_one from customer")
def characters_without_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many characters of given names in one scope as there are customers, up to nearly the whole common block."""
    chars = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit(1).alias("scope"), F.decode(F.unhex(F.hex(19968 + F.col("c_custkey") % 20000)), "UTF-16BE").alias("value"))
    return _checked(chars.select("scope", F.col("value").alias("original")).distinct(), realistic.characters(chars, ["scope"], "salt", realistic.GIVEN_POOL), "original")


def _checked(real: DataFrame, made: DataFrame, name: str) -> DataFrame:
    """Whether stand-ins are others, one to one, and no real values of their scope."""
    made = kept(made, "stand-ins")
    once = made.groupBy("scope", "fake").agg(F.count("*").alias("n"))
    taken = real.select("scope", F.col(name).alias("fake")).distinct().withColumn("_real", F.lit(True))
    return (
        made.join(once, ["scope", "fake"])
        .join(taken, ["scope", "fake"], "left")
        .select(name, (F.col("fake") != F.col(name)).alias("other"), (F.col("n") == 1).alias("one_to_one"), F.col("_real").isNull().alias("no_real_one"))
    )


@query(f"with g as ({PEOPLE}) select distinct case_id % 25 as region, value, true as apart from g")
def false_names_meet_no_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a region of many cases: no false name stands anywhere in the region's texts."""
    docs = casefiles.documents(spark, sf_dir).withColumn("region", F.col("case_id") % 25)
    spans = case_spans(spark, sf_dir, ["P"]).select("doc_id", (F.col("case_id") % 25).alias("region"), "start", "end", "value", F.lit("full").alias("kind"))
    made = kept(realistic.persons(spans, ["region"], "salt", None, realistic.held(docs, ["region"])).select("region", "value", "new").distinct(), "names")
    met = matcher.matched(docs.select("doc_id", "region", "text"), made.select("region", F.col("new").alias("written"), "new"), ["region"], "doc_id")
    bad = met.select("region", F.explode("hits").alias("h")).select("region", F.col("h.new").alias("new")).distinct().withColumn("_met", F.lit(True))
    return made.join(bad, ["region", "new"], "left").select("region", "value", F.col("_met").isNull().alias("apart"))


@query(f"""with g as ({casefiles.gold_sql(["P", "ORG"])}) select doc_id, start, value from g where tag = 'P' and case_id % 3 <> 0 and exists (select 1 from g x where x.case_id = g.case_id and x.tag = 'P' and x.value = g.value and x.doc_id % 4 = 0)""")
def kept_places_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names masked in every fourth document are masked in the others of their case, but not where a kept span lies: here every name of
    every third case."""
    docs = casefiles.documents(spark, sf_dir)
    people = case_spans(spark, sf_dir, ["P"]).withColumn("kind", F.lit("full")).drop("tag")
    masked = people.where("doc_id % 4 = 0 and case_id % 3 <> 0")
    # In these cases another name is masked, which stands inside the kept ones.
    guards = people.where("case_id % 3 = 0").withColumn("type", F.lit("PERSON_KEEP"))
    inner = people.where("doc_id % 4 = 0 and case_id % 3 = 0").select("doc_id", "case_id", F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.col("value"), F.lit("PERSON").alias("type"), F.lit("full").alias("kind"))
    found = consistency.propagated(docs, masked.unionByName(guards).unionByName(inner), ["case_id"])
    return found.where("type = 'PERSON' and start >= 0").select("doc_id", "start", "value")


@query("select distinct o_custkey as case_id, cast(366 as bigint) as days, cast(366 as bigint) as others, cast(0 as bigint) as fixed, cast(12 as bigint) as months, cast(0 as bigint) as fixed_months from orders")
def birthdays_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days of a year and all months under the permutation of each case: as many others as there are, none its own."""
    cases = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("case_id"))
    # By number, or adaptive execution would join the few cases into one task, which then makes all their days.
    cases = cases.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "case_id").distinct()
    # A column of the case, or each round of each day would put it together again.
    cases, key = cases.withColumn("key", F.concat_ws("|", F.col("case_id").cast("string"), F.lit("salt"))), F.col("key")
    each = cases.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(365))))
    each = each.withColumns({"o": birthdays.following(F.col("n"), birthdays.DAYS, key), "m": F.when(F.col("n") < 12, birthdays.other_month(F.col("n") + 1, key))})
    return each.groupBy("case_id").agg(
        F.count("*").alias("days"),
        F.countDistinct("o").alias("others"),
        F.sum((F.col("o") == F.col("n")).cast("long")).alias("fixed"),
        F.countDistinct("m").alias("months"),
        F.sum(F.coalesce((F.col("m") == F.col("n") + 1).cast("long"), F.lit(0).cast("long"))).alias("fixed_months"),
    )


def _dates(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return casefiles.gold(spark, sf_dir, ["DATE"]).withColumn("type", F.lit(kind))


_DATES = casefiles.gold_sql(["DATE"])


@query(f"with g as ({_DATES}) select doc_id, true as same_year, true as other_day, true as same_notation, true as one_to_one from g")
def move_birthdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of the case files as birthdays, in five notations: the year and the notation stay, and in a case one day has one stand-in."""
    key = F.concat_ws("|", F.col("case_id").cast("string"), F.lit("salt"))
    made = kept(_dates(spark, sf_dir, "DATE").withColumn("new", birthdays.birthday(F.col("value"), key)), "birthdays")
    old, new = V.parse_date(F.col("value")), V.parse_date(F.col("new"))
    day = lambda p: F.concat_ws("/", p["m"], p["d"])
    each = made.select("doc_id", "case_id", "value", "new", old["y"].alias("y"), new["y"].alias("z"), day(old).alias("a"), day(new).alias("b"))
    pairs = each.select("case_id", "a", "b").distinct()
    ways = pairs.groupBy("case_id", "a").agg(F.count("*").alias("n"), F.min("b").alias("b1")).join(pairs.groupBy("case_id", F.col("b").alias("b1")).agg(F.count("*").alias("k")), ["case_id", "b1"]).select("case_id", "a", "n", "k")
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "January|February|March|April|May|June|July|August|September|October|November|December", "M"), "[0-9〇一二三四五六七八九十]+", "0")
    return each.join(ways, ["case_id", "a"]).select(
        "doc_id", (F.col("y") == F.col("z")).alias("same_year"), (F.col("a") != F.col("b")).alias("other_day"), (plain(F.col("value")) == plain(F.col("new"))).alias("same_notation"), ((F.col("n") == 1) & (F.col("k") == 1)).alias("one_to_one")
    )


@query(f"""with d as (select o_orderkey as doc_id, o_custkey as case_id, cast(o_orderdate as date) as day from orders) select case_id, count(distinct day) as days, cast(0 as bigint) as met, true as one_shift from d group by case_id""")
def move_event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event dates of each case moved by one shift: intervals stay, and no moved day is a day of the case, in any notation."""
    spans = _dates(spark, sf_dir, "DATE_EVENT")
    shifts = kept(realistic.case_shifts(spans, ["case_id"], "salt"), "shifts")
    moved = kept(spans.join(shifts, "case_id").select("case_id", V.day_number(F.col("value")).alias("old"), V.day_number(V.shifted_date(F.col("value"), F.col("shift"))).alias("new")), "moved")
    days = moved.select("case_id", F.col("old").alias("new")).distinct().withColumn("_day", F.lit(True))
    return moved.join(days, ["case_id", "new"], "left").groupBy("case_id").agg(F.countDistinct("old").alias("days"), F.sum(F.col("_day").isNotNull().cast("long")).alias("met"), (F.min(F.col("new") - F.col("old")) == F.max(F.col("new") - F.col("old"))).alias("one_shift"))


_ORGS = casefiles.gold_sql(["ORG"])


@query(f"""with g as ({_ORGS}), v as (select distinct value as v from g), e as (select v, unnest(range(1, least(length(v) - 1, 8) + 1)) as n from v), c as (select right(v, n) as suffix, count(*) as names from e group by all having count(*) >= 20),
    l as (select right(suffix, length(suffix) - 1) as suffix, max(names) as m from c group by all) select c.suffix, c.names from c left join l using (suffix) where coalesce(m, 0) * 10 <= names * 9""")
def mine_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endings that many organisations of the case files share."""
    return gazetteer.mined_suffixes(casefiles.gold(spark, sf_dir, ["ORG"]).select("value"))
