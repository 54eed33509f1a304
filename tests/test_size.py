"""Work that grows with the tables: texts are dealt out to all tasks, and none of them go through the driver."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from veilspark.operators import wordpiece
from veilspark.plans import casefiles, training_queries


def test_texts_of_one_file_are_dealt_out(spark, sf_dir):
    n = spark.sparkContext.defaultParallelism
    for df in (casefiles.documents(spark, sf_dir), casefiles.marked(spark, sf_dir), casefiles.gold(spark, sf_dir, ["P"]), training_queries.judgments(spark, sf_dir)):
        sizes = [x["n"] for x in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
        assert len(sizes) >= n and max(sizes) < 2 * sum(sizes) / n


@pytest.mark.parametrize("name", ["scan_addresses", "token_spans", "judgment_training", "rename_people", "uncovered_annotations", "residual_leaks"])
def test_nothing_derived_is_broadcast(spark, sf_dir, name):
    """Spark sizes derived texts by the small table that they are made of, here some KB, and would send them all to the driver."""
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_gold_is_that_of_its_sql(spark, sf_dir):
    tags = ["P", "ADDR", "ORG"]
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    want = spark.sql(casefiles.gold_sql(tags).replace('"end"', "`end`"))
    got = casefiles.gold(spark, sf_dir, tags)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    spark.catalog.dropTempView("orders")


def test_short_texts_share_batches(spark, monkeypatch):
    """Tokens of whole texts are the same whatever a batch holds."""
    docs = spark.createDataFrame([(i, None if i == 3 else "ab " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    pieces = spark.createDataFrame([(p, i) for i, p in enumerate([wordpiece.FIRST, wordpiece.LAST, wordpiece.UNKNOWN, "a", "##b"])], "piece string, id int")
    got = {r.doc_id: (r.ids, r.starts, r.ends) for r in wordpiece.tokens(docs, pieces).collect()}
    monkeypatch.setattr(wordpiece, "LOT", 7)
    assert got == {r.doc_id: (r.ids, r.starts, r.ends) for r in wordpiece.tokens(docs, pieces).collect()}
    assert got[3] == ([0, 1], [0, 0], [0, 0]) and got[2] == ([0, 3, 4, 3, 4, 1], [0, 0, 1, 3, 4, 0], [0, 1, 2, 4, 5, 0])


def test_shifts_do_not_grow_with_the_days_they_might_meet(spark):
    """Days meet those near them; before, each event was laid on 310 days by itself."""
    import datetime

    from veilspark.operators import realistic

    days = [(1, "DATE_EVENT", (datetime.date(2020, 1, 1) + datetime.timedelta(n)).strftime("%Y/%-m/%-d")) for n in (0, 28, 182, 183, 365)]
    spans = spark.createDataFrame([*days, (1, "DATE", "2020/3/4"), (2, "DATE_EVENT", "2021/5/6")], "case_id long, type string, value string")
    shifts = realistic.case_shifts(spans, ["case_id"], "salt")
    assert "lit(309)" not in str(shifts._jdf.queryExecution().analyzed()) and "sequence(0, 309" not in str(shifts._jdf.queryExecution().analyzed().toString())
    got = {r.case_id: r["shift"] for r in shifts.collect()}
    at = [0, 28, 182, 183, 365, 63]
    assert set(got) == {1, 2} and not {a + got[1] for a in at[:5]} & set(at) and 28 <= abs(got[1]) <= 182


def test_days_of_cases_are_the_work_of_all_tasks(spark, sf_dir):
    plan = queries()["birthdays_one_to_one"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
