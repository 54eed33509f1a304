"""Marked text, ⟦TAG:value⟧, as plain text and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import TAGS
from ..functions.spans import match_spans

MARK = r"⟦[A-Z]+:[^⟦⟧]*⟧"


def plain(text: Column) -> Column:
    return F.regexp_replace(text, r"⟦[A-Z]+:([^⟦⟧]*)⟧", "$1")


def parsed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, plain text, and spans (start, end, tag, label, group, value) by place in the plain text.

    A mark is longer than its value by its tag and three signs, so a place in the plain text is the marked place less what
    the marks before it add.
    """
    label, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    shape = "array<struct<start:int,end:int,tag:string,value:string>>"

    def step(a: Column, m: Column) -> Column:
        tag = F.regexp_extract(m["value"], "^⟦([A-Z]+):", 1)
        value = F.regexp_extract(m["value"], "^⟦[A-Z]+:([^⟦⟧]*)⟧", 1)
        start = m["start"] - a["extra"]
        return F.struct((a["extra"] + F.length(tag) + 3).cast("int").alias("extra"), F.concat(a["found"], F.array(F.struct(start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), tag.alias("tag"), value.alias("value")))).alias("found"))

    first = F.struct(F.lit(0).alias("extra"), F.array().cast(shape).alias("found"))
    out = docs.select(key, plain(F.col(text)).alias("text"), F.aggregate(match_spans(F.col(text), MARK), first, step, lambda a: a["found"]).alias("spans"))
    for t, (lab, grp) in TAGS.items():
        label = F.when(F.col("tag") == t, lab).otherwise(label)
        group = F.when(F.col("tag") == t, grp).otherwise(group)
    rows = out.select(key, "text", F.explode("spans").alias("s")).select(key, "text", "s.*")
    return rows.withColumns({"label": label, "grp": group})
