"""Selection of non-overlapping spans from scored candidates, and splicing of replacements into texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import ORG_KINDS, OUTPUT_TYPE, PERSON_KINDS
from ..functions.spans import cut, let, sums_before


def output_type(kind: Column, p_mask: Column, p_keep: Column) -> Column:
    pii = F.lit(None).cast("string")
    for k, v in OUTPUT_TYPE.items():
        pii = F.when(kind == k, v).otherwise(pii)
    return (
        F.when(kind.isin(*ORG_KINDS), F.when(p_mask >= p_keep, "ORG").otherwise("ORG_KEEP"))
        .when((kind == "date") & (p_keep > p_mask), "DATE_EVENT")
        .when(kind.isin(*OUTPUT_TYPE), pii)
        .when(kind.isin(*PERSON_KINDS) | F.lit(True), F.when(p_mask >= p_keep, "PERSON").otherwise("PERSON_KEEP"))
    )


def selected(scored: DataFrame, key: str = "doc_id", tau: float = 0.5) -> DataFrame:
    """Greedy choice by p_mask + p_keep, highest first; a candidate under `tau` or on a chosen one is dropped. Ties go to the
    smaller start, end and kind. A column `value` stays.

    Candidates decide only about those that they overlap, so a document falls into islands: stretches that no candidate
    crosses. A window over the running end finds them, and each is decided by a fold over its few candidates.
    """
    total = F.col("p_mask") + F.col("p_keep")
    extra = ["value"] if "value" in scored.columns else []
    item = F.struct((-total).alias("o"), F.col("start"), F.col("end"), F.col("kind"), F.col("p_mask"), F.col("p_keep"), *extra)
    w = Window.partitionBy(key).orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = scored.where(total >= tau).withColumn("_new", (F.coalesce(reached, F.lit(-1)) <= F.col("start")).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = islands.groupBy(key, "_island").agg(F.sort_array(F.collect_list(item)).alias("a"))

    def step(chosen: Column, x: Column) -> Column:
        clash = F.exists(chosen, lambda c: (c["start"] < x["end"]) & (x["start"] < c["end"]))
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(x)))

    picked = each.select(key, F.explode(F.aggregate("a", F.slice("a", 1, 0), step)).alias("x"))
    return picked.select(
        key,
        F.col("x.start").cast("int").alias("start"),
        F.col("x.end").cast("int").alias("end"),
        output_type(F.col("x.kind"), F.col("x.p_mask"), F.col("x.p_keep")).alias("type"),
        F.round(-F.col("x.o"), 3).alias("score"),
        F.round("x.p_mask", 3).alias("p_mask"),
        F.col("x.kind").alias("kind"),
        *[F.col(f"x.{c}") for c in extra],
    )


def extend_long(spans: DataFrame, values: DataFrame, tile: int, key: str = "doc_id") -> DataFrame:
    """URLs and e-mails longer than a tile (`values`: start, end, type, and value if spans have it) replace the spans that touch them with
    one whole span, with the best of their scores. Spans that are kept do not count. Long values are few: they join as an array for
    each document, so this is an equi-join."""
    kept_types = ["PERSON_KEEP", "ORG_KEEP", "DATE_EVENT"]
    extra = [c for c in ("value",) if c in spans.columns and c in values.columns]
    long = values.where(F.col("end") - F.col("start") > tile).groupBy(key).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", *extra)).alias("_long"))
    touching = F.filter("_long", lambda v: (F.col("start") < v["end"]) & (v["start"] < F.col("end")))
    joined = spans.join(long, key, "left").withColumn("_v", F.when(~F.col("type").isin(*kept_types), F.get(touching, F.lit(0)))).drop("_long")
    columns = [key, "start", "end", "type", "score", "p_mask", "kind", *extra]
    best = joined.where("_v is not null").groupBy(key, "_v").agg(F.max_by(F.struct("score", "p_mask"), "score").alias("b"))
    whole = best.select(key, "_v.start", "_v.end", "_v.type", "b.score", "b.p_mask", F.lower("_v.type").alias("kind"), *[F.col(f"_v.{c}").alias(c) for c in extra])
    return joined.where("_v is null").select(*columns).unionByName(whole.select(*columns))


def longest_first(hits: Column) -> Column:
    """Of an array of hits (start, end, ...), those that stay when the earlier, then the longer, wins."""
    order = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("n"), h.alias("h"))))
    none = F.struct(F.lit(-1).alias("at"), F.slice(F.transform(order, lambda x: x["h"]), 1, 0).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        return F.when(x["start"] >= a["at"], F.struct(x["h"]["end"].cast("int").alias("at"), F.concat(a["kept"], F.array(x["h"])).alias("kept"))).otherwise(a)

    return F.aggregate(order, none, step, lambda a: a["kept"])


def spliced(text: Column, replacements: Column) -> Column:
    """struct<text, spans>: `replacements` (array of start, end, new; sorted, apart) put into the text, and where they went:
    start and end in the new text, original, orig_start, orig_end.

    The text is joined once from its pieces, and places move by a prefix sum of the changes in length before them.
    """

    def put(r: Column) -> Column:
        size = F.size(r)
        before = lambda i: F.when(i > 0, F.get(r, i - 1)["end"]).otherwise(0)
        pieces = F.transform(r, lambda x, i: F.concat(cut(text, before(i), x["start"]), x["new"]))
        tail = F.substring(text, before(size) + 1, F.length(text))
        moved = sums_before(F.transform(r, lambda x: (F.length(x["new"]) - x["end"] + x["start"]).cast("int")))

        def entry(x: Column, by: Column) -> Column:
            start = x["start"] + by
            return F.struct(start.cast("int").alias("start"), (start + F.length(x["new"])).cast("int").alias("end"), cut(text, x["start"], x["end"]).alias("original"), x["start"].cast("int").alias("orig_start"), x["end"].cast("int").alias("orig_end"))

        return F.struct(F.concat(F.array_join(pieces, ""), tail).alias("text"), F.zip_with(r, moved, entry).alias("spans"))

    return F.when(text.isNotNull(), let(replacements, put))


def restored(text: Column, spans: Column) -> Column:
    """The positional inverse of `spliced`."""
    back = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["original"].alias("new")))
    return spliced(text, back)["text"]
