"""Training text from annotated text: new names, markup, scanning noise, filled blanks. Every change is a replacement, and annotations
move with what is replaced before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import cut, match_spans, quoted
from ..plans.shared import kept, unsent
from . import realistic
from .gazetteer import Gazetteer
from .rewrite import rewritten

SPAN = "array<struct<start:int,end:int,tag:string>>"


def changed(docs: DataFrame, replacements: DataFrame, spans: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The changed texts (key, text), and `spans` (key, start, end, ...) with their places in them.

    `replacements` (key, start, end, new) lie apart, and inside or outside spans, not across their ends. A span moves by what the changes
    before it add, and its end also by those in it. Replacements of a document meet its spans as one array.
    """
    out = rewritten(docs, replacements, key)
    per = replacements.groupBy(key).agg(F.collect_list(F.struct("start", "end", (F.length("new") - F.col("end") + F.col("start")).cast("int").alias("by"))).alias("_r"))
    added = lambda keep: F.aggregate(F.filter(F.coalesce("_r", F.array().cast("array<struct<start:int,end:int,by:int>>")), keep), F.lit(0), lambda a, r: (a + r["by"]).cast("int"))
    # What is put in at a span's own beginning comes before it, at its end behind it.
    first = added(lambda r: r["end"] <= F.col("start"))
    last = added(lambda r: (r["end"] <= F.col("end")) & ~((r["start"] == r["end"]) & (r["start"] == F.col("end"))))
    moved = spans.join(unsent(per), key, "left").withColumns({"_a": F.col("start") + first, "_b": F.col("end") + last})
    return out.select(key, F.col("rewritten").alias("text")), moved.withColumns({"start": F.col("_a").cast("int"), "end": F.col("_b").cast("int")}).drop("_r", "_a", "_b")


def chosen(key: Column | str, share: float, salt: str) -> Column:
    """True for a share of the rows, by a hash of a key: the same rows on every run."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 20)) < int(share * (1 << 20))


def renamed(docs: DataFrame, spans: DataFrame, salt: str, gazetteer: Gazetteer | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """New names for the persons (tag P and K, with `value`) of each document, consistent in it: surnames, given names and full names."""
    people = spans.where(F.col("tag").isin("P", "K")).withColumn("kind", F.lit("full"))
    # Written, as the texts and the places of the spans both read them.
    return changed(docs, kept(realistic.persons(people, [key], salt, gazetteer).select(key, "start", "end", "new"), "names"), spans, key)


def rebranded(docs: DataFrame, spans: DataFrame, salt: str, share: float = 0.5, gazetteer: Gazetteer | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """New brands for the organisations of a share of the documents."""
    some = spans.where(F.col("tag").isin("ORG", "ORGK") & chosen(key, share, salt))
    return changed(docs, kept(realistic.organisations(some, [key], salt, gazetteer).select(key, "start", "end", "new"), "brands"), spans, key)


def marked_down(docs: DataFrame, spans: DataFrame, salt: str, share: float = 0.3, mark: str = "**", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Markup around the annotated values of a share of the documents; spans stay on the values."""
    some = spans.where(chosen(key, share, salt))
    edges = some.select(key, F.explode(F.array("start", "end")).alias("at")).distinct()
    return changed(docs, edges.select(key, F.col("at").alias("start"), F.col("at").alias("end"), F.lit(mark).alias("new")), spans, key)


#: What scanning puts after a character, and the share of the characters that it follows.
NOISE, NOISE_SHARE = ("^", "_", "¦"), 0.02


def noised(docs: DataFrame, spans: DataFrame, salt: str, share: float = NOISE_SHARE, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Junk after a share of the characters, by a hash of place and document, as scanned texts have it."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.struct(i.alias("i"), F.pmod(F.xxhash64(F.col(key), i, F.lit(salt)), F.lit(1 << 20)).alias("h")))
    hits = F.filter(at, lambda x: (x["h"] < int(share * (1 << 20))) & (x["i"] < F.length(text)))
    junk = F.element_at(F.array(*map(F.lit, NOISE)), (F.col("x.h") % len(NOISE) + 1).cast("int"))
    places = docs.select(key, F.explode(hits).alias("x")).select(key, F.col("x.i").cast("int").alias("start"), F.col("x.i").cast("int").alias("end"), junk.alias("new"))
    return changed(docs, places, spans, key)


def filled(docs: DataFrame, salt: str, gazetteer: Gazetteer | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, spans: names that a court has masked (陳○○, 林○○) with other given names, the same for the same surname in a document."""
    g = gazetteer or Gazetteer()
    found = docs.select(key, F.explode(match_spans(F.col(text), f"(?:{quoted(g.surnames | g.compound)})[○〇◯]{{1,2}}")).alias("s")).select(key, "s.start", "s.end", "s.value")
    size = F.length(F.regexp_extract("value", "[○〇◯]+$", 0))
    pool = "".join(dict.fromkeys(realistic.GIVEN_POOL))
    pick = lambda n: F.substring(F.lit(pool), (F.pmod(F.xxhash64(F.col(key), "value", F.lit(salt), F.lit(n)), F.lit(len(pool))) + 1).cast("int"), F.lit(1))
    new = F.concat(F.substring("value", F.lit(1), F.length("value") - size), pick(1), F.when(size == 2, pick(2)).otherwise(""))
    out = rewritten(docs, found.withColumn("new", new), key, text)
    return out.select(key, F.col("rewritten").alias("text"), F.transform("log", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("P").alias("tag"))).alias("spans"))


def values_of(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """`spans` with the text that stands at their places."""
    return spans.join(unsent(docs.select(key, "text")), key).withColumn("found", cut(F.col("text"), F.col("start"), F.col("end"))).drop("text")
