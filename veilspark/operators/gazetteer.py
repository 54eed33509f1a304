"""Tables that decide recall, as parameters: plain sets, which become part of the plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

@dataclass(frozen=True)
class Gazetteer:
    """Surnames of one and of several characters, Japanese ones, roads, districts, cities, short names of listed companies, words
    too common for a name's stem, and organisation suffixes. 臺 and 台 are the same in places."""

    surnames: frozenset[str] = frozenset(P.SURNAMES)
    compound: frozenset[str] = frozenset(P.COMPOUND)
    kana_surnames: frozenset[str] = frozenset()
    roads: frozenset[str] = frozenset()
    districts: frozenset[str] = frozenset()
    cities: frozenset[str] = frozenset(P.CITIES)
    companies: frozenset[str] = frozenset()
    common_words: frozenset[str] = frozenset()
    suffixes: tuple[str, ...] = P.ORGANISATION_FORMS

    def place(self, names: frozenset[str]) -> list[str]:
        return sorted({y for x in names for y in (x, x.replace("臺", "台"), x.replace("台", "臺"))})

    def places(self) -> set[str]:
        """Names, also without their last character (信義 of 信義區), that are no brands."""
        whole = {*self.place(self.districts), *self.place(self.cities)}
        return whole | {x[:-1] for x in whole if len(x) >= 3}


def mined_suffixes(names: DataFrame, least: int = 20, most: int = 8) -> DataFrame:
    """suffix, names: endings of `least` or more different names (`names`: value) behind as many different beginnings.

    Of two endings of which one ends in the other, the shorter one stays only if a tenth of its names do not have the longer one, so
    有限公司 is left out where every such name is a 股份有限公司. Endings are counted by one aggregate over distinct names.
    """
    once = names.select(F.regexp_replace("value", r"(?U)\s", "").alias("v")).where(F.length("v") > 1).distinct()
    ends = once.select("v", F.explode(F.sequence(F.lit(1), F.least(F.length("v") - 1, F.lit(most)))).alias("n")).select(F.expr("right(v, n)").alias("suffix"))
    counted = ends.groupBy("suffix").agg(F.count("*").alias("names")).where(F.col("names") >= least)
    longer = counted.select(F.expr("right(suffix, length(suffix) - 1)").alias("suffix"), F.col("names").alias("m")).groupBy("suffix").agg(F.max("m").alias("m"))
    return counted.join(longer, "suffix", "left").where(F.coalesce("m", F.lit(0)) * 10 <= F.col("names") * 9).select("suffix", "names")
