"""Person name candidates as Catalyst expressions. They over-generate on purpose: a scorer chooses.

A generator finds single characters at which something begins, by look-around, so that overlapping names are all found in
one pass of a pattern; ends follow from the characters behind.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import after, before, counting, distinct_sorted, flat_map, let, match_spans, quoted, row
from .gazetteer import Gazetteer

HAN = f"{P.HAN}々"
_KANA = f"{HAN}ぁ-ゖァ-ヺー"
_LEAD = "\n\r，。！？；、 「（\t"
_DOT = "·‧・．"


def beginning(words) -> str:
    """A pattern for the first character of each of the words, where the rest follows."""
    rest: dict[str, list[str]] = defaultdict(list)
    for w in words:
        rest[w[0]].append(w[1:])
    alone = [quoted(c for c, tails in sorted(rest.items()) if not all(tails))] if any(not all(x) for x in rest.values()) else []
    longer = [f"{quoted([c])}(?={quoted(tails)})" for c, tails in sorted(rest.items()) if all(tails)]
    return "|".join([*alone, f"(?={quoted(c for c, tails in rest.items() if all(tails))})(?:{'|'.join(longer)})"] if longer else alone)


def surname_heads(text: Column, g: Gazetteer, kana: bool = False) -> Column:
    """array<struct<start, end>> of every surname of every length, overlapping ones too."""
    names = g.kana_surnames if kana else g.surnames | g.compound

    def of_length(n: int) -> Column:
        found = match_spans(text, beginning(x for x in names if len(x) == n))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (x["start"] + n).cast("int").alias("end")))

    out = [of_length(n) for n in sorted({len(x) for x in names})]
    return F.concat(*out) if out else F.array().cast("array<struct<start:int,end:int>>")


def with_surname(text: Column, g: Gazetteer, kana: bool = False) -> Column:
    """Surnames with one to three characters behind them, at once or each after one white space; and alone beside a title."""
    letter, most = (f"[{_KANA}]", 4) if kana else (f"[{HAN}]", 3)

    def names(x: Column) -> Column:
        run = F.length(F.regexp_extract(after(text, x["end"], most), f"^{letter}*", 0))
        whole = F.transform(counting(run), lambda n: row(text, x["start"], x["end"] + n, "full"))
        spaced = []
        for n in (1, 2, 3):
            size = F.length(F.regexp_extract(after(text, x["end"], 2 * n), f"^(?:[ 　\\n]?[{HAN}]){{{n}}}", 0))
            spaced.append(F.when(size > n, F.array(row(text, x["start"], x["end"] + size, "full"))).otherwise(F.array().cast(ROWS)))
        titled = after(text, x["end"], 4).rlike(f"^(?:{quoted(set(P.TITLES))})") | before(text, x["start"], 3).rlike(f"(?:{quoted(P.SURNAME_AFTER)})$")
        alone = F.when(titled, F.array(row(text, x["start"], x["end"], "partial"))).otherwise(F.array().cast(ROWS))
        return F.concat(whole, *spaced, alone)

    return flat_map(surname_heads(text, g, kana), names)


ROWS = "array<struct<start:int,end:int,kind:string,value:string>>"


def nicknames(text: Column) -> Column:
    """One character before a word for kin, and 老, 小 or 阿 with one or two characters."""
    kin = F.transform(match_spans(text, f"[{HAN}](?=[姐姊哥嫂仔妹弟])"), lambda x: row(text, x["start"], x["end"], "nick"))
    called = flat_map(match_spans(text, f"[老小阿][{HAN}]{{1,2}}"), lambda x: F.transform(counting(x["end"] - x["start"], 2), lambda n: row(text, x["start"], x["start"] + n, "nick")))
    return F.concat(kin, called)


def given_names(text: Column) -> Column:
    """Two characters at the head of a clause, twice the same, or beside words of address."""
    pair = f"[{HAN}](?=[{HAN}]"
    heads = f"(?:(?<=^)|(?<=[{_LEAD}])|(?<={'|'.join(f'(?:{quoted([c])})' for c in P.GIVEN_BEFORE)})){pair})"
    pattern = rf"{heads}|([{HAN}])(?=\1)|{pair}(?:{quoted(P.GIVEN_AFTER)}))"
    return F.transform(match_spans(text, pattern), lambda x: row(text, x["start"], x["start"] + 2, "given"))


def transliterated(text: Column) -> Column:
    """Parts joined by dots, the first and the last cut to each length up to four."""
    part = f"[{HAN}]{{1,6}}"

    def cuts(x: Column) -> Column:
        first = F.length(F.regexp_extract(x["value"], f"^{part}", 0))
        last = F.length(F.regexp_extract(x["value"], f"{part}$", 0))
        inner, outer = x["start"] + first, x["end"] - last
        return flat_map(counting(F.least(first, F.lit(4))), lambda a: F.transform(counting(F.least(last, F.lit(4))), lambda b: row(text, inner - a, outer + b, "translit")))

    return flat_map(match_spans(text, f"{part}(?:[{_DOT}]{part}){{1,3}}"), cuts)


def latin_names(text: Column, g: Gazetteer) -> Column:
    """Names in Latin letters, also with a surname beside them."""
    found = [match_spans(text, p) for p in P.LATIN.values()]
    if g.surnames:
        sur = "[" + "".join(sorted(g.surnames)) + "]"
        found.append(match_spans(text, rf"(?<![A-Za-z])[A-Z][A-Za-z]{{1,12}} ?{sur}(?![A-Za-z])|(?<![{HAN}A-Za-z]){sur} ?[A-Z][A-Za-z]{{1,12}}(?![A-Za-z])"))
    return F.transform(F.concat(*found), lambda x: row(text, x["start"], x["end"], "latin"))


def persons(text: Column, g: Gazetteer | None = None) -> Column:
    """All person candidates of a text, distinct and sorted: array<struct<start, end, kind, value>>."""
    g = g or Gazetteer()
    kana = [with_surname(text, g, True)] if g.kana_surnames else []
    return distinct_sorted(F.concat(with_surname(text, g), *kana, nicknames(text), given_names(text), transliterated(text), latin_names(text, g)))


def surname_length(name: Column, g: Gazetteer) -> Column:
    """Length of the longest surname that a name begins with, or 0."""
    every = g.surnames | g.compound | g.kana_surnames
    several = quoted(x for x in every if len(x) > 1)
    single = "".join(sorted(x for x in every if len(x) == 1))
    forms = [x for x in (several, f"[{single}]" if single else "") if x]
    return F.length(F.regexp_extract(name, f"^(?:{'|'.join(forms) or '(?!)'})", 0))


def given_mentions(docs: DataFrame, masked: DataFrame, g: Gazetteer | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Where the given names, two characters or more, of the full names that are masked in a document stand in it."""
    given = F.col("value").substr(surname_length(F.col("value"), g or Gazetteer()) + 1, F.length("value"))
    per = masked.select(key, given.alias("given")).where(F.length("given") >= 2).groupBy(key).agg(F.collect_set("given").alias("_given"))
    each = F.flatten(F.transform("_given", lambda n: match_spans(F.col(text), F.concat(F.lit("\\Q"), n, F.lit("\\E")))))
    found = let(each, distinct_sorted)
    return docs.select(key, text).join(per, key).select(key, F.explode(found).alias("s")).select(key, "s.start", "s.end", F.lit("given2").alias("kind"), "s.value")
