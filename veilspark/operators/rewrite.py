"""Codes, generalisation and restoration, consistent in a document or over a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import flat_map, let, quoted
from ..functions.values import canon, coarse_date, half_digits, parse_date, value_label
from ..plans.shared import unsent
from .candidates import dates
from .decode import longest_first, spliced
from .gazetteer import Gazetteer
from .labelling import used_codes
from .matcher import HITS, matched
from .names import surname_length

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STRINGS = "array<string>"


def person_code(rank: Column) -> Column:
    """甲, 乙, … and, when all are used, 甲2, 乙2, …; `rank` starts at 1."""
    n = len(P.PERSON_CODES)
    lap = F.floor((rank - 1) / n) + 1
    return F.concat(F.substring(F.lit(P.PERSON_CODES), ((rank - 1) % n + 1).cast("int"), F.lit(1)), F.when(lap > 1, lap.cast("string")).otherwise(""))


def letter_code(rank: Column) -> Column:
    """A, B, … Z, A2, …"""
    lap = F.floor((rank - 1) / 26) + 1
    return F.concat(F.substring(F.lit(LETTERS), ((rank - 1) % 26 + 1).cast("int"), F.lit(1)), F.when(lap > 1, lap.cast("string")).otherwise(""))


def _free(letters: str, used: Column) -> Column:
    return F.filter(F.array(*map(F.lit, letters)), lambda c: ~F.array_contains(used, c))


def free_code(rank: Column, used: Column, letters: str, spare: str) -> Column:
    """The rank-th code whose letter is not in `used`: each free letter, then each with 2, …; with none free, `spare` and the rank."""

    def pick(free: Column) -> Column:
        n = F.greatest(F.size(free), F.lit(1))
        lap = F.floor((rank - 1) / n) + 1
        code = F.concat(F.get(free, ((rank - 1) % n).cast("int")), F.when(lap > 1, lap.cast("string")).otherwise(""))
        return F.when(F.size(free) == 0, F.concat(F.lit(spare), rank.cast("string"))).otherwise(code)

    return let(_free(letters, used), pick)


def free_number(rank: Column, label: Column, used: Column) -> Column:
    """The rank-th number that no code of this label in `used` has."""
    mine = F.filter(F.transform(used, lambda c: F.when(F.regexp_replace(c, r"[\s　]*[0-9]+$", "") == label, F.regexp_extract(c, "[0-9]+$", 0).try_cast("int"))), lambda n: n.isNotNull())
    return let(mine, lambda m: F.get(F.filter(F.sequence(F.lit(1).cast("int"), (rank + F.size(m)).cast("int")), lambda k: ~F.array_contains(m, k)), (rank - 1).cast("int")))


def first_seen(spans: DataFrame, scope: list[str], order: list[str], value: Column, within: list[str] | None = None) -> DataFrame:
    """Distinct values of each scope with their rank by first occurrence: an aggregate, then a window over the few distinct values."""
    first = spans.select(*scope, *(within or []), value.alias("canon"), F.struct(*order).alias("at")).groupBy(*scope, *(within or []), "canon").agg(F.min("at").alias("at"))
    return first.withColumn("rank", F.dense_rank().over(Window.partitionBy(*scope, *(within or [])).orderBy("at", "canon"))).drop("at")


def reserved(docs: DataFrame, scope: list[str], text: str = "text") -> DataFrame:
    """scope, used: the codes that the texts of a scope hold already, which new codes must avoid."""
    letters = F.filter(F.array(*map(F.lit, P.PERSON_CODES)), lambda c: F.contains(F.col(text), c))
    each = docs.select(*scope, F.array_distinct(F.concat(letters, used_codes(F.col(text)))).alias("u"))
    return each.groupBy(*scope).agg(F.array_distinct(F.flatten(F.collect_set("u"))).alias("used"))


def owners(spans: DataFrame, scope: list[str], gazetteer: Gazetteer | None = None) -> DataFrame:
    """Person spans (`canon`, `kind`) with `owner`: whose code a span gets.

    A full name is its own. A surname, given name or nickname belongs to the one full name of its scope that it fits; where it
    fits several, the owner is 〇, and where none, it is its own. Full names are listed under each part that may stand
    for them, so this is an equi-join.
    """
    g = gazetteer or Gazetteer()
    n = surname_length(F.col("canon"), g)
    named = spans.withColumns({"_sur": F.expr("substring(canon, 1, 0)") if not g.surnames else F.substring("canon", F.lit(1), n), "_given": F.substring("canon", n + 1, F.length("canon"))})
    part = F.when((F.col("kind") == "partial") | ((n > 0) & (F.length("canon") == n)), F.concat(F.lit("s:"), "canon")).when(F.col("kind").isin("given", "given2"), F.concat(F.lit("g:"), "canon"))
    head = F.regexp_extract("canon", "^[老小阿](?=.)", 0)
    body = F.substring("canon", F.length(head) + 1, F.length("canon"))
    nick = F.when(head.isin("老", "小") & (surname_length(body, g) == F.length(body)), F.concat(F.lit("s:"), body)).otherwise(F.concat(F.lit("n:"), body))
    named = named.withColumn("_part", F.when(F.col("kind") == "nick", nick).otherwise(part)).drop("_s")

    given = F.col("_given")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.length(given), F.lit(1))), lambda i: F.substring(given, i, F.length(given)))
    inside = flat_map(F.sequence(F.lit(1), F.greatest(F.length(given), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.length(given) - i + 1, F.lit(1))), lambda k: F.substring(given, i, k)))
    keys = F.concat(F.array(F.concat(F.lit("s:"), "_sur")), F.transform(tails, lambda x: F.concat(F.lit("g:"), x)), F.transform(inside, lambda x: F.concat(F.lit("n:"), x)))
    full = named.where("_part is null").select(*scope, "canon", F.explode(F.array_distinct(keys)).alias("_part")).where("length(_part) > 2").distinct()
    # Also a name that stands whole as a part elsewhere is that person.
    fits = full.groupBy(*scope, "_part").agg(F.min("canon").alias("_one"), F.count("*").alias("_n"))
    owner = F.when(F.col("_part").isNull() | F.col("_n").isNull(), F.coalesce("_part", F.concat(F.lit("p:"), "canon"))).when(F.col("_n") == 1, F.concat(F.lit("p:"), "_one")).otherwise("〇")
    return named.join(unsent(fits), [*scope, "_part"], "left").withColumn("owner", owner).drop("_sur", "_given", "_part", "_one", "_n")


def brand_parts(name: Column, gazetteer: Gazetteer | None = None) -> Column:
    """Pieces of an organisation name that are no form, trade or city: array<string>."""
    g = gazetteer or Gazetteer()
    words = quoted({*g.suffixes, *P.TRADE_WORDS, *g.place(g.cities)})
    return F.filter(F.split(F.regexp_replace(name, f"(?:{words})", "\x03"), "\x03+"), lambda x: x != "")


def organisation_code(name: Column, letter: Column, gazetteer: Gazetteer | None = None) -> Column:
    """The name with its brand as a letter (澄嶼顧問股份有限公司: A顧問股份有限公司). Where the brand is not one piece of two characters or more, the letter and
    the form; without Han, Company A."""
    g = gazetteer or Gazetteer()
    form = F.regexp_extract(name, f"(?:{quoted(g.suffixes)})$", 0)
    form = F.when((form == "") | form.endswith("公司"), "公司").otherwise(form)

    def put(parts: Column) -> Column:
        one = (F.size(parts) == 1) & (F.length(F.get(parts, F.lit(0))) >= 2) & (F.get(parts, F.lit(0)) != name)
        return F.when(~name.rlike(f"[{P.HAN}]"), F.concat(F.lit("Company "), letter)).when(one, F.replace(name, F.get(parts, F.lit(0)), letter)).otherwise(F.concat(letter, form))

    return let(brand_parts(name, g), put)


def labelled(spans: DataFrame, scope: list[str], address_level: str = "city", gazetteer: Gazetteer | None = None, known: DataFrame | None = None) -> DataFrame:
    """`spans` with what their code depends on: `label` (p, o, or what a token is called), `_kept` (what stays in front of a token), `canon`
    and `owner` (whose code it is). `known` (scope, value) are full names of earlier runs, to which parts of names may belong too."""
    g = gazetteer or Gazetteer()
    t, v = F.col("type"), F.col("value")
    lot = F.regexp_extract(v, rf"([{P.DIGIT}]+(?:-[{P.DIGIT}]+)?) ?([地建])號$", 2)
    label = (
        F.when(t == "PERSON", "p")
        .when(t == "ORG", "o")
        .when(t.startswith("DATE"), "日期")
        .when((t == "ADDRESS") & (lot != ""), F.concat(lot, F.lit("號")))
        .when(t == "ADDRESS", "地址")
        .otherwise(value_label(v))
    )
    city = f"^(?:{quoted(g.place(g.cities))})"
    district = rf"{city}?(?:{quoted(g.place(g.districts))})" if g.districts else rf"{city}(?:[{P.HAN}]{{1,3}}[區鄉鎮市])?"
    kept = F.when((t == "ADDRESS") & (lot != ""), F.regexp_replace(v, rf"[{P.DIGIT}]+(?:-[{P.DIGIT}]+)? ?[地建]號$", "")).when(t == "ADDRESS", F.regexp_extract(v, district if address_level == "district" else city, 0)).otherwise("")
    named = spans if "kind" in spans.columns else spans.withColumn("kind", F.lit("full"))
    named = named.withColumns({"label": label, "_kept": kept})
    named = named.withColumn("canon", canon(F.substring("value", F.length("_kept") + 1, F.length("value"))))
    people = named.where("label = 'p'")
    if known is None:
        people = owners(people, scope, g)
    else:
        before = known.select(*scope, canon(F.col("value")).alias("canon"), F.lit("full").alias("kind"), F.lit(True).alias("_before"))
        people = owners(people.withColumn("_before", F.lit(False)).unionByName(before, allowMissingColumns=True), scope, g).where("not _before").drop("_before")
    return people.unionByName(named.where("label <> 'p'").withColumn("owner", F.col("canon")))


def with_codes(named: DataFrame, codes: DataFrame, scope: list[str], date_level: str = "month", birth_level: str = "year", gazetteer: Gazetteer | None = None) -> DataFrame:
    """`labelled` spans with `new`, by the code `c` of each owner (`codes`: scope, label, owner, c); an owner of several has none."""
    g = gazetteer or Gazetteer()
    t, v, c = F.col("type"), F.col("value"), F.col("c")
    token = F.concat(F.lit("〔"), F.col("label"), c, F.lit("〕"))

    def date(level: str) -> Column:
        return v if level == "keep" else F.coalesce(coarse_date(v, level), token)

    new = (
        F.when(F.col("label") == "p", F.coalesce(c, F.lit("〇")))
        .when(F.col("label") == "o", organisation_code(F.col("canon"), c, g))
        .when(t == "DATE", date(birth_level))
        .when(t.startswith("DATE"), date(date_level))
        .otherwise(F.concat("_kept", token))
    )
    return named.join(unsent(codes.select(*scope, "label", "owner", "c")), [*scope, "label", "owner"], "left").withColumn("new", new)


def coded(spans: DataFrame, scope: list[str], order: list[str], date_level: str = "month", used: DataFrame | None = None, address_level: str = "city", birth_level: str = "year", gazetteer: Gazetteer | None = None) -> DataFrame:
    """`spans` (type, value, and kind if known) with `new`: 甲 for persons, A公司 for organisations, 〔label N〕 for other values, dates as far
    as their level ("keep", "month", "year"), addresses behind the city (or district) that stays.

    One value has one code in a scope (columns such as case_id). Codes in `used` (of `reserved`) are passed over. Equi-joins on scope
    and canonical value only.
    """
    named = labelled(spans, scope, address_level, gazetteer)
    # A part has the place of its full name's first mention or its own; a part of several has no code.
    ranks = first_seen(named.where("owner <> '〇' or label <> 'p'"), scope, order, F.col("owner"), ["label"]).withColumnRenamed("canon", "owner")
    ranks = ranks.join(unsent(used.select(*scope, "used")), scope, "left") if used is not None else ranks.withColumn("used", F.array().cast(_STRINGS))
    ranks = ranks.withColumn("used", F.coalesce("used", F.array().cast(_STRINGS)))
    rank, taken = F.col("rank"), F.col("used")
    c = F.when(F.col("label") == "p", free_code(rank, taken, P.PERSON_CODES, "人物")).when(F.col("label") == "o", free_code(rank, taken, LETTERS, "機構")).otherwise(free_number(rank, F.col("label"), taken).cast("string"))
    out = with_codes(named, ranks.withColumn("c", c), scope, date_level, birth_level, gazetteer).drop("canon", "label", "_kept", "owner", "c")
    return out if "kind" in spans.columns else out.drop("kind")


def rewritten(docs: DataFrame, replacements: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with `rewritten` and `log`; `replacements` (key, start, end, new) lie apart."""
    per = replacements.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "new"))).alias("_r"))
    empty = F.array().cast("array<struct<start:int,end:int,new:string>>")
    joined = docs.join(unsent(per), key, "left").withColumn("_o", spliced(F.col(text), F.coalesce("_r", empty)))
    return joined.select(*docs.columns, F.col("_o.text").alias("rewritten"), F.col("_o.spans").alias("log"))


def anonymized(docs: DataFrame, spans: DataFrame, scope: list[str], order: list[str], key: str = "doc_id", date_level: str = "month", used: DataFrame | None = None) -> DataFrame:
    """Rewritten text only: no mapping column leaves this function."""
    return rewritten(docs, coded(spans, scope, order, date_level, used), key).select(key, F.col("rewritten").alias("text"))


def mapping(spans: DataFrame, scope: list[str]) -> DataFrame:
    """The mapping table of replaced spans: scope, fake, original, type, and whether a fake stands for several originals."""
    once = spans.select(*scope, F.col("new").alias("fake"), F.col("value").alias("original"), "type").distinct()
    return once.withColumn("ambiguous", (F.count("*").over(Window.partitionBy(*scope, "fake")) > 1) | (F.col("fake") == "〇"))


_BRACKETS = (("〔", "〕"), ("[", "]"), ("［", "］"), ("【", "】"))


def written_forms(table: DataFrame, scope: list[str]) -> DataFrame:
    """scope, written, original: each way in which a reply may write a fake; of two originals for one, that of the lower rank, then a full
    name rather than a part of it, then the first of the case table.

    Bracketed codes in other brackets, numbers in half-width digits or without separators, false surnames before a title or behind
    "我姓", and the fake itself, which comes first.
    """
    part = (F.col("type") == "PERSON") & (F.col("kind") != "full") if "kind" in table.columns else F.lit(False)
    seq = F.col("seq").cast("long") if "seq" in table.columns else F.lit(0).cast("long")
    # Single characters and words of names serve later runs only.
    whole = table.where(~F.col("ambiguous") & ~F.col("type").isin("GIVEN_CHAR", "ORG_CHAR", "LATIN"))
    plain = whole.select(*scope, "fake", "original", "type", F.coalesce(part, F.lit(False)).alias("_part"), seq.alias("_seq"))
    fake, original = F.col("fake"), F.col("original")
    item = lambda w, o, n: F.struct(w.alias("written"), o.alias("original"), F.lit(n).alias("rank"))
    inner = F.substring(fake, F.lit(2), F.length(fake) - 2)
    forms = [F.array(item(fake, original, 0))]
    forms.append(F.when(fake.startswith("〔"), F.array(*[item(F.concat(F.lit(a), inner, F.lit(b)), original, 1) for a, b in _BRACKETS[1:]])))
    half = half_digits(fake)
    bare = F.regexp_replace(half, r"[\s\-()]", "")
    forms.append(F.when(F.col("type").isin("NUMBER", "CODE") & (F.length(F.regexp_replace(bare, "[^0-9]", "")) >= 6), F.array(item(half, original, 2), item(bare, original, 2))))
    titled = [item(F.concat(fake, F.lit(x)), F.concat(original, F.lit(x)), 3) for x in dict.fromkeys(P.TITLES) if x != "家"]
    before = [item(F.concat(F.lit(x), fake), F.concat(F.lit(x), original), 3) for x in P.SURNAME_AFTER]
    forms.append(F.when(F.col("type") == "SURNAME", F.array(*titled, *before)))
    none = F.array().cast("array<struct<written:string,original:string,rank:int>>")
    each = plain.select(*scope, "type", "_part", "_seq", F.explode(F.concat(*[F.coalesce(f, none) for f in forms])).alias("w")).select(*scope, "type", "_part", "_seq", "w.*")
    # A false surname alone could be part of any word.
    each = each.where(~((F.col("type") == "SURNAME") & (F.col("rank") == 0)))
    return each.groupBy(*scope, F.regexp_replace("written", r"[\s　]", "").alias("written")).agg(F.min(F.struct("rank", "_part", "_seq", "original")).alias("v")).select(*scope, "written", F.col("v.original").alias("original"))


def with_hits(replies: DataFrame, table: DataFrame, scope: list[str], text: str = "text", key: str = "reply_id", hot: DataFrame | None = None) -> DataFrame:
    """`replies` with `hits`, array<struct<start, end, new>>: what to put back, and where.

    A scope's written forms become one automaton, which runs once over each text, so what is put back is never taken for a code. Dates
    in another notation are found by what they mean, in scopes that have false dates.
    """
    forms = written_forms(table, scope).select(*scope, "written", F.col("original").alias("new"))
    found = matched(replies, forms, scope, key, text, hot=hot, codes=True)
    dated = table.where(~F.col("ambiguous") & F.col("type").startswith("DATE")).select(*scope, F.to_json(parse_date(F.col("fake"))).alias("k"), "original").where("k is not null")
    days = dated.groupBy(*scope, "k").agg(F.min("original").alias("o"), F.countDistinct("original").alias("n")).where("n = 1").groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct("k", "o"))).alias("_d"))
    joined = found.join(days, scope, "left")
    other = F.transform(dates(F.col(text)), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.element_at("_d", F.to_json(parse_date(h["value"]))).alias("new")))
    both = longest_first(F.filter(F.concat("hits", F.coalesce(other, F.array().cast(HITS))), lambda h: h["new"].isNotNull()))
    return joined.withColumn("hits", F.when(F.col("_d").isNull(), F.col("hits")).otherwise(both)).drop("_d")


def restored_by_mapping(replies: DataFrame, table: DataFrame, scope: list[str], key: str = "reply_id", text: str = "text", hot: DataFrame | None = None) -> DataFrame:
    """New texts with the values of their scope put back in one pass, the longest form first; ambiguous fakes stay."""
    return with_hits(replies, table, scope, text, key, hot).select(*replies.columns, spliced(F.col(text), F.col("hits"))["text"].alias("restored"))


def guarded(outputs: DataFrame, table: DataFrame, scope: list[str], key: str = "doc_id", rounds: int = 20) -> DataFrame:
    """The mapping with every fake marked ambiguous that would be put back wrongly in the texts it comes from (`outputs`: key, scope,
    rewritten, log): at a place that was not replaced, or with another original.

    One fake fewer can uncover another, so this goes on until nothing is wrong, a few rounds at most. What a round compares
    is the place of each hit with the log, within the row.
    """
    for _ in range(rounds):
        seen = with_hits(outputs.select(key, *[s for s in scope if s != key], F.col("rewritten").alias("text"), "log"), table, scope, key=key)
        inside = lambda h, x: (x["start"] <= h["start"]) & (h["end"] <= x["end"])
        right = lambda h, x: (x["start"] == h["start"]) & (x["end"] == h["end"]) & (canon(x["original"]) == canon(h["new"]))
        wrong = F.filter("hits", lambda h: ~F.exists("log", lambda x: right(h, x) | (inside(h, x) & F.contains(canon(x["original"]), canon(h["new"])))))
        bad = seen.select(*scope, F.explode(F.transform(wrong, lambda h: F.substring("text", h["start"] + 1, h["end"] - h["start"]))).alias("w")).select(*scope, F.regexp_replace("w", r"[\s　]", "").alias("_w")).distinct()
        # The mapping is small beside the texts; it is settled before the next round reads it.
        marked = table.withColumn("_w", F.regexp_replace("fake", r"[\s　]", "")).join(bad.withColumn("_bad", F.lit(True)), [*scope, "_w"], "left")
        after = marked.withColumn("ambiguous", F.col("ambiguous") | F.coalesce("_bad", F.lit(False))).drop("_w", "_bad")
        changed = marked.where(~F.col("ambiguous") & F.col("_bad")).limit(1).count()
        if not changed:
            return table
        table = after.checkpoint() if outputs.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else after
    return table
