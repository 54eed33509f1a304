"""Realistic pseudonyms of persons, organisations and addresses, consistent in a scope.

Within a scope each real surname, character of a given name or brand, and Latin word has a stand-in of its own (`assign`), however many
there are.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import flat_map, let, quoted
from ..functions.values import canon, day_number, shaped
from ..plans.shared import kept, unsent
from .assign import LONGEST, Pool, assigned
from .gazetteer import Gazetteer
from .names import surname_length

#: Stand-ins: characters of given names and of brands, words of Latin names, and roads.
GIVEN_POOL = "安柏辰昕宥恩語禾子芮晴朗澄沐川岳衡謙睿哲凡亦可心悅寧柔菲苓葳樂舟帆嵐硯彥霖祐翊棠槿瑀珩昀晏劭煦鈞丞奕宸凱翔宇恆毅誠信義和平順達榮昌隆盛祥瑞豐裕泰永久長青松竹梅蘭菊荷蓮桂楓桐"
BRAND_POOL = "恆創聯合嘉盛禾豐景泰晶鴻崧岱瀚沛穎捷騰欣榮昌隆盛祥瑞裕永青松翠碧曜旭晟昱耀輝煌燦熙煜焱森林楷梓楠榆槐桓桀栩柏植棋楨樺樸橋機檀櫻"
LATIN_POOL = "Alden Bryce Carter Dalton Elliot Fenton Graham Harlan Irving Jarvis Keaton Landon Merrill Nolan Orson Porter Quincy Rowan Sutton Truman Upton Vaughn Warren Yates Zander".split()
ROAD_POOL = "中山路 中華路 民權路 民生路 和平路 復興路 建國路 光復路 成功路 自強路 文化路 大同路 仁愛路 信義路 忠孝路 三民路".split()


#: Syllables of the Latin names that go on when those of the list are used.
SYLLABLES = tuple(c + v for c in "bdfghjklmnprstvz" for v in "aeiou")
#: What a part becomes that has no stand-in, so that an original never comes through.
NOTHING = "〇"


def _hash(*parts: Column | str) -> Column:
    return F.xxhash64(*parts)


def _unique(chars: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(chars))


@cache
def surname_pool(length: int) -> Pool:
    """Surnames for those of one character: safe ones, then the other surnames, then safe ones joined by three, five, ...; for longer ones
    safe ones joined by two, four, ..., so the two never meet."""
    safe = _unique(P.SAFE_SURNAMES)
    rest = tuple(c for c in _unique(P.SURNAMES) if c not in safe)
    return Pool((safe, rest), safe, tuple(range(3, LONGEST + 1, 2))) if length == 1 else Pool((), safe, tuple(range(2, LONGEST + 1, 2)))


@cache
def character_pool(chars: str) -> Pool:
    """Characters of given names or brands: a list, the common block, the first extension, and then several of the list."""
    return Pool((_unique(chars),), _unique(chars), tuple(range(2, 6)), ((0x4E00, 0x9FA5), (0x3400, 0x4DB5)))


@cache
def latin_pool() -> Pool:
    return Pool((tuple(x.lower() for x in LATIN_POOL),), SYLLABLES, (2, 3, 4))


def held(docs: DataFrame, scope: list[str], text: str = "text") -> DataFrame:
    """scope, value: which surnames of the pools the texts of a scope hold, those of several characters too."""
    singles = F.array_intersect(F.array_distinct(F.split(F.col(text), "")), F.split(F.lit(" ".join(_unique(P.SAFE_SURNAMES + P.SURNAMES))), " "))
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{P.SAFE_SURNAMES}]{{2,}})"), 1)
    part = lambda r: flat_map(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.transform(F.sequence(F.lit(2), F.least(F.length(r) - i + 1, F.lit(LONGEST))), lambda n: F.substring(r, i, n)))
    return docs.select(*scope, F.explode(F.array_distinct(F.concat(singles, flat_map(runs, part)))).alias("value")).distinct()


def surname_map(names: DataFrame, scope: list[str], salt: str, forbidden: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """scope, surname, fake: a surname for each real one of a scope (`names`: scope, surname); no two share one, and none is a real one
    of the scope or `forbidden` (scope, value) there. `known` (scope, surname, fake) of earlier runs stays."""
    originals = names.select(*scope, F.col("surname").alias("original")).distinct()
    # Real surnames of either length are forbidden to both.
    banned = originals.select(*scope, F.col("original").alias("value"))
    banned = banned if forbidden is None else banned.unionByName(forbidden.select(*scope, "value"))
    earlier = None if known is None else known.select(*scope, F.col("surname").alias("original"), "fake")
    short = F.length("original") == 1
    made = [assigned(originals.where(short if n == 1 else ~short), scope, surname_pool(n), salt, banned, earlier) for n in (1, 2)]
    return made[0].unionByName(made[1]).select(*scope, F.col("original").alias("surname"), "fake")


def characters(values: DataFrame, scope: list[str], salt: str, pool: str, known: DataFrame | None = None) -> DataFrame:
    """scope, original, fake: another character for each Han character of the values (`values`: scope, value), one to one in a scope."""
    chars = values.select(*scope, F.explode(F.regexp_extract_all("value", F.lit(f"([{P.HAN}々])"), 1)).alias("original"))
    return assigned(chars, scope, character_pool(pool), salt, None, known)


def rewritten_values(values: DataFrame, scope: list[str], units: DataFrame, pieces: Column) -> DataFrame:
    """scope, value, new: each value with its pieces (an array of strings) replaced where `units` (scope, original, fake) has them.

    Pieces of distinct values are joined one by one, so no scope's units come together in a row. A Han character without a stand-in
    becomes NOTHING."""
    once = values.select(*scope, "value").distinct()
    each = once.select(*scope, "value", F.posexplode(pieces).alias("i", "original")).join(unsent(units), [*scope, "original"], "left")
    new = F.coalesce("fake", F.when(F.col("original").rlike(f"[{P.HAN}々]"), NOTHING).otherwise(F.col("original")))
    put = each.groupBy(*scope, "value").agg(F.sort_array(F.collect_list(F.struct("i", new.alias("p")))).alias("a"))
    return put.select(*scope, "value", F.array_join(F.transform("a", lambda x: x["p"]), "").alias("new"))


def name_parts(spans: DataFrame, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Person spans (value, kind) with `_head` (老, 小, 阿), `_sur`, `_given` and `_latin`, of which their stand-ins are made."""
    g = gazetteer or Gazetteer()
    core = canon(F.col("value"))
    n = surname_length(core, g)
    head = F.regexp_extract(core, "^[老小阿](?=.)", 0)
    body = F.substring(core, F.length(head) + 1, F.length(core))
    latin, dotted = core.rlike("[A-Za-z]"), core.rlike("[·‧・．]")
    nick = F.col("kind") == "nick"
    by_name = nick & head.isin("老", "小") & (surname_length(body, g) == F.length(body)) & (body != "")
    whole = ~nick & ~F.col("kind").isin("given", "given2") & ~latin & ~dotted & (n > 0)
    sur = F.when(latin | dotted, "").when(by_name, body).when(nick, "").when(whole, F.substring(core, F.lit(1), n)).otherwise("")
    given = F.when(latin | by_name, "").when(nick, body).when(whole, F.substring(core, n + 1, F.length(core))).otherwise(core)
    return spans.withColumns({"_head": F.when(nick & ~latin, head).otherwise(""), "_sur": sur, "_given": given, "_latin": latin})


def persons(spans: DataFrame, scope: list[str], salt: str, gazetteer: Gazetteer | None = None, context: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Person spans (value, kind) with `new`.

    Surnames go by `surname_map`, given names, nicknames and transliterations character by character, Latin names word by word, each one
    to one in a scope, so that parts of a name follow the full one, titles stay, and names that differ in one character still do.
    `context` (scope, value, of `held`) are surnames that the scope's texts hold: as no false surname stands in them, no false
    full name does. `known` (scope, part, original, fake; of `parts_of`) keeps what earlier runs assigned.
    """
    # Written, as each kind of part reads it.
    parsed = kept(name_parts(spans, gazetteer), "names")
    earlier = (lambda part: None) if known is None else (lambda part: known.where(F.col("part") == part).select(*scope, "original", "fake"))
    named = parsed.where("_sur <> ''").select(*scope, F.col("_sur").alias("surname")).distinct()
    before = earlier("SURNAME")
    surs = surname_map(named, scope, salt, context, None if before is None else before.withColumnRenamed("original", "surname")).select(*scope, F.col("surname").alias("_sur"), F.col("fake").alias("_fake_sur"))
    given = parsed.where("_given <> ''").select(*scope, F.col("_given").alias("value")).distinct()
    chars = characters(given, scope, salt, GIVEN_POOL, earlier("GIVEN_CHAR"))
    givens = rewritten_values(given, scope, chars, F.filter(F.split("value", ""), lambda c: c != "")).select(*scope, F.col("value").alias("_given"), F.col("new").alias("_fake_given"))
    words = F.regexp_extract_all("value", F.lit(f"[A-Za-z]+|[{P.HAN}]|[^A-Za-z{P.HAN}]"), 0)
    latin = parsed.where("_latin").select(*scope, "value").distinct()
    parts = latin.select(*scope, F.explode(words).alias("w"))
    units = assigned(parts.where("w rlike '^[A-Za-z]{2,}$'").select(*scope, F.lower("w").alias("original")), scope, latin_pool(), salt, None, earlier("LATIN"))
    han = characters(parts.where(F.col("w").rlike(f"^[{P.HAN}]$")).select(*scope, F.col("w").alias("value")), scope, salt + "latin", P.SAFE_SURNAMES)
    each = latin.select(*scope, "value", F.posexplode(words).alias("i", "w")).withColumn("original", F.lower("w")).join(unsent(units.unionByName(han)), [*scope, "original"], "left")
    made = F.when(F.col("w").rlike("^[A-Z]{2,}$"), F.upper("fake")).when(F.col("w").rlike("^[A-Z]"), F.initcap("fake")).otherwise(F.col("fake"))
    loose = F.when(F.col("w").rlike(f"[{P.HAN}]"), NOTHING).otherwise(F.col("w"))
    put = each.groupBy(*scope, "value").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce(made, loose).alias("p")))).alias("a")).select(*scope, "value", F.array_join(F.transform("a", lambda x: x["p"]), "").alias("_fake_latin"))
    joined = parsed.join(unsent(surs), [*scope, "_sur"], "left").join(unsent(givens), [*scope, "_given"], "left").join(unsent(put), [*scope, "value"], "left")
    sur = F.when(F.col("_sur") == "", "").otherwise(F.coalesce("_fake_sur", F.lit(NOTHING)))
    name = F.when(F.col("_given") == "", "").otherwise(F.coalesce("_fake_given", F.lit(NOTHING)))
    new = F.when(F.col("_latin"), F.coalesce("_fake_latin", F.lit(NOTHING))).otherwise(F.concat("_head", sur, name))
    return joined.withColumn("new", new).select(*spans.columns, "new")


def parts_of(named: DataFrame, scope: list[str], gazetteer: Gazetteer | None = None) -> DataFrame:
    """scope, part, original, fake: the surnames, characters and Latin words behind person spans that have their `new`, for later runs."""
    parsed = name_parts(named, gazetteer)
    size = F.length("_fake_sur")
    split = parsed.withColumn("_tail", F.substring("new", F.length("_head") + 1, F.length("new"))).withColumn("_fake_sur", F.when(F.col("_sur") == "", "").otherwise(F.substring("_tail", F.lit(1), F.length("_tail") - F.length("_given"))))
    split = split.withColumn("_fake_given", F.substring("_tail", size + 1, F.length("_tail")))
    surs = split.where("_sur <> '' and not _latin").select(*scope, F.lit("SURNAME").alias("part"), F.col("_sur").alias("original"), F.col("_fake_sur").alias("fake"))
    pairs = F.arrays_zip(F.filter(F.split("_given", ""), lambda c: c != "").alias("o"), F.filter(F.split("_fake_given", ""), lambda c: c != "").alias("f"))
    chars = split.where("_given <> '' and not _latin and length(_given) = length(_fake_given)").select(*scope, F.explode(pairs).alias("p")).select(*scope, F.lit("GIVEN_CHAR").alias("part"), F.col("p.o").alias("original"), F.col("p.f").alias("fake"))
    latin = lambda c: F.regexp_extract_all(c, F.lit("([A-Za-z]{2,})"), 1)
    words = split.where("_latin").select(*scope, F.explode(F.arrays_zip(latin("value").alias("o"), latin("new").alias("f"))).alias("p")).select(*scope, F.lit("LATIN").alias("part"), F.lower("p.o").alias("original"), F.lower("p.f").alias("fake"))
    return surs.unionByName(chars.where(F.col("original").rlike(f"[{P.HAN}々]"))).unionByName(words).where("original is not null and fake is not null and original <> fake").distinct()


def name_pieces(name: Column, gazetteer: Gazetteer | None = None) -> Column:
    """Pieces of an organisation name: forms, trades and cities, Latin words, and single characters."""
    g = gazetteer or Gazetteer()
    keep = quoted({*g.suffixes, *P.TRADE_WORDS, *g.place(g.cities)})
    return F.regexp_extract_all(name, F.lit(rf"(?:{keep})|[A-Za-z0-9]+|[\s\S]"), 0)


def brand_parts_of(named: DataFrame, scope: list[str], gazetteer: Gazetteer | None = None) -> DataFrame:
    """scope, part, original, fake: the characters of brands behind organisation spans that have their `new`, for later runs."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    pairs = F.arrays_zip(chars(F.col("value")).alias("o"), chars(F.col("new")).alias("f"))
    each = named.where("length(value) = length(new)").select(*scope, F.explode(pairs).alias("p")).where(F.col("p.o") != F.col("p.f"))
    return each.select(*scope, F.lit("ORG_CHAR").alias("part"), F.col("p.o").alias("original"), F.col("p.f").alias("fake")).where(F.col("original").rlike(f"[{P.HAN}]")).distinct()


def organisations(spans: DataFrame, scope: list[str], salt: str, gazetteer: Gazetteer | None = None, known: DataFrame | None = None) -> DataFrame:
    """Organisation spans with `new`: forms, trades and cities stay, characters of the brand are replaced, one to one in a scope, Latin letters
    and digits by others of their class. `known` (of `brand_parts_of`) keeps what earlier runs assigned."""
    pieces = name_pieces(F.col("value"), gazetteer)
    once = spans.select(*scope, "value").distinct().withColumn("_parts", pieces)
    loose = lambda p: (F.length(p) == 1) & p.rlike(f"[{P.HAN}]")
    before = None if known is None else known.where("part = 'ORG_CHAR'").select(*scope, "original", "fake")
    brands = once.select(*scope, F.array_join(F.filter("_parts", loose), "").alias("value")).where("value <> ''")
    chars = characters(brands, scope, salt, BRAND_POOL, before)
    salted = F.concat_ws("|", *[F.col(c).cast("string") for c in scope], F.lit(salt))
    forms = r"(?i)^(?:co|ltd|inc|corp|corporation|company|limited|llc|group|holdings)$"
    p = F.col("p")
    each = once.select(*scope, "value", F.posexplode("_parts").alias("i", "p")).withColumn("original", F.when(loose(p), p)).join(unsent(chars), [*scope, "original"], "left")
    part = F.when(loose(p), F.coalesce("fake", F.lit(NOTHING))).when(p.rlike("^[A-Za-z0-9]+$") & ~p.rlike(forms), shaped(p, F.concat(salted, p))).otherwise(p)
    put = each.groupBy(*scope, "value").agg(F.sort_array(F.collect_list(F.struct("i", part.alias("n")))).alias("a")).select(*scope, "value", F.array_join(F.transform("a", lambda x: x["n"]), "").alias("new"))
    return spans.join(unsent(put), [*scope, "value"], "left")


def addresses(spans: DataFrame, scope: list[str], salt: str, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Address spans with `new`: post code, city and district stay, the road is another, numbers change but for the floor; land lots get other
    numbers. The same address of a scope has the same stand-in."""
    g = gazetteer or Gazetteer()
    v = F.col("value")
    district = quoted(g.place(g.districts)) if g.districts else f"[{P.HAN}]{{1,3}}?[區鄉鎮市]"
    head = F.regexp_extract(v, rf"^(?:[{P.DIGIT}]{{3,6}}\s?)?(?:{quoted(g.place(g.cities))})?(?:{district})?", 0)
    rest = F.substring(v, F.length(head) + 1, F.length(v))
    road = F.regexp_extract(rest, f"^[{P.HAN}]{{1,6}}?(?:路|街|大道)", 0)
    tail = F.substring(rest, F.length(road) + 1, F.length(rest))
    roads = F.array(*map(F.lit, sorted(g.roads) or ROAD_POOL))
    salted = F.concat_ws("|", *[F.col(c).cast("string") for c in scope], canon(v), F.lit(salt))
    others = F.filter(roads, lambda r: r != road)
    new_road = F.when(road == "", "").otherwise(let(others, lambda o: F.element_at(o, (F.pmod(_hash(salted), F.size(o)) + 1).cast("int"))))
    numbers = F.regexp_extract_all(tail, F.lit(rf"[{P.DIGIT}]+ ?樓|[{P.DIGIT}]+|[^{P.DIGIT}]+"), 0)

    def other(x: Column, i: Column) -> Column:
        n = F.length(x)
        drawn = F.pmod(_hash(salted, i), F.pow(F.lit(10.0), n).cast("long") - F.pow(F.lit(10.0), n - 1).cast("long")) + F.pow(F.lit(10.0), n - 1).cast("long")
        # The part of a lot that a number like 123-4 names stays.
        part = (i > 0) & F.endswith(F.get(numbers, i - 1), F.lit("-"))
        return F.when(x.rlike(f"^[{P.DIGIT}]+$") & (n < 15) & ~part, drawn.cast("string")).otherwise(x)

    return spans.withColumn("new", F.concat(head, new_road, F.array_join(F.transform(numbers, other), "")))


#: Days by which the event dates of a case may move.
_NEAR, _FAR = 28, 182
SHIFTS = [x for n in range(_NEAR, _FAR + 1) for x in (n, -n)]


def case_shifts(spans: DataFrame, scope: list[str], salt: str) -> DataFrame:
    """scope, shift: days by which all event dates of a scope move, so that intervals stay and no moved day is a day of the scope.

    Of the dates of a scope (`spans`: type, value) each event's day meets the days of the scope near it; shifts that lead to one of them,
    whatever its notation, are blocked, and the first that is left is taken, whole weeks first and then in a keyed order. Where all
    are blocked the dates move behind the last of them. A scope's days are joined by the day, never each with each.
    """
    dated = spans.where(F.col("type").startswith("DATE")).select(*scope, "type", day_number(F.col("value")).alias("day")).where("day is not null").distinct()
    days = dated.select(*scope, "day").distinct()
    # Days meet only those of their own span of time and the two beside it.
    span = lambda day: F.floor(day / (_FAR + 1))
    laid = dated.where("type = 'DATE_EVENT'").select(*scope, F.col("day").alias("_from"), F.explode(F.sequence(span(F.col("day")) - 1, span(F.col("day")) + 1)).alias("_span"))
    near = laid.join(unsent(days.withColumn("_span", span(F.col("day")))), [*scope, "_span"]).withColumn("shift", (F.col("day") - F.col("_from")).cast("int"))
    met = near.where(F.abs("shift").between(_NEAR, _FAR)).groupBy(*scope).agg(F.collect_set("shift").alias("_b"))
    spread = days.groupBy(*scope).agg((F.max("day") - F.min("day") + 28).cast("int").alias("_far"))
    per = spans.select(*scope).distinct().join(unsent(met), scope, "left").join(unsent(spread), scope, "left")
    order = F.array_sort(F.transform(F.array(*map(F.lit, SHIFTS)), lambda n: F.struct((n % 7 != 0).alias("odd"), F.xxhash64(n, F.lit(salt), *scope).alias("h"), n.alias("n"))))
    left = F.filter(order, lambda x: ~F.array_contains(F.coalesce("_b", F.array().cast("array<int>")), x["n"]))
    return per.select(*scope, F.coalesce(F.get(left, F.lit(0))["n"], F.col("_far")).cast("int").alias("shift"))


def pseudonyms(spans: DataFrame, scope: list[str], salt: str, keep_head: Column) -> DataFrame:
    """`new` for numbers and codes: the same value of a scope always gets the same value of the same shape."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in scope], canon(F.col("value")), F.lit(salt))
    return spans.withColumn("new", shaped(F.col("value"), key, keep_head))
