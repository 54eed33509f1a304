"""Scalars over found values: canonical form, dates, checksums, labels and shapes, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import CN_DIGIT, ID_LETTERS, MONTHS, UBN_WEIGHTS
from .spans import let

FULL_DIGITS, HALF_DIGITS = "０１２３４５６７８９", "0123456789"


def half_digits(s: Column) -> Column:
    return F.translate(s, FULL_DIGITS, HALF_DIGITS)


def canon(s: Column) -> Column:
    """Without white space of any kind, full-width digits as ASCII."""
    return half_digits(F.regexp_replace(s, r"(?U)\s", ""))


def digits(s: Column) -> Column:
    return F.regexp_replace(half_digits(s), "[^0-9]", "")


def cn_number(s: Column) -> Column:
    """Chinese numerals: digit by digit (years), or tens and units up to 99; null for anything else."""
    plain = F.translate(s, "〇○零一二三四五六七八九", "000123456789")
    tens, units = F.substring_index(plain, "十", 1), F.substring_index(plain, "十", -1)
    with_ten = F.when(tens == "", 1).otherwise(tens.try_cast("int")) * 10 + F.when(units == "", 0).otherwise(units.try_cast("int"))
    return F.when(plain.contains("十"), with_ten).otherwise(plain.try_cast("int"))


def parse_date(s: Column) -> Column:
    """struct<y, m, d>: y is null when not written, d is 1; null if no notation fits. Years stay as written (ROC under 1000)."""
    clean = half_digits(F.regexp_replace(s, r"(?<=[0-9０-９/.／-])\s+(?=[0-9０-９/.／-])", ""))
    # Bound once, as every notation reads it.
    return let(clean, _parsed)


def _parsed(t: Column) -> Column:
    def fields(pattern: str, y: int | None, m: int, d: int | None, read=lambda c: c.try_cast("int")) -> Column:
        part = lambda i: read(F.regexp_extract(t, pattern, i))
        year = F.lit(None).cast("int") if y is None else part(y)
        day = F.lit(1) if d is None else F.coalesce(part(d), F.lit(1))
        return F.when(F.regexp_extract(t, pattern, 0) != "", F.struct(year.alias("y"), part(m).alias("m"), day.alias("d")))

    cn = f"[{CN_DIGIT}]"
    month = "|".join(x[:3] for x in MONTHS)
    named = rf"(?:([0-9]{{1,2}}) )?({month})[a-z]*\.?(?: ([0-9]{{1,2}})(?:st|nd|rd|th)?(?![0-9]))?(?:,? ([0-9]{{4}}))?"
    part = lambda i: F.regexp_extract(t, named, i).try_cast("int")
    index = F.array_position(F.array(*[F.lit(x[:3]) for x in MONTHS]), F.regexp_extract(t, named, 2)).cast("int")
    english = F.when(index > 0, F.struct(part(4).alias("y"), index.alias("m"), F.coalesce(part(1), part(3), F.lit(1)).alias("d")))
    return F.coalesce(
        fields(r"([0-9]{2,4})\s?年\s?([0-9]{1,2})\s?月\s?([0-9]{1,2})", 1, 2, 3),
        fields(r"([0-9]{4})[-/.／]([0-9]{1,2})[-/.／]([0-9]{1,2})", 1, 2, 3),
        fields(r"([0-9]{2,3})[/.／]([0-9]{1,2})[/.／]([0-9]{1,2})", 1, 2, 3),
        fields(r"([0-9]{2,4})\s?年\s?([0-9]{1,2})\s?月", 1, 2, None),
        fields(r"([0-9]{1,2})\s?月\s?([0-9]{1,2})", None, 1, 2),
        fields(r"([0-9]{1,2})[/／]([0-9]{1,2})", None, 1, 2),
        fields(r"^([0-9]{2,4})([0-9]{2})([0-9]{2})$", 1, 2, 3),
        fields(rf"({cn}{{2,4}})年({cn}{{1,3}})月(?:({cn}{{1,3}})[日號])?", 1, 2, 3, cn_number),
        english,
    )


def gregorian(y: Column) -> Column:
    return F.when(y < 1000, y + 1911).otherwise(y)


def coarse_date(s: Column, level: str) -> Column:
    """Year ("year") or year and month ("month") in the value's own notation; null if it can't be told."""
    head = F.when(s.contains("民國"), "民國").otherwise("")

    def body(p: Column) -> Column:
        year = F.when(p["y"].isNull(), "").otherwise(F.concat(p["y"].cast("string"), F.lit("年")))
        name = F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.least(p["m"], F.lit(12)), F.lit(1)))
        latin = s.rlike("[A-Za-z]")
        if level == "year":
            out = F.when(latin, p["y"].cast("string")).otherwise(F.concat(head, year))
        else:
            out = F.when(latin, F.concat_ws(" ", name, p["y"].cast("string"))).otherwise(F.concat(head, year, p["m"].cast("string"), F.lit("月")))
        bad = p.isNull() | ~p["m"].between(1, 12)
        return F.when(~(bad | p["y"].isNull() if level == "year" else bad), out)

    return let(parse_date(s), body)


def luhn_ok(d: Column) -> Column:
    """13 to 19 digits with a right Luhn sum."""
    return F.coalesce(d.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", F.when(d.rlike("^[0-9]{13,19}$"), d)), F.lit(False))


def ubn_ok(d: Column) -> Column:
    """Business number: eight digits, digit sums of weighted digits divisible by 5; a 7 in place seven may count one more."""
    at = lambda i: F.substring(d, i, 1).try_cast("int")
    total = F.lit(0)
    for i, w in enumerate(UBN_WEIGHTS, 1):
        p = at(i) * w
        total = total + F.floor(p / 10) + p % 10
    ok = (total % 5 == 0) | ((at(7) == 7) & ((total + 1) % 5 == 0))
    return F.coalesce(d.rlike("^[0-9]{8}$") & ok, F.lit(False))


def id_check_digit(letter: Column, body: Column) -> Column:
    """Check digit of a national id: its letter, and the eight digits after it."""
    n = F.instr(F.lit(ID_LETTERS), letter) + 9
    total = F.floor(n / 10) + (n % 10) * 9
    for i in range(8):
        total = total + F.substring(body, i + 1, 1).try_cast("int") * (8 - i)
    return ((10 - total % 10) % 10).cast("int")


def id_ok(s: Column) -> Column:
    good = s.rlike("^[A-Z][1289][0-9]{8}$")
    return F.coalesce(good & (id_check_digit(F.substring(s, 1, 1), F.substring(s, 2, 8)) == F.substring(s, 10, 1).try_cast("int")), F.lit(False))


def keep_head(s: Column) -> Column:
    """How many leading digits of a number stay: country, area, mobile or bank prefix; four digits at least change."""
    d = digits(s)
    zeros = F.length(d) - F.length(F.regexp_replace(d, "^0+", ""))
    k = (
        F.when(F.ltrim(s).startswith("+886") | d.startswith("886"), 4)
        .when(s.rlike(r"^[0-9]{3}-"), 3)
        .when(zeros >= 2, zeros)
        .when(d.rlike("^0[2-9]"), 2)
        .otherwise(0)
    )
    return F.least(k, F.greatest(F.length(d) - 4, F.lit(0))).cast("int")


def shaped(s: Column, key: Column, keep: Column | int = 0) -> Column:
    """Other characters of the same class in each place, from a keyed hash; the first `keep` letters and digits stay."""
    keep = F.lit(keep) if isinstance(keep, int) else keep
    chars = F.split(s, "")
    plain = F.regexp_replace(s, r"[^0-9A-Za-z０-９]", "")

    def other(c: Column, i: Column) -> Column:
        # Letters and digits up to here, this one not counted.
        rank = F.length(F.regexp_replace(F.substring(s, F.lit(1), i), r"[^0-9A-Za-z０-９]", ""))
        h = F.pmod(F.xxhash64(key, i), F.lit(260)).cast("int")
        pick = lambda letters, n: F.substring(F.lit(letters), h % n + 1, F.lit(1))
        new = (
            F.when(c.rlike("[0-9]"), pick(HALF_DIGITS, 10))
            .when(c.rlike("[０-９]"), pick(FULL_DIGITS, 10))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", 26))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))
            .otherwise(c)
        )
        return F.when(rank < keep, c).otherwise(new)

    return F.when(plain == "", s).otherwise(F.array_join(F.transform(chars, other), ""))


def value_label(s: Column) -> Column:
    """Kind of a masked value, for codes such as 〔Email 1〕."""
    d = digits(s)
    return (
        F.when(s.contains("@") & s.rlike(r"@[A-Za-z0-9\-]+\."), "Email")
        .when(s.rlike("^(?:https?://|line://|www\\.)") | s.rlike(r"\.[a-z]{2,}/"), "網址")
        .when(s.startswith("@"), "帳號")
        .when(s.rlike("^[A-Z][1289A-D][0-9]{8}$"), "身分證")
        .when(d.rlike("^(?:886|0)9[0-9]{8}$") | (d.rlike("^0[2-8][0-9]{7,8}$") & s.rlike("[-()（）]")), "電話")
        .otherwise("號碼")
    )


def cn_text(n: Column) -> Column:
    """1 to 99 in Chinese numerals."""
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    digit = lambda k: F.substring(F.lit("〇一二三四五六七八九"), k + 1, F.lit(1))
    return F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise(""))


def in_notation(s: Column, y: Column, m: Column, d: Column) -> Column:
    """A date (the year as `s` counts it) in the notation of `s`: era, padding, separators, numerals and month names stay. Null if `s` has
    no notation with a day."""
    t = half_digits(s)

    def padded(n: Column, like: Column) -> Column:
        return F.when(like.startswith("0"), F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))

    def numeric(pattern: str, parts: list[Column]) -> Column:
        """Numbers in groups 1, 3, 5 of the pattern, separators in 2 and 4."""
        group = lambda i: F.regexp_extract(t, pattern, i)
        new = F.concat(*[x for i, n in enumerate(parts) for x in ([padded(n, group(2 * i + 1))] + ([group(2 * i + 2)] if i + 1 < len(parts) else []))])
        return F.when(group(0) != "", F.regexp_replace(t, F.lit(pattern), new))

    cn = f"([{CN_DIGIT}]{{2,4}})年([{CN_DIGIT}]{{1,3}})月([{CN_DIGIT}]{{1,3}})([日號])"
    chinese = F.when(
        F.regexp_extract(s, cn, 0) != "",
        F.regexp_replace(s, F.lit(cn), F.concat(F.translate(y.cast("string"), "0123456789", "〇一二三四五六七八九"), F.lit("年"), cn_text(m), F.lit("月"), cn_text(d), F.regexp_extract(s, cn, 4))),
    )
    names = "|".join(MONTHS)
    name = F.element_at(F.array(*map(F.lit, MONTHS)), m)
    first, second = rf"({names}) ([0-9]{{1,2}})(,? )([0-9]{{4}})", rf"([0-9]{{1,2}}) ({names})( )([0-9]{{4}})"
    english = F.coalesce(
        F.when(F.regexp_extract(t, first, 0) != "", F.regexp_replace(t, F.lit(first), F.concat(name, F.lit(" "), d.cast("string"), F.regexp_extract(t, first, 3), y.cast("string")))),
        F.when(F.regexp_extract(t, second, 0) != "", F.regexp_replace(t, F.lit(second), F.concat(d.cast("string"), F.lit(" "), name, F.lit(" "), y.cast("string")))),
    )
    sep = r"([-/.／])"
    return F.coalesce(
        numeric(r"([0-9]{2,4})(\s?年\s?)([0-9]{1,2})(\s?月\s?)([0-9]{1,2})", [y, m, d]),
        numeric(rf"([0-9]{{4}}){sep}([0-9]{{1,2}}){sep}([0-9]{{1,2}})", [y, m, d]),
        numeric(r"([0-9]{2,3})([/.／])([0-9]{1,2})([/.／])([0-9]{1,2})", [y, m, d]),
        numeric(r"([0-9]{1,2})(\s?月\s?)([0-9]{1,2})", [m, d]),
        chinese,
        english,
    )


def shifted_date(s: Column, days: Column) -> Column:
    """The date `days` later in the notation of `s`. Null if `s` is no calendar date. Dates without a year move within 2000."""

    def body(p: Column) -> Column:
        day = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", F.coalesce(gregorian(p["y"]), F.lit(2000)), p["m"], p["d"]), F.lit("yyyy-MM-dd")).cast("date")
        moved = F.date_add(day, days)
        y = F.when(p["y"] < 1000, F.year(moved) - 1911).otherwise(F.year(moved))
        return F.when(day.isNotNull(), in_notation(s, y, F.month(moved), F.dayofmonth(moved)))

    return let(parse_date(s), body)


def day_number(s: Column) -> Column:
    """Days since 1970 of a date with a year; null for others."""
    text = lambda p: F.format_string("%04d-%02d-%02d", gregorian(p["y"]), p["m"], p["d"])
    return let(parse_date(s), lambda p: F.when(p["y"].isNotNull(), F.unix_date(F.try_to_timestamp(text(p), F.lit("yyyy-MM-dd")).cast("date"))))


def unscanned(s: Column) -> Column:
    """`canon` also without what scanning leaves between characters."""
    return F.regexp_replace(canon(s), r"[\^|_•⑴⑵⑶¦¬`~'·;；]", "")


def place_name(s: Column) -> Column:
    """Without white space, 臺 as 台: the form in which lists of places and companies are compared."""
    return F.translate(F.regexp_replace(s, r"(?U)\s", ""), "臺", "台")


def written_date(y: Column, m: Column, d: Column, notation: Column) -> Column:
    """A Gregorian date in a notation: 0 民國, 1 slashes, 2 Chinese numerals of the ROC year, 3 English, else 年月日."""
    roc = (y - 1911).cast("string")
    text = lambda n: n.cast("string")
    name = F.element_at(F.array(*map(F.lit, MONTHS)), m)
    numerals = F.translate(roc, HALF_DIGITS, "〇一二三四五六七八九")
    return (
        F.when(notation == 0, F.concat(F.lit("民國"), roc, F.lit("年"), text(m), F.lit("月"), text(d), F.lit("日")))
        .when(notation == 1, F.concat_ws("/", text(y), text(m), text(d)))
        .when(notation == 2, F.concat(numerals, F.lit("年"), cn_text(m), F.lit("月"), cn_text(d), F.lit("日")))
        .when(notation == 3, F.concat(name, F.lit(" "), text(d), F.lit(", "), text(y)))
        .otherwise(F.concat(text(y), F.lit("年"), text(m), F.lit("月"), text(d), F.lit("日")))
    )


def sampled(u: Column, items: list[str], weights: list[int]) -> Column:
    """The item in whose share of the summed weights a number from 0 to 1 falls."""
    total, ends = sum(weights), []
    for w in weights:
        ends.append((ends[-1] if ends else 0) + w)
    place = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.floor(u * total)))
    return F.element_at(F.array(*map(F.lit, items)), F.least(place + 1, F.lit(len(items))))


def pronounceable(s: Column, key: Column) -> Column:
    """Letters of the same case that can be spoken, consonant after vowel, in place of each ASCII letter; other digits for digits."""
    consonants, vowels = "bcdfghjklmnprstvz", "aeiou"

    def other(c: Column, i: Column) -> Column:
        h = F.pmod(F.xxhash64(key, i, F.lit("word")), F.lit(1 << 20)).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), h % len(letters) + 1, F.lit(1))
        letter = F.when(i % 2 == 0, pick(consonants)).otherwise(pick(vowels))
        return F.when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike("[0-9]"), pick(HALF_DIGITS)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), other), "")
