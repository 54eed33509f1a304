"""Candidate spans with Catalyst only: each generator is a projection that makes an array of spans for each row, so that no text
is shuffled and no Python runs. Output rows: id, start, end, kind, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import before, char_at, distinct_sorted, flat_map, let, match_spans, row
from . import tolerant


def typed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def emails(text: Column) -> Column:
    return match_spans(text, P.EMAIL)


def urls(text: Column) -> Column:
    """URLs without the punctuation that ends a sentence."""

    def trimmed(x: Column) -> Column:
        value = F.regexp_replace(x["value"], r"[.,;:!?)\]」』'\"`>]+$", "")
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(value)).cast("int").alias("end"), value.alias("value"))

    return F.transform(match_spans(text, P.URL), trimmed)


def dates(text: Column) -> Column:
    """All notations, each also without the name of its era."""
    found = F.flatten(F.array(*[match_spans(text, p) for p in P.DATES]))

    def bare(x: Column) -> Column:
        rest = F.regexp_replace(x["value"], r"^(?:中華民國|民國|西元)\s?", "")
        return F.struct((x["end"] - F.length(rest)).cast("int").alias("start"), x["end"].alias("end"), rest.alias("value"))

    return let(found, lambda a: distinct_sorted(F.concat(a, F.transform(a, bare))))


def tokens(text: Column) -> Column:
    """ASCII tokens of three characters or more: alnum with letter and digit, handle with letters only; @x also as x."""

    def kinds(x: Column) -> Column:
        v = x["value"]
        kind = F.when(v.rlike("[0-9]") & v.rlike("[A-Za-z]"), "alnum").when(v.rlike("[A-Za-z]"), "handle")
        full = F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), v.alias("value"))
        bare = F.struct((x["start"] + 1).cast("int").alias("start"), x["end"].alias("end"), kind.alias("kind"), F.substring(v, F.lit(2), F.length(v)).alias("value"))
        out = F.when(v.startswith("@"), F.array(full, bare)).otherwise(F.array(full))
        return F.when(kind.isNull() | (F.length(F.ltrim(v)) - F.when(v.startswith("@"), 1).otherwise(0) < 3), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")).otherwise(out)

    return F.flatten(F.transform(match_spans(text, P.TOKEN), kinds))


def secrets(text: Column) -> Column:
    """Runs of printable ASCII: the run itself (6 to 64 characters with letter and digit), and values behind = or : or
    before @ inside it."""

    def mixed(v: Column) -> Column:
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]")

    def parts(x: Column) -> Column:
        head = F.length(x["value"]) - F.length(F.regexp_replace(x["value"], r"^[`'\"(<\[=:]+", ""))
        return let(F.struct((x["start"] + head).alias("s"), F.substring(x["value"], head + 1, F.length(x["value"])).alias("whole")), begun)

    def begun(b: Column) -> Column:
        return let(F.regexp_replace(b["whole"], r"[.,;:!?)\]」』'\"`>]+$", ""), lambda core: found(b["s"], b["whole"], core))

    def found(s: Column, whole: Column, core: Column) -> Column:
        def shifted(pattern: str) -> Column:
            return F.transform(match_spans(core, pattern), lambda y: F.struct((y["start"] + s).cast("int").alias("start"), (y["end"] + s).cast("int").alias("end"), y["value"].alias("value")))

        # Every way to end the run: with all, some or none of the punctuation behind it.
        ends = F.transform(F.sequence(F.length(core), F.length(whole)), lambda n: F.struct(s.cast("int").alias("start"), (s + n).cast("int").alias("end"), F.substring(whole, F.lit(1), n).alias("value")))
        whole_runs = F.filter(ends, lambda y: F.length(y["value"]).between(6, 64))
        return F.filter(F.concat(whole_runs, shifted(r"(?<=[=:])[^\s&=]{6,}"), shifted(r"[^\s@/:=]{6,}(?=@)")), lambda y: mixed(y["value"]))

    return distinct_sorted(F.flatten(F.transform(match_spans(text, P.ASCII_RUN), parts)))


def case_numbers(text: Column) -> Column:
    """字第…號 with one to four Han characters before it."""

    def starts(x: Column) -> Column:
        before = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.struct((x["start"] - k).cast("int").alias("start"), x["end"].alias("end"), F.substring(text, x["start"] - k + 1, x["end"] - x["start"] + k).alias("value")))
        return F.filter(before, lambda y: (y["start"] >= 0) & F.substring(y["value"], F.lit(1), x["start"] - y["start"]).rlike(f"^[{P.HAN}]+$"))

    return F.flatten(F.transform(match_spans(text, P.CASE_NUMBER), starts))


def full_width_ids(text: Column) -> Column:
    return match_spans(text, P.FULL_WIDTH_ID)


def outside(spans: Column, taken: Column) -> Column:
    """Interval anti join within a row: spans that lie in none of `taken`. Rows with nothing taken pass at once."""
    return F.when(F.size(taken) == 0, spans).otherwise(F.filter(spans, lambda x: ~F.exists(taken, lambda t: (t["start"] <= x["start"]) & (x["end"] <= t["end"]))))


def exploded(docs: DataFrame, key: str, spans: Column) -> DataFrame:
    """One row for each span (start, end, kind, value)."""
    return docs.select(key, F.explode(spans).alias("s")).select(key, "s.start", "s.end", "s.kind", "s.value")


_D = f"[{P.DIGIT}]"
#: A run of digits that is no part of a number with thousands groups or decimals.
RUN = rf"(?={_D})(?<!{_D})(?<!{_D}\.)(?!(?<={_D},){_D}{{3}}(?!{_D})){_D}++(?!\.{_D})(?!,{_D}{{3}}(?!{_D}))"


def numbers(text: Column) -> Column:
    """array<struct<start, end>>: a match is a chain of runs that a hyphen, blank, comma or bracket joins, and every sub-chain
    of up to six runs, and every one up to the chain's end, with three digits or more is a candidate. So is each of them with the
    sign +, ( or # before it, with an extension or # behind it, and the whole chain with spelled letters before it."""

    def within(chain: Column) -> Column:
        runs = F.transform(match_spans(chain["value"], f"{_D}+"), lambda r: F.struct((r["start"] + chain["start"]).alias("s"), (r["end"] + chain["start"]).alias("e")))

        def sub_chains(a: Column) -> Column:
            many = F.size(a)
            # Runs have one digit at least, so three of them are enough.
            enough = lambda i, j: (j - i >= 2) | (F.aggregate(F.slice(a, i + 1, j - i + 1), F.lit(0), lambda n, r: (n + r["e"] - r["s"]).cast("int")) >= 3)

            def begun(r: Column, i: Column) -> Column:
                ends = F.array_distinct(F.concat(F.sequence(i, F.least(i + 5, many - 1)), F.array(many - 1)))
                signed = F.when(char_at(text, r["s"] - 1).isin("+", "(", "（", "#"), F.array(r["s"], r["s"] - 1)).otherwise(F.array(r["s"]))
                closed = flat_map(F.filter(ends, lambda j: enough(i, j)), lambda j: _closed(text, F.get(a, j)["e"]))
                return flat_map(signed, lambda s: F.transform(closed, lambda e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))))

            lead = F.length(F.regexp_extract(before(text, chain["start"], 4), "(?:[A-Z] ){1,2}$", 0))
            digits = F.aggregate(a, F.lit(0), lambda n, r: (n + r["e"] - r["s"]).cast("int"))
            spelled = F.when((lead > 0) & (digits >= 6), F.array(F.struct((chain["start"] - lead).cast("int").alias("start"), chain["end"].alias("end")))).otherwise(F.array().cast(_PLACES))
            return F.concat(F.flatten(F.transform(a, begun)), spelled)

        return let(runs, sub_chains)

    return distinct_sorted(flat_map(match_spans(text, f"{RUN}(?:(?:{P.NUMBER_JOINS}){RUN})*"), within))


_PLACES = "array<struct<start:int,end:int>>"


def _closed(text: Column, end: Column) -> Column:
    """An end, that of an extension behind it, and that of a # behind it."""
    size = F.length(F.regexp_extract(F.substring(text, (end + 1).cast("int"), F.lit(12)), f"^{P.EXTENSION}", 0))
    more = F.when(size > 0, F.array(end + size)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(end), more, F.when(char_at(text, end) == "#", F.array(end + 1)).otherwise(F.array().cast("array<int>")))


def number_chains(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end of every number candidate. Rows stay where they are: there is no shuffle."""
    return docs.select(key, F.explode(numbers(F.col(text))).alias("s")).select(key, "s.start", "s.end")


def structured_spans(text: Column) -> Column:
    """E-mails, URLs, dates, numbers, tokens, secrets, ids and case numbers: array<struct<start, end, kind, value>>.

    Numbers, tokens and secrets inside an e-mail or URL are dropped. Numbers longer than a tile have no scorer and are left out.
    """
    taken = distinct_sorted(F.concat(typed(emails(text), "email"), typed(urls(text), "url")))

    def rest(t: Column) -> Column:
        num = F.transform(F.filter(numbers(text), lambda x: x["end"] - x["start"] <= P.TILE), lambda x: row(text, x["start"], x["end"], "num"))
        parts = [typed(dates(text), "date"), outside(num, t), outside(tokens(text), t), outside(typed(secrets(text), "alnum"), t), typed(full_width_ids(text), "alnum"), typed(case_numbers(text), "zi")]
        return F.concat(t, *parts)

    return let(taken, rest)


def structured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Structured candidates of each row and of its OCR-tolerant form, as distinct rows. Spans of one row never leave it."""
    return exploded(docs, key, distinct_sorted(tolerant.scanned(F.col(text), structured_spans)))
