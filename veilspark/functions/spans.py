"""Regex matches with positions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two characters that bound a match while positions are worked out; the input's own are dropped.
OPEN, CLOSE = "\x01", "\x02"


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


#: Matches whose places are summed in one fold; folds copy what they have, so they stay short.
GROUP = 64
SPANS = "array<struct<start:int,end:int,value:string>>"


def match_spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>> of the matches, by code point, end exclusive.

    Matches are bracketed in one regexp_replace; lengths of the pieces between brackets, summed from the left, are
    the positions. Look-around works, as the pattern runs once over the whole text. Pieces are summed in groups and then
    the groups, so a text with many matches costs little more than its length.
    """
    bracketed = f"(?:{pattern})" if isinstance(pattern, str) else F.concat(F.lit("(?:"), pattern, F.lit(")"))
    own = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    marked = F.regexp_replace(F.when(own, F.translate(text, OPEN + CLOSE, "  ")).otherwise(text), bracketed, f"{OPEN}$0{CLOSE}")

    def span(start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))

    def add(state: Column, piece: Column) -> Column:
        value = F.substring_index(piece, CLOSE, 1)
        start = state["at"]
        return F.struct((start + F.length(piece) - 1).cast("int").alias("at"), F.concat(state["found"], F.array(span(start, start + F.length(value), value))).alias("found"))

    def walk(pieces: Column) -> Column:
        n = F.size(pieces) - 1
        groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / GROUP), F.lit(0)).cast("int")), lambda k: F.slice(pieces, 2 + k * GROUP, F.lit(GROUP)))
        none = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast(SPANS).alias("found"))
        local = F.transform(groups, lambda g: F.aggregate(g, none, add))

        def placed(parts: Column) -> Column:
            first = F.struct(F.length(F.element_at(pieces, 1)).cast("int").alias("at"), F.array().cast("array<int>").alias("all"))
            bases = F.aggregate(parts, first, lambda a, x: F.struct((a["at"] + x["at"]).cast("int").alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
            return F.flatten(F.zip_with(parts, bases, lambda x, base: F.transform(x["found"], lambda y: span(y["start"] + base, y["end"] + base, y["value"]))))

        return F.when(n < 1, F.array().cast(SPANS)).otherwise(let(local, placed))

    # Most patterns match nowhere in most texts, which one search tells.
    nothing = text.isNull() | ~(text.rlike(bracketed) | own) if isinstance(pattern, str) else text.isNull()
    return F.when(nothing, F.array().cast(SPANS)).otherwise(let(F.split(marked, OPEN), walk))


def distinct_sorted(items: Column) -> Column:
    """The distinct members of an array of structs, sorted: equal ones are neighbours, so one pass drops them."""
    return let(F.sort_array(items), lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))


def char_at(text: Column, i: Column) -> Column:
    """The code point at a 0-based place; empty outside the text."""
    return F.when(i < 0, "").otherwise(F.substring(text, (i + 1).cast("int"), F.lit(1)))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def quoted(words) -> str:
    """A group of literal words, longest first. Of many, their first characters are looked for before any of them is tried."""
    special = set("\\.[]{}()*+-?^$|&#")
    literal = lambda w: "".join("\\" + c if c in special else c for c in w)
    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    every = "|".join(map(literal, ordered))
    if len(ordered) < 4 or not all(ordered):
        return f"(?:{every})"
    firsts = "[" + "".join(map(literal, sorted({w[0] for w in ordered}))) + "]"
    return firsts if all(len(w) == 1 for w in ordered) else f"(?={firsts})(?:{every})"


def row(text: Column, start: Column, end: Column, kind: str | Column) -> Column:
    """A candidate: struct<start, end, kind, value>."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("kind"), cut(text, start, end).alias("value"))


def before(text: Column, at: Column, n: int) -> Column:
    """At most `n` characters before a place."""
    return cut(text, F.greatest(at - n, F.lit(0)), at)


def after(text: Column, at: Column, n: int) -> Column:
    return F.substring(text, (at + 1).cast("int"), F.lit(n))


def counting(n: Column, first: int = 1) -> Column:
    """The numbers from `first` to n; none if n is less."""
    return F.when(n >= first, F.sequence(F.lit(first), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def flat_map(items: Column, body) -> Column:
    return F.flatten(F.transform(items, body))


def sums_before(items: Column) -> Column:
    """array<int>: for each number the sum of those before it. Summed in groups, then over the groups, so long arrays stay cheap."""
    none = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<int>").alias("all"))

    def run(values: Column) -> Column:
        return F.aggregate(values, none, lambda a, x: F.struct((a["at"] + x).cast("int").alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))

    def placed(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, run(F.transform(parts, lambda p: p["at"]))["all"], lambda p, base: F.transform(p["all"], lambda x: x + base)))

    groups = F.transform(counting(F.ceil(F.size(items) / GROUP)), lambda k: F.slice(items, (k - 1) * GROUP + 1, F.lit(GROUP)))
    return F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(let(F.transform(groups, run), placed))
