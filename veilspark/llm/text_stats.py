"""Document statistics as Catalyst expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RX, let

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more.

    Windows are compared by a 64-bit hash; one sort of (hash, position) pairs finds the repeats, and a pass over
    their positions counts each covered word once.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.when(i == F.size(places) - 1, 3).otherwise(F.least(F.lit(3), F.get(places, i + 1) - p)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeats(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | ((i < F.size(ordered) - 1) & (F.get(ordered, i + 1)["h"] == x["h"])),
        )
        return let(F.array_sort(F.transform(again, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, repeats))

    def bound(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(let(hashes, windows))

    return let(words, bound)


def with_base(docs: DataFrame) -> DataFrame:
    """Add the five base counts (long). Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, WHITE_RX), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct")),
    )
    n_dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return (
        docs.withColumn("_c", counts)
        .withColumns(
            {
                "word_chars": F.length(_without(text, WHITE)).cast("long"),
                "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
                "n_dup_lines": n_dup.cast("long"),
                "n_words": F.col("_c.n_words"),
                "n_repeat_words": F.col("_c.n_repeat_words"),
                "n_distinct": F.col("_c.n_distinct"),
            }
        )
        .drop("_c")
    )


#: Names of the ratios that the learned operators use.
RATIOS = ["log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "digit_rate", "mark_rate", "stop_rate", "words_per_line", "non_ascii_rate"]


def with_ratios(docs: DataFrame) -> DataFrame:
    """Add the base counts and the ratios (double, never null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = with_base(docs)
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    n_lines = (F.length(text) - F.length(_without(text, "\n")) + 1).cast("double")

    def rate(chars_in: str) -> Column:
        return (F.length(text) - F.length(_without(text, chars_in))) / chars

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return base.withColumns(
        {
            "log_words": F.log1p(F.col("n_words").cast("double")),
            "mean_word": F.col("word_chars") / words,
            "symbol_rate": F.col("n_symbols") / words,
            "dup_line_rate": F.col("n_dup_lines") / n_lines,
            "repeat_rate": F.col("n_repeat_words") / words,
            "distinct_rate": F.col("n_distinct") / words,
            "upper_rate": rate(upper),
            "digit_rate": rate("0123456789"),
            "mark_rate": rate("!?;:\"()[]{}=_/\\@"),
            "stop_rate": rate(".,"),
            "words_per_line": F.log1p(words / n_lines),
            "non_ascii_rate": (F.octet_length(text) - F.length(text)) / chars,
        }
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    """Documents of at most about `max_labelled` labelled ids, chosen by a hash of the id, with the label as `y`.

    Labels are joined by id; the chosen labels number at most `max_labelled` plus sampling noise, so they are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    if n > max_labelled:
        scale = 1 << 20
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(scale)) < int(scale * max_labelled / n))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
