"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Each stage works on all rows that its predecessor kept. Null and empty texts fail the quality rules and go there; repeated rows
fall to the n-gram join; rows without an id and several texts of one id are documents of their own at every stage; an empty
table gives an empty result at every stage. The last stage returns one row for each document in its token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import kept, shared_path, table, text_bytes
from veilspark.llm.queries import tokenizer_path

#: Text bytes of a file of the mixed order.
PART_BYTES = 16 << 20
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: what the base rule or a learned rule rejects goes."""
    from veilspark.llm.quality_rules import quality_rules

    return quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select(*DOCUMENTS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): of each component the row with the least id, then the least digest, stays.

    Rows are told apart by id and text together, and those without an id come last. Of rows equal in both one stays, that
    with the least other columns.
    """
    from veilspark.llm.ngram_join import similar_components

    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    place = F.coalesce(F.concat(F.lit("00"), number), F.lit("01" + "0" * 16))
    keyed = docs.select(F.unhex(F.concat(place, F.coalesce(F.md5("text"), F.lit("0" * 32)))).alias("row_key"), *DOCUMENTS)
    found = similar_components(keyed.select(F.col("row_key").alias("doc_id"), "text"), width=5, percent=80)
    first = kept(found.where("doc_id = component_id").select(F.col("doc_id").alias("row_key")).distinct(), "first")
    stay = keyed.join(first, "row_key", "left_semi").groupBy("row_key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("v"))
    return stay.select(*[F.col(f"v.{c}").alias(c) for c in DOCUMENTS])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item go."""
    from veilspark.llm.decontaminate import clean

    return clean(docs.select(*DOCUMENTS), table(spark, sf_dir, "benchmark"))


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: all documents, laid out in the mixed order, which the next stage keeps."""
    from veilspark.llm.mixing import mix

    placed = mix(docs.select(*DOCUMENTS))
    # As many files as the size of the data asks for, whatever the session says.
    return placed.repartitionByRange(text_bytes(docs) // PART_BYTES + 1, "mix_position").sortWithinPartitions("mix_position").select(*DOCUMENTS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output in the order in which the documents lie in the files read: the mixed order."""
    from veilspark.llm.token_files import read_tokens, write_tokens

    # Part files are numbered in the order of the ranges that wrote them; where a part fills several, those are numbered too.
    name = F.col("_metadata.file_name")
    part, piece = (F.coalesce(F.regexp_extract(name, rx, 1).try_cast("long"), F.lit(0)) for rx in (r"part-(\d+)", r"[.-]c(\d+)\."))
    stored = docs.select("doc_id", "text", (F.shiftleft(part, 40) + F.shiftleft(piece, 32) + F.col("_metadata.row_index")).alias("place"))
    manifest = write_tokens(stored, shared_path(spark, "tokens"), tokenizer_path(), [F.col("place")])
    return read_tokens(spark, manifest)


STAGES = [
    ("quality_rules", good_documents),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("source_mix", in_mixed_order),
    ("token_files", token_files),
]
#: The learned rules and the tokenizer are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
