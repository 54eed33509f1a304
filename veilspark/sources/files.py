"""Readers and writers of texts, mappings, JSON lines and tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPING = "case_id string, seq long, fake string, original string, type string, kind string, ambiguous boolean, label string, owner string, c string, code boolean, version int"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: doc_id (its path) and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are not JSON come back with `bad` set to the line."""
    return spark.read.schema(f"{schema}, bad string").option("columnNameOfCorruptRecord", "bad").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, without the byte-order mark."""
    rows = spark.read.option("header", True).csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def read_dictionary(spark: SparkSession, path: str, least: int = 300) -> DataFrame:
    """Lines `word freq pos`: words of two to four characters with `freq` of `least` or more."""
    rows = spark.read.option("sep", " ").schema("word string, freq long, pos string").csv(path)
    return rows.where((F.col("freq") >= least) & F.length("word").between(2, 4))


def read_table(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Rows of a query on a database that a JDBC driver on the class path reaches, such as a local cache of judgments."""
    return spark.read.jdbc(url, f"({query}) q", properties=properties or {})


def write_texts(docs: DataFrame, path: str) -> None:
    """Texts alone, partitioned by nothing, without any column that leads back."""
    docs.select("doc_id", "text").write.mode("overwrite").parquet(path)


def versions(spark: SparkSession, path: str) -> int:
    """The last version of a mapping folder; 0 if there is none."""
    try:
        rows = spark.read.schema(MAPPING).json(path)
        return rows.agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def write_mapping(mapping: DataFrame, path: str, code: bool) -> int:
    """A mapping or case table of one style as JSON lines, a folder for each version and case; return the version.

    A version is written beside those before it and never changed, so each run's texts can be restored by what held then.
    """
    version = versions(mapping.sparkSession, path) + 1
    rows = mapping.withColumns({"case_id": F.col("case_id").cast("string"), "code": F.lit(code), "version": F.lit(version)})
    rows.write.mode("append").partitionBy("version", "case_id").json(path)
    return version


def read_mapping(spark: SparkSession, path: str, code: bool | None = None, version: int | None = None) -> DataFrame:
    """A version of a mapping table, the last if none is named. Where `code` is given, entries of the other style are an error."""
    rows = spark.read.schema(MAPPING).json(path).where(F.col("version") == (versions(spark, path) if version is None else version)).drop("version")
    if code is not None and rows.where(F.coalesce("code", F.lit(False)) != F.lit(code)).limit(1).count():
        raise ValueError("the mapping was written by the other style")
    return rows
