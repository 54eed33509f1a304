"""python -m veilspark IN OUT [--codes | --anonymize | --restore DIR] [--general] [--map DIR]: text files in, one row for each out.

Without a mode, values become realistic stand-ins. `--map` names the folder of the mapping table, which `--restore` reads. If it is there
already, the case goes on: what it has given out stays. Each run adds a version to it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import case_state
from .operators.rewrite import restored_by_mapping
from .plans.deidentify import Engine
from .sources import files


def parsed(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser("veilspark", description=__doc__)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--codes", action="store_true", help="codes such as 甲 and 〔電話1〕")
    p.add_argument("--anonymize", action="store_true", help="texts alone, no mapping")
    p.add_argument("--general", action="store_true", help="move or generalise event dates too")
    p.add_argument("--map", help="folder for the mapping table")
    p.add_argument("--restore", help="folder of a mapping table: put the values back")
    p.add_argument("--version", type=int, help="restore by this version of the mapping table, not by the last")
    p.add_argument("--salt", default="", help="another salt gives other stand-ins")
    a = p.parse_args(args)
    if a.anonymize and (a.map or a.codes):
        p.error("anonymized texts have no mapping and no codes of their own")
    if a.restore and (a.map or a.codes or a.anonymize or a.general):
        p.error("restoring takes a mapping and nothing else")
    return a


def before(spark: SparkSession, docs: DataFrame, path: str | None, code: bool) -> DataFrame:
    """The case table that a run goes on from."""
    if not path or not files.versions(spark, path):
        return case_state.empty(docs, ["case_id"])
    return files.read_mapping(spark, path, code).drop("code")


def main(args: list[str] | None = None) -> None:
    a = parsed(args)
    spark = SparkSession.builder.getOrCreate()
    # All files of one call are one case.
    docs = files.read_texts(spark, a.source).withColumn("case_id", F.lit("all"))
    engine = Engine(mode="general" if a.general else "legal", dates="month" if a.general or a.anonymize else "keep")
    if a.restore:
        table = files.read_mapping(spark, a.restore, version=a.version)
        files.write_texts(restored_by_mapping(docs, table, ["case_id"], "doc_id").select("doc_id", F.col("restored").alias("text")), a.target)
    elif a.anonymize:
        files.write_texts(engine.anonymized(docs, "case_id"), a.target)
    elif a.codes:
        texts, after = engine.continued(docs, before(spark, docs, a.map, True))
        files.write_texts(texts.select("doc_id", F.col("rewritten").alias("text")), a.target)
        if a.map:
            files.write_mapping(after, a.map, code=True)
    else:
        texts, after = engine.continued_stand_ins(docs, before(spark, docs, a.map, False), "case_id", a.salt)
        files.write_texts(texts.select("doc_id", F.col("rewritten").alias("text")), a.target)
        if a.map:
            files.write_mapping(after, a.map, code=False)


if __name__ == "__main__":
    main()
