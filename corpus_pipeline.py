"""The corpus pipeline: five operators, each over all that its predecessor kept.

Quality rules drop what they reject, SimHash keeps one document of each group, decontamination drops
contaminated documents, mixing repeats or drops documents to reach its targets, and sharding writes
the shards and adds each row's shard and slot to its columns. All but the last return the columns of
documents. What a stage decides concerns single rows, also where doc_ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstream.llm.decontaminate import keep_clean
from siltstream.llm.mixing import mixed
from siltstream.llm.quality import judge
from siltstream.llm.rows import with_row, without
from siltstream.llm.sharding import reshard
from siltstream.llm.simhash import keep_first
from siltstream.plans.shared import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = with_row(docs, "doc_id", "text", *[c for c in docs.columns if c == "lang"])
    return without(rows, judge(rows.drop("_row"), labels, "uid").where("not kept").select("uid"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reshard(docs, columns=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Stages that SQL can't express (components of near-duplicates, for one) are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch(spark, name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
