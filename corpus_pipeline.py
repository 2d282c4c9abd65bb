"""From raw documents to shards of a clean mixture: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns documents; the last adds the place in a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import decontam, jaccard, mixing, rules, sharding
from quadrat.llm.common import free_names, stored, table
from quadrat.llm.queries import importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the learned list or the base rules reject go."""
    importable(spark)
    (kept,) = free_names(docs.columns, "kept")
    prefix = kept[: -len("kept")] + "rule_"
    while {c.lower() for c in docs.columns} & {(prefix + n).lower() for n in (*rules.BASE, *rules.RATIOS, "kept", "base_failed")}:
        prefix = "_" + prefix
    out = rules.judged(docs, table(spark, sf_dir, "labels"), prefix=prefix)
    return out.where(prefix + "kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the least id stays."""
    importable(spark)
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    importable(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their shares; a document taken in two passes comes twice."""
    importable(spark)
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its slot there; equal texts share a shard."""
    importable(spark)
    taken = dict(zip(("size", "text_crc32", "shard", "slot"), free_names(docs.columns, "size", "text_crc32", "shard", "slot"), strict=True))
    return sharding.sharded(docs, **taken)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: The learned rules and the packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
