"""Table schemas, reading, writing and profiling."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names and types of the observation tables.
BIRTH_INTERVAL = (
    "community string, name_code string, mother_name string, offspring_sex string, "
    "parity double, off_sex string, IBI double, off_name string, mother_age double, "
    "rank double, rank2 double"
)
BEHAVIOUR_SCAN = (
    "subject string, rrdate string, `time.n` double, end double, observationID string, "
    "day double, month double, year double, sample_day double, youngest_offspring string, "
    "eldest_offspring_age double, scan string, new_scan string, pregnant double, "
    "youngest_off_age double, youngest_off_sex string, eldest_off_sex string, "
    "community string, food_availability double, `male.in.party` int, `female.in.party` int, "
    "party_adults int, rank double, imm_kids double, age double, database string, "
    "oestrous double, frequency double, ibi double"
)

# Schemas of the given test tables.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def snake_case(name: str) -> str:
    name = re.sub(r"[^0-9A-Za-z]+", "_", name)
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def attach(
    spark: SparkSession, path: str, schema: str | None = None, view: str | None = None
) -> DataFrame:
    """Read a Parquet table under a declared schema, in snake case, optionally as a view.

    A declared schema spares the job that reads file footers to infer one.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    renames = {c: snake_case(c) for c in df.columns if snake_case(c) != c}
    clashes = set(renames.values()) & (set(df.columns) - set(renames))
    if clashes or len(set(renames.values())) < len(renames):
        raise ValueError(f"columns collide in snake case: {sorted(renames)}")
    df = df.withColumnsRenamed(renames)
    if view:
        df.createOrReplaceTempView(view)
    return df


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return attach(spark, os.path.join(folder, f"{name}.parquet"), GIVEN[name])


def save(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet and return the table read back, with its lineage cut."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, rows, nulls, distinct values, min and max.

    Counts and ends of all columns share one aggregate. Distinct values are counted on 128-bit digests, one narrow
    row (position, digest) per value, which tasks reduce to distinct ones before they are shuffled; so a column of long
    texts moves no text and no row is copied at its full width. Null counts as a distinct
    value. Numbers report ``min_num``/``max_num``, other types ``min_text``/``max_text``.
    """
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def stats(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        num = c if kind in numeric or kind.startswith("decimal") else F.lit(None)
        text = F.lit(None) if kind in numeric or kind.startswith("decimal") else c
        return F.struct(
            F.count("*").alias("n"),
            F.count_if(c.isNull()).alias("n_null"),
            F.min(num.cast("double")).alias("min_num"),
            F.max(num.cast("double")).alias("max_num"),
            F.min(text.cast("string")).alias("min_text"),
            F.max(text.cast("string")).alias("max_text"),
        )

    def digest(position: int, name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.struct(F.lit(position).alias("position"), F.xxhash64(c).alias("one"), F.xxhash64(F.lit(1), c).alias("two"))

    one_row = df.agg(*[stats(n, k).alias(f"c{i}") for i, (n, k) in enumerate(df.dtypes)])
    entries = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(n).alias("column"),
                F.lit(k).alias("type"),
                F.col(f"c{i}").alias("s"),
            )
            for i, (n, k) in enumerate(df.dtypes)
        ]
    )
    rows = one_row.select(F.explode(entries).alias("e")).select("e.position", "e.column", "e.type", "e.s.*")
    values = df.select(F.explode(F.array(*[digest(i + 1, n) for i, n in enumerate(df.columns)])).alias("d")).select("d.*")
    counts = values.distinct().groupBy(F.col("position").alias("_p")).agg(F.count("*").alias("n_distinct"))
    return rows.join(F.broadcast(counts), F.col("position") == F.col("_p"), "left").select(
        "position", "column", "type", "n", "n_null", F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"),
        "min_num", "max_num", "min_text", "max_text",
    )
