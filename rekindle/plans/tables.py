"""Interaction tables derived from the TPC-H-like star schema and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rekindle.operators.clean import Roles, standardise
from rekindle.operators.split import Split, drop_cold_users, hash_split
from rekindle.session import materialise

ORDER_ROLES = Roles("o_custkey", "l_partkey", "l_quantity", "o_orderdate")
EVENT_ROLES = Roles("user_id", "k", None, "ts")

#: names under which the role detection query reads lineitem
ROLE_COLUMNS = {
    "l_suppkey": "memberid", "l_partkey": "item-id", "l_orderkey": "id", "l_linenumber": "score points", "l_quantity": "values",
    "l_shipdate": "updated", "l_returnflag": "ship_type", "l_linestatus": "sku ref",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every order line with its customer, part, quantity and date."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_custkey", "l_partkey", "l_quantity", "o_orderdate"
    )


def order_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return standardise(order_rows(spark, folder), ORDER_ROLES)


def order_split(spark: SparkSession, folder: str) -> Split:
    """Train and test parts; the clean table is written once and both parts read it."""
    return drop_cold_users(hash_split(materialise(order_interactions(spark, folder))))


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").select("user_id", "props", "event_type", "ts")
    return events.select("user_id", F.get_json_object("props", "$.k").alias("k"), "event_type", "ts")


def event_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return standardise(event_rows(spark, folder), EVENT_ROLES)


def event_split(spark: SparkSession, folder: str) -> Split:
    return drop_cold_users(hash_split(materialise(event_interactions(spark, folder))))


def with_part_features(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add brand, type and size of the part as side features of the item."""
    part = read(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("itemID"), "p_brand", "p_type", "p_size"
    )
    return df.join(part, "itemID", "left").select("userID", "itemID", "rating", "timestamp", "p_brand", "p_type", "p_size")


def with_segment(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    customer = read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("userID"), "c_mktsegment"
    )
    return df.join(customer, "userID", "left").select(*df.columns, "c_mktsegment")


def run_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A run table as a benchmark would write it: one row per event type and experiment."""
    events = read(spark, folder, "events")
    rows = events.groupBy(F.concat(F.lit("exp"), (F.col("user_id") % 3).cast("string")).alias("experiment_id"),
                          F.col("event_type").alias("algorithm"))
    scale = (
        F.when(F.col("algorithm") == "purchase", 0.9)
        .when(F.col("algorithm").isin("click", "view"), 0.65)
        .otherwise(0.35)
    )
    return rows.agg(
        F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("metric"),
        F.round(F.avg("value"), 6).alias("elapsed_s"),
    ).withColumn("scalability", scale)
