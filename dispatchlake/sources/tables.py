"""Typed trace tables built from star-schema tables.

Captures normally come in as JSON lines (see ``sources.lines``). This adapter maps
orders to command buffers, line items to operations and events to waits, so that
the operators can be run and checked on plain relational data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.labels import detail_class, headline_category, wait_class

# Which wait bucket an event type stands for.
BUCKET_OF_EVENT = {
    "click": "cap_wait",
    "view": "memory_wait",
    "signup": "dependency_cv_wait",
    "purchase": "cb_wait_until_completed",
    "error": "sched_backpressure",
}


@dataclass(frozen=True)
class TraceTables:
    ops: DataFrame
    cbs: DataFrame
    waits: DataFrame


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _orders_with_trace(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    nations = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderdate", F.col("c_nationkey").cast("string").alias("trace_id")
    )


def command_buffers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long")
    encode_start = (
        F.floor(day / 60) * 60_000_000_000 + (day % 60) * 10_000_000 + ((key * 7919) % 1000) * 10_000
    )
    encode_end = encode_start + (1 + key % 5) * 2_000_000
    gpu_start = encode_start + (key % 3) * 1_000_000
    gpu_end = gpu_start + (1 + (key * 31) % 7) * 1_500_000
    return _orders_with_trace(spark, folder).select(
        "trace_id",
        key.alias("line_no"),
        key.cast("double").alias("command_buffer_index"),
        F.lit(None).cast("double").alias("op_count"),
        F.lit(None).cast("double").alias("first_op_seq"),
        F.lit(None).cast("double").alias("last_op_seq"),
        encode_start.cast("double").alias("encode_start_ns"),
        encode_end.cast("double").alias("encode_end_ns"),
        gpu_start.cast("double").alias("gpu_start_ns"),
        gpu_end.cast("double").alias("gpu_end_ns"),
    )


def _kernel() -> Column:
    custom = F.concat(F.lit("custom_kernel_"), "p_type", F.lit("__"), "p_brand")
    return F.when(F.col("p_type").isin("PROMO", "SMALL"), custom).otherwise(
        F.concat_ws("_", "p_type", "p_brand")
    )


def operations(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    parts = read_table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    traces = _orders_with_trace(spark, folder).select("o_orderkey", "trace_id")
    return (
        items.join(traces, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "trace_id",
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
            F.col("l_linenumber").cast("double").alias("seq"),
            F.col("l_orderkey").cast("double").alias("command_buffer_index"),
            _kernel().alias("kernel"),
            F.col("l_linenumber").cast("double").alias("set_bytes_calls"),
            (F.col("l_quantity") * 4).cast("double").alias("set_bytes_total_bytes"),
            (F.col("l_suppkey") % 5).cast("double").alias("buffer_binds"),
        )
    )


def waits(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    owned = event % 7 == 0
    bare = (event % 11 == 0) & ~owned
    orders = read_table(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0]
    owner = F.when(owned, event % (orders + 1))
    at = (event % 41) * 60_000_000_000 + ((event * 104729) % 620) * 1_000_000
    mapping = F.create_map(*[F.lit(v) for pair in BUCKET_OF_EVENT.items() for v in pair])
    events = read_table(spark, folder, "events").select(
        event,
        mapping[F.col("event_type")].alias("bucket"),
        F.round(F.col("value") * 1000).cast("double").alias("wait_ns"),
        F.when(~owned & ~bare, at.cast("double")).alias("at_ns"),
        owner.alias("_owner"),
        (F.col("user_id") % 25).cast("string").alias("_own_trace"),
    )
    traces = _orders_with_trace(spark, folder).select(
        F.col("o_orderkey").alias("_owner"), F.col("trace_id").alias("_cb_trace")
    )
    # Most events have no owner; in the join they would all meet in one task.
    unowned = events.filter("_owner IS NULL").withColumn("_cb_trace", F.lit(None).cast("string"))
    located = events.filter("_owner IS NOT NULL").join(traces, "_owner", "left").unionByName(unowned)
    return located.select(
        F.when(F.col("_owner").isNotNull(), F.col("_cb_trace"))
        .otherwise(F.col("_own_trace"))
        .alias("trace_id"),
        F.col("event_id").alias("line_no"),
        "bucket",
        "wait_ns",
        "at_ns",
        F.col("_owner").cast("double").alias("command_buffer_index"),
        F.col("_owner").isNotNull().alias("has_legacy_index"),
        wait_class(F.col("bucket")).alias("wait_class"),
        detail_class(F.col("bucket")).alias("detail_class"),
        headline_category(F.col("bucket")).alias("headline_category"),
    )


def trace_tables(spark: SparkSession, folder: str) -> TraceTables:
    return TraceTables(
        operations(spark, folder), command_buffers(spark, folder), waits(spark, folder)
    )
