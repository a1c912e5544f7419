"""Stored tables: typed records and analysis results as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.operators.normalize import Records


def write_records(records: Records, path: str) -> None:
    """One pass over the text: parse, type, and store by record type.

    Reports then read only the record type and columns they need.
    """
    records.all.write.mode("overwrite").partitionBy("record_type").parquet(path)


def read_records(spark: SparkSession, path: str) -> Records:
    return Records(spark.read.parquet(path))


def write_bucketed(table: DataFrame, path: str, keys: Sequence[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """Store a table so that joins and aggregates by ``keys`` need no shuffle: (rows with all keys, the others).

    Rows are dealt to ``buckets`` by a hash of the keys and sorted in each. Tables of the same
    keys and number of buckets lie next to each other bucket by bucket. Rows that lack a key
    join with nothing; they would all share a bucket, and are stored beside the others. Keys
    that are fractions by type are refused: Spark normalises these before it compares them,
    and the layout is lost on it.
    """
    spark = table.sparkSession
    unfit = [n for n, kind in table.dtypes if n in keys and kind in ("double", "float")]
    if unfit:
        raise ValueError(f"cast {unfit} to a whole type first")
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    name = f"bucketed_{uuid.uuid4().hex}"
    # One task writes one bucket, so a bucket is one file and its order holds.
    dealt = table.filter(whole).repartition(buckets, *keys)
    dealt.write.option("path", f"{path}/keyed").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    table.filter(~whole).write.parquet(f"{path}/other")
    return spark.table(name), spark.read.schema(table.schema).parquet(f"{path}/other")


def write_tables(tables: Mapping[str, DataFrame], folder: str, order: Mapping[str, Sequence[str]] | None = None) -> None:
    """Store result tables, each clustered by its order columns (default: by trace).

    Range clustering keeps a trace's rows together, so that row-group statistics
    skip other traces and times, without one directory per trace; a large trace
    still spreads over several files.
    """
    for name, table in tables.items():
        columns = list((order or {}).get(name) or ["trace_id"])
        table.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(
            f"{folder}/{name}"
        )
