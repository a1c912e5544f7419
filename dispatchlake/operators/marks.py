"""Merged marks, even samples and table sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions.guards import is_finite
from dispatchlake.operators.ordered import with_rank

# Most records shown per scope.
SAMPLE_LIMITS = {"dispatches": 4000, "command_buffers": 3000, "waits": 2000}


def marks(dispatches: DataFrame, waits: DataFrame) -> DataFrame:
    """Placed dispatches and anchored waits together; ``MARK_ORDER`` puts dispatches first at equal times."""
    def side(df: DataFrame, kind: str, label: str, rank: int) -> DataFrame:
        return df.filter("at_ns IS NOT NULL").select(
            "trace_id", "at_ns", F.lit(kind).alias("kind"), F.col(label).alias("label"), "line_no",
            F.lit(rank).alias("kind_rank"),
        )

    return side(dispatches, "dispatch", "kernel", 0).unionByName(side(waits, "wait", "bucket", 1))


MARK_ORDER = ["at_ns", "kind_rank", "line_no"]


def ordered_marks(dispatches: DataFrame, waits: DataFrame) -> DataFrame:
    """The marks of each trace numbered from 0 in time order (``place``); neighbours have neighbouring numbers."""
    ranked = with_rank(marks(dispatches, waits), ["trace_id"], MARK_ORDER)
    return ranked.withColumnRenamed("_rank", "place").drop("_total")


def even_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """``limit`` rows per key at even distances, first and last included; all if fewer.

    Adds ``displayed`` and ``total``. A row is taken when its position is one of
    ``floor(i * (total - 1) / (limit - 1))``, which is decided row by row.
    """
    if limit < 2:
        raise ValueError("limit must be at least 2")
    ranked = with_rank(df, keys, order)
    position = F.expr(f"((_rank * {limit - 1} + _total - 2) DIV greatest(_total - 1, 1) * (_total - 1)) DIV {limit - 1}")
    taken = (F.col("_total") <= limit) | (position == F.col("_rank"))
    return ranked.filter(taken).select(
        *df.columns, F.least(F.col("_total"), F.lit(limit).cast("long")).alias("displayed"), F.col("_total").alias("total")
    )


def sort_rows(df: DataFrame, key: str, ascending: bool = True, rank: str | None = None) -> DataFrame:
    """Sort a report by one column: numbers by value (not finite counts as zero), else as text.

    Equal keys stay in the order of ``rank`` in both directions.
    """
    if dict(df.dtypes)[key] in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        value = F.when(is_finite(F.col(key)), F.col(key)).otherwise(0)
    else:
        value = F.coalesce(F.col(key).cast("string"), F.lit(""))
    ties = [F.col(rank).asc()] if rank else []
    return df.orderBy(value.asc() if ascending else value.desc(), *ties)
