"""Counts and totals per kernel and per wait bucket, for any grouping keys.

``keys`` is ``["trace_id"]`` for traces, ``["trace_id", "launch_index"]`` for
launches, and includes ``range_id`` for selected ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions.guards import checked, is_finite
from dispatchlake.functions.labels import kernel_family
from dispatchlake.functions.text import stripped

# Columns summed per kernel, wait classes, their total columns.
KERNEL_SUMS = ("set_bytes_calls", "set_bytes_total_bytes", "buffer_binds")
HEADLINE = {
    "cap": "cap_wait_ns",
    "dependency": "dependency_wait_ns",
    "decision": "decision_wait_ns",
    "other": "other_wait_ns",
}
UNNAMED = "(unnamed)"
UNCLASSIFIED = "(unclassified)"


def _total(column: str, label: str) -> Column:
    return checked(F.sum(F.coalesce(F.col(column), F.lit(0.0))), label).alias(column)


def kernel_census(
    dispatches: DataFrame, keys: Sequence[str], by: str = "family", unnamed: str | None = None
) -> DataFrame:
    """Dispatches and argument sizes per kernel.

    ``by="family"`` folds generated kernels into their family and lists the raw
    names; ``by="name"`` keeps names. Rows without a kernel are left out, or
    counted under ``unnamed``. Counting by raw name comes first, so no family's
    rows meet in one task.
    """
    if by == "name":
        name = stripped(F.col("kernel"))
        named = dispatches.withColumn("kernel", name if unnamed is None else F.coalesce(name, F.lit(unnamed)))
    else:
        named = dispatches if unnamed is None else dispatches.fillna({"kernel": unnamed})
    raw = (
        named.filter("kernel IS NOT NULL")
        .groupBy(*keys, "kernel")
        .agg(F.count(F.lit(1)).alias("count"), *[_total(c, f"kernel {c}") for c in KERNEL_SUMS])
    )
    return raw if by == "name" else families(raw, keys)


def families(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by raw kernel name folded into families, with the names of each."""
    return (
        raw.withColumn("family", kernel_family(F.col("kernel")))
        .groupBy(*keys, "family")
        .agg(
            F.sum("count").alias("count"),
            *[_total(c, f"kernel {c}") for c in KERNEL_SUMS],
            F.array_sort(F.collect_list("kernel")).alias("raw_kernels"),
        )
        .withColumnRenamed("family", "kernel")
    )


#: Trace and launch in one aggregate.
SCOPES = (("trace_id", "launch_index"), ("trace_id",))


def _both_scopes(rows: DataFrame, by: Sequence[str], *measures: Column) -> DataFrame:
    """Aggregates per trace and per launch with one shuffle: ``scope`` is "trace" or "launch".

    Rows without a launch count for their trace only.
    """
    sets = [[*keys, *by] for keys in SCOPES]
    found = rows.groupingSets(sets, *sets[0]).agg(F.grouping("launch_index").alias("_all"), *measures)
    return found.filter("_all = 1 OR launch_index IS NOT NULL").withColumn("scope", F.when(F.col("_all") == 1, "trace").otherwise("launch")).drop("_all")


def kernel_census_scopes(counted: DataFrame) -> DataFrame:
    """Kernel census of every trace and every launch.

    ``counted`` has ``trace_id, launch_index, kernel, count`` and the sums, for instance per
    command buffer (``placement.counted_kernels``); a row counts into both scopes before the shuffle.
    """
    named = counted.filter("kernel IS NOT NULL").withColumn("family", kernel_family(F.col("kernel")))
    sums = [_total(c, f"kernel {c}") for c in KERNEL_SUMS]
    found = _both_scopes(named, ["family"], F.sum("count").alias("count"), *sums, F.array_sort(F.collect_set("kernel")).alias("raw_kernels"))
    return found.withColumnRenamed("family", "kernel")


def wait_taxonomy_scopes(waits: DataFrame) -> DataFrame:
    """Wait taxonomy of every trace and every launch."""
    keys = ["bucket", "wait_class", "detail_class", "headline_category"]
    return taxonomy(_both_scopes(waits.filter("bucket IS NOT NULL"), keys, F.count(F.lit(1)).alias("count"), checked(F.sum(usable_wait()), "wait duration").alias("wait_ns")))


def census_order(census: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent first, equal counts in dictionary order of the name."""
    return census.orderBy(*keys, F.col("count").desc(), F.collate("kernel", "UNICODE"), "kernel")


def usable_wait() -> Column:
    return F.when(is_finite(F.col("wait_ns")) & (F.col("wait_ns") >= 0), F.col("wait_ns")).otherwise(0.0)


def wait_taxonomy(waits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and duration per bucket, with its classes. Waits without bucket are left out."""
    return taxonomy(
        waits.filter("bucket IS NOT NULL")
        .groupBy(*keys, "bucket", "wait_class", "detail_class", "headline_category")
        .agg(F.count(F.lit(1)).alias("count"), checked(F.sum(usable_wait()), "wait duration").alias("wait_ns"))
    )


def taxonomy(counted: DataFrame) -> DataFrame:
    return counted.withColumn("headline_included", F.col("headline_category").isNotNull()).drop("headline_category")


def wait_rows(waits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report rows per bucket; waits without one are shown as unclassified.

    Waits are first added up by class too, in numbers alone: an aggregate that carries the
    class along as a text sorts all waits of a task.
    """
    bucket = F.coalesce(stripped(F.col("bucket")), F.lit(UNCLASSIFIED))
    by_class = (
        waits.withColumn("_bucket", bucket)
        .groupBy(*keys, F.col("_bucket").alias("bucket"), F.col("wait_class").alias("_class"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(usable_wait()).alias("_ns"), F.min("line_no").alias("_first"))
    )
    return (
        by_class.groupBy(*keys, "bucket")
        .agg(
            F.sum("_n").alias("count"),
            checked(F.sum("_ns"), "wait duration").alias("wait_ns"),
            F.coalesce(F.min_by("_class", "_first"), F.lit("other")).alias("wait_class"),
        )
        .withColumn("additive", ~F.col("bucket").isin("sched_backpressure", "sched_worker_wait"))
    )


def wait_totals(waits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Headline durations per class and their sum; mirrored buckets never count."""
    total = sum((F.col(c) for c in HEADLINE.values()), F.lit(0.0))
    return waits.groupBy(*keys).agg(*wait_sums()).withColumn("headline_wait_ns", total)


def wait_sums(among: Column | None = None) -> list[Column]:
    """The headline durations per class of a group's rows (``among`` which)."""

    def counts(kind: str) -> Column:
        mine = F.col("headline_category") == kind
        return mine if among is None else mine & among

    return [checked(F.sum(F.when(counts(kind), usable_wait()).otherwise(0.0)), "wait duration").alias(column) for kind, column in HEADLINE.items()]


def bucket_totals(waits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and summed duration per named bucket, exact integers."""
    return (
        waits.filter("bucket IS NOT NULL")
        .groupBy(*keys, "bucket")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum(F.coalesce(F.col("wait_ns"), F.lit(0)).cast("long")).alias("total_ns"),
        )
    )
