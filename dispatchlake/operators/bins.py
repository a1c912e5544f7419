"""Fixed-resolution overviews of launches and density of dispatches in ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.functions.guards import checked
from dispatchlake.operators.exposure import gpu_intervals, has_encode
from dispatchlake.operators.intervals import union_intervals
from dispatchlake.operators.launches import LAUNCH
from dispatchlake.operators.skew import salted_join

# Bins per overview, and the spacing in pixels below which dispatches blur.
DEFAULT_BINS = 512
MOST_BINS = 4096
DENSITY_SPACING_PX = 3
UNKNOWN_KERNEL = "(unknown)"


def _edge(index: Column, bins: int) -> Column:
    """Start of a bin; the last edge is the end of the launch itself."""
    return F.when(index == bins, F.col("launch_end")).otherwise(
        F.col("launch_start") + F.col("span") * (index / F.lit(bins))
    )


def _bin(at: Column, bins: int) -> Column:
    scaled = F.floor((at - F.col("launch_start")) / F.col("span") * bins)
    return F.least(F.greatest(scaled, F.lit(0)), F.lit(bins - 1)).cast("int")


def _interval_load(intervals: DataFrame, scopes: DataFrame, bins: int, name: str) -> DataFrame:
    """Summed overlap of intervals with each bin, two rows per interval.

    An interval adds one from its start on and takes it back from its end on. In
    the bin of such a change it counts for the rest of that bin, in later bins for
    their whole width; so the length of an interval does not matter.
    """
    clipped = (
        salted_join(intervals, scopes, LAUNCH, F.col("start_ns"))
        .select(
            *LAUNCH, "launch_start", "launch_end", "span",
            F.greatest("start_ns", "launch_start").alias("a"),
            F.least("end_ns", "launch_end").alias("b"),
        )
        .filter("b > a")
    )
    changes = F.array(
        F.struct(F.col("a").alias("t"), F.lit(1.0).alias("s")),
        F.struct(F.col("b").alias("t"), F.lit(-1.0).alias("s")),
    )
    events = clipped.select("*", F.explode(changes).alias("c")).withColumn("bin", _bin(F.col("c.t"), bins))
    rest = _edge(F.col("bin") + 1, bins) - F.col("c.t")
    return events.groupBy(*LAUNCH, "bin").agg(
        F.sum(F.col("c.s")).alias(f"{name}_slope"), F.sum(F.col("c.s") * rest).alias(f"{name}_rest")
    )


def overview_bins(
    cbs: DataFrame, dispatches: DataFrame, waits: DataFrame, launches: DataFrame, bins: int = DEFAULT_BINS
) -> DataFrame:
    """Per launch and bin: host encode time, GPU busy time, dispatches, waits, wait classes.

    ``launches`` carries the bounds; launches without positive length have no bins.
    """
    if not 1 <= bins <= MOST_BINS:
        raise ValueError(f"bins must lie between 1 and {MOST_BINS}")
    scopes = launches.select(
        *LAUNCH,
        F.col("start_ns").alias("launch_start"),
        F.col("end_ns").alias("launch_end"),
        (F.col("end_ns") - F.col("start_ns")).alias("span"),
    ).filter("span > 0")
    encode = cbs.filter(has_encode()).select(
        *LAUNCH, F.col("encode_start_ns").alias("start_ns"), F.col("encode_end_ns").alias("end_ns")
    )
    busy = union_intervals(gpu_intervals(cbs, LAUNCH), LAUNCH)

    def inside(points: DataFrame, *columns: str) -> DataFrame:
        return (
            points.filter("launch_index IS NOT NULL AND at_ns IS NOT NULL")
            .select(*LAUNCH, "at_ns", *columns)
            .transform(lambda rows: salted_join(rows, scopes, LAUNCH, F.col("at_ns")))
            .filter("at_ns >= launch_start AND at_ns <= launch_end")
            .withColumn("bin", _bin(F.col("at_ns"), bins))
        )

    dispatch_load = inside(dispatches).groupBy(*LAUNCH, "bin").agg(F.count(F.lit(1)).alias("dispatch_count"))
    wait_load = (
        inside(waits, "wait_class")
        .groupBy(*LAUNCH, "bin")
        .agg(
            F.count(F.lit(1)).alias("wait_count"),
            F.array_sort(F.collect_set(F.coalesce("wait_class", F.lit("other")))).alias("wait_classes"),
        )
    )
    grid = scopes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = grid
    for part in (
        _interval_load(encode, scopes, bins, "encode"),
        _interval_load(busy, scopes, bins, "busy"),
        dispatch_load,
        wait_load,
    ):
        filled = filled.join(part, [*LAUNCH, "bin"], "left")
    start, end = _edge(F.col("bin"), bins), _edge(F.col("bin") + 1, bins)
    earlier = Window.partitionBy(*LAUNCH).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)

    def load(name: str) -> Column:
        running = F.coalesce(F.sum(f"{name}_slope").over(earlier), F.lit(0.0)) * (end - start)
        total = F.coalesce(F.col(f"{name}_rest"), F.lit(0.0)) + running
        return checked(F.greatest(total, F.lit(0.0)), "overview coverage")

    return filled.select(
        *LAUNCH,
        "bin",
        start.alias("start_ns"),
        end.alias("end_ns"),
        load("encode").alias("host_encode_ns"),
        load("busy").alias("gpu_busy_ns"),
        F.coalesce("dispatch_count", F.lit(0)).alias("dispatch_count"),
        F.coalesce("wait_count", F.lit(0)).alias("wait_count"),
        F.coalesce("wait_classes", F.array().cast("array<string>")).alias("wait_classes"),
    )


def pixel(at: Column, columns: int) -> Column:
    """The pixel column of a time in its range; never smaller for a later time."""
    span = F.col("range_end_ns") - F.col("range_start_ns")
    scaled = F.floor((at - F.col("range_start_ns")) / span * columns)
    return F.least(F.greatest(scaled, F.lit(0)), F.lit(columns - 1)).cast("int")


def kernel_name() -> Column:
    return F.when(F.length("kernel") > 0, F.col("kernel")).otherwise(UNKNOWN_KERNEL)


def _density_rows(selected: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    return selected.filter("range_end_ns > range_start_ns").select(
        *keys, "range_start_ns", "range_end_ns", "at_ns", "line_no", "command_buffer_index",
        pixel(F.col("at_ns"), max(1, int(width))).alias("bin"),
        kernel_name().alias("kernel"),
    )


def density_owners(selected: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Which command buffers (NULL: none known) have dispatches in each bin, one row each."""
    return _density_rows(selected, keys, width).select(*keys, "bin", "command_buffer_index").distinct()


def density_bins(selected: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """At most one bin per pixel column for the dispatches of each range.

    ``selected`` holds placed dispatches with their range's ``range_start_ns`` and
    ``range_end_ns`` (see ``ranges.points_in_ranges``). ``command_buffer_index`` is the
    one owner of the bin, if it has just one; see ``density_owners`` for all.
    """
    order = F.struct("at_ns", "line_no")
    scope = [*keys, "range_start_ns", "range_end_ns", "bin"]
    per_kernel = (
        _density_rows(selected, keys, width)
        .groupBy(*scope, "kernel")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(order).alias("first"),
            F.max(order).alias("last"),
            F.min("command_buffer_index").alias("_low"),
            F.max("command_buffer_index").alias("_high"),
            F.max(F.col("command_buffer_index").isNull()).alias("_unowned"),
        )
    )
    return folded_bins(per_kernel, keys, max(1, int(width))).drop("first_at_ns", "last_at_ns")


def folded_bins(per_kernel: DataFrame, keys: Sequence[str], columns: int) -> DataFrame:
    """Bins out of what each kernel has in them. Rows without a kernel and with ``n`` 0 tell ends and owners alone."""
    scope = [*keys, "range_start_ns", "range_end_ns", "bin"]
    bins = per_kernel.groupBy(*scope).agg(
        F.sum("n").alias("count"),
        F.min_by("kernel", F.struct(-F.col("n"), F.col("kernel"))).alias("dominant_kernel"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kernel").isNotNull(), F.struct("kernel", "n"))))).alias("kernel_counts"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
        F.max("_unowned").alias("_unowned"),
    )

    def edge(step: int) -> Column:
        length = F.col("range_end_ns") - F.col("range_start_ns")
        return F.col("range_start_ns") + (F.col("bin") + step) / F.lit(columns) * length

    return bins.select(
        *keys,
        "bin",
        edge(0).alias("start_ns"),
        edge(1).alias("end_ns"),
        "count",
        "dominant_kernel",
        "kernel_counts",
        F.when((F.col("_low") == F.col("_high")) & ~F.col("_unowned"), F.col("_low")).alias("command_buffer_index"),
        F.col("first.line_no").alias("first_line_no"),
        F.col("last.line_no").alias("last_line_no"),
        F.col("first.at_ns").alias("first_at_ns"),
        F.col("last.at_ns").alias("last_at_ns"),
    )


def density_mode(selected: DataFrame, ranges: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Whether dispatches lie closer than three pixels on average, per range."""
    spread = selected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max("at_ns") - F.min("at_ns")).alias("extent")
    )
    return with_mode(ranges, spread, keys, width)


def with_mode(ranges: DataFrame, spread: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """The mode of each range by the number ``n`` and ``extent`` of its dispatches; one of no length is never dense."""
    length = F.col("end_ns") - F.col("start_ns")
    spacing = F.col("extent") / F.nullif(length, F.lit(0.0)) * float(width) / (F.col("n") - 1)
    dense = F.when(F.col("n") >= 2, spacing < DENSITY_SPACING_PX)
    return ranges.join(spread, list(keys), "left").select(
        *keys,
        F.coalesce("n", F.lit(0)).alias("dispatch_count"),
        F.coalesce(dense, F.lit(False)).alias("density_mode"),
    )
