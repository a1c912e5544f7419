"""Launches: stretches of command buffers separated by long idle gaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.operators.ordered import blocks, exact_median
from dispatchlake.operators.skew import salted_join
from dispatchlake.session import settle

# A gap opens a launch when it exceeds both.
MIN_GAP_NS = 100_000_000
MEDIAN_FACTOR = 20
UNTIMED = float("inf")
LAUNCH = ["trace_id", "launch_index"]


def activity_start() -> Column:
    return F.coalesce("encode_start_ns", "gpu_start_ns")


def latest_endpoint() -> Column:
    return F.greatest("encode_start_ns", "encode_end_ns", "gpu_start_ns", "gpu_end_ns")


def earliest_endpoint() -> Column:
    return F.least("encode_start_ns", "encode_end_ns", "gpu_start_ns", "gpu_end_ns")


@dataclass(frozen=True)
class Launches:
    """``cbs`` with ``launch_index``; one row per launch in ``launches``.

    ``start_ns`` is the earliest activity start, ``low_ns`` the earliest endpoint of any kind.
    """

    cbs: DataFrame
    launches: DataFrame


def launch_gaps(cbs: DataFrame):
    """Command buffers in activity order with the idle time before each.

    The gap runs from the latest encode or GPU end of everything earlier to this
    encode start. Without an encode start there is no gap; without any start the
    row sorts last.
    """
    keyed = cbs.withColumn("_at", F.coalesce(activity_start(), F.lit(UNTIMED)))
    cut = blocks(keyed, ["trace_id"], ["_at", "line_no"])
    end = F.greatest("encode_end_ns", "gpu_end_ns")
    rows = cut.with_carry(cut.rows, {"_m": F.max(end)}, {"_carry": F.max("_m")})
    reach = F.greatest(F.col("_carry"), F.max(end).over(cut.before))
    return cut, settle(rows.withColumn("gap_ns", F.col("encode_start_ns") - reach).drop("_carry"))


def partition_launches(
    cbs: DataFrame,
    min_gap_ns: float = MIN_GAP_NS,
    factor: float = MEDIAN_FACTOR,
) -> Launches:
    """Cut each trace where a gap exceeds ``max(min_gap_ns, factor * median gap)``."""
    cut, rows = launch_gaps(cbs)
    median = exact_median(rows.filter("gap_ns > 0"), ["trace_id"], "gap_ns", "_median")
    threshold = F.greatest(F.lit(float(min_gap_ns)), F.lit(float(factor)) * F.col("_median"))
    # greatest() skips NULL, so a trace without positive gaps gets the minimum.
    flagged = (
        salted_join(rows, median, ["trace_id"], F.col("line_no"), "left")
        .withColumn("gap_threshold_ns", threshold)
        .withColumn("_cuts", F.coalesce(F.col("gap_ns") > F.col("gap_threshold_ns"), F.lit(False)).cast("long"))
        .drop("_median")
    )
    carried = cut.with_carry(flagged, {"_n": F.sum("_cuts")}, {"_earlier": F.sum("_n")})
    index = F.coalesce("_earlier", F.lit(0)) + F.sum("_cuts").over(cut.upto)
    assigned = carried.withColumn("launch_index", index)
    launches = assigned.groupBy(*LAUNCH).agg(
        F.min(activity_start()).alias("start_ns"),
        F.max(latest_endpoint()).alias("end_ns"),
        F.min(earliest_endpoint()).alias("low_ns"),
        F.max(F.when(F.col("_cuts") == 1, F.col("gap_ns"))).alias("gap_before_ns"),
        F.max("gap_threshold_ns").alias("gap_threshold_ns"),
        F.count(F.lit(1)).alias("command_buffers"),
    )
    return Launches(assigned.select(*cbs.columns, "launch_index"), launches)


def nearest_launch(points: DataFrame, launches: DataFrame) -> DataFrame:
    """Add ``launch_index`` of the launch that contains ``at_ns`` or lies nearest.

    ``points`` needs ``trace_id``, ``at_ns`` and a ``line_no`` unique in the trace. Of two equally
    near launches the earlier wins; without timed launches the result is NULL. Both
    neighbours come from one sweep over launches and points in time order.
    """
    timed = launches.filter("start_ns IS NOT NULL AND end_ns IS NOT NULL")
    marker = F.struct("start_ns", "end_ns", "launch_index")
    marks = timed.select(
        "trace_id",
        F.col("start_ns").alias("_t"),
        F.lit(0).alias("_kind"),
        F.col("end_ns").alias("_tie"),
        F.col("launch_index").cast("long").alias("_id"),
        marker.alias("_launch"),
    )
    asked = points.filter("at_ns IS NOT NULL").select(
        "trace_id",
        F.col("at_ns").alias("_t"),
        F.lit(1).alias("_kind"),
        F.lit(0.0).alias("_tie"),
        F.col("line_no").cast("long").alias("_id"),
        F.lit(None).cast(marks.schema["_launch"].dataType).alias("_launch"),
    )
    cut = blocks(marks.unionByName(asked), ["trace_id"], ["_t", "_kind", "_tie", "_id"])
    rows = cut.with_carry(
        cut.rows,
        {"_low": F.min("_launch"), "_high": F.max("_launch")},
        {"_carry_left": F.max("_high")},
        {"_carry_right": F.min("_low")},
    )
    left = F.coalesce(F.last("_launch", ignorenulls=True).over(cut.upto), F.col("_carry_left"))
    right = F.coalesce(F.last("_launch", ignorenulls=True).over(cut.after), F.col("_carry_right"))
    found = rows.withColumn("_left", left).withColumn("_right", right).filter("_kind = 1")
    to_left = F.col("_t") - F.col("_left.end_ns")
    to_right = F.col("_right.start_ns") - F.col("_t")
    pick_left = F.col("_right").isNull() | F.coalesce((to_left <= 0) | (to_left <= to_right), F.lit(False))
    nearest = found.select(
        "trace_id",
        F.col("_id").alias("line_no"),
        F.when(pick_left, F.col("_left.launch_index"))
        .otherwise(F.col("_right.launch_index"))
        .alias("launch_index"),
    )
    return points.join(nearest, ["trace_id", "line_no"], "left")


def assign_waits(waits: DataFrame, cbs: DataFrame, launches: DataFrame) -> DataFrame:
    """Launch of each wait: the owner's for waits anchored on their command buffer,
    else the nearest one in time; NULL where neither is known."""
    owners = cbs.filter("command_buffer_index IS NOT NULL").select(
        "trace_id", "command_buffer_index", F.col("launch_index").alias("_owner_launch")
    )
    located = nearest_launch(waits, launches)
    # Only waits anchored on their command buffer look for it; most have no owner at all.
    fallback = F.coalesce(F.col("placement") == "legacy-command-buffer-fallback", F.lit(False))
    owned = located.filter(fallback).join(owners, ["trace_id", "command_buffer_index"], "left")
    owned = owned.withColumn("launch_index", F.coalesce("_owner_launch", "launch_index"))
    return owned.select(*waits.columns, "launch_index").unionByName(located.filter(~fallback).select(*waits.columns, "launch_index"))


def omissions(dispatches: DataFrame, waits: DataFrame, launches: DataFrame) -> DataFrame:
    """Records that no range can count: per launch those without a time, and per trace
    (repeated on each launch) those that belong to no launch at all."""
    def tally(df: DataFrame, kind: str) -> DataFrame:
        return df.groupBy("trace_id", "launch_index").agg(
            F.count(F.when(F.col("at_ns").isNull(), 1)).alias(f"{kind}_untimed"),
            F.count(F.lit(1)).alias(f"{kind}_all"),
        )

    per_launch = launches.select(*LAUNCH)
    traces = None
    for df, kind in ((dispatches, "dispatches"), (waits, "waits")):
        counts = tally(df, kind)
        inside = counts.filter("launch_index IS NOT NULL").drop(f"{kind}_all")
        lost = counts.filter("launch_index IS NULL").select("trace_id", f"{kind}_all")
        per_launch = per_launch.join(inside, LAUNCH, "left")
        traces = lost if traces is None else traces.join(lost, "trace_id", "full")

    def number(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(alias)

    return per_launch.join(traces, "trace_id", "full").select(
        "trace_id",
        "launch_index",
        number("dispatches_untimed", "unplaced_dispatches"),
        number("waits_untimed", "unanchored_waits"),
        number("dispatches_all", "unattributable_dispatches"),
        number("waits_all", "unattributable_waits"),
    )
