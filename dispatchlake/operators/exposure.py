"""Host encode time hidden behind GPU execution, and exposed outside of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions.guards import is_interval
from dispatchlake.operators.intervals import Coverage, _islands, coverage
from dispatchlake.operators.ordered import with_rank

TRACE = ["trace_id"]


def has_encode() -> Column:
    return is_interval(F.col("encode_start_ns"), F.col("encode_end_ns"))


def has_gpu() -> Column:
    return is_interval(F.col("gpu_start_ns"), F.col("gpu_end_ns"))


def gpu_intervals(cbs: DataFrame, keys: list[str]) -> DataFrame:
    return cbs.filter(has_gpu()).select(
        *keys, F.col("gpu_start_ns").alias("start_ns"), F.col("gpu_end_ns").alias("end_ns")
    )


def encode_coverage(cbs: DataFrame) -> Coverage:
    """GPU-covered length of the trace before each encode start (0) and end (1)."""
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("encode_start_ns").alias("at_ns")),
        F.struct(F.lit(1).alias("side"), F.col("encode_end_ns").alias("at_ns")),
    )
    points = (
        cbs.filter(has_encode())
        .select("trace_id", "line_no", F.explode(ends).alias("p"))
        .select("trace_id", "line_no", "p.side", "p.at_ns")
    )
    return coverage(gpu_intervals(cbs, TRACE), points, TRACE, "at_ns", ["line_no", "side"])


def _by_command_buffer(points: DataFrame) -> DataFrame:
    def at(side: int, value: Column) -> Column:
        return F.max(F.when(F.col("side") == side, value))

    inside = F.coalesce(F.col("reach_ns") > F.col("at_ns"), F.lit(False))
    return points.groupBy("trace_id", "line_no").agg(
        at(0, F.col("covered_ns")).alias("covered_at_start"),
        at(1, F.col("covered_ns")).alias("covered_at_end"),
        at(0, F.col("islands_begun") - inside.cast("long")).alias("first_island"),
        at(1, F.col("islands_begun")).alias("after_island"),
    )


def exposure(cbs: DataFrame, covered: Coverage | None = None) -> DataFrame:
    """Add ``hidden_host_ns`` and ``exposed_host_ns``, measured against the GPU union
    of the whole trace, and the covered length at both encode ends.

    A command buffer without a usable encode interval gets zero for both.
    """
    covered = covered or encode_coverage(cbs)
    sides = _by_command_buffer(covered.points).select(
        "trace_id", "line_no", "covered_at_start", "covered_at_end"
    )
    hidden = F.col("covered_at_end") - F.col("covered_at_start")
    length = F.col("encode_end_ns") - F.col("encode_start_ns")
    joined = cbs.join(sides, ["trace_id", "line_no"], "left")
    return joined.select(
        *cbs.columns,
        F.coalesce(hidden, F.lit(0.0)).alias("hidden_host_ns"),
        F.coalesce(length - hidden, F.lit(0.0)).alias("exposed_host_ns"),
        "covered_at_start",
        "covered_at_end",
    )


def exposure_fragments(cbs: DataFrame) -> DataFrame:
    """The pieces themselves: one row per hidden or exposed stretch of an encode interval.

    Islands are numbered in time order; an encode interval meets a run of
    consecutive numbers, so pieces come from an equi-join on that number.
    """
    islands = _islands(gpu_intervals(cbs, TRACE), TRACE)
    numbered = with_rank(islands, TRACE, ["start_ns"]).select(
        "trace_id",
        F.col("_rank").alias("island"),
        F.coalesce("gap_from_ns", F.lit(float("-inf"))).alias("free_from"),
        F.col("start_ns").alias("busy_from"),
        F.col("end_ns").alias("busy_to"),
    )
    endless = F.lit(float("inf"))
    tail = numbered.groupBy("trace_id").agg(
        (F.max("island") + 1).alias("island"), F.max("busy_to").alias("free_from")
    )
    idle = (
        cbs.select("trace_id")
        .distinct()
        .join(tail, "trace_id", "left")
        .select(
            "trace_id",
            F.coalesce("island", F.lit(0)).alias("island"),
            F.coalesce("free_from", F.lit(float("-inf"))).alias("free_from"),
            endless.alias("busy_from"),
            endless.alias("busy_to"),
        )
    )
    sides = _by_command_buffer(encode_coverage(cbs).points)
    runs = (
        cbs.filter(has_encode())
        .select("trace_id", "line_no", "command_buffer_index", "encode_start_ns", "encode_end_ns")
        .join(sides, ["trace_id", "line_no"])
        .withColumn("island", F.explode(F.sequence("first_island", "after_island")))
    )
    met = runs.join(numbered.unionByName(idle), ["trace_id", "island"])

    def piece(kind: str, start: str, end: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.greatest("encode_start_ns", start).alias("start_ns"),
            F.least("encode_end_ns", end).alias("end_ns"),
        )

    pieces = F.array(piece("exposed", "free_from", "busy_from"), piece("hidden", "busy_from", "busy_to"))
    return (
        met.select("trace_id", "line_no", "command_buffer_index", F.explode(pieces).alias("p"))
        .select("trace_id", "line_no", "command_buffer_index", "p.*")
        .filter("end_ns > start_ns")
    )
