"""Scope summaries: extent, host and GPU time, waits and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions.guards import checked
from dispatchlake.functions.labels import human_ns
from dispatchlake.operators.census import HEADLINE, wait_totals
from dispatchlake.operators.exposure import gpu_intervals, has_gpu
from dispatchlake.operators.ordered import blocks
from dispatchlake.operators.intervals import _longest_per_start

ENDPOINTS = ("encode_start_ns", "encode_end_ns", "gpu_start_ns", "gpu_end_ns")
WAIT_COLUMNS = [*HEADLINE.values(), "headline_wait_ns"]

# Report lines as (label, column, evidence, measurement name, unit, evidence class).
METRICS = [
    ("Wall span", "wall_span_ns", "measured endpoints", "wall_span", "ns", "measured-endpoints"),
    ("Exposed host", "exposed_host_ns", "interval-derived", "exposed_host", "ns", "derived-intervals"),
    ("Hidden host", "hidden_host_ns", "interval-derived", "hidden_host", "ns", "derived-intervals"),
    ("GPU busy", "gpu_busy_ns", "interval-derived union", "gpu_busy", "ns", "derived-interval-union"),
    ("GPU work", "gpu_work_ns", "measured intervals", "gpu_work", "ns", "measured-intervals"),
    ("Decision drain", "decision_wait_ns", "measured waits", "decision_drain", "ns", "measured-waits"),
    ("Cap wait", "cap_wait_ns", "measured waits", "cap_wait", "ns", "measured-waits"),
    ("Dependency wait", "dependency_wait_ns", "measured waits", "dependency_wait", "ns", "measured-waits"),
    ("Command buffers", "cbs_total", "record count", "command_buffers", "count", "counted-records"),
    ("Dispatches", "ops_total", "record count", "dispatches", "count", "counted-records"),
]


def busy_time(cbs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length of the union of GPU intervals per key."""
    cut = blocks(_longest_per_start(gpu_intervals(cbs, list(keys)), keys), keys, ["start_ns"])
    rows = cut.with_carry(cut.rows, {"_m": F.max("end_ns")}, {"_carry": F.max("_m")})
    reach = F.greatest(F.col("_carry"), F.max("end_ns").over(cut.before))
    fresh = rows.withColumn("_fresh", F.greatest(F.col("end_ns") - F.greatest(F.col("start_ns"), reach), F.lit(0.0)))
    return fresh.groupBy(*keys).agg(checked(F.sum("_fresh"), "GPU busy duration").alias("busy_ns"))


def command_buffer_totals(cbs: DataFrame, keys: Sequence[str]) -> DataFrame:
    gpu_start = F.when(has_gpu(), F.col("gpu_start_ns"))
    gpu_end = F.when(has_gpu(), F.col("gpu_end_ns"))
    return cbs.groupBy(*keys).agg(
        F.min(F.least(*ENDPOINTS)).alias("_cb_start"),
        F.max(F.greatest(*ENDPOINTS)).alias("_cb_end"),
        checked(F.sum("exposed_host_ns"), "exposed host duration").alias("exposed_host_ns"),
        checked(F.sum("hidden_host_ns"), "hidden host duration").alias("hidden_host_ns"),
        checked(F.sum(gpu_end - gpu_start), "GPU work duration").alias("gpu_work_ns"),
        (F.max(gpu_end) - F.min(gpu_start)).alias("gpu_span_ns"),
        F.count(F.lit(1)).alias("cbs_total"),
    )


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)).alias(name)


def summarize(
    cbs: DataFrame,
    dispatches: DataFrame | None,
    waits: DataFrame | None,
    keys: Sequence[str],
    busy: DataFrame | None = None,
) -> DataFrame:
    """One row per scope that has any record.

    The extent spans all command-buffer endpoints and the anchors of its waits;
    GPU busy time is the union of the scope's own intervals. ``cbs`` carries
    ``hidden_host_ns`` and ``exposed_host_ns``.
    """
    keys = list(keys)
    busy = busy_time(cbs, keys) if busy is None else busy
    parts = command_buffer_totals(cbs, keys).join(busy, keys, "left")
    if waits is not None:
        anchors = waits.groupBy(*keys).agg(
            F.min("at_ns").alias("_wait_start"), F.max("at_ns").alias("_wait_end")
        )
        parts = parts.join(anchors, keys, "full").join(wait_totals(waits, keys), keys, "left")
    else:
        absent = [F.lit(None).cast("double").alias(c) for c in ("_wait_start", "_wait_end", *WAIT_COLUMNS)]
        parts = parts.select("*", *absent)
    if dispatches is not None:
        parts = parts.join(dispatches.groupBy(*keys).agg(F.count(F.lit(1)).alias("ops_total")), keys, "full")
    else:
        parts = parts.withColumn("ops_total", F.lit(None).cast("long"))
    start = F.least("_cb_start", "_wait_start")
    end = F.greatest("_cb_end", "_wait_end")
    return parts.select(
        *keys,
        start.alias("start_ns"),
        end.alias("end_ns"),
        checked(F.coalesce(end - start, F.lit(0.0)), "wall span").alias("wall_span_ns"),
        _zero("exposed_host_ns"),
        _zero("hidden_host_ns"),
        F.coalesce("busy_ns", F.lit(0.0)).alias("gpu_busy_ns"),
        _zero("gpu_work_ns"),
        _zero("gpu_span_ns"),
        *[_zero(c) for c in WAIT_COLUMNS],
        F.coalesce("ops_total", F.lit(0)).alias("ops_total"),
        F.coalesce("cbs_total", F.lit(0)).alias("cbs_total"),
    )


def metric_report(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ten labelled lines per scope, each with its kind of evidence."""
    def value(column: str, unit: str) -> Column:
        return human_ns(F.col(column)) if unit == "ns" else F.col(column).cast("string")

    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(label).alias("label"),
                value(column, unit).alias("value"),
                F.lit(evidence).alias("evidence"),
            )
            for i, (label, column, evidence, _, unit, _) in enumerate(METRICS)
        ]
    )
    return summary.select(*keys, F.explode(lines).alias("line")).select(*keys, "line.*")
