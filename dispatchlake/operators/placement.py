"""Where records sit: duplicate quarantine, dispatch positions, legacy wait anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.operators.census import KERNEL_SUMS
from dispatchlake.operators.ordered import with_rank

OWNER = ["trace_id", "command_buffer_index"]
FALLBACK = "legacy-command-buffer-fallback"


def whole_owner(rows: DataFrame) -> DataFrame:
    """Indices of command buffers, which are whole numbers, as such: for tables stored by owner."""
    return rows.withColumn("command_buffer_index", F.col("command_buffer_index").cast("bigint"))


def duplicate_indices(cbs: DataFrame) -> DataFrame:
    """Command-buffer indices that occur more than once in a trace."""
    return (
        cbs.filter("command_buffer_index IS NOT NULL")
        .groupBy(*OWNER)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
    )


def quarantine(cbs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (accepted, quarantined).

    All rows of a repeated index are set aside; rows without an index never are.
    """
    repeated = duplicate_indices(cbs).select(*OWNER)
    return cbs.join(repeated, OWNER, "left_anti"), cbs.join(repeated, OWNER, "left_semi")


def sequence_bounds(ops: DataFrame, cbs: DataFrame) -> DataFrame:
    """Per indexed command buffer its sequence range: as declared when both ends are,
    else the range of the operations it owns."""
    owned = (
        ops.filter("command_buffer_index IS NOT NULL AND seq IS NOT NULL")
        .groupBy(*OWNER)
        .agg(F.min("seq").alias("_low"), F.max("seq").alias("_high"))
    )
    declared = F.col("first_op_seq").isNotNull() & F.col("last_op_seq").isNotNull()
    return (
        cbs.filter("command_buffer_index IS NOT NULL")
        .join(owned, OWNER, "left")
        .withColumn("first_seq", F.when(declared, F.col("first_op_seq")).otherwise(F.col("_low")))
        .withColumn("last_seq", F.when(declared, F.col("last_op_seq")).otherwise(F.col("_high")))
        .drop("_low", "_high")
    )


def counted_kernels(ops: DataFrame, cbs: DataFrame) -> DataFrame:
    """Operations counted by owner and kernel, with the owner's ``launch_index``.

    Counting comes before the join, so what meets the command buffers is a row per
    owner and kernel. No position is needed to know the launch of an operation.
    """
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in KERNEL_SUMS]
    counted = ops.filter("kernel IS NOT NULL").groupBy(*OWNER, "kernel").agg(F.count(F.lit(1)).alias("count"), *sums)
    return counted.join(cbs.filter("command_buffer_index IS NOT NULL").select(*OWNER, "launch_index"), OWNER, "left")


def place(ops: DataFrame, cbs: DataFrame) -> DataFrame:
    """Give each operation a position inside its command buffer's encode interval.

    Positions are interpolated by sequence number; they say in which order work was
    encoded, not when it ran. ``placement_detail`` says how a position came about
    or why there is none. ``launch_index`` comes along when ``cbs`` has it.

    The sequence range of ``sequence_bounds`` is taken on the operations as they meet their
    command buffer, so they are read and moved once; those without an index stay out of the join.
    """
    extra = [c for c in ("launch_index",) if c in cbs.columns]
    owners = cbs.filter("command_buffer_index IS NOT NULL").select(
        *OWNER, "encode_start_ns", "encode_end_ns", "first_op_seq", "last_op_seq", F.lit(True).alias("_found"), *extra
    )
    same_owner = Window.partitionBy(*OWNER)
    owned = ops.filter("command_buffer_index IS NOT NULL").select(
        "*", F.min("seq").over(same_owner).alias("_low"), F.max("seq").over(same_owner).alias("_high")
    )
    declared = F.col("first_op_seq").isNotNull() & F.col("last_op_seq").isNotNull()
    start, end = F.col("encode_start_ns"), F.col("encode_end_ns")
    first, last = F.col("first_seq"), F.col("last_seq")
    fraction = (F.col("seq") - first) / (last - first)
    detail = (
        F.when(F.col("_found").isNull(), "missing-parent-command-buffer")
        .when(start.isNull() | end.isNull(), "missing-encode-interval")
        .when(end <= start, "degenerate-encode-interval")
        .when(F.col("seq").isNull(), "missing-sequence")
        .when(first.isNull() | last.isNull(), "missing-sequence-span")
        .when(last <= first, "degenerate-sequence-span")
        .when((F.col("seq") < first) | (F.col("seq") > last), "sequence-outside-span")
        .otherwise("interpolated-sequence")
    )
    midpoint = start + (end - start) / 2
    at = F.when(
        F.col("placement_detail").isin("missing-sequence-span", "degenerate-sequence-span"), midpoint
    ).when(F.col("placement_detail") == "interpolated-sequence", start + fraction * (end - start))
    placed = (
        owned.join(owners, OWNER, "left")
        .withColumn("first_seq", F.when(declared, F.col("first_op_seq")).otherwise(F.col("_low")))
        .withColumn("last_seq", F.when(declared, F.col("last_op_seq")).otherwise(F.col("_high")))
        .withColumn("placement_detail", detail)
        .withColumn("at_ns", at)
        .select(*ops.columns, "at_ns", "placement_detail", *extra)
    )
    nowhere = [F.lit(None).cast(cbs.schema[c].dataType).alias(c) for c in extra]
    unowned = ops.filter("command_buffer_index IS NULL").select(
        *ops.columns, F.lit(None).cast("double").alias("at_ns"), F.lit("missing-parent-command-buffer").alias("placement_detail"), *nowhere
    )
    return placed.unionByName(unowned)


def anchor_waits(waits: DataFrame, cbs: DataFrame) -> DataFrame:
    """Anchor old-style waits (no time, numeric ``cb_index``) on their command buffer.

    Encode end is preferred over encode start over GPU start; ``at_ns_source`` says
    which was used and ``placement`` marks the row.
    """
    owners = cbs.filter("command_buffer_index IS NOT NULL").select(
        *OWNER, "encode_end_ns", "encode_start_ns", "gpu_start_ns"
    )
    needed = F.col("at_ns").isNull() & F.col("has_legacy_index") & F.col("command_buffer_index").isNotNull()
    needed = F.coalesce(needed, F.lit(False))
    source = (
        F.when(F.col("encode_end_ns").isNotNull(), "command-buffer-encode-end")
        .when(F.col("encode_start_ns").isNotNull(), "command-buffer-encode-start")
        .when(F.col("gpu_start_ns").isNotNull(), "command-buffer-gpu-start")
    )
    anchor = F.coalesce("encode_end_ns", "encode_start_ns", "gpu_start_ns")
    # Waits that need no anchor stay out of the join; most of them have no owner.
    nothing = F.lit(None).cast("string")
    others = waits.filter(~needed).select("*", nothing.alias("at_ns_source"), nothing.alias("placement"))
    return (
        waits.filter(needed).join(owners, OWNER, "left")
        .withColumn("at_ns_source", source)
        .withColumn("at_ns", F.when(source.isNotNull(), anchor).otherwise(F.col("at_ns")))
        .withColumn("placement", F.when(F.col("at_ns_source").isNotNull(), FALLBACK))
        .select(*waits.columns, "at_ns_source", "placement")
        .unionByName(others)
    )


def dispatch_order(dispatches: DataFrame) -> DataFrame:
    """Numbered per trace from 0 (``place``) by sequence, then source order; rows without sequence last."""
    keyed = dispatches.withColumn("_by", F.coalesce("seq", F.lit(float("inf"))))
    return with_rank(keyed, ["trace_id"], ["_by", "line_no"]).withColumnRenamed("_rank", "place").drop("_by", "_total")
