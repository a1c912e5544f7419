"""Selected time ranges of launches: checking them, and exact totals inside them.

Requests come as a table (``trace_id, launch_index, range_id, start_ns, end_ns``), so
that any number of ranges over any number of launches is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions.guards import is_finite, is_interval
from dispatchlake.operators.dyadic import above, cover
from dispatchlake.operators.exposure import has_encode, has_gpu
from dispatchlake.operators.launches import LAUNCH
from dispatchlake.operators.ordered import blocks
from dispatchlake.operators.range_totals import RANGE, RangeResult, analyze_ranges
from dispatchlake.operators.skew import salted_join
from dispatchlake.session import settle

__all__ = ["RANGE", "RangeResult", "analyze_ranges"]

SAFE_INTEGER = 2.0**53 - 1
# Why a launch or a request cannot be analysed.
NO_CB_TIMING = "missing-command-buffer-timing"
NO_LAUNCH_TIMING = "missing-launch-timing"
NANOSECONDS_AROUND_COMPLETION = 1_000_000.0


def range_availability(cbs: DataFrame, dispatches: DataFrame, launches: DataFrame) -> DataFrame:
    """Per launch ``available`` and ``reason``.

    Needs a positive launch length and, for every command buffer, a positive
    interval; an empty command buffer without dispatches may be a single instant.
    """

    def instant(start: str, end: str) -> Column:
        return is_finite(F.col(start)) & F.coalesce(F.col(start) == F.col(end), F.lit(False))

    hairline = instant("encode_start_ns", "encode_end_ns") | instant("gpu_start_ns", "gpu_end_ns")
    interval = has_encode() | has_gpu()
    # Owners are looked up for the command buffers alone that may be instants: written, their number is known.
    graded = cbs.select(*LAUNCH, "command_buffer_index", interval.alias("_ok"), (~interval & F.coalesce(F.col("op_count") == 0, F.lit(False)) & hairline).alias("_asks"))
    asked = settle(graded.filter("_asks").drop("_asks"))
    owner = [*LAUNCH, "command_buffer_index"]
    owners = dispatches.filter("launch_index IS NOT NULL AND command_buffer_index IS NOT NULL").select(*owner)
    owners = owners.join(asked.select(*owner).distinct(), owner, "left_semi").distinct().withColumn("_owns", F.lit(True))
    instants = asked.join(owners, owner, "left").select(*LAUNCH, F.col("_owns").isNull().alias("_ok"))
    others = graded.filter(~F.coalesce("_asks", F.lit(False))).select(*LAUNCH, "_ok")
    timed = others.unionByName(instants).groupBy(*LAUNCH).agg(F.min("_ok").alias("_timed"))
    length = F.col("end_ns") - F.col("start_ns")
    reason = F.when(~F.coalesce(length > 0, F.lit(False)), NO_LAUNCH_TIMING).when(
        ~F.coalesce(F.col("_timed"), F.lit(True)), NO_CB_TIMING
    )
    return launches.join(timed, LAUNCH, "left").select(
        *LAUNCH, reason.isNull().alias("available"), reason.alias("reason")
    )


def range_table(
    requests: DataFrame, launches: DataFrame, availability: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Clip requests to their launches; split into (ranges, errors)."""
    bounds = launches.select(
        *LAUNCH, F.col("start_ns").alias("launch_start_ns"), F.col("end_ns").alias("launch_end_ns"), F.lit(True).alias("_known")
    )
    joined = requests.join(bounds, LAUNCH, "left")
    if availability is not None:
        joined = joined.join(availability.select(*LAUNCH, F.col("reason").alias("_reason")), LAUNCH, "left")
    else:
        joined = joined.withColumn("_reason", F.lit(None).cast("string"))
    start = F.greatest("launch_start_ns", "start_ns")
    end = F.least("launch_end_ns", "end_ns")
    finite = is_finite(F.col("start_ns")) & is_finite(F.col("end_ns"))
    error = (
        F.when(F.col("_known").isNull(), "unknown-launch")
        .when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(~finite, "bounds-not-finite")
        .when(~is_interval(F.col("launch_start_ns"), F.col("launch_end_ns")), NO_LAUNCH_TIMING)
        .when(~(end > start), "empty-selection")
    )
    graded = joined.withColumn("error", error)
    ranges = graded.filter("error IS NULL").select(
        *RANGE, start.alias("start_ns"), end.alias("end_ns"), "launch_start_ns", "launch_end_ns"
    )
    return ranges, graded.filter("error IS NOT NULL").select(*RANGE, "start_ns", "end_ns", "error")


def shift_into(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Move a range into bounds keeping its length, or take the bounds when it is longer."""
    length = F.greatest(end - start, F.lit(1.0))
    moved = F.least(F.greatest(start, low), high - length)
    whole = length >= high - low
    return F.when(whole, low).otherwise(moved), F.when(whole, high).otherwise(moved + length)


def parse_selections(requests: DataFrame, launches: DataFrame) -> DataFrame:
    """Ranges given as text: ``mode`` (view or analyze), ``from`` and ``to`` in whole
    nanoseconds after the launch start.

    Anything unusable selects the whole launch; ranges beyond it are shifted in.
    """
    whole_number = r"^-?[0-9]+$"
    low, high = F.col("launch_start_ns"), F.col("launch_end_ns")
    first = F.when(F.col("from").rlike(whole_number), F.col("from").cast("double"))
    last = F.when(F.col("to").rlike(whole_number), F.col("to").cast("double"))
    start, end = low + first, low + last

    def safe(value: Column) -> Column:
        return F.abs(value) <= SAFE_INTEGER

    usable = F.coalesce(
        F.col("mode").isin("view", "analyze")
        & safe(first) & safe(last) & (last > first) & safe(start) & safe(end),
        F.lit(False),
    )
    moved_start, moved_end = shift_into(start, end, low, high)
    bounds = launches.select(
        *LAUNCH, F.col("start_ns").alias("launch_start_ns"), F.col("end_ns").alias("launch_end_ns")
    ).filter("launch_end_ns > launch_start_ns")
    return requests.join(bounds, LAUNCH).select(
        *RANGE,
        F.when(usable, F.col("mode")).otherwise("view").alias("mode"),
        F.when(usable, moved_start).otherwise(low).alias("start_ns"),
        F.when(usable, moved_end).otherwise(high).alias("end_ns"),
    )


def _range_side(ranges: DataFrame) -> DataFrame:
    return ranges.select(*RANGE, F.col("start_ns").alias("range_start_ns"), F.col("end_ns").alias("range_end_ns"))


def _levels(ranges: DataFrame) -> int:
    """Levels that blocks of edge numbers need: the logarithm of the most edges in one launch."""
    most = ranges.groupBy(*LAUNCH).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (2 * (most or 0) + 1).bit_length()


def match_ranges(rows: DataFrame, ranges: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Pair rows of a launch with the ranges that [start, end] touches, ends included; without ``end`` a row is a point.

    The edges of a launch's ranges are numbered in time order, in one sweep together
    with the starts and ends of the rows. A range then is a run of numbers between its
    edges, and a row's start is in it when its number is in the run. Runs are covered by
    aligned blocks, of which a number has one per level, so an equi-join on blocks finds
    just the ranges around a row's start. The ranges that begin later inside the row
    are found the other way round: the row is the run, the range's start the number. No
    row meets a range that it does not touch, and a launch with many ranges or rows is
    spread over its blocks.
    """
    side = _range_side(ranges)
    keyed = rows.withColumn("_a", start).withColumn("_b", start if end is None else end).filter("_a IS NOT NULL AND _b >= _a AND launch_index IS NOT NULL")
    keyed = keyed.withColumn("_row", F.monotonically_increasing_id())
    keyed = settle(keyed.join(side.select(*LAUNCH).distinct(), LAUNCH, "left_semi"))
    levels = _levels(side)

    def tokens(df: DataFrame, at: str, kind: int, ident: Column) -> DataFrame:
        # In time order; at equal times range starts, then rows, then range ends.
        return df.select(*LAUNCH, F.col(at).alias("_t"), F.lit(kind).alias("_kind"), ident.alias("_ident"))

    row, name = F.col("_row").cast("string"), F.col("range_id").cast("string")
    swept = tokens(side, "range_start_ns", 0, name).unionByName(tokens(side, "range_end_ns", 3, name)).unionByName(tokens(keyed, "_a", 1, row))
    if end is not None:
        swept = swept.unionByName(tokens(keyed.filter("_b > _a"), "_b", 2, row))
    cut = blocks(swept, LAUNCH, ["_t", "_kind", "_ident"])
    is_edge, is_start = F.col("_kind").isin(0, 3).cast("long"), (F.col("_kind") == 0).cast("long")
    carried = cut.with_carry(
        cut.rows.withColumn("_edge", is_edge).withColumn("_begin", is_start),
        {"_n": F.sum("_edge"), "_m": F.sum("_begin")},
        {"_n_before": F.sum("_n"), "_m_before": F.sum("_m")},
    )
    # For a range edge the number counts the edge itself.
    numbered = settle(
        carried.select(
            *LAUNCH,
            "_kind",
            "_ident",
            (F.coalesce("_n_before", F.lit(0)) + F.sum("_edge").over(cut.upto)).alias("_number"),
            (F.coalesce("_m_before", F.lit(0)) + F.sum("_begin").over(cut.upto)).alias("_begun"),
        )
    )

    def kind(number: int, *columns: Column) -> DataFrame:
        return numbered.filter(F.col("_kind") == number).select(*LAUNCH, "_ident", *columns)

    starts = kind(0, F.col("_number").alias("_from"), F.col("_begun").alias("_place"))
    ends = kind(3, (F.col("_number") - 1).alias("_to"))
    placed = side.withColumn("_ident", name).join(starts, [*LAUNCH, "_ident"]).join(ends, [*LAUNCH, "_ident"]).drop("_ident")
    firsts = kind(1, F.col("_number").alias("_at"), F.col("_begun").alias("_after"))
    located = keyed.withColumn("_ident", row).join(firsts, [*LAUNCH, "_ident"])
    if end is not None:
        located = settle(located.join(kind(2, F.col("_begun").alias("_upto")), [*LAUNCH, "_ident"], "left").drop("_ident"))

    block = ["_c.level", "_c.block"]
    tail = [c for c in placed.columns if c not in ("_from", "_to", "_place", *LAUNCH)]
    around = located.select(*rows.columns, F.explode(above(F.col("_at"), levels)).alias("_c")).select(*rows.columns, *block)
    runs = placed.select(*LAUNCH, *tail, F.explode(cover(F.col("_from"), F.col("_to"), levels)).alias("_c")).select(*LAUNCH, *tail, *block)
    by_start = around.join(runs, [*LAUNCH, "level", "block"])
    kept = [*rows.columns, *tail]
    if end is None:
        return by_start.select(*kept)
    inside = located.filter("_upto > _after").select(*rows.columns, F.explode(cover(F.col("_after") + 1, F.col("_upto"), levels)).alias("_c")).select(*rows.columns, *block)
    begun = placed.select(*LAUNCH, *tail, F.explode(above(F.col("_place"), levels)).alias("_c")).select(*LAUNCH, *tail, *block)
    by_begin = inside.join(begun, [*LAUNCH, "level", "block"])
    return by_start.select(*kept).unionByName(by_begin.select(*kept))


def points_in_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records whose ``at_ns`` lies in a range, both ends included."""
    return match_ranges(points, ranges, F.col("at_ns"))


def command_buffers_in_ranges(cbs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Command buffers with a positive part in a range, clipped; empty ones by their instant.

    Adds ``clip_encode_*``, ``clip_gpu_*`` (NULL when outside).
    """
    ends = ("encode_start_ns", "encode_end_ns", "gpu_start_ns", "gpu_end_ns")
    pairs = match_ranges(cbs, ranges, F.least(*ends), F.greatest(*ends))
    low, high = F.col("range_start_ns"), F.col("range_end_ns")

    def clip(kind: str, usable: Column) -> tuple[Column, Column]:
        start, end = F.col(f"{kind}_start_ns"), F.col(f"{kind}_end_ns")
        inside = usable & (F.least(end, high) > F.greatest(start, low))
        return F.when(inside, F.greatest(start, low)), F.when(inside, F.least(end, high))

    def instant(kind: str) -> Column:
        start, end = F.col(f"{kind}_start_ns"), F.col(f"{kind}_end_ns")
        return F.coalesce((start == end) & start.between(low, high), F.lit(False))

    encode, gpu = clip("encode", has_encode()), clip("gpu", has_gpu())
    empty = F.coalesce(F.col("op_count") == 0, F.lit(False)) & (instant("encode") | instant("gpu"))
    return (
        pairs.withColumn("clip_encode_start", encode[0])
        .withColumn("clip_encode_end", encode[1])
        .withColumn("clip_gpu_start", gpu[0])
        .withColumn("clip_gpu_end", gpu[1])
        .filter(F.col("clip_encode_start").isNotNull() | F.col("clip_gpu_start").isNotNull() | empty)
    )


def focus_ranges(cbs: DataFrame, dispatches: DataFrame, waits: DataFrame, launches: DataFrame) -> DataFrame:
    """The stretch of each launch worth showing first.

    Spans command buffers that own dispatches and the anchored waits, except
    completion waits far behind that activity; padded by 3 %. Launches that are
    busy for 90 % or more of their length are shown whole.
    """
    owners = (
        dispatches.filter("launch_index IS NOT NULL AND command_buffer_index IS NOT NULL")
        .select(*LAUNCH, "command_buffer_index")
        .distinct()
    )
    ends = ("encode_start_ns", "encode_end_ns", "gpu_start_ns", "gpu_end_ns")
    points = sum((F.col(e).isNotNull().cast("int") for e in ends), F.lit(0))
    active = (
        cbs.join(owners, [*LAUNCH, "command_buffer_index"], "left_semi")
        .groupBy(*LAUNCH)
        .agg(
            F.min(F.least(*ends)).alias("_s"), F.max(F.greatest(*ends)).alias("_e"), F.sum(points).alias("_n")
        )
    )
    near = F.greatest(F.lit(NANOSECONDS_AROUND_COMPLETION), (F.col("_e") - F.col("_s")) * 0.1)
    far = (F.col("bucket") == "cb_wait_until_completed") & (F.col("at_ns") > F.col("_e") + near)
    waited = (
        waits.filter("launch_index IS NOT NULL AND at_ns IS NOT NULL")
        .transform(lambda rows: salted_join(rows, active, LAUNCH, F.col("at_ns"), "left"))
        .filter(~F.coalesce(far, F.lit(False)))
        .groupBy(*LAUNCH)
        .agg(F.min("at_ns").alias("_ws"), F.max("at_ns").alias("_we"), F.count(F.lit(1)).alias("_wn"))
    )
    known = launches.filter("end_ns > start_ns").join(active, LAUNCH, "left").join(waited, LAUNCH, "left")
    start, end = F.least("_s", "_ws"), F.greatest("_e", "_we")
    n = F.coalesce("_n", F.lit(0)) + F.coalesce("_wn", F.lit(0))
    length = end - start
    low, high = F.col("start_ns"), F.col("end_ns")
    pad = F.floor(length * 0.03 + 0.5)
    narrow = F.coalesce((n >= 2) & (length > 0) & (length / (high - low) < 0.9), F.lit(False))
    moved_start, moved_end = shift_into(F.greatest(low, start - pad), F.least(high, end + pad), low, high)
    return known.select(
        *LAUNCH,
        F.when(narrow, moved_start).otherwise(low).alias("focus_start_ns"),
        F.when(narrow, moved_end).otherwise(high).alias("focus_end_ns"),
        (~narrow).alias("whole_launch"),
    )


def visible_command_buffers(cbs: DataFrame, waits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Command buffers that touch a viewport, or whose earliest anchored wait lies in it."""
    first_wait = (
        waits.filter("launch_index IS NOT NULL AND at_ns IS NOT NULL AND command_buffer_index IS NOT NULL")
        .groupBy(*LAUNCH, "command_buffer_index")
        .agg(F.min("at_ns").alias("_wait_at"))
    )
    ends = ("encode_start_ns", "encode_end_ns", "gpu_start_ns", "gpu_end_ns")
    with_wait = cbs.join(first_wait, [*LAUNCH, "command_buffer_index"], "left")
    by_extent = match_ranges(with_wait, ranges, F.least(*ends), F.greatest(*ends))
    outside = ~F.coalesce(
        (F.greatest(*ends) >= F.col("range_start_ns")) & (F.least(*ends) <= F.col("range_end_ns")), F.lit(False)
    )
    by_wait = match_ranges(with_wait, ranges, F.col("_wait_at")).filter(outside)
    return by_extent.unionByName(by_wait).drop("_wait_at")
