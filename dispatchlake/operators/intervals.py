"""Interval sets: union, intersection, difference, and covered length up to a time.

An interval set is a DataFrame with key columns, ``start_ns`` and ``end_ns``. Rows
that are not finite or have no positive length do not count.

All operators here sweep once over the starts in time order and look only at the
latest end seen so far, so their cost does not depend on how much intervals
overlap, and nothing is paired within a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions.guards import checked, is_interval
from dispatchlake.operators.ordered import blocks

FOREVER = float("inf")


def valid_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start_ns", end: str = "end_ns"
) -> DataFrame:
    """Project and keep the usable intervals."""
    return df.filter(is_interval(F.col(start), F.col(end))).select(
        *keys, F.col(start).cast("double").alias("start_ns"), F.col(end).cast("double").alias("end_ns")
    )


def _longest_per_start(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Among intervals with one start the longest covers the others."""
    return valid_intervals(df, keys).groupBy(*keys, "start_ns").agg(F.max("end_ns").alias("end_ns"))


def _islands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union as ``start_ns, end_ns`` plus ``gap_from_ns``, the previous island's end."""
    cut = blocks(_longest_per_start(df, keys), keys, ["start_ns"])
    rows = cut.with_carry(cut.rows, {"_m": F.max("end_ns")}, {"_carry": F.max("_m")})
    # greatest() skips NULLs; both are NULL only for the first interval of a key.
    rows = rows.withColumn(
        "_reach", F.greatest(F.col("_carry"), F.max("end_ns").over(cut.before))
    ).withColumn("_opens", F.col("_reach").isNull() | (F.col("start_ns") > F.col("_reach")))
    # An opening row tells where the island before it ended.
    stop = F.when(F.col("_opens"), F.col("_reach"))
    chained = cut.with_carry(
        rows,
        {
            "_stop": F.min_by(stop, F.when(F.col("_opens"), F.col("start_ns"))),
            "_top": F.max("end_ns"),
        },
        {},
        {"_stop_later": F.last("_stop", ignorenulls=True), "_top_later": F.max("_top")},
    )
    return (
        chained.withColumn(
            "_end",
            F.coalesce(
                F.last(stop, ignorenulls=True).over(cut.after),
                F.col("_stop_later"),
                F.greatest(F.max("end_ns").over(cut.from_here), F.col("_top_later")),
            ),
        )
        .filter("_opens")
        .select(*keys, "start_ns", F.col("_end").alias("end_ns"), F.col("_reach").alias("gap_from_ns"))
    )


def union_intervals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint, maximal intervals per key; touching intervals become one."""
    return _islands(df, keys).select(*keys, "start_ns", "end_ns")


def _overlaps_of_disjoint(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common parts of two sets that are each free of overlaps.

    Every common part begins where the later of its two intervals begins, and
    the only partner it can have is the last interval of the other side that
    began no later.
    """
    both = left.select(*keys, "start_ns", "end_ns", F.lit(0).alias("_side")).unionByName(
        right.select(*keys, "start_ns", "end_ns", F.lit(1).alias("_side"))
    )
    cut = blocks(both, keys, ["start_ns", "_side"])

    def side_end(side: int):
        return F.when(F.col("_side") == side, F.col("end_ns"))

    def side_start(side: int):
        return F.when(F.col("_side") == side, F.col("start_ns"))

    rows = cut.with_carry(
        cut.rows,
        {f"_end{s}": F.max_by(side_end(s), side_start(s)) for s in (0, 1)},
        {f"_carry{s}": F.last(f"_end{s}", ignorenulls=True) for s in (0, 1)},
    )
    latest = [
        F.coalesce(F.last(side_end(s), ignorenulls=True).over(cut.before), F.col(f"_carry{s}"))
        for s in (0, 1)
    ]
    rows = rows.withColumn("_other", F.when(F.col("_side") == 0, latest[1]).otherwise(latest[0]))
    return rows.filter("_other > start_ns").select(
        *keys, "start_ns", F.least("end_ns", "_other").alias("end_ns")
    )


def intersect_intervals(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts common to the unions of both sets."""
    return _overlaps_of_disjoint(union_intervals(left, keys), union_intervals(right, keys), keys)


def subtract_intervals(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of the union of ``left`` that ``right`` does not cover."""
    source = union_intervals(left, keys)
    cover = _islands(right, keys)
    between = cover.select(
        *keys,
        F.coalesce("gap_from_ns", F.lit(-FOREVER)).alias("start_ns"),
        F.col("start_ns").alias("end_ns"),
    )
    behind = cover.groupBy(*keys).agg(F.max("end_ns").alias("start_ns")).withColumn("end_ns", F.lit(FOREVER))
    untouched = (
        valid_intervals(left, keys)
        .select(*keys)
        .distinct()
        .join(valid_intervals(right, keys).select(*keys).distinct(), list(keys), "left_anti")
        .select(*keys, F.lit(-FOREVER).alias("start_ns"), F.lit(FOREVER).alias("end_ns"))
    )
    free = between.unionByName(behind).unionByName(untouched)
    return _overlaps_of_disjoint(source, free, keys)


@dataclass(frozen=True)
class Coverage:
    """What the intervals of a key cover.

    ``points``: the asked points with ``covered_ns`` (covered length before the
    point), ``reach_ns`` (latest end among intervals begun by then) and
    ``islands_begun``. ``totals``: per key ``busy_ns``, the whole covered length.
    """

    points: DataFrame
    totals: DataFrame


def coverage(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    at: str,
    ident: Sequence[str],
) -> Coverage:
    """Covered length of the union of ``intervals`` before each point.

    Take the intervals begun by time t. Beyond t their union is the one stretch
    [t, latest end], so the covered length before t is the length of that union
    less what reaches past t. Both are running values over the starts.
    ``ident`` must identify a point within its key.
    """
    spans = _longest_per_start(intervals, keys).select(
        *keys,
        F.col("start_ns").alias("_t"),
        F.col("end_ns").alias("_e"),
        *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ident],
    )
    asked = points.filter(F.col(at).isNotNull()).select(
        *keys, F.col(at).cast("double").alias("_t"), F.lit(None).cast("double").alias("_e"), *ident
    )
    cut = blocks(spans.unionByName(asked), keys, ["_t", *ident])
    rows = cut.with_carry(cut.rows, {"_m": F.max("_e")}, {"_carry": F.max("_m")})
    rows = rows.withColumn("_reach", F.greatest(F.col("_carry"), F.max("_e").over(cut.before)))
    fresh = F.greatest(F.col("_e") - F.greatest("_t", "_reach"), F.lit(0.0))
    rows = rows.withColumn("_adds", F.when(F.col("_e").isNull(), 0.0).otherwise(fresh)).withColumn(
        "_opens",
        (F.col("_e").isNotNull() & (F.col("_reach").isNull() | (F.col("_t") > F.col("_reach")))).cast("long"),
    )
    summed = cut.with_carry(
        rows,
        {"_block_adds": F.sum("_adds"), "_block_opens": F.sum("_opens")},
        {"_adds_before": F.sum("_block_adds"), "_opens_before": F.sum("_block_opens")},
    )
    length = F.coalesce("_adds_before", F.lit(0.0)) + F.sum("_adds").over(cut.upto)
    begun = F.coalesce("_opens_before", F.lit(0)) + F.sum("_opens").over(cut.upto)
    past = F.greatest(F.coalesce(F.col("_reach") - F.col("_t"), F.lit(0.0)), F.lit(0.0))
    placed = (
        summed.withColumn("_length", length)
        .withColumn("_begun", begun)
        .filter(F.col("_e").isNull())
        .select(
            *keys,
            *ident,
            F.col("_t").alias(at),
            (F.col("_length") - past).alias("covered_ns"),
            F.col("_reach").alias("reach_ns"),
            F.col("_begun").alias("islands_begun"),
        )
    )
    totals = rows.groupBy(*keys).agg(checked(F.sum("_adds"), "covered length").alias("busy_ns"))
    return Coverage(placed, totals)
