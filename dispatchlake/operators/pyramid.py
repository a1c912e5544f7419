"""A stored pyramid of dispatch counts: density at any zoom from a number of blocks that follows the width asked for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.operators.bins import folded_bins, kernel_name, pixel, with_mode
from dispatchlake.operators.launches import LAUNCH
from dispatchlake.operators.ordered import with_rank
from dispatchlake.session import settle

#: Dispatches of a leaf block, and blocks that make up one of the next level.
LEAF, FANOUT = 64, 16
_BLOCK = [*LAUNCH, "level", "block"]
_EXTENT = ("first", "last", "_low", "_high", "_unowned")


@dataclass(frozen=True)
class Pyramid:
    """``rows``: placed dispatches with their leaf ``block``. ``blocks``: per level and block the number
    ``n`` of dispatches, the ``first`` and ``last`` one and the range of their owners. ``counts``: ``n`` per level,
    block and kernel. What does not depend on the kernel is kept once a block."""

    rows: DataFrame
    blocks: DataFrame
    counts: DataFrame

    @property
    def top(self) -> int:
        """The level on which every launch is one block."""
        return self.blocks.agg(F.max("level")).first()[0] or 0


def _extent(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_unowned").alias("_unowned"), F.sum("n").alias("n"),
    )


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "kernel").agg(F.sum("n").alias("n"))


def _single(rows: DataFrame, *columns: str) -> DataFrame:
    """Every dispatch as a block of its own."""
    at = F.struct("at_ns", "line_no")
    owner = F.col("command_buffer_index")
    return rows.select(*columns, "kernel", F.lit(1).cast("bigint").alias("n"), at.alias("first"), at.alias("last"), owner.alias("_low"), owner.alias("_high"), owner.isNull().alias("_unowned"))


def _leaf_blocks(ranked: DataFrame) -> DataFrame:
    """Ends and owners of the leaves: at either end lies the dispatch of least or greatest rank."""
    opens = F.col("_rank") % LEAF == 0
    closes = (F.col("_rank") % LEAF == LEAF - 1) | (F.col("_rank") == F.col("_total") - 1)
    owner = F.col("command_buffer_index")
    found = ranked.groupBy(*LAUNCH, "block").agg(
        F.min("at_ns").alias("_a"), F.max(F.when(opens, F.col("line_no"))).alias("_a_line"),
        F.max("at_ns").alias("_b"), F.max(F.when(closes, F.col("line_no"))).alias("_b_line"),
        F.min(owner).alias("_low"), F.max(owner).alias("_high"), F.max(owner.isNull()).alias("_unowned"), F.count(F.lit(1)).alias("n"),
    )
    ends = [F.struct(F.col(at).alias("at_ns"), F.col(line).alias("line_no")).alias(name) for at, line, name in (("_a", "_a_line", "first"), ("_b", "_b_line", "last"))]
    return found.select(*LAUNCH, "block", *ends, "_low", "_high", "_unowned", "n")


def build_pyramid(dispatches: DataFrame) -> Pyramid:
    """Number the dispatches of a launch in time order, and count them in blocks of blocks.

    Blocks hold equally many dispatches, so a burst is as deep as a quiet stretch.
    A level is made from the one below, until every launch is one block.
    """
    placed = dispatches.filter("launch_index IS NOT NULL AND at_ns IS NOT NULL").select(*LAUNCH, "at_ns", "line_no", kernel_name().alias("kernel"), "command_buffer_index")
    ranked = with_rank(placed, LAUNCH, ["at_ns", "line_no"]).withColumn("block", F.floor(F.col("_rank") / LEAF).cast("bigint"))
    rows = ranked.select(*placed.columns, "block")
    blocks = [settle(_leaf_blocks(ranked))]
    counts = [settle(rows.groupBy(*LAUNCH, "block", "kernel").agg(F.count(F.lit(1)).alias("n")))]
    while (blocks[-1].agg(F.max("block")).first()[0] or 0) > 0:
        parent = F.floor(F.col("block") / FANOUT).cast("bigint")
        blocks.append(settle(_extent(blocks[-1].withColumn("block", parent), [*LAUNCH, "block"])))
        counts.append(settle(_counted(counts[-1].withColumn("block", parent), [*LAUNCH, "block"])))

    def levels(tables: Sequence[DataFrame], *columns: str | Column) -> DataFrame:
        made = [t.select(*LAUNCH, F.lit(level).alias("level"), "block", *columns) for level, t in enumerate(tables)]
        return reduce(DataFrame.unionByName, made)

    ends = (F.col("first.at_ns").alias("first_at"), F.col("last.at_ns").alias("last_at"))
    return Pyramid(rows, levels(blocks, *ends, *_EXTENT, "n"), levels(counts, "kernel", "n"))


def write_pyramid(pyramid: Pyramid, root: str) -> None:
    """Store the tables, levels in folders of their own, rows and blocks of a launch next to each other.

    ``build_pyramid`` leaves rows in ranges of (launch, block), so they need no other move to lie so.
    """
    pyramid.rows.sortWithinPartitions(*LAUNCH, "block").write.mode("overwrite").parquet(f"{root}/rows")
    for name in ("blocks", "counts"):
        table = getattr(pyramid, name).repartitionByRange("level", *LAUNCH, "block").sortWithinPartitions("level", *LAUNCH, "block")
        table.write.mode("overwrite").partitionBy("level").parquet(f"{root}/{name}")


def read_pyramid(spark: SparkSession, root: str) -> Pyramid:
    return Pyramid(*(spark.read.parquet(f"{root}/{name}") for name in ("rows", "blocks", "counts")))


@dataclass(frozen=True)
class _Descent:
    """What a viewport is made of: whole ``blocks`` with their ``bin``, single ``rows`` of leaf blocks that
    a bin's edge cuts, and how many blocks each level was ``looked`` at."""

    blocks: DataFrame
    rows: DataFrame
    looked: DataFrame


def _descend(pyramid: Pyramid, ranges: DataFrame, keys: Sequence[str], width: int) -> _Descent:
    """From the one block of a launch down: a block inside one bin is taken whole, one that a bin's edge or an
    end of the viewport cuts is opened. An edge cuts one block of a level, so a level opens ``width`` + 1 at most."""
    asked = ranges.filter("end_ns > start_ns").select(*keys, F.col("start_ns").alias("range_start_ns"), F.col("end_ns").alias("range_end_ns"))
    whole = (F.col("first_at") >= F.col("range_start_ns")) & (F.col("last_at") <= F.col("range_end_ns"))
    one_bin = whole & (pixel(F.col("first_at"), width) == pixel(F.col("last_at"), width))
    touches = (F.col("last_at") >= F.col("range_start_ns")) & (F.col("first_at") <= F.col("range_end_ns"))
    named = [*dict.fromkeys([*keys, *LAUNCH]), "range_start_ns", "range_end_ns"]
    top = pyramid.top
    opened, taken, looked = asked.withColumn("parent", F.lit(0).cast("bigint")), None, None
    for level in range(top, -1, -1):
        children = pyramid.blocks.filter(F.col("level") == level).select(*LAUNCH, "block", "first_at", "last_at", *_EXTENT, (F.lit(0) if level == top else F.floor(F.col("block") / FANOUT)).cast("bigint").alias("parent"))
        here = settle(opened.join(children, [*LAUNCH, "parent"]).select(*named, "block", "first_at", "last_at", *_EXTENT, F.lit(level).alias("level")))
        mine = here.filter(touches & one_bin).select(*named, "level", "block", *_EXTENT, pixel(F.col("first_at"), width).alias("bin"))
        seen = here.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"))
        taken = mine if taken is None else taken.unionByName(mine)
        looked = seen if looked is None else looked.unionByName(seen)
        opened = here.filter(touches & ~one_bin).select(*named, F.col("block").alias("parent"))
    rows = opened.withColumnRenamed("parent", "block").join(pyramid.rows, [*LAUNCH, "block"])
    return _Descent(taken, rows, looked)


def density_from_pyramid(pyramid: Pyramid, ranges: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The rows of ``bins.density_bins`` for ``ranges`` (``keys``, ``start_ns``, ``end_ns``), out of the stored pyramid.

    ``keys`` includes the launch. Equal to counting the dispatches of each range,
    but a range costs in proportion to ``width`` however many dispatches it has.
    """
    columns = max(1, int(width))
    found = _descend(pyramid, ranges, keys, columns)
    scope = [*keys, "range_start_ns", "range_end_ns", "bin"]
    inside = found.rows.filter(F.col("at_ns").between(F.col("range_start_ns"), F.col("range_end_ns"))).withColumn("bin", pixel(F.col("at_ns"), columns))
    single = _single(inside, *scope)
    by_block = found.blocks.join(pyramid.counts, _BLOCK).select(*scope, "kernel", "n")
    kernels = _counted(by_block.unionByName(single.select(*scope, "kernel", "n")), scope)
    ends = found.blocks.withColumn("n", F.lit(0).cast("bigint")).select(*scope, "n", *_EXTENT).unionByName(single.withColumn("n", F.lit(0).cast("bigint")).select(*scope, "n", *_EXTENT))
    return folded_bins(kernels.unionByName(_extent(ends, scope), allowMissingColumns=True), keys, columns)


def density_mode_from_pyramid(pyramid: Pyramid, ranges: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """The rows of ``bins.density_mode``: one bin over the whole range has its count and extent."""
    spread = density_from_pyramid(pyramid, ranges, keys, 1).select(*keys, F.col("count").alias("n"), (F.col("last_at_ns") - F.col("first_at_ns")).alias("extent"))
    return with_mode(ranges, spread, keys, width)


def looked_at(pyramid: Pyramid, ranges: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Blocks and single dispatches that each range reads: what it costs."""
    found = _descend(pyramid, ranges, keys, max(1, int(width)))
    rows = found.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return found.looked.groupBy(*keys).agg(F.sum("blocks").alias("blocks")).join(rows, list(keys), "left").fillna(0, ["rows"])
