"""Density out of stored blocks: equal to counting, at a cost that follows the width."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dispatchlake.operators import bins, pyramid, ranges
from dispatchlake.operators.ordered import with_rank

DISPATCHES = "trace_id string, launch_index bigint, at_ns double, line_no bigint, kernel string, command_buffer_index double"
ASKED = "trace_id string, launch_index bigint, range_id string, start_ns double, end_ns double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    rows = []
    for launch, n in ((0, 20_000), (1, 63), (2, 1), (3, 0)):
        for i in range(n):
            # Half of the dispatches lie in a burst of a few nanoseconds.
            at = rng.choice([float(rng.randint(500, 505)), rng.random() * 1e6]) if launch == 0 else float(rng.randint(0, 40))
            rows.append(("t", launch, at, i, rng.choice(["a", "b", "b", "", None]), rng.choice([None, 1.0, 2.0]) if at > 1e5 else 1.0))
    rows += [("t", None, 5.0, -1, "a", 1.0), ("t", 0, None, -2, "a", 1.0)]
    asked = [("t", launch, f"r{i}", a, b) for launch in range(5) for i, (a, b) in enumerate([(0.0, 1e6), (400.0, 600.0), (501.5, 501.75), (503.0, 504.0), (-5.0, 30.0), (2e6, 3e6), (123.25, 987654.5), (9.0, 9.0)])]
    dispatches = spark.createDataFrame(rows, DISPATCHES).repartition(4)
    return dispatches, spark.createDataFrame(asked, ASKED)


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pyramid"))
    pyramid.write_pyramid(pyramid.build_pyramid(tables[0]), root)
    return pyramid.read_pyramid(spark, root)


def test_equal_to_counting(tables, stored):
    dispatches, asked = tables
    assert stored.top == 3
    selected = ranges.points_in_ranges(dispatches, asked)
    for width in (7, 1000):
        want = bins.density_bins(selected, ranges.RANGE, width)
        got = pyramid.density_from_pyramid(stored, asked, ranges.RANGE, width).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    long = asked.filter("end_ns > start_ns")
    want = bins.density_mode(selected, long, ranges.RANGE, 800).collect()
    assert sorted(map(tuple, pyramid.density_mode_from_pyramid(stored, long, ranges.RANGE, 800).collect())) == sorted(map(tuple, want))


def test_cost_follows_the_width(tables, stored):
    asked = tables[1]
    for width in (1, 20):
        cost = {(r.launch_index, r.range_id): (r.blocks, r.rows) for r in pyramid.looked_at(stored, asked, ranges.RANGE, width).collect()}
        # Each of the width + 1 edges opens one block of a level; on a burst of equal times, those that share a time.
        assert max(b for b, _ in cost.values()) <= 4 * pyramid.FANOUT * (width + 2)
        assert max(r for _, r in cost.values()) <= pyramid.LEAF * (width + 2)
        assert cost[0, "r0"][1] + cost[0, "r0"][0] < 20_000 / 4


def test_rows_move_once_and_ends_are_kept_once_a_block(tables, stored):
    # A rank takes a sort of the rows and a small table of what each block holds, no second shuffle of rows.
    ranked = with_rank(tables[0].filter("launch_index = 0"), ["trace_id", "launch_index"], ["at_ns", "line_no"])
    assert "Exchange hashpartitioning" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert set(stored.counts.columns) == {"trace_id", "launch_index", "level", "block", "kernel", "n"}
    by_block = stored.counts.groupBy("trace_id", "launch_index", "level", "block").agg(F.sum("n").alias("n"))
    for level in range(stored.top + 1):
        assert stored.blocks.filter(F.col("level") == level).agg(F.sum("n")).first()[0] == 20_064
    assert by_block.exceptAll(stored.blocks.select(by_block.columns)).isEmpty()
