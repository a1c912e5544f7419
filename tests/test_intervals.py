"""Interval sets and ordered scans against brute force, in one block and in many."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from dispatchlake.operators.intervals import coverage, intersect_intervals, subtract_intervals, union_intervals
from dispatchlake.operators.marks import even_sample
from dispatchlake.operators.ordered import exact_median, with_rank

KEYS = ["trace_id"]


@pytest.fixture(params=["true", "false"], ids=["one-block", "many-blocks"], autouse=True)
def block_mode(request, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def make(spark, seed: int, n: int = 120):
    """One trace holds most of the intervals; some are empty, reversed, or equal."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = float(rng.randrange(0, 900))
        rows.append(("hot" if i % 6 else "cold", start, start + rng.choice([-3, 0, 1, 2, 5, 40])))
    return rows, spark.createDataFrame(rows, "trace_id string, start_ns double, end_ns double")


def cells(rows, trace: str) -> set[int]:
    return {t for k, s, e in rows if k == trace for t in range(int(s), int(e))}


def merged(points: set[int]) -> list[tuple[float, float]]:
    result: list[list[float]] = []
    for t in sorted(points):
        if result and result[-1][1] == t:
            result[-1][1] = t + 1.0
        else:
            result.append([float(t), t + 1.0])
    return [tuple(r) for r in result]


def per_trace(df) -> dict[str, list]:
    found: dict[str, list] = {}
    for row in df.collect():
        found.setdefault(row["trace_id"], []).append((row["start_ns"], row["end_ns"]))
    return {k: sorted(v) for k, v in found.items()}


def test_set_operations_match_brute_force(spark):
    left_rows, left = make(spark, 1)
    right_rows, right = make(spark, 2, 60)
    union, both, rest = (
        per_trace(df)
        for df in (union_intervals(left, KEYS), intersect_intervals(left, right, KEYS), subtract_intervals(left, right, KEYS))
    )
    for trace in ("hot", "cold"):
        a, b = cells(left_rows, trace), cells(right_rows, trace)
        assert union[trace] == merged(a)
        assert sum(e - s for s, e in both.get(trace, [])) == len(a & b)
        assert sum(e - s for s, e in rest.get(trace, [])) == len(a - b)
        assert {t for s, e in both.get(trace, []) for t in range(int(s), int(e))} == a & b
        assert {t for s, e in rest.get(trace, []) for t in range(int(s), int(e))} == a - b


def test_difference_keeps_traces_without_cover(spark):
    left = spark.createDataFrame([("a", 0.0, 5.0), ("b", 0.0, 5.0)], "trace_id string, start_ns double, end_ns double")
    right = spark.createDataFrame([("a", 1.0, 2.0)], "trace_id string, start_ns double, end_ns double")
    assert per_trace(subtract_intervals(left, right, KEYS)) == {"a": [(0.0, 1.0), (2.0, 5.0)], "b": [(0.0, 5.0)]}


def test_touching_intervals_become_one(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 3.0, 4.0)], "trace_id string, start_ns double, end_ns double")
    assert per_trace(union_intervals(df, KEYS)) == {"a": [(0.0, 2.0), (3.0, 4.0)]}


def test_coverage_before_points(spark):
    rows, df = make(spark, 3)
    points = spark.createDataFrame(
        [("hot", i, float(t)) for i, t in enumerate(range(0, 950, 37))], "trace_id string, line_no bigint, at_ns double"
    )
    found = coverage(df, points, KEYS, "at_ns", ["line_no"])
    covered = cells(rows, "hot")
    for row in found.points.collect():
        assert row["covered_ns"] == len([t for t in covered if t < row["at_ns"]])
    totals = {r["trace_id"]: r["busy_ns"] for r in found.totals.collect()}
    assert totals == {k: len(cells(rows, k)) for k in ("hot", "cold")}


def test_rank_and_median_and_sample(spark):
    rng = random.Random(5)
    values = [("hot", i, float(rng.choice([1, 1, 1, 2, 7, 9, 30]))) for i in range(101)] + [("cold", 0, 4.0), ("cold", 1, 9.0)]
    df = spark.createDataFrame(values, "trace_id string, line_no bigint, v double")
    ranks = {(r["trace_id"], r["line_no"]): (r["_rank"], r["_total"]) for r in with_rank(df, KEYS, ["line_no"]).collect()}
    assert all(ranks[("hot", i)] == (i, 101) for i in range(101))
    medians = {r["trace_id"]: r["m"] for r in exact_median(df, KEYS, "v", "m").collect()}
    assert medians == {"hot": statistics.median(v for k, _, v in values if k == "hot"), "cold": 6.5}
    taken = even_sample(df.filter("trace_id = 'hot'"), KEYS, ["line_no"], 7).select("line_no").orderBy("line_no")
    assert [r[0] for r in taken.collect()] == [i * 100 // 6 for i in range(7)]
    assert even_sample(df.filter("trace_id = 'cold'"), KEYS, ["line_no"], 7).count() == 2
    assert df.agg(F.count(F.lit(1))).collect()[0][0] == 103
