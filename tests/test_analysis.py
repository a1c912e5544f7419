"""Launches, placement, anchors, summaries and ranges on hand-made records."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dispatchlake.functions.labels import human_bytes, human_ns, kernel_family
from dispatchlake.operators import ranges
from dispatchlake.operators.launches import LAUNCH
from dispatchlake.operators.marks import sort_rows
from dispatchlake.operators.normalize import normalize
from dispatchlake.operators.placement import quarantine
from dispatchlake.plans.analysis import Analysis
from dispatchlake.plans.queries import QUERIES
from dispatchlake.sources.lines import parse_lenient
from tests.captures import capture, lines

MS = 1_000_000


def analysed(spark, **captures) -> Analysis:
    records = normalize(parse_lenient(lines(spark, captures))[0])
    return Analysis(records.ops, records.cbs, records.waits)


def cb(index, start=None, end=None, gpu_start=None, gpu_end=None, **more) -> dict:
    fields = {"encode_start_ns": start, "encode_end_ns": end, "gpu_start_ns": gpu_start, "gpu_end_ns": gpu_end}
    return {"record": "cb", "command_buffer_index": index, **{k: v for k, v in fields.items() if v is not None}, **more}


def test_launches_split_on_long_gaps_and_untimed_come_last(spark):
    rows = [
        cb(0, 0, MS, MS, 2 * MS), cb(1, 3 * MS, 4 * MS), cb(9), cb(3, 5 * MS, 6 * MS),
        cb(2, 500 * MS, 501 * MS, 501 * MS, 502 * MS),
    ]
    a = analysed(spark, t=rows)
    found = {r["command_buffer_index"]: r["launch_index"] for r in a.command_buffers.collect()}
    assert found == {0.0: 0, 1.0: 0, 3.0: 0, 2.0: 1, 9.0: 1}
    parts = a.partitions.orderBy("launch_index").collect()
    assert [p["gap_before_ns"] for p in parts] == [None, 494.0 * MS]
    # The median gap is 1 ms, so the minimum of 100 ms decides.
    assert {p["gap_threshold_ns"] for p in parts} == {100.0 * MS}


def test_single_gap_is_its_own_median(spark):
    a = analysed(spark, t=[cb(0, 0, MS), cb(1, 200 * MS, 201 * MS)])
    # Twenty times the only gap exceeds it, so nothing is cut.
    assert [r["launch_index"] for r in a.command_buffers.collect()] == [0, 0]


def test_waits_go_to_the_nearest_launch_earlier_on_ties(spark):
    quiet = [cb(i, i * 2 * MS, (i * 2 + 1) * MS) for i in range(5)]
    rows = quiet + [cb(9, 1009 * MS, 1010 * MS)] + [
        {"record": "wait", "bucket": "cap_wait", "wait_ns": 1, "at_ns": at * MS} for at in (-5, 3, 509, 510, 2000)
    ] + [{"record": "wait", "bucket": "x", "wait_ns": 1}, {"record": "wait", "bucket": "x", "wait_ns": 1, "cb_index": 9}]
    a = analysed(spark, t=rows)
    found = [(r["at_ns"], r["launch_index"]) for r in a.launch_waits.orderBy("line_no").collect()]
    assert found == [(-5.0 * MS, 0), (3.0 * MS, 0), (509.0 * MS, 0), (510.0 * MS, 1), (2000.0 * MS, 1), (None, None), (1010.0 * MS, 1)]
    lost = a.launch_omissions.collect()
    assert {r["unattributable_waits"] for r in lost} == {1}


def test_every_placement_outcome(spark):
    rows = [
        cb(0, 0, 100, first_op_seq=0, last_op_seq=4), cb(1, 10), cb(2, 20, 20), cb(3, 0, 50), cb(4, 0, 60), cb(5, 0, 80),
        *[{"record": "op", "command_buffer_index": i, "seq": s} for i, s in ((0, 1), (0, 9), (1, 0), (2, 0), (3, 5), (7, 1))],
        {"record": "op", "command_buffer_index": 0}, {"record": "op", "command_buffer_index": 4}, {"record": "op", "seq": 1},
    ]
    a = analysed(spark, t=rows)
    found = [(r["at_ns"], r["placement_detail"]) for r in a.dispatches.orderBy("line_no").collect()]
    assert found == [
        (25.0, "interpolated-sequence"), (None, "sequence-outside-span"), (None, "missing-encode-interval"),
        (None, "degenerate-encode-interval"), (25.0, "degenerate-sequence-span"), (None, "missing-parent-command-buffer"),
        (None, "missing-sequence"), (None, "missing-sequence"), (None, "missing-parent-command-buffer"),
    ]


def test_quarantine_sets_all_copies_aside(spark):
    df = spark.createDataFrame([("t", 1.0), ("t", 1.0), ("t", 2.0), ("u", 1.0), ("t", None), ("t", None)], "trace_id string, command_buffer_index double")
    accepted, aside = quarantine(df)
    assert accepted.count() == 4 and aside.count() == 2


def test_whole_launch_range_equals_the_launch(spark):
    a = analysed(spark, t=capture(6), u=capture(3))
    asked = a.launches.select(*LAUNCH, F.lit("all").alias("range_id"), F.col("start_ns") - 5, F.col("end_ns") + 5).toDF(*ranges.RANGE, "start_ns", "end_ns")
    found, errors = ranges.range_table(asked, a.launches, a.availability)
    assert errors.count() == 0
    args = (a.command_buffers, a.dispatches, a.launch_waits, found, a.launch_omissions)
    names = [c for c in a.launch_summary.columns]
    expected = sorted(map(tuple, a.launch_summary.select(*names).collect()))
    assert sorted(map(tuple, ranges.analyze_ranges(*args).summary.select(*names).collect())) == expected


def test_rows_meet_exactly_the_ranges_they_touch(spark):
    rng = random.Random(4)
    asked = [(f"t{i % 2}", i % 3, f"r{i}", float(a := rng.randint(0, 60)), float(a + rng.randint(1, 30))) for i in range(60)]
    rows = [(f"t{i % 2}", rng.choice([0, 1, 2, 9, None]), i, float(a := rng.randint(-5, 95)), float(a + rng.choice([0, 0, 1, 9, 70]))) for i in range(200)]
    side = spark.createDataFrame(asked, "trace_id string, launch_index int, range_id string, start_ns double, end_ns double")
    left = spark.createDataFrame(rows, "trace_id string, launch_index int, line_no int, a double, b double")
    got = ranges.match_ranges(left, side, F.col("a"), F.col("b")).select("line_no", "range_id", "range_start_ns").collect()
    want = sorted((n, r, s) for t, l, n, a, b in rows for u, m, r, s, e in asked if (t, l) == (u, m) and b >= s and a <= e)
    assert sorted(map(tuple, got)) == want


def test_range_errors(spark):
    a = analysed(spark, t=capture(2))
    asked = spark.createDataFrame(
        [("t", 0, "out", 1e6, 2e6), ("t", 7, "none", 0.0, 1.0), ("t", 0, "nan", float("nan"), 5.0)],
        "trace_id string, launch_index bigint, range_id string, start_ns double, end_ns double",
    )
    errors = ranges.range_table(asked, a.launches, a.availability)[1]
    assert {r["range_id"]: r["error"] for r in errors.collect()} == {"out": "empty-selection", "none": "unknown-launch", "nan": "bounds-not-finite"}


def test_readable_quantities_and_families(spark):
    df = spark.createDataFrame([(999.0, 1023.0), (1500.0, 1536.0), (1234567.0, 1048576.0), (2.5e9, 3 * 1024.0**4), (None, None)], "n double, b double")
    assert [tuple(r) for r in df.select(human_ns(F.col("n")), human_bytes(F.col("b"))).collect()] == [
        ("999 ns", "1023 B"), ("1.5 µs", "1.5 KiB"), ("1.23 ms", "1 MiB"), ("2.5 s", "3 TiB"), ("—", "—")
    ]
    names = spark.createDataFrame([("custom_kernel_a_b__x__y",), ("custom_kernel_a",), ("plain",)], "k string")
    assert [r[0] for r in names.select(kernel_family(F.col("k"))).collect()] == ["a_b", "custom_kernel_a", "plain"]


def test_sort_is_stable_in_both_directions(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 2.0), (3, float("nan"))], "i int, v double")
    assert [r["i"] for r in sort_rows(df, "v", True, "i").collect()] == [3, 1, 0, 2]
    assert [r["i"] for r in sort_rows(df, "v", False, "i").collect()] == [0, 2, 1, 3]


@pytest.mark.parametrize("name", ["launch_partition", "wait_launches", "host_exposure", "trace_summary"])
def test_many_blocks_give_the_same_answer(spark, name):
    folder = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, QUERIES[name](spark, folder).collect()), key=repr)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = sorted(map(tuple, QUERIES[name](spark, folder).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut == plain
