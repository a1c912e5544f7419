"""What the plans of some steps must not do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dispatchlake.operators import census, placement
from dispatchlake.plans.queries import analysis
from dispatchlake.sources.store import write_bucketed
from tests.captures import folder

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_tables_stored_by_owner_join_without_a_shuffle(spark):
    a = analysis(spark, SF)
    out = folder({})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    (ops, unowned), (cbs, _) = (write_bucketed(placement.whole_owner(t), f"{out}/{n}", placement.OWNER, 5) for n, t in (("ops", a.ops), ("cbs", a._launches.cbs)))
    assert unowned.isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (placement.place(ops, cbs), placement.counted_kernels(ops, cbs)):
            assert "Exchange" not in plan(made)
        assert "Exchange" in plan(placement.place(a.ops, cbs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    names = ["line_no", "at_ns", "placement_detail", "launch_index"]
    assert sorted(map(str, placement.place(ops, cbs).select(names).collect())) == sorted(map(str, placement.place(a.ops, a._launches.cbs).select(names).collect()))


def test_rows_without_an_owner_are_stored_beside_the_others(spark):
    rows = spark.createDataFrame([("t", None, 1), ("t", 2.0, 2), (None, 3.0, 3)], "trace_id string, command_buffer_index double, n int")
    with pytest.raises(ValueError):
        write_bucketed(rows, folder({}) + "/x", placement.OWNER, 3)
    keyed, other = write_bucketed(placement.whole_owner(rows), folder({}) + "/x", placement.OWNER, 3)
    assert ([r.n for r in keyed.collect()], sorted(r.n for r in other.collect())) == ([2], [1, 3])


def test_both_scopes_take_one_shuffle(spark):
    rows = [("t", 0, "a", 2), ("t", 1, "a", 3), ("t", None, "custom_kernel_x", 4), ("u", None, "b", 1), ("u", 0, None, 9)]
    counted = spark.createDataFrame(rows, "trace_id string, launch_index int, kernel string, count long").withColumns({c: F.lit(1.0) for c in census.KERNEL_SUMS})
    found = census.kernel_census_scopes(counted)
    assert plan(found).count("Exchange hashpartitioning") == 1
    got = {(r.scope, r.trace_id, r.launch_index, r["count"], tuple(r.raw_kernels)) for r in found.collect()}
    assert got == {("trace", "t", None, 5, ("a",)), ("trace", "t", None, 4, ("custom_kernel_x",)), ("trace", "u", None, 1, ("b",)), ("launch", "t", 0, 2, ("a",)), ("launch", "t", 1, 3, ("a",))}


def test_operations_are_placed_in_one_read_and_without_an_owner_beside_the_join(spark):
    out = folder({})
    rows = [("t", 1.0, 1, 1.0), ("t", 1.0, 2, 3.0), ("t", 1.0, 3, None), ("t", 2.0, 4, 7.0), ("t", 9.0, 5, 1.0), ("t", None, 6, 1.0), (None, None, 7, 2.0), (None, 1.0, 8, 1.0)]
    spark.createDataFrame(rows, "trace_id string, command_buffer_index double, line_no bigint, seq double").write.parquet(f"{out}/ops")
    cbs = spark.createDataFrame(
        [("t", 1.0, 0, 10.0, 30.0, None, None), ("t", 2.0, 0, 10.0, 30.0, 5.0, 9.0)],
        "trace_id string, command_buffer_index double, launch_index bigint, encode_start_ns double, encode_end_ns double, first_op_seq double, last_op_seq double",
    )
    made = placement.place(spark.read.parquet(f"{out}/ops"), cbs)
    lost = "missing-parent-command-buffer"
    got = {r.line_no: (r.at_ns, r.placement_detail, r.launch_index) for r in made.collect()}
    assert got == {
        1: (10.0, "interpolated-sequence", 0), 2: (30.0, "interpolated-sequence", 0), 3: (None, "missing-sequence", 0), 4: (20.0, "interpolated-sequence", 0),
        5: (None, lost, None), 6: (None, lost, None), 7: (None, lost, None), 8: (None, lost, None),
    }
    # One scan of the owned ones and one of the others; no aggregate beside them.
    assert "Aggregate" not in plan(made)


def test_ranges_are_checked_without_writing_dispatches(spark):
    a, b = analysis(spark, SF), analysis(spark, SF)
    got = a.availability
    assert "dispatches" not in a.__dict__
    # Written once: what asks for it reads the rows and computes nothing again.
    assert "Join" not in plan(got)
    assert b.dispatches.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, b.availability.collect()))
