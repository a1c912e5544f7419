"""The summary monitor in the state store: the same alerts wherever batches are cut, and after restarts."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from dispatchlake.streaming.live import STATE, check_batch, stream_lines
from dispatchlake.streaming.monitor import start_monitor
from tests.captures import folder


def summary(seq, total, final=False, **more):
    return json.dumps({"record": "summary", "summary_seq": seq, "final": final, "complete": True, "dropped_rows": 0, "ops_total": total, "cbs_total": total, "buckets": {}, **more})


BUCKET = {"x": {"count": 2, "total_ns": 9}}
VALUES = [
    summary(5, 50), summary(3, 30, buckets=BUCKET), "", summary(7, 70, buckets={"x": {"count": 1, "total_ns": 9}}), '{"record":"op"}', "not json", summary(8, 80, True),
    '{"record":"op"}', "{}", "oops", summary(9, 90, note=1), summary("x", 95, True, note=1), "[1]",
]


def growing(spark, root, values, out, cuts, **options):
    """Lands the lines file by file; the monitor is started anew for each."""
    first = 0
    for number, stop in enumerate(cuts):
        with open(f"{root}/part-{number}.jsonl", "w") as file:
            file.write("".join(v + "\n" for v in values[first:stop]))
        first = stop
        stream = stream_lines(spark, root).withColumn("trace_id", F.lit("t"))
        start_monitor(stream, out, **options).awaitTermination()
    return sorted((r.line_no, r.code) for r in spark.read.parquet(f"{out}/alerts").collect())


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("cuts", [[13], [2, 9, 13]])
def test_alerts_do_not_depend_on_batches(spark, cuts):
    rows = spark.createDataFrame([("t", "f", i, v) for i, v in enumerate(VALUES)], "trace_id string, relative_path string, place long, value string")
    want = sorted((r.line_no, r.code) for r in check_batch(rows, spark.createDataFrame([], STATE), 0)[0].collect())
    found = growing(spark, folder({}), VALUES, folder({}) + "/watch", cuts)
    late = lambda alerts: {a for a in alerts if a[1] == "rows-after-final"}
    assert [a for a in found if a[1] != "rows-after-final"] == [a for a in want if a[1] != "rows-after-final"]
    # Late rows are told once a batch, by the first of them.
    assert late(found) >= late(want) == {(8, "rows-after-final")}
    assert len(found) > 8


def test_quiet_captures_are_let_go_with_an_alert(spark):
    root, out = folder({}), folder({}) + "/watch"
    with open(f"{root}/part.jsonl", "w") as file:
        file.write(summary(1, 10) + "\n" + summary(2, 20) + "\n")
    query = start_monitor(stream_lines(spark, root).withColumn("trace_id", F.lit("t")), out, quiet_ms=1, processingTime="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            found = [tuple(r) for r in spark.read.schema("trace_id string, line_no bigint, code string").parquet(f"{out}/alerts").collect()] if os.path.exists(f"{out}/alerts") else []
            if found:
                break
        assert found == [("t", 2, "state-released")]
    finally:
        query.stop()
