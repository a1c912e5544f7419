"""Documents and streams, and some registered queries against their SQL."""

from __future__ import annotations

import glob
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dispatchlake.operators import documents
from dispatchlake.operators.launches import LAUNCH
from dispatchlake.plans.queries import QUERIES
from dispatchlake.streaming.live import STATE, check_batch, monitor_summaries, stream_census, stream_lines
from tests.captures import capture, folder, text
from tests.oracle_check import compare, database
from tests.test_analysis import analysed


def test_documents_in_pieces_and_whole(spark):
    a = analysed(spark, t=capture(4))
    asked = a.launches.select(*LAUNCH, F.lit("r").alias("range_id"), F.lit(40.0).alias("start_ns"), F.lit(75.0).alias("end_ns"))
    pieces = documents.document_pieces(a, asked, "now")
    parts = documents.evidence_documents(pieces, pieces_per_part=3).orderBy("part").collect()
    assert [p["part"] for p in parts] == list(range(len(parts))) and len(parts) > 2
    made = {"file_name": parts[0]["file_name"], "text": "\n".join(p["text"] for p in parts)}
    assert made["file_name"] == "t-launch-1-visible-timeline.json"
    payload = json.loads(made["text"])
    assert [c["command_buffer_index"] for c in payload["command_buffers"]] == [1.0, 2.0]
    assert payload["command_buffers"][1]["visible_host_encode_ns"] == {"start": 70.0, "end": 75.0}
    assert payload["command_buffers"][1]["visible_gpu_ns"] == {"start": 75.0, "end": 75.0}
    assert payload["dispatch_summary"]["kernel_families"] == [
        {"kernel": "k1", "count": 1}, {"kernel": "k2", "count": 1}
    ]
    assert payload["waits"] == [] and payload["generated_at"] == "now"
    assert payload["limitations"][0] == "measurements[*].scope=selected-launch"
    prompt = documents.evidence_documents(documents.document_pieces(a, asked, "now", format="md")).first()["text"]
    assert json.loads(prompt.split("```json\n", 1)[1].rsplit("```", 1)[0]) == payload
    out = folder({}) + "/documents"
    documents.write_documents(pieces, out)
    parts = sorted(glob.glob(f"{out}/trace_id=t/launch_index=0/range_id=r/part-*"))
    assert json.loads("".join(open(p).read() for p in parts)) == payload


def test_streams(spark):
    def checkpoint(seq, n, final):
        return {"record": "summary", "summary_seq": seq, "final": final, "complete": final, "dropped_rows": 0, "ops_total": n,
                "cbs_total": n, "buckets": {"x": {"count": n, "total_ns": n}}}

    root = folder({"a.jsonl": text([*capture(3)[:4], checkpoint(0, 5, False), checkpoint(1, 4, True)])})
    census = stream_census(spark, root).writeStream.outputMode("complete").format("memory").queryName("census").start()
    out = folder({}) + "/watch"
    alerts = monitor_summaries(stream_lines(spark, root), out).start()
    try:
        census.processAllAvailable()
        alerts.processAllAvailable()
        assert {r["kernel"]: r["count"] for r in spark.table("census").collect()} == {"k0": 1, "k1": 1}
        assert {r["code"] for r in spark.read.parquet(f"{out}/alerts").collect()} == {"summary-count-decreased", "summary-bucket-decreased"}
    finally:
        census.stop()
        alerts.stop()


@pytest.mark.parametrize("cuts", [[9], [1, 9], [2, 3, 9], [1, 2, 3, 4, 5, 6, 7, 8, 9]])
def test_alerts_do_not_depend_on_batches(spark, cuts):
    def summary(seq, total, final=False, **more):
        return json.dumps({"record": "summary", "summary_seq": seq, "final": final, "complete": True, "dropped_rows": 0, "ops_total": total, "cbs_total": total, "buckets": {}, **more})

    values = [summary(5, 50), summary(3, 30), summary(7, 70), '{"record":"op"}', summary(8, 80, True), '{"record":"op"}', "{}", summary(9, 90, note=1), summary("x", 95, note=1)]
    state, found, first = spark.createDataFrame([], STATE), set(), 0
    for batch, stop in enumerate(cuts):
        rows = spark.createDataFrame([("t", "f", i, values[i]) for i in range(first, stop)], "trace_id string, relative_path string, place long, value string")
        alerts, state = check_batch(rows, state, batch)
        found |= {(r["line_no"], r["code"]) for r in alerts.collect() if r["code"] != "rows-after-final"}
        assert {r["seen"] for r in state.collect()} == {stop}
        late = {r["line_no"] for r in alerts.filter("code = 'rows-after-final'").collect()}
        assert late == {min(x) for x in [{n for n in (6, 7) if first < n <= stop}] if x}
        first = stop
    assert found >= {(2, "summary-sequence"), (2, "summary-count-decreased"), (8, "summary-schema"), (8, "summary-fixed-fields"), (8, "summary-after-final"), (9, "bad-integer:summary_seq")}
    assert {n for n, _ in found} == {2, 8, 9}


def test_entry_and_registry(spark):
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", ["trace_summary", "launch_partition", "dispatch_placement", "interval_difference", "evidence_grades", "run_names"])
def test_query_against_sql(spark, name):
    folder_ = "/root/testdata/sf0.001"
    assert compare(spark, database(folder_), folder_, name) is None
