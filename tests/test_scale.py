"""Steps that must not bring the rows of a table into one task, or do a job several times over."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import functions as F

from dispatchlake.operators import documents, evidence
from dispatchlake.operators.census import UNCLASSIFIED, wait_rows
from dispatchlake.operators.normalize import normalize
from dispatchlake.sources import tables
from dispatchlake.sources.lines import parse_lenient


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wait_rows_add_up_numbers_alone(spark):
    rows = [("t", 3, "a", "x", 1.0), ("t", 2, "a", None, 2.0), ("t", 5, "a", "y", 4.0), ("t", None, "a", "z", 8.0), ("t", 1, None, None, 16.0), ("u", None, "b", "x", 1.0)]
    found = wait_rows(spark.createDataFrame(rows, "trace_id string, line_no bigint, bucket string, wait_class string, wait_ns double"), ["trace_id"])
    first = plan(found).rsplit("Exchange", 1)[-1]
    assert "SortAggregate" not in first and "HashAggregate" in first
    assert sorted(tuple(r)[:5] for r in found.collect()) == [("t", UNCLASSIFIED, 1, 16.0, "other"), ("t", "a", 4, 15.0, "other"), ("u", "b", 1, 1.0, "other")]


def test_events_without_owner_stay_out_of_the_join(spark):
    folder = tempfile.mkdtemp()
    spark.createDataFrame([(k, k, "1995-01-01") for k in range(20)], "o_orderkey bigint, o_custkey bigint, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, k % 3) for k in range(20)], "c_custkey bigint, c_nationkey bigint").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(e, "click", 1.0, e) for e in range(70)], "event_id bigint, event_type string, value double, user_id bigint").write.parquet(f"{folder}/events.parquet")
    found = tables.waits(spark, folder)
    assert re.search(r"isnull\(", plan(found)) and "Union" in plan(found)
    rows = {r.line_no: r for r in found.collect()}
    assert len(rows) == 70
    for e, r in rows.items():
        owner = e % 20 if e % 7 == 0 else None
        assert r.command_buffer_index == owner and r.has_legacy_index == (owner is not None)
        assert r.trace_id == str(owner % 3 if owner is not None else e % 25)
        assert (r.at_ns is None) == (e % 7 == 0 or e % 11 == 0)


def test_grading_reads_stored_records(spark):
    lines = [{"record": "cb", "command_buffer_index": 1, "encode_start_ns": 1}, {"record": "cb", "command_buffer_index": 1}, {"record": "op", "seq": 1}, {"x": 1},
             {"record": "summary", "schema_version": 1, "complete": True, "dropped_rows": 0, "ops_total": 1, "cbs_total": 0}]
    rows = spark.createDataFrame([("t", i + 1, json.dumps(v)) for i, v in enumerate(lines)], "trace_id string, line_no bigint, value string")
    records = normalize(parse_lenient(rows)[0])
    stored = evidence.stored_for_grading(records)
    assert stored.all.dtypes and sorted(stored.all.dtypes) == sorted(records.all.dtypes)
    graded = evidence.grade(stored)
    assert "parse_json" not in plan(graded)
    assert graded.collect() == evidence.grade(records).collect()


def test_outlines_are_read_part_by_part(spark):
    cbs = [json.dumps({"command_buffer_index": i}) for i in range(7)]
    text = ['{"evidence_health":{"n":7},"measurements":[1],"command_buffers":[', *[("," if i else "") + c for i, c in enumerate(cbs)],
            '],"dispatch_summary":{"placed_in_viewport":2,"kernel_families":[', '{"kernel":"b","count":2}', ',{"kernel":"a","count":1}', ']},"waits":[',
            '{"duration_ns":1,"ownership":{"command_buffer_index":3}}', '],"limitations":[]}']
    assert json.loads("\n".join(text))["command_buffers"][6] == {"command_buffer_index": 6}
    bare = [text[0], text[8], text[11], text[13]]
    kind = "trace_id string, launch_index bigint, range_id string, file_name string, part bigint, text string"
    torn = [*text[:2], text[1], *text[2:]]
    for size in (1, 3, 100):
        rows = [("t", n, "r", "f", p, "\n".join(doc[p * size : (p + 1) * size])) for n, doc in enumerate((text, bare, torn)) for p in range(-(-len(doc) // size))]
        found = {r.launch_index: r for r in documents.document_outlines(spark.createDataFrame(rows, kind)).collect()}
        assert (found[0].command_buffers, json.loads(found[0].first_kernel)["kernel"], json.loads(found[0].head)["evidence_health"]) == (7, "b", {"n": 7})
        assert (found[1].command_buffers, found[1].first_kernel) == (0, None)
        assert (found[2].head, found[2].command_buffers, found[2].first_kernel) == (None, None, None)


def test_one_type_alone_is_read_as_among_all(spark):
    lines = [{"record": "wait", "bucket": "cap_wait", "wait_ns": 3, "cb_index": 1}, {"cause": "b", "ns": -1}, {"type": "op", "seq": 2, "kernel": "k"}, {"encode_start_ns": 1, "cb_index": 4}, [1]]
    rows = parse_lenient(spark.createDataFrame([("t", i, json.dumps(v)) for i, v in enumerate(lines)], "trace_id string, line_no bigint, value string"))[0]
    for kind in ("wait", "op", "cb"):
        alone, among = normalize(rows, [kind]), normalize(rows)
        assert len(alone.all.columns) < len(among.all.columns)
        assert sorted(map(str, alone.of(kind).drop("raw", "grid", "threadgroup").collect())) == sorted(map(str, among.of(kind).drop("raw", "grid", "threadgroup").collect()))


def test_wait_stream_has_few_state_partitions(spark):
    from dispatchlake.session import setting

    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with setting(spark, name, 3):
        assert spark.conf.get(name) == "3"
    assert spark.conf.get(name) == before
