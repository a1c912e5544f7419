"""Capture folders, lenient records, evidence, catalogue and run names."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from dispatchlake.functions import names
from dispatchlake.operators.evidence import badges, grade, select_summary
from dispatchlake.operators.normalize import normalize
from dispatchlake.plans.analysis import Analysis
from dispatchlake.sources import catalog, store
from dispatchlake.sources.lines import parse_diagnostics, parse_lenient, scan_lines
from tests.captures import capture, folder, lines, text

LEGACY = [
    {"cb_index": 0, "encode_start_ns": 0, "encode_end_ns": 100, "gpu_start_ns": 150, "gpu_end_ns": 400, "op_count": 2, "first_op_seq": 0, "last_op_seq": 1},
    {"cb_index": 1, "encode_start_ns": 110, "encode_end_ns": 210, "gpu_start_ns": 410, "gpu_end_ns": 700, "op_count": 3, "first_op_seq": 2, "last_op_seq": 4},
    *[{"seq": s, "cb_index": int(s > 1), "kind": "compute", "kernel_name": f"k{s}"} for s in range(5)],
    {"kind": "wait", "cause": "active_tasks_cap", "cb_index": 0, "ns": 20},
    {"kind": "wait", "cause": "pool_exhausted", "ts_ns": 405, "ns": 5},
    {"kind": "wait", "cause": "mystery", "ns": 10},
    {"note": "something else"},
    "",
    "{not valid json",
]


def test_legacy_capture_end_to_end(spark):
    root = folder({"a b+c/x.JSONL": text(LEGACY), ".hidden.jsonl": text(LEGACY), "y.txt": "no"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = scan_lines(spark, root)
        numbered = [(r["line_no"], r["value"]) for r in read.orderBy("line_no").collect()]
        assert [n for n, _ in numbered] == list(range(1, 14))
        assert [v for _, v in numbered] == text(LEGACY).splitlines()
        assert {r[0] for r in read.select("relative_path").distinct().collect()} == {"a b+c/x.JSONL"}
        diagnostics = parse_diagnostics(read)
        d = diagnostics.collect()[0]
        assert (d["parsed_rows"], d["malformed_rows"], d["blank_rows"], d["total_lines"]) == (11, 1, 1, 13)
        records = normalize(parse_lenient(read)[0])
        graded = badges(grade(records, diagnostics)).collect()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (graded["command_buffers"], graded["operations"], graded["waits"], graded["unrecognized"]) == (2, 5, 3, 1)
    assert graded["source_completeness"] == "missing-summary" and not graded["valid_evidence"]
    path = folder({}) + "/records"
    store.write_records(records, path)
    stored = store.read_records(spark, path)
    a = Analysis(stored.ops, stored.cbs, stored.waits)
    s = a.trace_summary.collect()[0]
    assert (s["wall_span_ns"], s["gpu_busy_ns"], s["gpu_work_ns"], s["gpu_span_ns"]) == (700, 540, 540, 550)
    assert (s["hidden_host_ns"], s["exposed_host_ns"], s["other_wait_ns"]) == (60, 140, 35)
    assert a.launch_summary.collect()[0]["other_wait_ns"] == 25
    assert [r["at_ns"] for r in a.dispatches.orderBy("seq").collect()] == [0, 100, 110, 160, 210]
    anchors = {r["line_no"]: (r["at_ns"], r["at_ns_source"]) for r in a.launch_waits.collect()}
    assert anchors == {8: (100.0, "command-buffer-encode-end"), 9: (405.0, None), 10: (None, None)}


def test_what_counts_as_json(spark):
    good = ['{"a":1}', '  {"a":1}\r', "[1]", "3", '"x"', '{"a":1,"a":2}', "null"]
    bad = ['{"a":1} x', '{"a":1}}', '{"a":1}]', "1,2", '1,"b":2', '{"a":1}],[', '{"a":1}},{', "{'a':1}", "NaN", "{a:1}", "01"]
    rows, wrong = parse_lenient(lines(spark, {"t": good + bad + [" \t"]}))
    assert sorted(r["line_no"] for r in rows.collect()) == list(range(1, len(good) + 1))
    assert wrong.count() == len(bad)


def test_types_are_not_coerced_and_first_present_alias_counts(spark):
    rows = [
        {"record": "op", "seq": "5", "command_buffer_index": True, "kernel_name": "", "kernel": "k"},
        {"record": "op", "seq": -1, "command_buffer_index": None, "cb_index": 4, "buffer_binds": 1.5},
        {"record": None, "kind": "op"}, {"type": " Dispatch "}, {"kind": "stall"}, {"final": True}, {"seq": 1}, [1], "3",
    ]
    records = normalize(parse_lenient(lines(spark, {"t": [r if isinstance(r, dict) else json.dumps(r) for r in rows]}))[0])
    kinds = [r["record_type"] for r in records.all.orderBy("line_no").collect()]
    assert kinds == ["op", "op", "unknown", "op", "wait", "summary", "op", "rejected", "rejected"]
    ops = records.ops.orderBy("line_no").collect()
    assert (ops[0]["seq"], ops[0]["command_buffer_index"], ops[0]["kernel"]) == (None, None, None)
    assert (ops[1]["seq"], ops[1]["command_buffer_index"], ops[1]["buffer_binds"]) == (None, None, 1.5)


def test_summary_choice(spark):
    def s(seq=None, final=None):
        return {"record": "summary", **({} if seq is None else {"summary_seq": seq}), **({} if final is None else {"final": final})}

    picks = {"final": [s(1, True), s(2, True), s(9)], "highest": [s(3), s(5), s(5), s(1)], "last": [s(), s()]}
    chosen = select_summary(normalize(parse_lenient(lines(spark, picks))[0]).summaries)
    assert {r["trace_id"]: r["line_no"] for r in chosen.collect()} == {"final": 2, "highest": 3, "last": 2}


def test_good_capture_is_valid_evidence(spark):
    records = normalize(parse_lenient(lines(spark, {"t": capture(3)}))[0])
    graded = badges(grade(records)).collect()[0]
    assert graded["valid_evidence"] and graded["badges"] == ["Complete evidence"] and graded["state"] == "Capture complete"


def test_catalogue(spark):
    manifest = {
        "schema_version": 1, "root_label": " Shown ",
        "traces": {
            "c.ndjson": {"model": "M", "mode": "AR", "size": 3, "huggingface_repo": "o/r", "related_huggingface_repos": ["zz/Q"], "valid_evidence": False},
            "bad": 3, "../x.jsonl": {},
        },
    }
    root = folder({"sub/a.JSONL": "{}\n", "c.ndjson": "{}\n", "empty.jsonl": "", "traces.json": json.dumps(manifest)})
    files = catalog.discover(spark, root)
    assert [(r["relative_path"], r["size"], r["extension"]) for r in files.collect()] == [
        ("c.ndjson", 3, ".ndjson"), ("empty.jsonl", 0, ".jsonl"), ("sub/a.JSONL", 3, ".jsonl")
    ]
    header, entries, warnings = catalog.read_manifest(spark, root)
    assert header.collect()[0]["root_label"] == "Shown"
    assert [r["warning"] for r in warnings.collect()] == ["metadata-shape"]
    listed = catalog.build_catalog(files, entries)
    described = {r["name"]: r for r in catalog.describe(listed).collect()}
    assert described["c.ndjson"]["label"] == "M · AR" and described["c.ndjson"]["size"] == 3
    assert described["c.ndjson"]["model_url"] == "https://huggingface.co/o/r"
    assert described["a.JSONL"]["label"] == "a.JSONL"
    assert [r["name"] for r in catalog.search(listed, " m ZZ/q ").collect()] == ["c.ndjson"]
    problems = {r["relative_path"]: r["problem"] for r in catalog.reconcile(entries, files).collect()}
    assert problems == {"../x.jsonl": "unsafe-path", "empty.jsonl": "not-in-manifest", "sub/a.JSONL": "not-in-manifest"}
    assert catalog.id_collisions(files).count() == 0
    assert catalog.fingerprint(scan_lines(spark, root)).select("source_sha256").distinct().count() == 1
    hashed = {r["trace_id"]: r["source_sha256"] for r in catalog.fingerprint(scan_lines(spark, root), files).collect()}
    assert hashed[files.filter("name = 'empty.jsonl'").first()["trace_id"]] == hashlib.sha256().hexdigest() and len(hashed) == 3
    broken = folder({"traces.json": '{"schema_version": 2, "traces": {}}'})
    assert [r["warning"] for r in catalog.read_manifest(spark, broken)[2].collect()] == ["manifest-schema"]


def test_scan_keeps_every_line_when_splits_change(spark):
    """The number of splits depends on the cores at planning time; a scan must not."""
    root = folder({"a.jsonl": "".join(f"line {i}\n" for i in range(60_000)), "b.jsonl": "x\r\n\ny"})
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "8")
        read = scan_lines(spark, root)
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        got = read.select("relative_path", "line_no", "value").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    a = {r["line_no"]: r["value"] for r in got if r["relative_path"] == "a.jsonl"}
    assert a == {i + 1: f"line {i}" for i in range(60_000)}
    assert {r["line_no"]: r["value"] for r in got if r["relative_path"] == "b.jsonl"} == {1: "x\r", 2: "", 3: "y"}


def test_fingerprints_are_those_of_the_bytes(spark):
    """With and without a last line end, a byte order mark, bytes that are no UTF-8, in many splits."""
    kinds = {"a": b"x\ny\n", "b": b"x\ny", "c": b"\xef\xbb\xbfx\n", "d": b"\xef\xbb\xbfx", "e": b"\n", "f": b"\xff\xfe\r\n\n\x80", "g": b"0123456789\n" * 5000}
    root = folder({})
    for name, data in kinds.items():
        with open(f"{root}/{name}.jsonl", "wb") as out:
            out.write(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines = scan_lines(spark, root)
        found = catalog.fingerprint(lines).join(lines.select("trace_id", "relative_path").distinct(), "trace_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["relative_path"][0]: r["source_sha256"] for r in found} == {k: hashlib.sha256(v).hexdigest() for k, v in kinds.items()}


def test_run_names(spark):
    good = "own--re.po__me-1__2024-02-29t10-20-30z.window-cb64.jsonl"
    wrong = [
        good.replace("2024", "2023"), good.replace("own", "Own"), good.replace("cb64", "cb0"), good.replace("__me-1", "__me--1"),
        good.replace("30z", "60z"), "a/" + good, good.replace("own", "o" * 190), "",
    ]
    df = spark.createDataFrame([(good,), *[(w,) for w in wrong], (names.EXEMPT_NAMES[0],)], "n string")
    found = df.select(names.run_name(F.col("n")).alias("r"), names.name_errors(F.col("n")).alias("e")).collect()
    assert found[0]["r"]["repository_slug"] == "own/re.po" and found[0]["r"]["capture_utc"] == "2024-02-29T10:20:30Z"
    assert found[0]["e"] == [] and found[-1]["e"] == []
    assert all(r["r"] is None and r["e"] for r in found[1:-1])
