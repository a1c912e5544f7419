"""Typing of parsed lines: members are taken out of a record once, not by a walk for every name."""

from pyspark.sql import functions as F

from dispatchlake.functions.json_values import field, member, members, whole_document
from dispatchlake.operators.audit import _typed
from dispatchlake.operators.normalize import normalize
from dispatchlake.sources.lines import parse_lenient
from dispatchlake.sources.strict import parse_strict

TEXTS = [
    '{"record":"op","seq":1,"cb_index":2}', '{"a":[1,[2]],"b":"]"}', '{"a":null}', "{}", "[]", "[1,2]", "1", '"]"', "null",
    "1] x", "[1] x", '{"a":1}]', "1,2", "1,", "", "{", '{"a":1} x', '1},{"v":2', "1],[2", '{"a":1,"a":2}',
]


def _lines(spark):
    rows = [("t", i, text) for i, text in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "trace_id string, line_no bigint, value string")


def test_one_value_and_nothing_behind_it(spark):
    found = parse_lenient(_lines(spark))[0].select("line_no", F.to_json("raw").alias("j")).collect()
    assert {TEXTS[r.line_no] for r in found} == set(TEXTS[:9]) | {'{"a":1,"a":2}'}
    assert {r.line_no: r.j for r in found}[1] == '{"a":[1,[2]],"b":"]"}'


def test_members_are_those_that_a_walk_finds(spark):
    raw = whole_document(F.col("value"))
    pairs = [(F.to_json(field(raw, n)), F.to_json(member(members(raw), n))) for n in ("a", "b", "record", "seq", "none")]
    checked = _lines(spark).select("value", *[a.eqNullSafe(b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    assert all(all(row[1:]) for row in checked.collect())
    void = _lines(spark).filter("line_no = 2").select(member(members(raw), "a").isNotNull()).first()
    assert void[0]


def test_a_record_is_not_walked_for_every_name(spark):
    rows = parse_lenient(_lines(spark))[0]
    for typed in (normalize(rows).all, _typed(parse_strict(_lines(spark)))):
        plan = typed._jdf.queryExecution().optimizedPlan().toString()
        assert "$.cb_index" not in plan and "$.record" not in plan
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
