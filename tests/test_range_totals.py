"""Totals of ranges against plain sums over every row and range."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from dispatchlake.operators import ranges
from dispatchlake.operators.launches import LAUNCH

CBS = "trace_id string, launch_index bigint, line_no bigint, command_buffer_index double, op_count double, encode_start_ns double, encode_end_ns double, gpu_start_ns double, gpu_end_ns double, covered_at_start double, covered_at_end double"
DISPATCHES = "trace_id string, launch_index bigint, at_ns double, kernel string, set_bytes_calls double, set_bytes_total_bytes double, buffer_binds double"
WAITS = "trace_id string, launch_index bigint, at_ns double, bucket string, wait_class string, detail_class string, headline_category string, wait_ns double"
ASKED = "trace_id string, launch_index bigint, range_id string, start_ns double, end_ns double"


def covered(intervals, t):
    """Length of the union before t."""
    total, reach = 0.0, float("-inf")
    for a, b in sorted(intervals):
        a, b = max(a, reach), min(b, t)
        if b > a:
            total, reach = total + b - a, b
    return total


def plain(cbs, dispatches, waits, asked):
    out = {}
    for trace, launch, name, low, high in asked:
        mine = [c for c in cbs if c[:2] == (trace, launch)]
        gpu_of_trace = [(c[7], c[8]) for c in cbs if c[0] == trace and c[7] is not None and c[8] > c[7]]
        gpu_of_launch = [(c[7], c[8]) for c in mine if c[7] is not None and c[8] > c[7]]
        total = encode = hidden = work = 0
        firsts, lasts = [], []
        for _, _, _, _, ops, es, ee, gs, ge, _, _ in mine:
            inside = False
            if es is not None and ee > es and min(ee, high) > max(es, low):
                a, b = max(es, low), min(ee, high)
                encode, hidden, inside = encode + b - a, hidden + covered(gpu_of_trace, b) - covered(gpu_of_trace, a), True
            if gs is not None and ge > gs and min(ge, high) > max(gs, low):
                a, b = max(gs, low), min(ge, high)
                work, inside = work + b - a, True
                firsts.append(a)
                lasts.append(b)
            instants = [x for x, y in ((es, ee), (gs, ge)) if x is not None and x == y]
            total += inside or (ops == 0 and any(low <= x <= high for x in instants))
        points = [d for d in dispatches if d[:2] == (trace, launch) and d[2] is not None and low <= d[2] <= high]
        waited = [w for w in waits if w[:2] == (trace, launch) and w[2] is not None and low <= w[2] <= high]
        kernels = {}
        for d in points:
            if d[3] is not None:
                n, size = kernels.get(d[3], (0, 0))
                kernels[d[3]] = n + 1, size + (d[5] or 0)
        buckets = {}
        for w in waited:
            if w[3] is not None:
                n, ns = buckets.get(w[3], (0, 0))
                buckets[w[3]] = n + 1, ns + w[7]
        cap = sum(w[7] for w in waited if w[6] == "cap")
        busy = covered(gpu_of_launch, high) - covered(gpu_of_launch, low)
        span = max(lasts) - min(firsts) if firsts else 0
        out[trace, launch, name] = (total, encode - hidden, hidden, busy, work, span, len(points), cap, kernels, buckets)
    return out


def tables(spark, cbs, dispatches, waits, asked):
    pairs = ((cbs, CBS), (dispatches, DISPATCHES), (waits, WAITS), (asked, ASKED))
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in pairs]
    known = frames[3].select(*LAUNCH).distinct()
    omitted = known.select(*LAUNCH, *[F.lit(n).cast("bigint").alias(c) for n, c in enumerate(("unplaced_dispatches", "unattributable_dispatches", "unanchored_waits", "unattributable_waits"))])
    return (*frames, omitted)


def found_by(spark, *rows):
    result = ranges.analyze_ranges(*tables(spark, *rows))
    out = {}
    for r in result.summary.collect():
        assert (r.unplaced_dispatches, r.unanchored_waits, r.headline_wait_ns) == (1, 5, r.cap_wait_ns)
        out[r.trace_id, r.launch_index, r.range_id] = [r.cbs_total, r.exposed_host_ns, r.hidden_host_ns, r.gpu_busy_ns, r.gpu_work_ns, r.gpu_span_ns, r.ops_total, r.cap_wait_ns, {}, {}]
    for r in result.kernels.collect():
        out[r.trace_id, r.launch_index, r.range_id][8][r.kernel] = r["count"], r.set_bytes_total_bytes
    for r in result.wait_taxonomy.collect():
        out[r.trace_id, r.launch_index, r.range_id][9][r.bucket] = r["count"], r.wait_ns
    return {k: tuple(v) for k, v in out.items()}


def some_rows(rng, wide, first=0):
    """Rows of the traces t<first> and t<first + 1>."""
    def interval():
        if rng.random() < 0.2:
            return None, None
        a = float(rng.randint(0, wide))
        return a, a + rng.choice([0, 0, 1, 2, 5, wide // 3])

    cbs = []
    for i in range(60):
        trace, launch = f"t{first + i % 2}", rng.choice([0, 1, None])
        cbs.append((trace, launch, i, float(i), rng.choice([0.0, 0.0, 3.0, None]), *interval(), *interval()))
    gpu = {t: [(c[7], c[8]) for c in cbs if c[0] == t and c[7] is not None and c[8] > c[7]] for t in (f"t{first}", f"t{first + 1}")}
    cbs = [(*c, *(covered(gpu[c[0]], x) if c[5] is not None else None for x in c[5:7])) for c in cbs]
    place = lambda: (f"t{first + rng.randint(0, 1)}", rng.choice([0, 1, None]), rng.choice([None, *map(float, range(wide))]))
    dispatches = [(*place(), rng.choice(["a", "b", None]), 1.0, rng.choice([None, 4.0]), 0.0) for _ in range(80)]
    waits = [(*place(), *rng.choice([("x", "c", "d", "cap"), ("y", "c", "d", None), (None, None, None, None)]), float(rng.randint(0, 9))) for _ in range(40)]
    asked = [(f"t{first + i % 2}", i % 3, f"r{i}", float(a := rng.randint(-3, wide)), float(a + rng.choice([1, 2, 5, wide]))) for i in range(40)]
    return cbs, dispatches, waits, asked


def test_totals(spark):
    """Crowded and sparse rows, and command buffers with a gap that has whole ranges."""
    crowded, sparse = some_rows(random.Random(1), 12), some_rows(random.Random(2), 60, 2)
    cbs = [("gap", 0, i, float(i), 3.0, float(i), float(i + 2), float(90 - i), float(95 + i), 0.0, 0.0) for i in range(30)]
    cbs.append(("gap", 0, 99, 99.0, 0.0, 10.0, 10.0, 80.0, 80.0, None, None))
    asked = [("gap", 0, f"r{a}-{b}", float(a), float(b)) for a in (0, 10, 11, 32, 40, 79) for b in (12, 32, 50, 80, 81, 91) if b > a]
    rows = crowded[0] + sparse[0] + cbs, crowded[1] + sparse[1], crowded[2] + sparse[2], crowded[3] + sparse[3] + asked
    assert found_by(spark, *rows) == plain(*rows)


def test_rows_equal_the_totals(spark):
    cbs, dispatches, waits, asked = some_rows(random.Random(3), 30)
    frames = tables(spark, cbs, dispatches, waits, asked)
    inside = ranges.command_buffers_in_ranges(frames[0], frames[3]).groupBy(*ranges.RANGE).agg(F.count("*").alias("n"), F.sum(F.col("clip_gpu_end") - F.col("clip_gpu_start")).alias("work"))
    got = {tuple(r)[:3]: (r.n, r.work or 0) for r in inside.collect()}
    assert got == {k: (v[0], v[4]) for k, v in plain(cbs, dispatches, waits, asked).items() if v[0]}


def test_nested_ranges_do_not_meet_rows_one_by_one(spark):
    """Ten thousand ranges inside each other over two thousand rows: pairs would be ten million."""
    n, rows = 10_000, 2_000
    cbs = [("t0", 0, i, float(i), 3.0, 10.0 * i, 10.0 * i + 8, 10.0 * i + 4, 10.0 * i + 12, 0.0, 0.0) for i in range(rows)]
    asked = [("t0", 0, f"r{i}", float(i), 20.0 * rows - i) for i in range(n)]
    start = time.time()
    result = ranges.analyze_ranges(*tables(spark, cbs, [("t0", 0, 10.0 * i + 5, "k", 1.0, 1.0, 1.0) for i in range(rows)], [], asked))
    found = {int(r.range_id[1:]): (r.ops_total, r.cbs_total, r.gpu_work_ns) for r in result.summary.collect()}
    assert time.time() - start < 120
    for i in range(0, n, 97):
        low, high = i, 20 * rows - i
        ops = sum(low <= 10 * k + 5 <= high for k in range(rows))
        present = sum(10 * k + 12 > low and 10 * k < high for k in range(rows))
        work = sum(max(0, min(10 * k + 12, high) - max(10 * k + 4, low)) for k in range(rows))
        assert found[i] == (ops, present, work)


def test_a_kind_of_row_is_swept_without_the_others(spark):
    fail = F.raise_error(F.lit("read"))
    waits = [("t", 0, at, "b", "c", "d", "cap", 1.0) for at in (1.0, 5.0, 9.0)]
    dispatches = [("t", 0, at, "k", 1.0, 2.0, 3.0) for at in (4.0, 5.0)]
    cbs, ops, waited, asked, omitted = tables(spark, [], dispatches, waits, [("t", 0, "r", 4.0, 6.0)])
    unread = [df.withColumn("at_ns", fail.cast("double")) for df in (ops, waited)]
    assert [(r.bucket, r["count"]) for r in ranges.analyze_ranges(cbs, unread[0], waited, asked, omitted).wait_taxonomy.collect()] == [("b", 1)]
    assert [(r.kernel, r["count"]) for r in ranges.analyze_ranges(cbs, ops, unread[1], asked, omitted).kernels.collect()] == [("k", 2)]
