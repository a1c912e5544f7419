"""The registered queries again, as SQL over the same tables.

Written with range joins, correlated conditions and SQL aggregates rather than
sweeps, so that it checks the operators by another method.
"""

from __future__ import annotations

# Named pieces in dependency order; ``sql`` puts in front of a query those it needs.
PIECES: dict[str, str] = {
    "tr": """
        SELECT o_orderkey AS k, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d,
               CAST(c_nationkey AS VARCHAR) AS trace_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "cb0": """
        SELECT trace_id, k, (d // 60) * 60000000000 + (d % 60) * 10000000 + ((k * 7919) % 1000) * 10000 AS es
        FROM tr""",
    "cb": """
        SELECT trace_id, k, es, es + (1 + k % 5) * 2000000 AS ee, es + (k % 3) * 1000000 AS gs,
               es + (k % 3) * 1000000 + (1 + (k * 31) % 7) * 1500000 AS ge
        FROM cb0""",
    "op": """
        SELECT tr.trace_id, l_orderkey AS k, l_linenumber AS seq, l_orderkey * 8 + l_linenumber AS line_no,
               CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'custom_kernel_' || p_type || '__' || p_brand
                    ELSE p_type || '_' || p_brand END AS kernel,
               CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type ELSE p_type || '_' || p_brand END AS family,
               l_linenumber AS calls, CAST(4 * l_quantity AS BIGINT) AS bytes, l_suppkey % 5 AS binds
        FROM lineitem JOIN tr ON l_orderkey = tr.k JOIN part ON l_partkey = p_partkey""",
    "wt": """
        SELECT CASE WHEN event_id % 7 = 0 THEN tr.trace_id ELSE CAST(user_id % 25 AS VARCHAR) END AS trace_id,
               event_id AS line_no,
               CASE event_type WHEN 'click' THEN 'cap_wait' WHEN 'view' THEN 'memory_wait'
                    WHEN 'signup' THEN 'dependency_cv_wait' WHEN 'purchase' THEN 'cb_wait_until_completed'
                    WHEN 'error' THEN 'sched_backpressure' END AS bucket,
               CASE event_type WHEN 'click' THEN 'cap' WHEN 'view' THEN 'dependency' WHEN 'signup' THEN 'dependency'
                    WHEN 'purchase' THEN 'decision' ELSE 'other' END AS wait_class,
               CAST(round(1000 * value) AS BIGINT) AS wait_ns,
               CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0
                    THEN (event_id % 41) * 60000000000 + ((event_id * 104729) % 620) * 1000000 END AS raw_at,
               CASE WHEN event_id % 7 = 0 THEN event_id % (SELECT max(o_orderkey) + 1 FROM orders) END AS owner
        FROM events LEFT JOIN tr ON event_id % 7 = 0 AND event_id % (SELECT max(o_orderkey) + 1 FROM orders) = tr.k""",
    "isl_start": """
        SELECT DISTINCT trace_id, gs AS t FROM cb a WHERE NOT EXISTS
          (SELECT 1 FROM cb b WHERE b.trace_id = a.trace_id AND b.gs < a.gs AND b.ge >= a.gs)""",
    "isl_end": """
        SELECT DISTINCT trace_id, ge AS t FROM cb a WHERE NOT EXISTS
          (SELECT 1 FROM cb b WHERE b.trace_id = a.trace_id AND b.gs <= a.ge AND b.ge > a.ge)""",
    "isl": """
        SELECT s.trace_id, s.t AS s, min(e.t) AS e FROM isl_start s JOIN isl_end e
          ON e.trace_id = s.trace_id AND e.t > s.t GROUP BY s.trace_id, s.t""",
    "enc_start": """
        SELECT DISTINCT trace_id, es AS t FROM cb a WHERE NOT EXISTS
          (SELECT 1 FROM cb b WHERE b.trace_id = a.trace_id AND b.es < a.es AND b.ee >= a.es)""",
    "enc_end": """
        SELECT DISTINCT trace_id, ee AS t FROM cb a WHERE NOT EXISTS
          (SELECT 1 FROM cb b WHERE b.trace_id = a.trace_id AND b.es <= a.ee AND b.ee > a.ee)""",
    "enc": """
        SELECT s.trace_id, s.t AS s, min(e.t) AS e FROM enc_start s JOIN enc_end e
          ON e.trace_id = s.trace_id AND e.t > s.t GROUP BY s.trace_id, s.t""",
    "hidden_piece": """
        SELECT cb.trace_id, k, greatest(es, s) AS a, least(ee, e) AS b
        FROM cb JOIN isl ON cb.trace_id = isl.trace_id AND s < ee AND e > es""",
    "hid": """
        SELECT cb.trace_id, cb.k, coalesce(sum(b - a), 0) AS hidden, ee - es - coalesce(sum(b - a), 0) AS exposed
        FROM cb LEFT JOIN hidden_piece p ON p.k = cb.k GROUP BY cb.trace_id, cb.k, es, ee""",
    "gap": """
        SELECT a.trace_id, a.k, a.es, a.es - max(greatest(b.ee, b.ge)) AS gap
        FROM cb a LEFT JOIN cb b ON b.trace_id = a.trace_id AND (b.es < a.es OR (b.es = a.es AND b.k < a.k))
        GROUP BY a.trace_id, a.k, a.es""",
    "thr": """
        SELECT trace_id, greatest(100000000, 20 * coalesce(median(gap) FILTER (gap > 0), 0)) AS threshold
        FROM gap GROUP BY trace_id""",
    "cut": "SELECT gap.* FROM gap JOIN thr ON gap.trace_id = thr.trace_id WHERE gap > threshold",
    "lcb": """
        SELECT cb.*, (SELECT count(*) FROM cut WHERE cut.trace_id = cb.trace_id
                      AND (cut.es < cb.es OR (cut.es = cb.es AND cut.k <= cb.k))) AS launch
        FROM cb""",
    "part_l": """
        SELECT trace_id, launch, min(es) AS s, max(greatest(ee, ge)) AS e, count(*) AS n
        FROM lcb GROUP BY trace_id, launch""",
    "aw": """
        SELECT wt.trace_id, wt.line_no, bucket, wait_class, wait_ns, owner, coalesce(raw_at, cb.ee) AS at_ns,
               CASE WHEN cb.k IS NOT NULL THEN 'command-buffer-encode-end' END AS source,
               CASE WHEN cb.k IS NOT NULL THEN 'legacy-command-buffer-fallback' END AS placement
        FROM wt LEFT JOIN cb ON wt.raw_at IS NULL AND wt.owner = cb.k AND wt.trace_id = cb.trace_id""",
    "near": """
        SELECT aw.trace_id, aw.line_no,
               arg_min(launch, struct_pack(d := greatest(s - at_ns, at_ns - e, 0), s := s)) AS launch
        FROM aw JOIN part_l p ON p.trace_id = aw.trace_id WHERE at_ns IS NOT NULL GROUP BY aw.trace_id, aw.line_no""",
    "wl": """
        SELECT aw.*, CASE WHEN placement IS NOT NULL THEN lcb.launch ELSE near.launch END AS launch
        FROM aw LEFT JOIN near ON near.trace_id = aw.trace_id AND near.line_no = aw.line_no
        LEFT JOIN lcb ON lcb.trace_id = aw.trace_id AND lcb.k = aw.owner""",
    "ob": "SELECT k, min(seq) AS lo, max(seq) AS hi FROM op GROUP BY k",
    "pl": """
        SELECT op.*, launch,
               CASE WHEN hi = lo THEN es + (ee - es) / 2
                    ELSE es + CAST(seq - lo AS DOUBLE) / (hi - lo) * (ee - es) END AS at_ns,
               CASE WHEN hi = lo THEN 'degenerate-sequence-span' ELSE 'interpolated-sequence' END AS detail
        FROM op JOIN lcb ON lcb.k = op.k JOIN ob ON ob.k = op.k""",
    "lisl_start": """
        SELECT DISTINCT trace_id, launch, gs AS t FROM lcb a WHERE NOT EXISTS
          (SELECT 1 FROM lcb b WHERE b.trace_id = a.trace_id AND b.launch = a.launch AND b.gs < a.gs AND b.ge >= a.gs)""",
    "lisl_end": """
        SELECT DISTINCT trace_id, launch, ge AS t FROM lcb a WHERE NOT EXISTS
          (SELECT 1 FROM lcb b WHERE b.trace_id = a.trace_id AND b.launch = a.launch AND b.gs <= a.ge AND b.ge > a.ge)""",
    "lisl": """
        SELECT s.trace_id, s.launch, s.t AS s, min(e.t) AS e FROM lisl_start s JOIN lisl_end e
          ON e.trace_id = s.trace_id AND e.launch = s.launch AND e.t > s.t GROUP BY s.trace_id, s.launch, s.t""",
    "bounds": """
        SELECT p.trace_id, p.launch, least(p.s, min(at_ns)) AS s, greatest(p.e, max(at_ns)) AS e
        FROM part_l p LEFT JOIN wl ON wl.trace_id = p.trace_id AND wl.launch = p.launch
        GROUP BY p.trace_id, p.launch, p.s, p.e""",
    "req": """
        SELECT trace_id, launch, 'all' AS range_id, CAST(s AS BIGINT) AS a, CAST(e AS BIGINT) AS b FROM bounds
        UNION ALL SELECT trace_id, launch, 'middle', CAST(s + floor((e - s) / 4) AS BIGINT), CAST(s + floor((e - s) / 2) AS BIGINT) FROM bounds
        UNION ALL SELECT trace_id, launch, 'over-start', CAST(s - 1000000 AS BIGINT), CAST(s + floor((e - s) / 3) AS BIGINT) FROM bounds
        UNION ALL SELECT trace_id, launch, 'outside', CAST(e + 1 AS BIGINT), CAST(e + 2 AS BIGINT) FROM bounds""",
    "rng": """
        SELECT r.trace_id, r.launch, range_id, greatest(a, s) AS a, least(b, e) AS b
        FROM req r JOIN bounds USING (trace_id, launch) WHERE least(b, e) > greatest(a, s)""",
    "fin": """
        SELECT *, greatest(ee, ge) AS fin,
               row_number() OVER (PARTITION BY trace_id ORDER BY greatest(ee, ge), least(es, gs), k) - 1 AS r,
               count(*) OVER (PARTITION BY trace_id) AS total FROM cb""",
    "anchor": """
        SELECT *, (SELECT count(*) FROM fin WHERE fin.trace_id = aw.trace_id AND fin.fin <= aw.at_ns) AS stop
        FROM aw WHERE bucket = 'cb_wait_until_completed' AND at_ns IS NOT NULL""",
    "able": """
        SELECT a.* FROM anchor a LEFT JOIN fin f ON f.trace_id = a.trace_id AND f.k = a.owner
        WHERE stop > 0 AND (owner IS NULL OR f.r BETWEEN stop - 64 AND stop - 1)""",
    "pick": """
        SELECT trace_id, coalesce(max(struct_pack(t := at_ns, l := line_no, s := stop)) FILTER (stop >= 64),
                                  max(struct_pack(t := at_ns, l := line_no, s := stop))) AS p,
               CASE WHEN count(*) FILTER (stop >= 64) > 0 THEN 'anchor' ELSE 'anchor-partial' END AS mode
        FROM able GROUP BY trace_id""",
    "cut_cb": """
        SELECT fin.*, p.p.t AS anchor, coalesce(mode, 'final-command-buffers') AS mode FROM fin LEFT JOIN pick p ON p.trace_id = fin.trace_id
        WHERE r < coalesce(p.p.s, total) AND r >= coalesce(p.p.s, total) - 64""",
    "cut_window": """
        SELECT trace_id, mode, min(least(es, gs)) AS lo, coalesce(max(anchor), max(fin)) AS hi, count(*) AS n FROM cut_cb GROUP BY trace_id, mode""",
    "cut_wait": """
        SELECT aw.*, wt.raw_at FROM aw JOIN wt ON wt.line_no = aw.line_no AND wt.trace_id = aw.trace_id
        JOIN cut_window w ON w.trace_id = aw.trace_id
        LEFT JOIN cut_cb c ON c.trace_id = aw.trace_id AND c.k = aw.owner
        WHERE aw.at_ns BETWEEN lo AND hi AND (aw.owner IS NULL OR c.k IS NOT NULL)""",
}
HEAVY = ("cb", "op", "wt", "isl", "enc", "hidden_piece", "hid", "gap", "cut", "lcb", "part_l", "aw", "wl", "pl", "lisl", "bounds", "rng", "fin", "able", "cut_cb", "cut_window", "cut_wait", "focus")

WAIT_SUMS = """
    coalesce(sum(wait_ns) FILTER (bucket = 'cap_wait'), 0) AS cap_wait_ns,
    coalesce(sum(wait_ns) FILTER (bucket IN ('memory_wait', 'dependency_cv_wait')), 0) AS dependency_wait_ns,
    coalesce(sum(wait_ns) FILTER (bucket = 'cb_wait_until_completed'), 0) AS decision_wait_ns,
    CAST(0 AS BIGINT) AS other_wait_ns,
    coalesce(sum(wait_ns) FILTER (bucket <> 'sched_backpressure'), 0) AS headline_wait_ns"""
WAIT_NAMES = ("cap_wait_ns", "dependency_wait_ns", "decision_wait_ns", "other_wait_ns", "headline_wait_ns")


def sql(query: str) -> str:
    """``query`` with the pieces it refers to, directly or through others."""
    import re

    def used(text: str) -> set[str]:
        return {n for n in PIECES if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)}

    needed, todo = set(), used(query)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= used(PIECES[name]) - needed
    parts = [
        f"{n} AS {'MATERIALIZED ' if n in HEAVY else ''}({' '.join(PIECES[n].split())})" for n in PIECES if n in needed
    ]
    return (f"WITH {', '.join(parts)} " if parts else "") + " ".join(query.split())


def integers(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


SUMMARY_NAMES = (
    "start_ns", "end_ns", "wall_span_ns", "exposed_host_ns", "hidden_host_ns", "gpu_busy_ns", "gpu_work_ns",
    "gpu_span_ns", *WAIT_NAMES, "ops_total", "cbs_total",
)
TRACE_SUMMARY = f"""
    SELECT c.trace_id, {integers(*SUMMARY_NAMES)} FROM (
      SELECT trace_id, least(cs, ws) AS start_ns, greatest(ce, we) AS end_ns,
             greatest(ce, we) - least(cs, ws) AS wall_span_ns, *
      FROM (SELECT trace_id, min(least(es, gs)) AS cs, max(greatest(ee, ge)) AS ce, sum(ge - gs) AS gpu_work_ns,
                   max(ge) - min(gs) AS gpu_span_ns, count(*) AS cbs_total FROM cb GROUP BY trace_id)
      JOIN (SELECT trace_id, sum(hidden) AS hidden_host_ns, sum(exposed) AS exposed_host_ns FROM hid GROUP BY trace_id) USING (trace_id)
      JOIN (SELECT trace_id, sum(e - s) AS gpu_busy_ns FROM isl GROUP BY trace_id) USING (trace_id)
      JOIN (SELECT trace_id, min(at_ns) AS ws, max(at_ns) AS we, {WAIT_SUMS} FROM aw GROUP BY trace_id) USING (trace_id)
      JOIN (SELECT trace_id, count(*) AS ops_total FROM op GROUP BY trace_id) USING (trace_id)
    ) c"""


def human(column: str) -> str:
    """Readable duration of a whole number of nanoseconds."""
    def number(divisor: int) -> str:
        value = f"(floor(CAST({column} AS DOUBLE) / {divisor} * 100 + 0.5) / 100)"
        return f"regexp_replace(printf('%.2f', {value}), '\\.?0+$', '')"

    return (
        f"CASE WHEN {column} < 1000 THEN CAST({column} AS VARCHAR) || ' ns' "
        f"WHEN {column} < 1000000 THEN {number(1000)} || ' µs' "
        f"WHEN {column} < 1000000000 THEN {number(1000000)} || ' ms' ELSE {number(1000000000)} || ' s' END"
    )


METRIC_LINES = [
    ("Wall span", "wall_span_ns", "measured endpoints"),
    ("Exposed host", "exposed_host_ns", "interval-derived"),
    ("Hidden host", "hidden_host_ns", "interval-derived"),
    ("GPU busy", "gpu_busy_ns", "interval-derived union"),
    ("GPU work", "gpu_work_ns", "measured intervals"),
    ("Decision drain", "decision_wait_ns", "measured waits"),
    ("Cap wait", "cap_wait_ns", "measured waits"),
    ("Dependency wait", "dependency_wait_ns", "measured waits"),
    ("Command buffers", "cbs_total", "record count"),
    ("Dispatches", "ops_total", "record count"),
]
KERNEL_SUMS = (
    "count(*) AS count, CAST(sum(calls) AS BIGINT) AS set_bytes_calls, "
    "CAST(sum(bytes) AS BIGINT) AS set_bytes_total_bytes, CAST(sum(binds) AS BIGINT) AS buffer_binds"
)
TAXONOMY = (
    "bucket, wait_class, CASE WHEN bucket = 'sched_backpressure' THEN 'scheduler-mirror' ELSE wait_class END AS detail_class, "
    "count(*) AS count, CAST(sum(wait_ns) AS BIGINT) AS wait_ns, bucket <> 'sched_backpressure' AS headline_included"
)
EDGE = "(CASE WHEN {i} = 32 THEN e ELSE s + (e - s) * (CAST({i} AS DOUBLE) / 32) END)"
BIN_OF = "CAST(least(31, greatest(0, floor(CAST(at_ns - s AS DOUBLE) / (e - s) * 32))) AS INTEGER)"
DENSE_OF = "CAST(least(39, greatest(0, floor((at_ns - a) / (b - a) * 40))) AS INTEGER)"

ORACLES: dict[str, str] = {
    "trace_summary": TRACE_SUMMARY,
    "launch_summary": f"""
        SELECT trace_id, launch AS launch_index,
               {", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in SUMMARY_NAMES)} FROM (
          SELECT *, s AS start_ns, e AS end_ns, e - s AS wall_span_ns FROM bounds
          JOIN (SELECT trace_id, launch, sum(ge - gs) AS gpu_work_ns, max(ge) - min(gs) AS gpu_span_ns, count(*) AS cbs_total
                FROM lcb GROUP BY ALL) USING (trace_id, launch)
          JOIN (SELECT hid.trace_id, launch, sum(hidden) AS hidden_host_ns, sum(exposed) AS exposed_host_ns
                FROM hid JOIN lcb ON lcb.k = hid.k GROUP BY ALL) USING (trace_id, launch)
          JOIN (SELECT trace_id, launch, sum(e - s) AS gpu_busy_ns FROM lisl GROUP BY ALL) USING (trace_id, launch)
          LEFT JOIN (SELECT trace_id, launch, {WAIT_SUMS} FROM wl GROUP BY ALL) USING (trace_id, launch)
          LEFT JOIN (SELECT trace_id, launch, count(*) AS ops_total FROM pl GROUP BY ALL) USING (trace_id, launch)
        )""",
    "interval_union": "SELECT trace_id, s AS start_ns, e AS end_ns FROM isl",
    "interval_intersection": """
        SELECT isl.trace_id, greatest(isl.s, enc.s) AS start_ns, least(isl.e, enc.e) AS end_ns
        FROM isl JOIN enc ON enc.trace_id = isl.trace_id AND enc.s < isl.e AND enc.e > isl.s""",
    "interval_difference": """
        SELECT trace_id, t0 AS start_ns, t1 AS end_ns FROM (
          SELECT trace_id, s, t AS t0, lead(t) OVER (PARTITION BY trace_id, s ORDER BY t) AS t1 FROM (
            SELECT trace_id, s, s AS t FROM enc UNION SELECT trace_id, s, e FROM enc
            UNION SELECT enc.trace_id, enc.s, isl.s FROM enc JOIN isl ON isl.trace_id = enc.trace_id AND isl.s > enc.s AND isl.s < enc.e
            UNION SELECT enc.trace_id, enc.s, isl.e FROM enc JOIN isl ON isl.trace_id = enc.trace_id AND isl.e > enc.s AND isl.e < enc.e))
        c WHERE t1 IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM isl WHERE isl.trace_id = c.trace_id AND isl.s < c.t1 AND isl.e > c.t0)""",
    "host_exposure": f"""
        SELECT trace_id, k AS command_buffer_index, CAST(hidden AS BIGINT) AS hidden_host_ns,
               CAST(exposed AS BIGINT) AS exposed_host_ns FROM hid""",
    "host_exposure_pieces": """
        SELECT trace_id, k AS command_buffer_index, 'hidden' AS kind, a AS start_ns, b AS end_ns FROM hidden_piece
        UNION ALL
        SELECT trace_id, k, 'exposed', t0, t1 FROM (
          SELECT trace_id, k, t AS t0, lead(t) OVER (PARTITION BY k ORDER BY t) AS t1 FROM (
            SELECT trace_id, k, es AS t FROM cb UNION SELECT trace_id, k, ee FROM cb
            UNION SELECT trace_id, k, a FROM hidden_piece UNION SELECT trace_id, k, b FROM hidden_piece))
        c WHERE t1 IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM hidden_piece p WHERE p.k = c.k AND p.a < c.t1 AND p.b > c.t0)""",
    "launch_partition": """
        SELECT p.trace_id, launch AS launch_index, s AS start_ns, e AS end_ns,
               CAST(gap AS BIGINT) AS gap_before_ns, CAST(threshold AS BIGINT) AS gap_threshold_ns, n AS command_buffers
        FROM part_l p JOIN thr ON thr.trace_id = p.trace_id LEFT JOIN cut ON cut.trace_id = p.trace_id AND cut.es = p.s""",
    "command_buffer_launches": "SELECT trace_id, k AS command_buffer_index, launch AS launch_index FROM lcb",
    "duplicate_quarantine": """
        SELECT CASE WHEN count(*) OVER (PARTITION BY i) > 1 THEN 'quarantined' ELSE 'accepted' END AS state,
               i AS command_buffer_index, k AS line_no
        FROM (SELECT k, CASE WHEN k % 50 = 7 THEN k - 1 ELSE k END AS i FROM cb)""",
    "operation_bounds": """
        SELECT trace_id, cb.k AS command_buffer_index, CAST(lo AS BIGINT) AS first_seq, CAST(hi AS BIGINT) AS last_seq
        FROM cb LEFT JOIN ob ON ob.k = cb.k""",
    "dispatch_placement": """
        SELECT trace_id, k AS command_buffer_index, launch AS launch_index, CAST(seq AS BIGINT) AS seq,
               detail AS placement_detail, round(at_ns, 3) AS position_ns, count(*) AS dispatches
        FROM pl GROUP BY ALL""",
    "wait_anchors": "SELECT trace_id, line_no, at_ns, source AS at_ns_source, placement FROM aw",
    "wait_launches": "SELECT trace_id, line_no, launch AS launch_index FROM wl",
    "kernel_census_by_trace": f"""
        SELECT trace_id, family AS kernel, {KERNEL_SUMS},
               array_to_string(list_sort(list_distinct(list(kernel))), ',') AS raw_kernels FROM op GROUP BY trace_id, family""",
    "kernel_census_by_launch": f"""
        SELECT trace_id, launch AS launch_index, family AS kernel, {KERNEL_SUMS},
               array_to_string(list_sort(list_distinct(list(kernel))), ',') AS raw_kernels FROM pl GROUP BY trace_id, launch, family""",
    "kernel_rows": f"""
        SELECT trace_id, CASE WHEN kernel LIKE 'LARGE%' THEN '(unnamed)' ELSE kernel END AS kernel, {KERNEL_SUMS}
        FROM op GROUP BY trace_id, CASE WHEN kernel LIKE 'LARGE%' THEN '(unnamed)' ELSE kernel END""",
    "kernel_ranking": """
        SELECT family AS kernel, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS set_bytes_total_bytes
        FROM op GROUP BY family""",
    "wait_taxonomy_by_trace": f"SELECT trace_id, {TAXONOMY} FROM wt GROUP BY trace_id, bucket, wait_class",
    "wait_taxonomy_by_launch": f"""
        SELECT trace_id, launch AS launch_index, {TAXONOMY} FROM wl WHERE launch IS NOT NULL
        GROUP BY trace_id, launch, bucket, wait_class""",
    "wait_report": """
        SELECT trace_id, b AS bucket, count(*) AS count, CAST(sum(wait_ns) AS BIGINT) AS wait_ns,
               coalesce(max(c), 'other') AS wait_class, b <> 'sched_backpressure' AS additive
        FROM (SELECT trace_id, wait_ns, CASE WHEN line_no % 13 <> 0 THEN bucket ELSE '(unclassified)' END AS b,
                     CASE WHEN line_no % 13 <> 0 THEN wait_class END AS c FROM wt) GROUP BY trace_id, b""",
    "headline_waits": f"SELECT trace_id, {integers(*WAIT_NAMES)} FROM (SELECT trace_id, {WAIT_SUMS} FROM wt GROUP BY trace_id)",
    "wait_bucket_totals": """
        SELECT trace_id, bucket, count(*) AS count, CAST(sum(wait_ns) AS BIGINT) AS total_ns FROM wt GROUP BY trace_id, bucket""",
    "metric_lines": " UNION ALL ".join(
        f"SELECT trace_id, {i} AS position, '{label}' AS label, "
        + (human(column) if column.endswith("_ns") else f"CAST({column} AS VARCHAR)")
        + f" AS value, '{evidence}' AS evidence FROM ({TRACE_SUMMARY})"
        for i, (label, column, evidence) in enumerate(METRIC_LINES)
    ),
    "launch_overview": f"""
        SELECT g.trace_id, g.launch AS launch_index, CAST(g.bin AS BIGINT) AS bin, round(x, 3) AS start_ns, round(y, 3) AS end_ns,
               round(coalesce(h.v, 0), 3) AS host_encode_ns, round(coalesce(u.v, 0), 3) AS gpu_busy_ns,
               coalesce(p.n, 0) AS dispatch_count, coalesce(w.n, 0) AS wait_count, coalesce(w.c, '') AS wait_classes
        FROM (SELECT trace_id, launch, CAST(i AS INTEGER) AS bin, CAST({EDGE.format(i='i')} AS DOUBLE) AS x,
                     CAST({EDGE.format(i='(i + 1)')} AS DOUBLE) AS y
              FROM bounds, range(32) r(i) WHERE e > s) g
        LEFT JOIN (SELECT trace_id, launch, bin, sum(least(y, ee) - greatest(x, es)) AS v
                   FROM (SELECT trace_id, launch, CAST(i AS INTEGER) AS bin, {EDGE.format(i='i')} AS x, {EDGE.format(i='(i + 1)')} AS y
                         FROM bounds, range(32) r(i)) JOIN lcb USING (trace_id, launch)
                   WHERE least(y, ee) > greatest(x, es) GROUP BY ALL) h USING (trace_id, launch, bin)
        LEFT JOIN (SELECT trace_id, launch, bin, sum(least(y, ie) - greatest(x, is_)) AS v
                   FROM (SELECT trace_id, launch, CAST(i AS INTEGER) AS bin, {EDGE.format(i='i')} AS x, {EDGE.format(i='(i + 1)')} AS y
                         FROM bounds, range(32) r(i)) JOIN (SELECT trace_id, launch, s AS is_, e AS ie FROM lisl) USING (trace_id, launch)
                   WHERE least(y, ie) > greatest(x, is_) GROUP BY ALL) u USING (trace_id, launch, bin)
        LEFT JOIN (SELECT trace_id, launch, {BIN_OF} AS bin, count(*) AS n FROM pl JOIN bounds USING (trace_id, launch) GROUP BY ALL) p
          USING (trace_id, launch, bin)
        LEFT JOIN (SELECT trace_id, launch, {BIN_OF} AS bin, count(*) AS n,
                          array_to_string(list_sort(list_distinct(list(wait_class))), ',') AS c
                   FROM wl JOIN bounds USING (trace_id, launch) WHERE at_ns IS NOT NULL GROUP BY ALL) w USING (trace_id, launch, bin)""",
    "dispatch_density": f"""
        SELECT trace_id, launch AS launch_index, range_id, CAST(bin AS BIGINT) AS bin,
               round(a + CAST(bin AS DOUBLE) / 40 * (b - a), 3) AS bin_start_ns,
               round(a + CAST(bin + 1 AS DOUBLE) / 40 * (b - a), 3) AS bin_end_ns,
               CAST(sum(n) AS BIGINT) AS count, arg_min(kernel, struct_pack(x := -n, y := kernel)) AS dominant_kernel,
               array_to_string(list(kernel || '=' || n ORDER BY kernel), ',') AS kernel_counts,
               CASE WHEN max(lo) = min(lo) AND max(hi) = min(lo) THEN min(lo) END AS command_buffer_index
        FROM (SELECT trace_id, launch, range_id, a, b, {DENSE_OF} AS bin, kernel, count(*) AS n, min(k) AS lo, max(k) AS hi
              FROM pl JOIN rng USING (trace_id, launch) WHERE at_ns BETWEEN a AND b GROUP BY ALL)
        GROUP BY trace_id, launch, range_id, a, b, bin""",
    "dispatch_density_owners": f"""
        SELECT DISTINCT trace_id, launch AS launch_index, range_id, CAST({DENSE_OF} AS BIGINT) AS bin, k AS command_buffer_index
        FROM pl JOIN rng USING (trace_id, launch) WHERE at_ns BETWEEN a AND b""",
    "dispatch_density_mode": """
        SELECT r.trace_id, r.launch AS launch_index, range_id, count(k) AS dispatch_count,
               CASE WHEN count(k) < 2 THEN false
                    ELSE (max(at_ns) - min(at_ns)) / (b - a) * 800 / (count(k) - 1) < 3 END AS density_mode
        FROM rng r LEFT JOIN pl ON pl.trace_id = r.trace_id AND pl.launch = r.launch AND at_ns BETWEEN a AND b
        GROUP BY r.trace_id, r.launch, range_id, a, b""",
    "launch_omissions": """
        SELECT trace_id, launch AS launch_index, CAST(0 AS BIGINT) AS unplaced_dispatches, CAST(0 AS BIGINT) AS unanchored_waits,
               CAST(0 AS BIGINT) AS unattributable_dispatches,
               (SELECT count(*) FROM wl WHERE wl.trace_id = p.trace_id AND wl.launch IS NULL) AS unattributable_waits
        FROM part_l p""",
    "launch_availability": """
        SELECT trace_id, launch AS launch_index, reason IS NULL AS available, reason FROM (
          SELECT trace_id, launch,
                 CASE WHEN bool_or(CASE WHEN k % 97 = 0 THEN true
                                        WHEN k % 89 = 0 THEN EXISTS (SELECT 1 FROM op WHERE op.k = lcb.k AND op.k % 2 = 0)
                                        ELSE false END)
                      THEN 'missing-command-buffer-timing' END AS reason
          FROM lcb GROUP BY trace_id, launch)""",
    "time_marks": """
        SELECT trace_id, 'dispatch' AS kind, kernel AS label, 0 AS kind_rank, count(*) AS marks,
               round(min(at_ns), 3) AS first_ns, round(max(at_ns), 3) AS last_ns FROM pl GROUP BY trace_id, kernel
        UNION ALL
        SELECT trace_id, 'wait', bucket, 1, count(*), round(CAST(min(at_ns) AS DOUBLE), 3), round(CAST(max(at_ns) AS DOUBLE), 3)
        FROM aw WHERE at_ns IS NOT NULL GROUP BY trace_id, bucket""",
    "even_samples": """
        SELECT trace_id, k AS line_no, least(n, 100) AS displayed, n AS total FROM (
          SELECT trace_id, k, row_number() OVER (PARTITION BY trace_id ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY trace_id) AS n FROM cb)
        WHERE n <= 100 OR r IN (SELECT (i * (n - 1)) // 99 FROM range(100) g(i))""",
    "sorted_report": """
        SELECT trace_id, bucket, count(*) AS count, CAST(sum(wait_ns) AS BIGINT) AS total_ns FROM wt GROUP BY trace_id, bucket""",
    "range_requests": """
        SELECT trace_id, launch AS launch_index, range_id,
               CASE WHEN least(b, e) > greatest(a, s) THEN greatest(a, s) ELSE a END AS start_ns,
               CASE WHEN least(b, e) > greatest(a, s) THEN least(b, e) ELSE b END AS end_ns,
               CASE WHEN NOT least(b, e) > greatest(a, s) THEN 'empty-selection' END AS error
        FROM req JOIN bounds USING (trace_id, launch)""",
    "range_selections": """
        SELECT trace_id, launch AS launch_index, 'inside' AS range_id, 'analyze' AS mode,
               CAST(s + floor((e - s) / 4) AS BIGINT) AS start_ns, CAST(s + floor((e - s) / 2) AS BIGINT) AS end_ns FROM bounds
        UNION ALL SELECT trace_id, launch, 'past-end', 'view',
               CAST(e - (floor((e - s) * 5 / 4) - floor((e - s) / 2)) AS BIGINT), e FROM bounds
        UNION ALL SELECT trace_id, launch, 'malformed', 'view', s, e FROM bounds
        UNION ALL SELECT trace_id, launch, 'reversed', 'view', s, e FROM bounds""",
    "range_summaries": f"""
        SELECT trace_id, launch AS launch_index, range_id, a AS start_ns, b AS end_ns, b - a AS wall_span_ns,
               CAST(coalesce(enc_ns, 0) - coalesce(hidden_host_ns, 0) AS BIGINT) AS exposed_host_ns,
               {integers("gpu_busy_ns")}, {", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in ("hidden_host_ns", "gpu_work_ns", "gpu_span_ns", *WAIT_NAMES, "ops_total", "cbs_total"))},
               CAST(0 AS BIGINT) AS unplaced_dispatches,
               (SELECT count(*) FROM wl WHERE wl.trace_id = q.trace_id AND wl.launch IS NULL) AS unanchored_waits
        FROM (SELECT * REPLACE (coalesce(gpu_busy_ns, 0) AS gpu_busy_ns) FROM rng
          LEFT JOIN (SELECT trace_id, launch, range_id, count(*) AS cbs_total, sum(greatest(0, least(ee, b) - greatest(es, a))) AS enc_ns,
                            sum(greatest(0, least(ge, b) - greatest(gs, a))) AS gpu_work_ns,
                            max(CASE WHEN least(ge, b) > greatest(gs, a) THEN least(ge, b) END)
                              - min(CASE WHEN least(ge, b) > greatest(gs, a) THEN greatest(gs, a) END) AS gpu_span_ns
                     FROM lcb JOIN rng USING (trace_id, launch)
                     WHERE least(ee, b) > greatest(es, a) OR least(ge, b) > greatest(gs, a) GROUP BY ALL) USING (trace_id, launch, range_id)
          LEFT JOIN (SELECT l.trace_id, l.launch, range_id, sum(least(p.b, r.b) - greatest(p.a, r.a)) AS hidden_host_ns
                     FROM lcb l JOIN hidden_piece p ON p.k = l.k JOIN rng r ON r.trace_id = l.trace_id AND r.launch = l.launch
                     WHERE least(p.b, r.b) > greatest(p.a, r.a) GROUP BY ALL) USING (trace_id, launch, range_id)
          LEFT JOIN (SELECT r.trace_id, r.launch, range_id, sum(least(e, b) - greatest(s, a)) AS gpu_busy_ns
                     FROM lisl i JOIN rng r ON r.trace_id = i.trace_id AND r.launch = i.launch
                     WHERE least(e, b) > greatest(s, a) GROUP BY ALL) USING (trace_id, launch, range_id)
          LEFT JOIN (SELECT trace_id, launch, range_id, count(*) AS ops_total FROM pl JOIN rng USING (trace_id, launch)
                     WHERE at_ns BETWEEN a AND b GROUP BY ALL) USING (trace_id, launch, range_id)
          LEFT JOIN (SELECT trace_id, launch, range_id, {WAIT_SUMS} FROM wl JOIN rng USING (trace_id, launch)
                     WHERE at_ns BETWEEN a AND b GROUP BY ALL) USING (trace_id, launch, range_id)) q""",
    "range_kernels": f"""
        SELECT trace_id, launch AS launch_index, range_id, family AS kernel, {KERNEL_SUMS},
               array_to_string(list_sort(list_distinct(list(kernel))), ',') AS raw_kernels
        FROM pl JOIN rng USING (trace_id, launch) WHERE at_ns BETWEEN a AND b GROUP BY trace_id, launch, range_id, family""",
    "range_waits": f"""
        SELECT trace_id, launch AS launch_index, range_id, {TAXONOMY}
        FROM wl JOIN rng USING (trace_id, launch) WHERE at_ns BETWEEN a AND b
        GROUP BY trace_id, launch, range_id, bucket, wait_class""",
    "focus_windows": """
        SELECT trace_id, launch AS launch_index,
               CAST(CASE WHEN narrow THEN greatest(s, a0 - pad) ELSE s END AS BIGINT) AS focus_start_ns,
               CAST(CASE WHEN narrow THEN least(e, b0 + pad) ELSE e END AS BIGINT) AS focus_end_ns,
               NOT narrow AS whole_launch
        FROM (SELECT *, coalesce(CAST(b0 - a0 AS DOUBLE) / (e - s) < 0.9 AND b0 > a0, false) AS narrow, floor((b0 - a0) * 0.03 + 0.5) AS pad
          FROM (SELECT bounds.trace_id, bounds.launch, bounds.s, bounds.e, least(cs, min(at_ns)) AS a0, greatest(ce, max(at_ns)) AS b0
            FROM bounds LEFT JOIN (SELECT trace_id, launch, min(least(es, gs)) AS cs, max(greatest(ee, ge)) AS ce
                                   FROM lcb WHERE k IN (SELECT k FROM op) GROUP BY ALL) c USING (trace_id, launch)
            LEFT JOIN wl ON wl.trace_id = bounds.trace_id AND wl.launch = bounds.launch
              AND (ce IS NULL OR NOT (bucket = 'cb_wait_until_completed' AND at_ns > ce + greatest(1000000, (ce - cs) * 0.1)))
            GROUP BY bounds.trace_id, bounds.launch, bounds.s, bounds.e, cs, ce))""",
    "viewport_command_buffers": """
        SELECT r.trace_id, r.launch AS launch_index, range_id, k AS command_buffer_index
        FROM rng r JOIN lcb ON lcb.trace_id = r.trace_id AND lcb.launch = r.launch
        LEFT JOIN (SELECT trace_id, launch, owner, min(at_ns) AS w FROM wl WHERE at_ns IS NOT NULL AND owner IS NOT NULL GROUP BY ALL) f
          ON f.trace_id = lcb.trace_id AND f.launch = lcb.launch AND f.owner = lcb.k
        WHERE (greatest(ee, ge) >= a AND least(es, gs) <= b) OR w BETWEEN a AND b""",
    "line_report": """
        SELECT trace_id, total AS total_lines, total - bad AS parsed_rows, bad AS malformed_rows, CAST(0 AS BIGINT) AS blank_rows,
               false AS line_too_long
        FROM (SELECT trace_id, CAST(sum(n) AS BIGINT) + 1 AS total, CAST(sum(b) AS BIGINT) AS bad FROM (
          SELECT trace_id, count(*) AS n, count(*) FILTER (k % 101 = 0) AS b FROM cb GROUP BY trace_id
          UNION ALL SELECT trace_id, count(*), 0 FROM op GROUP BY trace_id
          UNION ALL SELECT trace_id, count(*), 0 FROM wt GROUP BY trace_id) GROUP BY trace_id)""",
    "malformed_lines": """
        SELECT trace_id, k AS line_no, 'Invalid JSON' AS message,
               CASE WHEN length(t) <= 200 THEN t ELSE substring(t, 1, 200) || '…' END AS preview
        FROM (SELECT trace_id, k,
                CASE k % 3
                  WHEN 0 THEN printf('{"record":"cb","schema_version":1,"command_buffer_index":%d,"encode_start_ns":%d,"encode_end_ns":%d,"gpu_start_ns":%d,"gpu_end_ns":%d} x', k, es, ee, gs, ge)
                  WHEN 1 THEN printf('{"cb_index":%d,"encode_start_ns":%d,"encode_end_ns":%d,"gpu_start_ns":%d,"gpu_end_ns":%d} x', k, es, ee, gs, ge)
                  ELSE printf('{"type":"Command_Buffer ","commandBufferIndex":%d,"encodeStartNs":%d,"encodeEndNs":%d,"gpuStartNs":%d,"gpuEndNs":%d} x', k, es, ee, gs, ge)
                END AS t FROM cb WHERE k % 101 = 0)""",
    "normalized_command_buffers": """
        SELECT trace_id, k AS line_no, k AS command_buffer_index, es AS encode_start_ns, ee AS encode_end_ns,
               gs AS gpu_start_ns, ge AS gpu_end_ns FROM cb WHERE k % 101 <> 0""",
    "normalized_operations": """
        SELECT trace_id, line_no, CAST(seq AS BIGINT) AS seq, k AS command_buffer_index, kernel,
               CAST(calls AS BIGINT) AS set_bytes_calls, bytes AS set_bytes_total_bytes, CAST(binds AS BIGINT) AS buffer_binds FROM op""",
    "normalized_waits": """
        SELECT trace_id, line_no, bucket, wait_ns, raw_at AS at_ns, owner AS command_buffer_index, owner IS NOT NULL AS has_legacy_index,
               wait_class, CASE WHEN bucket = 'sched_backpressure' THEN 'scheduler-mirror' ELSE wait_class END AS detail_class,
               CASE WHEN bucket <> 'sched_backpressure' THEN wait_class END AS headline_category
        FROM wt WHERE line_no % 103 <> 0""",
    "reported_buckets": """
        SELECT trace_id, bucket, count(*) AS count, CAST(sum(wait_ns) AS BIGINT) AS total_ns
        FROM wt WHERE trace_id IN (SELECT trace_id FROM cb) GROUP BY trace_id, bucket""",
    "evidence_grades": """
        SELECT trace_id, good AS command_buffers, operations, waits, CAST(1 AS BIGINT) AS summaries, odd AS unrecognized,
               bad AS malformed_rows, CAST(0 AS BIGINT) AS duplicate_rows, 'complete' AS source_completeness,
               good + bad AS reported_cbs_total, good AS analyzed_cbs_total,
               CASE WHEN bad > 0 THEN 'cbs_total' ELSE '' END AS count_mismatches, bad = 0 AND odd = 0 AS valid_evidence,
               CASE WHEN bad = 0 AND odd = 0 THEN 'Complete evidence' ELSE concat_ws('; ',
                 CASE WHEN bad > 0 THEN 'Malformed rows: ' || bad END, CASE WHEN odd > 0 THEN 'Unsupported rows: ' || odd END,
                 CASE WHEN bad > 0 THEN 'Summary count mismatch' END) END AS badges,
               CASE WHEN bad = 0 AND odd = 0 THEN 'Capture complete' ELSE 'Degraded' END AS state
        FROM (SELECT trace_id, count(*) FILTER (k % 101 <> 0) AS good, count(*) FILTER (k % 101 = 0) AS bad FROM cb GROUP BY trace_id)
        JOIN (SELECT trace_id, count(*) AS operations FROM op GROUP BY trace_id) USING (trace_id)
        JOIN (SELECT trace_id, count(*) FILTER (line_no % 103 <> 0) AS waits, count(*) FILTER (line_no % 103 = 0) AS odd
              FROM wt GROUP BY trace_id) USING (trace_id)""",
    "strict_violations": """
        SELECT trace_id, 'unsafe-integer' AS code, count(*) AS violations FROM cb WHERE k % 500 = 3 GROUP BY trace_id
        UNION ALL SELECT trace_id, 'total-mismatch:cbs_total', 1 FROM cb WHERE k % 500 = 3 GROUP BY trace_id
        UNION ALL SELECT trace_id, 'declared-operations', 1 FROM op WHERE k % 500 = 3 GROUP BY trace_id
        UNION ALL SELECT trace_id, 'missing-owner', count(*) FROM (
          SELECT trace_id FROM op WHERE k % 500 = 3 UNION ALL SELECT trace_id FROM wt WHERE owner % 500 = 3) GROUP BY trace_id""",
    "curated_windows": """
        SELECT trace_id, mode AS selection_mode, lo AS source_start_ns, hi AS source_end_ns, n AS command_buffers,
               (SELECT count(*) FROM op JOIN cut_cb c ON c.k = op.k WHERE c.trace_id = w.trace_id) AS ops,
               (SELECT count(*) FROM cut_wait x WHERE x.trace_id = w.trace_id) AS waits
        FROM cut_window w""",
    "curated_rows": """
        SELECT trace_id, record, count(*) AS rows, CAST(sum(es) AS BIGINT) AS encode_start_ns, CAST(sum(ge) AS BIGINT) AS gpu_end_ns,
               CAST(sum(at_ns) AS BIGINT) AS at_ns, CAST(sum(wait_ns) AS BIGINT) AS wait_ns, CAST(sum(ops) AS BIGINT) AS ops_total
        FROM (
          SELECT c.trace_id, 'cb' AS record, es - lo AS es, ge - lo AS ge, NULL AS at_ns, NULL AS wait_ns, NULL AS ops
          FROM cut_cb c JOIN cut_window w ON w.trace_id = c.trace_id
          UNION ALL SELECT c.trace_id, 'op', NULL, NULL, NULL, NULL, NULL FROM op JOIN cut_cb c ON c.k = op.k
          UNION ALL SELECT x.trace_id, 'wait', NULL, NULL, raw_at - lo, wait_ns, NULL FROM cut_wait x JOIN cut_window w ON w.trace_id = x.trace_id
          UNION ALL SELECT w.trace_id, 'summary', NULL, NULL, NULL, NULL, (SELECT count(*) FROM op JOIN cut_cb c ON c.k = op.k WHERE c.trace_id = w.trace_id)
          FROM cut_window w) GROUP BY trace_id, record""",
    "curated_verification": """
        SELECT trace_id, 'structural-curated-file' AS validation_scope, false AS raw_provenance_attested,
               n + ops + waits + 1 AS rows, n AS command_buffers, ops, waits, sha256(trace_id) AS source_sha256,
               true AS source_complete, true AS valid_evidence
        FROM (SELECT trace_id, n, (SELECT count(*) FROM op JOIN cut_cb c ON c.k = op.k WHERE c.trace_id = w.trace_id) AS ops,
                     (SELECT count(*) FROM cut_wait x WHERE x.trace_id = w.trace_id) AS waits FROM cut_window w)""",
    "run_names": """
        SELECT k AS customer,
               CASE WHEN ok THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS capture_utc,
               CASE WHEN ok THEN CASE WHEN k % 5 = 0 THEN 'window-cb64' ELSE 'raw' END END AS artifact,
               CASE WHEN ok THEN '' ELSE 'grammar-mismatch' END AS errors,
               substring(sha256(c_mktsegment || '/' || name), 1, 24) AS trace_id, true AS path_is_safe,
               CASE WHEN k % 11 <> 0 THEN 'https://huggingface.co/own/r' || k END AS url
        FROM (SELECT *, coalesce(k % 7 <> 0 AND ts IS NOT NULL, false) AS ok FROM (
          SELECT k, c_mktsegment, d, (CASE WHEN k % 7 = 0 THEN 'Own' ELSE 'own' END) || k || '--re.po__me__' || replace(d, ' ', 't') || 'z.'
                 || (CASE WHEN k % 5 = 0 THEN 'window-cb64' ELSE 'raw' END) || '.jsonl' AS name,
                 try_strptime(d, '%Y-%m-%d %H-%M-%S') AS ts
          FROM (SELECT c_custkey AS k, c_mktsegment, printf('20%02d-%02d-%02d 10-%02d-30', c_custkey % 30, c_custkey % 13, c_custkey % 31 + 1, c_custkey % 60) AS d
                FROM customer)))""",
}
# A document or report shows the figures of other queries.
ORACLES["visible_evidence"] = f"""
    SELECT f.trace_id, f.launch_index, f.trace_id || '-launch-' || (f.launch_index + 1) || '-visible-timeline.json' AS file_name,
           (SELECT count(*) FROM seen WHERE seen.trace_id = f.trace_id AND seen.launch = f.launch_index) AS command_buffers,
           (SELECT count(*) FROM seen WHERE seen.trace_id = f.trace_id AND seen.launch = f.launch_index) AS listed_command_buffers,
           (SELECT count(*) FROM pl WHERE pl.trace_id = f.trace_id AND pl.launch = f.launch_index AND at_ns BETWEEN a AND b) AS dispatches,
           (SELECT count(*) FROM wl WHERE wl.trace_id = f.trace_id AND wl.launch = f.launch_index AND at_ns BETWEEN a AND b) AS waits,
           (SELECT arg_min(kernel, struct_pack(n := -n, k := kernel)) FROM (
              SELECT kernel, count(*) AS n FROM pl WHERE pl.trace_id = f.trace_id AND pl.launch = f.launch_index AND at_ns BETWEEN a AND b
              GROUP BY kernel)) AS top_kernel,
           (SELECT CAST(sum(e - s) AS BIGINT) FROM lisl WHERE lisl.trace_id = f.trace_id AND lisl.launch = f.launch_index) AS gpu_busy_ns
    FROM focus f"""
ORACLES["range_report_figures"] = (
    "SELECT trace_id, launch_index, range_id, gpu_busy_ns, hidden_host_ns, ops_total AS dispatches, headline_wait_ns "
    f"FROM ({ORACLES['range_summaries']})"
)
PIECES["focus"] = (
    "SELECT trace_id, launch_index, focus_start_ns AS a, focus_end_ns AS b FROM (" + ORACLES["focus_windows"] + ")"
)
PIECES["seen"] = """
    SELECT f.trace_id, lcb.launch, k FROM focus f JOIN lcb ON lcb.trace_id = f.trace_id AND lcb.launch = f.launch_index
    LEFT JOIN (SELECT trace_id, launch, owner, min(at_ns) AS w FROM wl WHERE at_ns IS NOT NULL AND owner IS NOT NULL GROUP BY ALL) o
      ON o.trace_id = lcb.trace_id AND o.launch = lcb.launch AND o.owner = lcb.k
    WHERE (greatest(ee, ge) >= a AND least(es, gs) <= b) OR w BETWEEN a AND b"""

ORACLES["ordered_marks"] = """
    SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY at_ns, kind_rank, line_no) - 1 AS place, kind, round(at_ns, 3) AS at_ns FROM (
      SELECT trace_id, CAST(at_ns AS DOUBLE) AS at_ns, 0 AS kind_rank, 'dispatch' AS kind, line_no FROM pl WHERE at_ns IS NOT NULL
      UNION ALL SELECT trace_id, CAST(at_ns AS DOUBLE), 1, 'wait', line_no FROM aw WHERE at_ns IS NOT NULL)"""
ORACLES["dispatch_ranks"] = """
    SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq, line_no) - 1 AS place, CAST(seq AS BIGINT) AS seq FROM op"""
for _name in ("kernel_census", "wait_taxonomy"):
    _trace, _launch = ORACLES[f"{_name}_by_trace"], ORACLES[f"{_name}_by_launch"]
    ORACLES[f"{_name}_scopes"] = f"""
    SELECT 'trace' AS scope, NULL AS launch_index, * FROM ({_trace}) UNION ALL BY NAME SELECT 'launch' AS scope, * FROM ({_launch})"""
ORACLES["empty_buffers_in_ranges"] = """
    SELECT trace_id, launch AS launch_index, range_id, count(*) FILTER (WHERE CASE WHEN k % 89 = 0 THEN es BETWEEN a AND b
             ELSE least(ee, b) > greatest(es, a) OR least(ge, b) > greatest(gs, a) END) AS cbs_total
    FROM rng LEFT JOIN lcb USING (trace_id, launch) GROUP BY trace_id, launch, range_id"""
ORACLES["placement_from_buckets"] = ORACLES["dispatch_placement"]
ORACLES["density_from_pyramid"] = ORACLES["dispatch_density"]
ORACLES["density_mode_from_pyramid"] = ORACLES["dispatch_density_mode"]
ORACLES["stored_tables"] = ORACLES["wait_taxonomy_by_trace"]
ORACLES["curated_files"] = """
    SELECT trace_id, n + 1 + (SELECT count(*) FROM op JOIN cut_cb c ON c.k = op.k WHERE c.trace_id = w.trace_id)
             + (SELECT count(*) FROM cut_wait x WHERE x.trace_id = w.trace_id) AS rows,
           n AS command_buffers, 'summary' AS last_record FROM cut_window w"""


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for name, text in ORACLES.items()}
