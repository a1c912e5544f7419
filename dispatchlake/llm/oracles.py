"""SQL of the registered queries that SQL can express."""

from __future__ import annotations

from dispatchlake.llm.quality import BASE_RULES, HOST_RULES, RULES, SURE, TOLERATED, WEIGHT

SPACES = r"[\x20\x09-\x0D]+"

_BASE = " OR ".join(f"({test})" for test in BASE_RULES.values())

QUALITY_CTES = f"""
texts AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM {{documents}}),
words AS (SELECT *, list_filter(string_split_regex(t, '{SPACES}'), lambda x: x <> '') AS w FROM texts),
windows AS (SELECT doc_id, w[i : i + 4] AS g, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM windows) WHERE k > 1
  ) GROUP BY doc_id
),
measured AS (
  SELECT doc_id, host, len(w) AS n_words,
    length(regexp_replace(t, '{SPACES}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS n_lines,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM words LEFT JOIN repeated r USING (doc_id)
),
by_host AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {test}) AS {rule}" for rule, test in RULES.items())} FROM measured WHERE host IS NOT NULL GROUP BY host),
by_rule AS ({" UNION ALL ".join(f"SELECT host, '{rule}' AS rule, n, {rule} AS failed FROM by_host" for rule in RULES)}),
totals AS (
  SELECT rule, count(*) AS hosts, sum(n) AS all_n, sum(n * n) AS square_n, sum(failed) / sum(n) AS mean, sum(failed * failed / n) AS squares FROM by_rule GROUP BY rule
),
priors AS (SELECT rule, mean, {WEIGHT} AS weight FROM totals),
rates AS (SELECT host, rule, n + weight AS total, (failed + mean * weight) / (n + weight) AS rate FROM by_rule JOIN priors USING (rule)),
flagged AS (SELECT host, rule FROM rates WHERE rate - {SURE} * sqrt(rate * (1 - rate) / (total + 1)) > {TOLERATED}),
judged AS (
  SELECT m.*, ({_BASE}) AS base_failed,
    NOT ({_BASE}) AND NOT ({" OR ".join(f"(({test}) AND host IN (SELECT host FROM flagged WHERE rule = '{rule}'))" for rule, test in HOST_RULES.items())}) AS kept
  FROM measured m
)
"""

OP4 = f"""
WITH {QUALITY_CTES.replace("{documents}", "documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(kept, NOT base_failed) AS kept FROM judged
"""

OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n, regexp_replace(t, '{SPACES}', '', 'g') AS s FROM d)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept, sha256(s) AS text_sha256
FROM n WINDOW g AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
g AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
  )
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
  ) p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 90 * (u.n + v.n - k)
),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w, least(len(w), 10) AS n FROM benchmark WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
win AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i))),
hit AS (SELECT win.* FROM win SEMI JOIN item ON win.n = item.n AND win.g = item.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM (SELECT DISTINCT doc_id, n, g FROM hit) JOIN item USING (n, g) WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: The checksum of a decimal number: eight steps for each byte, by a table made of the same eight steps.
_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"

OP12 = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claimed
  FROM documents, crc
),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS total FROM leaves),
nodes(lvl, tree, place, total, node) AS (
  SELECT 0, tree, place, total, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, tree, place // 3, (total + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM nodes WHERE total > 1 GROUP BY lvl, tree, place // 3, total
),
subroots AS MATERIALIZED (SELECT tree, lvl AS height, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1),
tops(lvl, place, total, node) AS (
  SELECT 0, place, total, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 3, (total + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM tops WHERE total > 1 GROUP BY lvl, place // 3, total
),
own AS (
  SELECT a.lvl, a.tree, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS r
  FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.tree = b.tree AND a.place // 3 = b.place // 3 WHERE a.total > 1 GROUP BY a.lvl, a.tree, a.place
),
over AS (
  SELECT a.lvl, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS r
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.place // 3 = b.place // 3 WHERE a.total > 1 GROUP BY a.lvl, a.place
),
steps AS MATERIALIZED (
  SELECT p.tree, p.place, o.lvl, o.l, o.r FROM placed p JOIN own o ON o.tree = p.tree AND o.place = p.place // (3 ** o.lvl)::BIGINT
  UNION ALL
  SELECT p.tree, p.place, s.height + o.lvl, o.l, o.r FROM placed p JOIN subroots s ON s.tree = p.tree JOIN over o ON o.place = s.place // (3 ** o.lvl)::BIGINT
),
fold(tree, place, lvl, node) AS (
  SELECT tree, place, 0, claimed FROM placed
  UNION ALL
  SELECT f.tree, f.place, f.lvl + 1, sha256(s.l || f.node || s.r) FROM fold f JOIN steps s ON s.tree = f.tree AND s.place = f.place AND s.lvl = f.lvl
),
proofs AS (SELECT tree, place, string_agg(l || r, '' ORDER BY lvl) AS proof FROM steps GROUP BY tree, place),
root AS (SELECT node AS root FROM tops WHERE total = 1),
folded AS (SELECT tree, place, arg_max(node, lvl) AS folded_root FROM fold GROUP BY tree, place)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s USING (tree) JOIN folded f ON f.tree = p.tree AND f.place = p.place LEFT JOIN proofs q ON q.tree = p.tree AND q.place = p.place, root
"""

ORACLES: dict[str, str] = {
    "op4_quality_rules": OP4,
    "op6_ngram_jaccard_join": OP6,
    "op10_exact_dedup": OP10,
    "op11_decontamination": OP11,
    "op12_merkle_manifest": OP12,
}
