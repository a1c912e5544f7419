"""Personal data against the plain expressions of the base rules."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections import defaultdict

from dispatchlake.llm import pii
from dispatchlake.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


ODD = [
    None,
    "",
    "a@b.c_d@e.f g@h..i x@y@z.com .@-.-",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0255.4 1.2.3 00000256.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111",
    "+1 (017) 555-7713 +49 30 1234567890123456 +1-((((( +12 +1.2.3.4.5.6.7.8.9.0",
    "é😀 é@é.com é+1 2345678901é 😀a@b.co",
    "1" * 20000 + " " + "a" * 20000 + "@" + ".a" * 3000 + "-" * 500,
    "4111111111111111@mail.com 10.0.0.1@x.y +4111111111111111",
]


def test_base_spans_equal_the_plain_expressions(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, spans string")
    got = pii.find(docs).select("doc_id", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        assert r.b == listed(plain_spans(ODD[r.doc_id])), r.doc_id
        assert set(r.b.split(",")) <= set(r.s.split(","))


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op1_pii"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in want) for k in PLAIN]


def digits(value: str) -> int:
    return len(re.sub("[^0-9]", "", value))


def plain_places(text: str) -> list[tuple]:
    """Words and runs that no base span touches: start, end, value, before, after."""
    base, found = plain_spans(text), []
    for m in re.finditer(pii.LOOSE, text, re.ASCII):
        value = re.sub(r"[^0-9A-Za-z]++$", "", m[0])
        inner = re.sub("^[^0-9A-Za-z]++", "", value)
        end = m.start() + len(value)
        found.append((end - len(inner), end, inner, m))
    found += [(m.start(), m.end(), m[0], m) for m in re.finditer(pii.RUN, text, re.ASCII) if any(plausible(k, m[0]) for k in PLAIN)]
    return [(a, b, v, m) for a, b, v, m in found if v and not any(x[0] < b and a < x[2] for x in base)]


def plausible(kind: str, value: str) -> bool:
    if kind == "email":
        return "@" in value
    if kind == "ip":
        return bool(re.search(r"^[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){3,7}$", value))
    return 12 <= digits(value) <= 19 if kind == "card" else 7 <= digits(value) <= 15


def plain_contexts(before: str, after: str) -> set[str]:
    left, right = (re.sub("[0-9]", "0", t.lower()).split() for t in (before, after))
    found = {f"L {left[-1]}"} if left else set()
    found |= {f"R {right[0]}"} if right else set()
    found |= {f"LL {left[-2]} {left[-1]}"} if len(left) > 1 else set()
    return found | ({f"LR {left[-1]} {right[0]}"} if left and right else set())


def plain_bootstrap(texts: list[str], confident: float = 0.75, support: int = 3) -> dict[str, str]:
    """Kinds of values that only contexts give away, by the definition."""
    seeds, edges, weights = defaultdict(set), defaultdict(set), {}

    def around(text, pattern, m):
        """Up to 64 code points on either side, not beyond the neighbouring matches of the same rule."""
        spans = [x.span() for x in re.finditer(pattern, text, re.ASCII)]
        i = spans.index(m.span())
        return text[max(spans[i - 1][1] if i else 0, m.start() - 64) : m.start()], text[m.end() : min(spans[i + 1][0] if i + 1 < len(spans) else len(text), m.end() + 64)]

    known = set()
    for text in texts:
        for start, _, end, kind in plain_spans(text):
            m = next(x for x in re.finditer(PLAIN[kind], text) if x.start() == start)
            for pattern in plain_contexts(*around(text, PLAIN[kind], m)):
                seeds[pattern].add((text[start:end], kind))
        for _, _, value, m in plain_places(text):
            before, after = around(text, m.re.pattern, m)
            apart = re.search(r"[0-9][ ().-]{1,3}$", before) or re.search(r"^[ ().-]{1,3}[0-9]", after)
            group = r"[0-9](?:[^\s0-9]?[0-9]){5}"
            half = apart or re.search(rf"[ ()].*{group}|{group}.*[ ()]", value)
            for pattern in plain_contexts(before, after):
                edges[pattern].add(value)
                weights[pattern, value] = max(weights.get((pattern, value), 0), 0.5 if half else 1.0)
    seeded = {p: {v: max(k for w, k in pairs if w == v) for v, _ in pairs} for p, pairs in seeds.items()}
    found: dict[str, tuple[str, float]] = {}
    while True:
        scores = defaultdict(list)
        for pattern in edges.keys() | seeded.keys():
            values = edges[pattern] | seeded.get(pattern, {}).keys()
            if len(values) < support:
                continue
            n = sum(max(weights.get((pattern, v), 0), 1.0 if v in seeded.get(pattern, {}) else 0) for v in values)
            mass = defaultdict(float)
            for kind in seeded.get(pattern, {}).values():
                mass[kind] += 1
            for v in edges[pattern]:
                if v in found and v not in seeded.get(pattern, {}):
                    mass[found[v][0]] += found[v][1] * weights[pattern, v]
            for kind, total in mass.items():
                if total / (n + 1) >= confident:
                    for v in edges[pattern]:
                        if v not in found and plausible(kind, v) and v not in seeded.get(pattern, {}):
                            scores[v, kind].append(total / (n + 1))
        best: dict[str, tuple[float, str]] = {}
        for (v, kind), parts in scores.items():
            score = 1 - math.prod(1 - min(x, 0.999) for x in parts)
            best[v] = max(best.get(v, (0.0, "")), (score, kind))
        new = {v: (kind, score) for v, (score, kind) in best.items() if score >= confident}
        if not new:
            return {v: kind for v, (kind, _) in found.items()}
        found |= new


def chained() -> list[str]:
    """Contexts that lead from one to the next: each is learned only from values that the one before gave away."""
    texts = [f"please call phone +1 (202) 555-{i:04d} today or never" for i in range(600)]
    before, after = "call phone", "today"
    for level, n in enumerate((180, 52, 14, 3)):
        values = [f"3{level}5.777.{1000 + i}" for i in range(n)]
        texts += [f"so {before} {v} {after} again" for v in values]
        before, after = (f"{w}{'abcd'[level]}" for w in ("over ring", "soon"))
        texts += [f"or {before} {v} {after} then" for v in values]
    return texts


def test_bootstrap_equals_the_plain_definition(spark):
    folder = "/root/testdata/sf0.001"
    corpus = [r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    for texts in (chained(), corpus):
        want = plain_bootstrap(texts)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r for r in pii.find(docs).collect()}
        for i, text in enumerate(texts):
            extra = {(a, b, want[v]) for a, b, v, _ in plain_places(text) if v in want}
            extra = {x for x in extra if not any(y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0] for y in extra)}
            assert sorted((s.start, s.end, s.kind) for s in got[i].spans) == sorted({(a, e, k) for a, _, e, k in plain_spans(text)} | extra), text[:200]
    assert len(plain_bootstrap(chained())) == 180 + 52 + 14 + 3, "the last take four rounds"


def test_many_spans_in_one_text(spark):
    """Base spans, unseen runs and masking of a text with a hundred thousand numbers take time near linear in it."""
    n = 50_000
    text = "".join(f"call 10.0.{i % 250}.1 now 12345{i % 10}7 ok " for i in range(n))
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars int")
    begun = time.time()
    row = pii.find(docs).select(pii.listed("base").alias("b")).first()
    assert row.b == listed(plain_spans(text))
    masked = pii.mask(docs).first().text
    assert masked == re.sub(PLAIN["ip"], "[IP]", text)
    assert time.time() - begun < 120


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please call phone +1 (202) 555-01{i:02d} today or never") for i in range(6)]
    rows += [(10, "please call phone 202.555.0199. today"), (11, "the number 123456789 today is odd"), (12, "code 99887766 and 11223344 here")]
    got = {r.doc_id: r.s for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert got[10] == "phone:18:30"
    assert got[12] == ""


def test_contexts_find_identifiers_of_several_words(spark):
    rows = [(i, f"please call phone +1 (202) 555-01{i:02d} today or never") for i in range(20)]
    cards = [n for n in range(4111111111110000, 4111111111110200) if luhn(str(n))]
    rows += [(20 + i, f"my visa card {' '.join(str(n)[k : k + 4] for k in (0, 4, 8, 12))} expired soon") for i, n in enumerate(cards[:20])]
    rows += [(40 + i, f"the server address 10.0.0.{i} answered again") for i in range(6)]
    shapes = {60: "020 7946 0958", 61: "555 123 4567", 62: "(017) 555-7713"}
    rows += [(d, f"please call phone {v} today or never") for d, v in shapes.items()]
    cards = {70: "4999 1111 1111 1112", 71: "4111 1111 1111"}
    rows += [(d, f"my visa card {v} expired soon") for d, v in cards.items()]
    rows += [(80, "the server address fe80::ab:cd answered again"), (90, "in rows 555 765 4321 of it"), (91, "please call phone 202.555.0199. 3 of us today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert {d: got[d] for d in shapes} == {d: f"phone:18:{18 + len(v)}" for d, v in shapes.items()}
    assert {d: got[d] for d in cards} == {d: f"card:13:{13 + len(v)}" for d, v in cards.items()}
    assert got[80] == "ip:19:30" and got[90] == "" and got[91] == "phone:18:30"
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[62] == "please call phone [PHONE] today or never"


def test_mask(spark):
    rows = [(1, "mail a@b.co or +1 202 555 0100!", 5), (2, None, 0), (3, "clean", 5), (None, "10.0.0.1", 8)]
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("mail [EMAIL] or [PHONE]!", 24), 2: (None, 0), 3: ("clean", 5), None: ("[IP]", 4)}


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
