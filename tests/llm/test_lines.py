"""Line dedup against all pairs."""

from __future__ import annotations

import random

from dispatchlake.llm import lines
from dispatchlake.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute(texts, least=5):
    """(doc_id, line_no) -> None if kept, else the earliest line it repeats and its edits."""
    seen, verdicts = [], {}
    for doc in sorted(texts):
        for number, line in enumerate((texts[doc] or "").split("\n")):
            words = line.encode().split()
            verdicts[doc, number] = None
            if not words:
                continue
            for other, place in seen:
                if other == words or (min(len(words), len(other)) >= least and abs(len(words) - len(other)) < 2 and distance(words, other) <= 1):
                    verdicts[doc, number] = (*place, int(other != words))
                    break
            seen.append((words, (doc, number)))
    return verdicts


def verdicts(rows):
    return {(r.doc_id, r.line_no): None if r.kept else (r.keep_id, r.keep_line, r.edits) for r in rows}


def test_within_one():
    rng = random.Random(8)
    for _ in range(3000):
        a = [rng.choice("ab") for _ in range(rng.randint(0, 6))]
        b = [rng.choice("ab") for _ in range(rng.randint(0, 6))]
        assert lines.within_one(a, b) == (distance(a, b) <= 1)


def test_keys_are_shared_exactly_within_one_edit():
    rng = random.Random(9)
    for _ in range(1500):
        a = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(5, 8))]
        b = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(5, 8))]
        if rng.random() < 0.7:
            b = list(a)
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = [b"c"] * rng.randint(0, 2)
        if a == b or len(b) < 5:
            continue
        near = distance(a, b) <= 1
        assert bool(set(lines.neighbour_keys(a).tolist()) & set(lines.neighbour_keys(b).tolist())) == near, (a, b)
        assert not near or set(lines.half_keys(a)) & set(lines.half_keys(b))


def test_small_tables(spark):
    rng = random.Random(10)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(30)]
    texts = {0: None, 1: "", 2: "\n\n", 3: "one two  three four five", 4: "one two three four\tfive\none two three four six"}
    for d in range(5, 60):
        mine = []
        for _ in range(rng.randint(1, 8)):
            words = rng.choice(base).split()
            if rng.random() < 0.6:
                i = rng.randrange(len(words) + 1)
                words[i : i + rng.randint(0, 1)] = [rng.choice("abcz")] * rng.randint(0, 1)
            mine.append(" ".join(words))
        texts[d] = "\n".join(mine)
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, digest string").repartition(5)
    assert verdicts(lines.judge(docs).collect()) == brute(texts)
    assert verdicts(lines.judge(docs, filter_bits=6).collect()) == brute(texts)
    assert lines.judge(docs.where("false")).count() == 0
    twice = lines.judge(docs.where("doc_id = 4").union(docs.where("doc_id = 4"))).collect()
    assert sorted((r.line_no, r.kept) for r in twice) == [(0, False), (0, True), (1, False), (1, False)]
    assert lines.judge(spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")).where("kept").first().doc_id == 1


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert verdicts(QUERIES["op9_line_dedup"](spark, folder).collect()) == brute(texts)
