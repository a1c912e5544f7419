"""Segments against brute force, and scores on held-out rows."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter

from dispatchlake.llm import toxicity
from dispatchlake.llm.queries import QUERIES


def brute_best(scores):
    best = 0.0
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            best = max(best, total)
    return best


def brute_segments(scores, offset=0):
    """By definition: the best segment (shortest), then the same to its left and right."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12 or (at and abs(total - best) < 1e-12 and j - i < at[1] - at[0] - 1):
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return brute_segments(scores[:i], offset) + [(i + offset, j + offset, best)] + brute_segments(scores[j:], offset + j)


def test_segments_take_linear_time():
    n = 1_000_000
    rng = random.Random(2)
    for scores in ([1.0, -0.1] * (n // 2), [0.05, -0.1] * (n // 2), [rng.choice([-0.3, 0.1, 0.3]) for _ in range(n)], [0.2 * (i % 3 == 0) - 0.1 for i in range(n)], [rng.uniform(-1, 0.9) for _ in range(n)]):
        start = time.time()
        toxicity.segments(scores)
        assert time.time() - start < 10


def test_segments():
    rng = random.Random(1)
    for _ in range(400):
        scores = [rng.choice([-0.3, rng.uniform(-1.0, 0.0), 0.0, rng.uniform(0.1, 1.0)]) for _ in range(rng.randint(0, 30))]
        got = toxicity.segments(scores)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert abs(max((s for *_, s in got), default=0.0) - brute_best(scores)) < 1e-9


def test_signed_weights(spark):
    """Words of clean texts count against a segment; weights and scores equal those of the plain formulas."""
    rows = [(i, "vile rotten scum here" if i % 4 == 0 else "calm kind friend here") for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    learned = [(t, y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5]
    counts = {y: Counter(f for t, label in learned if label == y for f in {f for w in t.split() for f in toxicity.features(w)}) for y in (0, 1)}
    sums = {y: sum(counts[y].values()) for y in (0, 1)}
    mass = 0.05 * (sums[0] + sums[1])
    for feature in counts[0] | counts[1]:
        pseudo = 0.05 * (counts[0][feature] + counts[1][feature])
        b, g = counts[1][feature] + pseudo, counts[0][feature] + pseudo
        odds = math.log(b / (sums[1] + mass - b)) - math.log(g / (sums[0] + mass - g))
        certain = abs(odds / math.sqrt(1 / b + 1 / g)) >= 3
        assert (feature in model.weights) == certain and (not certain or abs(model.weights[feature] - odds) < 1e-9), feature
    assert model.weights["scum."] > 0 > model.weights["friend."] and model.word_score("here") == -model.drift
    text = "vile scum friend unknown vile"
    scores = [model.word_score(w) for w in text.split()]
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert abs(got.score - model.score(model.evidence([s for *_, s in brute_segments(scores)], 5))) < 1e-9


def test_repeated_labelled_id(spark):
    """Of many rows of one labelled id one is learned from."""
    docs = spark.createDataFrame([(i, "vile scum" if i % 2 else "calm friend") for i in range(60)] + [(1, f"text {k}") for k in range(500)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert "text." not in model.weights and model.weights["vile."] > 0


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    test = [(rows[d], y) for d, y in labels.items() if rows[d].held_out]
    assert sum(r.predicted == y for r, y in test) / len(test) > 0.97
    hits = [r.predicted for r, y in test if y == 1]
    assert sum(hits) / len(hits) > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you idiot moron" if i % 2 else "good day to all") for i in range(60)] + [(100, None), (101, ""), (None, "idiot"), (102, "x " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 1), (3, None, 0), (5, 1, 1)], "doc_id long, toxic int, score int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[1].score > 0.5 > got[0].score and got[100].score < 0.5 and got[101].n_words == 0
    assert [(p.start, p.end) for p in got[1].passages] == [(0, 15)]
    for empty in (labels.where("toxic = 0"), labels.where("false")):
        assert all(r.score < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0
