"""Recompression and periodic runs against plain search."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np

from dispatchlake.llm import periods
from dispatchlake.llm.grammar import Grammar
from dispatchlake.llm.queries import op13_periodic_runs


def brute_runs(words):
    least = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(6, 4 * q):
                least.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    kinds, words = rng.choice([1, 2, 3, 10]), []
    for _ in range(rng.randint(0, 5)):
        words += [rng.randrange(kinds) for _ in range(rng.randint(1, 8))] * rng.randint(1, 8)
    return words


def test_extensions():
    rng = random.Random(3)
    for _ in range(200):
        texts = [w for w in (some_words(rng) for _ in range(4)) if len(w) > 1]
        grammar = Grammar([np.array(t, np.int64) for t in texts])
        assert len(grammar.levels[-1].symbols) == 2 * len(texts) + 1
        for t, at in zip(texts, grammar.offsets.tolist()):
            x = np.array([rng.randrange(len(t) - 1) for _ in range(30)])
            y = np.array([rng.randrange(i + 1, len(t)) for i in x])
            ahead, behind = grammar.forward(x + at, y + at), grammar.backward(x + at, y + at)
            for i, j, a, b in zip(x.tolist(), y.tolist(), ahead.tolist(), behind.tolist()):
                assert a == next((k for k in range(len(t)) if j + k >= len(t) or t[i + k] != t[j + k]))
                assert b == next((k for k in range(len(t)) if i - k < 0 or t[i - k] != t[j - k]))


def test_runs(monkeypatch):
    rng = random.Random(1)
    for turn in range(1500):
        monkeypatch.setattr(periods, "AT_ONCE", rng.choice([1, 50, 1 << 19]))
        texts = [some_words(rng) for _ in range(rng.randint(0, 6))]
        assert periods.runs_of([np.array(t, np.int64) for t in texts]) == [brute_runs(t) for t in texts]


def test_long_texts_take_time_in_proportion():
    n = 300_000
    noise = np.random.default_rng(1).integers(0, 5000, n)
    for words, want in ((np.zeros(n, np.int64), [(0, n, 1)]), (np.arange(n) % 7, [(0, n, 7)]), (noise, []), (np.tile(noise[: n // 5], 5), [(0, n, n // 5)])):
        start = time.time()
        assert periods.runs_of([words])[0] == want
        assert time.time() - start < 20


def collapsed_of(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def answer(words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return runs, best, collapsed_of(words, runs)


def test_documents(spark):
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "a\x85b " * 4, "x " + "a b " * 5 + "a a a a a a y", "w " * 5000, " ".join(map(str, range(3000))), "é é\té é é é é", "a b c d " * 4 + "e f " * 8]
    rows = [(i, t, 1, "k", "c") for i, t in enumerate(texts)] + [(None, "b b b b b b", 2, "k", "c"), (4, texts[4], 1, "k", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string, strongest string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in periods.find(docs).collect()), key=repr)
    want = []
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs, best, collapsed = answer(words)
        want.append((doc, len(words), runs, best, collapsed))
    assert got == sorted(want, key=repr)
    assert periods.find(docs.where("false")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in op13_periodic_runs(spark, folder).collect()}
    seen = 0
    for doc, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, best, collapsed = answer(words)
        r = found.pop(doc)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()
        seen += len(runs)
    assert not found and seen > 3
