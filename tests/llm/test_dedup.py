"""Exact dedup and the n-gram join against brute force, in small and odd tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from dispatchlake.llm import exact, ngrams
from dispatchlake.llm.graph import components


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_chunks():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    for part in (b"", b"a", data[:255], data[:257], b"\0" * 100_000, data):
        ends = exact.chunk_ends(part)
        lengths = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(part)
        assert all(n <= exact.LONGEST for n in lengths) and all(n >= exact.SHORTEST for n in lengths[:-1])
    first = {data[a:b] for a, b in zip([0, *exact.chunk_ends(data)], exact.chunk_ends(data))}
    moved = b"in front" + data
    second = {moved[a:b] for a, b in zip([0, *exact.chunk_ends(moved)], exact.chunk_ends(moved))}
    assert len(first & second) > 0.9 * len(first)


def brute_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[squeezed(text)].append((-len(text or ""), doc))
    return {doc: (min(groups[squeezed(t)])[1], len(groups[squeezed(t)])) for doc, t in rows}


def test_exact_dedup(spark):
    rng = random.Random(2)
    texts = ["", None, " \n", "a b", "ab", " ab ", "x" * 50_000, "x" * 49_999 + " x", "é 😀", "é😀"] + [rng.choice(["a", "b "]) * rng.randint(1, 3) for _ in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kept string").repartition(4)
    got = exact.deduplicate(docs).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == brute_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    twice = exact.deduplicate(docs.where("doc_id = 6").union(docs.where("doc_id = 6"))).collect()
    assert sorted(r.kept for r in twice) == [False, True] and {r.group_size for r in twice} == {2}
    nameless = exact.deduplicate(spark.createDataFrame([(None, "ab"), (7, "ab")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in nameless} == {(None, 7, False), (7, 7, True)}
    assert exact.deduplicate(docs.where("false")).count() == 0


def test_chunks_of_one_identifier_and_two_contents_stay_apart(spark, monkeypatch):
    made = spark.createDataFrame([(1, b"i" * 16, b"a" * 16), (2, b"i" * 16, b"b" * 16), (3, b"j" * 16, b"c" * 16)], "row long, ids binary, checks binary")
    got = {r.row: bytes(r.identity) for r in exact.verified(made).collect()}
    assert got == {1: b"i" * 16 + b"a" * 16, 2: b"i" * 16 + b"b" * 16, 3: b"j" * 16}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_components(rows, percent=90):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in names}


def near_copies(rng):
    texts = [None, "", "One", "one", "one two", "ONE two", "one two three", "É two", "é two"]
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([5, 12, 40, 90, 200]))]
        for _ in range(rng.randint(1, 9)):
            mine = list(base)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(mine))
                mine[i : i + rng.randint(0, 1)] = [f"w{rng.randrange(60)}"] * rng.randint(0, 1)
            texts.append(" ".join(mine))
    return list(enumerate(texts))


def test_ngram_join(spark):
    for seed in (1, 2):
        rows = near_copies(random.Random(seed))
        docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, n string").repartition(3)
        want = brute_components(rows)
        for blocks in ({}, {"block_sets": 3}, {"block_grams": 150}):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.link(docs, **blocks).collect()}
            assert got == want
    assert ngrams.link(docs.where("false")).count() == 0
    # Joins that Spark splits must not tear a block.
    split = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0"}
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(w if (k + i) % 97 else f"u{i}" for k, w in enumerate(words))) for i in range(120)] + [(500 + i, " ".join(f"x{i}y{k}" for k in range(400))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for key, value in split.items():
        spark.conf.set(key, value)
    try:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.link(docs).collect()} == brute_components(rows)
    finally:
        for key in split:
            spark.conf.unset(key)
    odd = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "x y z"), (3, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in ngrams.link(odd).where("doc_id IS NOT NULL").collect()) == [(2, 2), (3, 2), (3, 3), (3, 3)]
    assert ngrams.link(odd).where("doc_id IS NULL").first().component_id is None


def test_signatures_never_miss_a_link():
    rng = np.random.default_rng(3)
    for _ in range(600):
        n = int(rng.integers(1, 400))
        one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        change = int(rng.integers(0, max(1, n // 9) + 1))
        other = np.unique(np.concatenate([rng.permutation(one)[change:], rng.integers(0, 2**63, int(rng.integers(0, change + 1))).astype(np.uint64) * np.uint64(2)]))
        if not len(other):
            continue
        both = len(np.intersect1d(one, other))
        if 100 * both >= 90 * (len(one) + len(other) - both):
            assert set(ngrams.signatures(one, 90).tolist()) & set(ngrams.signatures(other, 90).tolist())


def test_signatures_stay_linear_and_never_miss_at_any_percent():
    rng = np.random.default_rng(6)
    for percent in (80, 90, 50, 88, 95):
        for n in (1, 2, 3, 5, 8, 13, 30, 48, 100, 200, 400, 800, 3000, 20_000):
            for _ in range(20 if n < 1000 else 3):
                one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
                most = 2 * n * (100 - percent) // (100 + percent)
                lost = int(rng.integers(0, most + 1))
                other = np.unique(np.concatenate([rng.permutation(one)[lost:], rng.integers(0, 2**63, int(rng.integers(0, most - lost + 1))).astype(np.uint64) * np.uint64(2)]))
                mine, its = ngrams.signatures(one, percent), ngrams.signatures(other, percent) if len(other) else one[:0]
                assert len(mine) <= 8 * n + 8
                both = len(np.intersect1d(one, other))
                if both and 100 * both >= percent * (len(one) + len(other) - both):
                    assert set(mine.tolist()) & set(its.tolist()), (percent, n)


def test_crowded_ranges_fall_back_to_first_grams():
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        one = np.unique(rng.integers(0, 2**57, 400).astype(np.uint64))  # all in the lowest ranges
        other = np.concatenate([one[:-20], one[-20:] + np.uint64(1)])
        mine, its = ngrams.signatures(one, percent), ngrams.signatures(other, percent)
        assert set(mine.tolist()) & set(its.tolist()) and len(mine) < 400


def test_join_at_five_words_and_four_fifths(spark):
    rng = random.Random(8)
    rows = []
    for n in (50, 100, 100, 400, 900, 3000, 20_000):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for k in range(4):
            mine = list(base)
            for i in rng.sample(range(n), n * k * 2 // 300):
                mine[i] = "other"
            rows.append((len(rows), " ".join(mine)))
    words = [f"v{i}" for i in range(100)]
    rows += [(900, " ".join(words)), (901, " ".join("x" if i in (30, 70) else w for i, w in enumerate(words)))]
    split = {d: t.split() for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in split.items()}
    links = [(a, b) for a in sets for b in sets if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label, seen = {d: d for d in sets}, None
    while label != seen:
        seen = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert label[901] == 900 and len(set(label.values())) < len(rows) - 7
    for blocks in ({}, {"block_sets": 3}):
        assert {r.doc_id: r.component_id for r in ngrams.link(docs, width=5, percent=80, **blocks).collect()} == label


def test_large_blocks():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**62, 200).astype(np.uint64))
    sets = []
    for _ in range(150):
        keep = rng.random(len(base)) > rng.choice([0.01, 0.04, 0.09, 0.2])
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**62, int(rng.integers(0, 9))).astype(np.uint64)])))
    ids = rng.permutation(1000)[: len(sets)]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i in range(len(sets)):
        least[find(i)] = min(least[find(i)], ids[i])
    assert ngrams.block_labels(ids, sets, 90).tolist() == [least[find(i)] for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(5)
    for n, m in [(0, 0), (40, 30), (200, 150)]:
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(n, n + 40)] + [(n + 100, n + 100 + i) for i in range(1, 30)] if n else [])
        label = {}

        def find(i):
            label.setdefault(i, i)
            while label[i] != i:
                i = label[i]
            return i

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            label[y] = x
        got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {i: find(i) for i in label if any(i in e and e[0] != e[1] for e in edges)}
