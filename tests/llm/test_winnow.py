"""Winnowed fingerprints and contamination against plain search."""

from __future__ import annotations

import random
import re

from dispatchlake.llm import winnow

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words():
    for text in ("", "A b-C_d!\x00e\x7ff 9", "É Éa ñ中文 a\x85b\xa0c", "x\ty\nz ÀB"):
        assert [w.decode() for w in winnow.words_of(text.encode())] == plain_words(text)


def test_every_shared_window_has_a_fingerprint():
    rng = random.Random(1)
    for _ in range(400):
        span = rng.randint(1, 10)
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        least, place = winnow.fingerprints(words, span)
        assert len(least) == max(0, len(words) - span + 1)
        assert all(s <= p <= s + span // 2 for s, p in enumerate(place.tolist())) and sorted(place.tolist()) == place.tolist()
        for s in range(len(least)):
            alone, where = winnow.fingerprints(words[s : s + span], span)
            assert (alone[0], where[0]) == (least[s], place[s] - s)


def brute(docs, items):
    wanted = {}
    for item, text in items:
        words = plain_words(text)
        size = min(10, len(words))
        for s in range(len(words) - size + 1) if size else ():
            wanted.setdefault(tuple(words[s : s + size]), set()).add(item)
    sizes = {len(w) for w in wanted}
    found = []
    for doc, text in docs:
        words, hit, of = plain_words(text), set(), set()
        for size in sizes:
            for s in range(len(words) - size + 1):
                owners = wanted.get(tuple(words[s : s + size]))
                if owners is not None:
                    hit |= set(range(s, s + size))
                    of |= owners - {None}
        found.append((doc, len(words), len(hit), sorted(map(str, of)), sorted(i for i in hit if i - 1 not in hit), sorted(i + 1 for i in hit if i + 1 not in hit)))
    return sorted(found, key=repr)


def found_by(docs, benchmark):
    rows = winnow.contamination(docs, benchmark).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items, [s.start for s in r.stretches], [s.stop for s in r.stretches]) for r in rows), key=repr)


def test_contamination(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["a", "B", "ç", "d1", "e"]
    passage = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, passage(rng.choice([3, 7, 9, 10, 11, 30]))) for i in range(30)]
    items += [(5, "zz"), (100, None), (101, "?!"), (None, passage(12)), (102, items[0][1]), (0, items[0][1]), (103, "q " * 40)]
    docs = []
    for i in range(60):
        text = passage(rng.randint(0, 40))
        if i % 2:
            text += ", " + (rng.choice(items)[1] or "").upper() + "!" + passage(5)
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, "q " * 3000), (203, "ZZ"), (None, items[3][1]), (3, docs[3][1]), (204, "word " * 20_000 + items[29][1])]
    table = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], "doc_id long, text string, row string, digest string, start int").repartition(4)
    benchmark = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, span int").repartition(2)
    assert found_by(table, benchmark) == brute(docs, items)
    # A filter too small to tell anything apart, and joins by shuffle, change nothing.
    monkeypatch.setattr(winnow, "MOST_BITS", 12)
    monkeypatch.setattr(winnow, "BITS_EACH", 1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found_by(table, benchmark) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found_by(table.where("false"), benchmark) == []
    assert found_by(table, benchmark.where("false")) == brute(docs, [])
