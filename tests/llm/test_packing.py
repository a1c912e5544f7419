"""Packing: every id once, no gaps, capacity kept, little padding."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from dispatchlake.llm import packing
from dispatchlake.llm.queries import QUERIES

WORD = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(WORD)
    return [e.ids + [2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, ids_of, capacity, crc=False):
    """rows: tuples doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    seen, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, ids, tokens, sequence, offset in rows:
        assert 0 < length <= capacity and tokens == len(ids_of[doc])
        want = np.array(ids_of[doc][start : start + length], "<u4").tobytes()
        assert (zlib.crc32(want) if crc else want) == (ids if crc else bytes(ids))
        seen[doc].append((start, length))
        sequences[sequence].append((offset, length))
    assert seen.keys() == ids_of.keys()
    for doc, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids_of[doc])
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at
    return padding / (capacity * len(sequences))


def test_differencing_against_plain_sums():
    rng = random.Random(5)
    for n, k in [(1, 1), (3, 5), (40, 4), (300, 17), (64, 64)]:
        sizes = [rng.randint(1, 4095) for _ in range(n)]
        dealt = packing.difference(sizes, k)
        assert sorted(i for w in dealt for i in w) == list(range(n)) and len(dealt) <= k
        if n >= 10 * k:
            sums = [sum(sizes[i] for i in w) for w in dealt]
            assert max(sums) - min(sums) < 0.02 * sum(sizes) / k
    assert packing.difference([], 3) == []


def test_windows_hold_everything_and_stay_within_capacity():
    rng = random.Random(6)
    for n, top in [(0, 1), (1, 4095), (500, 4095), (2000, 300), (3, 4095), (256, 4095)]:
        sizes = [rng.randint(1, top) for _ in range(n)]
        windows = packing.windows_of(sizes, 4096)
        covered = defaultdict(list)
        for w in windows:
            assert sum(length for _, _, length in w) <= 4096
            for i, start, length in w:
                covered[i].append((start, length))
        assert all(sum(x[1] for x in covered[i]) == sizes[i] for i in range(n))
        least = -(-sum(sizes) // 4096)
        assert len(windows) <= least + 1


def test_count_rises_until_differencing_fits():
    """Items of more than half a window need one each, however far that is above the least count."""
    windows = packing.windows_of([60] * 90, 100, parts=1)
    assert len(windows) == 90
    halves = packing.windows_of([60, 60, 60], 100, parts=2)
    assert len(halves) == 2 and all(sum(length for _, _, length in w) <= 100 for w in halves)
    assert [p for w in packing.windows_of([100], 100) for p in w] == [(0, 0, 100)]


def test_odd_rows(spark):
    texts = [None, "", "  \n ", "<|endoftext|> don't <|ENDOFTEXT|><|startoftext|>  STOP now é😀 é", "word " * 9000, "x" * 30000, "a\x1cb \x85 c"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = [tuple(r) for r in packing.pack(docs, WORD, 2).collect()]
    check(rows, dict(enumerate(plain_ids(texts))), 4096)
    twice = packing.pack(docs.limit(1).union(docs.limit(1)).withColumn("doc_id", docs.doc_id.cast("string")), WORD, 2).collect()
    assert [r.doc_tokens for r in twice] == [1, 1]
    assert packing.pack(docs.where("false"), WORD, 2).count() == 0


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = [tuple(r) for r in QUERIES["op3_packing"](spark, folder).collect()]
    padding = check(rows, dict(zip([d.doc_id for d in docs], plain_ids([d.text for d in docs]))), 4096, crc=True)
    assert padding < 0.02
