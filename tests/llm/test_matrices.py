"""Packed matrices: exact round trip, and best fit against a plain search."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from dispatchlake.llm import matrices
from dispatchlake.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_best_fit_against_plain_search():
    rng = random.Random(11)
    for capacity in (1, 7, 100, 128):
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        rooms, plain = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [r for r in rooms if r >= sizes[i]]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - sizes[i])
            else:
                rooms.append(capacity - sizes[i])
            plain.append(sorted(rooms))
        rows = matrices.best_fit(sizes, capacity)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert sorted(capacity - sum(sizes[i] for i in row) for row in rows) == sorted(rooms)


def round_trip(rows, capacity, pad):
    found = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == capacity and (ids[r.n_tokens :] == pad).all()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            found[doc].setdefault(start, []).extend(ids[a:b].tolist())
    return {doc: [i for start in sorted(parts) for i in parts[start]] for doc, parts in found.items()}


def test_round_trip(spark):
    texts = [None, "", "  a  b\n\n c ", "word " * 5000, "x" * 9000, "<|endoftext|>", "é😀\t\n z"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    tokenizer = Tokenizer.from_file(BYTES)
    rows = matrices.pack(docs, BYTES, 50256, 0, capacity=256).collect()
    got = round_trip(rows, 256, 0)
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [50256] for i, t in enumerate(texts)}
    assert tokenizer.decode(got[2][:-1]) == texts[2]
    assert matrices.pack(docs.where("false"), BYTES, 50256, 0).count() == 0
    nameless = matrices.pack(docs.where("doc_id = 1").selectExpr("CAST(NULL AS STRING) AS doc_id", "text"), BYTES, 50256, 0).first()
    assert nameless.doc_ids == [None] and nameless.n_tokens == 1


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(BYTES)
    lengths = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in docs.items()}
    rows = QUERIES["op7_token_matrices"](spark, folder).collect()
    sums = defaultdict(int)
    for r in rows:
        for doc, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]):
            sums[doc] += b - a
    assert sums == lengths
    assert sum(lengths.values()) / (2048 * len(rows)) > 0.97
