"""Encoding and decoding against the library itself."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import sentencepiece

from dispatchlake.llm import pieces
from dispatchlake.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
library = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts():
    rng = random.Random(3)
    coder = pieces.coder(MODEL)
    alphabet = ["a", "e", "t", "h", "in", "the", " ", " ", "  ", "\n", "\t", "é", "ß", "中", "😀", "▁", "▁▁", "0", "1", "<0x0A>", "</s>", "<s>", ".", ",", "\x00", "�", "ing", "tion", "STR", "_", "-" * 5]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_eos=True)
        got = [int.from_bytes(coder.encode(text)[4 * i : 4 * i + 4], "little") for i in range(len(want))]
        assert len(coder.encode(text)) == 4 * len(want) and got == want, repr(text)
        assert coder.decode(want) == library.decode(want), repr(text)


def test_texts_of_any_length():
    rng = random.Random(6)
    coder = pieces.coder(MODEL)
    n = 200_000
    for text in ("a" + " " * n + "b", " " * n, "x" * n, "\n" * n, "".join(rng.choice("abcdeth") for _ in range(n)), "  a" * (n // 3), "中" * n, "the " * n):
        start = time.time()
        got = np.frombuffer(coder.encode(text), "<i4").tolist()
        assert time.time() - start < 10
        assert got == library.encode(text, add_eos=True)
    for k in range(1, 80):
        for rest in ("", "the", "中", "\x00", "\nb", "- x"):
            text = " " * k + rest + " " * (k % 7) + "end"
            assert np.frombuffer(coder.encode(text), "<i4").tolist() == library.encode(text, add_eos=True), repr(text)


def test_tokens_that_go_together():
    rng = random.Random(5)
    coder = pieces.coder(MODEL)
    names, seen = list(coder.id), [0, 0]
    for _ in range(20_000):
        one, other = rng.choice(names), rng.choice(names)
        if rng.random() < 0.7 and len(one) > 1:
            cut = rng.randrange(1, len(one))
            one, other = one[:cut], one[cut:]
        if one in coder.id and other in coder.id and pieces.SPACE not in other and (len(other) == 1 or coder.halves[other]):
            want = coder.merged(one + other)[0] == [one, other]
            assert coder.go_together(one, other) == want, (one, other)
            seen[want] += 1
    assert min(seen) > 1000


def test_memory_of_two_halves(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 8)
    made = []
    memory = pieces._Memory(lambda key: made.append(key) or key * 2)
    for key in [1, 2, 3, 4, 5, 1, 6, 1, 7, 8, 1]:
        assert memory[key] == key * 2
    assert made.count(1) == 1 and len(memory) + len(memory.older) <= 8


def test_decode_of_any_ids():
    rng = random.Random(4)
    coder = pieces.coder(MODEL)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(0, 32000), 28705, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_odd_rows(spark):
    texts = [None, "", " ", "  two  spaces ", "x" * 50000, "ab" * 3000 + "\n" * 3000, "word " * 8000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] * 2, "doc_id int, text string, ids string")
    rows = pieces.encode(docs, MODEL).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.ids == want and r.decoded == library.decode(want)
    assert pieces.encode(docs.where("false"), MODEL).count() == 0


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op2_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
