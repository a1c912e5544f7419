"""The pipeline stage by stage against plain Python."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import brute_components, brute_exact
from tests.llm.test_packing import check
from tests.llm.test_pii import plain_spans
from tests.llm.test_quality import plain


def masked(text):
    out, at = "", 0
    for start, _, end, kind in plain_spans(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.where("doc_id < 9")).union(spark.createDataFrame([(None, "words and more words " * 1 + "one two three four five six seven", "en", None, 9), (5000, None, None, None, None)], docs.schema))
    now = [(r.doc_id, r.text) for r in docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == before.columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            now = [(d, t) for d, t in now if plain(t)[0] >= 10 and 100 * plain(t)[5] <= 20 * plain(t)[0]]
        elif name == "exact_dedup":
            now = list(dict.fromkeys(now))
            keep = brute_exact([(10**9 if d is None else d, t) for d, t in now])
            now = [(d, t) for d, t in now if keep[10**9 if d is None else d][0] == (10**9 if d is None else d)]
        elif name == "near_dedup":
            linked = brute_components([(d, t) for d, t in now if d is not None])
            now = [(d, t) for d, t in now if d is None or linked[d][1] == d]
        elif name == "pii":
            now = [(d, masked(t)) for d, t in now]
        if name != "packing":
            assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(now, key=str), name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [2] for d, t in now}
    check([tuple(r) for r in docs.collect()], ids, 4096)


def test_empty_and_odd_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    empty = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, 0), (2, "", None, None, 0)], docs.schema)
    odd = odd.withColumn("kept", odd.lang).withColumn("spans", odd.lang).withColumn("_place", odd.lang)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        got = stage(spark, odd, "")
        assert got.count() == {"quality_rules": 0, "exact_dedup": 1, "near_dedup": 4, "pii": 4, "packing": 4}[name], name
        assert name == "packing" or got.columns == odd.columns, name
