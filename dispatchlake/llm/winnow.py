"""Benchmark passages in documents, found by winnowed fingerprints."""

from __future__ import annotations

import hashlib
import math
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.llm.common import map_slices, staged, text_key, whole
from dispatchlake.llm.lines import _filter_of

#: Words that a document and an item have to share in a row.
SPAN = 10
#: The filter of fingerprints has 2^MOST_BITS bits at most (8 MB), and fewer where fewer will do.
MOST_BITS, BITS_EACH = 26, 16
REMEMBERED = 1 << 19

_WORD_BYTES = (string.ascii_letters + string.digits).encode() + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and makes a space of every byte that is in no word.
_FOLD = bytes(b if b in _WORD_BYTES else 0x20 for b in range(256)).lower()
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)


class _Hashes(dict):
    """Hashes of words, remembered up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a text in UTF-8: runs of letters, digits and what is not ASCII."""
    return text.translate(_FOLD).split()


def fingerprints(words: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``span`` words, the least hash of a k-gram in it and the place of that k-gram.

    k is half of the span, rounded up. Of equal hashes the last counts, so the
    places never go back. Two windows of equal words have the same hash at the
    same distance from their beginnings: every shared stretch of ``span`` words is
    seen through a fingerprint of its own.
    """
    k = (span + 1) // 2
    grams, windows = len(words) - k + 1, len(words) - span + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    value = np.full(grams, span, np.uint64)
    for i in range(k):
        value = (value ^ hashes[i : grams + i]) * _STEP
        value ^= value >> _HALF
    value *= _MIX
    value = (value ^ (value >> _HALF)).view(np.int64)
    least, place = value[:windows].copy(), np.zeros(windows, np.int64)
    for i in range(1, span - k + 1):
        other = value[i : windows + i]
        smaller = other <= least
        least = np.where(smaller, other, least)
        place[smaller] = i
    return least, place + np.arange(windows)


def digest(words: list[bytes]) -> bytes:
    """Identifies the content of a window."""
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def index_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per window of an item: ``item_id, span, fingerprint, offset, digest``.

    An item of fewer words than ``span`` is one window of its own span; one
    without words has none. ``offset`` is where the fingerprint is in the window.
    """
    source = benchmark.select(F.col(id_col).alias("item_id"), whole(text_col).cast("binary").alias("text"))
    kind = source.schema["item_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, spans, prints, offsets, digests = [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = words_of(text)
            size = min(span, len(words))
            if not size:
                continue
            least, place = fingerprints(words, size)
            n = len(least)
            index += [i] * n
            spans += [size] * n
            prints += least.tolist()
            offsets += (place - np.arange(n)).tolist()
            digests += [digest(words[s : s + size]) for s in range(n)]
        columns = [batch.column("item_id").take(pa.array(index, pa.int64())), pa.array(spans, pa.int32()), pa.array(prints, pa.int64()), pa.array(offsets, pa.int32()), pa.array(digests, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["item_id", "span", "fingerprint", "offset", "digest"])

    return map_slices(source, f"item_id {kind}, span int, fingerprint long, offset int, digest binary", work)


def _passing(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints the filter lets pass."""
    keys, mask = prints.view(np.uint64), np.uint64(len(table) * 64 - 1)
    passes = np.ones(len(keys), bool)
    for shift in (np.uint64(0), _HALF):
        bit = (keys >> shift) & mask
        passes &= (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return passes


def candidates(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``row, doc_id, text_key, n_words`` and ``near``, its windows whose fingerprint may be one of ``windows``.

    The fingerprints of the items go to the tasks as a Bloom filter, whose size
    follows their number up to 8 MB. What it lets pass by mistake, more where there
    are too many fingerprints for it, is left out by the join that follows.
    """
    prints = windows.select(F.col("fingerprint").alias("line")).distinct()
    bits = max(12, min(MOST_BITS, math.ceil(math.log2(BITS_EACH * (1 + prints.count())))))
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(prints, bits))
    # At most SPAN distinct numbers.
    spans = sorted(r.span for r in windows.select("span").distinct().collect())
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), whole(text_col).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    window = pa.struct([("fingerprint", pa.int64()), ("offset", pa.int32()), ("digest", pa.binary()), ("start", pa.int32()), ("span", pa.int32())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = sent.value
        sizes, prints, offsets, digests, starts, widths, ends = [], [], [], [], [], [], [0]
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            sizes.append(len(words))
            for span in spans:
                least, place = fingerprints(words, span)
                # Neighbouring windows mostly have one fingerprint between them: each is looked up once.
                fresh = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
                at = np.flatnonzero(np.repeat(_passing(table, least[fresh]), np.diff(np.append(fresh, len(least)))))
                if len(at):
                    prints.append(least[at])
                    offsets.append(place[at] - at)
                    starts.append(at)
                    widths.append(np.full(len(at), span))
                    digests += [digest(words[s : s + span]) for s in at.tolist()]
            ends.append(len(digests))
        flat = [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64)) for p in (prints, offsets, starts, widths)]
        fields = [flat[0], flat[1].cast(pa.int32()), pa.array(digests, pa.binary()), flat[2].cast(pa.int32()), flat[3].cast(pa.int32())]
        near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(window)))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), near], names=["row", "doc_id", "text_key", "n_words", "near"])

    return map_slices(source, f"row long, doc_id {kind}, text_key long, n_words long, near array<struct<fingerprint:long,offset:int,digest:binary,start:int,span:int>>", work)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit``, the hit ``stretches`` and the ``items`` they come from.

    Fingerprints of documents and of benchmark windows are joined; a hit extends
    to the whole window around the fingerprint, whose content has to be equal (by
    128 bits of SHA-256), and windows that overlap or touch make one stretch
    (``start``, ``stop`` in words). Texts never move: what does are the windows of
    documents that pass the filter. A window that many items share is one row of
    the join; the items are attached to distinct windows of a document.

    Defined results: a null or empty text has no words and no hits; an item
    without words has no windows; an item of fewer than ``span`` words is hit only
    as a whole; items with a null id hit, and are not listed; repeated items are
    listed once; repeated documents are each answered; other columns are not read;
    an empty table on either side gives no hits.
    """
    indexed = staged(index_items(benchmark, item_id_col, item_text_col, span))
    key = ["fingerprint", "offset", "digest"]
    windows = staged(indexed.select(*key, "span").distinct())
    owners = staged(indexed.where("item_id IS NOT NULL").select("digest", F.col("item_id").cast("string").alias("item")).distinct())
    made = staged(candidates(docs, windows, id_col, text_col))
    near = made.where("size(near) > 0").select("row", F.explode("near").alias("w")).select("row", "w.*")
    # Of its file size Spark knows whether ``windows`` is small enough to be sent to all tasks.
    hits = staged(near.join(windows.drop("span"), key).select("row", "start", (F.col("start") + F.col("span")).alias("stop"), "digest"))

    inside = Window.partitionBy("row").orderBy("start", "stop")
    reach = F.max("stop").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    parted = hits.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("stretch", F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = parted.groupBy("row", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    stretches = stretches.groupBy("row").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("stretches"))
    items = hits.select("row", "digest").distinct().join(owners, "digest").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    joined = made.drop("near").join(stretches, "row", "left").join(items, "row", "left")
    return joined.select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("stretches", F.array().cast("array<struct<start:int,stop:int>>")).alias("stretches"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
