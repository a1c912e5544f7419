"""Deduplication of lines within an edit bound, by keys of deletion neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import map_slices, staged, text_key, whole

_STEP, _PLACE, _MIX = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_HIGH = np.uint64(32)


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of which two lines within one edit share at least one.

    The shorter of the two has n words. Cut it after n // 2 of them: the edit is
    on one side, and on the other the lines are equal from their outer ends. A
    line has the keys of both roles, the shorter one and the longer by a word.
    """
    keys = []
    for n in (len(words), len(words) - 1):
        m = n // 2
        for side, part in ((b"L", words[:m]), (b"R", words[len(words) - (n - m) :])):
            keys.append(xxhash.xxh3_64_intdigest(b"%b%d %b" % (side, n, b" ".join(part))) - (1 << 63))
    return keys


def neighbour_keys(words: list[bytes]) -> np.ndarray:
    """Keys that two lines share exactly when one edit of a word leads from one to the other.

    Without its word i a line has the key (rest, i): lines that differ in the
    word i share it. As it is, a line has the key (line, i) for every i: lines
    that have a word more at i share that.
    """
    n = len(words)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP)]))
    here = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[1:])])
    moved = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1])])
    without = here[:-1] + (moved[-1] - moved[1:])
    values = np.concatenate([without, np.full(n + 1, here[-1])])
    places = np.concatenate([np.arange(n), np.arange(n + 1)]).astype(np.uint64)
    mixed = (values ^ (values >> _HIGH)) * _MIX + places * _PLACE
    return ((mixed ^ (mixed >> _HIGH)) * _MIX).view(np.int64)


def within_one(one: list, other: list) -> bool:
    """Whether at most one word has to be changed, added or taken away."""
    if abs(len(one) - len(other)) > 1:
        return False
    i = 0
    while i < min(len(one), len(other)) and one[i] == other[i]:
        i += 1
    return one[i + (len(one) >= len(other)) :] == other[i + (len(other) >= len(one)) :]


def line_hash(joined: bytes) -> int:
    return xxhash.xxh3_64_intdigest(joined)


def line_rows(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """One row per line: where it is, its number of words, a digest and a hash (``line``) of the words, and ``half_keys`` if it is long enough."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.monotonically_increasing_id().alias("row"), whole(text_col).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, numbers, sizes, digests, hashes, keys = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for number, line in enumerate(text.split(b"\n")):
                words = line.split()
                index.append(i)
                numbers.append(number)
                sizes.append(len(words))
                joined = b" ".join(words)
                digests.append(xxhash.xxh3_128_digest(joined) if words else None)
                hashes.append(line_hash(joined))
                keys.append(half_keys(words) if len(words) >= least_words else None)
        place = pa.array(index, pa.int64())
        columns = [batch.column(c).take(place) for c in ("doc_id", "text_key", "row")]
        columns += [pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "row", "line_no", "n_words", "digest", "line", "keys"])

    return map_slices(source, f"doc_id {kind}, text_key long, row long, line_no int, n_words int, digest binary, line long, keys array<long>", work)


def _filter_of(lines: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the column ``line``: 2^bits bits, whatever the number of rows.

    The bits are put together by Spark, 64 at a time; the driver gets 2^(bits - 6)
    numbers at most.
    """
    places = F.explode(F.array(*(F.expr(f"shiftrightunsigned(line, {shift}) & {(1 << bits) - 1}L") for shift in (0, 32)))).alias("bit")
    words = lines.select(places).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("ones"))
    found = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("ones").to_numpy()
    return table.view(np.uint64)


def _passes(table: np.ndarray, line: int) -> bool:
    mask = len(table) * 64 - 1
    return all(int(table[(line >> shift & mask) >> 6]) >> (line >> shift & 63) & 1 for shift in (0, 32))


def _texts(docs: DataFrame, places: DataFrame, near: DataFrame, id_col: str, text_col: str, least_words: int, bits: int) -> DataFrame:
    """``places`` (doc_id, text_key, line_no, ...) with the ``words`` of their lines.

    A second pass over the texts takes out the lines that a Bloom filter of ``near``
    lets pass, so that of the others nothing moves; the join is exact. A table with
    more near lines than the filter can tell apart moves more lines, no fewer.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), whole(text_col).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(near, bits))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = sent.value
        index, numbers, lines = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for number, line in enumerate(text.split(b"\n")):
                words = line.split()
                joined = b" ".join(words)
                if len(words) >= least_words and _passes(table, line_hash(joined)):
                    index.append(i)
                    numbers.append(number)
                    lines.append(joined)
        place = pa.array(index, pa.int64())
        columns = [batch.column(c).take(place) for c in ("doc_id", "text_key")] + [pa.array(numbers, pa.int32()), pa.array(lines, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "_line", "words"])

    lines = map_slices(source, f"_id {kind}, _key long, _line int, words binary", work).dropDuplicates(["_id", "_key", "_line"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("line_no") == F.col("_line"))
    return places.join(lines, same).drop("_id", "_key", "_line")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row", "line_no")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5, filter_bits: int = 26) -> DataFrame:
    """Verdict on every line: ``doc_id``, ``text_key``, ``row``, ``line_no``, ``n_words``, ``kept``, and the line it repeats.

    A line goes when an earlier one, by document id and line number, has the
    same words, or, for lines of at least ``least_words`` words, differs by one
    word changed, added or taken away (``edits`` is 1 then). ``keep_id`` and
    ``keep_line`` name the earliest such line.

    Equal lines are one row each from the start. Of the others only those that
    share the outer half of their words with another can be within one edit;
    they alone are read again (past a filter of ``2 ** filter_bits`` bits) and emit all their deletion neighbours as hashed keys. All lines of a
    key are within one edit of each other, so the earliest of a key serves all,
    and a key that very many lines share costs no more than its rows. Each pair
    taken is verified word by word.

    Defined results: a line without words is kept, and so is the one line of a
    null or empty text; a null id comes after all others; of repeated rows the
    first in reading order keeps its lines; other columns are not read; an empty
    table gives an empty result.
    """
    rows = staged(line_rows(docs, id_col, text_col, least_words))
    first = F.min(F.struct(_place().alias("place"), "text_key")).alias("first")
    distinct = staged(rows.where("n_words > 0").groupBy("digest").agg(first, F.count("*").alias("times"), F.max("line").alias("line")))

    keyed = rows.where("keys IS NOT NULL").select("line", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("line").alias("least"), F.max("line").alias("most")).where("least < most").select("key")
    near = staged(keyed.join(shared, "key", "left_semi").select("line").distinct())
    chosen = distinct.join(near, "line", "left_semi").select("digest", "first.place.*", "first.text_key")
    worded = _texts(docs, chosen, near, id_col, text_col, least_words, filter_bits).orderBy("missing", "doc_id", "row", "line_no")
    ranked = staged(worded.withColumn("rank", F.monotonically_increasing_id()))  # grows with the place

    def neighbours(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [neighbour_keys(line.split()) for line in batch.column("text").to_pylist()]
        ranks = np.repeat(batch.column("rank").to_numpy(), [len(x) for x in found])
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ranks, pa.int64())], names=["key", "rank"])

    variants = map_slices(ranked.select("rank", F.col("words").alias("text")), "key long, rank long", neighbours)
    heads = staged(variants.groupBy("key").agg(F.min("rank").alias("head"), F.max("rank").alias("last")).where("head < last").select("key", "head"))
    partners = variants.join(heads, "key").where("head < rank").groupBy("rank").agg(F.min("head").alias("head"))
    early = ranked.select(F.col("rank").alias("head"), F.struct("doc_id", "row", "line_no").alias("partner"), F.col("words").alias("text"))
    pairs = partners.join(ranked.select("rank", "digest", "words"), "rank").join(early, "head").select("digest", "partner", "words", "text")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = [within_one(a.split(), b.split()) for a, b in zip(batch.column("words").to_pylist(), batch.column("text").to_pylist())]
        return batch.select(["digest", "partner"]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["partner"].dataType.simpleString()
    matched = map_slices(pairs, f"digest binary, partner {kind}", verify)
    known = staged(distinct.join(matched, "digest", "left").where("times > 1 OR partner IS NOT NULL").select("digest", F.col("first.place").alias("first"), "partner"))

    joined = rows.drop("keys", "line").join(known, "digest", "left")
    is_first = F.col("first").isNull() | ((F.col("first.row") == F.col("row")) & (F.col("first.line_no") == F.col("line_no")))
    kept = F.col("partner").isNull() & is_first
    target = F.when(F.col("partner").isNotNull(), F.struct(F.col("partner.doc_id").alias("doc_id"), F.col("partner.line_no").alias("line_no"), F.lit(1).alias("edits"))).otherwise(
        F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), F.lit(0).alias("edits"))
    )
    told = F.when(~kept, target)
    return joined.select("doc_id", "text_key", "row", "line_no", "n_words", kept.alias("kept"), told["doc_id"].alias("keep_id"), told["line_no"].alias("keep_line"), told["edits"].alias("edits"))
