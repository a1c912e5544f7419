"""Join of documents whose n-gram sets have a high Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import map_slices, rows_of, runs, staged, text_key, whole
from dispatchlake.llm.graph import components

#: A block of the trie join holds at most this many sets and n-grams, but one set at least.
BLOCK_SETS, BLOCK_GRAMS = 2000, 2_000_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = np.uint64(31)


class _Hashes(dict):
    """Eight bytes for each word; forgets all when it has grown to ``most`` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _B
    return (x ^ (x >> _S)) * _C


def gram_set(text: bytes, width: int = 3) -> np.ndarray:
    """The distinct n-grams of a text, as sorted 64-bit hashes; fewer words than ``width`` are one n-gram."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(_hashes.__getitem__, words)), "<u8")
    width = min(width, len(words))
    value = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        value = _mix(value * _A + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(value)


def size_classes(size: int, percent: int) -> list[tuple[int, int]]:
    """(name, largest size) of the classes in which sets of ``size`` meet all sets that may link with them.

    Classes end at sizes that grow by half. Sets near an end also meet in a
    class around that end, so two linked sets always share a class.
    """
    found, first, name = [], 1, 0
    while first * percent <= size * 100:
        after = first + first // 2 + 1
        if first <= size < after:
            found.append((2 * name, after - 1))
        top = (first - 1) * 100 // percent
        if first * percent <= size * 100 and size <= top:
            found.append((2 * name + 1, top))
        first, name = after, name + 1
    return found


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which two linked sets share at least one; their number is linear in the set for every ``percent``.

    Sets of a class with sizes to m that link differ in at most
    d = 2m(100 - p) / (100 + p) n-grams. Over d + 1 + e ranges of the hash
    values at least 1 + e hold the same n-grams in both. A range with less than
    two n-grams is weak: it says little. Where ranges hold few n-grams at best,
    only empty ones are weak, and e is larger. Where a set has at most e weak
    ranges, a common one is among the others; else all common ones may be weak,
    in both sets, and both add the first size - ceil(size * p / 100) + 1 n-grams
    by hash: two linked sets always have one of these in common.
    """
    out = []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(grams))])
    few = 16 * (100 - percent) > 100 + percent  # under eight n-grams a range
    short = False
    for name, top in size_classes(len(grams), percent):
        d = 2 * top * (100 - percent) // (100 + percent)
        spare = 0 if d == 0 else 1 + d // (4 if few else 16)
        parts = d + 1 + spare
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])
        number = np.arange(parts, dtype=np.uint64) + np.uint64(name << 32)
        values = _mix(_mix(sums[at[1:]] - sums[at[:-1]]) + number * _A)
        weak = np.diff(at) < (1 if few else 2) if spare else np.zeros(parts, bool)
        out.append(values[~weak])
        short |= weak.sum() > spare
    if short:
        out.append(_mix(grams[: len(grams) + 1 - -(-len(grams) * percent // 100)] ^ _C))
    return np.concatenate(out)


def gram_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, ``n_shingles``, ``digest`` of the set, and ``signatures``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), whole(text_col).cast("binary").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, offsets, values = [], [], [0], []
        for text in batch.column("text").to_pylist():
            grams = gram_set(text, width)
            sizes.append(len(grams))
            digests.append(xxhash.xxh3_128_digest(grams) if len(grams) else None)
            mine = signatures(grams, percent) if len(grams) else grams
            values.append(mine)
            offsets.append(offsets[-1] + len(mine))
        flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc_id", "text_key", "n_shingles", "digest", "signatures"])

    return map_slices(source, "doc_id long, text_key long, n_shingles long, digest binary, signatures array<long>", work)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the first document of each signature to its others; rows come sorted by both."""
    last, head = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        signature, node = (batch.column(i).to_numpy() for i in (0, 1))
        first = np.concatenate([[signature[0] != last if last is not None else True], signature[1:] != signature[:-1]])
        where = np.maximum.accumulate(np.where(first, np.arange(len(node)), -1))
        heads = np.where(where < 0, head, node[where])
        last, head = signature[-1], heads[-1]
        pairs = np.unique(np.stack([heads, node], 1)[heads != node], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


class _Trie:
    """Sorted sets as a compressed prefix tree. A node: [set, from depth, to depth, children, sets that end here, least size, largest size]."""

    def __init__(self, sets: list[np.ndarray], chosen: list[int]):
        self.sets = sets
        self.root = [0, 0, 0, [], [], 1 << 60, 0]
        path = [self.root]
        before = None
        for k in sorted(chosen, key=lambda i: sets[i].astype(">i4").tobytes()):
            mine = sets[k]
            common = 0
            if before is not None:
                m = min(len(before), len(mine))
                unlike = np.flatnonzero(before[:m] != mine[:m])
                common = int(unlike[0]) if len(unlike) else m
            while path[-1][1] >= common and len(path) > 1:
                path.pop()
            tip = path[-1]
            if tip[2] > common:  # cut the edge where the new set leaves it
                tip[3], tip[4], tip[2] = [[tip[0], common, tip[2], tip[3], tip[4], tip[5], tip[6]]], [], common
            if common < len(mine):
                leaf = [k, common, len(mine), [], [], 1 << 60, 0]
                tip[3].append(leaf)
                path.append(leaf)
            path[-1][4].append(k)
            for node in path:
                node[5], node[6] = min(node[5], len(mine)), max(node[6], len(mine))
            before = mine


def block_labels(ids: np.ndarray, grams: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set of a block the least id that its links lead to. Sets with one id belong together.

    All sets are ordered by one global order, the hash of an n-gram, and kept in
    a prefix tree. A set walks down the tree once: the overlap along a common
    prefix is counted for all sets below it, and a subtree is left as soon as
    what remains of the set or of its longest member can't reach the overlap
    that its smallest member needs. In large blocks the sets are first held
    against some single ones; those that are together afterwards need no walk
    among themselves.
    """
    n = len(ids)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            small, large = (i, j) if ids[i] <= ids[j] else (j, i)
            parent[large] = small

    by_id: dict[int, int] = {}
    for i, value in enumerate(ids.tolist()):
        union(by_id.setdefault(value, i), i)
    sizes = np.array([len(g) for g in grams])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    vocabulary, flat = np.unique(np.concatenate(grams), return_inverse=True)
    flat = flat.astype(np.int32)
    sets = [flat[offsets[i] : offsets[i + 1]] for i in range(n)]
    mark = np.zeros(len(vocabulary), bool)
    top, low = 100 + percent, percent
    if n > 64:
        tried: set[int] = set()
        for _ in range(16):
            alone = next((i for i in range(n) if find(i) == i and i not in tried), None)
            if alone is None:
                break
            tried.add(alone)
            mark[sets[alone]] = True
            overlap = np.add.reduceat(mark[flat], offsets[:-1], dtype=np.int64)
            mark[sets[alone]] = False
            for j in np.flatnonzero(top * overlap >= low * (sizes + sizes[alone])).tolist():
                union(alone, j)
    roots = [find(i) for i in range(n)]
    names, members = np.unique(roots, return_counts=True)
    if len(names) > 1:
        main = names[members.argmax()] if n > 64 else -1
        trie = _Trie(sets, [i for i in range(n) if roots[i] != main])
        for x in range(n):
            mine, a = sets[x], int(sizes[x])
            mark[mine] = True
            stack = [(trie.root, 0)]
            while stack:
                (k, start, end, children, here, least, most), overlap = stack.pop()
                if end > start:
                    edge = sets[k][start:end]
                    overlap += int(np.count_nonzero(mark[edge]))
                    left = min(a - int(np.searchsorted(mine, edge[-1], "right")), most - end)
                    if top * (overlap + left) < low * (a + least):
                        continue
                for y in here:
                    if y != x and top * overlap >= low * (a + int(sizes[y])):
                        union(x, y)
                stack.extend((child, overlap) for child in children)
            mark[mine] = False
    return np.array([ids[find(i)] for i in range(n)])


def _join_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``label`` of the sets of every block. ``sets`` must be a written table (see ``link``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, "block"):
            ids = block.column("node").to_numpy()
            labels = block_labels(ids, [np.frombuffer(g, "<u8") for g in block.column("grams").to_pylist()], percent)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64())], names=["node", "label"])

    return sets.repartition("block").sortWithinPartitions("block", "node").select("block", "node", "grams").mapInArrow(run, "node long, label long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per document ``doc_id``, ``text_key``, ``n_shingles`` and ``component_id``, the least id its links lead to.

    Two documents link when 100 |A n B| >= percent |A u B| for their n-gram
    sets. Exact: equal sets become one class first; classes that share a
    signature (see ``signatures``) are candidates, as a star around the first of
    each signature, never as all pairs; each connected set of candidates is a
    block of the trie join. A set of candidates beyond the size of a block is
    split, and every two of its parts meet in one task. Only signatures, class
    digests and the texts of candidates move.

    Defined results: a null or empty text has no n-grams, links with nothing
    and is its own component; a null id takes no part and has a null component;
    repeated rows are one node, and rows that share an id but not a text are nodes
    of their own with one name; other columns are not read; an empty table gives
    an empty result.
    """
    rows = staged(gram_rows(docs, id_col, text_col, width, percent))
    filled = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(filled.groupBy("digest").agg(F.min("doc_id").alias("node")))
    chosen = filled.join(classes, "digest").where("doc_id = node").select("node", F.explode("signatures").alias("signature"))
    starred = chosen.select("signature", "node").repartition("signature").sortWithinPartitions("signature", "node").mapInArrow(_stars, "a long, b long")
    candidates = staged(components(starred.distinct()))

    names = filled.join(candidates, F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "text_key")
    texts = rows_of(docs, names, id_col, text_col).select(F.col(id_col).cast("long").alias("node"), whole(text_col).cast("binary").alias("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = [gram_set(text, width) for text in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], names=["node", "n", "grams"])

    members = filled.join(candidates, F.col("doc_id") == F.col("node")).select("label", "n_shingles")
    needed = F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n_shingles") / block_grams)).alias("parts")
    placed = candidates.join(members.groupBy("label").agg(needed), "label")
    # Written before the rows of a block are put together: right on top of a join by the
    # same key Spark leaves out the repartition, and may split that join.
    sized = staged(map_slices(texts, "node long, n long, grams binary", make).where("n > 0").join(placed, "node"))
    small = _join_blocks(sized.where("parts = 1").withColumn("block", F.col("label")), percent)
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    other = F.explode(F.expr("filter(sequence(0L, parts - 1), x -> x <> own)"))
    paired = sized.where("parts > 1").withColumn("own", own).withColumn("other", other)
    paired = paired.withColumn("block", F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")))
    met = _join_blocks(paired, percent).where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = small.unionByName(components(met)).where("node <> label")

    named = classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    linked = filled.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest").drop("digest")
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
