"""Merkle manifest of a dataset: subtrees of sources under one root, proofs and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import staged
from dispatchlake.operators.ordered import with_rank

#: Nodes of a run, and levels that one superblock finishes: 3^8 = 6,561 leaves.
FANOUT, HEIGHT = 3, 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_SHARD = ["shard_tree", "shard"]


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: of each field ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [field.cast("string") for field in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes of a block and of ``height`` levels above: every three consecutive ones, at the end fewer, become one."""
    made = [nodes]
    for _ in range(height):
        last = made[-1]
        made.append([digest(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return made


def height_of(total: int, most: int) -> int:
    """Levels until one node is left of ``total``, ``most`` at the most."""
    height = 0
    while total > 1 and height < most:
        total = -(-total // FANOUT)
        height += 1
    return height


def siblings(made: list[list[str]], place: int) -> list[str]:
    """The others of the runs above a node: for each level those on its left, and those on its right, as two texts."""
    path = []
    for nodes in made[:-1]:
        start = place - place % FANOUT
        path += ["".join(nodes[start:place]), "".join(nodes[place + 1 : start + FANOUT])]
        place //= FANOUT
    return path


def fold(node: str, path: Sequence[str]) -> str:
    """The root that a node and the siblings of its path lead to."""
    for left, right in zip(path[::2], path[1::2]):
        node = digest((left, node, right))
    return node


def _trees(rows: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    """The rows of one tree after the other, in order of place."""
    for tree, mine in rows.sort_values(["tree", "place"], kind="stable").groupby("tree", sort=False):
        yield tree, mine


def _sharded(nodes: DataFrame, block: Column, buckets: int, height: int) -> DataFrame:
    """``nodes`` with the superblock each is in.

    A tree of more than 3^height nodes has a superblock for each 3^height of them;
    smaller trees share superblocks, about as large, dealt by hash.
    """
    large = F.col("total") > FANOUT**height
    return nodes.withColumn("shard_tree", F.when(large, F.col("tree")).otherwise("")).withColumn("shard", F.when(large, block).otherwise(F.pmod(F.xxhash64("tree"), F.lit(buckets))))


def _block(height: int) -> Column:
    return F.floor(F.col("place") / F.lit(FANOUT**height)).cast("long")


def _reduced(nodes: DataFrame, height: int) -> DataFrame:
    """One row per tree and superblock: ``tree, place`` among its tree's superblocks, ``total`` (nodes below) and ``node``."""
    size = FANOUT**height

    def work(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        for tree, mine in _trees(rows):
            total = int(mine["total"].iloc[0])
            made.append((tree, int(mine["place"].iloc[0]) // size, total, levels(mine["node"].tolist(), height_of(total, height))[-1][0]))
        return pd.DataFrame(made, columns=["tree", "place", "total", "node"])

    return nodes.select(*_SHARD, "tree", "place", "total", "node").groupBy(*_SHARD).applyInPandas(work, "tree string, place long, total long, node string")


def _buckets(nodes: DataFrame, height: int) -> int:
    return nodes.count() // FANOUT**height + 1


def _outer(nodes: DataFrame, height: int) -> DataFrame:
    """Of every superblock of ``nodes`` (sharded): ``tree, place, total``, the ``path`` from its node to the root, and the ``root``.

    The nodes of superblocks are leaves of a tree 3^height times smaller, so the
    proofs of these are found in the same way, until a tree is one superblock.
    """
    size = FANOUT**height
    blocks = staged(_reduced(nodes, height))
    alone = blocks.where(F.col("total") <= size).select("tree", "place", "total", F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    above = blocks.where(F.col("total") > size).withColumn("below", F.col("total")).withColumn("total", F.ceil(F.col("total") / F.lit(size)).cast("long"))
    if above.isEmpty():
        return alone
    upper = paths(above, height).join(above.select("tree", "place", "below"), ["tree", "place"])
    return alone.unionByName(upper.select("tree", "place", F.col("below").alias("total"), "path", "root"))


def _exchanged(nodes: DataFrame, outer: DataFrame, buckets: int, height: int, carried: Sequence[str], proofs: bool, claimed: bool) -> DataFrame:
    """Cogroup the nodes of each superblock with the outer nodes it needs, and finish there.

    A task has at most a superblock at a time: it reduces the block again, joins
    its siblings with the path above, and folds what each row claims to be.
    """
    kinds = dict(nodes.dtypes)
    sides = dict(outer.dtypes)
    extra = [c for c in outer.columns if c not in ("tree", "place", "total", "path")]
    finished = {"path": "array<string>"} if proofs else {}
    finished |= {"proof_sha256": "string", "folded_root": "string"} if claimed else {}
    names = ["tree", "place", "node", *carried]

    def work(_key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        over = {tree: row for tree, row in zip(above["tree"], above.to_dict("records"))}
        parts = []
        for tree, mine in _trees(rows):
            row = over[tree]
            made = levels(mine["node"].tolist(), height_of(int(row["total"]), height))
            rest = list(row["path"])
            own = [siblings(made, i) + rest for i in range(len(mine))]
            part = mine[names].copy()
            for name in extra:
                part[name] = row[name]
            if proofs:
                part["path"] = own
            if claimed:
                part["proof_sha256"] = [digest(path) for path in own]
                part["folded_root"] = [fold(node, path) for node, path in zip(mine["claimed"], own)]
            parts.append(part)
        return pd.concat(parts) if parts else pd.DataFrame(columns=[*names, *extra, *finished])

    schema = ", ".join(f"`{n}` {t}" for n, t in [*((n, kinds[n]) for n in names), *((n, sides[n]) for n in extra), *finished.items()])
    wanted = [*names, "claimed"] if claimed else names
    left = nodes.select(*_SHARD, *wanted).groupBy(*_SHARD)
    right = _sharded(outer, F.col("place"), buckets, height).groupBy(*_SHARD)
    return left.cogroup(right).applyInPandas(work, schema)


def paths(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``nodes`` (``tree, place, total, node``) with the ``path`` to the ``root`` of their tree.

    ``total`` is the number of nodes of the tree, ``place`` counts them from 0.
    """
    nodes = staged(nodes.select("tree", "place", "total", "node"))
    buckets = _buckets(nodes, height)
    sharded = _sharded(nodes, _block(height), buckets, height)
    return staged(_exchanged(sharded, staged(_outer(sharded, height)), buckets, height, [], True, False))


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    columns: Sequence[str] = COLUMNS,
    claims: Mapping[str, Column] | None = None,
    proofs: bool = True,
    height: int = HEIGHT,
) -> DataFrame:
    """One row per document: ``leaf``, ``subroot`` of its source, ``root``, and what its proof shows.

    The leaf is a digest of ``columns``. Leaves of a source ascend by id; subroots
    ascend by source. ``path`` (with ``proofs``) lists the siblings of every level,
    left ones and right ones in turn; ``proof_sha256`` is their digest,
    ``folded_root`` what they lead to from the row as ``claims`` (columns to put in
    place) has it, ``verified`` whether that is the root.

    Texts are read once and become two digests. Leaves are ranked in blocks of a
    range partitioning, so a source that holds a third of all rows is many blocks.
    Superblocks of 3^height leaves are reduced, the few nodes above them likewise,
    and leaves meet the outer nodes that their superblock needs in one cogroup.

    Defined results: a null field counts as ``-``, a null source comes first and is
    a source of its own, null ids come first in theirs; leaves of one id are in
    order of their digest, so repeated rows are leaves of their own; a source of one
    row has that leaf as its subroot; other columns are not read; an empty table
    gives an empty result.
    """
    fields = [F.col(c) for c in columns]
    claimed = [(claims or {}).get(c, F.col(c)) for c in columns]
    # Sources as text after a mark, so that null comes before the empty one.
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))
    read = staged(docs.select(F.col(id_col).alias("doc_id"), tree.alias("tree"), leaf_digest(fields).alias("node"), leaf_digest(claimed).alias("claimed")))
    ranked = with_rank(read, ["tree"], ["doc_id", "node", "claimed"])
    leaves = staged(ranked.withColumnRenamed("_rank", "place").withColumnRenamed("_total", "total"))
    buckets = _buckets(leaves, height)
    sharded = _sharded(leaves, _block(height), buckets, height)
    outer = staged(_outer(sharded, height))

    subroots = outer.where("place = 0").select(F.col("tree").alias("of"), F.col("root").alias("subroot"))
    sources = staged(with_rank(subroots, [], ["of"]).select(F.lit("").alias("tree"), F.col("_rank").alias("place"), F.col("_total").alias("total"), F.col("subroot").alias("node"), "of"))
    top = paths(sources, height).select("place", F.col("path").alias("rest"), F.col("root").alias("top"))
    top = sources.join(top, "place").select(F.col("of").alias("tree"), "rest", "top")
    outer = staged(outer.join(top, "tree").select("tree", "place", "total", F.concat("path", "rest").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root")))
    found = _exchanged(sharded, outer, buckets, height, ["doc_id"], proofs, True)
    source = F.when(F.col("tree") != "0", F.expr("substr(tree, 2)"))
    return found.select("doc_id", source.alias("source"), F.col("node").alias("leaf"), "subroot", "root", *(["path"] if proofs else []), "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
