"""Merkle manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    """The root, and of each node the (left, right) siblings up to it."""
    place, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(place):
            start = p - p % 3
            proofs[i].append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + 3])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        place = [p // 3 for p in place]
    return nodes[0], proofs


def plain_manifest(rows, altered):
    sources = {}
    for row in rows:
        sources.setdefault((row[1] is not None, (row[1] or "").encode()), []).append(row)
    names, built = sorted(sources), {}
    for name in names:
        mine = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[name] = mine, *tree_of([leaf_of(r) for r in mine])
    root, over = tree_of([built[name][1] for name in names])
    out = []
    for name, above in zip(names, over):
        mine, subroot, proofs = built[name]
        for row, proof in zip(mine, proofs):
            path = proof + above
            node = leaf_of(altered(row))
            for left, right in path:
                node = h(left, node, right)
            out.append((row[0], row[1], leaf_of(row), subroot, root, [x for step in path for x in step], h(*(left + right for left, right in path)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(spark, height):
    rng = random.Random(height)
    rows = []
    for source, n in (("hot", 130), ("", 4), (None, 10), ("ß", 27), ("z", 1), ("a\nb", 9), ("many", 82)):
        rows += [(i, source, rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "plain", "two\nlines é", "x" * 10_000 + "\n"])) for i in rng.sample(range(1000), n)]
    rows += [(f + 2000, f"s{f}", "en", 1, "t\n") for f in range(20)]
    rows += [rows[0], rows[0], (rows[1][0], "hot", "de", 5, "other"), (None, "hot", "en", 1, "no\nid"), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, place int, root string").repartition(5)
    claims = {"text": F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    got = merkle.manifest(docs, claims=claims, height=height).collect()
    got = sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, r.path, r.proof_sha256, r.folded_root, r.verified) for r in got), key=repr)
    cut = lambda r: (*r[:4], r[4] and r[4].replace("\n", "") if r[0] is not None and r[0] % 2 == 0 else r[4])
    want = plain_manifest(rows, cut)
    assert got == want
    assert {True, False} == {r[-1] for r in got}


def test_small_tables(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    one = spark.createDataFrame([(7, "s", "en", 1, "x")], kind)
    (row,) = merkle.manifest(one).collect()
    leaf = leaf_of((7, "s", "en", 1, "x"))
    assert (row.leaf, row.subroot, row.root, row.path, row.proof_sha256, row.verified) == (leaf, leaf, leaf, [], h(), True)
    assert merkle.manifest(one.where("false")).count() == 0
    assert "path" not in merkle.manifest(one, proofs=False).columns
