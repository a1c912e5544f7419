"""Periodic runs of words: stretches that repeat a period four times and more."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import map_slices, text_key, whole
from dispatchlake.llm.grammar import Grammar

#: A run has this many periods and words at least.
TIMES, SHORTEST = 4, 6
#: Grid pairs that are extended at once; more go in several turns.
AT_ONCE = 1 << 19

Run = tuple[int, int, int]


def grid(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q with equal words at i and i + q, on the harmonic grid.

    A run of period q has four periods, so i goes over three of them: one of the
    places 0, 3q, 6q, … is among them. Over all q that is a harmonic sum of places.
    Small periods are taken one by one, large ones together by the number of the
    place, so the number of turns is of the order of the root of the length.
    """
    n = len(words)
    most = n // TIMES
    small = min(most, isqrt(n // 3) + 1)
    for q in range(1, small + 1):
        step = (TIMES - 1) * q
        one, other = words[: n - q : step], words[q::step]
        at = np.flatnonzero(one == other[: len(one)]) * step
        yield at, np.full(len(at), q)
    j = 0
    while (last := min(most, (n - 1) // (3 * j + 1))) > small:
        q = np.arange(small + 1, last + 1)
        q = q[words[3 * j * q] == words[(3 * j + 1) * q]]
        yield 3 * j * q, q
        j += 1


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct columns of ``rows``, in order of the first row, then the second and so on."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.concatenate([[True], np.any(rows[:, 1:] != rows[:, :-1], axis=0)])] if rows.size else rows


def runs_of(sequences: list[np.ndarray]) -> list[list[Run]]:
    """The runs (start, length, period) of every sequence of numbers, by start, then period.

    Pairs of the grid are extended both ways by the grammar of all sequences. A
    stretch that repeats 2q words has the period q only through its smallest one,
    whose own pair leads to the same stretch, so of the periods found for a stretch
    the least is kept.
    """
    grammar = Grammar(sequences)
    found: list[np.ndarray] = []

    def extend(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        owner = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        q = np.concatenate([p[2] for p in parts])
        at = np.concatenate([p[1] for p in parts]) + grammar.offsets[owner]
        start = at - grammar.backward(at - 1, at - 1 + q)
        length = at + q + grammar.forward(at, at + q) - start
        kept = length >= np.maximum(SHORTEST, TIMES * q)
        rows = np.stack([owner, start - grammar.offsets[owner], length, q])[:, kept]
        found.append(_distinct(rows))

    waiting, held = [], 0
    for owner, words in enumerate(sequences):
        if len(words) < SHORTEST:
            continue
        for at, q in grid(words):
            if len(at):
                waiting.append((owner, at, q))
                held += len(at)
            if held >= AT_ONCE:
                extend(waiting)
                waiting, held = [], 0
    if waiting:
        extend(waiting)
    runs: list[list[Run]] = [[] for _ in sequences]
    rows = _distinct(np.concatenate(found, axis=1)) if found else np.zeros((4, 0), np.int64)
    if rows.size:
        least = np.concatenate([[True], np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)])
        for owner, *run in rows[:, least].T.tolist():
            runs[owner].append(tuple(run))
        for mine in runs:
            mine.sort(key=lambda r: (r[0], r[2]))
    return runs


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length over period; of equal ones the first, then the one of the smaller period."""
    best = None
    for run in runs:  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats, which is all of it after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: ``n_words``, its ``runs``, the ``strongest`` of them, and the text ``collapsed``.

    Words are what white space parts. A run is a stretch of words with smallest
    period q and at least max(6, 4q) words that no neighbouring word extends.
    ``collapsed`` leaves out what a run repeats after its first period; the words
    kept are joined by one space. ``edit`` may change the words of a document (by
    its id) before. Texts are worked on whole, in the task that reads them: the
    grammar of a slice of documents takes memory in proportion to its words.

    Defined results: a null or empty text, or one of fewer than six words, has no
    run; ``strongest`` is then null; repeated rows are each answered; null ids pass
    through; other columns are not read; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), whole(text_col).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text.split() for text in batch.column("text").to_pylist()]
        if edit is not None:
            texts = [edit(doc, words) for doc, words in zip(batch.column("doc_id").to_pylist(), texts)]
        numbers: dict[bytes, int] = {}
        sequences = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in texts]
        runs = runs_of(sequences)
        flat = np.array([run for mine in runs for run in mine], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run_type))
        offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        best = [mine and dict(zip(("start", "length", "period"), strongest(mine))) or None for mine in runs]
        collapsed = [b" ".join(kept_words(words, mine) if mine else words) for words, mine in zip(texts, runs)]
        columns = [
            pa.array([len(words) for words in texts], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), structs),
            pa.array(best, run_type),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "text_key", "n_words", "runs", "strongest", "collapsed"])

    run = "struct<start:long,length:long,period:long>"
    return map_slices(source, f"doc_id {kind}, text_key long, n_words long, runs array<{run}>, strongest {run}, collapsed string", work)
