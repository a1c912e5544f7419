"""Packing of token ids into near-equal windows by multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import whole
from dispatchlake.llm.tokens import encoded

#: Windows that are balanced against each other at once. It bounds what a task holds.
TOGETHER = 256
#: No item that is balanced is longer than this part of a window. Small items balance well, so the count of windows hardly has to rise.
PARTS = 4


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The numbers of ``sizes`` dealt into ``windows`` lists of near-equal sums, by Karmarkar and Karp.

    Each size begins as a partition with one filled window. The two partitions
    of the widest spread merge, the fullest windows of one onto the emptiest of
    the other, until one is left. Empty windows are not kept.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    born = len(sizes)
    while len(heap) > 1:
        one, other = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = windows - len(other)  # so many of the emptiest places of the other are empty
        both = len(one) - free
        if both > 0:
            low = other[len(other) - both :][::-1]
            merged = one[:free] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(one[free:], low)] + other[: len(other) - both]
        else:
            merged = one + other
        merged.sort(key=lambda window: -window[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], born, merged))
        born += 1
    found = []
    for _, tree in heap[0][2] if heap else []:
        members, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                members.append(node)
        found.append(sorted(members))
    return found


def windows_of(sizes: list[int], capacity: int, parts: int = PARTS) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (number, start, length) that hold all of ``sizes``, none over ``capacity``.

    Sizes over a ``parts``-th of the capacity are cut into items of that length
    and a rest. The count of windows starts at the least that can hold all, and
    rises by one as long as differencing leaves a window over capacity.
    Neighbouring items of one size that meet in a window are one piece.
    """
    longest = max(1, capacity // parts)
    items = [(i, start, min(longest, size - start)) for i, size in enumerate(sizes) for start in range(0, size, longest)]
    lengths = [length for _, _, length in items]
    count = -(-sum(lengths) // capacity)
    dealt = difference(lengths, count)
    while any(sum(lengths[k] for k in window) > capacity for window in dealt):
        count += 1
        dealt = difference(lengths, count)
    windows = []
    for window in dealt:
        pieces: list[tuple[int, int, int]] = []
        for i, start, length in (items[k] for k in window):
            if pieces and pieces[-1][0] == i and pieces[-1][1] + pieces[-1][2] == start:
                pieces[-1] = (i, pieces[-1][1], pieces[-1][2] + length)
            else:
                pieces.append((i, start, length))
        windows.append(pieces)
    return windows


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """Pieces of the token ids of all documents, in sequences of at most ``capacity``.

    One row per piece: ``doc_id``, ``start`` (ids of the document before it),
    ``length``, ``ids`` (binary: little-endian, 32 bits each), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence. Every id with the end id of
    its document lies in exactly one piece; offsets of a sequence have no gaps.
    Whole windows of a long document are sequences of their own; what remains of
    the documents is cut into items of at most a quarter of a window, and these
    are balanced, about ``together`` windows at a time.

    Nothing is shuffled: a task packs the rows of its partition, and only the
    last windows of a partition are less than full. Sequence ids are the
    partition's number and a running one, so a task that is run again after a
    lost executor gives the same rows.

    Defined results: a null or empty text is its end id alone; repeated rows and
    rows with a null id are packed each; other columns are not read; an empty
    table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held: list[tuple] = []
        total = 0

        def flush() -> None:
            nonlocal held, total, sequence
            for window in windows_of([len(ids) // 4 for _, _, ids, _ in held], capacity):
                offset = 0
                for i, first, length in window:
                    name, start, ids, tokens = held[i]
                    rows.append((name, start + first, length, ids[4 * first : 4 * (first + length)], tokens, sequence, offset))
                    offset += length
                sequence += 1
            held, total = [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 7
            rows.clear()
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(columns[0], kind_type)] + [pa.array(c, t) for c, t in zip(columns[1:], types)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        kind_type = None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind_type
            for batch in batches:
                kind_type = batch.schema.field("doc_id").type
                yield batch

        for name, ids in encoded(watched(), tokenizer, spaced, end_id):
            tokens = len(ids) // 4
            whole_windows = tokens // capacity
            for w in range(whole_windows):
                rows.append((name, w * capacity, capacity, ids[4 * w * capacity : 4 * (w + 1) * capacity], tokens, sequence, 0))
                sequence += 1
            rest = tokens - whole_windows * capacity
            if rest:
                held.append((name, tokens - rest, ids[4 * (tokens - rest) :], tokens))
                total += rest
                if total >= together * capacity:
                    flush()
            if len(rows) >= 2000:
                yield out()
        if held:
            flush()
        if rows:
            yield out()

    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
