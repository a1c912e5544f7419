"""Packed id matrices: token ids in rows of one length, by best-fit-decreasing packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import whole
from dispatchlake.llm.tokens import encoded

#: Rows that are packed together at once. It bounds what a task holds.
TOGETHER = 512


class Rooms:
    """The rows that are open, by the room they have left, in a segment tree over all rooms."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open: list[list[int]] = [[] for _ in range(self.size)]
        self.some = bytearray(2 * self.size)

    def _mark(self, room: int) -> None:
        node = room + self.size
        self.some[node] = bool(self.open[room])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def add(self, room: int, row: int) -> None:
        self.open[room].append(row)
        if len(self.open[room]) == 1:
            self._mark(room)

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of a row with the least room that is enough, taken out."""
        node = need + self.size
        if not self.some[node]:
            while node > 1 and (node % 2 or not self.some[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.open[room].pop()
        if not self.open[room]:
            self._mark(room)
        return room, row


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """The numbers of ``sizes`` in rows, largest first, each into the row that it fills best."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[i])
        if found is None:
            found = (capacity, len(rows))
            rows.append([])
        rows[found[1]].append(i)
        rooms.add(found[0] - sizes[i], found[1])
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int, pad_id: int, capacity: int = 2048, spaced: bool = True, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """Rows of packed ids of all documents.

    Per row of a matrix: ``sequence_id``; ``ids`` (binary: ``capacity`` numbers,
    little-endian, 32 bits each, padded with ``pad_id``); ``n_tokens`` before the
    padding; ``cu_seqlens``, the cumulative lengths of its pieces from 0 to
    ``n_tokens``; ``position_resets``, where positions begin again at 0; and
    ``doc_ids`` and ``starts``, the document of each piece and the ids of it that
    come before. A document with its end id that is over ``capacity`` is cut into
    pieces; all its ids are there once.

    A task packs the rows of its partition, ``together`` rows of the matrix at a
    time; nothing is shuffled, and a task that is run again gives the same rows.

    Defined results: a null or empty text is its end id alone; repeated rows and
    rows with a null id are packed each; other columns are not read; an empty
    table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    padding = np.array([pad_id], "<u4").tobytes()
    names = ["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[object, int, bytes]] = []
        rows: list[tuple] = []
        total, id_type = 0, pa.null()

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("doc_id").type
                yield batch

        def emit(pieces: list[tuple[object, int, bytes]]) -> None:
            nonlocal sequence
            data = b"".join(p[2] for p in pieces)
            ends = np.cumsum([0, *(len(p[2]) // 4 for p in pieces)]).tolist()
            rows.append((sequence, data + padding * (capacity - ends[-1]), ends[-1], ends, ends[:-1], [p[0] for p in pieces], [p[1] for p in pieces]))
            sequence += 1

        def flush() -> None:
            nonlocal held, total
            for members in best_fit([len(p[2]) // 4 for p in held], capacity):
                emit([held[i] for i in members])
            held, total = [], 0

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64())]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows.clear()
            return made

        for name, ids in encoded(watched(), tokenizer, spaced, end_id):
            tokens = len(ids) // 4
            for start in range(0, tokens, capacity):
                piece = (name, start, ids[4 * start : 4 * (start + capacity)])
                if len(piece[2]) == 4 * capacity:
                    emit([piece])
                else:
                    held.append(piece)
                    total += tokens - start
            if total >= together * capacity:
                flush()
            if len(rows) >= 500:
                yield out()
        flush()
        if rows:
            yield out()

    return source.mapInArrow(run, f"sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, starts array<long>")


def write(packed: DataFrame, folder: str) -> None:
    """One Parquet file of matrix rows per task; ``ids`` of a row group read as one array is the matrix."""
    packed.write.option("compression", "zstd").parquet(folder)
