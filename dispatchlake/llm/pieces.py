"""SentencePiece encoding of merge-type models by backtracking, and decoding."""

from __future__ import annotations

import codecs
import heapq
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import map_slices, whole

SPACE = "▁"
#: Segments and token pairs remembered in one Python worker.
REMEMBERED = 300_000
#: Segments of more characters are not remembered.
LONGEST = 100


def _one_mark_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_mark_each", _one_mark_each)


class _Memory(dict):
    """Remembers ``make(key)``. Of what was not asked for since it was half full the rest goes when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.older = {}

    def __missing__(self, key):
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class PieceCoder:
    """Ids of a text and the text of ids, for a merge-type model without text normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(model.get_piece_size())
        self.end = model.eos_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = {}
        self.text: list[bytes] = []
        self.silent: set[int] = set()
        for i in numbers:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = bytes([int(piece[3:5], 16)])
                self.byte_id[value[0]] = i
            elif model.is_unknown(i):
                value = " ⁇ ".encode()
            elif model.is_control(i):
                self.silent.add(i)
                value = b""
            else:
                self.id[piece], self.score[piece] = i, model.get_score(i)
                value = piece.replace(SPACE, " ").encode()
            self.text.append(value)
        self.leading = {i for piece, i in self.id.items() if piece.startswith(SPACE)}
        # A match leads to the shorter ones that end where it does.
        self.pieces = ahocorasick.Automaton()
        suffixes: dict[str, tuple[str, ...]] = {"": ()}
        for piece in sorted(self.id, key=len):
            shorter = next((piece[i:] for i in range(1, len(piece)) if piece[i:] in self.id), "")
            suffixes[piece] = piece, *suffixes[shorter]
            self.pieces.add_word(piece, suffixes[piece])
        self.pieces.make_automaton()
        # No piece holds a space after another character. Where a character that
        # no piece has stands, nothing can join either. Segments lie between.
        known = set("".join(self.id))
        self.breaks = "\n" not in known and not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        # Where pieces of spaces all have the least score, spaces are merged after everything else.
        least = min(self.score.values(), default=0.0)
        self.spaces_last = self.breaks and all((set(p) == {SPACE}) == (s == least) for p, s in self.score.items()) and not any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.id)
        order = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in self.score.items() if len(p) > 1}
        self.known = _Memory(self.segment_ids)
        self.halves = _Memory(lambda piece: self.merged(piece)[1])
        self.compatible = _Memory(lambda pair: self.go_together(*pair))

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | tuple[()]]:
        """Pieces by merging, the pair of the best score first, the leftmost of equals; and, if one piece is left, the two it was made of."""
        parts: list[str | None] = list(text)
        ahead, back = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            piece = parts[i] + parts[j]
            if piece in self.score:
                heapq.heappush(queue, (-self.score[piece], i, j, piece))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        last: tuple[str, str] | tuple[()] = ()
        while queue:
            _, i, j, piece = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or ahead[i] != j or parts[i] + parts[j] != piece:
                continue
            last = parts[i], parts[j]
            parts[i], parts[j] = piece, None
            ahead[i] = ahead[j]
            if ahead[j] < len(parts):
                back[ahead[j]] = i
                offer(i, ahead[j])
            if back[i] >= 0:
                offer(back[i], i)
        left = [p for p in parts if p is not None]
        return left, last if len(left) == 1 else ()

    def go_together(self, one: str, other: str) -> bool:
        """Whether merging the joint text of two tokens gives them back; ``other`` may be empty.

        The merges of both are undone, the latest first. A merge over the border
        must at no time come before the one just undone: on the left side earlier
        means a better score, on the right side of equal scores the border's too.
        """
        rank, halves = self.rank, self.halves
        if len(one) > 1 and not halves[one]:
            return False
        if not other:
            return True
        limit = len(self.score)
        while True:
            over = rank.get(one + other, limit)
            if over < limit:
                return False
            left, right = rank.get(one, -1), rank.get(other, -1)
            if left > right:
                limit, one = left, halves[one][1]
            elif right >= 0:
                limit, other = right + 1, halves[other][0]
            else:
                return True

    def spaces(self, n: int) -> list[str]:
        """Pieces of n spaces, whose scores are equal: from the left, each joins what is before it where it can."""
        made: list[str] = []
        for _ in range(n):
            made.append(SPACE)
            while len(made) > 1 and made[-2] + made[-1] in self.id:
                made[-2:] = [made[-2] + made[-1]]
        return made

    def tokens(self, segment: str) -> list[str]:
        """Pieces by backtracking: back from the end, the longest match that goes with the token behind it.

        Two neighbours go together when merging their joint text gives them
        back; a sequence of such neighbours is what merging gives for the whole.
        There is one such sequence from a place on, so a place to which no token
        led back is never entered again. Runs of spaces are merged by their own rule.
        """
        if segment.startswith(SPACE * 2):
            if not self.spaces_last:
                return self.merged(segment)[0]
            alone = len(segment) - len(segment.lstrip(SPACE)) - 1
            rest = self.tokens(segment[alone:])
            return self.spaces(alone + 1) + rest[1:] if rest[0] == SPACE else self.spaces(alone) + rest
        at = len(segment)
        # Of the matches with one end the longest comes first.
        longest: dict[int, tuple[str, ...]] = {}
        if at <= LONGEST:
            longest = dict(reversed(list(self.pieces.iter(segment))))
        else:
            for last, match in self.pieces.iter(segment):
                longest.setdefault(last, match)
        failed = bytearray(at // 8 + 1)
        found = [""]
        open_choices = [iter(longest.get(at - 1) or (segment[at - 1 : at],))]
        compatible = self.compatible
        while at:
            behind = found[-1]
            for token in open_choices[-1]:
                start = at - len(token)
                if not failed[start >> 3] >> (start & 7) & 1 and compatible[token, behind]:
                    found.append(token)
                    at = start
                    open_choices.append(iter(longest.get(at - 1) or (segment[at - 1 : at],)))
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                open_choices.pop()
                at += len(found.pop())
        return found[:0:-1]

    def segment_ids(self, segment: str) -> bytes:
        """Ids of the pieces of a segment, as little-endian 32-bit numbers."""
        ids = self.piece_ids(self.tokens(segment))
        return struct.pack(f"<{len(ids)}i", *ids)

    def piece_ids(self, tokens: list[str]) -> list[int]:
        """Ids of pieces; a character that is none becomes its bytes."""
        return [i for t in tokens for i in ([self.id[t]] if t in self.id else [self.byte_id[b] for b in t.encode()])]

    def encode(self, text: str) -> bytes:
        """Ids with the end id, as little-endian 32-bit numbers."""
        end = np.array([self.end], "<i4").tobytes()
        if not text:
            return end
        spaced = SPACE + text.replace(" ", SPACE)
        segments = self.segments.findall(spaced) if self.breaks else [spaced]
        return b"".join([self.known[s] if len(s) <= LONGEST else self.segment_ids(s) for s in segments]) + end

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The space before the text is dropped; each broken byte becomes a replacement mark."""
        if self.silent.isdisjoint(ids[:-1]):
            text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "one_mark_each")
        else:  # bytes on either side of a control piece don't join
            text, run = "", b""
            for i in ids:
                run += self.text[i]
                if i in self.silent:
                    text, run = text + run.decode("utf-8", "one_mark_each"), b""
            text += run.decode("utf-8", "one_mark_each")
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first in self.leading else text


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``ids`` (with the end id) and ``decoded``, the text of the ids.

    A text is cut into segments that no token crosses; a worker remembers the
    ids of the segments it has met, within a bound.

    Defined results: a null or empty text is the end id alone and decodes to the
    empty text; repeated rows have a row each; other columns are not read; an
    empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = coder(model)
        found = [pieces.encode(text) for text in batch.column("text").to_pylist()]
        flat = np.frombuffer(b"".join(found), "<i4")
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
        decoded = [pieces.decode(flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_slices(source, f"doc_id {kind}, ids array<int>, decoded string", work)
