"""Token ids of whole texts, word by word from a bounded memory of words."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from dispatchlake.llm.common import by_size

#: Words remembered in one Python worker. More are forgotten and encoded again.
REMEMBERED = 500_000

#: New words that the tokenizer gets as one text.
TOGETHER = 50

_TOUCHING = re.compile(r"\s | \s")
_RUN = re.compile(r"\s\s")
#: A full stop or comma that no letter or digit precedes.
_APART = re.compile(r"(?<![^\W_])[.,][ \n]")
#: Marks a cut while a text with significant spaces is split.
_CUT = "\0"
#: A full stop or comma after another sign, or after the letter whose small form ends in one: both may be one token.
_SIGNS = re.compile(r"(?<![^\W_İ])(?<! )[.,] ")


class WordIds:
    """Ids of a text as bytes, little-endian 32-bit, equal to those of the tokenizer over the whole text.

    ``spaced``: the tokenizer keeps white space, and a space begins the word that
    follows. A text is then cut before each space and around a line end alone; where
    a space touches other white space, the tokenizer gets the whole text. Else the
    tokenizer drops case and white space, and the text is cut there. Both kinds part
    letters from signs, so there are cuts too. No token crosses a cut. The strings
    of added tokens (end of text and the like) have their ids, as in the library.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {token.content: np.array([i], "<u4").tobytes() for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.around = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")")
        # Texts are cut at these strings. What a change of case makes of other strings is ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self.known: dict[str, bytes] = {"": b""}
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.marked = np.array([name.startswith("Ġ") if spaced else name.endswith("</w>") for name in names])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Those of letters only are one text, in which their ids can be told apart by the mark of a word."""
        plain = [w for w in words if (w[1:] if self.spaced else w).isalpha() and (not self.spaced or w[0] == " ")]
        other = set(words).difference(plain)
        for first in range(0, len(plain), TOGETHER):
            group = plain[first : first + TOGETHER]
            data = self._encode([("" if self.spaced else " ").join(group)])[0]
            marks = np.flatnonzero(self.marked[np.frombuffer(data, "<u4")])
            edges = [*marks.tolist(), len(data) // 4] if self.spaced else [0, *(marks + 1).tolist()]
            if len(edges) == len(group) + 1 and edges[0] == 0 and edges[-1] == len(data) // 4:
                self.known.update((w, data[4 * a : 4 * b]) for w, a, b in zip(group, edges, edges[1:]))
            else:
                other.update(group)
        rest = list(other)
        self.known.update(zip(rest, self._encode(rest)))

    def _words(self, text: str, run: bool) -> list[str]:
        if self.spaced:
            if not _APART.search(text):
                for sign in (". ", ", ", ".\n", ",\n"):
                    text = text.replace(sign, _CUT + sign)
            if not run:
                text = text.replace("\n", f"{_CUT}\n{_CUT}")
            return text.replace(" ", f"{_CUT} ").split(_CUT)
        text = text.encode().lower().decode().replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if not _SIGNS.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def ids(self, text: str) -> bytes:
        if any(map(text.__contains__, self.added)):
            return b"".join(self.added[part] if part in self.added else self._between(part) for part in self.around.split(text))
        return self._between(text)

    def _between(self, text: str) -> bytes:
        run = self.spaced and bool(_RUN.search(text))
        if self.spaced and (run and _TOUCHING.search(text) or _CUT in text):
            return self._encode([text])[0]
        words = self._words(text, run)
        new = set(words).difference(self.known)
        if new:
            if len(self.known) > REMEMBERED:
                self.known = {"": b""}
                new = set(words) - {""}
            self._learn(list(new))
        return b"".join(map(self.known.__getitem__, words))


_encoders: dict[tuple[str, bool], WordIds] = {}


def encoder(path: str, spaced: bool) -> WordIds:
    """One per tokenizer in each Python worker."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = WordIds(path, spaced)
    return _encoders[path, spaced]


def encoded(batches: Iterator[pa.RecordBatch], path: str, spaced: bool, end_id: int) -> Iterator[tuple[object, bytes]]:
    """``doc_id`` and ids with ``end_id`` of the rows of batches with a column ``text``."""
    words, end = encoder(path, spaced), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for part in by_size(batch, "text"):
            for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                yield name, words.ids(text) + end
