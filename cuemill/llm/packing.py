"""Packing tokenised documents into fixed windows by online sum-of-squares placement.

A document's tokens fill whole windows first; what is left over goes to the fill level that keeps
the sum of squared counts of partly filled windows smallest (Csirik et al., "On the sum-of-squares
algorithm for bin packing"). A level array holds, for each fill, how many open windows have it.
Each task packs its own rows, so no row is shuffled and no state leaves a task; windows are numbered
within the task's partition.

When a task ends, the emptiest open windows are cut up to fill the fullest; until then all that is left
over is placed by the sum of squares, and a task holds no more than the ids of what it read. What
remains at the end is one window, which becomes sequences of powers of two, so that
nothing is padded. Documents are cut only when they are longer than a window, or in that last step.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cuemill.llm.shared import take_over

WINDOW = 4096
END_ID = 2
#: Words and pieces whose ids a Python worker remembers, in about 125 MB; none longer than LONG_WORD. Half are those met
#: last: when they are full, they take the place of the other half, from which what is met again comes over.
CACHED_WORDS, CACHED_PIECES, LONG_WORD = 600_000, 200_000, 64

#: Python splits at these; the tokenizer does not count them as white space.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Python lowers these with an eye to their place, or to two characters; the tokenizer does it itself.
_OWN_LOWER = "\u03a3\u0130"

#: From here on Unicode versions may differ on what is a letter, so the tokenizer itself is asked.
_BEYOND_LATIN = "\u0250"
#: The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for 256 and up.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts as little-endian bytes.

    The tokenizer drops white space and cuts words into pieces that it encodes one by one, so the
    ids of a text are those of its words' pieces in turn. Words and pieces are remembered.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]
        self.pieces_of = regex.compile(split["pattern"]["Regex"]).findall
        self.normal, self.tokens = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.spelled_ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, normal: bool) -> bytes:
        ids = self.older_words.get(word)
        if ids is not None:
            self.words[word] = ids
            return ids
        if not word.isascii() and max(word) >= _BEYOND_LATIN:
            return self._keep(word, self._whole(word))
        # Letters, and letters before one other character, are cut as the tokenizer's pattern does it.
        if not normal:
            pieces = self.pieces_of(self.normal(word))
        elif word.isalpha():
            return self._keep(word, self._piece(word))
        elif word[:-1].isalpha() and not word[-1].isalpha():
            pieces = (word[:-1], word[-1])
        else:
            pieces = self.pieces_of(word)
        return self._keep(word, b"".join([self.pieces.get(piece) or self._piece(piece) for piece in pieces]))

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece) or self.older_pieces.get(piece)
        if ids is None:
            spelled = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
            of = self.spelled_ids
            ids = b"".join([of[t.id] for t in self.tokens(spelled)])
        if len(piece) <= LONG_WORD:
            self.pieces[piece] = ids
        return ids

    def _names_special(self, text: str) -> bool:
        """Whether the text may spell a special token, which is an id of its own wherever it stands."""
        lower = text.lower()
        return any(t in lower for t in self.special)

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONG_WORD:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _NOT_SPACE) or self._names_special(text):
            return self._whole(text)
        normal = not any(c in text for c in _OWN_LOWER) and unicodedata.is_normalized("NFC", text)
        if normal:
            text = text.lower()
        if len(self.words) > CACHED_WORDS // 2:
            self.words, self.older_words = {}, self.words
        if len(self.pieces) > CACHED_PIECES // 2:
            self.pieces, self.older_pieces = {}, self.pieces
        get, word = self.words.get, self._word
        return b"".join([get(w) or word(w, normal) for w in text.split()])


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget() -> None:
    _encoders.clear()


class Packer:
    """Windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.next = window, first_sequence
        self.count = np.zeros(window + 1, np.int64)  # the level array: open windows by fill
        self.open: dict[int, list[list]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, self.window * 4
        whole = total // self.window
        for k in range(whole):
            self.close([(doc, k * self.window, ids[k * step : (k + 1) * step], total)])
        if total % self.window:
            self.place((doc, whole * self.window, ids[whole * step :], total))

    def level(self, size: int) -> int:
        """The fill to place a piece at; 0 opens a window. Ties go to the fullest."""
        window, count = self.window, self.count
        last = window - size
        cost = 2 * count[size : window + 1]  # of the level that the window comes to: N + 1 squared less N squared
        cost[last] = -1  # a full window leaves the array
        cost[1:] -= 2 * count[1 : last + 1] - 1
        if last:
            cost[1:][count[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        at = self.level(size)
        if at:
            pieces = self.open[at].pop()
            self.count[at] -= 1
        else:
            pieces = []
        pieces.append(piece)
        self.settle(pieces, at + size)

    def settle(self, pieces: list, fill: int) -> None:
        if fill == self.window:
            self.close(pieces)
        elif fill:
            self.open.setdefault(fill, []).append(pieces)
            self.count[fill] += 1

    def merge(self) -> tuple[list, int]:
        """Fill the fullest open windows with cuts of the emptiest; what one window is left with."""
        found = [(fill, pieces) for fill in sorted(self.open) for pieces in self.open[fill]]
        self.open = {}
        self.count[:] = 0
        low = 0
        while found and low < len(found):
            fill, pieces = found.pop()
            gap = self.window - fill
            while gap and low < len(found):
                source = found[low][1]
                doc, start, ids, total = source.pop()
                taken = min(gap, len(ids) // 4)
                pieces.append((doc, start, ids[: taken * 4], total))
                gap -= taken
                if taken * 4 < len(ids):
                    source.append((doc, start + taken, ids[taken * 4 :], total))
                low += not source
                if source:
                    found[low] = (sum(len(x[2]) for x in source) // 4, source)
            if gap:
                return pieces, self.window - gap
            self.close(pieces)
        return [], 0

    def finish(self) -> None:
        pieces, fill = self.merge()
        pieces.reverse()
        while fill:
            room, cut = 1 << (fill.bit_length() - 1), []
            fill -= room
            while room:
                doc, start, ids, total = pieces.pop()
                taken = min(room, len(ids) // 4)
                cut.append((doc, start, ids[: taken * 4], total))
                room -= taken
                if taken * 4 < len(ids):
                    pieces.append((doc, start + taken, ids[taken * 4 :], total))
            self.close(cut)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence.

    Null and empty texts are documents of the end id alone; texts of any length are encoded whole. Rows are packed one by one: repeated
    rows and repeated or null identifiers are separate documents. An empty table gives no rows.
    Other columns are ignored, whatever their names. Every id lies in exactly one piece.
    """
    end = int(end_id).to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("packing", forget)
        encode = encoder(tokenizer_path).encode
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, encode(text.as_py() or "") + end)
                if len(packer.rows) >= 10_000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(task, SCHEMA)
