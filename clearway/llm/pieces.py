"""SentencePiece encoding and decoding by a forward pass over a trie of distinct words.

A text becomes marked words: every space is a mark, and each run of marks starts a word. Equal words have equal ids, so the distinct words of
a batch are sorted, which makes neighbours share prefixes, and walked depth-first through the trie they form: the forward states of
a common prefix are computed once and kept on a stack.

The state of a position is the best way to reach it. In a unigram model that is the path with the highest sum of scores. In a
byte-pair model the sum does not decide; there a piece may follow another only if encoding both together
keeps them apart. Exactly one path meets that everywhere and it is the model's own encoding, so the same pass looks for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import id_and_text, per_process

MARK = "▁"
# A word: a run of marks and what follows it. No piece has a mark after another character (checked on loading).
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# Pairs of pieces whose fit a worker remembers, and states of the piece automaton; when full, the memory starts anew.
REMEMBERED_PAIRS = 300_000
STATES = 300_000
# Bytes of the words that a worker remembers in each of two generations, with what Python needs for each; longer words are not remembered.
REMEMBERED_BYTES = 80_000_000
WORD_OVERHEAD = 160
LONG_WORD = 64
# Texts whose words are encoded together: more share more prefixes but need more memory.
ROWS = 1024
NO_PIECE = -1


class State:
    """The longest end of what was read that begins a piece, and the pieces that end here, the longest first.

    A character that is no piece stands for itself; so something ends at every place.
    """

    __slots__ = ("text", "ending", "after")

    def __init__(self, text: str, ending: tuple[tuple[int, int | str], ...]):
        self.text, self.ending, self.after = text, ending, {}


class Automaton:
    """States made as they are met. Reading a character leads from a state to the next, so no substring is looked up twice."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        self.begins = {p[:k] for p in ids for k in range(1, len(p) + 1)}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[str, str], State] = {}
        self.root = State("", ())

    def step(self, state: State, char: str) -> State:
        """The state after ``char``; remembered in ``state.after``."""
        text = state.text + char
        while text and text not in self.begins:
            text = text[1:]
        found = self.states.get((text, char))
        if found is None:
            ending = tuple((len(text) - k, self.ids[text[k:]]) for k in range(len(text)) if text[k:] in self.ids)
            if char not in self.ids:
                ending += ((1, char),)
            found = self.states[text, char] = State(text, ending)
        state.after[char] = found
        return found


class PieceModel:
    """The pieces and scores of a SentencePiece model, without its library's encoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.is_byte = [model.is_byte(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in usual}
        self.scores = {i: model.get_score(i) for i in usual}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if self.is_byte[i]}
        self.unknown = model.unk_id()
        self.automaton = Automaton(self.ids)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece with an inner mark: words of this model cannot be encoded one by one")
        # Byte-pair models score a piece by its place in the order of merges.
        ordinary = [s for s in self.scores.values() if s > -1e8]
        self.merges = bool(ordinary) and all(float(s).is_integer() for s in ordinary)
        self.code = {i: self.code_of(i) for i in usual}
        self.worst = min(self.scores.values(), default=0.0) - 10.0
        self.fit: dict[tuple[int | str | None, int | str], bool] = {}

    def code_of(self, piece: int | str) -> bytes:
        """A piece's id, or those of the bytes of a character that no piece covers, as little-endian signed 32-bit numbers."""
        if not isinstance(piece, str):
            ids = [piece]
        else:
            ids = [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
        return np.array(ids, dtype="<i4").tobytes()

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(self.ids.get(parts[i] + parts[i + 1], NO_PIECE))
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int | str | None, right: int | str) -> bool:
        """Whether encoding both pieces together, or ``right`` alone at the start, keeps them as they are."""
        known = self.fit.get((left, right))
        if known is None:
            if len(self.fit) >= REMEMBERED_PAIRS:
                self.fit.clear()
            if left is None:
                known = isinstance(right, str) or self.merged(self.pieces[right]) == [self.pieces[right]]
            else:
                a, b = (p if isinstance(p, str) else self.pieces[p] for p in (left, right))
                known = self.merged(a + b) == [a, b]
            self.fit[left, right] = known
        return known


class TrieWalk:
    """Forward states along the current path of the trie; a word only extends them past what it shares with the one before."""

    def __init__(self, model: PieceModel):
        self.model = model
        if len(model.automaton.states) >= STATES:
            model.automaton.clear()
        self.word = ""
        # Per position: the automaton's state, the piece that ends there (an id, or an uncovered character), where it starts, the best path's score.
        self.states = [model.automaton.root]
        self.last: list[int | str | None] = [None]
        self.start: list[int] = [0]
        self.total: list[float] = [0.0]

    def encode(self, word: str) -> bytes:
        """Little-endian signed 32-bit ids."""
        shared = len(commonprefix((self.word, word)))
        self.word = word
        last, start, states, model = self.last, self.start, self.states, self.model
        del last[shared + 1:], start[shared + 1:], self.total[shared + 1:], states[shared + 1:]
        fit, code, step = model.fit, model.code, model.automaton.step
        state = states[-1]
        for end in range(shared + 1, len(word) + 1):
            char = word[end - 1]
            state = state.after.get(char) or step(state, char)
            if model.merges:
                for length, piece in state.ending:
                    at = end - length
                    fits = fit.get((last[at], piece))
                    if fits or (fits is None and model.fits(last[at], piece)):
                        break
                else:
                    return self.merged_word(word)
            else:
                total, at = max((self.total[end - n] + (model.worst if isinstance(p, str) else model.scores[p]), end - n) for n, p in state.ending)
                piece = next(p for n, p in state.ending if end - n == at)
                self.total.append(total)
            states.append(state)
            last.append(piece)
            start.append(at)
        # The ids are read once, back from the end: a copy per position would take memory with the square of the word's length.
        parts, end = [], len(word)
        while end:
            piece = last[end]
            parts.append(code[piece] if piece in code else model.code_of(piece))
            end = start[end]
        parts.reverse()
        return b"".join(parts)

    def merged_word(self, word: str) -> bytes:
        """The ids of a word for which the walk finds no path: by merging the whole word; the walk starts anew after it."""
        self.word = ""
        del self.last[1:], self.start[1:], self.total[1:], self.states[1:]
        return b"".join(self.model.code_of(self.model.ids.get(p, p)) for p in self.model.merged(word))


class Remembered:
    """Ids of words, in two generations: when the younger is full the older is forgotten, and what is still in use moves up."""

    def __init__(self, limit: int = REMEMBERED_BYTES):
        self.limit, self.young, self.old, self.size = limit, {}, {}, 0

    def get(self, word: str) -> bytes | None:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is not None:
                self.put(word, ids)
        return ids

    def put(self, word: str, ids: bytes) -> None:
        if len(word) > LONG_WORD:
            return
        if self.size >= self.limit:
            self.young, self.old, self.size = {}, self.young, 0
        self.young[word] = ids
        self.size += len(word) + len(ids) + WORD_OVERHEAD


class Encoder:
    """Ids of whole texts, batch by batch; words met before are looked up."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.known = Remembered()
        self.spelled = [
            bytes([int(p[3:5], 16)]) if is_byte else p.replace(MARK, " ").encode() if p in self.model.ids else b""
            for p, is_byte in zip(self.model.pieces, self.model.is_byte)
        ]
        self.spelled[self.model.unknown] = " \u2047 ".encode()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian signed 32-bit ids of each text; an empty text has none."""
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        ids: dict[str, bytes] = {}
        fresh = []
        for word in set(chain.from_iterable(split)):
            known = self.known.get(word)
            if known is None:
                fresh.append(word)
            else:
                ids[word] = known
        walk = TrieWalk(self.model)
        for word in sorted(fresh):
            ids[word] = walk.encode(word)
            self.known.put(word, ids[word])
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids in range: marks are spaces but for the first, bytes that are no UTF-8 are replacement characters."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _encoder(path: str) -> Encoder:
    return per_process(("piece encoder", path), lambda: Encoder(path))


def _encoding(vocabulary: str):
    """Batches of (id, text) to batches of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                encoded = encoder.encode(part.column(1).to_pylist())
                ends = [0]
                for ids in encoded:
                    ends.append(ends[-1] + len(ids) // 4)
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(encoded))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "ids"])

    return run


def _decoding(vocabulary: str):
    """Batches of (id, ids) to batches of (doc_id, ids, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        size = len(encoder.spelled)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column(1)
                bounds = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
                flat = lists.flatten().fill_null(-1).to_numpy()
                odd = (flat < 0) | (flat >= size)
                texts = [
                    encoder.decode((ids[~odd[start:end]] if odd[start:end].any() else ids).tolist())
                    for start, end in zip(bounds[:-1], bounds[1:]) for ids in (flat[start:end],)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have no ids. ``vocabulary`` is a .model file on every executor."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_encoding(vocabulary), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the text they spell, of every row; null ids count as none, null elements and ids out of range spell nothing."""
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoding(vocabulary), "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text that they spell: ``decode`` of ``encode``, one after the other in the same worker."""
    first, second = _encoding(vocabulary), _decoding(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return second(first(batches))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")
