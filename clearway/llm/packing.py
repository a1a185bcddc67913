"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become token ids plus an end id; longer ones are cut into full sequences and a rest. Pieces are dealt
at random into groups of a bounded size and every group is packed by best-two-fit: fill a sequence greedily with
the longest piece that fits, then replace its shortest piece by two unpacked pieces that fill the widened gap
more tightly. A group holds thousands of pieces, so what the split costs is below one sequence per group.

Token ids never leave the worker that made them: the shuffle moves one small row per piece.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import cut, id_and_text, per_process, record_batch

# Pieces packed together; bounds the memory and time of one task.
GROUP_PIECES = 8192
# Words and word parts whose ids a worker remembers; when full, those not asked for lately go.
REMEMBERED = 400_000

# Words of these characters are their own normal form apart from their case, and hold no white space.
_PLAIN = re.compile("[!-~¡-ÿ]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
# Fixed value: the word pattern of the tokenizer file.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same pattern for lower-case texts of such words, with the letters, numbers and spaces that they can have. Only parts that begin
# with an apostrophe can begin alike, and those keep their order.
_SPACES, _LETTERS, _NUMBERS = " \t\n\r\x0b\x0c", "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_PLAIN_TEXT = re.compile(f"[!-~¡-ÿ{_SPACES}]*")
_plain_parts = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+").findall


class Remembered(dict):
    """What ``learn`` gave for each short key. When half of ``REMEMBERED`` is full, it becomes the older half and the one before goes; keys asked for
    again come back, so frequent words are never learned anew.
    """

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.learn(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class WordEncoder:
    """Token ids of whole texts by a tokenizer whose tokens never span white space.

    Texts repeat their words, so ids are looked up. A text of plain characters alone is cut into the tokenizer's word parts, of which there are
    fewer than words with their cases and signs, and only unknown parts are sent to its model. Other texts are cut at white space: a new word of
    plain characters goes by its parts, any other is encoded by the tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts_of = regex.compile(_PARTS).findall
        self.words = Remembered(self._learn)
        self.parts = Remembered(self._learn_part)
        # How byte-level tokenizers write bytes as characters.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" not in text and _PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, _plain_parts(text.lower())))
        words = re.split("[ \t\n\r\x0b\x0c]+", text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))

    def _learn(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self.parts[p] for p in self.parts_of(word.lower())])
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _learn_part(self, part: str) -> bytes:
        # Printable ASCII is spelled as it is.
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(spelled)])


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("deal", pa.int64()),
])


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of at most ``size`` ids: doc_id, piece, start, length, ids_crc32 and a random ``deal``.

    Null and empty texts are the end id alone. Repeated rows and null ids are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("word encoder", vocabulary), lambda: WordEncoder(vocabulary))
        # Dealing must not follow keys, or copies of one document would meet in one group.
        task = TaskContext.get()
        rng = np.random.default_rng(task.partitionId() if task else 0)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for doc, text in zip(part["id"].to_pylist(), part["text"].to_pylist()):
                    ids = encoder.encode(text) + end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, size)):
                        piece = ids[4 * start: 4 * (start + size)]
                        rows.append((doc, k, start, len(piece) // 4, zlib.crc32(piece), int(rng.integers(1 << 62))))
                yield record_batch(rows, PIECES)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence number and the offset of every piece; all lengths are 1 .. ``size``.

    Lengths on hand are the bits of one integer, so the longest piece that fits, and two pieces of a wanted
    total, are found by shifts.
    """
    order = np.argsort(lengths, kind="stable")
    stock: list[list[int]] = [[] for _ in range(size + 1)]
    for i in order[::-1].tolist():
        stock[lengths[i]].append(i)
    on_hand = mirrored = 0
    for length in range(1, size + 1):
        if stock[length]:
            on_hand |= 1 << length
            mirrored |= 1 << (size - length)

    def take(length: int) -> int:
        nonlocal on_hand, mirrored
        item = stock[length].pop()
        if not stock[length]:
            on_hand ^= 1 << length
            mirrored ^= 1 << (size - length)
        return item

    def put_back(length: int, item: int) -> None:
        nonlocal on_hand, mirrored
        if not stock[length]:
            on_hand |= 1 << length
            mirrored |= 1 << (size - length)
        stock[length].append(item)

    def two_of(total: int) -> tuple[int, int] | None:
        """Two lengths on hand with this total, the longest first one."""
        firsts = on_hand & (mirrored >> (size - total))
        first = firsts.bit_length() - 1
        if first * 2 == total and len(stock[first]) < 2:
            return None  # every other pair has one part above the half, so none is left
        return (first, total - first) if first > 0 else None

    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    number = 0
    while on_hand:
        packed: list[tuple[int, int]] = []
        gap = size
        while gap and (longest := (on_hand & ((2 << gap) - 1)).bit_length() - 1) > 0:
            packed.append((longest, take(longest)))
            gap -= longest
        if gap and on_hand:
            shortest = packed[-1][0]
            for total in range(shortest + gap, shortest, -1):
                if pair := two_of(total):
                    chosen = [(p, take(p)) for p in pair]
                    put_back(*packed.pop())
                    packed += chosen
                    break
        at = 0
        for length, item in packed:
            sequence[item], offset[item] = number, at
            at += length
        number += 1
    return sequence, offset


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents; one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Sequences are gapless from offset 0 and never
    longer than ``size``; every id of every document is in exactly one of them. See ``token_pieces`` for odd rows.
    """
    # Cut, so that texts are tokenised once and the random dealing is data.
    pieces = cut(token_pieces(docs, vocabulary, id_col, text_col, size, end_id))
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("deal", kind="stable")
        sequence, offset = best_two_fit(rows["length"].to_numpy(), size)
        return rows[columns].assign(sequence_id=(key[0] << 32) + sequence, offset=offset)

    return (
        pieces.withColumn("pack", F.col("deal") % groups).groupBy("pack")
        .applyInPandas(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
