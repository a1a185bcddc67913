"""Probability of texts under a bigram model by deleted interpolation.

p(w | v) = a * count(v w) / count(v) + b * count(w) / N + c / (V + 1), where the weights a, b, c depend on how often the context v occurs, in
powers of two. They are learned by expectation-maximisation on a part of the training texts that is deleted from the counts for that.

Texts are cut into batches of words, written once. A batch asks for the corpus counts of its distinct words and pairs: its keys go to the part of
the key space they belong to, where all batches' counts of a key are summed, and the sums come back to the batch. A key is sent once
per batch however often it occurs, so a frequent word is no hot key, and the number of parts follows the number of words.

Words and pairs are told apart by 64-bit hashes: two of 10^9 different ones share a hash with a probability of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from clearway.llm.common import cut, spark_schema
from clearway.llm.simhash import words_of
from clearway.session import new_shared_path

# Bytes of text in a batch; a longer text is a batch of its own.
BATCH_BYTES = 1 << 22
# Words whose keys meet in one part of the key space, on average.
PART_WORDS = 1 << 21
# The add-so-many of the base score.
BASE_COUNT = 0.1
# No word has a blank, so this stands for the end of a text, and for the context of its first word.
END = b" "
# What a batch's texts are for: only scored, counted, or counted and deleted while the weights are learned.
SCORED, COUNTED, DELETED = 0, 1, 2
BUCKETS = 64
STEPS = 25
# Learning ends once a step raises the mean log-likelihood of a word by less.
LEAST_GAIN = 1e-5
# Each weight starts from one word that it would explain.
PRIOR = 1.0

LONG, INT = pa.int64(), pa.int32()
TEXTS = pa.schema([
    ("batch", LONG), ("kind", INT), ("ids", pa.list_(LONG)), ("sizes", pa.list_(INT)), ("n_words", LONG), ("words", pa.binary()), ("hashes", pa.binary())])
REQUESTS = pa.schema([("part", INT), ("batch", LONG), ("kind", INT), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("batch", LONG), ("part", INT), ("counts", pa.binary()), ("vocabulary", LONG)])
EVENTS = pa.schema([("bucket", pa.list_(pa.int8())), ("pair", pa.list_(pa.float32())), ("single", pa.list_(pa.float32())), ("times", pa.list_(INT))])
SCORES = pa.schema([
    ("doc_id", LONG), ("n_tokens", LONG), ("n_known", LONG), ("train_tokens", LONG), ("base_score", pa.float64()), ("score", pa.float64())])


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of one size, byte by byte from the lowest, compressed."""
    size = numbers.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, size).T).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


class Batch:
    """Word numbers of some texts, each closed by an end, which has number 0."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {END: 0}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        words, number = words_of(text), self.number
        coded = np.zeros(len(words) + 1, dtype=np.uint32)
        coded[:-1] = [number.setdefault(w, len(number)) for w in words]
        self.ids.append(doc_id)
        self.sizes.append(len(coded))
        self.parts.append(coded)
        self.bytes += len(text) + 1

    def row(self, batch: int, kind: int) -> dict:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.number], dtype=np.uint64)
        words = np.concatenate(self.parts)
        return {"batch": batch, "kind": kind, "ids": self.ids, "sizes": self.sizes, "n_words": len(words), "words": pack(words), "hashes": hashes.tobytes()}


def batches_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of TEXTS from rows of (id, text, kind)."""
    filling = {kind: Batch() for kind in (SCORED, COUNTED, DELETED)}
    made = TaskContext.get().partitionId() << 32

    def full(kind: int) -> pa.RecordBatch:
        nonlocal made
        made += 1
        row = filling[kind].row(made, kind)
        filling[kind] = Batch()
        return pa.RecordBatch.from_pylist([row], TEXTS)

    for some in rows:
        for at in range(0, some.num_rows, 256):
            part = some.slice(at, 256)
            for doc_id, text, kind in zip(part["id"].to_pylist(), part["text"].to_pylist(), part["kind"].to_pylist()):
                if filling[kind].ids and filling[kind].bytes + len(text) > BATCH_BYTES:
                    yield full(kind)
                filling[kind].add(doc_id, text)
    for kind in filling:
        if filling[kind].ids:
            yield full(kind)


@dataclass(frozen=True)
class Keys:
    """Distinct words and pairs of a batch, by key: keys, how often each occurs, and the places of words and pairs in that order."""

    keys: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair: np.ndarray
    word_at: np.ndarray
    pair_at: np.ndarray

    @staticmethod
    def of(words: np.ndarray, hashes: np.ndarray) -> Keys:
        words = words.astype(np.int64)
        # The end before the first text is the context of its first word, as the end of each text is that of the next one's.
        codes = np.concatenate([[0], words[:-1]]) * len(hashes) + words
        distinct, pair, pair_counts = np.unique(codes, return_inverse=True, return_counts=True)
        left, right = np.divmod(distinct, len(hashes))
        mixed = hashes[left] * np.uint64(0x9E3779B97F4A7C15) + hashes[right]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        one = np.uint64(1)
        keys = np.concatenate([hashes & ~one, mixed | one])
        counts = np.concatenate([np.bincount(words, minlength=len(hashes)), pair_counts])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        return Keys(keys[order], counts[order], words, left, right, pair, place[: len(hashes)], place[len(hashes):])


def cuts_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each part of the key space, by its first ``bits`` bits, begins and ends in sorted keys."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def requests_of(bits: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for row in some.to_pylist():
                asked = Keys.of(unpack(row["words"], "<u4"), np.frombuffer(row["hashes"], dtype=np.uint64))
                cuts = cuts_of(asked.keys, bits)
                counts = asked.counts.astype(np.uint32)
                yield pa.RecordBatch.from_pylist([
                    {"part": p, "batch": row["batch"], "kind": row["kind"], "keys": pack(asked.keys[i:j]), "counts": pack(counts[i:j])}
                    for p, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if i < j], REQUESTS)

    return run


def count_part(table: pa.Table) -> pa.Table:
    """Sums of one part of the key space, sent back to each batch in the order of its keys: all training texts, then the deleted ones."""
    rows = table.to_pylist()
    keys = [unpack(r["keys"], "<u8") for r in rows]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    counted, deleted = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    for r, here in zip(rows, np.split(which, ends)):
        if r["kind"] != SCORED:
            times = unpack(r["counts"], "<u4")
            # Keys of one batch are distinct but for equal hashes.
            np.add.at(counted, here, times)
            if r["kind"] == DELETED:
                np.add.at(deleted, here, times)
    answers = [
        {"batch": r["batch"], "part": r["part"], "counts": pack(np.concatenate([counted[here], deleted[here]])), "vocabulary": None}
        for r, here in zip(rows, np.split(which, ends))
    ]
    words = int(((distinct & np.uint64(1) == 0) & (counted > 0)).sum())
    answers.append({"batch": None, "part": rows[0]["part"], "counts": b"", "vocabulary": words})
    return pa.Table.from_pylist(answers, ANSWERS)


@dataclass(frozen=True)
class Corpus:
    """Tokens of the training texts, of the deleted ones among them, and distinct training tokens."""

    tokens: int
    deleted: int
    vocabulary: int


@dataclass(frozen=True)
class Answered:
    """A batch with the corpus counts of its words and distinct pairs; ``deleted`` of them fall to deleted texts."""

    row: dict
    keys: Keys
    words: np.ndarray
    words_deleted: np.ndarray
    pairs: np.ndarray
    pairs_deleted: np.ndarray

    @staticmethod
    def of(texts: pa.Table, answers: pa.Table) -> Answered:
        row = texts.to_pylist()[0]
        keys = Keys.of(unpack(row["words"], "<u4"), np.frombuffer(row["hashes"], dtype=np.uint64))
        counted, deleted = [], []
        for answer in sorted(answers.to_pylist(), key=lambda a: a["part"]):
            both = unpack(answer["counts"], "<i8").reshape(2, -1)
            counted.append(both[0])
            deleted.append(both[1])
        counted, deleted = np.concatenate(counted), np.concatenate(deleted)
        return Answered(row, keys, counted[keys.word_at], deleted[keys.word_at], counted[keys.pair_at], deleted[keys.pair_at])


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, k for 2^(k-1) to 2^k - 1 times."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int8)


def shares(pairs: np.ndarray, contexts: np.ndarray, words: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of a word after its context and of the word alone; 0 where nothing is known."""
    return np.where(contexts > 0, pairs / np.maximum(contexts, 1), 0.0), words / max(tokens, 1)


def events_of(corpus: Corpus):
    """What the counts without the deleted texts say about each distinct pair of a batch of deleted texts."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_pylist([], EVENTS)
        a = Answered.of(texts, answers)
        words = a.words - a.words_deleted
        pair, single = shares(a.pairs - a.pairs_deleted, words[a.keys.left], words[a.keys.right], corpus.tokens - corpus.deleted)
        times = np.bincount(a.keys.pair, minlength=len(pair)).astype(np.int32)
        columns = [bucket_of(words[a.keys.left]), pair.astype(np.float32), single.astype(np.float32), times]
        return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(columns, EVENTS)], schema=EVENTS)

    return run


def learn_weights(events: DataFrame, corpus: Corpus) -> np.ndarray:
    """Weights of pair, word and constant for each bucket of contexts, by expectation-maximisation."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0.0, 0.5, 0.5
    if not corpus.tokens:
        weights[:] = 0.0, 0.0, 1.0
    constant = 1 / (corpus.vocabulary + 1)
    before = None
    while corpus.deleted:
        def expected(rows: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, 5))
            for some in rows:
                for bucket, pair, single, times in zip(*(some[c] for c in ("bucket", "pair", "single", "times"))):
                    b, n = np.asarray(bucket.values), np.asarray(times.values).astype(np.float64)
                    terms = weights[b].T * np.stack([np.asarray(pair.values), np.asarray(single.values), np.full(len(b), constant)])
                    mixed = terms.sum(axis=0)
                    for k, term in enumerate([*(terms / mixed), np.log(mixed), np.ones(len(b))]):
                        total[:, k] += np.bincount(b, n * term, minlength=BUCKETS)
            some = np.flatnonzero(total[:, 4])
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32))] + [pa.array(total[some, k]) for k in range(5)], names=names)

        names = ["bucket", "pair", "single", "constant", "likelihood", "times"]
        sums = events.mapInArrow(expected, "bucket int, " + ", ".join(f"{n} double" for n in names[1:])).groupBy("bucket").agg(
            *(F.sum(n).alias(n) for n in names[1:])).collect()
        weights = weights.copy()
        for r in sums:
            explained = np.array([r.pair + PRIOR * (r.bucket > 0), r.single + PRIOR, r.constant + PRIOR])
            weights[r.bucket] = explained / explained.sum()
        mean = sum(r.likelihood for r in sums) / sum(r.times for r in sums)
        steps = 1 if before is None else steps + 1
        if steps >= STEPS or before is not None and mean - before < LEAST_GAIN:
            break
        before = mean
    return weights


def scores_of(corpus: Corpus, weights: np.ndarray):
    base_total = np.log10(corpus.tokens + BASE_COUNT * (corpus.vocabulary + 1))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_pylist([], SCORES)
        a = Answered.of(texts, answers)
        pair, single = shares(a.pairs, a.words[a.keys.left], a.words[a.keys.right], corpus.tokens)
        w = weights[bucket_of(a.words[a.keys.left])]
        logs = np.log10(w[:, 0] * pair + w[:, 1] * single + w[:, 2] / (corpus.vocabulary + 1))[a.keys.pair]
        base = (np.log10(a.words + BASE_COUNT) - base_total)[a.keys.words]
        known = (a.words > 0).astype(np.int64)[a.keys.words]
        sizes = np.array(a.row["sizes"], dtype=np.int64)
        heads = np.cumsum(sizes) - sizes
        columns = [
            a.row["ids"], sizes, np.add.reduceat(known, heads), np.full(len(sizes), corpus.tokens), np.add.reduceat(base, heads), np.add.reduceat(logs, heads),
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORES)], schema=SCORES)

    return run


def score(docs: DataFrame, training: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are the words of the text, parted by the six ASCII white spaces, with A-Z in lower case, and one end. ``training`` tells the rows that
    are counted, ``deleted`` those of them that the weights are learned on (their counts are used in the end too); null is false.
    ``n_known`` counts tokens that training texts hold, ``train_tokens`` is their number in training texts. ``base_score`` sums log10 of
    add-0.1 shares of single tokens, ``score`` is log10 of the text's probability. A null text is an empty one, of one token; equal rows and null
    ids are kept apart. Without training texts all probabilities are 1.
    """
    kind = F.when(F.coalesce(training, F.lit(False)), F.when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(COUNTED)).otherwise(SCORED)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), kind.alias("kind"))
    path = new_shared_path(docs.sparkSession, "batches")
    rows.mapInArrow(batches_of, spark_schema(TEXTS)).write.option("compression", "none").parquet(path)
    texts = docs.sparkSession.read.schema(spark_schema(TEXTS)).parquet(path)
    sizes = {r.kind: r.n for r in texts.groupBy("kind").agg(F.sum("n_words").alias("n")).collect()}
    bits = max(0, sum(sizes.values()) // PART_WORDS).bit_length()
    answers = cut(texts.mapInArrow(requests_of(bits), spark_schema(REQUESTS)).groupBy("part").applyInArrow(count_part, spark_schema(ANSWERS)))
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0
    tokens_deleted = sizes.get(DELETED, 0)
    corpus = Corpus(sizes.get(COUNTED, 0) + tokens_deleted, tokens_deleted, vocabulary)
    answers = answers.where("batch is not null").select("batch", "part", "counts")

    def answered(some: DataFrame, fn, schema: pa.Schema) -> DataFrame:
        return some.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(fn, spark_schema(schema))

    weights = learn_weights(cut(answered(texts.where(F.col("kind") == DELETED), events_of(corpus), EVENTS)), corpus)
    return answered(texts, scores_of(corpus, weights), SCORES)

