"""Periodic runs in texts, found on a Re-Pair grammar.

A run is a stretch of words that repeats with a smallest period q, as long as it can be, of at least two periods and some least length.

The words of a slice of documents are numbers in one array. Re-Pair replaces repeated pairs of neighbours by nonterminals, those first that
are more frequent than the pairs they overlap, until no pair occurs twice; what is left of each document is paired up to a balanced tree.
Every run is cut by the boundary of exactly one node that holds all of it: the lowest node around its ends. So the runs across the
boundary of each nonterminal are computed once, at one of its places, and moved to all places where it was written; then the longest
stretches are kept.

A run has at least `least / 2` words in a row that are equal to the words one period on. Two equal n-grams of that size, one of
them touching the boundary, are therefore what a period must start from, and how far it reaches is found by comparing
fingerprints of growing stretches, for all periods at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import id_and_text, record_batch, spark_schema

LEAST_LENGTH = 12
# Bytes of text whose words share a grammar; a longer document is a slice of its own.
SLICE_BYTES = 1 << 21
# Two primes below 2^31 and bases for fingerprints of stretches: products fit 64 bits. Every stretch that is reported is compared word by word.
PRIMES = ((2147483647, 1048573981), (2147483629, 736251917))


@dataclass(frozen=True)
class Nodes:
    """Places of nodes in the word array: which nonterminal, first word, first word of the right child, word after the last."""

    name: np.ndarray
    start: np.ndarray
    middle: np.ndarray
    stop: np.ndarray


def grammar(words: np.ndarray, bounds: np.ndarray, least: int) -> Nodes:
    """Every place of every nonterminal of at least ``least`` words, after Re-Pair over all documents and a tree over the rest of each.

    ``words`` are word numbers from 0; document k is ``words[bounds[k]:bounds[k + 1]]``. No pair reaches over a document's end.
    A symbol stands at the place of its first word; ``after`` and ``before`` lead to its neighbours.
    """
    n = len(words)
    symbol = words.astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    border = np.zeros(n + 1, dtype=bool)
    border[bounds] = True
    before[border] = n
    alive = np.ones(n + 1, dtype=bool)
    alive[n] = False
    rank = np.zeros(n + 1, dtype=np.int64)
    names = int(words.max(initial=-1)) + 1
    found: list[tuple[np.ndarray, ...]] = []

    def note(name: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> None:
        big = stop - start >= least
        found.append((name[big], start[big], middle[big], stop[big]))

    # A pair that has become unique stays so until one of its symbols is replaced, so only the others and new pairs are counted again.
    pairs = np.flatnonzero(~border[after])
    while len(pairs):
        pair, count = repeated(symbol[pairs] * names + symbol[after[pairs]])
        some = count > 1
        at, pair, count = pairs[some], pair[some], count[some]
        if not len(at):
            break
        # More frequent pairs first; of equally frequent ones any fixed order will do.
        order = np.lexsort((pair, count))
        changes = np.concatenate([[True], np.diff(pair[order]) != 0])
        rank[at[order]] = np.cumsum(changes) * 2
        # Of a pair that overlaps itself (x x x) every second place, from the left.
        same = np.zeros(len(at), dtype=bool)
        same[1:] = (after[at[:-1]] == at[1:]) & (pair[1:] == pair[:-1])
        heads = np.flatnonzero(~same)
        offset = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
        rank[at] += offset % 2 == 0
        chosen = (rank[at] > rank[before[at]]) & (rank[at] > rank[after[at]])
        rank[at] = 0
        others, at, pair = at[~chosen], at[chosen], pair[chosen]
        _, name = np.unique(pair, return_inverse=True)
        middle = after[at]
        stop = after[middle]
        note(names + name, at, middle, stop)
        symbol[at], after[at], alive[middle] = names + name, stop, False
        names += int(name.max()) + 1
        inner = ~border[stop]
        before[stop[inner]] = at[inner]
        pairs = np.unique(np.concatenate([others, at, before[at]]))
        pairs = pairs[alive[pairs]]
        pairs = pairs[~border[after[pairs]]]
    # What is left of each document: neighbours are joined two by two.
    start = np.flatnonzero(alive)
    while len(start):
        stop = np.append(start[1:], n)
        last = border[stop]
        heads = np.flatnonzero(border[start])
        offset = np.arange(len(start)) - np.repeat(heads, np.diff(np.append(heads, len(start))))
        left = (offset % 2 == 0) & ~last
        at = np.flatnonzero(left)
        if not len(at):
            break
        note(names + np.arange(len(at)), start[at], start[at + 1], stop[at + 1])
        names += len(at)
        start = start[offset % 2 == 0]
    return Nodes(*(np.concatenate(c) for c in zip(*found))) if found else Nodes(*(np.zeros(0, np.int64),) * 4)


def repeated(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code its rank among the codes that occur more than once (0 for others) and how often it occurs (1 for those)."""
    bits = max(10, len(code).bit_length() + 2)
    bucket = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    several = np.bincount(bucket.view(np.int64), minlength=1 << bits)[bucket] > 1
    pair, count = np.zeros(len(code), dtype=np.int64), np.ones(len(code), dtype=np.int64)
    if several.any():
        _, number, counts = np.unique(code[several], return_inverse=True, return_counts=True)
        pair[several], count[several] = number, counts[number]
    return pair, count


class Stretches:
    """Fingerprints of all stretches of a word array."""

    def __init__(self, words: np.ndarray, attempt: int = 0):
        self.tables = []
        for prime, base in PRIMES:
            base += attempt
            p = np.uint64(prime)
            power = np.ones(len(words) + 1, dtype=np.uint64)
            step, known = np.uint64(base), 1
            while known < len(power):
                more = min(known, len(power) - known)
                power[known: known + more] = power[:more] * step % p
                step, known = step * step % p, known + more
            terms = (words.astype(np.uint64) + np.uint64(1)) % p * power[:-1] % p
            total = np.zeros(len(words) + 1, dtype=np.uint64)
            # Terms below 2^31 leave room for 2^33 of them.
            np.cumsum(terms, out=total[1:])
            self.tables.append((p, power, total % p))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` words from ``a`` and from ``b`` (a < b) are equal."""
        result = np.ones(len(a), dtype=bool)
        for p, power, total in self.tables:
            left = (total[a + length] + p - total[a]) % p * power[b - a] % p
            result &= left == (total[b + length] + p - total[b]) % p
        return result

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and ``b`` on are equal, up to ``most``."""
        low, high = np.zeros(len(a), dtype=np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and ``b`` are equal, up to ``most``."""
        low, high = np.zeros(len(a), dtype=np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a - mid, b - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of many ranges, and which range each is from."""
    size = np.maximum(stop - first, 0)
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs of at least ``least`` words inside the documents, by start and period; see :func:`grammar`."""
    nodes = grammar(words, bounds, least)
    for attempt in range(100):
        runs = runs_of(nodes, words, bounds, least, attempt)
        # Two different stretches with equal fingerprints can only make a run too long.
        if all(np.array_equal(words[b: e - q], words[b + q: e]) for b, e, q in zip(*runs)):
            return runs
    raise ArithmeticError("equal fingerprints of different stretches for 100 bases")


def runs_of(nodes: Nodes, words: np.ndarray, bounds: np.ndarray, least: int, attempt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nothing = (np.zeros(0, np.int64),) * 3
    gram = max(1, least // 2)
    name, one = np.unique(nodes.name, return_index=True)
    start, middle, stop = nodes.start[one], nodes.middle[one], nodes.stop[one]
    group, places, rank = equal_grams(words, bounds, gram)
    if not len(places):
        return nothing
    # n-grams inside the node that touch the last word before its boundary, and those equal to them inside the node.
    node, here = ranges(np.maximum(start, middle - gram), np.minimum(middle, stop - gram + 1))
    known = group[here] >= 0
    node, here = node[known], here[known]
    base = group[here] * len(words)
    which, at = ranges(np.searchsorted(rank, base + start[node]), np.searchsorted(rank, base + stop[node] - gram + 1))
    node, here, there = node[which], here[which], places[at]
    away = here != there
    node, period, at, earlier = node[away], np.abs(there - here)[away], np.minimum(here, there)[away], (there < here)[away]
    # Equal n-grams at one distance that touch the same word are one stretch: it is followed once.
    _, first = np.unique((node * len(words) + period) * np.int64(2) + earlier, return_index=True)
    node, period, at = node[first], period[first], at[first]
    stretches = Stretches(words, attempt)
    back = stretches.behind(at, at + period, at - start[node])
    ahead = stretches.ahead(at, at + period, stop[node] - at - period)
    begin, end = at - back, at + period + ahead
    fine = (end - begin >= np.maximum(least, 2 * period)) & (begin < middle[node]) & (end > middle[node])
    node, begin, end, period = node[fine], begin[fine], end[fine], period[fine]
    if not len(node):
        return nothing
    # To all places of the nonterminal.
    order = np.argsort(nodes.name, kind="stable")
    sorted_names = nodes.name[order]
    which, at = ranges(np.searchsorted(sorted_names, name[node]), np.searchsorted(sorted_names, name[node], side="right"))
    shift = nodes.start[order[at]] - start[node[which]]
    begin, end, period = begin[which] + shift, end[which] + shift, period[which]
    # The longest stretches of each period.
    order = np.lexsort((-end, begin, period))
    begin, end, period = begin[order], end[order], period[order]
    reach = np.maximum.accumulate(end + period * np.int64(len(words) + 1))
    longest = np.concatenate([[True], (end + period * np.int64(len(words) + 1))[1:] > reach[:-1]])
    begin, end, period = begin[longest], end[longest], period[longest]
    # Of one stretch the smallest period.
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    smallest = np.concatenate([[True], (np.diff(begin) != 0) | (np.diff(end) != 0)])
    begin, end, period = begin[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def equal_grams(words: np.ndarray, bounds: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which n-grams occur more than once in their document.

    For each position the number of its group (-1 for none); the positions by group; and group * words + position of those, in order.
    """
    n = len(words)
    group = np.full(n, -1, dtype=np.int64)
    none = group, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < gram:
        return none
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    mixed = document[: n - gram + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(gram):
        mixed = (mixed ^ words[k: n - gram + 1 + k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    inside = np.flatnonzero(document[: n - gram + 1] == document[gram - 1:])
    number, count = repeated(mixed[inside].view(np.int64))
    some = count > 1
    if not some.any():
        return none
    places, number = inside[some], number[some]
    order = np.argsort(number, kind="stable")
    places, number = places[order], number[order]
    group[places] = number
    return group, places, number * n + places


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """In one of ten documents, chosen by its id, the words from some place on become copies of those there."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


@dataclass(frozen=True)
class Found:
    """What is found in one document: its words, and (start, length, period) of each run by start and period."""

    words: list[bytes]
    runs: list[tuple[int, int, int]]

    def longest(self) -> tuple[int, int, int] | None:
        return min(self.runs, key=lambda r: (-r[1], r[0], r[2]), default=None)

    def collapsed(self) -> list[bytes]:
        """The words without those that only repeat a run's first period."""
        if not self.runs:
            return self.words
        kept = np.ones(len(self.words), dtype=bool)
        for start, length, period in self.runs:
            kept[start + period: start + length] = False
        return [w for w, k in zip(self.words, kept) if k]


def documents_runs(documents: list[list[bytes]], least: int = LEAST_LENGTH) -> list[Found]:
    """The runs of each of some documents, given as words, with one grammar for all."""
    flat = pa.array([w for words in documents for w in words], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in documents])]).astype(np.int64)
    begin, end, period = find_runs(flat, bounds, least)
    at = np.searchsorted(begin, bounds)
    return [
        Found(words, list(zip((begin[i:j] - bound).tolist(), (end[i:j] - begin[i:j]).tolist(), period[i:j].tolist())))
        for words, bound, i, j in zip(documents, bounds, at[:-1], at[1:])
    ]


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes of text; a longer text is a part of its own."""
    lengths = np.diff(np.frombuffer(batch["text"].cast(pa.large_string()).buffers()[1], dtype=np.int64)[batch["text"].offset:][: batch.num_rows + 1])
    start = total = 0
    for k, length in enumerate(lengths.tolist()):
        if k > start and total + length > size:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += length
    if start < batch.num_rows:
        yield batch.slice(start)


LONG = pa.int64()
RUN = pa.struct([("start", LONG), ("length", LONG), ("period", LONG)])
RUNS = pa.schema([("doc_id", LONG), ("n_words", LONG), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
DIGESTS = pa.schema([*((c, LONG) for c in ("doc_id", "n_runs", "start", "length", "period")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, edit: bool = False,
                  digest: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and the collapsed text of every row.

    Words are parted by the six ASCII white spaces. A run is a stretch of words with smallest period q, of at least ``least`` and
    2 q words, that no neighbouring word extends; ``collapsed`` leaves out the words that a run holds after its first q. Null texts are
    empty and have no runs; rows with equal or null ids are kept apart. ``edit`` makes parts of some texts periodic first, by their ids (see
    :func:`edited`); with ``digest`` the runs and texts themselves are replaced by ``runs_sha256`` and ``collapsed_sha256``, and the
    longest run's start, length and period (of equal ones the first, then the one with the smaller period; null without runs).
    """
    schema = DIGESTS if digest else RUNS

    def row(doc_id: int | None, found: Found) -> tuple:
        collapsed = b" ".join(found.collapsed())
        if not digest:
            return doc_id, len(found.words), [dict(zip(("start", "length", "period"), r)) for r in found.runs], collapsed.decode()
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found.runs)
        return (doc_id, len(found.runs), *(found.longest() or (None,) * 3),
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                ids = part["id"].to_pylist()
                documents = [text.encode().split() for text in part["text"].to_pylist()]
                if edit:
                    documents = [edited(words, i) for words, i in zip(documents, ids)]
                rows = [row(i, found) for i, found in zip(ids, documents_runs(documents, least))]
                yield record_batch(rows, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, spark_schema(schema))


def longest_run(runs: DataFrame) -> DataFrame:
    """The digest of :func:`periodic_runs` with the exponent of the longest run, in thousandths."""
    return runs.withColumn("exponent_milli", F.expr("length * 1000 div period"))
