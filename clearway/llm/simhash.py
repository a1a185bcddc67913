"""Near-duplicates by SimHash: 64-bit fingerprints of word shingles, compared exactly in tiles.

Equal fingerprints are merged first, so copies cost nothing. Distinct fingerprints form tiles by the numbers of ones in their
quarters. Two fingerprints differ in at least as many bits as those numbers differ in sum, so tiles whose numbers
are further apart than the radius are never compared; the rest is compared in full with numpy. Every compared pair of tiles sends
only the links that connect something new, at most one per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from clearway.llm.common import cut, id_and_text
from clearway.llm.components import components
from clearway.llm.forest import Forest

BITS = 64
# Parts of a fingerprint (2, 4 or 8) whose ones are counted. More parts skip more pairs but give each tile more neighbours: with 4,
# some 1.4 % of the pairs of random fingerprints are compared, with 8 some 0.025 %. 8 pays from about 10^8 fingerprints.
PARTS = 4
# Fingerprints of one tile; bounds the memory of a comparison.
TILE = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than the six ASCII white spaces, with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash as an unsigned number: a bit is one if it is one in over half of the shingle hashes, repeats included.

    A text of fewer words is one shingle; without words the fingerprint is 0.
    """
    words = words_of(text)
    if not words:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):
        stop = min(n, at + 65_536)
        rows = zip(*(words[at + k: stop + k] for k in range(shingle))) if len(words) >= shingle else [words]
        hashes = np.array([digest(b" ".join(r), seed) for r in rows], dtype=np.uint64)
        ones += _ones(hashes)
    bits = (2 * ones > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits[::-1]).tobytes(), "big")


def bits_of_majority(hashes: np.ndarray) -> int:
    """The SimHash of some hashes as an unsigned number; 0 for none."""
    bits = (2 * _ones(hashes) > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits[::-1]).tobytes(), "big") if len(hashes) else 0


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, from bit 0."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at: at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, print): the fingerprint of every row as a signed 64-bit number; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints = np.array([fingerprint(t, shingle, seed) for t in part["text"].to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(prints.view(np.int64))], names=["id", "print"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, print long")


def compared(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of two tiles, or of one, as far as pairs within ``radius`` do."""
    both = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    forest = Forest(len(both))
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at: at + 256, None] ^ other[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            forest.join(at + int(i), np.flatnonzero(near[i]) + shift)
    return [(int(both[i]), int(both[j])) for i, j in forest.links]


def _offsets(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Differences of counts within the radius; of each and its opposite only one, so a pair of tiles meets once."""
    steps = [()]
    for _ in range(parts):
        steps = [(*d, k) for d in steps for k in range(-radius, radius + 1) if sum(map(abs, d)) + abs(k) <= radius]
    return [d for d in steps if d >= (0,) * parts]


def near_links(prints: DataFrame, radius: int = 2, tile: int = TILE, parts: int = PARTS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``print``) that connect all pairs within ``radius`` bits."""
    bits = BITS // parts
    base = bits + 1
    counts = [F.bit_count(F.shiftrightunsigned("print", bits * k).bitwiseAND(F.lit((1 << bits) - 1))) for k in range(parts)]
    code = sum((c * base ** (parts - 1 - k) for k, c in enumerate(counts)), F.lit(0)).cast("int")
    coded = prints.select("print", code.alias("code"))
    # At most 17^4 rows for 4 parts, which Spark may broadcast. A tile with too many fingerprints is cut at random into several.
    cuts = coded.groupBy("code").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
    tiles = (
        coded.join(cuts, "code")
        .groupBy("code", "cuts", F.pmod(F.xxhash64("print"), F.col("cuts")).cast("int").alias("cut"))
        .agg(F.sort_array(F.collect_list("print")).alias("prints"))
    )
    tiles = cut(tiles)
    heads = tiles.select("code", "cut")
    # A neighbour's code is the own one plus a fixed difference, if no count leaves 0 .. bits.
    digit = [F.pmod(F.floor(F.col("code") / base ** (parts - 1 - k)), F.lit(base)) for k in range(parts)]
    neighbours = F.array(*(
        F.when(
            F.lit(True) if not any(d) else _all((digit[k] + d[k] for k in range(parts) if d[k]), bits),
            F.col("code") + sum(d[k] * base ** (parts - 1 - k) for k in range(parts)),
        ) for d in _offsets(radius, parts)
    ))
    pairs = (
        heads.select("code", "cut", F.explode(neighbours).alias("code2")).where(F.col("code2").isNotNull())
        .join(heads.select(F.col("code").alias("code2"), F.col("cut").alias("cut2")), "code2")
        .where("code <> code2 or cut <= cut2")
    )
    left = tiles.select("code", "cut", F.col("prints").alias("a"))
    right = tiles.select(F.col("code").alias("code2"), F.col("cut").alias("cut2"), F.col("prints").alias("b"))
    meeting = pairs.join(left, ["code", "cut"]).join(right, ["code2", "cut2"]).select(
        ((F.col("code") == F.col("code2")) & (F.col("cut") == F.col("cut2"))).alias("own"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for own, a, b in zip(batch["own"].to_pylist(), batch["a"], batch["b"]):
                a, b = (np.asarray(x.values).view(np.uint64) for x in (a, b))
                found += compared(a, None if own else b, radius)
            ends = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return meeting.mapInArrow(run, "a long, b long")


def _all(values: Iterable[Column], most: int) -> Column:
    condition = F.lit(True)
    for v in values:
        condition = condition & v.between(0, most)
    return condition


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, seed: int = 42,
                    parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; the component is the smallest doc_id reachable over
    links. Texts without words have fingerprint zero and are linked like any other. Null ids take part in links but name a component
    only if it has no other id.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = cut(rows.groupBy("print").agg(F.min("id").alias("lowest")))
    grouped = cut(components(near_links(distinct.select("print"), radius, parts=parts)))
    named = cut(distinct.join(grouped, distinct["print"] == grouped["node"], "left").select(
        "print", "lowest", F.coalesce("component", "print").alias("component")))
    lowest = cut(named.groupBy("component").agg(F.min("lowest").alias("component_id")))
    names = cut(named.join(lowest, "component").select("print", "component_id"))
    return rows.join(names, "print").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
