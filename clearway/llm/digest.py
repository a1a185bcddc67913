"""Quartile bucket digests: locality-sensitive fingerprints of whole texts.

Byte triplets are hashed into 512 buckets. The digest holds, for every bucket, which quartile of the bucket counts its count is in
(two bits), and the length on a logarithmic scale. Similar texts fill similar buckets, so their digests differ little.

The bytes of a triplet are some places apart, so that it reaches across syllables: neighbouring bytes follow the language more than the
text, and told unlike texts of one language apart less well. The text is a ring, so that short ones have triplets too.

Form: ``Q1``, two hex digits of length, 256 hex digits of quartile codes (bucket 0 in the highest bits).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clearway.llm.common import id_and_text, record_batch

BUCKETS = 512
VERSION = "Q1"
# How far the second and third byte of each triplet are from the first.
TRIPLETS = ((3, 6), (4, 9))
WINDOW = 9
# Cost of two quartile codes that are 0, 1, 2 or 3 apart: opposite ends count double.
COSTS = np.array([0.0, 1.0, 2.0, 6.0])
PAIR_COST = COSTS[np.abs(np.subtract.outer(np.arange(4), np.arange(4)))]
# Steps of the length scale per factor e, and the likeness that one step of difference costs.
LENGTH_STEPS = 8
LENGTH_COST = 0.02


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket; every byte starts one of each kind."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if not data:
        return counts
    ring = np.frombuffer(data + (data * (WINDOW // len(data) + 1))[:WINDOW], dtype=np.uint8)
    # In slices, so that a very long text needs little memory.
    for at in range(0, len(data), 1 << 20):
        m = min(1 << 20, len(data) - at)
        part = ring[at: at + m + WINDOW].astype(np.uint32)
        for n, (second, third) in enumerate(TRIPLETS):
            key = part[:m] | (part[second:second + m] << 8)
            key |= part[third:third + m] << 16
            key += np.uint32(n << 24)
            key *= np.uint32(2654435761)
            counts += np.bincount(key >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return counts


def fingerprint(text: str | None) -> str:
    """The digest of a text; null counts as empty, whose codes are all zero."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(axis=1).astype(np.uint8)
    length = min(255, round(LENGTH_STEPS * math.log1p(len(data))))
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], dtype=np.uint8)
    return f"{VERSION}{length:02x}{packed.astype(np.uint8).tobytes().hex()}"


def _decode(digest: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(digest[4:]), dtype=np.uint8)
    return int(digest[2:4], 16), (packed[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3).ravel()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for digests no closer than their buckets in random order would be.

    The difference of the codes is divided by the one expected if the same codes were dealt to the buckets at
    random, so sparse digests of short texts and full ones are on one scale.
    """
    if a == b:
        return 1.0
    (length_a, codes_a), (length_b, codes_b) = _decode(a), _decode(b)
    share_a, share_b = (np.bincount(c, minlength=4) / BUCKETS for c in (codes_a, codes_b))
    expected = float(share_a @ PAIR_COST @ share_b)
    difference = float(PAIR_COST[codes_a, codes_b].mean())
    body = difference / expected if expected else 0.0
    return max(0.0, 1.0 - body - LENGTH_COST * abs(length_a - length_b))


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (code points, rounded down) replaced by as many first ones, or all, of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


NEIGHBOURS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
LOWEST = -(1 << 63)


def _ranges(rows: DataFrame, parts: int) -> Column:
    """The part of each row, in the order of ``key`` and within a key against that of ``h``: ranges of about equal size.

    The bounds are data, so that every scan agrees on them. A key that holds several ranges' rows is several equal bounds;
    its rows are dealt to all of these ranges by their hash, which is even.
    """
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    found = rows.agg(F.percentile_approx("key", shares, F.lit(10 * parts)).alias("b")).first().b if parts > 1 else None
    bounds = np.array(sorted(found or []), dtype=np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series, h: pd.Series) -> pd.Series:
        key = key.to_numpy()
        low, high = np.searchsorted(bounds, key), np.searchsorted(bounds, key, side="right")
        # The share of all hashes below this one, in [0, 1).
        share = (h.to_numpy() >> 11).astype(np.float64) / 2.0 ** 53 + 0.5
        equal = np.maximum(high - low, 1)
        return pd.Series((low + equal - 1 - np.floor(share * equal)).astype(np.int32))

    return part("key", "h")


def digests_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint every document and its edited text, and compare them and the next document.

    The next document has the next lower id; the first follows the last, and a single one follows itself. Null ids are the lowest;
    rows of one id are ordered by a hash of their texts. Returns the columns of ``NEIGHBOURS``, one row per input row.

    Texts are shuffled once, into ranges of id and hash, so rows that share an id are split too; only rows with equal id and text meet in one range, whose
    fingerprints are made once. A range ends with a copy of the first document of the next one, so each is worked off alone, as a stream.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_text(docs, id_col, text_col).withColumns({"key": F.coalesce("id", F.lit(LOWEST)), "h": F.xxhash64("text")})
    part = _ranges(rows, parts)
    # One row per range, however many documents there are.
    first = F.max(F.struct("key", F.bitwise_not("h").alias("not_h"))).alias("first")
    firsts = sorted(rows.select("key", "h", part.alias("part")).groupBy("part").agg(first).collect(), reverse=True)
    links = [(r.first.key, ~r.first.not_h, firsts[i - 1].part) for i, r in enumerate(firsts)]
    # As many rows as ranges, so small enough to broadcast. Of equal rows one is copied.
    copied = rows.join(F.broadcast(spark.createDataFrame(links, "key long, h long, part int")), ["key", "h"])
    copies = copied.groupBy("part", "key", "h").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    columns = ["id", "key", "h", "text", "part", "extra"]
    dealt = rows.withColumns({"part": part, "extra": F.lit(False)}).select(columns).unionByName(copies.withColumn("extra", F.lit(True)).select(columns))
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.desc("key"), "h")

    def compare(doc: int, text: str, own: str, following: str, next_print: str) -> tuple:
        changed = edited(text, following)
        changed_print = fingerprint(changed)
        return (doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, changed_print,
                likeness(own, changed_print), likeness(own, next_print))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = None  # (part, extra, id, text, fingerprint)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                columns = (batch.slice(at, 512)[c].to_pylist() for c in ("part", "extra", "id", "text"))
                for number, extra, doc, text in zip(*columns):
                    own = previous[4] if previous and previous[3] == text else fingerprint(text)
                    if previous and previous[0] == number:
                        out.append(compare(*previous[2:], text, own))
                    previous = (number, extra, doc, text, own)
                yield record_batch(out, NEIGHBOURS)

    return dealt.select("part", "extra", "id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
