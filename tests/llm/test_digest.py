import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from clearway.llm import digest

FOLDER = "/root/testdata/sf0.001"


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.text(max_size=80))
def test_likeness_is_bounded_and_symmetric(a, b):
    x, y = digest.fingerprint(a), digest.fingerprint(b)
    assert 0 <= digest.likeness(x, y) <= 1 and digest.likeness(x, y) == digest.likeness(y, x)
    assert digest.likeness(x, digest.fingerprint(a)) == 1


def test_form():
    for text in (None, "", "a", "é" * 3_000_000):
        value = digest.fingerprint(text)
        assert value.startswith("Q1") and len(value) == 4 + digest.BUCKETS // 2
    assert digest.fingerprint(None) == digest.fingerprint("")


def test_counts_do_not_depend_on_slices():
    data = random.Random(1).randbytes((1 << 20) + 77)
    whole = digest.bucket_counts(data)
    assert whole.sum() == len(data) * len(digest.TRIPLETS) and (whole > 0).all()
    # Ten bytes by hand.
    small = bytes(range(10))
    wanted = [0] * digest.BUCKETS
    for at in range(10):
        for n, (second, third) in enumerate(digest.TRIPLETS):
            key = small[at] | small[(at + second) % 10] << 8 | small[(at + third) % 10] << 16 | n << 24
            wanted[(key * 2654435761 & 0xFFFFFFFF) >> 23] += 1
    assert digest.bucket_counts(small).tolist() == wanted


@pytest.mark.parametrize("parts", [1, 3, 7, 1000])
def test_documents_and_their_neighbours(spark, parts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in digest.digests_with_next(docs, parts=parts).collect()}
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    assert len(got) == len(rows)
    better = 0
    for n, r in enumerate(rows):
        after = rows[(n + 1) % len(rows)].text
        changed = digest.edited(r.text, after)
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (g.fingerprint, g.edited_fingerprint) == (digest.fingerprint(r.text), digest.fingerprint(changed))
        assert g.near_edited == digest.likeness(g.fingerprint, g.edited_fingerprint)
        assert g.near_next == digest.likeness(g.fingerprint, digest.fingerprint(after))
        better += g.near_edited > g.near_next
    assert better > 0.97 * len(rows)


def test_odd_rows(spark):
    rows = [(5, "five five"), (5, "five five"), (None, "lost"), (3, None), (2, ""), (9, "nine " * 20_000)]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, part int, key string")
    got = digest.digests_with_next(docs, parts=2).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((d or -1, len(t or "")) for d, t in rows)
    lost = next(r for r in got if r.doc_id is None)
    # Null ids are last, and the first follows them.
    assert lost.edited_sha256 == hashlib.sha256(b"losn").hexdigest()


def test_single_and_none(spark):
    one = digest.digests_with_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(1, 1.0, hashlib.sha256(b"abcdab").hexdigest())]
    assert digest.digests_with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_one_id_is_split(spark, parts):
    """Half of the rows share one id, others none; each follows the next lower id, and within an id the next higher hash."""
    rows = [(7, f"seven {n}") for n in range(300)] + [(None, f"none {n}") for n in range(150)] + [(n, f"single {n}") for n in range(20)] + [(3, "three")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    changed = [(d, digest.edited(t, order[(n + 1) % len(order)][1])) for n, (d, t) in enumerate(order)]
    got = digest.digests_with_next(docs, parts=parts).collect()
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == sorted((d or -1, hashlib.sha256(t.encode()).hexdigest()) for d, t in changed)
    if parts > 4:
        ranged = docs.selectExpr("coalesce(doc_id, -99) as key", "xxhash64(text) as h")
        sizes = ranged.groupBy(digest._ranges(ranged, parts).alias("part")).count().toPandas()["count"]
        assert sizes.max() < 60
