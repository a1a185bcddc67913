import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brute import lowest_reachable
from clearway.llm import simhash
from clearway.llm.components import components


def plain_print(text, shingle=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one TWO", "A b\x0bc\x0cd\r\ne", "É é x  y z", "a b c " * 500, "İ K ſ words"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_fingerprint_agrees_with_sparks_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert simhash.fingerprint("One two THREE") == row.h % 2**64


def test_long_text_in_parts():
    words = [f"w{n % 977}" for n in range(150_000)]
    assert simhash.fingerprint(" ".join(words)) == plain_print(" ".join(words))


def links_of(prints, radius):
    prints = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    return [(int(a), int(b)) for a, b in np.argwhere(near) if a < b]


@pytest.mark.parametrize("radius,tile,parts", [(0, 4096, 4), (1, 3, 4), (2, 4096, 4), (2, 5, 4), (3, 50, 2), (2, 50, 8), (2, 9, 2)])
def test_links_connect_what_is_near(spark, radius, tile, parts):
    rng = random.Random(radius)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "print long"), radius, tile, parts).collect()
    place = {s: n for n, s in enumerate(signed)}
    got = [(place[r.a], place[r.b]) for r in found]
    wanted = links_of(prints, radius)
    assert all((min(p), max(p)) in set(wanted) for p in got)
    assert lowest_reachable(range(len(prints)), got) == lowest_reachable(range(len(prints)), wanted)


def test_a_group_of_near_copies_sends_few_links():
    rng = np.random.default_rng(1)
    base = np.uint64(0x1234567890ABCDEF)
    cloud = np.unique(np.array([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 500)], dtype=np.uint64))
    assert len(simhash.compared(cloud, None, 2)) == len(cloud) - 1


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    prints = [plain_print(r.text) for r in rows]
    wanted = lowest_reachable([r.doc_id for r in rows], [(rows[a].doc_id, rows[b].doc_id) for a, b in links_of(prints, 2)])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for r, p in zip(rows, prints):
        assert got[r.doc_id].fingerprint == f"{p:016x}" and got[r.doc_id].component_id == wanted[r.doc_id]


def test_odd_rows(spark):
    rows = [(4, None), (3, ""), (None, " "), (7, "same words here now"), (6, "Same words here now"), (7, "same words here now"), (None, "other words entirely"), (9, "long " * 100_000)]
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, print int, id int, component string")
    got = sorted(((r.doc_id or -1), r.component_id if r.component_id is not None else -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (4, 3), (6, 6), (7, 6), (7, 6), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(n, n + 1) for n in range(40)], [(0, n) for n in range(1, 60)], [(99, n) for n in range(50)],
    [(n, n + 7) for n in range(0, 60, 3)] + [(100, 200), (200, 300)], [(-5, 3), (3, 2**62)],
])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert {r.node: r.component for r in components(df).collect()} == lowest_reachable(nodes, links) if nodes else components(df).collect() == []


def test_random_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(350)]
    nodes = {x for p in links if p[0] != p[1] for x in p}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(nodes) and {r.node: r.component for r in got} == lowest_reachable(nodes, links)
