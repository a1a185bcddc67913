import hashlib
import random
import zlib

import numpy as np
import pytest

from clearway.llm import runs


def brute(words, least=12):
    """All runs by trying every period: (start, length, period)."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((b, e - b, q) for (b, e), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    w = [0]
    while len(w) < n:
        w += [1 - x for x in w]
    return w[:n]


def as_words(numbers):
    return [b"%d" % x for x in numbers]


def random_documents(rng):
    docs = []
    for _ in range(rng.randint(1, 5)):
        n, k = rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 120, 200]), rng.choice([1, 2, 3, 5, 50])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 10:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w = w[:a] + [w[a + x % p] for x in range(n - a)]
        if rng.random() < 0.3 and docs:
            w = w + rng.choice(docs)[: rng.randint(1, 90)]
        docs.append(w)
    return [as_words(w) for w in docs]


@pytest.mark.parametrize("seed", range(60))
def test_equals_brute_force(seed):
    docs = random_documents(random.Random(seed))
    for least in (12, 7, 2, 1):
        assert [f.runs for f in runs.documents_runs(docs, least)] == [brute(w, least) for w in docs]


@pytest.mark.parametrize("n", [40, 255, 256, 610, 987])
def test_words_that_are_all_runs(n):
    docs = [as_words(fibonacci(n)), as_words(thue_morse(n)), as_words([0] * n), as_words(fibonacci(n)), as_words([1, 2] * (n // 2) + [1])]
    assert [f.runs for f in runs.documents_runs(docs)] == [brute(w) for w in docs]


def test_a_run_over_grammar_borders_between_copies():
    """The same passage in several documents is one nonterminal; its runs go on in some of them only."""
    passage = list(range(100, 140)) + [1, 2, 3] * 6
    docs = [as_words(passage), as_words([5] + passage + [1, 2, 3, 1, 9]), as_words([3] * 20 + passage), as_words(passage + [4]), as_words(passage * 3)]
    assert [f.runs for f in runs.documents_runs(docs)] == [brute(w) for w in docs]


def test_every_nonterminal_is_written_where_it_is_said_to_be():
    docs = random_documents(random.Random(3)) * 2
    flat = np.array([int(w) for d in docs for w in d], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    nodes = runs.grammar(flat, bounds, 2)
    texts = {}
    for name, start, middle, stop in zip(nodes.name, nodes.start, nodes.middle, nodes.stop):
        assert start < middle < stop and not ((bounds > start) & (bounds < stop)).any()
        assert texts.setdefault(name, (middle - start, flat[start:stop].tolist())) == (middle - start, flat[start:stop].tolist())
    # Each place between two words of a document is the boundary of exactly one node.
    inner = sorted(set(range(1, len(flat))) - set(bounds.tolist()))
    assert sorted(nodes.middle.tolist()) == inner


def test_equal_fingerprints_are_noticed(monkeypatch):
    monkeypatch.setattr(runs, "PRIMES", ((5, 2), (7, 3)))
    docs = random_documents(random.Random(8))
    for attempt in range(3):
        try:
            assert [f.runs for f in runs.documents_runs(docs)] == [brute(w) for w in docs]
        except ArithmeticError:
            pass


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def digests(df):
    found = runs.longest_run(runs.periodic_runs(df, edit=True, digest=True))
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "a " * 5000), (None, "b c " * 20), (None, None), (5, "x y z " * 4), (5, "x y z " * 4),
        (6, "a b c\x85d\x1ce " * 9), (7, "one"), (8, "A a A a A a A a A a A a a A a A a A a A a A a A"), (26, " ".join(map(str, range(50)))),
        (9, "w" * 100_000), (-3, "é ß " * 30), (10, "p q r s " * 3 + "p q r s p"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, start int")
    assert digests(df) == sorted((expected_row(*r) for r in rows), key=str)
    assert digests(df.limit(0)) == []


def test_general_form(spark):
    df = spark.createDataFrame([(1, "say it again again again " + "and on " * 8 + "end"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(5, 16, 2)] and got[1].collapsed == "say it again again again and on end" and got[1].n_words == 22
    assert got[2].runs == [] and got[2].collapsed == ""
    short = runs.periodic_runs(df, least=3).where("doc_id = 1").first()
    assert [tuple(r) for r in short.runs] == [(2, 3, 1), (5, 16, 2)]


def test_documents_do_not_depend_on_their_neighbours(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = digests(df)
    monkeypatch.setattr(runs, "SLICE_BYTES", 1)
    assert digests(df.repartition(3)) == whole


def test_documents_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    small = df.where("n_chars < 6000")
    assert digests(small) == sorted((expected_row(r.doc_id, r.text) for r in small.collect()), key=str)
