import math

import numpy as np
import pytest

from clearway.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, wanted=4):
    """(vec_id, component) -> (deviation, whitened up to sign, explained), by the dense eigenvalue problem."""
    usable = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in usable})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    x = np.array(distinct, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(x.T @ x / n)
    order = np.argsort(-values)[:wanted]
    out = {}
    for i, v in usable:
        exact = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for k, at in enumerate(order):
            white = (np.array(v) - np.array(sums) / n) @ vectors[:, at] / math.sqrt(values[at])
            out.setdefault((i, k + 1), []).append((n, exact, white, values[at] / values.sum()))
    return out


def check(got, rows, wanted=4, tolerance=1e-7):
    expected = brute(rows, wanted)
    assert len(got) == sum(map(len, expected.values()))
    signs = {}
    for r in sorted(got, key=lambda r: (r.vec_id, r.component)):
        assert r.identity_error < 1e-9
        n, exact, white, share = expected[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, exact)
        assert r.explained == pytest.approx(share, rel=1e-9)
        if r.component not in signs and abs(white) > 1e-3:
            signs[r.component] = 1 if (white > 0) == (r.whitened > 0) else -1
        assert r.whitened * signs.get(r.component, 1) == pytest.approx(white, abs=tolerance)


@pytest.mark.parametrize("n,d,spread", [(60, 5, 1.0), (300, 24, 0.9), (12, 40, 1.0), (500, 16, 0.3)])
def test_equals_dense_eigenvectors(spark, n, d, spread):
    rng = np.random.default_rng(d)
    points = rng.normal(size=(n, d)) * spread ** np.arange(d) * 3 + 20
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    rows += [(1000 + k, rows[0][1]) for k in range(50)]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), rows)


def test_equal_deviations(spark):
    """Four directions of the same deviation: any basis of them is right, so only what does not depend on it is compared."""
    rows = [(2 * k + s, [(1.0 if s else -1.0) * (j == k) for j in range(6)]) for k in range(6) for s in range(2)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 48 and {r.component for r in got} == {1, 2, 3, 4}
    white = np.zeros((12, 4))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(1 / 6) and r.identity_error < 1e-9
    assert np.allclose(white.T @ white / 12, np.eye(4), atol=1e-9)


def test_low_rank(spark):
    rows = [(k, [float(k), 2.0 * k, 0.0, 5.0]) for k in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9
    assert sum(r.whitened ** 2 for r in got) / 9 == pytest.approx(1)
    assert whitening.whiten(spark.createDataFrame(rows[:1] * 3, SCHEMA)).collect() == []


def test_odd_rows(spark):
    good = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [4.0, 2.5]), (4, [-0.001, 0.0])]
    bad = [(5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 3) for r in good + bad], SCHEMA + ", component string, n int")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == sorted((i or -1, k) for i, _ in good for k in (1, 2))
    assert {r.n for r in got} == {4}
    sums = [sum(math.floor(256 * v[j]) for v in ([1.0, 0.0], [0.0, 1.0], [4.0, 2.5], [-0.001, 0.0])) for j in range(2)]
    assert {r.deviation for r in got if r.vec_id == 3} == {(4 * 1024 - sums[0]) ** 2 + (4 * 640 - sums[1]) ** 2}
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(spark.createDataFrame(bad[:2], SCHEMA)).collect() == []


def test_huge_entries(spark):
    rows = [(k, [1e30 * (k % 2), float(k)]) for k in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) >= 6 and all(r.deviation is None or r.deviation >= 0 for r in got)


def test_sums_of_sums(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, p.tolist()) for k, p in enumerate(rng.normal(size=(200, 8)))]
    monkeypatch.setattr(whitening, "PARTIAL_SUMS", 2)
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect(), rows)


def test_embeddings_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitening.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()], tolerance=1e-6)
