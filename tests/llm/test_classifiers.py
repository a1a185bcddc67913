import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from clearway.llm import quality, toxicity
from clearway.llm.queries import op1_quality_classifier, op7_toxicity

FOLDER = "/root/testdata/sf0.1"


def held_out(spark, query, label, fold, rest):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = query(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest) and 0 <= r.score <= 1
    known = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    return {(a, b): sum(k == (a, b) for k in known) for a in (0, 1) for b in (0, 1)}


def test_quality_on_held_out_rows(spark):
    n = held_out(spark, op1_quality_classifier, "quality", 5, 0)
    assert n[0, 0] / (n[0, 0] + n[0, 1]) > 0.95 and n[1, 1] / (n[1, 0] + n[1, 1]) > 0.99


def test_toxicity_on_held_out_rows(spark):
    n = held_out(spark, op7_toxicity, "toxic", 3, 1)
    assert n[1, 1] / (n[1, 0] + n[1, 1]) > 0.7 and n[0, 1] / (n[0, 0] + n[0, 1]) < 0.01


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 9)), min_size=1, max_size=12))
def test_pooling_is_the_closest_rising_sequence(points):
    values, weights = (np.array(x, dtype=float) for x in zip(*points))
    fitted = quality.pool_adjacent(values, weights)
    assert (np.diff(fitted) >= -1e-12).all()
    # The min-max formula of the same fit.
    n = len(values)
    mean = lambda i, j: np.average(values[i:j + 1], weights=weights[i:j + 1])
    for k in range(n):
        assert abs(fitted[k] - max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1))) < 1e-9


def test_normal_equations_equal_one_solve(spark):
    """The ridge weights from sums of partitions are those of the whole matrix."""
    rows = [(n, ("good words of many kinds " * (n % 7 + 1) + str(n)) if n % 3 else "!! $$ " * (n % 5 + 2)) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(n, int(n % 3 > 0)) for n, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scored = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((scored[n] > 0.5) == (n % 3 > 0) for n, _ in rows)
    stats = np.array([quality.statistics(t) for n, t in rows])
    spread = stats.std(axis=0)
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, np.where(spread > 1e-9, spread, 1.0))
    cos = model.features(stats)[:, :-1]
    z = np.clip((stats - model.mean) / model.scale, -6, 6)
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / (2 * z.shape[1]))
    assert np.abs(cos @ cos.T - kernel).mean() < 0.06


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    rows = [(1, None), (2, ""), (None, "text"), (3, "word " * 200_000), (4, "same"), (4, "same")]
    docs = spark.createDataFrame([(d, t, 1, 0.5) for d, t in rows], "doc_id long, text string, label int, score double")
    labels = lambda *pairs: spark.createDataFrame([(*p, "x") for p in pairs], f"doc_id long, {label} int, text string")
    for given_labels, wanted in (
        (labels(), 0.5), (labels((None, 1), (4, None)), 0.5), (labels((1, 1), (3, 1), (99, 0)), 1.0), (labels((4, 0), (4, 0), (4, 1)), 0.0),
    ):
        model = module.fit(docs, given_labels)
        got = module.score(docs, model).collect()
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 4, 4] and all(abs(r.score - wanted) < 1e-6 for r in got)
    model = module.fit(docs, labels((1, 0), (3, 1), (4, 1)))
    assert all(0 <= r.score <= 1 for r in module.score(docs, model).collect())
    assert module.score(docs.limit(0), model).collect() == []
    filtered = module.keep_good(docs, model, 0.0) if module is quality else module.keep_clean(docs, model, 1.01)
    assert filtered.columns == docs.columns and filtered.count() == 6


def test_labels_bound(spark):
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(3000)], "doc_id long, toxic int")
    from clearway.llm.common import labelled_sample

    assert 200 < labelled_sample(docs, labels, "toxic", 300).count() < 400
    assert labelled_sample(docs, labels, "toxic", 5000).count() == 3000


def test_gram_buckets_do_not_depend_on_slices(monkeypatch):
    text = "some words, einige Wörter und quelques mots " * 50
    whole = np.sort(np.concatenate(list(toxicity.gram_slices(text))))
    monkeypatch.setattr(toxicity, "SLICE", 64)
    assert (np.sort(np.concatenate(list(toxicity.gram_slices(text)))) == whole).all()


def test_commonest_pair_does_not_depend_on_where_it_starts():
    at = quality.STATISTICS.index("commonest_pair")
    assert quality.statistics("a b c a b d")[at] == quality.statistics("x a b c a b")[at] == 2 / 5
    assert quality.statistics("one")[at] == 0
