import random

import pytest
from pyspark.sql import functions as F

from clearway.operators import evaluation as ev
from clearway.plans.windows import running_totals

INF = float("inf")


def brute_curve(values, true):
    finite = sorted({v for v in values.values() if v is not None and v < INF})
    out = {}
    for threshold in [*finite, INF]:
        got = {s for s, v in values.items() if v is not None and v < threshold}
        out[threshold] = (len(got & true), len(got - true), len(true - got))
    return out


def curve(spark, values, true):
    rows = spark.createDataFrame(list(values.items()), "scene string, value double")
    truth = spark.createDataFrame([(s,) for s in true], "scene string")
    return {r.threshold: (r.tp, r.fp, r.fn) for r in ev.full_curve(rows.repartition(5), "value", truth).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_full_curve(spark, seed):
    rng = random.Random(seed)
    values = {f"s{n}": rng.choice([None, INF, *[x / 4 for x in range(12)]]) for n in range(120)}
    true = set(rng.sample(sorted(values), 40)) | {"never measured"}
    assert curve(spark, values, true) == brute_curve(values, true)


def test_full_curve_meets_fixed_thresholds(spark):
    rng = random.Random(5)
    values = {f"s{n}": rng.choice([INF, *[x / 8 for x in range(40)]]) for n in range(100)}
    true = set(rng.sample(sorted(values), 30))
    rows = spark.createDataFrame(list(values.items()), "scene string, value double")
    truth = spark.createDataFrame([(s,) for s in true], "scene string")
    whole = curve(spark, values, true)
    steps = (0.0, 0.3, 0.5, 1.0, 2.01, 100.0)
    for r in ev.threshold_curve(rows, "value", steps, truth).collect():
        assert whole[min(x for x in whole if x >= r.threshold)] == (r.tp, r.fp, r.fn)


def test_full_curve_of_nothing(spark):
    assert curve(spark, {"a": INF, "b": None}, {"a"}) == {INF: (0, 0, 1)}
    assert curve(spark, {"a": 1.0}, set()) == {1.0: (0, 0, 0), INF: (0, 1, 0)}


def brute_precision(scored):
    """Average precision from (score, true) pairs; equal scores at once, missing ones last."""
    total, before, rows, sum_ = sum(t for _, t in scored), 0, 0, 0.0
    for value in sorted({-INF if s is None else s for s, _ in scored}, reverse=True):
        here = [t for s, t in scored if (-INF if s is None else s) == value]
        before, rows = before + sum(here), rows + len(here)
        sum_ += sum(here) * before / rows
    return sum_ / total


def test_average_precision(spark):
    rng = random.Random(3)
    rows = [(n, rng.choice([None, 0, 1, 2, 3, 7]), rng.random() < 0.3) for n in range(300)]
    df = spark.createDataFrame(rows, "id long, score int, want boolean").repartition(4)
    got = {r.score: r for r in ev.average_precision(df, {"score": F.col("score"), "id": F.col("id"), "same": F.lit(1)}, F.col("want")).collect()}
    for name, scored in (("score", [(s, w) for _, s, w in rows]), ("id", [(i, w) for i, _, w in rows]), ("same", [(1, w) for *_, w in rows])):
        assert got[name].average_precision == pytest.approx(brute_precision(scored))
        assert (got[name].rows, got[name].distinct_values) == (300, len({s for s, _ in scored}))
    assert got["same"].average_precision == pytest.approx(got["same"].chance)


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_permuted_over_all_and_within_classes(spark, monkeypatch, limit):
    """Also when a class is larger than one task may sort."""
    monkeypatch.setattr(ev, "number_rows", lambda *a, f=ev.number_rows: f(*a, limit=limit))
    rows = [(n, n * 10, n % 3) for n in range(200)]
    df = spark.createDataFrame(rows, "id long, value long, kind int").repartition(6)
    mixed = F.xxhash64("id")
    for within in ([], [F.col("kind")]):
        got = ev.permuted(df, "id", "value", mixed, within).collect()
        assert sorted(r.id for r in got) == list(range(200)) and sorted(r.permuted for r in got) == [10 * n for n in range(200)]
        assert sum(r.permuted == r.value for r in got) < 20
        if within:
            assert all(r.permuted // 10 % 3 == r.kind for r in got)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_running_totals_split_a_group_over_parts(spark, keys):
    rng = random.Random(9)
    rows = [(rng.choice("aaaab"), n, rng.randint(0, 9)) for n in range(500)]
    df = spark.createDataFrame(rows, "g string, n int, x int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = df.repartitionByRange(*keys, "n").select(F.spark_partition_id()).distinct().count()
        got = running_totals(df, keys, ["n"], ["x"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1
    for r in got:
        mine = [(n, x) for g, n, x in rows if not keys or g == r.g]
        assert r.before_x == sum(x for n, x in mine if n < r.n) and r.all_x == sum(x for _, x in mine)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_permuted_in_classes(spark, batch):
    """Over several parts and batches, for several dealings at once, against lists; a missing class deals with nothing."""
    rng = random.Random(4)
    rows = [(n * 7 % 1009, rng.choice("abc"), n * 10, rng.choice([1, 1, 1, 2, 5, None])) for n in range(600)]
    df = spark.createDataFrame(rows, "id long, kept string, value long, kind int").repartition(6)
    mixed = F.col("id") * 7919 % 1009
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ev.permuted_in_classes(df, "id", "value", mixed, {"all": None, "own": F.col("kind"), "other": F.col("id") % 2}, ["id", "kept"])
        got = {name: sorted(map(tuple, d.collect())) for name, d in got.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def dealt(members):
        plain, other = sorted(members), sorted(members, key=lambda r: (r[0] * 7919 % 1009, r[0]))
        return [(p[0], p[1], o[2]) for p, o in zip(plain, other)]

    assert got["all"] == sorted(dealt(rows))
    assert got["own"] == sorted(x for k in (1, 2, 5) for x in dealt([r for r in rows if r[3] == k]))
    assert got["other"] == sorted(x for k in (0, 1) for x in dealt([r for r in rows if r[0] % 2 == k]))


def test_ranked_rays_are_never_checkpointed(spark, monkeypatch):
    """Checkpoints hold whole rows without compression; only counts by value may go into one."""
    from __spark_entry__ import queries

    sizes = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "checkpoint", lambda self, eager=True, f=kind.checkpoint: sizes.append(self.count()) or f(self, eager))
    out = {r["score"]: r for r in queries()["occlusion_ranking"](spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == 4
    assert max(sizes) <= sum(r["distinct_values"] for r in out.values()) < out["depth"]["rows"] / 4
