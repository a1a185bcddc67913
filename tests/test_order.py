import random

import pytest
from pyspark.sql import functions as F

from clearway import schemas
from clearway.operators import linking, temporal
from clearway.plans.windows import number_rows


def follow(rows):
    """Token order of one scene by walking the links; rows are (token, prev, next) in file order."""
    by_token = {token: nxt for token, _, nxt in rows}
    end = (None, "", "EOF")
    head = next((token for token, prev, _ in rows if prev in end), None)
    if not head:
        return [token for token, _, _ in rows]
    order, token = [], head
    while token and token not in order and token in by_token:
        order.append(token)
        token = by_token[token] if by_token[token] not in end else None
    return order


def poses(spark, scenes):
    rows = []
    for scene, links in scenes.items():
        for pos, (token, prev, nxt, *stamp) in enumerate(links):
            rows.append((scene, token, pos, prev, nxt, stamp[0] if stamp else pos, 0.0, 0.0))
    return spark.createDataFrame(rows, schemas.POSES)


def order_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["scene"], r["t"])):
        out.setdefault(r["scene"], []).append((r["t"], r["token"]))
    for seq in out.values():
        assert [t for t, _ in seq] == list(range(len(seq)))
    return {s: [token for _, token in seq] for s, seq in out.items()}


SCENES = {
    "straight": [("a", None, "b"), ("b", "a", "c"), ("c", "b", None)],
    "shuffled": [("c", "b", "EOF"), ("a", "", "b"), ("b", "a", "c")],
    "cycle": [("a", "EOF", "b"), ("b", "a", "c"), ("c", "b", "b")],
    "to_head": [("a", None, "b"), ("b", "a", "c"), ("c", "b", "a")],
    "dangling": [("a", None, "b"), ("b", "a", "zzz"), ("c", "b", None)],
    "headless": [("b", "a", "c"), ("a", "c", "b"), ("c", "b", "a")],
    "two_heads": [("b", None, "c"), ("a", None, "b"), ("c", "b", None)],
    "single": [("a", None, None)],
    "self": [("a", None, "a"), ("b", None, None)],
    "stamps_lie": [("a", None, "b", 30), ("b", "a", "c", 10), ("c", "b", None, 20)],
}


def test_link_order_cases(spark):
    got = order_of(linking.temporal_order(poses(spark, SCENES)))
    assert got == {s: follow([r[:3] for r in rows]) for s, rows in SCENES.items()}


def test_random_links(spark):
    rng = random.Random(11)
    scenes = {}
    for n in range(25):
        tokens = [f"k{x}" for x in range(rng.randrange(1, 40))]
        chain = tokens[:]
        rng.shuffle(chain)
        nxt = {a: b for a, b in zip(chain, chain[1:])}
        prev = {b: a for a, b in zip(chain, chain[1:])}
        for token in tokens:
            if rng.random() < 0.06:
                nxt[token] = rng.choice([*tokens, "gone", "EOF", ""])
        scenes[f"s{n}"] = [(x, prev.get(x), nxt.get(x), rng.randrange(1000)) for x in tokens]
    got = order_of(linking.temporal_order(poses(spark, scenes)))
    assert got == {s: follow([r[:3] for r in rows]) for s, rows in scenes.items()}


def backwards(spark, n):
    """A chain against the order of its rows."""
    return spark.range(n).select(
        F.lit("s").alias("scene"), F.col("id").cast("string").alias("token"), F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") < n - 1, (F.col("id") + 1).cast("string")).alias("prev"),
        F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("next"),
        F.col("id").alias("ts_us"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"),
    )


@pytest.mark.parametrize("short", [20, 100_000])
def test_long_chain(spark, short):
    got = order_of(linking.chain_order(backwards(spark, 1000), short))["s"]
    assert got == [str(x) for x in range(999, -1, -1)]


def test_contraction_of_odd_links(spark):
    """Chains contracted to a handful of frames, next to scenes with loops, several heads and frames linked to twice."""
    rng = random.Random(5)
    scenes = dict(SCENES)
    for n in range(12):
        tokens = [f"k{x}" for x in range(rng.randrange(1, 60))]
        rng.shuffle(tokens)
        cut = rng.randrange(len(tokens) + 1)
        # A chain from the first token and, behind the cut, a loop or a chain of its own, linked into the first one at times.
        chain, rest = tokens[:cut], tokens[cut:]
        nxt = dict(zip(chain, chain[1:])) | dict(zip(rest, rest[1:]))
        if rest:
            nxt[rest[-1]] = rng.choice([rest[0], "gone", "EOF", *([chain[0], rng.choice(chain)] if chain else [])])
        prev = {b: a for a, b in nxt.items()}
        if chain:
            prev.pop(chain[0], None)
        rows = [(x, prev.get(x), nxt.get(x), rng.randrange(1000)) for x in tokens]
        rng.shuffle(rows)
        scenes[f"s{n}"] = rows
    got = order_of(linking.chain_order(poses(spark, scenes), 5))
    assert got == {s: follow([r[:3] for r in rows]) for s, rows in scenes.items()}


def shuffled_rows(spark, group, run):
    """Rows written to shuffles by the jobs of a call, as Spark counts them."""
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {stage for job in tracker.getJobIdsForGroup(group) for stage in tracker.getJobInfo(job).stageIds}
    rows = 0
    for stage in stages:
        try:
            rows += store.lastStageAttempt(stage).shuffleWriteRecords()
        except Exception as skipped:  # noqa: BLE001 - a stage whose output was there already
            assert "NoSuchElement" in str(skipped)
    return rows


def test_contraction_moves_fewer_rows(spark):
    n = 60_000
    chain = backwards(spark, n)
    heads = linking.scene_heads(chain)
    nodes = linking.materialise(linking.link_nodes(chain, heads))
    ways = {
        "contraction": lambda: linking.contracted_ranks(nodes, heads, 500).agg(F.sum("t")).first()[0],
        "doubling": lambda: linking.doubled_ranks(linking.hops(nodes), heads).agg(F.sum("t")).first()[0],
    }
    rows = {}
    for name, way in ways.items():
        def run():
            assert way() == n * (n - 1) // 2
        rows[name] = shuffled_rows(spark, name, run)
    assert 0 < rows["contraction"] < 0.5 * rows["doubling"], rows


def test_small_scenes_are_walked_in_one_shuffle(spark):
    """However many there are: together they are more than one task may hold of a scene."""
    scenes, frames = 600, 50
    chains = backwards(spark, frames).drop("scene").crossJoin(spark.range(scenes).select(F.col("id").cast("string").alias("scene")))
    chains = linking.materialise(chains.select("scene", "token", "pos", "prev", "next", "ts_us", "tx", "ty"))

    def run():
        got = linking.chain_order(chains, 1000)
        assert got.where(F.col("t") != frames - 1 - F.col("pos")).isEmpty() and got.count() == scenes * frames

    rows = shuffled_rows(spark, "small scenes", run)
    # Once for each of both actions, and counts of scenes.
    assert scenes * frames < rows < 2.5 * scenes * frames, rows


def test_walked_and_split_scenes_agree(spark):
    """Also for equal tokens, missing names and batches that end inside a scene."""
    rng = random.Random(3)
    rows = []
    for n in range(40):
        scene = None if n == 7 else f"s{n}"
        tokens = [rng.choice([None, "", *"abcdefgh"]) if rng.random() < 0.3 else f"k{x}" for x in range(rng.randrange(1, 30))]
        for pos, token in enumerate(tokens):
            near = [tokens[pos + 1] if pos + 1 < len(tokens) else "EOF", rng.choice([*tokens, "gone", "", None])]
            rows.append((scene, token, pos, None if pos == 0 and n % 5 else rng.choice(["x", "x", "x", ""]), near[rng.random() < 0.1], pos, 0.0, 0.0))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, schemas.POSES)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(linking.chain_order(df, 0).collect(), key=str)
    try:
        for size in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for limit in (12, 1000):
                assert sorted(linking.chain_order(df, limit).select(*want[0].__fields__).collect(), key=str) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_number_rows_splits_a_huge_group(spark):
    """The range-partitioned way must equal row_number, with one key holding a third of all rows."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("scene"),
        (F.col("id") * 7919 % 6007).alias("stamp"), "id",
    )
    plain = number_rows(rows, ["scene"], ["stamp", "id"])
    split = number_rows(rows, ["scene"], ["stamp", "id"], limit=100)
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_number_rows_split_with_equal_stamps(spark):
    rows = spark.range(3000).select(F.lit(1).alias("scene"), F.lit(5).alias("stamp"), "id")
    split = number_rows(rows, ["scene"], ["stamp", "id"], limit=100)
    assert split.where("t != id").isEmpty() and split.count() == 3000


def test_speed(spark):
    rows = [
        ("two", 0, 0, 0.0, 0.0), ("two", 1, 500_000, 3.0, 4.0), ("one", 0, 0, 1.0, 1.0),
        ("same", 0, 7, 0.0, 0.0), ("same", 1, 7, 5.0, 0.0), ("back", 0, 2_000_000, 0.0, 0.0), ("back", 1, 1_000_000, 2.0, 0.0),
        ("three", 0, 0, 0.0, 0.0), ("three", 1, 1_000_000, 1.0, 0.0), ("three", 2, 2_000_000, 4.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "scene STRING, t INT, ts_us BIGINT, tx DOUBLE, ty DOUBLE")
    got = {(r["scene"], r["t"]): r["speed"] for r in temporal.ego_speed(df).collect()}
    assert got == {
        ("two", 0): 10.0, ("two", 1): 10.0, ("one", 0): 0.0, ("same", 0): 0.0, ("same", 1): 0.0, ("back", 0): 2.0, ("back", 1): 2.0,
        ("three", 0): 1.0, ("three", 1): 3.0, ("three", 2): 3.0,
    }


def test_speed_across_blocks(spark):
    df = spark.range(10000).select(
        F.lit("s").alias("scene"), F.col("id").cast("int").alias("t"), (F.col("id") * 1_000_000).alias("ts_us"),
        (F.col("id") * F.col("id")).cast("double").alias("tx"), F.lit(0.0).alias("ty"),
    )
    out = temporal.ego_speed(df)
    wrong = out.where(F.col("speed") != F.when(F.col("t") < 9999, 2.0 * F.col("t") + 1).otherwise(2.0 * 9998 + 1))
    assert wrong.isEmpty() and out.count() == 10000


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_first_frame_value(spark, limit):
    df = spark.createDataFrame([("s", 4, 2.0), ("s", 3, 1.0), ("u", 0, 9.0)], "scene STRING, t INT, width DOUBLE")
    assert {r["scene"]: r["width"] for r in temporal.first_frame_value(df, "width").collect()} == {"s": 1.0, "u": 9.0}
