"""Scoring retrieved scene sets against truth, and the reports built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clearway.functions.numbers import inf, or_false
from clearway.functions.occupancy import POLICY_FREE, POLICY_IGNORED, POLICY_OCCUPIED
from clearway.operators.retrieval import match_matrix, policy_sets, scene_flags
from clearway.plans.catalogue import Query
from clearway.plans.windows import number_rows, numbered_in_order, running_totals

# Decimal places of precision, recall and F1 in a report.
SCORE_PLACES = 3


def with_scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1 to rows with tp, fp, fn.

    An empty result has precision 1, an empty truth recall 1; f1 comes from the unrounded values.
    """
    tp = F.col("tp").cast("double")
    retrieved, relevant = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    rows = counts.withColumn("_p", F.when(retrieved > 0, tp / retrieved).otherwise(1.0)).withColumn(
        "_r", F.when(relevant > 0, tp / relevant).otherwise(1.0)
    )
    both = F.col("_p") + F.col("_r")
    f1 = F.when(both > 0, F.lit(2.0) * F.col("_p") * F.col("_r") / both).otherwise(0.0)
    return rows.withColumns({
        "precision": F.bround("_p", SCORE_PLACES), "recall": F.bround("_r", SCORE_PLACES), "f1": F.bround(f1, SCORE_PLACES),
    }).drop("_p", "_r")


def outcomes(retrieved: DataFrame, truth: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Outer join of retrieved and true scenes: ``keys``, scene and outcome tp / fp / fn.

    The fp and fn rows are the false-positive and false-negative sets, as rows, so they may grow
    without bound; sort them at the sink.
    """
    on = [*keys, "scene"]
    joined = retrieved.select(*on, F.lit(True).alias("_got")).distinct().join(
        truth.select(*on, F.lit(True).alias("_want")).distinct(), on, "full"
    )
    outcome = F.when(F.col("_got") & F.col("_want"), "tp").when(F.col("_got"), "fp").otherwise("fn")
    return joined.select(*on, outcome.alias("outcome"))


def outcome_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")])


def score(retrieved: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """P / R / F1 per row of ``queries`` (query_id); one without any result or truth still gets a row."""
    counts = outcome_counts(outcomes(retrieved, truth), ["query_id"])
    return with_scores(queries.select("query_id").distinct().join(counts, "query_id", "left").fillna(0, ["tp", "fp", "fn"]))


def truth_sizes(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Number of true scenes per query; a query id without labels has the empty set."""
    sizes = truth.distinct().groupBy("query_id").agg(F.count("*").alias("truth_scenes"))
    return queries.select("query_id").distinct().join(sizes, "query_id", "left").fillna(0, ["truth_scenes"])


def query_table(spark: SparkSession, queries: Sequence[Query]) -> DataFrame:
    """The catalogue's metadata as rows."""
    return spark.createDataFrame(
        [(q.id, q.text, q.backend, q.status, q.scope, q.box_expressible, q.is_occupancy) for q in queries],
        "query_id STRING, text STRING, backend STRING, status STRING, scope STRING, "
        "box_expressible BOOLEAN, is_occupancy BOOLEAN",
    )


def coverage(queries: DataFrame) -> DataFrame:
    """How many queries each language can express: all of them by occupancy, the flagged ones by boxes."""
    return queries.agg(
        F.count("*").alias("queries"), F.count("*").alias("occupancy_expressible"),
        F.count_if("box_expressible").alias("box_expressible"),
    )


def sensitivity_report(flags: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query and policy: scores, retrieved and undetermined scene counts, and the stable flag.

    ``flags`` has one row per (query_id, scene) with BOOLEAN columns free and occupied. One outer join
    with the truth serves all three policies; every count combines map-side.
    """
    return _report(flags, truth, queries, F.lit(True))


def _report(flags: DataFrame, truth: DataFrame, queries: DataFrame, by_policy: Column) -> DataFrame:
    """The report of queries that are read under every policy, and (not ``by_policy``) of those read once, as policy "any"."""
    sets = policy_sets(flags).where(F.col(POLICY_FREE) | F.col(POLICY_OCCUPIED))
    labelled = truth.select("query_id", "scene", F.lit(True).alias("_want")).distinct()
    rows = sets.join(labelled, ["query_id", "scene"], "full")
    rows = rows.join(F.broadcast(queries.select("query_id")), "query_id", "left_semi")
    want = or_false(F.col("_want"))
    aggs: list[Column] = [F.count_if(or_false(F.col("undetermined"))).alias("undetermined")]
    policies = (POLICY_FREE, POLICY_OCCUPIED, POLICY_IGNORED)
    for p in policies:
        got = or_false(F.col(p))
        aggs += [F.count_if(got & want).alias(f"tp_{p}"), F.count_if(got & ~want).alias(f"fp_{p}"), F.count_if(~got & want).alias(f"fn_{p}")]
    counts = rows.groupBy("query_id").agg(*aggs)
    full = queries.select("query_id", by_policy.alias("_by_policy")).join(counts, "query_id", "left").na.fill(0)

    def entry(policy: str, source: str) -> Column:
        return F.struct(F.lit(policy).alias("policy"), *[F.col(f"{o}_{source}").alias(o) for o in ("tp", "fp", "fn")])

    entries = F.when(F.col("_by_policy"), F.array(*[entry(p, p) for p in policies])).otherwise(F.array(entry("any", POLICY_FREE)))
    undetermined = F.when(F.col("_by_policy"), F.col("undetermined")).otherwise(0).alias("undetermined")
    long = full.select("query_id", undetermined, F.explode(entries).alias("e")).select("query_id", "undetermined", "e.*")
    return with_scores(long).withColumn("retrieved", F.col("tp") + F.col("fp")).withColumn(
        "unknown_stable", F.col("undetermined") == 0
    )


def baseline_report(flags: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of queries that do not depend on the unknown policy (read under ``free``)."""
    retrieved = flags.where(F.col(POLICY_FREE)).select("query_id", "scene")
    known = truth.join(F.broadcast(queries.select("query_id")), "query_id", "left_semi")
    return score(retrieved, known, queries).withColumn("retrieved", F.col("tp") + F.col("fp"))


def full_report(metrics: DataFrame, queries: Sequence[Query], truth: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """All queries: occupancy ones per policy, baseline ones once (policy ``any``), with their metadata.

    The metrics feed one match matrix, and its rows meet the truth once.
    """
    flags = scene_flags(match_matrix(metrics, queries, scenes), queries)
    table = query_table(metrics.sparkSession, queries)
    return _report(flags, truth, table, F.col("is_occupancy")).join(F.broadcast(table.drop("text")), "query_id")


def measurement_agreement(pairs: DataFrame, measured: str, oracle: str, low: float = 0.75, high: float = 1.25) -> DataFrame:
    """Mean absolute error and tolerance accuracy of a distance column against an oracle column.

    Error and tolerance use the rows where both are finite; the rows where one or both are open are counted.
    """
    a, b = F.col(measured), F.col(oracle)
    finite = (a < inf()) & (b < inf())
    close = finite & (a >= b * F.lit(low)) & (a <= b * F.lit(high))
    return pairs.agg(
        F.count_if(finite).alias("both_finite"),
        F.count_if((a == inf()) & (b == inf())).alias("both_open"),
        F.count_if((a == inf()) != (b == inf())).alias("one_open"),
        F.avg(F.when(finite, F.abs(a - b))).alias("mae"),
        F.count_if(close).alias("within_tolerance"),
        (F.count_if(close) / F.count_if(finite)).alias("tolerance_accuracy"),
    )


def threshold_curve(values: DataFrame, value: str, thresholds: Sequence[float], truth: DataFrame) -> DataFrame:
    """Scores of "value < threshold" for each threshold, from one row per scene.

    ``truth`` has the column scene. Each scene is expanded by the constant list of thresholds.
    """
    want = truth.select("scene", F.lit(True).alias("_want")).distinct()
    rows = values.select("scene", value).join(want, "scene", "full")
    steps = F.array(*[F.lit(float(x)) for x in thresholds])
    rows = rows.withColumn("threshold", F.explode(steps))
    got, true = or_false(F.col(value) < F.col("threshold")), or_false(F.col("_want"))
    counts = rows.groupBy("threshold").agg(
        F.count_if(got & true).alias("tp"), F.count_if(got & ~true).alias("fp"), F.count_if(~got & true).alias("fn")
    )
    return with_scores(counts)


def full_curve(values: DataFrame, value: str, truth: DataFrame) -> DataFrame:
    """Scores of "value < threshold" at every threshold where they change: one row per distinct finite value, and one above all.

    ``values`` has one row per scene, ``truth`` the column scene. The threshold of a row is a distinct value itself; scenes with that
    value are not yet below it, so tied scenes enter together at the next row. The last threshold is infinity and takes in all finite values.
    Any other threshold has the scores of the next row. Open (infinite, missing) values are never retrieved.
    """
    want = truth.select("scene", F.lit(True).alias("_want")).distinct()
    rows = values.select("scene", value).join(want, "scene", "full")
    threshold = F.when((F.col(value) < inf()), F.col(value)).otherwise(inf())
    true = or_false(F.col("_want"))
    steps = rows.groupBy(threshold.alias("threshold")).agg(F.count_if(true).alias("true"), F.count_if(~true).alias("false"))
    # A row above all values, if no scene is open.
    last = values.sparkSession.range(1).select(inf().alias("threshold"), F.lit(0).cast("long").alias("true"), F.lit(0).cast("long").alias("false"))
    steps = steps.unionByName(last).groupBy("threshold").agg(F.sum("true").alias("true"), F.sum("false").alias("false"))
    curve = running_totals(steps, [], ["threshold"], ["true", "false"])
    return with_scores(curve.select(
        "threshold", F.col("before_true").alias("tp"), F.col("before_false").alias("fp"), (F.col("all_true") - F.col("before_true")).alias("fn")))


def average_precision(rows: DataFrame, scores: dict[str, Column], actual: Column) -> DataFrame:
    """How well each score ranks the rows where ``actual`` holds: one row per score.

    Average precision over distinct score values, highest first: the share of the true rows that has each value, times the precision among
    all rows with at least that value. Tied rows count together, so their order does not matter. Rows whose score is NULL come last, together.
    ``chance`` is the precision of an order at random.
    """
    return precision_of(value_counts(rows, scores, actual))


def value_counts(rows: DataFrame, scores: dict[str, Column], actual: Column) -> DataFrame:
    """Rows and true rows by score and value, of which an average precision is made. Those of several tables may be put together."""
    entries = F.array(*[F.struct(F.lit(n).alias("score"), c.cast("double").alias("value")) for n, c in scores.items()])
    long = rows.select(F.explode(entries).alias("e"), or_false(actual).alias("want")).select("e.*", "want")
    return long.groupBy("score", F.coalesce(-F.col("value"), inf()).alias("last")).agg(
        F.count_if("want").alias("true"), F.count("*").alias("n"))


def precision_of(steps: DataFrame) -> DataFrame:
    """The average precision of :func:`value_counts`."""
    ranked = running_totals(steps, ["score"], ["last"], ["true", "n"])
    precision = (F.col("before_true") + F.col("true")) / (F.col("before_n") + F.col("n"))
    return ranked.groupBy("score").agg(
        (F.sum(F.col("true") * precision) / F.sum("true")).alias("average_precision"), (F.sum("true") / F.sum("n")).alias("chance"),
        F.count("*").alias("distinct_values"), F.sum("n").alias("rows"))


def permuted(rows: DataFrame, id_col: str, value: str, mixed: Column, within: Sequence[Column] = (), name: str = "permuted") -> DataFrame:
    """Add column ``name``: ``value`` dealt anew among all rows, or among those that are equal in ``within``.

    The rows are numbered twice over the whole table, in the order of their ids and in the order of ``mixed``, a hash of them; a row gets the
    value of the row with the same number. Numbering splits large groups over tasks, and the two meet by a plain join.
    Ids are distinct.
    """
    classes = [f"_class{n}" for n in range(max(1, len(within)))]
    tagged = rows.withColumns({c: w for c, w in zip(classes, within or (F.lit(0),))})
    plain = number_rows(tagged, classes, [id_col], "_at")
    other = number_rows(tagged.select(*classes, F.col(id_col).alias("_id"), mixed.alias("_mixed"), F.col(value).alias(name)), classes, ["_mixed", "_id"], "_at")
    return plain.join(other.drop("_id", "_mixed"), [*classes, "_at"]).drop(*classes, "_at")


def permuted_in_classes(
    rows: DataFrame, id_col: str, value: str, mixed: Column, within: Mapping[str, Column | None], keep: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """By name, the same dealing as :func:`permuted` within few classes, or over all rows (None): a table of the columns ``keep`` and the new value.

    The rows are ordered once by their ids and once by ``mixed``, whatever the number of dealings, and only a place, its class and the columns
    asked for meet again. ``rows`` is read several times, so hand over written rows.
    """
    classes = {name: f"_class_{name}" for name, c in within.items() if c is not None}
    places = {f"_at_{name}": classes.get(name) for name in within}
    tagged = rows.select(id_col, *dict.fromkeys(c for c in (value, *keep) if c != id_col), *[within[n].alias(c) for n, c in classes.items()])
    plain = numbered_in_order(tagged, [id_col], places, keep)
    other = numbered_in_order(tagged, [mixed, id_col], places, [value])
    out = {}
    for name in within:
        on = [*([classes[name]] if name in classes else []), f"_at_{name}"]
        out[name] = plain.select(*on, *keep).join(other.select(*on, F.col(value).alias(name)), on).select(*keep, name)
    return out


def flag_agreement(rows: DataFrame, flags: dict[str, Column], actual: Column) -> DataFrame:
    """Scores of several BOOLEAN flags against one actual condition, one row per flag.

    Serves the occlusion-depth distrust check: depth > 0 against "not observed by the sensor", next to a
    shuffled-depth and a distance control.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("flag"), c.alias("got"), actual.alias("want")) for n, c in flags.items()])
    long = rows.select(F.explode(entries).alias("e")).select("e.*")
    counts = long.groupBy("flag").agg(
        F.count_if(F.col("got") & F.col("want")).alias("tp"), F.count_if(F.col("got") & ~F.col("want")).alias("fp"),
        F.count_if(~F.col("got") & F.col("want")).alias("fn"),
    )
    return with_scores(counts)
