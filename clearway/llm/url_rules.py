"""Block and allow rules for urls by hashed host-suffix and path-prefix expressions.

A url is expanded into the suffixes of its host joined with the prefixes of its path, of the numbers of labels and characters that some rule has. Expressions
and rules meet in an equi-join on a short prefix of their digests; the full digests confirm a hit, and the longest rule
wins. All of it is DataFrame functions; each distinct url is judged once, so a url that fills the table is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Hex digits of a digest that the join compares before the whole digest.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    raw = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, label_counts: list[int]) -> Column:
    """The ends of a host that have one of these numbers of labels; a host of very many labels has no more of them."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.array_compact(F.array(*(F.when(labels >= n, F.substring_index(host, ".", -n)) for n in label_counts)))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has host, path (not empty) and verdict. A rule fits its host and all its subdomains if the url's path starts
    with the rule's path. Of the fitting rules the longest (host and path together) wins, of equally long ones
    the first by name, and of one rule given twice ``block``. Urls that are null or hold no ``://`` have an empty host and path and the default verdict.
    """
    rules = (
        rules.select(F.lower("host").alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict"))
        .where("host <> '' and path <> ''")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # allow < block
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "host", "path"), 256))
        .select("rule", "verdict", F.substring("digest", 1, PREFIX_DIGITS).alias("short"), F.col("digest").alias("rule_digest"),
                F.length("path").alias("path_length"), F.size(F.split("host", r"\.", -1)).alias("labels"))
    )
    # The lengths their paths and the numbers of labels their hosts have: few, however many rules there are.
    sizes = rules.agg(F.collect_set("path_length").alias("lengths"), F.collect_set("labels").alias("labels")).first()
    lengths, label_counts = sorted(sizes.lengths) or [1], sorted(sizes.labels) or [1]
    urls = (
        pages.select(F.col(url_col).cast("string").alias("url")).where(F.col("url").isNotNull()).distinct()
        .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    )
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    expressions = (
        urls.select("url", F.explode(F.flatten(F.transform(
            suffixes(F.col("host"), label_counts), lambda h: F.transform(fitting, lambda n: F.sha2(F.concat_ws("\n", h, F.col("path").substr(F.lit(1), n)), 256)),
        ))).alias("digest"))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    best = (
        expressions.join(rules, "short").where(F.col("digest") == F.col("rule_digest"))
        .groupBy("url").agg(F.min(F.struct((-F.length("rule")).alias("length"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))).alias("best"))
    )
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.join(best, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
