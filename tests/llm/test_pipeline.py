import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from clearway.llm import near_copies, packing, quality, secret_scan, toxicity
from clearway.llm.common import BATCH_BYTES
from clearway.llm.queries import QUALITY_THRESHOLD, TOXIC_THRESHOLD, fold, tokenizer_path

FOLDER = "/root/testdata/sf0.01"


def test_every_stage_takes_effect(spark):
    """Each stage against its operator's own result on what the stage before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "toxicity", "SimHash near-dedup", "secret scans", "best-fit packing"]

    def after(name, before):
        out = steps[name](spark, before, FOLDER)
        assert out.columns == columns
        return spark.createDataFrame(out.collect(), docs.schema)

    good = after("quality classifier", docs)
    scores = quality.score(docs, quality.fit(docs, labels.where(fold("doc_id", 5) != 0))).collect()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores if r.score >= QUALITY_THRESHOLD}

    clean = after("toxicity", good)
    scores = toxicity.score(good, toxicity.fit(good, labels.where(fold("doc_id", 3) != 1))).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores if r.score < TOXIC_THRESHOLD}

    single = after("SimHash near-dedup", clean)
    groups = near_copies.groups(clean).collect()
    lowest = {}
    for r in groups:
        lowest[r.component] = min(r.id, lowest.get(r.component, r.id))
    assert sorted(r.doc_id for r in single.collect()) == sorted(lowest.values())

    masked = after("secret scans", single)
    assert masked.count() == single.count() and all(r.n_chars == len(r.text) for r in masked.collect())
    assert all(not r.found for r in secret_scan.find_secrets(masked).collect())

    packed = steps["best-fit packing"](spark, masked, FOLDER).collect()
    pieces = packing.token_pieces(masked, tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


def test_run_is_the_stages_in_order(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    key = lambda r: (r.doc_id, r.piece, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, docs.collect()))


def test_workers_get_texts_in_small_batches(spark):
    """What a task holds of long texts or large tiles is bounded by bytes, not by 10 000 rows; a smaller bound of the user stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    long_texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    spark.conf.unset(key)
    try:
        for _, stage in corpus_pipeline.STAGES[3:]:
            spark.conf.unset(key)
            stage(spark, long_texts.limit(1), FOLDER)
            most = max(r.bytes for r in long_texts.mapInArrow(sizes, "bytes long").collect())
            assert BATCH_BYTES // 2 < most <= 2 * BATCH_BYTES
        spark.conf.set(key, "1m")
        corpus_pipeline.mask_secrets(spark, long_texts, FOLDER)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
