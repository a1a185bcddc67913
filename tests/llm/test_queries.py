"""The registered queries: their columns, and those with SQL against it."""

import pytest

import oracle_check
from clearway.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2": "doc_id bigint, fingerprint string, component_id bigint",
    "op3": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5": "doc_id bigint, ids array<int>, n_ids bigint, decoded_sha256 string",
    "op6": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8": "page_id bigint, host string, path string, rule string, verdict string",
    "op9": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op13": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op11": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op12": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op10": "page_id bigint, url string, text string, n_chars bigint",
}


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    wanted = dict(c.split(" ") for c in COLUMNS[name.split("_")[0]].split(", "))
    assert {c: kinds.get(c) for c in wanted} == wanted
    key = next(iter(wanted))
    table = {"doc_id": "documents", "vec_id": "embeddings", "page_id": "pages"}[key]
    rows, ids = df.count(), spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key)
    assert rows == ids.count() or name.startswith(("op9", "op12")) and rows >= ids.count()
    assert df.select(key).distinct().exceptAll(ids).isEmpty()


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, con, name):
    ok, message = oracle_check.compare(spark, con, name, FOLDER)
    assert ok, message
