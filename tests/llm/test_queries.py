"""The registered queries against their SQL on small tables."""

import pytest

from checks.compare import duck, sorted_rows
from copyloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(middle):
    return duck(middle)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, connection, middle, name):
    found = QUERIES[name](spark, middle)
    result = connection.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(names, result.fetchall())


#: The columns that each query owes, with their types.
CONTRACT = {
    "op1_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op2_html": "page_id bigint, url string, text string, n_chars bigint",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7_substrings": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op11_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_forest": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op13_tries": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


def test_every_operator_is_registered_once():
    assert list(QUERIES) == list(CONTRACT)


@pytest.mark.parametrize("name", list(CONTRACT))
def test_columns(spark, small, name):
    found = QUERIES[name](spark, small)
    assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == CONTRACT[name]


def test_queries_without_sql_against_brute_force(spark, small):
    from .test_html_text import plain
    from .test_mixing import check
    from .test_substrings import brute, result

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert result(QUERIES["op7_substrings"](spark, small)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    check(docs, QUERIES["op9_mixing"](spark, small))
    pages = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in QUERIES["op2_html"](spark, small).collect()} == pages
    scores = QUERIES["op3_quality"](spark, small).toPandas()
    assert len(scores) == docs.count() and ((scores.score >= 0.3) == (scores.predicted == 1)).all()
