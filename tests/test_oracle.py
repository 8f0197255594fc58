"""Every query against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from lexiloom.plans import fixtures, registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_query_but_two_has_sql():
    assert set(registry.QUERIES) - set(registry.SQL) == {"segment_tokens", "ml_classifier"}


def test_classifier_scores(spark, sf_dir):
    rows = registry.ml_classifier(spark, sf_dir).collect()
    assert rows and all(0 <= r["conf"] <= 1 for r in rows)


def test_layer_9_reads_the_table(spark, sf_dir):
    """Scores weigh on, and refuse, rows of the table; test_same_rows holds each against SQL."""
    rows = {r["doc_id"]: r for r in registry.QUERIES["identify_documents_with_ml"](spark, sf_dir).collect()}
    langs = {r["doc_id"]: r["lang"] for r in registry.documents(spark, sf_dir).select("doc_id", "lang").collect()}
    assert set(langs) <= set(rows) and len(rows) == len(langs) + len(fixtures.TEXTS) + len(fixtures.SCORES)
    refused = {i for i, t in langs.items() if t in ("de", "es") and i % 2 == 0}
    assert refused and all(rows[i]["status"] == "unsupported" and f"language '{langs[i]}'" in rows[i]["reasons"] for i in refused)
    assert sum("Layer 9 (ML classifier) — " in rows[i]["reasons"] for i in set(langs) - refused) > 100
