"""Every registered query of the subpackage, run as the driver runs it; those with SQL against DuckDB."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from weftwork.llm import queries

NAMES = {
    "op1_line_dedup", "op2_exact_top_k", "op3_url_filters", "op4_quality_classifier", "op5_minhash_near_dedup", "op6_substring_dedup", "op7_best_fit_packing",
    "op8_document_fingerprints", "op9_chat_formatting", "op10_source_mixing",
}


def test_all_are_registered():
    assert set(queries.QUERIES) == NAMES and {*NAMES, "pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(row[names.index(c)] for c in columns)) for row in found.fetchall()) and got


@pytest.mark.parametrize("name", sorted(NAMES - set(queries.SQL)))
def test_runs_over_its_whole_table(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    table, key = ("pages", "page_id") if name.startswith("op3") else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in df.select(key).collect()} == want


def test_pipeline(spark, sf):
    """Every stage's rows come from its predecessor's, and every kept document is packed without a gap."""
    rows = corpus_pipeline.run(spark, sf).collect()
    known = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert rows and {r.doc_id for r in rows} <= known
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
