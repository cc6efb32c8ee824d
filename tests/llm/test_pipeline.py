"""The pipeline's stages, and the queries' SQL."""

import duckdb
import pytest

import corpus_pipeline as pipeline
from canopy.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_chain(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left and left <= ids, name
        ids = left
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_copies_leave_one(spark):
    text = "some words that make a text long enough to have shingles of its own"
    docs = spark.createDataFrame([(3, text, "en"), (1, text.upper(), "en"), (2, text, "en"), (2, text, "en"), (4, "another text with other words in it", "en"), (None, text, "en"), (None, "alone without any id here", "en")], "doc_id bigint, text string, lang string")
    kept = pipeline.copies(spark, docs, DATA).collect()
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in kept) == [(0, "en"), (1, "en"), (4, "en")]


def test_copies_of_repeated_ids(spark):
    a, b = "first text with words enough for shingles of its own here", "second body which has no words like those above it"
    docs = spark.createDataFrame([(3, b), (5, a), (5, b), (5, b), (None, a), (7, None), (8, "")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["text"]) for r in pipeline.copies(spark, docs, DATA).collect()) == [(3, b), (5, a), (7, None)]


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    """Nulls, empty and very long texts, repeated rows and clashing columns; then no rows at all."""
    d = spark.read.parquet(f"{DATA}/documents.parquet").limit(80)
    rows = [tuple(r) + ("x", 1.0, "y") for r in d.collect()]
    text = next(r[d.columns.index("text")] for r in rows if r[d.columns.index("text")])
    at = {c: i for i, c in enumerate(d.columns)}

    def row(i, t):
        out = list(rows[0])
        out[at["doc_id"]], out[at["text"]] = i, t
        return tuple(out)

    odd = [row(None, None), row(None, text), row(900, None), row(901, ""), row(902, text), row(902, text), row(902, "another " + text), row(903, (text + "\n") * (2_000_000 // len(text))), row(904, "abc" * 100_000)]
    docs = spark.createDataFrame(rows + odd, d.schema.add("fingerprint", "string").add("score", "double").add("id", "string"))
    got = stage(spark, docs, DATA)
    seen = got.collect()
    assert {r["doc_id"] for r in seen} <= {r[0] for r in docs.select("doc_id").collect()}
    if name != "packing":
        assert got.columns == docs.columns
    if name in ("line dedup", "packing"):
        assert {r["doc_id"] for r in seen} == {r[0] for r in docs.select("doc_id").collect()}
    if name == "line dedup":
        assert len(seen) == docs.count()
    if name in ("language", "quality"):
        assert sum(r["doc_id"] == 902 and r["text"] == text for r in seen) in (0, 2)
    assert stage(spark, docs.where("false"), DATA).count() == 0


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    rows = lambda df: sorted(map(tuple, df[order].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)
