"""Registered queries on the small tables: with SQL where there is any, and the pipeline."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from salesmix.llm import queries
from tests.compare import database, difference
from tests.llm import brute


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.fixture(scope="module")
def texts(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_with_sql(name, spark, sf_dir, con):
    got = queries.REGISTRY[name](spark, sf_dir).toPandas()
    assert difference(got, con.execute(queries.ORACLE[name]).df()) == ""


def test_op2(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_minhash_dedup(spark, sf_dir).collect()}
    assert got == brute.near_copies(texts)


def test_op4(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, sf_dir).collect()}
    assert got == brute.repeats(texts, 400)


def test_op6(spark, sf_dir, texts):
    got = queries.op6_best_fit_packing(spark, sf_dir).collect()
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size == {i: len((t or "").encode().split()) for i, t in texts}


def test_op8(spark, sf_dir, con):
    got = {r.page_id: r.text for r in queries.op8_html_text(spark, sf_dir).collect()}
    pages = con.execute("SELECT page_id, html FROM pages").fetchall()
    assert len(got) == len(pages)
    assert sum("track(" in t or "\xa9" in t for t in got.values()) == 0
    assert sum(bool(t) for t in got.values()) == len(pages)


def test_op9(spark, sf_dir, con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op9_embedding_dedup(spark, sf_dir).collect()}
    assert got == brute.linked_vectors(rows, 0.9)


def test_op10(spark, sf_dir, con):
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_pipeline_against_plain_stages(spark, sf_dir, texts):
    """Every stage's result from what the stage before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    scores = {r.doc_id: r.score for r in queries.op10_toxicity(spark, sf_dir).collect()}
    state = [(i, t) for i, t in texts if scores[i] < queries.TOXIC_FROM]
    stages = dict(corpus_pipeline.STAGES)

    def run(name, df):
        out = corpus_pipeline.stored(stages[name](spark, df, sf_dir), name)
        return out, sorted((r.doc_id, r.text) for r in out.collect()) if "text" in out.columns else out.collect()

    docs, got = run("toxicity", docs)
    assert got == sorted(state) and docs.columns == columns
    want = brute.later_lines(state, 10)
    state = [(i, want[i]) for i, t in state if (want[i] or "").strip(" ") or not (t or "").strip(" ")]
    docs, got = run("line_dedup", docs)
    assert got == sorted(state) and docs.columns == columns
    comps = brute.near_copies(state)
    state = [(i, t) for i, t in state if comps[i][1] == i]
    docs, got = run("minhash_dedup", docs)
    assert got == sorted(state) and docs.columns == columns
    cut = brute.repeats(state, 400)
    docs, got = run("suffix_dedup", docs)
    assert [i for i, _ in got] == sorted(i for i, _ in state) and docs.columns == columns
    for i, t in got:
        assert hashlib.sha256((t or "").encode()).hexdigest() == cut[i][3] or cut[i][1]
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
    _, packed = run("best_fit_packing", docs)
    size = {}
    for r in packed:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size == {i: len((t or "").encode().split()) for i, t in got}
