"""The SQL counterparts against the plain versions, on the smallest tables."""

import duckdb
import pytest
from tests.llm import brute

from rasterlab.llm.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(con):
    return con.sql("select doc_id, text from documents").fetchall()


def rows(con, name):
    out = con.sql(ORACLES[name])
    return [dict(zip(out.columns, r)) for r in out.fetchall()]


def test_near_duplicates(con, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(con, "op1_tensored_minhash")}
    assert got == brute.components(docs)


def test_leaks(con, docs):
    want = brute.leaks(docs, con.sql("select item_id, text from benchmark").fetchall())
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows(con, "op7_suffix_automaton")}
    assert got == {i: (n, h, len(x), brute.sha(",".join(x))) for i, (n, h, x) in want.items()}


def test_lines(con, docs):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows(con, "op8_shared_lines")}
    assert got == {i: (n, d, brute.sha(t)) for i, (n, d, t) in brute.lines(docs).items()}


def test_middles(con, docs):
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) for r in rows(con, "op11_fill_in_middle")}
    want = {i: brute.fill_in_middle(i, t) for i, t in docs}
    assert got == {i: (*w[:4], brute.sha(w[4])) for i, w in want.items()}


def test_clusters(con):
    got = {r["vec_id"]: (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows(con, "op13_shallot_clusters")}
    assert got == brute.clusters(con.sql("select vec_id, embedding from embeddings").fetchall())
