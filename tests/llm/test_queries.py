"""Every query against a plain version on the smallest tables."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from tests.llm import brute

from rasterlab.llm import queries as Q


def read(sf_dir, name, columns):
    path = f"{sf_dir}/{name}.parquet"
    return duckdb.sql(f"select {columns} from '{path}{'/*.parquet' if os.path.isdir(path) else ''}' order by 1").fetchall()


@pytest.fixture(scope="module")
def docs(sf_dir):
    return read(sf_dir, "documents", "doc_id, text")


def rows(name, spark, sf_dir):
    return Q.QUERIES[name](spark, sf_dir).collect()


def test_op1(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows("op1_tensored_minhash", spark, sf_dir)}
    want = brute.components(docs)
    assert got == want and any(c != i for i, (_, c) in want.items())


def test_op2(spark, sf_dir, docs):
    out = rows("op2_hypergeometric_shards", spark, sf_dir)
    got = {r.doc_id: (r.size, r.text_crc32) for r in out}
    assert got == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs} and len(out) == len(docs)
    sizes = np.bincount([r["shard"] for r in out], minlength=16)
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 16
    assert sorted((r["shard"], r.slot) for r in out) == [(s, k) for s in range(16) for k in range(sizes[s])]


def test_op3(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows("op3_prefix_doubling", spark, sf_dir)}
    assert got == brute.repeats(docs) and any(r[1] for r in got.values())


def test_op4(spark, sf_dir, docs):
    got = {r.doc_id: r for r in rows("op4_quality_ratio", spark, sf_dir)}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
        assert not (r.kept and r.base_failed)


def test_op5(spark, sf_dir):
    got = {r.page_id: r for r in rows("op5_url_regression", spark, sf_dir)}
    verdicts = {h + p: v for v, h, p in Q.RULES}
    for i, u in read(sf_dir, "pages", "page_id, url"):
        assert (got[i].host, got[i].path, got[i].rule) == brute.url(u, Q.RULES)
        assert got[i].verdict == verdicts.get(got[i].rule, "block" if got[i].block_probability >= 0.5 else "allow")


def test_op6(spark, sf_dir, docs):
    got = {r.doc_id: r for r in rows("op6_markov_secrets", spark, sf_dir)}
    names = ["assign", "access", "hex"]
    for i, t in docs:
        spans = brute.secrets(t)
        base = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert got[i].base_sha256 == brute.sha(",".join(base))
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("markov")] == base


def test_op7(spark, sf_dir, docs):
    want = brute.leaks(docs, read(sf_dir, "benchmark", "item_id, text"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows("op7_suffix_automaton", spark, sf_dir)}
    assert got == {i: (n, h, len(x), brute.sha(",".join(x))) for i, (n, h, x) in want.items()}
    assert any(h for _, h, _ in want.values())


def test_op8(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows("op8_shared_lines", spark, sf_dir)}
    assert got == {i: (n, d, brute.sha(t)) for i, (n, d, t) in brute.lines(docs).items()}


def test_op9(spark, sf_dir, docs):
    out = rows("op9_deleted_interpolation", spark, sf_dir)
    want, n = brute.base_scores(docs)
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known) for r in out} == {i: x[:3] for i, x in want.items()}
    assert len(out) == len(docs) and {r.train_tokens for r in out} == {n}
    assert all(abs(r.base_score - want[r.doc_id][3]) < 1e-6 * max(1, abs(r.base_score)) for r in out)
    # pairs explain unseen texts better than single words
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op10(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(Q.tokenizer_path())
    plain.encode_special_tokens = True
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    out = rows("op10_vector_packing", spark, sf_dir)
    at, used = {}, {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in ids.items()}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048 and sum(used.values()) > 0.95 * 2048 * len(used)


def test_op11(spark, sf_dir, docs):
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in rows("op11_fill_in_middle", spark, sf_dir)}
    want = {i: brute.fill_in_middle(i, t) for i, t in docs}
    assert got == {i: (*want[i][:4], brute.sha(want[i][4]), brute.sha(t or "")) for i, t in docs}
    assert {w[1] for w in want.values()} == {"plain", "spm", "psm"}


def test_op12(spark, sf_dir, docs):
    got = {r.doc_id: r for r in rows("op12_compression_toxicity", spark, sf_dir)}
    assert set(got) == {i for i, _ in docs}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op13(spark, sf_dir):
    got = {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows("op13_shallot_clusters", spark, sf_dir)}
    assert got == brute.clusters(read(sf_dir, "embeddings", "vec_id, embedding"))
