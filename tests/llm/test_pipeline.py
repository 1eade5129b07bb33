"""The pipeline's stages, each against a plain version of its decisions on its own input."""

import importlib

import pytest
from tests.llm import brute

from rasterlab.session import cut_lineage


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, input, output) of each stage"""
    pipeline = importlib.import_module("corpus_pipeline")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        new = cut_lineage(stage(spark, docs, sf_dir))
        out.append((name, docs, new))
        docs = new
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "line dedup", "near duplicates", "benchmark decontamination", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_quality(stages):
    before, after = texts(stages[0][1]), texts(stages[0][2])
    assert all(after[i] == before[i] for i in after)
    assert not any(brute.quality(t)[-1] for t in after.values())


def test_lines(stages):
    before, after = texts(stages[1][1]), texts(stages[1][2])
    want = {i: t for i, (_, n, t) in brute.lines(list(before.items())).items() if not n or brute.WORD.search(t)}
    assert after == want


def test_near_duplicates(stages):
    before, after = texts(stages[2][1]), texts(stages[2][2])
    want = {i for i, (_, c) in brute.components(list(before.items()), size=5).items() if c == i}
    assert after == {i: before[i] for i in want}


def test_benchmark(stages, spark, sf_dir):
    before, after = texts(stages[3][1]), texts(stages[3][2])
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.leaks(list(before.items()), items)
    assert set(after) == {i for i, (n, h, _) in want.items() if h <= 0.5 * n}
    assert all(after[i] == before[i] for i in after if not want[i][1])
    assert all(len(brute.PLAIN.findall(brute.low(after[i]))) <= want[i][0] - want[i][1] + 1 for i in after)


def test_packing(stages):
    pieces = stages[4][2]
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(texts(stages[4][1]))
