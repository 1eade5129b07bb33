"""Odd rows and clashing column names in every stage of the pipeline."""

import importlib

import pytest
from tests.llm.test_edges import FIELDS, LONG, PROSE, TEXTS, table

pipeline = importlib.import_module("corpus_pipeline")
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small labels and items beside the documents."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "wizards quietly boxed up"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


ROWS = [*TEXTS, (None, PROSE), (None, None), (1, PROSE), (9, "word")]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_an_empty_table(spark, folder, name):
    out = STAGES[name](spark, table(spark, []), folder)
    assert out.collect() == [] and (name == "packing" or out.columns == FIELDS.names)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_columns_come_through(spark, folder, name):
    """Also those named like an operator's own; the helper's values never show."""
    out = STAGES[name](spark, table(spark, ROWS), folder)
    assert out.schema == FIELDS
    rows = out.collect()
    assert rows and all(v == "c" for r in rows for v in r[2:])


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_what_stays(spark, folder):
    docs = table(spark, ROWS)
    key = lambda rows: sorted((i is None, i or 0) for i in rows)
    after = STAGES["quality rules"](spark, docs, folder)
    assert not set(key([4, 5, 6, 9, 10, 12])) & set(ids(after))
    after = STAGES["line dedup"](spark, docs, folder)
    left = {(r.doc_id, r.text) for r in after.collect()}
    assert {(4, None), (5, ""), (6, "   \n\t "), (None, None), (None, PROSE), (9, "word"), (7, LONG)} <= left
    after = STAGES["near duplicates"](spark, docs, folder)
    assert set(key([4, 5, 6, None])) <= set(ids(after)) and ids(after).count((False, 1)) == 2 and (False, 2) not in ids(after)
    after = STAGES["benchmark decontamination"](spark, docs, folder)
    left = [(r.doc_id, r.text) for r in after.collect()]
    assert {(4, None), (5, ""), (7, LONG), (9, "word")} <= set(left)
    assert not any("quietly boxed" in (t or "") for _, t in left) and any(i == 1 for i, _ in left)
    pieces = STAGES["packing"](spark, docs, folder).collect()
    assert sum(p.start == 0 for p in pieces) == len(ROWS)


def test_tables_with_only_the_needed_columns(spark, folder):
    docs = table(spark, ROWS).select("doc_id", "text")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == ["doc_id", "text"], name
