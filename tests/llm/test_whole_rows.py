"""op2 shuffles whole documents, not their digests."""

import numpy as np

from rasterlab.llm import queries as Q
from rasterlab.llm import sharding


def test_texts_reach_the_shards(spark, sf_dir, monkeypatch):
    seen = []
    shuffle = sharding.shuffle_to_shards

    def spy(df, *args, **kwargs):
        seen.append(df.columns)
        return shuffle(df, *args, **kwargs)

    monkeypatch.setattr(sharding, "shuffle_to_shards", spy)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    Q.QUERIES["op2_hypergeometric_shards"](spark, sf_dir).collect()
    assert {"doc_id", "text"} <= set(seen[0])
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_long_and_repeated_texts(spark):
    """Blocks of bounded bytes; every text arrives once; a second run gives the same places."""
    rows = [(k, "x" * 50_000 if k % 3 == 0 else "same" if k % 3 == 1 else None if k % 2 else f"own {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id")
    runs = [sharding.shuffle_to_shards(df, shards=4, block_bytes=100_000).collect() for _ in range(2)]
    assert sorted(runs[0]) == sorted(runs[1])
    assert {r.doc_id: r.text for r in runs[0]} == dict(rows) and len(runs[0]) == len(rows)
    sizes = np.bincount([r["shard"] for r in runs[0]], minlength=4)
    assert (sizes == 75).all()
    assert sorted((r["shard"], r.slot) for r in runs[0]) == [(s, k) for s in range(4) for k in range(75)]
