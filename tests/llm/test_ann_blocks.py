"""Query blocks of bounded size."""

import numpy as np
from pyspark.sql import functions as F

from ladderbook.llm import ann


def test_queries_meet_shards_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(ann, "SHARD", 200)
    real = ann._search

    def bounded(shared, shards, *more):
        inner = real(shared, shards, *more)

        def run(left, right):
            assert right.num_rows <= 60 and left.num_rows <= 300
            return inner(left, right)

        return run

    asks = F.col("vec_id") % 4 == 0
    want = ann.nearest(frame, asks).collect()
    monkeypatch.setattr(ann, "_search", bounded)
    monkeypatch.setattr(ann, "BLOCK", 30)
    assert sorted(ann.nearest(frame, asks).collect()) == sorted(want) and len(want) == 750
