"""Samples of rare labels and long texts."""

import numpy as np
from pyspark.sql import functions as F

from ladderbook.llm import quality


def test_rare_labels_and_long_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS", 60)
    rng = np.random.default_rng(3)
    good, bad = ([f"{s}{k}" for k in range(40)] for s in ("good", "bad"))
    rows = [(i, " ".join(rng.choice(good, 20))) for i in range(6000)] + [(10_000 + i, " ".join(rng.choice(bad, 8000))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    assert model is not None
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert min(s for d, s in got.items() if d < 10_000) > max(s for d, s in got.items() if d >= 10_000)
    assert np.mean([s for d, s in got.items() if d < 10_000]) > 0.99
    monkeypatch.setattr(quality, "CHARACTERS", 10)
    assert quality.fit(docs, labels) is not None
