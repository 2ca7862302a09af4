"""Rows whose codes tell little: nothing near is missed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderbook.llm import ann


def rows(kind, n=2_500, width=24):
    rng = np.random.default_rng(11)
    noise = rng.normal(size=(n, width))
    if kind == "one tight group":
        return rng.normal(size=width) + 1e-3 * noise
    if kind == "tight groups and far rows":
        x = rng.normal(size=(4, width))[rng.integers(0, 4, n)] + 1e-4 * noise
        x[::7] = noise[::7]
        return x
    if kind == "other rows than the sample":
        x = noise.copy()
        x[:, 1:] *= 1e-3
        return x
    return noise * 10.0 ** rng.uniform(-15, 15, (n, 1))


@pytest.mark.parametrize("kind", ["one tight group", "tight groups and far rows", "other rows than the sample", "lengths apart"])
def test_all_of_the_nearest(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "SHARD", 1_500)
    x = rows(kind).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for q in range(0, len(x), 50):
        near = y @ y[q]
        near[q] = -2
        best = np.sort(near)[::-1][:5]
        assert [got[q][k + 1][1] for k in range(5)] == pytest.approx(best.tolist(), abs=1e-14)
        assert [near[got[q][k + 1][0]] for k in range(5)] == pytest.approx(best.tolist(), abs=1e-14)


def test_ties_go_to_the_smaller_id(spark):
    """One direction in many lengths: equal cosines, as far as their rounding goes."""
    rng = np.random.default_rng(3)
    far = rng.normal(size=(400, 8)).tolist()
    frame = spark.createDataFrame([(1_000 + i, [2.0**i, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(-60, 60)] + list(enumerate(far)), "vec_id bigint, embedding array<float>")
    got = ann.nearest(frame, F.col("vec_id") == 1_000).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(940 + i, 1.0) for i in range(5)]
