"""The quality model learns from every labelled row."""

import numpy as np

from riskloom.llm import quality


def test_every_labelled_row_counts(spark, monkeypatch):
    monkeypatch.setattr(quality, "GROUP", 64)
    n, size = 22_000, len(quality.NAMES)
    x = np.random.default_rng(1).normal(size=(n, size)).round(3)
    y = np.arange(n) % 400 == 0  # rare, and known by the first feature
    x[:, 0] = np.where(y, 4, -4)
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "doc_id bigint, y int, x array<double>").repartition(4)
    model = quality.fit(rows)
    assert np.allclose(model["mean"], x.mean(0)) and np.allclose(model["scale"], x.std(0) + 1e-6)
    assert (quality.score(model, x) >= 0.5).tolist() == y.tolist()
    strength = quality.standard(model, x) @ model["w"]
    assert abs(model["cut"] - np.quantile(strength, 1 - y.mean())) < 1e-6
    pairs = quality.differences(rows, model, int(y.sum()), int(n - y.sum()))
    assert pairs.count() >= quality.ROUNDS * (n - y.sum())
