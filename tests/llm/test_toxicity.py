"""Toxicity: the label model against known rates, held-out accuracy, whole texts, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import entries, toxicity


def drawn(seed, n=60_000, prior=0.2, labelled=0.05, wrong=0.1):
    """Votes of six voters: 0 to 2 independent, 3 to 5 copies of one with noise; few labels, some of them wrong."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < prior
    rates = np.array([[0.02, 0.7], [0.1, 0.6], [0.05, 0.9]])
    votes = [rng.random(n) < np.where(y, b, a) for a, b in rates]
    base = rng.random(n) < np.where(y, 0.6, 0.15)
    votes += [np.where(rng.random(n) < 0.05, ~base, base) for _ in range(3)]
    patterns = sum(v.astype(int) << k for k, v in enumerate(votes))
    labels = np.where(rng.random(n) < labelled, np.where(rng.random(n) < wrong, ~y, y).astype(int), -1)
    keys, counts = np.unique(np.stack([patterns, labels]), axis=1, return_counts=True)
    return y, patterns, labels, keys, counts.astype(float), np.stack([[v[y == z].mean() for z in (False, True)] for v in votes])


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_label_model_finds_rates_and_correlations(seed):
    y, patterns, labels, keys, counts, truth = drawn(seed)
    model = toxicity.LabelModel(6).fit(keys[0], keys[1], counts)
    assert sorted(map(sorted, model.blocks)) == [[0], [1], [2], [3, 4, 5]]
    assert np.abs(model.rates() - truth).max() < 0.04 and abs(model.prior - y.mean()) < 0.02
    assert abs(model.said[0, 1] - 0.1) < 0.04 and abs(model.said[1, 0] - 0.1) < 0.04
    p = model.posterior(patterns, np.full(len(y), -1))
    apart = toxicity.LabelModel(6)
    apart.blocks, floor = [[k] for k in range(6)], toxicity.LEAST_CORRELATION
    toxicity.LEAST_CORRELATION = 2.0  # as if voters were independent
    try:
        q = apart.fit(keys[0], keys[1], counts).posterior(patterns, np.full(len(y), -1))
    finally:
        toxicity.LEAST_CORRELATION = floor
    loss = lambda p: -np.log(np.clip(np.where(y, p, 1 - p), 1e-9, 1)).mean()
    assert ((p >= 0.5) == y).mean() > 0.93 and loss(p) < loss(q)


def test_posterior_labels_overrule_wrong_labels():
    y, patterns, labels, keys, counts, _ = drawn(3)
    p = toxicity.LabelModel(6).fit(keys[0], keys[1], counts).posterior(patterns, labels)
    given = labels >= 0
    assert ((p[given] >= 0.5) == y[given]).mean() > (labels[given] == y[given]).mean() + 0.03


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = entries.QUERIES["op11_toxicity"](spark, folder)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = rows.collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    hit, toxic, told = sum(a == b == 1 for a, b in held), sum(a for a, _ in held), sum(b for _, b in held)
    assert hit >= 0.9 * toxic and hit >= 0.95 * told


def fixture(spark, extra=()):
    clean, toxic = "plain words about weather and harvest " * 4, "plain words zorblax weather grunwick and zorbling harvest " * 3
    docs = [(n, toxic if n % 4 == 0 else clean, "x") for n in range(400)] + list(extra)
    labels = [(n, int(n % 4 == 0)) for n in range(0, 300)]
    return spark.createDataFrame(docs, "doc_id long, text string, votes string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_whole_texts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    late = "quiet words of rain " * 3000 + "zorblax grunwick zorbling " * 3000
    docs, labels = fixture(spark, [(None, None, "x"), (None, "", "x"), (900, late, "x"), (901, "quiet words of rain " * 9000, "x"), (902, "12 34 !!!", None), (903, "zorblax", "x"), (903, "rain", "x")])
    out = toxicity.score_toxicity(docs, labels, lambda i: i % 5 != 0)
    assert out.columns == ["doc_id", "votes", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 407 and {r.predicted for r in rows if r.doc_id in range(400) and r.doc_id % 4 == 0} == {1}
    assert {r.predicted for r in rows if r.doc_id in range(400) and r.doc_id % 4} == {0} and [r.predicted for r in rows if r.doc_id == 900] == [1]
    assert not any(r.predicted for r in rows if r.doc_id in (None, 901, 902)) and [r.votes for r in rows if r.doc_id == 902] == [None]
    again = toxicity.score_toxicity(docs.repartition(7), labels.repartition(3), lambda i: i % 5 != 0).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, round(r.score, 9))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = fixture(spark)
    turned = labels.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, t, lambda i: i % 5 != 0).collect()) for t in (labels, turned))
    assert one == two


def test_without_labels(spark):
    docs, labels = fixture(spark)
    for some in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("toxic = 0")):
        assert {(r.score, r.predicted) for r in toxicity.score_toxicity(docs, some, lambda i: i >= 0).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(docs.limit(0), labels, lambda i: i >= 0).collect() == []
