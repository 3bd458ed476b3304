"""Centroid clustering: against plain k-means, on odd rows, and what the trees save."""

import hashlib

import numpy as np
import pytest
from compare import assert_same

from quillspark.llm import clusters, entries


def plain_kmeans(rows, k, rounds, size, scale, seed):
    """Every vector against every centroid, in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(float(x) * scale)) for x in v]))
    name = lambda i: "null" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    if not cents:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        got = [near(v)[1] for _, v in kept]
        for c in set(got):
            own = [v for (_, v), g in zip(kept, got, strict=True) if g == c]
            cents[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [near(v) for _, v in kept]
    per = {c: sum(d for d, g in last if g == c) for _, c in last}
    sha = lambda c: hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
    return [(i, c, d, per[c], sum(per.values()), sha(c)) for (i, _), (d, c) in zip(kept, last, strict=True)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")


def same(found, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("seed,size,k,spread", [(0, 64, 16, 1.0), (1, 2, 7, 1.0), (2, 3, 16, 0.05), (3, 5, 1, 1.0), (4, 2, 40, 1.0)])
def test_equals_plain_kmeans(spark, seed, size, k, spread, monkeypatch):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, size))
    rows = [(n, (middles[n % 6] + spread * 0.3 * rng.normal(size=size)).astype(np.float32).tolist()) for n in range(700)]
    rows += [(n, rows[0][1]) for n in range(700, 900)] + rows[5:9]  # many alike, and repeated rows
    monkeypatch.setattr(clusters, "BLOCK", 128)
    found = clusters.cluster_vectors(table(spark, rows), k=k, rounds=3, size=size, scale=8, seed=1)
    same(found.collect(), plain_kmeans(rows, k, 3, size, 8, 1))


def test_odd_rows(spark):
    ok = [0.5, -0.25]
    rows = [(1, ok), (1, ok), (None, ok), (None, [3.0, 4.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [1.0, 2.0, 3.0]), (9, [-0.01, 0.01])]
    found = clusters.cluster_vectors(table(spark, rows), k=2, rounds=3, size=2, scale=64, seed=1)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same(found.collect(), plain_kmeans(rows, 2, 3, 2, 64, 1))
    assert clusters.cluster_vectors(table(spark, []), size=2).collect() == []
    assert clusters.cluster_vectors(table(spark, rows[4:11]), size=2).collect() == []
    huge = clusters.cluster_vectors(table(spark, [(1, [3e38, 0.0]), (2, ok)]), size=2).collect()
    assert [(r.vec_id, r.distance) for r in huge] == [(2, 0)]


def test_ties_go_to_the_smaller_number():
    points = np.array([[0, 0]] * 70 + [[2, 0]] * 70 + [[4, 0]] * 70, np.int32)
    order, tree = clusters.tree_of(points)
    points = points[order]
    found = np.full(len(points), -1)

    def each(rows, cluster, node):
        found[rows] = cluster

    clusters.assigned(points, tree, np.array([[4, 0], [0, 0], [4, 0], [0, 0]]), each)
    assert [set(found[points[:, 0] == x]) for x in (0, 2, 4)] == [{1}, {0}, {0}]


def test_whole_nodes_are_assigned():
    """On grouped vectors most rows are never compared with a centroid; nodes hold the right rows, boxes and children."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-4000, 4000, (16, 64))
    points = (middles[rng.integers(0, 16, 8000)] + rng.integers(-40, 40, (8000, 64))).astype(np.int32)
    order, tree = clusters.tree_of(points)
    points = points[order]
    assert sorted(order) == list(range(8000))
    for n in range(len(tree["left"])):
        own = points[tree["start"][n] : tree["stop"][n]]
        assert (own.min(0) == tree["lo"][n]).all() and (own.max(0) == tree["hi"][n]).all()
    counts = clusters.assigned(points, tree, middles, lambda *a: None)
    assert counts["whole"] + counts["compared"] == 8000 and counts["whole"] > 7000


def test_query_equals_sql(spark, duck):
    df = entries.QUERIES["op13_centroid_clustering"](spark, "/root/testdata/sf0.001")
    assert_same(df.collect(), df.columns, duck.execute(entries.ORACLES["op13_centroid_clustering"]))
