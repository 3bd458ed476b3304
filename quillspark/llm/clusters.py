"""Exact integer k-means by kd-trees: whole nodes go to a centroid where no other can win.

Vectors become integers, ``floor(scale * x)``. Every scan partition packs its vectors into blocks of at most ``BLOCK`` rows, each with a kd-tree
that holds for every node its rows, their integer sums and their box; the blocks are written once and read by each round. A round walks the
trees from the root: among the centroids still possible for a node, the one nearest to the middle of its box rules out all others that are
strictly farther at the corner of the box that suits them best. A node left with one centroid adds its count and sums as a whole; a leaf left
with more compares its rows with each. Sums and squared distances are integers, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship, small_table, written

ship(__name__)

BLOCK, LEAF = 8192, 32
#: No squared distance of 64 components of this size leaves a long; sums of them are made in decimals, and one beyond a long is null in the result.
MOST = 1 << 26
#: Pairs of node and centroid whose boxes are compared at once.
TILE = 1 << 12


def whole_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v`` (integers) of the rows with exactly ``size`` components, none null, NaN or infinite.

    A row with a component beyond 2**26 after scaling is left out, as no long holds its distances.
    """
    x = F.col("embedding")
    usable = (F.size(x) == size) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(F.floor(e.cast("double") * scale).cast("double")) > MOST))
    kept = vectors.filter(F.coalesce(usable, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``<seed>:<vec_id>``; rows without an id come last, rows of one id by their components."""
    h = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256), F.lit("null"))
    return np.array([r.v for r in vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def tree_of(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the rows in the tree, and its nodes: ``lo`` and ``hi`` (box), ``start``, ``stop`` (rows), ``left`` (first child, -1 for a leaf).

    A node is split at the median of its widest dimension; rows that are all alike are a leaf however many they are.
    """
    order = np.arange(len(points))
    start, stop, left, lo, hi = [0], [len(points)], [], [], []
    n = 0
    while n < len(start):
        a, b = start[n], stop[n]
        own = points[order[a:b]]
        low, high = own.min(0), own.max(0)
        lo.append(low), hi.append(high)
        dim = int(np.argmax(high - low))
        if b - a <= leaf or low[dim] == high[dim]:
            left.append(-1)
        else:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, dim], mid)]
            left.append(len(start))
            start += [a, a + mid]
            stop += [a + mid, b]
        n += 1
    return order, {"lo": np.array(lo, np.int32), "hi": np.array(hi, np.int32), "start": np.array(start, np.int32), "stop": np.array(stop, np.int32), "left": np.array(left, np.int32)}


def assigned(points: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray, each) -> dict[str, int]:
    """Walk a tree: ``each(rows, cluster)`` is called with a slice and a number for a whole node, with an array of rows and one of clusters for leaves.

    Gives how many rows went as whole nodes and how many were compared.
    """
    k = len(centroids)
    nodes, possible = np.zeros(1, np.int64), np.ones((1, k), bool)
    whole = compared = 0
    while len(nodes):
        later, masks = [], []
        for at in range(0, len(nodes), max(1, TILE // k)):
            own, can = nodes[at : at + max(1, TILE // k)], possible[at : at + max(1, TILE // k)].copy()
            lo, hi = tree["lo"][own].astype(np.int64), tree["hi"][own].astype(np.int64)
            far = ((2 * centroids[None] - (lo + hi)[:, None]) ** 2).sum(2)
            far[~can] = np.iinfo(np.int64).max
            best = centroids[far.argmin(1)][:, None]
            corner = np.where(centroids[None] > best, hi[:, None], lo[:, None])
            can &= ((centroids[None] - corner) ** 2).sum(2) <= ((best - corner) ** 2).sum(2)  # equal distances are left to the leaves
            alone = can.sum(1) == 1
            for n, c in zip(own[alone], can[alone].argmax(1), strict=True):
                each(slice(tree["start"][n], tree["stop"][n]), int(c), int(n))
                whole += int(tree["stop"][n] - tree["start"][n])
            point, leaf = ~alone & (lo == hi).all(1), ~alone & (tree["left"][own] < 0)
            for n, mask in zip(own[leaf | point], can[leaf | point], strict=True):
                few, rows = np.flatnonzero(mask), slice(tree["start"][n], tree["stop"][n])
                mine = points[rows].astype(np.int64) if tree["lo"][n].tolist() != tree["hi"][n].tolist() else tree["lo"][n][None].astype(np.int64)
                near = few[((mine[:, None] - centroids[few][None]) ** 2).sum(2).argmin(1)]  # the first of equal distances is the smaller number
                if len(near) == 1:
                    each(rows, int(near[0]), int(n))
                else:
                    each(np.arange(rows.start, rows.stop), near, None)
                compared += len(mine)
            inner = ~alone & ~leaf & ~point
            first = tree["left"][own[inner]].astype(np.int64)
            later.append(np.concatenate([first, first + 1]))
            masks.append(np.concatenate([can[inner]] * 2))
        nodes, possible = np.concatenate(later), np.concatenate(masks)
    return {"whole": whole, "compared": compared}


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """One row for each block of vectors: ids, integers in tree order, nodes with their sums; at most ``BLOCK`` rows, a few MB."""

    def packed(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        order, tree = tree_of(points)
        points = points[order]
        upto = np.concatenate([np.zeros((1, size), np.int64), np.cumsum(points, axis=0, dtype=np.int64)])
        sums = upto[tree["stop"]] - upto[tree["start"]]
        row = {"n": len(points), "points": points.tobytes(), "sums": sums.tobytes()} | {name: a.tobytes() for name, a in tree.items()}
        ids = ids.take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64()))] + [pa.array([v]) for v in row.values()], ["ids", *row])

    def run(batches):
        ids, held, n = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                if n + part.num_rows > BLOCK:
                    yield packed(pa.concat_arrays(ids), np.concatenate(held))
                    ids, held, n = [], [], 0
                ids.append(part.column(0))
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, size))
                n += part.num_rows
        if n:
            yield packed(pa.concat_arrays(ids), np.concatenate(held))

    schema = "ids array<long>, n long, points binary, sums binary, lo binary, hi binary, start binary, stop binary, left binary"
    return vectors.mapInArrow(run, schema)


def _opened(b: pa.RecordBatch, k: int, size: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    raw = lambda name, kind: np.frombuffer(b.column(name)[k].as_py(), kind)
    tree = {name: raw(name, np.int32) for name in ("start", "stop", "left")} | {name: raw(name, np.int32).reshape(-1, size) for name in ("lo", "hi")}
    return raw("points", np.int32).reshape(-1, size), raw("sums", np.int64).reshape(-1, size), tree


def _round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means, empty ones as they were."""
    k, size = centroids.shape

    def run(batches):
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for r in range(b.num_rows):
                points, sums, tree = _opened(b, r, size)

                def each(rows, cluster, node, points=points, sums=sums):
                    if node is None:
                        for c in np.unique(cluster):
                            total[c] += points[rows[cluster == c]].sum(0, dtype=np.int64)
                            count[c] += (cluster == c).sum()
                    else:
                        total[cluster] += sums[node]
                        count[cluster] += rows.stop - rows.start

                assigned(points, tree, centroids, each)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some], pa.int64()), "s": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    parts = blocks.select("points", "sums", "lo", "hi", "start", "stop", "left").mapInArrow(run, "cluster int, n long, s array<long>")
    each = F.posexplode("s").alias("dim", "x")
    summed = parts.select("cluster", "n", each).groupBy("cluster", "dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in summed.collect():  # k * size rows
        out[r.cluster, r.dim] = int(r.s) // int(r.n)
    return out


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each vector that has ``size`` finite components.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are left out, whatever they are called. Rows with a null vector, a null or non-finite
    component or another number of them are left out, as are those beyond 2**26 (see ``whole_vectors``); a row without an id is a vector like any
    other, but comes last where centroids are chosen. Repeated rows count each. Equal distances go to the smaller number. With fewer vectors than
    ``k`` each is a centroid; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, size, scale)
    centroids = first_centroids(kept, k, seed)
    columns = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{columns}, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = written(_blocks(kept, size), "kd-blocks")
    for _ in range(rounds):
        centroids = _round(blocks, centroids)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                points, _, tree = _opened(b, r, size)
                found = np.zeros(len(points), np.int32)

                def each(rows, cluster, node, found=found):
                    found[rows] = cluster

                assigned(points, tree, centroids, each)
                far = ((points.astype(np.int64) - centroids[found]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("ids")[r].values, pa.array(found), pa.array(far)], ["vec_id", "cluster", "distance"])

    done = written(blocks.select("ids", "points", "sums", "lo", "hi", "start", "stop", "left").mapInArrow(run, columns), "clustered")
    per = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    named = [(c, s, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(per.items())]
    facts = small_table(spark, named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
