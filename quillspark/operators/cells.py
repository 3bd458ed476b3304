"""Exact nearest vectors without reading them all: cells with a centre and a radius, visited by what they can hold at best.

A vector lies in the cell of the centre it is closest to, a file or more for each cell. An angle between two vectors is at most the sum of the
angles to a third, so no vector of a cell is closer to a query than the centre's angle less the cell's radius. Cells are read in the order of
that bound until ``k`` hits are better than any unread cell can give. Nothing is lost: the result is that of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillspark.functions import vectors as V
from quillspark.operators import retrieval as R
from quillspark.session import ship, small_table, written

ship(__name__)

#: Cells at most, and rows for each cell that its centres are fitted on; what rounding may add to a cosine.
MOST_CELLS, PER_CELL, SLACK = 4096, 16, 1e-9
ZERO = V.ZERO  # for tasks, which get this module by value and not that one
UNIT = 4096  # vectors that many queries meet at once, at most twice as many
ZERO_CELL = -1  # vectors without a direction, which are at cosine 0 to every query


@dataclass
class CellTable:
    """``vectors`` (by ``cell``), and for each cell with a direction its number, centre, least cosine to the centre and number of vectors."""

    vectors: DataFrame
    cell: np.ndarray
    centre: np.ndarray
    least: np.ndarray
    n: np.ndarray
    zeros: int

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest cosine to each of some unit vectors that a vector of each cell can have."""
        angle = np.arccos(np.clip(queries @ self.centre.T, -1, 1)) - np.arccos(np.clip(self.least, -1, 1))[None]
        return np.cos(np.maximum(angle, 0)) + SLACK

    def share(self, cells: list[int]) -> float:
        """The share of all vectors that lies in these cells."""
        total = int(self.n.sum()) + self.zeros
        return float(self.n[np.isin(self.cell, cells)].sum() + (self.zeros if ZERO_CELL in cells else 0)) / max(1, total)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-300)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=True).reshape(-1, size)


def _centres(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """``k`` directions among which a bounded sample is spread."""
    centre = sample[:k].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[at : at + 4096] @ centre.T).argmax(1) for at in range(0, len(sample), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        some = np.sqrt((total**2).sum(1)) > 1e-9
        centre[some] = _unit(total[some])
    return centre


def build_cells(vectors: DataFrame, size: int, cells: int | None = None) -> CellTable:
    """Write ``vectors`` (chunk_id, vector and other columns) by cells; about the square root of their number unless ``cells`` is given, 4,096 at most.

    Vectors of another length, or with a NaN or infinite component, are left out, as no query of this length has a cosine to them; one with a null
    component is at cosine 0, like one of length 0. Centres are
    fitted on 16 rows for each, chosen by a hash of the id; every vector is assigned. An empty table has no cell.
    """
    v = F.col("vector")
    whole, finite = ~F.exists(v, lambda x: x.isNull()), ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False)))
    usable = vectors.filter(F.coalesce((F.size(v) == size) & (~whole | finite), F.lit(False)))
    turned = usable.filter(whole & (V.squared_norm(v) > V.ZERO))
    k = min(MOST_CELLS, cells or max(1, int(usable.count() ** 0.5)))
    rows = turned.select("vector").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(k * PER_CELL).collect()  # 65,536 at most
    sample = _unit(np.array([r.vector for r in rows], np.float64).reshape(-1, size))
    centre = _centres(sample, min(k, len(sample)))
    schema = StructType([*usable.schema.fields, StructField("cell", IntegerType()), StructField("toward", DoubleType())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _matrix(part.column("vector"), size)  # nulls are NaN here
                x[np.isnan(x).any(1)] = 0
                none = (x**2).sum(1) <= ZERO
                near = _unit(x) @ centre.T if len(centre) else np.zeros((len(x), 1))
                own = near.argmax(1)
                toward = near[np.arange(len(x)), own]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.where(none, ZERO_CELL, own).astype(np.int32)), pa.array(toward)], schema.names)

    # by cell and id, so that a cell with many vectors is dealt over tasks
    placed = written(usable.mapInArrow(run, schema), "cells-raw")
    table = written(placed.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id"), "cells", partition_by=("cell",))
    facts = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("toward").alias("least")).collect()}  # a row for each cell
    zeros = facts.pop(ZERO_CELL, None)
    known = sorted(facts)
    least = np.array([facts[c].least for c in known], np.float64) - SLACK
    return CellTable(table, np.array(known, int), centre[known], least, np.array([facts[c].n for c in known], int), zeros.n if zeros else 0)


def visited(table: CellTable, query: list[float], k: int, least: float, boost: float = 1.0, ranked=None) -> list[int]:
    """The cells that a query has to read: those it starts with, and those that may hold a score as good as its ``k`` best so far.

    ``ranked(vectors)`` gives the ``k`` best rows of some vectors, with their ``score``; ``boost`` is the largest factor of a score.
    """
    q = _unit(np.array([query], np.float64))
    best = table.bounds(q)[0] if len(table.cell) else np.zeros(0)
    best = np.where(best > 0, np.maximum(best, np.minimum(0.99, best * boost)), best)
    order = np.argsort(-best, kind="stable")
    upto = int(np.searchsorted(np.cumsum(table.n[order]), 4 * k)) + 1
    first = [int(table.cell[c]) for c in order[:upto] if best[c] >= least]
    found = ranked(table.vectors.filter(F.col("cell").isin(first))).select("score").collect() if first else []  # k rows
    floor = max(least, min(r.score for r in found)) if len(found) >= k else least
    more = [int(table.cell[c]) for c in order[upto:] if best[c] >= floor - SLACK]
    return first + more + ([ZERO_CELL] if table.zeros and floor <= SLACK else [])


def semantic(table: CellTable, query: list[float], k: int = 64, least: float = 0.3, document_boost: float = 1.35, model: str | None = None, where: Column | None = None) -> DataFrame:
    """The rows of ``retrieval.semantic`` from the cells that can hold them."""
    ranked = lambda vectors: R.semantic(vectors, query, k, least, document_boost, model, where)
    if sum(x * x for x in query) <= V.ZERO:
        return ranked(table.vectors).drop("cell", "toward")
    cells = visited(table, query, k, least, document_boost, ranked)
    return ranked(table.vectors.filter(F.col("cell").isin(cells))).drop("cell", "toward")


def _units(table: CellTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Cells joined to units of some thousand vectors: (order of the cells, where each unit starts in it, vectors of each unit, rows of cell, unit, parts).

    Cells that lie close to one another share a unit; a unit beyond twice the aim is cut in parts. Vectors without a direction are the last unit.
    """
    total = int(table.n.sum())
    aim = min(UNIT, max(UNIT // 8, total // 128))
    beside = _centres(table.centre, min(len(table.cell), max(1, total // aim)))
    order = np.lexsort((table.cell, (table.centre @ beside.T).argmax(1) if len(table.cell) else table.cell))
    ahead = (np.cumsum(table.n[order]) - table.n[order]) // aim
    starts = np.flatnonzero(np.diff(ahead, prepend=-1))
    unit = np.cumsum(np.diff(ahead, prepend=-1) > 0) - 1
    held = np.add.reduceat(table.n[order], starts) if len(starts) else np.zeros(0, int)
    if table.zeros:
        held = np.append(held, table.zeros)
    parts = np.maximum(1, -(-held // (2 * aim)))
    placed = [(int(table.cell[c]), int(u), int(parts[u])) for c, u in zip(order, unit, strict=True)]
    return order, starts, held, placed + ([(ZERO_CELL, len(held) - 1, int(parts[-1]))] if table.zeros else [])


def _best_pairs(k: int, size: int, names: list[str]):
    """Rows of a unit's part, its vectors by id and then the queries that ask it, to (query_id, chunk_id, cosine): those that may be among a query's ``k`` best.

    A matrix product tells which pairs may be; the cosine of these is summed component by component, as ``vectors.dot`` does. Of equal vectors the first
    ``k`` ids are enough. A task holds the vectors of one part and 256 queries.
    """

    def prepared(held: list[pa.RecordBatch]):
        ids = pa.concat_arrays([b.column("chunk_id") for b in held])
        x = np.concatenate([_matrix(b.column("vector"), size) for b in held])
        x[np.isnan(x).any(1)] = 0
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * size))).ravel(), return_inverse=True)[1].ravel()
        by = np.argsort(same, kind="stable")
        first = np.flatnonzero(np.diff(same[by], prepend=-1))
        place = np.arange(len(by)) - np.repeat(first, np.diff(first, append=len(by)))
        kept = np.sort(by[place < k])
        x, ids = x[kept], ids.take(pa.array(kept))
        norm = np.zeros(len(x))
        for d in range(size):
            norm += x[:, d] * x[:, d]
        length = np.where(norm > ZERO, np.sqrt(norm), np.inf)
        return ids, x, length, x / length[:, None]

    def met(part: pa.RecordBatch, ids, x, length, turned):
        q, floor = _matrix(part.column("vector"), size), part.column("floor").to_numpy(zero_copy_only=False)
        about = q @ turned.T
        least = np.maximum(floor, np.partition(about, -k, axis=1)[:, -k]) if len(x) > k else floor
        row, col = np.nonzero(about >= least[:, None] - 4 * SLACK)
        total = np.zeros(len(row))
        for d in range(size):
            total += q[row, d] * x[col, d]
        return pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row)), ids.take(pa.array(col)), pa.array(total / length[col])], names)

    def run(batches):
        key, held, ready = None, [], None
        for b in batches:
            at = np.stack([b.column(n).to_numpy() for n in ("unit", "part", "side")])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if tuple(at[:2, lo]) != key:
                    key, held, ready = tuple(at[:2, lo]), [], None
                if at[2, lo] == 0:
                    held.append(b.slice(lo, hi - lo))
                    continue
                if held and ready is None:
                    ready = prepared(held)
                for k_ in range(lo, hi, 256) if ready else ():
                    yield met(b.slice(k_, min(256, hi - k_)), *ready)

    return run


def nearest(table: CellTable, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, cosine, rank): the ``k`` vectors nearest to each of many queries (query_id, vector), ties by chunk_id.

    Queries may be any number: each first meets the cells of the best bounds that have ``2 * k`` vectors, then those that can still hold one of its
    ``k`` best. Cells are met in units of some thousand vectors, a matrix product for the queries that ask one. Queries of another length, with a null,
    NaN or infinite component, or of length 0 give no rows.
    """
    spark, size = queries.sparkSession, table.centre.shape[1]
    v = F.col("vector")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = queries.select("query_id", "vector").filter(F.coalesce((F.size(v) == size) & fine, F.lit(False)) & (V.squared_norm(v) > V.ZERO))
    unit = usable.select("query_id", V.normalised(v).alias("vector")).repartition(spark.sparkContext.defaultParallelism)
    order, starts, held, placed = _units(table)
    if not placed:
        placed = [(ZERO_CELL, 0, 1)]
    parts = np.array([p for _, p in sorted({(u, p) for _, u, p in placed})])
    bounded = CellTable(None, table.cell, table.centre, table.least, table.n, table.zeros)  # what tasks need: at most 4,096 centres
    kind = {f.name: f.dataType for f in [*queries.schema.fields, *table.vectors.schema.fields]}
    asks = StructType([StructField("unit", IntegerType()), StructField("part", IntegerType()), StructField("query_id", kind["query_id"]), unit.schema["vector"], StructField("floor", DoubleType())])

    def asking(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                piece = b.slice(at, 128)
                floor = piece.column("floor").to_numpy(zero_copy_only=False)[:, None]
                cell = bounded.bounds(_matrix(piece.column("vector"), size))[:, order]
                best = np.maximum.reduceat(cell, starts, axis=1) if len(starts) else cell
                if bounded.zeros:
                    best = np.concatenate([best, np.full((len(best), 1), SLACK)], 1)
                down = np.argsort(-best, axis=1, kind="stable")
                begun = np.zeros(best.shape, bool)
                np.put_along_axis(begun, down, np.cumsum(held[down], 1) - held[down] < 2 * k, 1)
                row, u = np.nonzero(np.where(np.isnan(floor), begun, best >= floor - SLACK))
                times = parts[u]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                taken = pa.array(np.repeat(row, times))
                cols = [pa.array(np.repeat(u, times).astype(np.int32)), pa.array(part.astype(np.int32))]
                floors = pa.array(np.nan_to_num(np.repeat(floor[row, 0], times), nan=-2.0))
                yield pa.RecordBatch.from_arrays([*cols, piece.column("query_id").take(taken), piece.column("vector").take(taken), floors], asks.names)

    cells = table.vectors.select("cell", "chunk_id", F.col("vector").cast("array<double>").alias("vector")).join(F.broadcast(small_table(spark, placed, "cell int,unit int,parts int")), "cell")
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int").alias("part")
    vectors = cells.select("unit", part, F.lit(0).alias("side"), "chunk_id", F.lit(None).cast(kind["query_id"]).alias("query_id"), "vector", F.lit(None).cast("double").alias("floor"))
    found = StructType([StructField("query_id", kind["query_id"]), StructField("chunk_id", kind["chunk_id"]), StructField("cosine", DoubleType())])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id"))

    def ranked(asked: DataFrame) -> DataFrame:
        rows = asked.mapInArrow(asking, asks).select("unit", "part", F.lit(1).alias("side"), F.lit(None).cast(kind["chunk_id"]).alias("chunk_id"), "query_id", "vector", "floor")
        dealt = vectors.unionByName(rows).repartition("unit", "part").sortWithinPartitions("unit", "part", "side", "chunk_id")
        pairs = dealt.mapInArrow(_best_pairs(k, size, found.names), found).withColumn("cosine", F.round("cosine", 9))
        return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)

    first = written(ranked(unit.withColumn("floor", F.lit(float("nan")))), "near-first")
    floors = first.filter(F.col("rank") == k).select("query_id", F.col("cosine").alias("floor"))
    return ranked(unit.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))))
