"""SimHash near-duplicates: fingerprints, pivot distance tables, connected components.

A fingerprint has ``64 * lanes`` bits. The first lane hashes the shingles by XXH64
with seed 42, the others mix that hash anew. Fingerprints link at ``radius`` or fewer differing bits.

Every different fingerprint has a row in the pivot distance table: its Hamming distances to fixed reference fingerprints,
computed once. By the triangle inequality the coordinates of a linked pair differ by ``radius`` at most, so a pair with a larger
difference anywhere is discarded unseen, and survivors are verified.

Pairs are looked for in buckets of equal bits, so that the work does not grow with the square of the corpus: a fingerprint is cut
into blocks, of which a linked pair differs in ``radius`` at most, so it agrees in all blocks of one of the choices that leave out
``radius`` of them, and no link is lost. The number of blocks follows from the number of fingerprints and changes the work only.
A bucket gives a spanning forest of its links, never all pairs. Buckets larger than ``chunk`` are cut in chunks and
every pair of chunks is a task of its own.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.skew import heavy_keys, heavy_of, skew_join
from quillspark.session import ship, written

ship(__name__)


def fingerprint(text: str | None, shingle: int, lanes: int) -> bytes:
    """Big-endian fingerprint of one text; without words it is zero."""
    words = (text or "").encode().lower().split()  # bytes: ASCII rules for blanks and case
    if not words:
        return bytes(8 * lanes)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= shingle:
        grams = [joined]
    else:
        starts = [0, *[e + 1 for e in ends]]
        grams = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    ones = np.zeros((lanes, 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(grams), 65536):  # memory is bounded for any length of text
        h = np.array([digest(g, 42) for g in grams[k : k + 65536]], dtype=np.uint64)
        for lane in range(lanes):
            v = h if lane == 0 else _mixed(h + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64))
            ones[lane] += np.unpackbits(v.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(grams), axis=1).tobytes()


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, fp): fp is a hexadecimal string of 16 digits for each lane."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle, lanes).hex() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.string())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp string")


def pivots(lanes: int, n: int = 16) -> np.ndarray:
    """The reference fingerprints: fixed pseudorandom bits."""
    return np.random.default_rng(20240229).integers(0, 2**64, size=(n, lanes), dtype=np.uint64)


def pivot_table(v: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint (row of ``v``) to every pivot."""
    return np.stack([np.bitwise_count(v ^ r).sum(axis=1, dtype=np.int16) for r in refs], axis=1)


def _labels(root: np.ndarray) -> np.ndarray:
    """Everyone's root, by pointer jumping."""
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def near_links(tile: np.ndarray, side: np.ndarray, v: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a spanning forest of the pairs within ``radius`` inside each tile; rows of one tile that are on sides 0 and 1 are compared
    across the sides only, side -1 meets all.

    Rows are ordered by tile and distance to the first pivot, and each is held against the next, the one after it, and so on while
    that distance differs by ``radius`` at most. Pairs that are joined already are passed over.
    """
    order = np.lexsort((table[:, 0], tile))
    tile, side, v, table = tile[order], side[order], v[order], table[order]
    root, out, alive, step = np.arange(len(order)), [], np.arange(len(order)), 0
    while True:
        step += 1
        alive = alive[alive + step < len(order)]
        alive = alive[(tile[alive] == tile[alive + step]) & (table[alive + step, 0] - table[alive, 0] <= radius)]
        if not len(alive):
            break
        apart = (root[alive] != root[alive + step]) & ((side[alive] < 0) | (side[alive] != side[alive + step]))
        i = alive[apart]
        i = i[np.abs(table[i] - table[i + step]).max(axis=1, initial=0) <= radius]
        i = i[np.bitwise_count(v[i] ^ v[i + step]).sum(axis=1) <= radius]
        for a, b in zip(i.tolist(), (i + step).tolist(), strict=True):
            ra, rb = a, b
            while root[ra] != ra:
                ra = root[ra]
            while root[rb] != rb:
                rb = root[rb]
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        if len(i):
            root = _labels(root)
    pairs = order[np.array(out, dtype=np.int64).reshape(-1, 2)]
    return pairs[:, 0], pairs[:, 1]


def blocks_for(n: int, radius: int, lanes: int) -> int:
    """The number of blocks that costs least for ``n`` fingerprints: rows for each choice of blocks against pairs in their buckets.

    Fixed weights: a row costs some 200 times a pair, and buckets of texts hold some 50 times the pairs of evenly spread ones.
    """

    def cost(blocks: int) -> float:
        keys, bits = math.comb(blocks, radius), 64 * lanes * (blocks - radius) // blocks
        return keys * n * (200 + 50 * n / 2 ** (bits + 1))

    return min(range(radius + 1, radius + 6), key=cost)


def bucket_keys(lanes: int, radius: int, blocks: int) -> np.ndarray:
    """A mask of bits for each choice of blocks - radius of the blocks."""
    parts = np.array_split(np.arange(64 * lanes), blocks)
    chosen = list(itertools.combinations(range(blocks), blocks - radius))
    masks = np.zeros((len(chosen), lanes), dtype=np.uint64)
    for m, picked in zip(masks, chosen, strict=True):
        for b in itertools.chain.from_iterable(parts[p].tolist() for p in picked):
            m[b // 64] |= np.uint64(1) << np.uint64(63 - b % 64)
    return masks


def _unhex(column, lanes: int) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), dtype=">u8").astype(np.uint64).reshape(-1, lanes)


def fingerprint_links(fps: DataFrame, radius: int, lanes: int = 1, blocks: int | None = None, chunk: int = 4096, batch_rows: int = 50_000) -> DataFrame:
    """(a, b): links between the different fingerprints of ``fps`` (column fp), enough to connect all that are linked."""
    masks, refs = bucket_keys(lanes, radius, blocks or blocks_for(fps.count(), radius, lanes)), pivots(lanes)

    def tabled(batches):
        for b in batches:
            rows = pivot_table(_unhex(b.column(0), lanes), refs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["fp", "distances"])

    def keyed(batches):
        for b in batches:
            v = _unhex(b.column(0), lanes)
            for t, m in enumerate(masks):
                key = v & m
                mixed = key[:, 0].copy()
                for lane in range(1, lanes):
                    mixed = mixed * np.uint64(0x9E3779B97F4A7C15) ^ key[:, lane]
                mixed = (mixed * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(t * 0x632BE59BD9B4E019 % 2**64)
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), *b.columns], ["key", "fp", "distances"])

    table = written(fps.select("fp").mapInArrow(tabled, "fp string, distances binary"), "simhash-pivots")
    entries = written(table.mapInArrow(keyed, "key long, fp string, distances binary"), "simhash-keys")
    sizes = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-sizes")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = skew_join(entries, sizes, ["key"], heavy_keys(sizes, ["key"], entries.count()))
    met = met.withColumn("k", chunks).withColumn("c", F.when(F.col("k") > 1, F.pmod(F.xxhash64("fp"), F.col("k"))).otherwise(0).cast("int"))
    # chunk c of k meets every chunk once: tile (i, j) with i <= j holds both
    tiles = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
    tiled = met.select("key", "fp", "distances", "c", F.explode(tiles).alias("t")).select("key", "fp", "distances", "c", "t.i", "t.j")

    def solved(held: pa.Table):
        ends = np.stack([held.column(n).to_numpy() for n in ("key", "i", "j")])
        tile = np.concatenate([[0], np.cumsum((ends[:, 1:] != ends[:, :-1]).any(axis=0))])
        side = np.where(ends[1] == ends[2], -1, held.column("c").to_numpy() == ends[2])
        near = np.frombuffer(b"".join(held.column("distances").to_pylist()), dtype=np.int16).reshape(held.num_rows, -1)
        a, b = near_links(tile, side, _unhex(held.column("fp"), lanes), near, radius)
        fp = held.column("fp").combine_chunks()
        return pa.RecordBatch.from_arrays([fp.take(pa.array(a)), fp.take(pa.array(b))], ["a", "b"])

    def compare(batches):
        held, n = [], 0
        for batch in batches:
            if n >= batch_rows:  # all tiles but the last are whole
                table = pa.Table.from_batches(held)
                at = [table.column(k).to_numpy() for k in ("key", "i", "j")]
                last = np.logical_and.reduce([x == x[-1] for x in at])
                first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
                if first:
                    yield solved(table.slice(0, first))
                    held = table.slice(first).to_batches()
                    n = table.num_rows - first
            held.append(batch)
            n += batch.num_rows
        if n:
            yield solved(pa.Table.from_batches(held))

    dealt = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "fp", "distances", "c", "i", "j")
    return dealt.mapInArrow(compare, "a string, b string").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by alternating large and small stars.

    Every round is written to the shared folder, which cuts the lineage. Nodes with very many links are heavy keys of the joins.
    """
    pairs = lambda e: e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()

    def starred(links: DataFrame, n: int) -> DataFrame:
        """``links`` with the smallest neighbour m of each u."""
        low = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        return skew_join(links, low.select("u", "m"), ["u"], heavy_keys(low, ["u"], n))

    edges = written(pairs(links), "simhash-edges")
    n = edges.count()
    while True:
        both = starred(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))), 2 * n)
        large = both.filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        large = written(pairs(large), "simhash-large")
        small = starred(large, large.count()).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        after = written(pairs(small), "simhash-small")
        before, n = n, after.count()
        if n == before and after.exceptAll(edges).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``; no link within ``radius`` is lost.

    A null text has no words: fingerprint zero, linked like any other. Rows that
    repeat share fingerprint and component, and so do texts with equal shingles. Texts may be of any length: 65,536 shingles are held
    at a time. component_id is the smallest doc_id
    of the component; it is null only if all its ids are. Only doc_id and text are read, so other columns cannot clash. An empty table gives
    an empty result.
    """
    own = written(fingerprints(docs, shingle, lanes), "simhash-fingerprints")
    least = written(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = written(components(fingerprint_links(least, radius, lanes)), "simhash-roots")
    joined = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "simhash-joined")
    low = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = skew_join(joined, low, ["root"], heavy_of(joined, ["root"])).select("fp", "component_id")
    out = skew_join(own, named, ["fp"], heavy_keys(least, ["fp"], own.count()))
    return out.select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
