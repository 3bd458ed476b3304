"""Exact removal of byte strings that occur twice anywhere, by column-wise suffix construction.

Every string of ``size`` bytes is assigned to the smallest hash of a ``SEED``-byte
window inside it (leftmost of equals), which depends on its bytes alone. The
strings of neighbouring places that share one such anchor form a segment of at
most 2 * size - SEED bytes, so equal strings always lie in segments of equal
anchors, and segments of different anchors never have to meet.

Segments that are equal as a whole are found by their digests. Where segments of
one anchor differ, their bytes are gathered, and for each batch of them the
collection's Burrows-Wheeler transform and its array of longest common prefixes
are built column by column: each round inserts one symbol of every segment, from
the last to the first, into sequential files that hold the transform and the
prefixes. Adjacent suffixes with ``size`` bytes in common are the repeats.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.skew import heavy_keys, skew_join
from quillspark.session import ship, written

ship(__name__)

SEED = 64
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_POSITION = 24  # bits of a place in a piece of text; pieces are shorter than 2 ** 24 bytes


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED bytes at each place, by doubling."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    n, factor = 1, 0xD6E8FEB86659FD93
    while n < SEED:
        h = h[:-n] * np.uint64(factor) + h[n:]
        n, factor = 2 * n, factor * factor % 2**64
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def segments(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start, anchor's place and anchor hash of each segment of one text's bytes, at most 2 ** 24 of them."""
    if len(data) < size:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    h = seed_hashes(data)
    low = np.uint64((1 << _POSITION) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, n = size - SEED + 1, 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    if n < width:
        m = np.minimum(m[: len(m) - (width - n)], m[width - n :])
    starts = np.concatenate([[0], np.nonzero(m[1:] != m[:-1])[0] + 1])
    ends = np.concatenate([starts[1:] - 1, [len(m) - 1]])
    anchors = (m[starts] & low).astype(np.int64)
    return starts, ends, anchors, h[anchors]


def text_segments(raw: bytes, size: int, piece: int = 4 << 20):
    """(starts, ends, places, anchors) of a text of any length, in pieces that overlap by size - 1 bytes."""
    for at in range(0, len(raw) - size + 1, piece):
        s, e, p, a = segments(np.frombuffer(raw, np.uint8, min(piece + size - 1, len(raw) - at), at), size)
        yield s + at, e + at, p + at, a


class Columns:
    """The growing transform: symbol before each suffix, common prefix with the suffix before, and whose it is.

    Two generations of files are kept; a round reads one from start to end and
    writes the other.
    """

    KINDS = {"symbol": np.uint8, "prefix": np.uint16, "segment": np.int32, "length": np.uint16}

    def __init__(self, total: int, folder: str | None = None):
        self.files = [{k: tempfile.TemporaryFile(dir=folder) for k in self.KINDS} for _ in range(2)]
        self.maps = [{k: np.memmap(f, dtype=self.KINDS[k], mode="w+", shape=(total,)) for k, f in g.items()} for g in self.files]
        self.now, self.n = 0, 0

    def view(self, name: str) -> np.ndarray:
        return self.maps[self.now][name][: self.n]

    def merge(self, at: np.ndarray, new: dict[str, np.ndarray]) -> None:
        """Write the next generation: ``new`` entries get the (ascending) final places ``at``."""
        n = self.n + len(at)
        old = np.ones(n, dtype=bool)
        old[at] = False
        for k in self.KINDS:
            target = self.maps[1 - self.now][k][:n]
            target[old] = self.view(k)
            target[at] = new[k]
        self.now, self.n = 1 - self.now, n

    def close(self) -> None:
        self.maps = []
        for g in self.files:
            for f in g.values():
                f.close()


def repeated_starts(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text, the starts of its ``size``-byte strings that some text has elsewhere too.

    One round for each column: the symbol in front of every text's latest suffix
    is inserted. Its place is the number of smaller (symbol, place of the rest)
    pairs, counted in the transform; its common prefixes are one more than the
    smallest between the rests.
    """
    m = len(texts)
    if len(set(b"".join(texts))) > 255:  # one value of the byte is for "none yet"
        raise ValueError("more than 255 different bytes")
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat, begin = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(lengths)])[:-1]
    dense = np.zeros(256, dtype=np.int64)
    dense[np.unique(flat)] = np.arange(1, len(np.unique(flat)) + 1)  # 0 means none yet
    state = Columns(int(lengths.sum()) + m)
    place = np.arange(m)
    state.merge(place, {"symbol": np.zeros(m), "prefix": np.zeros(m), "segment": place, "length": np.zeros(m)})
    for t in range(1, int(lengths.max(initial=0)) + 1):
        live = np.nonzero(lengths >= t)[0]
        symbols = dense[flat[begin[live] + lengths[live] - t]]
        n, transform = state.n, state.view("symbol")
        transform[place[live]] = symbols
        # all suffixes but the empty ones, in order: (symbol, place of the rest)
        order = np.argsort(transform, kind="stable")
        order = order[n - int(np.count_nonzero(transform)) :]
        keys = transform[order].astype(np.int64) * n + order
        mine = np.sort(symbols * n + place[live])
        k = np.searchsorted(keys, mine)  # where each new suffix stands among them
        rest = mine % n
        owner = np.empty(n, dtype=np.int32)
        owner[place[live]] = live
        whose = owner[rest]
        prefix = state.view("prefix")

        def common(j: np.ndarray) -> np.ndarray:
            """The common prefix of order[j - 1] and order[j], 0 where symbols differ or there is none."""
            ok = (j > 0) & (j < len(order))
            jj = j[ok]
            same = transform[order[jj - 1]] == transform[order[jj]]
            lo, hi = order[jj[same] - 1] + 1, order[jj[same]] + 1
            out = np.zeros(len(j), dtype=np.int64)
            if len(lo):
                pairs = np.stack([lo, hi], axis=1).ravel()
                wide = np.append(prefix, np.uint16(0))
                found = np.minimum.reduceat(wide, pairs)[::2].astype(np.int64) + 1
                slots = np.nonzero(ok)[0][same]
                out[slots] = found
            return out

        at = m + k
        new_prefix, next_prefix = common(k), common(k + 1)
        state.merge(at, {"symbol": np.zeros(len(at)), "prefix": new_prefix, "segment": whose, "length": np.full(len(at), t)})
        after = at + 1
        inside = after < state.n
        state.view("prefix")[after[inside]] = next_prefix[inside]
        moved = np.setdiff1d(np.arange(m), live, assume_unique=True)
        if len(moved):  # finished texts only shift
            place[moved] += np.searchsorted(at - np.arange(len(at)), place[moved], side="right")
        place[whose] = at
    joined = state.view("prefix") >= size
    member = joined.copy()
    member[:-1] |= joined[1:]
    segment, length = state.view("segment")[member], state.view("length")[member].astype(np.int64)
    keep = length >= size
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * m
    by = np.argsort(segment[keep], kind="stable")
    seg, start = segment[keep][by], lengths[segment[keep][by]] - length[keep][by]
    cuts = np.nonzero(np.diff(seg))[0] + 1
    for s, part in zip(seg[np.concatenate([[0], cuts])] if len(seg) else [], np.split(start, cuts), strict=False):
        out[s] = np.sort(part)
    state.close()
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _reach(parts: list[bytes]) -> list[int]:
    """For each part, its longest common prefix with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def group_repeats(groups: list[list[tuple[bytes, int]]], size: int) -> list[list[list[tuple[int, int]]]]:
    """For each segment (bytes, anchor's place) of each group: the runs of bytes in strings that another of its group has.

    A segment is first trimmed to the bytes that any other of the group shares
    with it on either side of the anchor; below ``size`` nothing is left. What is
    left of all groups goes through one columnwise construction; texts that are
    equal after trimming go in once and count as repeated.
    """
    out = [[[] for _ in g] for g in groups]
    texts: dict[bytes, list[tuple[int, int, int]]] = {}
    for g, members in enumerate(groups):
        right = _reach([raw[a:] for raw, a in members])
        left = _reach([raw[:a][::-1] for raw, a in members])
        for k, (raw, a) in enumerate(members):
            if left[k] + right[k] >= size:
                texts.setdefault(raw[a - left[k] : a + right[k]], []).append((g, k, a - left[k]))
    alone = {g for owners in texts.values() if len(owners) == 1 for g, _, _ in owners}
    built = [t for t, owners in texts.items() if any(g in alone for g, _, _ in owners)]
    starts = dict(zip(built, repeated_starts(built, size), strict=True)) if built else {}
    for text, owners in texts.items():
        if len(owners) > 1:
            runs = [(0, len(text))]
        else:
            runs = []
            for s in starts[text].tolist():
                if runs and s <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], s + size)
                else:
                    runs.append((s, s + size))
        for g, k, at in owners:
            out[g][k] = [(at + lo, at + hi) for lo, hi in runs]
    return out


_SEGMENTS = "k1 long, k2 long, start array<int>, length array<smallint>, place array<smallint>, m array<long>, c array<long>"
KEY, SAME = ["k1", "k2"], ["m", "c"]


def _cut(docs: DataFrame, size: int) -> DataFrame:
    """Segments of every text: rows of at most 20,000 segments; m is the anchor, c the digest of the whole."""

    def run(batches):
        for b in batches:
            for k1, k2, text in zip(*[x.to_pylist() for x in b.columns], strict=True):
                raw = (text or "").encode()
                for s, e, p, a in text_segments(raw, size):
                    ends = (e + size).tolist()
                    c = [xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(s.tolist(), ends, strict=True)]
                    for k in range(0, len(c), 20_000):
                        z = slice(k, k + 20_000)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([k1], pa.int64()), pa.array([k2], pa.int64()), pa.array([s[z].astype(np.int32)]), pa.array([(e + size - s)[z].astype(np.int16)]),
                                pa.array([(p - s)[z].astype(np.int16)]), pa.array([a[z].view(np.int64)]), pa.array([np.array(c[z], np.uint64).view(np.int64)]),
                            ],
                            ["k1", "k2", "start", "length", "place", "m", "c"],
                        )

    return docs.mapInArrow(run, _SEGMENTS)


def _bytes_by_sieve(docs: DataFrame, wanted: DataFrame, size: int, bits: int) -> DataFrame:
    """(m, c, place, raw) of all segments whose anchor may be wanted: a second reading with a fixed-size sieve."""
    spark = docs.sparkSession
    slot = F.col("m").bitwiseAND(F.lit((1 << bits) - 1))
    words = wanted.select("m").distinct().groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("v"))
    table = words.toArrow()  # at most 2 ** (bits - 6) rows, whatever the corpus
    sieve = np.zeros(1 << (bits - 6), dtype=np.int64)
    sieve[table["w"].to_numpy()] = table["v"].to_numpy()
    shared = spark.sparkContext.broadcast(sieve)

    def run(batches):
        held, mask = shared.value.view(np.uint64), np.uint64((1 << bits) - 1)
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                raw = (text or "").encode()
                for s, e, p, a in text_segments(raw, size):
                    at = a & mask
                    hit = (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                    for k in np.nonzero(hit)[0].tolist():
                        part = raw[s[k] : e[k] + size]
                        out.append((int(a[k].view(np.int64)), xxhash.xxh3_64_intdigest(part), int(p[k] - s[k]), part))
            if out:
                m, c, place, part = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(np.array(c, np.uint64).view(np.int64)), pa.array(place, pa.int32()), pa.array(part, pa.binary())], ["m", "c", "place", "raw"])

    return docs.select("text").mapInArrow(run, "m long, c long, place int, raw binary")


def _bytes_by_join(docs: DataFrame, cut: DataFrame, wanted: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """The same for any number of anchors: one owner of each wanted segment is joined to its text."""
    flat = skew_join(_flat(cut), wanted.select(*SAME), SAME, heavy)
    owner = flat.groupBy(*SAME).agg(F.min(F.struct(*KEY, "start", "length", "place")).alias("o")).select(*SAME, "o.*")
    asked = owner.groupBy(*KEY).agg(F.collect_list(F.struct(*SAME, "start", "length", "place")).alias("asked"))
    met = docs.dropDuplicates(KEY).join(asked, KEY).select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"), F.explode("asked").alias("a"))
    return met.select("a.m", "a.c", F.col("a.place").cast("int").alias("place"), F.expr("substring(raw, a.start + 1, a.length)").alias("raw"))


def _flat(cut: DataFrame) -> DataFrame:
    zipped = cut.select(*KEY, F.explode(F.arrays_zip("start", "length", "place", "m", "c")).alias("s"))
    return zipped.select(*KEY, "s.start", "s.length", "s.place", "s.m", "s.c")


def _columns(contested: DataFrame, size: int, batch_bytes: int) -> DataFrame:
    """(m, c, lo, hi): runs of each contested segment (m, c, place, raw) in strings that its group has twice."""

    def solve(held):
        found = group_repeats([[(raw, place) for _, _, place, raw in g] for g in held], size)
        rows = [(m, c, lo, hi) for g, runs in zip(held, found, strict=True) for (m, c, _, _), r in zip(g, runs, strict=True) for lo, hi in r]
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["m", "c", "lo", "hi"])

    def run(batches):
        held, total = [], 0
        for b in batches:
            for row in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if not held or held[-1][0][0] != row[0]:
                    if total >= batch_bytes:  # only between groups
                        yield from solve(held)
                        held, total = [], 0
                    held.append([])
                held[-1].append(row)
                total += len(row[3])
        yield from solve(held)

    dealt = contested.repartition("m").sortWithinPartitions("m").select("m", "c", "place", "raw")
    return dealt.mapInArrow(run, "m long, c long, lo int, hi int")


def parted(raw: bytes, place: int, size: int, width: int, span: int):
    """(place in ``raw``, anchor, place of the anchor, bytes) of the parts of a segment whose strings start 0 to width - 1 bytes before ``place``.

    Each part has the strings of ``span`` neighbouring starts; what they all have in common is its anchor, of
    size - span + 1 bytes or more. Equal strings of two segments of one anchor lie in parts of one anchor.
    """
    for k in range(0, width, span):
        far = min(k + span, width) - 1
        first, last = max(0, place - far), min(len(raw) - size, place - k)
        if first <= last:
            anchor = b"%d " % k + raw[place - k : place - far + size]
            yield first, xxhash.xxh3_64_intdigest(anchor, 11), place - k - first, raw[first : last + size]


def _group_runs(contested: DataFrame, size: int, width: int, most: int, batch_bytes: int) -> DataFrame:
    """(m, c, lo, hi) of the repeated run of each contested segment (m, c, place, raw, k), k being the size of its group.

    Groups of more than ``most`` segments are parted by longer anchors, and the parts are segments of groups of their own: equal
    ones are found by digests, others by columns, and what is still too large is parted again, down to single strings.
    """
    found = _columns(contested.filter(F.col("k") <= most), size, batch_bytes)
    large, span = contested.filter(F.col("k") > most), -(-width // 8)
    if width == 1 or large.isEmpty():
        return found

    def run(batches):
        for b in batches:
            out = []
            for m, c, place, raw in zip(*[x.to_pylist() for x in b.columns], strict=True):
                out += [(m, c, at, m2, xxhash.xxh3_64_intdigest(part), p, part) for at, m2, p, part in parted(raw, place, size, width, span)]
            if out:
                m, c, at, m2, c2, p, part = zip(*out, strict=True)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                columns = [pa.array(m, pa.int64()), pa.array(c, pa.int64()), pa.array(at, pa.int32()), signed(m2), signed(c2), pa.array(p, pa.int32()), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["m", "c", "at", "m2", "c2", "place", "raw"])

    parts = written(large.select("m", "c", "place", "raw").mapInArrow(run, "m long, c long, at int, m2 long, c2 long, place int, raw binary"), "repeat-parts")
    each = written(parts.groupBy("m2", "c2").agg(F.count(F.lit(1)).alias("n"), F.first("place").alias("place"), F.first("raw").alias("raw")), "repeat-parts-once")
    whole = each.filter("n > 1").select(F.col("m2").alias("m"), F.col("c2").alias("c"), F.lit(0).alias("lo"), F.length("raw").alias("hi"))
    if span > 1:
        sizes = written(each.groupBy("m2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeat-part-groups")
        heavy = heavy_keys(sizes, ["m2"], each.count())
        again = skew_join(each.drop("n"), sizes.withColumnRenamed("n", "k"), ["m2"], heavy)
        again = written(again.select(F.col("m2").alias("m"), F.col("c2").alias("c"), "place", "raw", "k"), "repeat-parts-contested")
        whole = whole.unionByName(_group_runs(again, size, span, most, batch_bytes))
    marks = _one_run(whole).select(F.col("m").alias("m2"), F.col("c").alias("c2"), "lo", "hi")
    heavy = heavy_keys(each.select("m2", "c2", "n"), ["m2", "c2"], parts.count())
    met = skew_join(parts.select("m", "c", "at", "m2", "c2"), marks, ["m2", "c2"], heavy)
    return found.unionByName(met.select("m", "c", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))


def _one_run(runs: DataFrame) -> DataFrame:
    """The runs of a segment as one: all strings of a segment hold its anchor, so their union has no gap."""
    return runs.groupBy(*SAME).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def remove_repeats(docs: DataFrame, size: int = 200, most_in_group: int = 4096, batch_bytes: int = 400_000, sieve_bits: int = 26, sieve_anchors: int = 4_000_000) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): texts' UTF-8 bytes without those in a ``size``-byte string that starts anywhere else too.

    Overlapping occurrences count, texts are judged as they came in, and matches
    never cross documents. A null text is empty; texts below ``size`` bytes stay
    whole; texts may be of any length; rows are told apart by 128 bits of doc_id and text; rows repeated with the same id and text repeat each other; null ids are
    allowed; other columns are not read, so their names cannot clash; an empty table gives an empty result. Groups of more than
    ``most_in_group`` different segments are parted by longer anchors; beyond ``sieve_anchors`` contested anchors the bytes come by a join.
    """
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(id_.alias("doc_id"), "text", F.xxhash64(id_, "text").alias("k1"), F.xxhash64(F.lit(1), "text", id_).alias("k2"))
    cut = written(_cut(keyed.select(*KEY, "text"), size), "repeat-segments")
    counts = written(_flat(cut).groupBy(*SAME).agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length")), "repeat-counts")
    heavy = heavy_keys(counts, SAME, counts.agg(F.sum("n")).first()[0] or 0)
    groups = written(counts.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeat-groups")
    crowded = heavy_keys(groups, ["m"], counts.count())
    wanted = written(skew_join(counts.select(*SAME), groups.withColumnRenamed("n", "k"), ["m"], crowded).select(*SAME, "k"), "repeat-wanted")
    whole = counts.filter("n > 1").select(*SAME, F.lit(0).alias("lo"), F.col("length").cast("int").alias("hi"))
    if wanted.select("m").limit(sieve_anchors + 1).count() <= sieve_anchors:
        found = _bytes_by_sieve(keyed, wanted, size, sieve_bits)
    else:
        found = _bytes_by_join(keyed, cut, wanted, heavy)
    once = found.groupBy(*SAME).agg(F.first("place").alias("place"), F.first("raw").alias("raw"))
    contested = written(once.join(wanted, SAME), "repeat-contested")
    runs = _group_runs(contested, size, size - SEED + 1, most_in_group, batch_bytes)
    marks = written(_one_run(whole.unionByName(runs)), "repeat-runs")
    # copies of one row have the same spans, which a set holds once
    spans = (
        skew_join(_flat(cut).select(*KEY, "start", *SAME), marks, SAME, heavy)
        .groupBy(*KEY).agg(F.collect_set(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))
    )
    copies = cut.filter(F.get("start", F.lit(0)) == 0).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    copied = heavy_keys(copies, KEY, cut.count())

    def strip(batches):
        for b in batches:
            out = []
            for doc_id, text, spans in zip(*[x.to_pylist() for x in b.columns], strict=True):
                raw, kept, at, removed, n = (text or "").encode(), [], 0, 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > at or n == 0:
                        kept.append(raw[at:lo])
                        n, removed, at = n + 1, removed + hi - lo, hi
                    elif hi > at:
                        removed, at = removed + hi - at, hi
                kept.append(raw[at:])
                out.append((doc_id, b"".join(kept), len(raw), removed, n))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    # short texts have no segments: they are dealt out evenly, as many of them may be alike
    short = F.octet_length(F.coalesce("text", F.lit(""))) < size
    dealt = keyed.select("doc_id", "text", F.when(short, F.monotonically_increasing_id()).otherwise(F.col("k1")).alias("k1"), F.when(short, F.lit(-1)).otherwise(F.col("k2")).alias("k2"))
    joined = skew_join(dealt, spans, KEY, copied, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(strip, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
