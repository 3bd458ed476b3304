"""Token ids in files of fixed-width bit packing, in ascending order of documents.

A file: the magic, then blocks of ``BLOCK`` ids, each id in the fewest bits that
hold the vocabulary, least significant bits first, padded with zeros to 64 ids;
then the blocks' byte offsets, the document table (id, whether it has one, number
of ids) and a trailer of five 64-bit numbers (bits, ids, blocks, documents, place
of the offsets) before the magic. A reader finds any block from the trailer and
unpacks it by vectorised shifts.
"""

from __future__ import annotations

import array
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.files import filesystem
from quillspark.llm.workers import kept, trimmed
from quillspark.session import shared_dir, ship

ship(__name__)

MAGIC = b"QSTOKEN1"
BLOCK = 65536
#: Texts that are encoded together: so many, of so many bytes together (one text may have more); characters that go to the library in one call.
ROWS, BYTES, CALL = 2048, 8 << 20, 1 << 20
DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u8")])


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id; the number of ids is padded to a multiple of 64."""
    padded = np.zeros(-(-len(ids) // 64) * 64, dtype=np.uint64)
    padded[: len(ids)] = ids
    rows = padded.reshape(-1, 64)
    out = np.zeros((len(rows), bits), dtype="<u8")
    for k in range(64):
        word, off = divmod(k * bits, 64)
        out[:, word] |= rows[:, k] << np.uint64(off)
        if off + bits > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - off)
    return out.tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    words = np.frombuffer(data, dtype="<u8").reshape(-1, bits)
    out, mask = np.empty((len(words), 64), dtype=np.uint32), np.uint64(2**bits - 1)
    for k in range(64):
        word, off = divmod(k * bits, 64)
        v = words[:, word] >> np.uint64(off)
        if off + bits > 64:
            v = v | words[:, word + 1] << np.uint64(64 - off)
        out[:, k] = v & mask
    return out.reshape(-1)[:n]


class TokenWriter:
    """Writes one file; holds a batch and a block of ids and 17 bytes for each document."""

    def __init__(self, stream, vocabulary: int):
        self.stream, self.bits = stream, max(1, (vocabulary - 1).bit_length())
        self.held, self.n_held, self.offsets, self.n = [], 0, array.array("Q"), 0
        self.doc_ids, self.known, self.counts = array.array("q"), array.array("B"), array.array("Q")
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with their numbers of ids, and all their ids one after the other."""
        self.doc_ids.extend(d or 0 for d in doc_ids)
        self.known.extend(d is not None for d in doc_ids)
        self.counts.extend(counts.tolist())
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, full, BLOCK):
            data = pack(ids[k : k + BLOCK], self.bits)
            self.offsets.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        docs = np.zeros(len(self.counts), DOC)
        docs["id"], docs["known"], docs["n"] = self.doc_ids, self.known, self.counts
        self.stream.write(docs.tobytes())
        self.stream.write(np.array([self.bits, self.n, len(self.offsets), len(docs), self.at], "<u8").tobytes() + MAGIC)


class TokenFile:
    """Random access to one file through any seekable stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 48)
        tail = stream.read(48)
        if tail[40:] != MAGIC:
            raise ValueError("not a token file, or a file cut short")
        self.bits, self.n, n_blocks, n_docs, at = (int(x) for x in np.frombuffer(tail[:40], "<u8"))
        stream.seek(at)
        self.offsets = np.frombuffer(stream.read(8 * n_blocks), "<u8")
        self.docs = np.frombuffer(stream.read(DOC.itemsize * n_docs), DOC)
        self.starts = np.concatenate([[0], np.cumsum(self.docs["n"], dtype=np.int64)])

    def block(self, k: int) -> np.ndarray:
        n = min(BLOCK, self.n - k * BLOCK)
        self.stream.seek(int(self.offsets[k]))
        return unpack(self.stream.read(-(-n // 64) * 8 * self.bits), n, self.bits)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        ids = np.concatenate([self.block(k) for k in range(first, (stop - 1) // BLOCK + 1)])
        return ids[start - first * BLOCK : stop - first * BLOCK]

    def documents(self):
        """(id, number of ids, crc32 of the ids as little-endian 32-bit integers), one block in memory."""
        held, held_at = None, -1
        for row, start in zip(self.docs, self.starts[:-1], strict=True):
            crc, at, stop = 0, int(start), int(start) + int(row["n"])
            while at < stop:
                if at // BLOCK != held_at:
                    held_at = at // BLOCK
                    held = self.block(held_at).astype("<u4")
                off = at - held_at * BLOCK
                part = held[off : off + stop - at]
                crc = zlib.crc32(part.data.cast("B"), crc)
                at += len(part)
            yield (int(row["id"]) if row["known"] else None), int(row["n"]), crc


#: White space as the library's patterns know it.
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class Encoder:
    """Whole texts to ids, with a cache of the library's answers for repeated pieces.

    Byte-level BPE of this kind splits a text before every blank that is followed by
    something other than white space, so the pieces between single blanks are
    encoded apart. Pieces go through the library once while the cache holds
    them (it starts anew beyond ``max_pieces``); texts with two blanks in a
    row, or a blank between other white space, go through it whole. The cache numbers the pieces; their ids lie one after the other in one array.
    """

    def __init__(self, path: str, max_pieces: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.max_pieces = max_pieces
        self.opens = np.zeros(self.vocabulary, dtype=bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[k] = token.startswith("\u0120")  # how this vocabulary writes a blank
        self._reset()

    def _reset(self) -> None:
        self.numbers, self.ids, self.lengths = {}, np.zeros(0, np.uint32), np.zeros(0, np.int64)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each has."""
        ids, lengths, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) <= CALL:
                size += len(texts[stop])
                stop += 1
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:stop], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(lengths[-1].sum())))
            at = stop
        return np.concatenate(ids), np.concatenate(lengths)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces with a blank before each, many pieces in a call.

        A piece starts at an id whose bytes begin with a blank, as pieces hold none; where that does not add up
        they are encoded one by one.
        """
        groups, parts = [pieces[k : k + 250] for k in range(0, len(pieces), 250)], []
        ids, lengths = self._library([" " + " ".join(g) for g in groups])
        for group, part in zip(groups, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            starts = np.flatnonzero(self.opens[part])
            if len(starts) == len(group) and starts[0] == 0:
                parts.append((part, np.diff(starts, append=len(part))))
            else:
                parts.append(self._library([" " + p for p in group]))
        return np.concatenate([i for i, _ in parts]), np.concatenate([n for _, n in parts])

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces that stand behind a blank."""
        found = np.fromiter(map(self.numbers.get, pieces, itertools.repeat(-1)), dtype=np.int64, count=len(pieces))
        if len(self.numbers) + np.count_nonzero(found < 0) > self.max_pieces:
            self._reset()
            found[:] = -1
        plain, odd = [], []
        for k in np.flatnonzero(found < 0).tolist():
            p = pieces[k]
            (plain if p and p == p.strip() else odd).append(k)
        for at, ids in ((plain, self._joined), (odd, lambda ps: self._library([" " + p for p in ps]))):
            if at:
                new, first = [pieces[k] for k in at], len(self.lengths)
                own, lengths = ids(new)
                self.numbers.update(zip(new, range(first, first + len(new)), strict=True))
                self.ids, self.lengths = np.concatenate([self.ids, own]), np.concatenate([self.lengths, lengths])
                found[at] = np.arange(first, first + len(new))
        return found

    def _run_over(self, pieces: pa.Array, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts in which white space stands on both sides of a blank, or before a blank at the end: it is split as one run."""
        told = lambda pattern: pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False)
        starts, ends = told(f"^({_SPACE}|$)"), told(f"(^|{_SPACE})$")
        met = ends[codes[:-1]] & starts[codes[1:]]
        met[at[1:-1] - 1] = False  # from one text to the next
        return np.unique(np.searchsorted(at, np.flatnonzero(met), side="right") - 1)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, ``end`` behind each text, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        codes, size = coded.indices.to_numpy(), len(coded.dictionary)
        odd = np.union1d(np.flatnonzero(pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False)), self._run_over(coded.dictionary, codes, at))
        behind = np.bincount(codes, minlength=size) - np.bincount(codes[at[:-1]], minlength=size)
        used, number = np.flatnonzero(behind), np.zeros(size, dtype=np.int32)
        number[used] = self._numbers(coded.dictionary.take(pa.array(used)).to_pylist())
        # behind the shared pieces: each text's first piece, whole texts that are not cut, the end
        heads = self._library(split.values.take(pa.array(at[:-1])).to_pylist())
        whole = self._library(texts.take(pa.array(odd)).to_pylist())
        pool = np.concatenate([self.ids, heads[0], whole[0], np.array([end], np.uint32)])
        lengths = np.concatenate([self.lengths, heads[1], whole[1], [1]]).astype(np.int32)
        starts, first = (np.cumsum(lengths) - lengths).astype(np.int32), len(self.lengths)
        codes = number[codes]
        del split, coded, number, behind
        codes[at[:-1]] = first + np.arange(len(texts))
        if len(odd):
            keep = np.ones(len(codes), dtype=bool)
            for k, t in enumerate(odd.tolist()):
                keep[at[t] + 1 : at[t + 1]] = False
                codes[at[t]] = first + len(texts) + k
            codes, at = codes[keep], np.concatenate([[0], np.cumsum(keep)])[at]
        codes = np.insert(codes, at[1:], len(lengths) - 1)
        n = lengths[codes]
        stops = np.cumsum(n)
        # ids i of a piece come from its place in the pool: the piece's offset repeated, plus i (batches stay below 2 ** 31 ids)
        base = stops.astype(np.int32)
        base -= n
        np.subtract(starts[codes], base, out=base)
        jump = np.repeat(base, n)
        jump += np.arange(len(jump), dtype=np.int32)
        last = np.concatenate([[0], stops])[at + np.arange(len(at))]
        return pool[jump], np.diff(last)


def portions(texts: pa.Array):
    """Places where to cut an array of texts, so that each part has ``ROWS`` texts and ``BYTES`` bytes at most, or one text."""
    sizes, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        stop = min(at + ROWS, max(at + 1, int(np.searchsorted(sizes, before + BYTES, side="right"))), len(sizes))
        yield at, stop
        at = stop


def _encoder(path: str) -> Encoder:
    """The worker's encoder, which later tasks of the worker find again."""
    return kept(path, lambda: Encoder(path))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, out_dir: str | None = None) -> DataFrame:
    """Encode ``docs`` and write files in ascending order of doc_id (null first); gives the list of files.

    The list has (shard, path, n_docs, n_tokens), one row for each file, in the
    order of documents. A task writes a file under a name of its own attempt and
    reports it, so that a repeated task leaves no doubt which file counts. A
    null text has the end id only; repeated rows are written each; rows of one doc_id, or without one, are ordered by a hash of their
    text and may lie in several files; texts may be of any length, 8 MB of them or one are encoded at a time; other columns are not read, so their names cannot clash; an empty
    table gives no file.
    """
    spark = docs.sparkSession
    base = out_dir or shared_dir(spark, "tokens")
    fs, root = filesystem(base)
    fs.create_dir(root, recursive=True)

    def run(batches):
        task = TaskContext.get()
        fs, top = filesystem(base)
        path, writer, stream = f"{top}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.tok", None, None
        for b in batches:
            for at, stop in portions(b.column(1)):
                part, encoder = b.slice(at, stop - at), _encoder(tokenizer)
                if writer is None:
                    stream = fs.open_output_stream(path)
                    writer = TokenWriter(stream, encoder.vocabulary)
                ids, counts = encoder.encode(part.column(1), end_id)
                writer.add(part.column(0).to_pylist(), ids, counts)
        if writer:
            writer.close()
            stream.close()
            trimmed()
            name = base.rstrip("/") + path[len(top) :]
            row = [[task.partitionId()], [name], [len(writer.counts)], [writer.n]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["shard", "path", "n_docs", "n_tokens"])

    # rows of one id, or without one, are spread by their text, and by where they were read if they share that too
    order = [F.asc_nulls_first("doc_id"), F.asc("__h"), F.asc("__p")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__h"), F.spark_partition_id().alias("__p"))
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")
    manifest = shared_dir(spark, "tokens-manifest")
    files.write.parquet(manifest)
    return spark.read.schema(files.schema).parquet(manifest)


def read_tokens(spark, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the listed files; none for an empty list."""
    rows, start, starts = sorted(manifest.collect()), 0, []  # one row for each file
    for r in rows:
        starts.append((r["path"], start))
        start += r["n_tokens"]

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, local = filesystem(path)
                size = fs.get_file_info(local).size
                with fs.open_input_file(local) as stream:
                    f = TokenFile(stream, size)
                    held = []
                    for k, found in enumerate(f.documents()):
                        held.append((found[0], base + int(f.starts[k]), *found[1:]))
                        if len(held) == 50_000:
                            yield _rows(held)
                            held = []
                    if held:
                        yield _rows(held)

    listed = spark.createDataFrame(starts, "path string, base long").repartition(max(1, len(starts)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
