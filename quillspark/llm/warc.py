"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Records are gzip members of their own (``.warc.gz``) or plain. The reader checks
version line, header block, length and block digest of every record. When a
check fails it looks for the next gzip member or version line that holds a valid
record, goes on from there, and logs the bytes between as quarantined.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.files import filesystem
from quillspark.llm.skew import heavy_keys, skew_join
from quillspark.session import shared_dir, ship, written

ship(__name__)

VERSION = b"WARC/1.1\r\n"
_VERSION = re.compile(rb"WARC/1\.\d\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record(headers: dict[str, str], block: bytes, gz: bool = True) -> bytes:
    """One record; the block's digest and length are added to ``headers``."""
    lines = headers | {"WARC-Block-Digest": f"sha256:{sha256(block)}", "Content-Length": str(len(block))}
    raw = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    if not gz:
        return raw
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, gz: bool = True) -> bytes:
    """The response record of a page, or its revisit of another page's response: then without the payload."""
    name = lambda p: f"<urn:page:{'none' if p is None else p}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": urllib.parse.quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        headers |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": PROFILE}
    return record(headers, http + (payload if refers_to is None else b""), gz)


def _parsed(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The valid record that starts at ``at``, and where it ends; else None."""
    start = _VERSION.match(raw, at)
    end = raw.find(b"\r\n\r\n", at) if start else -1
    if end < 0:
        return None
    try:
        pairs = [line.split(": ", 1) for line in raw[start.end() : end].decode().split("\r\n")]
        headers = {k.lower(): v for k, v in pairs}
        n = int(headers["content-length"])
    except (ValueError, KeyError, UnicodeDecodeError):
        return None
    block = raw[end + 4 : end + 4 + n]
    after = end + 4 + n
    if n < 0 or len(block) != n or raw[after : after + 4] != b"\r\n\r\n":
        return None
    digest = headers.get("warc-block-digest")
    if digest and digest.startswith("sha256:") and digest[7:] != sha256(block):
        return None
    return headers, block, after + 4


def _member(raw: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds, whose checksum zlib verifies, and where it ends; of a broken one what comes before the damage, and None."""
    packer, out, view, fed = zlib.decompressobj(31), [], memoryview(raw), at
    while not packer.eof and fed < len(raw):
        before = packer.copy()
        try:
            out.append(packer.decompress(view[fed : fed + 65536]))
        except zlib.error:
            try:  # again byte by byte, up to the damage
                for k in range(fed, min(len(raw), fed + 65536)):
                    out.append(before.decompress(view[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(out), None
        fed = min(len(raw), fed + 65536)
    return b"".join(out), fed - len(packer.unused_data) if packer.eof else None


def salvage(raw: bytes, members: bool = True):
    """("record", offset, headers, block) and ("gap", start, end, reason) in the order of the file.

    Records within a gzip member have the member's offset. In a member of several records those around a damaged one are recovered by their version
    lines, and the gap is the member with the bytes of its content that are lost; of a member that cannot be unpacked to its end, the
    records before the damage.
    """
    at, gap = 0, None
    while at < len(raw):
        found, stop = [], None
        if members and raw[at : at + 3] == b"\x1f\x8b\x08":
            inside, stop = _member(raw, at)
            reason, parts = "broken member", list(salvage(inside, members=False))
            records = [p for p in parts if p[0] == "record"]
            if stop is None or not records:
                found, stop = records, None
            else:
                found = [p if p[0] == "record" else ("gap", at, stop, f"broken record in a member, bytes {p[1]}-{p[2]} of its content") for p in parts]
        else:
            one, reason = _parsed(raw, at), "no valid record"
            if one:
                found, stop = [("record", at, one[0], one[1])], one[2]
        if found and gap:
            yield "gap", gap[0], at, gap[1]
            gap = None
        for part in found:
            yield ("record", at, *part[2:]) if part[0] == "record" else part
        if stop is not None:
            if gap:
                yield "gap", gap[0], at, gap[1]
                gap = None
            at = stop
            continue
        gap = gap or (at, reason)
        line, member = _VERSION.search(raw, at + 1), raw.find(b"\x1f\x8b\x08", at + 1) if members else -1
        at = min(line.start() if line else len(raw), member if member > 0 else len(raw))
    if gap:
        yield "gap", gap[0], len(raw), gap[1]


def with_revisits(pages: DataFrame, min_bytes: int = 100, broadcast_rows: int = 50_000) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the smallest page with the same payload, for all others.

    Payloads below ``min_bytes`` refer to none. Only payloads that occur twice
    meet the pages again; their smallest ids come from partial sums, so that no
    payload's pages gather in one task.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    large = own.filter(F.octet_length("html") >= min_bytes)
    first = written(large.groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-repeated")
    if first.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = own.join(F.broadcast(first.drop("n")), "digest", "left")
    else:  # a payload that many pages have is not gathered in one task
        joined = skew_join(own, first.drop("n"), ["digest"], heavy_keys(first, ["digest"], pages.count()), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"))


def write_warc(pages: DataFrame, min_bytes: int = 100, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); gives the list of files (path, records, bytes).

    Tasks write files of about ``roll_bytes`` under names of their own attempt.
    A null html is an empty payload; rows repeated with the smallest id of their
    payload are all responses; null page ids refer to the smallest id. A page may be of any length; a task holds one at a time. Other columns
    are not read, so their names cannot clash. An empty table gives no file.
    """
    spark = pages.sparkSession
    base = shared_dir(spark, "warc")
    fs, root = filesystem(base)
    fs.create_dir(root, recursive=True)

    def run(batches):
        fs, top = filesystem(base)
        task, done, stream, n, size = TaskContext.get(), [], None, 0, 0
        for b in batches:
            for page_id, url, html, digest, refers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if stream is None:
                    name, n, size = f"/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz", 0, 0
                    stream = fs.open_output_stream(top + name, compression=None)
                raw = page_record(page_id, url, html.encode(), digest, refers)
                stream.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= roll_bytes:
                    stream.close()
                    done.append((base.rstrip("/") + name, n, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((base.rstrip("/") + name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    files = with_revisits(pages, min_bytes).mapInArrow(run, "path string, records long, bytes long")
    manifest = shared_dir(spark, "warc-manifest")
    files.write.parquet(manifest)
    return spark.read.schema(files.schema).parquet(manifest)


RECORDS = "path string, offset long, kind string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string, gap_end long"


def _page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_warc(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Records (kind ``record``) and quarantined gaps (kind ``gap``) of the files in column ``path``.

    A revisit's payload length and digest are those its headers state; of a
    response they are taken from the payload itself, and a payload that differs
    from its stated digest is a gap. A file is held by one task, so a page's length is bounded by a file's; repeated records are
    rows of their own; files without records, and an empty list, give none.
    """
    spark = files.sparkSession
    names = [f.strip().split()[0] for f in RECORDS.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.strip().split()[1]] for f in RECORDS.split(",")]

    def rows(path):
        fs, local = filesystem(path)
        with fs.open_input_stream(local, compression=None) as stream:
            raw = stream.read()
        for what, at, a, b in salvage(raw):
            if what == "gap":
                yield (path, at, "gap", None, None, None, None, None, None, None, b, a)
                continue
            head, _, payload = b.partition(b"\r\n\r\n")
            stated = re.search(rb"Content-Length: (\d+)", head)
            kind, digest = a.get("warc-type"), a.get("warc-payload-digest", "").removeprefix("sha256:")
            n = int(stated[1]) if kind == "revisit" and stated else len(payload)
            if kind == "response":
                own = sha256(payload)
                if digest and own != digest:
                    yield (path, at, "gap", None, None, None, None, None, None, None, "payload differs from its digest", at)
                    continue
                digest = own
            yield (path, at, "record", _page_of(a.get("warc-record-id")), a.get("warc-target-uri"), kind, n, digest,
                   _page_of(a.get("warc-refers-to")), payload if payloads else None, None, None)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                for r in rows(path):
                    held.append(r)
                    size += len(r[9] or b"") + 300
                    if size > 8 << 20:
                        yield _table(held, names, types)
                        held, size = [], 0
                if held:
                    yield _table(held, names, types)

    paths = [(r[0],) for r in files.select("path").collect()]  # one row for each file
    listed = spark.createDataFrame(paths, "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(run, RECORDS)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
