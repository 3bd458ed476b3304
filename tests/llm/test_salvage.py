"""Salvage inside gzip members of several records; repeated payloads beyond what is broadcast."""

import random
import zlib

from quillspark.llm import warc


def packed(raw):
    p = zlib.compressobj(6, zlib.DEFLATED, 31)
    return p.compress(raw) + p.flush()


def plain(n, body=b"payload "):
    return warc.page_record(n, f"http://x/{n}", body + b"%d" % n, warc.sha256(body + b"%d" % n), None, gz=False)


def ids(found):
    return [f[2]["warc-record-id"] for f in found if f[0] == "record"]


def test_records_around_a_damaged_one_of_a_member():
    records = [plain(n) for n in range(3)]
    hurt = bytearray(b"".join(records))
    hurt[len(records[0]) + len(records[1]) - 6] ^= 255
    got = list(warc.salvage(packed(bytes(hurt))))
    assert ids(got) == ["<urn:page:0>", "<urn:page:2>"] and [f[0] for f in got] == ["record", "gap", "record"]
    lost = f"{len(records[0])}-{len(records[0]) + len(records[1])}"
    assert got[1][1:3] == (0, len(packed(bytes(hurt)))) and lost in got[1][3]


def test_records_before_the_damage_of_a_member():
    rng = random.Random(1)
    records = [plain(n, bytes(rng.randrange(33, 127) for _ in range(2000))) for n in range(40)]
    raw, behind = bytearray(packed(b"".join(records))), warc.page_record(99, "u", b"later", warc.sha256(b"later"), None)
    raw[len(raw) // 2] ^= 255
    got = list(warc.salvage(bytes(raw) + behind))
    found = ids(got)
    numbers = [int(f[10:-1]) for f in found]  # what unpacks is judged by its digests
    assert numbers[-1] == 99 and 10 <= len(numbers) - 1 < 40 and numbers[:-1] == sorted(set(numbers[:-1])) and numbers[-2] < 40
    gaps = [f for f in got if f[0] == "gap"]
    assert [(g[1], g[2]) for g in gaps] == [(0, len(raw))]
    assert ids(warc.salvage(bytes(raw[: len(raw) // 3]))) == [f"<urn:page:{n}>" for n in range(len(ids(warc.salvage(bytes(raw[: len(raw) // 3])))))]


def test_a_member_without_a_record_and_an_empty_one():
    good = warc.page_record(1, "u", b"x", warc.sha256(b"x"), None)
    for odd in (packed(b"no record at all"), packed(b"")):
        got = list(warc.salvage(odd + good))
        assert ids(got) == ["<urn:page:1>"] and [f[0] for f in got] == ["gap", "record"] and got[0][1:3] == (0, len(odd))


def test_many_repeated_payloads(spark):
    """Beyond the broadcast bound the result is the same, with one payload that most pages have."""
    pages = [(n, "u", "common " * 20 if n % 3 else f"page {n // 9} " * 20) for n in range(3000)] + [(None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    plain_ = lambda d: sorted((r.page_id is None, r.page_id, r.refers_to, r.digest) for r in d.collect())
    assert plain_(warc.with_revisits(df, broadcast_rows=5)) == plain_(warc.with_revisits(df))
