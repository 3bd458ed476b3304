"""SimHash, token files, decontamination, WARC, chats and the pipeline against brute force and round trips."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from quillspark.llm import chat, decontam, entries, simhash, tokens, warc
from quillspark.session import written

ODD = [None, "", " \t\n", "One two", "one TWO", "É b c", "é b c", "a b c d e f g " * 400, "x" * 3000]


def frame(spark, rows, schema="doc_id long, text string, key int, h int, c string"):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], schema)


def brute_fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, fp, radius):
    root = {k: k for k in range(len(rows))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return [least[find(k)] for k in range(len(rows))]


def test_simhash_fingerprints_and_components(spark):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(50)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 200))) for _ in range(12)]
    rows = list(enumerate(ODD)) + [(None, "One two"), (3, "One two")]
    for k in range(80):
        t = rnd.choice(base).split()
        if k % 3:
            t[rnd.randrange(len(t))] = "changed"
        rows.append((100 + k, " ".join(t)))
    fp = [brute_fingerprint(t) for _, t in rows]
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fp, brute_components(rows, fp, 3), strict=True)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [5, 4096])
def test_fingerprint_links_lose_none(spark, chunk):
    rnd = random.Random(2)
    values = {rnd.getrandbits(64) for _ in range(40)} | {0}
    for v in list(values)[:20]:
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))))
    values = sorted(values)
    links = simhash.fingerprint_links(spark.createDataFrame([(f"{v:016x}",) for v in values], "fp string"), 3, chunk=chunk).collect()
    assert all((int(a, 16) ^ int(b, 16)).bit_count() <= 3 for a, b in links)
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(links or [("a", "a")], "a string, b string")).collect()}
    want = brute_components([(k, "") for k in range(len(values))], values, 3)
    got = collections.defaultdict(set)
    for k, v in enumerate(values):
        got[roots.get(f"{v:016x}", f"{v:016x}")].add(k)
    assert {frozenset(g) for g in got.values()} == {frozenset(k for k in range(len(values)) if want[k] == c) for c in set(want)}


def test_pivots_discard_no_link():
    rnd = np.random.default_rng(4)
    v = np.concatenate([rnd.integers(0, 2**64, 300, dtype=np.uint64), np.uint64(2) ** rnd.integers(0, 64, 40, dtype=np.uint64)])
    v = np.unique(np.concatenate([v, v[:150] ^ (np.uint64(1) << rnd.integers(0, 64, 150, dtype=np.uint64))])).reshape(-1, 1)
    near = simhash.pivot_table(v, simhash.pivots(1))
    tile = np.sort(rnd.integers(0, 3, len(v)))
    for side in (np.full(len(v), -1), rnd.integers(0, 2, len(v))):
        a, b = simhash.near_links(tile, side, v, near, 3)
        linked = [(i, j) for i in range(len(v)) for j in range(i) if tile[i] == tile[j] and (side[i] < 0 or side[i] != side[j]) and int(v[i, 0] ^ v[j, 0]).bit_count() <= 3]
        assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} <= {tuple(sorted(p)) for p in linked}
        root = list(range(len(v)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            assert find(i) != find(j)  # a forest
            root[find(i)] = find(j)
        assert linked and all(find(i) == find(j) for i, j in linked)


def test_more_blocks_for_more_fingerprints():
    assert [simhash.blocks_for(n, 3, 1) for n in (0, 1000, 250_000, 10**8, 10**10, 10**12)] == [4, 4, 4, 5, 6, 8]


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_any_number_of_blocks_gives_the_same_links(spark, blocks):
    rnd = random.Random(7)
    values = [rnd.getrandbits(64) for _ in range(30)]
    values += [v ^ sum(1 << b for b in rnd.sample(range(64), k)) for v in values for k in (1, 2, 3, 4)]
    frame_ = spark.createDataFrame([(f"{v:016x}",) for v in set(values)], "fp string")
    roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(frame_, 3, blocks=blocks, chunk=7, batch_rows=5)).collect()}
    distinct = sorted(set(values))
    want = brute_components([(k, "") for k in range(len(distinct))], distinct, 3)
    groups = lambda name: {frozenset(k for k in range(len(distinct)) if name(k) == c) for c in map(name, range(len(distinct)))}
    assert groups(lambda k: roots.get(f"{distinct[k]:016x}", f"{distinct[k]:016x}")) == groups(want.__getitem__)


def test_chain_components(spark):
    links = [(f"{k:04d}", f"{k + 1:04d}") for k in range(200)] + [("x", "y"), ("y", "x")]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {**{f"{k:04d}": "0000" for k in range(1, 201)}, "y": "x"}


@pytest.mark.parametrize("bits", [1, 3, 13, 16, 17, 31])
def test_bit_packing(bits):
    ids = np.random.default_rng(0).integers(0, 2**bits, size=1000, dtype=np.uint32)
    packed = tokens.pack(ids, bits)
    assert len(packed) == 16 * 8 * bits and (tokens.unpack(packed, 1000, bits) == ids).all()


def test_token_file_random_access():
    rnd, out = np.random.default_rng(1), io.BytesIO()
    writer = tokens.TokenWriter(out, 50257)
    docs = [rnd.integers(0, 50257, size=n, dtype=np.uint32) for n in (0, 1, 70_000, 5, 200_000)]
    for k, d in enumerate(docs):
        writer.add([k if k else None], d, np.array([len(d)]))
    writer.close()
    f = tokens.TokenFile(io.BytesIO(out.getvalue()), len(out.getvalue()))
    every = np.concatenate(docs)
    assert f.bits == 16 and all((f.slice(a, b) == every[a:b]).all() for a, b in ((0, 0), (3, 9), (65_530, 65_540), (100_000, 270_000)))
    assert list(f.documents()) == [(k or None, len(d), zlib.crc32(d.astype("<u4").tobytes())) for k, d in enumerate(docs)]
    with pytest.raises(ValueError):
        tokens.TokenFile(io.BytesIO(out.getvalue()[:-9]), len(out.getvalue()) - 9)


TRICKY = [
    None, "", " ", "  ", "a  b", " x", "x ", "a\n\n b\n", "a \n b", "é ü\xa0 z", "don't 's", "<|endoftext|> x", "\n", "x\n y", "a\t b", " \n x", "日本 語", "a" * 300 + " b",
    "a \n \n b", "a\n \nb", "a \n ", "a \xa0 \xa0", " \n \n", "a \t \n b \n", "\u3000 \u3000x", "x\n ", "\n \n", "1,000.5 -- !? ...", "\x85 a", "a \x85b  c", "  a", "Ġ ĠA Ġ",
]


def library_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("most", [2, 1_000_000])
def test_encoder_equals_the_library(most):
    encoder = tokens.Encoder(entries.tokenizer_path(), most)
    for _ in range(2):
        ids, n = encoder.encode(pa.array(TRICKY, pa.string()), 0)
        assert [c.tolist() for c in np.split(ids, np.cumsum(n)[:-1])] == [[*library_ids(encoder, t), 0] for t in TRICKY]


def test_encoder_equals_the_library_on_random_texts():
    rnd, encoder = random.Random(6), tokens.Encoder(entries.tokenizer_path(), 3000)
    bits = [*".,;:!?\n\t", "a", "É", "word", "Don't", "x²", "½", "日本", "İ", "1", "_", "\xa0", "\u3000", "\u2028", "\x1c", *[" "] * 12]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 16))) for _ in range(30_000)]
    for k in range(0, len(texts), 2000):
        part = texts[k : k + 2000]
        ids, n = encoder.encode(pa.array(part), 0)
        want = [[*e.ids, 0] for e in encoder.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        assert [c.tolist() for c in np.split(ids, np.cumsum(n)[:-1])] == want


def test_token_files(spark):
    rows = [(k * 7 % 23 if k % 5 else None, t) for k, t in enumerate([*TRICKY, *ODD])]
    encoder, start, want = tokens.Encoder(entries.tokenizer_path()), 0, []
    got = [tuple(r) for r in tokens.read_tokens(spark, tokens.write_tokens(frame(spark, rows), entries.tokenizer_path())).orderBy("start").collect()]
    ids = collections.defaultdict(collections.Counter)
    for i, t in rows:
        x = np.array([*library_ids(encoder, t), 0], "<u4")
        ids[i][(len(x), zlib.crc32(x.tobytes()))] += 1
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    for i, at, n, crc in got:
        assert at == start
        want.append(ids[i][(n, crc)])
        ids[i][(n, crc)] -= 1
        start += n
    assert all(w > 0 for w in want)
    assert tokens.read_tokens(spark, tokens.write_tokens(frame(spark, []), entries.tokenizer_path())).count() == 0


def test_decontamination(spark):
    rnd = random.Random(4)
    noise = lambda n: " ".join(rnd.choice(["la", "mo", "ki", "tu", "re", "so"]) + str(rnd.choice("abcdefg")) for _ in range(n))
    item = "A farmer named Tom sold 12 apples to Mary for 3 dollars each and then bought 5 kg of flour at the market in Rome."
    again = item.replace("Tom", "Jim").replace("Mary", "Ann").replace("12", "40").replace("3 dollars", "7 euros").replace("Rome", "Oslo")
    mixed = item.replace("Tom", "Jim") + " Tom again"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, noise(30)), (5, "what is the capital of that")], "item_id long, text string")
    rows = [(10, noise(50) + ".\n" + item + "\n" + noise(60)), (11, noise(40) + " " + again), (12, noise(300)), (13, None), (14, ""), (15, item[:40]), (16, mixed), (None, item), (17, "well, what is the capital of that place")]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(10, 1), (11, 1), (16, 1), (None, 1), (17, 5)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, rows), bench, broadcast_rows=0, sieve_bits=4).collect()} == got
    assert decontam.contaminated(frame(spark, rows), bench.limit(0)).count() == 0 and decontam.contaminated(frame(spark, []), bench).count() == 0


def test_slots_must_be_consistent(spark):
    item = "Bob gave 3 pens to his friend and later Bob took 3 cups from the old shelf near Bob again today"
    bench = spark.createDataFrame([(1, f"now {item}")], "item_id long, text string")
    swap = lambda *names: "now " + re.sub("Bob", lambda m, n=iter(names): next(n), item)
    rows = [(1, swap("Al", "Al", "Al")), (2, swap("Al", "Ed", "Cy"))]
    got = {r.doc_id: r.cover for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert 1 in got and 2 not in got


def test_decontamination_finds_planted_items(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet").collect(), spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    planted = {(d.doc_id, b.item_id) for d in docs for b in bench if d.text and b.text in d.text}
    assert planted and {(r.doc_id, r.item_id) for r in entries.op7_decontamination(spark, DATA).collect()} == planted


def test_warc_round_trip_and_revisits(spark):
    long = "<p>é" * 60
    rows = [(5, "u", long), (3, "a b\r\nX: y", long), (3, "v", long), (9, None, "short"), (7, "w", None), (None, "n", long), (8, "r", "WARC/1.1\r\nx\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.read_warc(warc.write_warc(pages, roll_bytes=500), payloads=True).filter("kind = 'record'").collect()
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h == long and i != 3
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


@pytest.mark.parametrize("gz", [True, False])
def test_salvage(gz):
    parts = [warc.page_record(k, "u", f"<p>page {k}</p>".encode() * 30, warc.sha256(f"<p>page {k}</p>".encode() * 30), None, gz) for k in range(5)]
    whole = list(warc.salvage(b"".join(parts)))
    assert [w[0] for w in whole] == ["record"] * 5
    bad = bytearray(parts[1])
    bad[len(bad) // 2] ^= 255
    broken = parts[0] + bytes(bad) + b"junk" + parts[2] + parts[3][: len(parts[3]) // 2] + parts[4] + b"tail"
    got = list(warc.salvage(broken))
    ids = [g[2]["warc-record-id"] for g in got if g[0] == "record"]
    assert ids == [f"<urn:page:{k}>" for k in (0, 2, 4)]
    gaps = [broken[g[1] : g[2]] for g in got if g[0] == "gap"]
    assert gaps == [bytes(bad) + b"junk", parts[3][: len(parts[3]) // 2], b"tail"]


def test_chat_template_is_reversible():
    rnd = random.Random(5)
    bits = ["\\", "###", "</turn>", ":", "\n", "### user:\n", "a", "<", "/turn>", "#", "\\###", "é"]
    for _ in range(300):
        said = [("".join(rnd.choices(bits, k=rnd.randint(0, 3))), "".join(rnd.choices(bits, k=rnd.randint(0, 9)))) for _ in range(3)]
        assert chat.parse("".join(chat.render(*m)[0] for m in said)) == said
    whole, a, z = chat.render("assistant", "x</turn>\\")
    assert chat.unescape(whole[a:z]) == "x</turn>\\"
    with pytest.raises(ValueError):
        chat.parse("### user:\nx")


def test_event_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", "assistant", "Hel"), (1, 1, 3, "delta", "assistant", "lo"),
        (1, 0, 4, "edit", "user", "hey"), (1, 1, 5, "regenerate", "assistant", None), (1, 1, 6, "delta", "assistant", "Hi!"), (2, 0, 0, "delta", "user", "late"),
        (None, None, None, "message", None, None), (None, None, None, "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    out = chat.format_chats(events)
    said = {c: [m for r in sorted(out.filter(F.col("conv_id").eqNullSafe(F.lit(c))).collect(), key=lambda r: r.pos) for m in chat.parse(r.rendered)] for c in (1, 2, None)}
    assert said == {1: [("user", "hey"), ("assistant", "Hi!")], 2: [("user", "late")], None: [("", ""), ("", "")]}
    got = {r.conv_id: r for r in chat.read_chats(out).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 3 and got[1].loss_sha256 == hashlib.sha256(b"Hi!").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhey\nassistant\nHi!\n").hexdigest()
    assert chat.read_chats(chat.format_chats(events.limit(0))).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, frames = docs.columns, []
    for name, stage in p.STAGES:
        frames.append(written(stage(spark, docs, DATA), f"test-{name}"))
        docs = frames[-1]
    good, apart, clean, mix, last = (f.collect() for f in frames)
    assert all(f.columns == columns for f in frames[:4])
    bench = [b.text for b in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not [d for d in clean if any(b in d.text for b in bench)]
    assert {d.doc_id for d in apart} - {d.doc_id for d in clean} <= {d.doc_id for d in apart if any(b in d.text for b in bench)}
    assert len({d.text for d in apart}) == len(apart) and {d.text for d in apart} <= {d.text for d in good}
    assert len(last) == len(mix) and sum(r.n_tokens for r in last) > 0
    encoder = tokens.Encoder(entries.tokenizer_path())
    want = collections.Counter((m.doc_id, len(x), zlib.crc32(x.tobytes())) for m in mix for x in [np.array([*library_ids(encoder, m.text), 0], "<u4")])
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in last) == want
