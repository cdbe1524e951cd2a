"""Search, prefix trie and WARC bundles against plain Python: odd inputs, bounds made small, round trips."""

import base64
import glob
import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from tallyline.llm import conversation_trie, lexical_search, warc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Search


def plain_search(docs, items, k):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    found = set()
    for item, terms in asked.items():
        scored = []
        for (i, c), size in zip(counts, sizes):
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * n // total)))
                for t, times in terms.items() if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i, score))
        found |= {(item, rank, i, score) for rank, (_, _, i, score) in enumerate(sorted(scored, key=lambda s: s[:3] if s[2] is not None else (*s[:2], 0))[:k], 1)}
    return found


def searched(docs, items, k=20):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(docs, items, k).collect()]


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "five words, here AND five again"), (2, None), (3, " .,; "), (4, "É ü tail nul"), (None, "one two"), (None, "one"),
        (6, "x" * 200_000 + " w1x1"), (7, "absent"), (8, "again " * 500), (9, "w1x1 w2x2 line"),
    ]
    return spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "item_id long, text string, df int, number string")


def test_search(odd, none, items):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    wanted = [(r.item_id, r.text) for r in items.collect()]
    found = searched(odd, items, 3)
    assert sorted(found, key=str) == sorted(plain_search(docs, wanted, 3), key=str)
    assert {i for i, *_ in found} == {1, 4, None, 6, 8, 9}
    assert searched(none, items) == searched(odd, items.limit(0)) == searched(odd, items.filter("item_id in (2, 3)")) == []


def test_search_in_blocks_and_slices(odd, items, monkeypatch):
    whole = sorted(searched(odd, items), key=str)
    for name, value in {"BLOCK_BYTES": 64, "BLOCK_ITEMS": 2, "SLICE": 16, "CHUNK": 2, "ADDITIONS": 3}.items():
        monkeypatch.setattr(lexical_search, name, value)
    assert sorted(searched(odd, items), key=str) == whole
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 100)
    with pytest.raises(ValueError, match="distinct terms of one item"):
        lexical_search.search(odd, items)


def test_search_keeps_the_best_of_many(spark):
    rng = random.Random(5)
    docs = [(i // 2, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))) for i in range(1500)]
    items = [(i, " ".join(rng.choice("abcdefghz") for _ in range(4))) for i in range(12)]
    found = searched(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 20
    )
    assert sorted(found) == sorted(plain_search(docs, items, 20)) and len(found) == 240


# Trie


def plain_trie(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in own.items()}
    nodes = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    children, leaves, saved = Counter(), Counter(), Counter()
    for path in nodes:
        children[path[:-1]] += bool(path)
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1].encode()) if path else 0
    return sorted(
        (
            min(members)[0], len(path), min(nodes[path[:-1]])[0] if path else None, len(members), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c, last in sorted(members) if last).encode()).hexdigest(),
        )
        for path, members in nodes.items()
    )


@pytest.fixture(scope="module")
def turns(spark):
    """Conversations that share heads, copies, one long one, and rows with nulls, ties and repeats."""
    rng = random.Random(3)
    rows = []
    for c in range(120):
        first = ("user", "hello") if c % 3 else ("user", f"own {c}")
        rows.append((c, 0, *first))
        rows += [(c, t, rng.choice(["user", "tool", None]), rng.choice(["yes", "no", "é", None])) for t in range(1, rng.randrange(1, 12))]
    rows += [(c, t, "user", f"t{t}") for c in (200, 201, 207) for t in range(90)]
    rows += [(c, t, "user", f"copy{t}") for c in range(300, 330, 5) for t in range(4)]
    rows += [(400, None, "b", "x"), (400, None, "a", "y"), (400, 1, "b", "x"), (400, 1, "b", "x"), (None, 1, "user", "nobody"), (-7, 1, None, None)]
    return rows


def as_frame(spark, rows):
    schema = "conv_id long, turn int, role string, text string, depth int, k1 string, place long"
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], schema).repartition(3)


@pytest.mark.parametrize("bounds", [{}, {"shard_rows": 4, "levels": 2, "queue": 2, "chunk": 8}, {"shard_rows": 30, "levels": 3, "queue": 1}])
def test_trie(spark, turns, bounds):
    found = conversation_trie.prefix_trie(as_frame(spark, turns), **bounds)
    # c % 5 of a negative number is negative in SQL; -7 has no turns to borrow either way.
    assert sorted(map(tuple, found.collect())) == plain_trie(turns)


def test_trie_of_little(spark, turns):
    assert conversation_trie.prefix_trie(as_frame(spark, turns).limit(0)).count() == 0
    # Conversation 1 has fewer turns than it leaves out, and no family: the root alone.
    (row,) = conversation_trie.prefix_trie(as_frame(spark, [(1, 1, "user", "x")])).collect()
    assert tuple(row) == (1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())


def test_one_conversation_is_spread_over_tasks(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(4000)]
    summed = conversation_trie.own_prefixes(as_frame(spark, rows)).collect()
    assert sorted(r.j for r in summed) == list(range(1, 4001))
    by = {r.j: r for r in summed}
    assert all((by[j].g1, by[j].g2) == (by[j - 1].h1, by[j - 1].h2) for j in range(2, 4001))


def test_messages_wait_on_disk():
    rng, expected = random.Random(1), {}
    messages = conversation_trie.Messages(limit=3)
    sent = [((-rng.randrange(4), rng.randrange(5), 0), (1, rng.randrange(9), 2)) for _ in range(400)]
    for key, sums in sent:
        messages.send(key, sums)
        expected[key] = tuple(a + b for a, b in zip(expected.get(key, (0, 0, 0)), sums))
    assert messages.spills > 20
    keys = sorted({*expected, (-9, 0, 0), (0, 9, 9)})
    assert [messages.take(k) for k in keys] == [expected.get(k, (0, 0, 0)) for k in keys]


# WARC


@pytest.fixture
def odd_pages(spark):
    rows = [
        (1, "http://a/b c\r\nX: y", "same"), (2, None, "same"), (2, "http://b", "same"), (None, "http://c", "same"), (3, "u", None), (4, "u", ""),
        (5, "http://é", "WARC/1.1\r\n\r\n" * 50), (6, "u", "x" * 300_000), (None, "u", "nobody's"), (None, None, "nobody's"), (7, "u", "é"),
    ]
    return spark.createDataFrame([(*r, 5, "p", "s") for r in rows], "page_id long, url string, html string, row int, payload string, first string").repartition(2)


def test_warc_round_trip(spark, odd_pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_bundles(odd_pages, path, frame_bytes=500, bundle_bytes=200)
    found = warc.read_records(spark, path, payloads=True).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    pages = [(r.page_id, r.html or "") for r in odd_pages.collect()]
    expected = []
    for text in {t for _, t in pages}:
        ids = sorted((i for i, t in pages if t == text), key=lambda i: (i is None, i or 0))
        expected += [(i, len(text.encode()), digest(text), "revisit" if n else "response", ids[0] if n else None) for n, i in enumerate(ids)]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == sorted(expected, key=str)
    assert len({r.record_id for r in found}) == len(pages)
    responses = {r.record_id: r for r in found if r.record_type == "response"}
    assert sorted(bytes(r.payload).decode() for r in responses.values()) == sorted({t for _, t in pages})
    assert all(responses[r.refers_to_record].payload_digest == r.payload_digest for r in found if r.record_type == "revisit")
    assert {r.url for r in found if r.page_id == 1} == {"http://a/b%20c%0D%0AX:%20y"}

    # Any reader of Zstandard sees the records one after another.
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) > 2
    text = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(f, "rb").read()), read_across_frames=True).read() for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages) and text.endswith(b"\r\n\r\n")

    # One record from the end of the file and one frame.
    index = warc.record_index(spark, path)
    assert sorted((r.record_id, r.frame, r.offset, r.length) for r in index.collect()) == sorted((r.record_id, r.frame, r.offset, r.length) for r in found)
    some = [r.record_id for r in found][::3]
    ids = spark.createDataFrame([(i,) for i in [*some, "<urn:uuid:none>", None]], "record_id string")
    got = {r.record_id: r for r in warc.lookup(spark, path, index, ids).collect()}
    assert got == {r.record_id: r for r in found if r.record_id in some}
    assert warc.lookup(spark, path, index, ids.limit(0)).count() == 0


def test_warc_of_nothing(spark, odd_pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_bundles(odd_pages.limit(0), path)
    assert warc.read_records(spark, path).count() == warc.record_index(spark, path).count() == 0


def test_damage_is_seen():
    bundle = warc.Bundle(100, 3)
    for i in range(9):
        bundle.add(f"r{i}", f"record {i} ".encode() * 5)
    content = bundle.finish()
    frames = warc.seek_table(content)
    assert [f.plain for f in frames] == [100, 100, 100, 100, 50, 0] or sum(f.plain for f in frames) == 9 * 45
    assert frames[-1].start + frames[-1].packed + 8 + 12 * len(frames) + 9 == len(content)
    for name, frame, offset, length in warc.read_index(content, frames):
        assert warc.read_frame(content, frames[frame])[offset : offset + length] == f"record {name[1]} ".encode() * 5
    count, descriptor, magic = struct.unpack("<IBI", content[-9:])
    bent = frames[0]._replace(checksum=frames[0].checksum ^ 1)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_frame(content, bent)
    with pytest.raises(ValueError, match="seek table"):
        warc.seek_table(content[:-1])


def test_hot_payloads_stay_behind(odd_pages):
    rows = warc.prepared(odd_pages).filter(F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))).collect()
    assert len(rows) == 5 and all(bytes(r.payload) == b"" for r in rows)
