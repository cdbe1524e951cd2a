"""The parts of the operators that need no tables."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from tallyline.llm import context_mixing as cm
from tallyline.llm import linking, near_dedup, packing, pii, secrets, topics, words

texts = st.lists(st.text(st.sampled_from("ab \n\tAé\x85\x1c"), max_size=30) | st.none(), max_size=8)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_and_lines(values, block):
    found = words.texts_of(pa.array(values, pa.string()))
    spans = words.words_of(found)
    raw = [found.data[a:b].tobytes().decode() for a, b in zip(spans.start, spans.end)]
    assert raw == [w for v in values for w in brute.words(v)]
    assert spans.counts().tolist() == [len(brute.words(v)) for v in values]
    lines = words.lines_of(found)
    assert [found.data[a:b].tobytes().decode() for a, b in zip(lines.start, lines.end)] == [x for v in values for x in (v or "").split("\n")]
    for lower in (False, True):
        hashes = words.hash_spans(found.data, spans, lower).tolist()
        same = [brute.lower(w) if lower else w for w in raw]
        assert len(set(zip(hashes, same))) == len(set(hashes)) == len(set(same))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(values, pa.string())})
    assert sum(len(t) for _, t in words.slices(batch, most=block)) == len(values)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    found = words.texts_of(pa.array(["some words of a text " * 50, "x" * 300]))
    spans = words.words_of(found)
    whole = words.hash_spans(found.data, spans)
    monkeypatch.setattr(words, "BLOCK", 16)
    assert (words.hash_spans(found.data, spans) == whole).all()


@pytest.mark.parametrize(
    "text, spans",
    [
        ("write to jane (at) mail [dot] example (dot) org now", [("email", "jane (at) mail [dot] example (dot) org")]),
        ("jane at mail dot example dot org", [("email", "jane at mail dot example dot org")]),
        ("jаne＠mail.org", [("email", "jаne＠mail.org")]),
        ("call plus 4 nine one two three four five six seven", [("phone", "plus 4 nine one two three four five six seven")]),
        ("call +4 one two three four five six seven", [("phone", "+4 one two three four five six seven")]),
        ("card four one one one one one one one one one one one one one one one", [("card", "four one one one one one one one one one one one one one one one")]),
        ("host 10 dot 0 dot 0 dot 255 here", [("ip", "10 dot 0 dot 0 dot 255")]),
        ("at one nine two dot one six eight dot zero dot seven now", [("ip", "one nine two dot one six eight dot zero dot seven")]),
        ("call +1 five five five 0123 nine eight seven", [("phone", "+1 five five five 0123 nine eight seven")]),
        ("one dot two dot three", []),
        ("10​.0.0.1", [("ip", "10​.0.0.1")]),
        ("look at example and dot the letters, one two three", []),
        ("he was at work. Dot came", []),
    ],
)
def test_hidden_data(text, spans):
    found = pii.find_hidden(text, pii.find_plain(text))
    assert [(k, text[a:b]) for k, a, b in found] == spans


@pytest.mark.parametrize(
    "text, spans",
    [
        ("mail john [at] example dot com now", [("email", "john [at] example dot com")]),
        ("mail john@example dot com", [("email", "john@example dot com")]),
        ("mail john@mail.example dot com", [("email", "john@mail.example dot com")]),
        ("mail john at example [dot] com", [("email", "john at example [dot] com")]),
        ("mail john at mail.example dot com", [("email", "john at mail.example dot com")]),
        ("sit at home.me at example dot com", [("email", "home.me at example dot com")]),
        ("call plus 44 20 7946 0958", [("phone", "plus 44 20 7946 0958")]),
        ("host one point two point three point four", [("ip", "one point two point three point four")]),
        ("host 10.0 dot 0 [dot] 255 here", [("ip", "10.0 dot 0 [dot] 255")]),
        ("look at example.com and at home.", []),
        ("one point two plus 3", []),
    ],
)
def test_mixed_disguises(text, spans):
    found = pii.find_hidden(text, pii.find_plain(text))
    assert [(k, text[a:b]) for k, a, b in found] == spans


def test_long_mixed_disguises_take_little_time():
    for text in ("a at a.b " * 60_000, "a at b" + ".c" * 250_000, "a@b" + " dot c" * 80_000, "a@b.c" * 100_000 + " dot d", "1 dot 2." * 60_000, "plus 1 " * 70_000, "one point two " * 30_000):
        plain = pii.find_plain(text)
        pii.find_hidden(text, plain)


PII = st.text(st.sampled_from("a.@-+ 10425(9)а"), max_size=60)


@settings(max_examples=500, deadline=None)
@given(PII)
def test_plain_data(text):
    assert pii.find_plain(text) == brute.plain_pii(text)
    plain = pii.find_plain(text)
    assert not set(plain) & set(pii.find_hidden(text, plain))


def test_long_texts_take_little_time():
    for text in ("a" * 500_000, "1" * 500_000, "1." * 200_000, "+1" * 200_000, "@" * 200_000, "token " * 100_000, "zero " * 100_000, "a@" * 100_000):
        plain = pii.find_plain(text)
        pii.find_hidden(text, plain)
        secrets.find_linked(text, secrets.find_strong(text))


SECRET = st.lists(st.sampled_from(["token", "passwd", "Secret", "api_key", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234567890", "0123abcd", "deadbeef0123", "\n", "ſ"]), max_size=14)


@settings(max_examples=500, deadline=None)
@given(SECRET)
def test_plain_secrets(parts):
    text = "".join(parts)
    assert secrets.find_strong(text) == brute.strong_secrets(text)


def test_weak_parts_need_company():
    part = "9fK2mQ7xL4vB8nR1"
    alone = f"the word {part} stands alone"
    assert secrets.find_linked(alone, secrets.find_strong(alone)) == []
    name = "user = jane.doe and nothing else"
    assert secrets.find_linked(name, secrets.find_strong(name)) == []
    both = f"user = jane.doe\nthen {part}\nhost = db.example.org"
    found = secrets.find_linked(both, secrets.find_strong(both))
    assert {(k, both[a:b]) for k, a, b in found} == {("identifier", "jane.doe"), ("material", part), ("endpoint", "db.example.org")}
    apart = f"user = jane.doe\n\nthen {part}"
    assert secrets.find_linked(apart, secrets.find_strong(apart)) == []
    far = f"user = jane.doe {'x ' * 200} {part}"
    assert secrets.find_linked(far, secrets.find_strong(far)) == []


def test_weak_parts_of_any_length_and_case():
    key = "9fK2mQ7xL4vB8nR1" * 13
    name, path = "jane." + "doe" * 40, "db.example.org/" + "part/" * 60 + "end"
    text = f"USER = {name}\nthen {key}\nHost: {path}"
    found = {(k, text[a:b]) for k, a, b in secrets.find_linked(text, secrets.find_strong(text))}
    assert found == {("identifier", name), ("material", key), ("endpoint", path)}
    text = f"then {key} at HTTPS://{path}"
    found = {(k, text[a:b]) for k, a, b in secrets.find_linked(text, secrets.find_strong(text))}
    assert found == {("material", key), ("endpoint", f"HTTPS://{path}")}
    text = "user: jane 9fK2mQ7x URL=db.example.org"
    found = {(k, text[a:b]) for k, a, b in secrets.find_linked(text, secrets.find_strong(text))}
    assert found == {("identifier", "jane"), ("material", "9fK2mQ7x"), ("endpoint", "db.example.org")}
    for text in (f"user: jane {'x ' * 30}9fK2mQ7x", "user: jane has version10 of covid-19", "user: jane\n\n9fK2mQ7x"):
        assert secrets.find_linked(text, secrets.find_strong(text)) == []


def test_long_weak_parts_take_little_time():
    for word in ("a1" * 250_000, "a1=" * 100_000, "a1" * 250_000 + "===", "a1b2c3d4 " * 50_000, "http://aaaa" * 50_000, "a+" * 250_000):
        text = f"user=jane {word} host=db.example"
        secrets.find_linked(text, secrets.find_strong(text))


def test_registers_merge_and_tell_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for common, alone in ((900, 50), (500, 500), (0, 400)):
        a, b = pool[: common + alone], np.concatenate([pool[:common], pool[2000 : 2000 + alone]])
        marks = near_dedup.registers(np.concatenate([a, b, np.union1d(a, b)]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + len(np.union1d(a, b))]))
        assert (marks[2] == np.maximum(marks[0], marks[1])).all()
        truth = common / (common + 2 * alone)
        guess = near_dedup.likely_similarity(marks[:1], marks[1:2], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(guess - truth) < 0.12
    assert (near_dedup.registers(pool[:0], np.array([0, 0])) == 0).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=30), st.integers(1, 40))
def test_packing_plan(counts, groups):
    capacity, small = 100, 100 // packing.SMALL_SHARE
    large = {n: c for n, c in counts.items() if n > small}
    plan = packing.plan(counts, capacity, groups)
    items = [n for n in sorted(large, reverse=True) for _ in range(large[n])]
    used, slots = collections.Counter(), set()
    covered = 0
    for s in plan.segments:
        for k in range(s.count):
            place = (s.bin + k // s.each, s.slot + k % s.each)
            assert place not in slots
            slots.add(place)
            used[place[0]] += items[s.rank + k]
            covered += 1
    assert covered == len(items) and all(v <= capacity for v in used.values()) and len(used) == plan.bins
    gaps = collections.Counter(capacity - v for v in used.values())
    fills, new, rest = packing.plan_small({n: c for n, c in counts.items() if n <= small}, dict(gaps), capacity, capacity)
    assert sum(rest.values()) == plan.bins + new
    assert sum(f.count for f in fills) == sum(c for n, c in counts.items() if n <= small)
    assert sum((capacity - gap) * n for gap, n in rest.items()) == sum(n * c for n, c in counts.items())
    if groups >= 40:
        assert plan.bins + new <= brute.best_fit([n for n, c in counts.items() for _ in range(c)], capacity) + 1


def units(words_by_kind):
    found = sorted(words_by_kind)
    data = np.frombuffer(b"".join(w for w, _ in found), np.uint8)
    return cm.Units(
        data, np.cumsum([0] + [len(w) for w, _ in found]), np.array([k for _, k in found]), np.array([words_by_kind[f] for f in found])
    )


def test_path_counts():
    found = units({(b"ab ", 0): 3, (b"ab ", 1): 2, (b"ac ", 0): 1, (b"b ", 1): 4, (b"\n", 0): 5, (b"\n", 1): 0})
    by_spelling, by_class = cm.exact_counts(found)
    for i in range(len(found.kind)):
        word = found.data[found.offsets[i] : found.offsets[i + 1]].tobytes()
        for place in range(len(word)):
            for j in range(9):
                def path(w):
                    bits = "".join(f"{b:08b}" for b in w)
                    return bits[: 8 * place + j]

                alike = [k for k in range(len(found.kind)) if path(found.data[found.offsets[k] : found.offsets[k + 1]].tobytes()) == path(word)]
                at = found.offsets[i] + place
                assert by_spelling[j, at] == sum(found.count[k] for k in alike)
                assert by_class[j, at] == sum(found.count[k] for k in alike if found.kind[k] == found.kind[i])


def test_both_bits_add_up_to_one():
    """Over a byte's last bit: two spellings that differ in it share all contexts before."""
    rng = np.random.default_rng(2)
    spelled = {(bytes(rng.choice(list(b"abcdefgh"), rng.integers(1, 7))) + b" ", int(rng.integers(0, 3))): int(rng.integers(0, 9)) for _ in range(400)}
    spelled |= {(w[:-2] + bytes([w[-2] ^ 1]) + b" ", k): 0 for w, k in list(spelled) if w[-2] ^ 1 not in b" \n" and (w[:-2] + bytes([w[-2] ^ 1]) + b" ", k) not in spelled}
    found = units(spelled)
    tables = cm.tables_of(*cm.table_counts(found))
    exact = cm.exact_counts(found)
    lesson = cm.learn(found, exact, tables)
    weights, refined = cm.merge_lessons(*lesson)
    x, gates = cm.inputs(found, exact, tables, False)
    p = cm.probability(cm.mixed(x, gates, weights), gates, refined)
    assert ((p > 0) & (p < 1)).all()
    at = {(found.data[found.offsets[i] : found.offsets[i + 1]].tobytes(), found.kind[i]): found.offsets[i + 1] - 2 for i in range(len(found.kind))}
    checked = 0
    for (word, kind), place in at.items():
        other = at.get((word[:-2] + bytes([word[-2] ^ 1]) + b" ", kind))
        if other is not None:
            assert p[7, place] + p[7, other] == pytest.approx(1, abs=1e-4)
            checked += 1
    assert checked > 300


def test_profiles_tell_languages_apart():
    found = words.texts_of(pa.array(["the and of that this", "THE AND OF THAT THIS", "der und die das ein", "", None]))
    p = topics.profiles(found)
    assert (p[0] == p[1]).all() and (p[0] != p[2]).any() and not p[3:].any()
    assert topics.nearest(p, p[[0, 2]].astype(np.float32)).tolist()[:3] == [0, 0, 1]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (7, None)]
    sets = brute.Sets({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if b is not None:
            sets.join(a, b)
    found = linking.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == {x: sets.find(x) for x in linked}
    assert linking.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
