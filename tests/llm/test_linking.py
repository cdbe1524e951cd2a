"""Links among nodes that share a key, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyline.llm import line_dedup, linking

DISTANCE = 3


def _linked(spark, sims, monkeypatch, m=5):
    """(node -> component, rows staged by name, pairs that were verified)."""
    staged, seen = {}, set()

    def counted(df, name, keep=linking.staged):
        out = keep(df, name)
        staged[name] = staged.get(name, 0) + out.count()
        return out

    def verify(pairs):
        pairs = linking.staged(pairs, "verified")
        found = [(r.a, r.b) for r in pairs.collect()]
        assert len(found) == len(set(found)) and all(a < b for a, b in found)
        seen.update(found)
        return pairs

    monkeypatch.setattr(linking, "stored", counted)
    nodes = spark.createDataFrame(list(enumerate(sims)), "node long, sim long")
    nodes = nodes.select("node", line_dedup.block_keys(F.col("sim"), m).alias("keys"), "sim")
    groups = linking.link_buckets(
        nodes, verify, lambda a, b: F.bit_count(a("sim").bitwiseXOR(b("sim"))) <= DISTANCE,
        differ=("sim", lambda xor: F.bit_count(xor) <= DISTANCE),
    )
    return {r.node: r.component for r in groups.collect()}, staged, seen


def _components(sims):
    names = list(range(len(sims)))
    near = [(i, j) for i in range(len(sims)) for j in range(i) if (sims[i] ^ sims[j]).bit_count() <= DISTANCE]
    for _ in sims:
        for i, j in near:
            names[i] = names[j] = min(names[i], names[j])
    return {i: names[i] for pair in near for i in pair}


def _flipped(sim, n, rng):
    for bit in rng.sample(range(60), n):
        sim ^= 1 << bit
    return sim


@pytest.mark.parametrize("sizes", [(2, 3, 3, 4, 5), (7, 8, 9, 10), (30,)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, sizes):
    rng = random.Random(sum(sizes))
    sims = []
    for size in sizes:
        first = rng.getrandbits(60)
        sims += [_flipped(first, rng.choice((1, 2, 3, 5)), rng) for _ in range(size)]
    sims += [rng.getrandbits(60) for _ in range(20)]
    sims = list(dict.fromkeys(sims))
    rng.shuffle(sims)
    found, _, seen = _linked(spark, sims, monkeypatch)
    assert found == _components(sims) and found
    assert all((sims[a] ^ sims[b]).bit_count() <= DISTANCE for a, b in seen)


def test_keys_shared_by_chance_are_left_out_at_once(spark, monkeypatch):
    rng = random.Random(5)
    sims = []
    for _ in range(40):
        low = rng.getrandbits(24)
        sims += [rng.getrandbits(36) << 24 | low for _ in range(3)]
    found, staged, seen = _linked(spark, sims, monkeypatch)
    assert found == {} and not seen
    assert staged["rows"] == staged["several"] == 0
