"""Ranked search for many items by one automaton over the texts, without an index of documents.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII,
with A-Z lower-cased. All terms of the items go into one Aho-Corasick
automaton, each guarded by a blank before and behind; a text whose other
ASCII characters are blanks is read once, and every output of the automaton
is one whole occurrence of a term. So term frequencies come from the texts
alone. Document frequencies are counted from these outputs, then each task
adds up the scores of its documents for all items that have one of their
terms, and keeps the best ``k`` of each item; Spark ranks what the tasks kept.

The automaton is sent to every task, so its size is bounded: items are dealt
into blocks whose terms take at most about ``BLOCK_BYTES``, measured before
anything is collected, and each block scans all documents. One item whose own
distinct terms take more than ``ITEM_BYTES`` is refused with an error. Texts are
read in slices, terms of more than ``LONGEST`` bytes are replaced by their
SHA-256 on both sides, and nothing is grouped by a term or a document, so
neither a word in every text nor a very long text makes a large task.

Weights and scores are whole numbers (see ``weight`` and ``norm``). Rows with a
null text have no terms. Rows that share an item identifier, null included, are
one item with the terms of all of them. Documents may share identifiers: each
row is a document of its own. Of equal scores the smaller document identifier
comes first, null last. Items without terms, and empty tables, give no rows.
Further columns are not looked at.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.session import staged

BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 2000
ITEM_BYTES = 64 << 20
#: Bytes of text handed to the automaton at a time, and of the longest term it holds as it is.
SLICE = 1 << 20
LONGEST = 255
#: Documents, and additions to their scores, taken at a time.
CHUNK, ADDITIONS = 256, 1 << 21

_LONG = re.compile(rb"[^ ]{%d,}" % (LONGEST + 1))


def _table() -> bytes:
    """Byte to byte: A-Z to a-z, other letters, digits and bytes beyond ASCII as they are, the rest to a blank."""
    kept = lambda b: b > 127 or chr(b).isalnum()
    return bytes((b | 32 if 65 <= b <= 90 else b) if kept(b) else 32 for b in range(256))


_NORMAL = _table()


def slices(text: bytes) -> Iterator[tuple[bytes, int]]:
    """(blank-guarded part of the normalised text, how many terms it has), cut at blanks only."""
    data, at = b" " + text.translate(_NORMAL) + b" ", 0
    while at < len(data) - 1:
        end = data.find(b" ", min(at + SLICE, len(data) - 1))
        part, at = data[at : end + 1], end
        gaps = np.diff(np.flatnonzero(np.frombuffer(part, np.uint8) == 32)) - 1
        if gaps.max() > LONGEST:
            # The mark before the digest is a byte that no normalised text has.
            part = _LONG.sub(lambda m: b"\x01" + hashlib.sha256(m[0]).hexdigest().encode(), part)
        yield part, int(np.count_nonzero(gaps))


def weight(n: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def norm(n_terms: int, n: int, total: int) -> int:
    """Length of a document against the mean, in hundredths, by a quarter beyond 75."""
    return 75 + (25 * n_terms * n) // total


class Block(NamedTuple):
    """Terms of some items, and for each term the items (by number) and how often they have it."""

    terms: list
    first: np.ndarray
    items: np.ndarray
    times: np.ndarray
    n_items: int


def item_terms(items: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, term, times) of all items."""

    def count(batches):
        for batch in batches:
            rows, terms, times = [], [], []
            for i, text in enumerate(batch.column("text")):
                found = Counter(t for part, _ in slices(text.as_py() or b"") for t in part.split())
                rows += [i] * len(found)
                terms += found
                times += found.values()
            yield pa.record_batch(
                [batch.column("item").take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["item", "term", "times"]
            )

    rows = items.select(F.col(item).alias("item"), F.col("text").cast("binary").alias("text"))
    kind = dict(rows.dtypes)["item"]
    return rows.mapInArrow(count, f"item {kind}, term binary, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def _blocks(terms: DataFrame) -> DataFrame:
    """Items with the number of their block; refuses what no block can hold."""
    sizes = terms.groupBy("item").agg(F.sum(F.octet_length("term") + 16).alias("size"))
    total = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.max("size"), F.lit(0)).alias("longest")).first()
    if total["longest"] > ITEM_BYTES:
        raise ValueError(f"the distinct terms of one item take {total['longest']} bytes, more than {ITEM_BYTES}")
    # Half full on average, so that blocks dealt by hash stay near the bound.
    n = max(1, -(-2 * total["size"] // BLOCK_BYTES), -(-2 * total["n"] // BLOCK_ITEMS)) if total["size"] > BLOCK_BYTES or total["n"] > BLOCK_ITEMS else 1
    return sizes.select("item", F.pmod(F.xxhash64("item"), F.lit(n)).cast("int").alias("block"))


def _collected(rows: DataFrame) -> tuple[Block, DataFrame]:
    """A block's terms and items; ``rows`` has no more than a block's terms."""
    found = rows.collect()
    number = {item: i for i, item in enumerate(dict.fromkeys(r["item"] for r in found))}
    of_term = {}
    for r in found:
        of_term.setdefault(bytes(r["term"]), []).append((number[r["item"]], r["times"]))
    pairs = [p for held in of_term.values() for p in held]
    first = np.cumsum([0, *map(len, of_term.values())])
    block = Block(list(of_term), first, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), len(number))
    kind = dict(rows.dtypes)["item"]
    return block, rows.sparkSession.createDataFrame([(i, item) for item, i in number.items()], f"number int, item {kind}")


def automaton(terms: list):
    """Aho-Corasick automaton of blank-guarded terms; its outputs are places in the list."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        found.add_word(f" {term.decode('latin-1')} ", i)
    found.make_automaton()
    return found


_SCAN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])


def scan(docs: DataFrame, terms: list) -> DataFrame:
    """(doc_id, n: all terms of the text, terms: places of those in the list, tf: how often each occurs), a row per document."""

    def count(batches):
        search = automaton(terms)
        for batch in batches:
            rows = {name: [] for name in _SCAN.names[1:]}
            for text in batch.column("text"):
                n, hits = 0, []
                for part, here in slices(text.as_py() or b""):
                    n += here
                    found, times = np.unique(np.fromiter((v for _, v in search.iter(part.decode("latin-1"))), np.int32), return_counts=True)
                    hits.append((found, times))
                if len(hits) > 1:  # a long text: the parts' counts together
                    found, place = np.unique(np.concatenate([f for f, _ in hits]), return_inverse=True)
                    hits = [(found, np.bincount(place, np.concatenate([t for _, t in hits]), len(found)))]
                rows["n"].append(n)
                rows["terms"].append(hits[0][0] if hits else [])
                rows["tf"].append(hits[0][1].astype(np.int32) if hits else [])
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(rows[f.name], f.type) for f in list(_SCAN)[1:]]], schema=_SCAN)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>")


class Best:
    """The best ``k`` documents of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 4  # item, score, whether the identifier is null, identifier
        self.held = []

    def add(self, item, score, null, doc) -> None:
        self.held.append((item, score, null, doc))
        if sum(len(h[0]) for h in self.held) > 4 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        parts = [self.kept, *self.held]
        item, score, null, doc = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        new = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(new, np.diff(np.r_[new, len(item)]))
        stay = order[rank < self.k]
        item, score, null, doc = (np.concatenate([p[i] for p in parts])[stay] for i in range(4))
        last = rank[rank < self.k] == self.k - 1
        self.least[item[last]] = score[last]  # an equal score may still come first by its identifier
        self.kept, self.held = [item, score, null, doc], []


def _chunks(costs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of bounded number and bounded additions; a single one may take more."""
    begin, spent = 0, 0
    for i, cost in enumerate(costs.tolist()):
        if i > begin and (i - begin >= CHUNK or spent + cost > ADDITIONS):
            yield begin, i
            begin, spent = i, 0
        spent += cost
    if begin < len(costs):
        yield begin, len(costs)


def _best(scanned: DataFrame, block: Block, weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(number, doc_id, score): the best ``k`` of each task and item."""

    def rank(batches):
        best, n_items = Best(block.n_items, k), block.n_items
        count = np.diff(block.first)
        for batch in batches:
            ids = batch.column("doc_id")
            nulls, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            norms = np.array([norm(x, n, total) for x in batch.column("n").to_pylist()], np.int64)
            lists = batch.column("terms")
            ends = lists.offsets.to_numpy().astype(np.int64)
            terms, tf = lists.values.to_numpy(), batch.column("tf").values.to_numpy().astype(np.int64)
            spent = np.r_[0, np.cumsum(count[terms])]
            for a, b in _chunks(spent[ends[1:]] - spent[ends[:-1]]):
                own, times = terms[ends[a] : ends[b]], tf[ends[a] : ends[b]]
                doc = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                value = weights[own] * ((1_000_000_000 * times) // (1000 * times + 12 * norms[a:b][doc]))
                # Each posting once for every item that has its term.
                each = np.repeat(np.arange(len(own)), count[own])
                before = np.cumsum(count[own]) - count[own]
                at = block.first[own][each] + np.arange(len(each)) - before[each]
                scores = np.zeros((b - a) * n_items, np.int64)
                np.add.at(scores, doc[each] * n_items + block.items[at], value[each] * block.times[at])
                hit = np.flatnonzero(scores.reshape(b - a, n_items) >= best.least)
                best.add(hit % n_items, scores[hit], nulls[a:b][hit // n_items].astype(np.int64), ids[a:b][hit // n_items])
        best.settle()
        item, score, null, doc = best.kept
        yield pa.record_batch([pa.array(item.astype(np.int32)), pa.array(doc, mask=null.astype(bool)), pa.array(score)], ["number", "doc_id", "score"])

    return scanned.select("doc_id", "n", "terms", "tf").mapInArrow(rank, "number int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, item: str = "item_id") -> DataFrame:
    """(item, rank, doc_id, score): the best ``k`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    terms = staged(item_terms(items, item), "item-terms")
    blocks = staged(_blocks(terms), "item-blocks")
    found, facts = [], None
    for row in blocks.select("block").distinct().orderBy("block").collect():
        own = blocks.filter(F.col("block") == row["block"])
        block, names = _collected(terms.join(own, terms["item"].eqNullSafe(own["item"])).select(terms["item"], "term", "times"))
        scanned = staged(scan(docs, block.terms), "scanned")
        if facts is None:
            facts = scanned.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        if not facts["n"]:
            break
        held = dict(scanned.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([weight(facts["n"], held.get(i, 0)) for i in range(len(block.terms))], np.int64)
        best = _best(scanned, block, weights, facts["n"], facts["total"], k)
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(best.join(F.broadcast(names), "number").select(F.col("item").alias(item), "rank", "doc_id", "score"))
    if not found:
        kind = dict(items.select(F.col(item)).dtypes)[item]
        return spark.createDataFrame([], f"{item} {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
