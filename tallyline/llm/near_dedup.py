"""Near duplicates by SetSketch registers, estimated jointly by likelihood and verified on full sets.

A document's set holds its distinct shingles of some words in a row (fewer
words: the whole sequence as one). A register keeps the least of a hash over
the set, read as the least of exponentially distributed values and rounded down
to a power of a base near 1: registers of two sets merge by maximum, and agree
the more often the more alike the sets are. Bands of registers put documents in
buckets. For documents that share a bucket the likelihood of their registers
gives the most plausible similarity, and what may reach the threshold is
compared on the full sets.

Documents with equal sets (128-bit hash and size) are one class and are never
compared. With the default sketch a pair at similarity 0.85 misses all buckets
with probability 6e-9 and at 0.8 with 6e-6; estimates may lie five standard
deviations below the threshold. There is no cap on a bucket, class or group.

Nulls and empty texts have the empty set, which is linked with nothing. Rows
with a null identifier are linked by their texts, and a group of such rows only
has a null component. Repeated rows fall in one class. An empty table gives an
empty result.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.linking import link_buckets, stored
from tallyline.llm.words import Texts, hash_spans, mix, shingle_hashes, slices, words_of
from tallyline.session import broadcast_if_small

REGISTERS = 240
BAND = 6
#: Base, rate and limit of the registers.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: How far below the threshold an estimate may lie, in standard deviations of an estimate at the threshold.
MARGIN = 5.0


def document_shingles(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (repeats included) in text order, and how many stand before each text."""
    words = words_of(texts)
    hashes = hash_spans(texts.data, words, lower=True)
    shingles, at = shingle_hashes(hashes, words, width)
    before = np.searchsorted(at, words.before)
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < width))
    if len(short):
        whole = [hashes[words.before[i] : words.before[i + 1]] for i in short]
        whole = [(mix(h) * (2 * np.arange(len(h), dtype=np.uint64) + 1)).sum(dtype=np.uint64, keepdims=True) + len(h) for h in whole]
        shingles = np.insert(shingles, before[short], mix(np.concatenate(whole).astype(np.uint64), 23))
        extra = np.zeros(len(before), np.int64)
        extra[short + 1] = 1
        before = before + np.cumsum(extra)
    return shingles, before


def _distinct(shingles: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which shingles occur for the first time in their text."""
    own = np.repeat(np.arange(len(before) - 1, dtype=np.uint64), np.diff(before))
    keys = shingles ^ mix(own, 29)
    order = np.argsort(keys)
    first = np.zeros(len(keys), bool)
    first[order] = np.concatenate([np.ones(min(1, len(keys)), bool), keys[order[1:]] != keys[order[:-1]]])
    return first


def registers(shingles: np.ndarray, before: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of each text (rows); texts without shingles have zeros."""
    filled = np.flatnonzero(np.diff(before))
    out = np.zeros((len(before) - 1, count), np.uint16)
    if not len(filled):
        return out
    starts = before[filled]
    least = np.empty((len(filled), count))
    seeds = mix(np.arange(2 * count, dtype=np.uint64), 31)
    for k in range(count):
        least[:, k] = np.minimum.reduceat((shingles ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), starts)
    exponential = -np.log1p(-(least + 1) / 2.0**64.0000001) / RATE
    out[filled] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1)
    return out


#: One bit of each register, sixty to a long.
BITS = [f"bits{i}" for i in range(-(-REGISTERS // 60))]


def one_bit_each(marks: np.ndarray) -> np.ndarray:
    """(texts, longs): equal registers give equal bits, others equal ones half the time."""
    bits = mix(marks.astype(np.uint64) * np.uint64(REGISTERS) + np.arange(marks.shape[1], dtype=np.uint64)[None, :], 47) & np.uint64(1)
    longs = [(bits[:, i : i + 60] << np.arange(bits[:, i : i + 60].shape[1], dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
             for i in range(0, marks.shape[1], 60)]
    return np.column_stack(longs).view(np.int64)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 64) -> np.ndarray:
    """Most likely Jaccard similarity of each pair, from how many registers are greater, less or equal."""
    greater, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - greater - less
    u = na / (na + nb)
    v = 1 - u
    j = np.minimum(u / v, v / u)[:, None] * np.linspace(0, 1, steps)[None, :]
    scale = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE)

    more, fewer = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    same = 1 - more - fewer
    tiny = 1e-12
    likelihood = (
        greater[:, None] * np.log(np.maximum(more, tiny)) + less[:, None] * np.log(np.maximum(fewer, tiny))
        + equal[:, None] * np.log(np.maximum(same, tiny))
    )
    return j[np.arange(len(j)), likelihood.argmax(axis=1)]


def _sketch(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, text_hash, text) -> (doc_id, text_hash, n_shingles, key1, key2, registers, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                shingles, before = document_shingles(texts, width)
                first = _distinct(shingles, before)
                kept = shingles[first]
                n = np.concatenate([[0], np.cumsum(first)])
                before = n[before]
                marks = registers(kept, before)
                bands = np.zeros((len(texts), REGISTERS // BAND), np.uint64)
                for k in range(BAND):
                    bands = mix(bands * np.uint64(5) + marks[:, k::BAND].astype(np.uint64), k)
                bands = mix(bands + np.arange(bands.shape[1], dtype=np.uint64)[None, :], 37)
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(kept, seed))]) for seed in (41, 43)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "text_hash": part.column("text_hash"),
                    **{name: pa.array(bits) for name, bits in zip(BITS, one_bit_each(marks).T)},
                    "n_shingles": pa.array(np.diff(before), pa.int64()),
                    "key1": pa.array((total[0][before[1:]] - total[0][before[:-1]]).view(np.int64)),
                    "key2": pa.array((total[1][before[1:]] - total[1][before[:-1]]).view(np.int64)),
                    "registers": pa.array([row.tobytes() for row in marks], pa.binary()),
                    "bands": pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                })

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {key}, text_hash long, {', '.join(f'{name} long' for name in BITS)}, n_shingles long, key1 long, key2 long, registers binary, bands array<long>"
    )


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (text, node) -> (node, set): the distinct shingle hashes in order, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                shingles, before = document_shingles(texts, width)
                sets = [np.unique(shingles[before[i] : before[i + 1]]).tobytes() for i in range(len(texts))]
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "set": pa.array(sets, pa.binary())})

    return docs.select("node", "text").mapInArrow(run, "node long, set binary")


def _members(docs: DataFrame, width: int) -> DataFrame:
    """Rows (text, node) -> (node, shingle): one row per distinct shingle hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                shingles, before = document_shingles(texts, width)
                first = _distinct(shingles, before)
                own = np.repeat(part.column("node").to_numpy(), np.diff(before))[first]
                yield pa.RecordBatch.from_pydict({"node": pa.array(own), "shingle": pa.array(shingles[first].view(np.int64))})

    return docs.select("node", "text").mapInArrow(run, "node long, shingle long")


def _maybe_similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs with registers and sizes -> the pairs whose likely similarity may reach the threshold."""
    level = percent / 100
    least = level - MARGIN * float(np.sqrt(level * (1 - level) / REGISTERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                na, nb = (part.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                kept = likely_similarity(a, b, na, nb) >= least
                yield part.select(["a", "b"]).filter(pa.array(kept))

    return pairs.mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with both sets -> the pairs that reach the threshold, compared in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                kept.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))


def near_groups(
    docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id), one row per row of ``docs``.

    ``percent`` is the least 100 * intersection / union of a link. A component
    is named by the smallest identifier in it; ``component`` tells components
    apart even if rows share identifiers, and is null for texts without words.
    """
    rows = _rows(docs, id_column, text_column)
    sketches = stored(_sketch(rows, width), "sketches")
    key = ["key1", "key2", "n_shingles"]
    # Rows of a class agree in registers and bands.
    classes = sketches.filter("n_shingles > 0").groupBy(*key).agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("at"),
        F.any_value("registers").alias("registers"), F.any_value("bands").alias("keys"), *[F.max(name).alias(name) for name in BITS],
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    differ = (1 - percent / 100) / 2
    most = REGISTERS * differ + MARGIN * float(np.sqrt(REGISTERS * differ * (1 - differ)))

    def near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        fits = F.least(a("n_shingles"), b("n_shingles")) * 100 >= F.greatest(a("n_shingles"), b("n_shingles")) * percent
        return fits & (sum(F.bit_count(a(name).bitwiseXOR(b(name))) for name in BITS) <= most)

    sizes = classes.select("node", "n_shingles", "registers")

    def texts_of_nodes(nodes: DataFrame) -> DataFrame:
        """(node, text) from one row of each class; only repeated rows can give it twice."""
        wanted = broadcast_if_small(stored(nodes.join(classes, "node").select("node", "at"), "wanted"))
        return rows.join(wanted, rows.doc_id.eqNullSafe(wanted["at.doc_id"]) & (rows.text_hash == wanted["at.text_hash"])).select("node", "text")

    def verify(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(
                sizes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("registers").alias(f"r{side}")), side
            )
        maybe = stored(_maybe_similar(pairs.select("a", "b", "na", "nb", "ra", "rb"), percent), "pairs")
        nodes = maybe.select(F.col("a").alias("node")).union(maybe.select("b")).distinct()
        sets = stored(_sets(texts_of_nodes(nodes), width).groupBy("node").agg(F.any_value("set").alias("set")), "sets")
        for side in "ab":
            maybe = maybe.join(sets.select(F.col("node").alias(side), F.col("set").alias(f"s{side}")), side)
        return _similar(maybe.select("a", "b", "sa", "sb"), percent)

    def shared_shingles(nodes: DataFrame) -> DataFrame:
        """(node, n_shared): how many of a node's shingles any other of the nodes has too."""
        held = _members(texts_of_nodes(nodes), width).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
        lone = held.filter("node = last").groupBy("node").agg(F.count("*").alias("lone"))
        counted = nodes.join(sizes, "node").join(lone, "node", "left")
        return counted.select("node", (F.col("n_shingles") - F.coalesce("lone", F.lit(0))).alias("n_shared"))

    def may_reach(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        """No more than either's shared shingles can be common to both."""
        common = F.least(a("n_shared"), b("n_shared"))
        return common * 100 >= (a("n_shingles") + b("n_shingles") - common) * percent

    groups = link_buckets(classes.select("node", "keys", "n_shingles", *BITS), verify, near, sharpen=shared_shingles, nearer=may_reach)
    placed = classes.select(*key, "node", "first").join(groups, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = stored(placed.join(names, "component").select(*key, "component", "component_id"), "placed")
    columns = ["doc_id", "text_hash", "n_shingles", "component", "component_id"]
    filled = sketches.filter("n_shingles > 0").join(placed, key).select(*columns)
    empty = sketches.filter("n_shingles = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return filled.unionByName(empty.select(*columns))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the smallest identifier stays.

    A null identifier counts as greater than all others; of rows that share the
    smallest one the least text hash decides, and of repeated rows one stays.
    Rows without words all stay.
    """
    groups = stored(near_groups(docs, width, percent, id_column, text_column).filter("component is not null"), "near")
    first = groups.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash")).alias("first"))
    groups = groups.join(stored(first, "first"), "component")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    dropped = stored(groups.filter(~stays).select("doc_id", "text_hash").distinct(), "dropped")
    again = groups.filter(stays).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_name, text_name = names[docs.columns.index(id_column)], names[docs.columns.index(text_column)]
    plain = plain.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_name).cast("string"), F.lit(""))))

    def among(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
        return rows.join(chosen, rows[id_name].eqNullSafe(chosen["doc_id"]) & (rows["__hash"] == chosen["text_hash"]), how)

    out = among(plain, broadcast_if_small(dropped), "left_anti")
    again = stored(again.select("doc_id", "text_hash"), "again")
    if not again.isEmpty():
        repeats = broadcast_if_small(again)
        once = among(out, repeats, "left_semi").dropDuplicates([id_name, "__hash"])
        out = among(out, repeats, "left_anti").unionByName(once)
    return out.select(*names).toDF(*docs.columns)
