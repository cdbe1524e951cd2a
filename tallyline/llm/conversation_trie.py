"""Trie of conversation prefixes, with subtree totals by time-forward processing.

A conversation c is rebuilt as the first h turns of conversation c - c % 5 and
its own turns after its first h, where h is crc32(decimal c) % 9. Each distinct
sequence of first d rebuilt turns is a node of depth d; node 0 is the root.

*Keys.* A prefix is known by its depth and two polynomial sums of its turns'
SHA-256 values modulo 2^61 - 1. Turns are range-sorted by (conversation, turn)
and summed within each partition; what a conversation carries over from one
partition to the next are at most two rows a partition, so a conversation of
any length is spread over tasks. Sums of a rebuilt conversation follow from
those of its own turns and of the borrowed head.

*Totals.* Nodes are sorted in reverse level order; one sweep per task gives each
node what its children sent, and sends its own total on to its parent through
a priority queue that keeps what exceeds its bound in sorted runs on disk. A
shard is the subtree below the highest prefix that at most ``shard_rows``
turns continue, so a first turn that most conversations share is cut into many
shards. What shard roots send is added up by parent, and the prefixes above
them are swept in the same way; where these reach deeper than ``levels``, they
are cut into pieces of so many levels, pieces are added up from their roots, and
each piece is swept again with what the pieces below it came to. ``shard_rows``
grows with the square root of the input, so shards and the tree above them
stay far smaller than it.

*Digests* of the conversations that end at a node are made from one text chunk
per run of sorted identifiers.

Null roles and texts are empty texts. Turns are ordered by turn, null first,
and equal turns by the SHA-256 of role and text; equal rows count each. Rows
without a conversation identifier belong to no conversation and are left out.
An empty table has no nodes. Further columns are not looked at. Spilled runs are
unnamed files of one task, gone with it; everything between stages lies in the
shared folder.
"""

import hashlib
import heapq
import math
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.session import broadcast_if_small, staged

PRIME = (1 << 61) - 1
BASES = (0x0F3C59A7B1D2E481, 0x1A6B8C2D9E4F7035)
#: Most turns borrowed, and conversations that share a head.
HEAD, FAMILY = 8, 5
LEAST_SHARD, LEVELS = 50_000, 64
#: Messages a queue holds in memory, and characters of a chunk of identifiers.
QUEUE, CHUNK = 200_000, 1 << 16
ROWS = 20_000

KEY = ["depth", "k1", "k2"]


# Prefix sums ---------------------------------------------------------------------


def _arrow_rows(batches, names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _longs(*names: str) -> tuple[pa.Schema, str]:
    return pa.schema([(name, pa.int64()) for name in names]), ", ".join(f"{name} long" for name in names)


def own_prefixes(turns: DataFrame) -> DataFrame:
    """(conv, j, g1, g2, h1, h2, bytes): sums over the first j - 1 and j turns of each conversation, as it stands."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    # Equal rows may lie in any order, so their place only serves to spread them.
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    order = ["conv", "turn", "digest", "place"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    schema, ddl = _longs("part", "conv", "j", "g1", "g2", "h1", "h2", "bytes")

    def sums(batches):
        conv, j, h, power = None, 0, [0, 0], [1, 1]
        for part, own, digest, size in _arrow_rows(batches, ["part", "conv", "digest", "bytes"]):
            if own != conv:
                conv, j, h, power = own, 0, [0, 0], [1, 1]
            g, j = h, j + 1
            power = [p * b % PRIME for p, b in zip(power, BASES)]
            h = [(s + int(digest[at : at + 15], 16) * p) % PRIME for s, at, p in zip(h, (0, 15), power)]
            yield part, conv, j, *g, *h, size

    summed = staged(rows.select("part", "conv", "digest", "bytes").mapInArrow(lambda b: _in_batches(sums(b), schema), ddl), "turn-sums")
    carried = _carried(summed)
    if not carried:
        return summed.drop("part")

    def carry(batches):
        for part, conv, j, *s, size in _arrow_rows(batches, schema.names):
            before = carried.get((part, conv))
            if before:
                n, *start, up1, up2 = before
                s = [(a + x * up) % PRIME for a, x, up in zip(start * 2, s, (up1, up2) * 2)]
                j += n
            yield conv, j, *s, size

    schema_out, ddl_out = _longs("conv", "j", "g1", "g2", "h1", "h2", "bytes")
    return staged(summed.mapInArrow(lambda b: _in_batches(carry(b), schema_out), ddl_out), "turn-sums")


def _carried(summed: DataFrame) -> dict:
    """{(part, conv): (turns before, their two sums, what shifts the part's own sums)}: at most one entry a partition."""
    edges = summed.groupBy("part").agg(F.min("conv").alias("least"), F.max("conv").alias("most"))
    edges = edges.select("part", F.explode(F.array_distinct(F.array("least", "most"))).alias("conv"))
    # Two rows a partition at most.
    ends = summed.join(F.broadcast(edges), ["part", "conv"]).groupBy("part", "conv").agg(F.max(F.struct("j", "h1", "h2")).alias("end"))
    found, conv, n, sums = {}, None, 0, [0, 0]
    for row in sorted(ends.collect()):
        if row["conv"] != conv:
            conv, n, sums = row["conv"], 0, [0, 0]
        shift = [pow(b, n, PRIME) for b in BASES]
        if n:
            found[row["part"], conv] = (n, *sums, *shift)
        j, *h = row["end"]
        sums = [(a + x * up) % PRIME for a, x, up in zip(sums, h, shift)]
        n += j
    return found


def rebuilt_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes: conv, depth, p1, p2, k1, k2, bytes, len; conversations: conv, len), both staged."""
    own = own_prefixes(turns)
    heads = own.filter(F.col("j") <= HEAD)
    lengths = staged(own.groupBy("conv").agg(F.max("j").alias("n")), "lengths")
    convs = lengths.withColumns({
        "h": F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1),
        "base": F.col("conv") - F.col("conv") % FAMILY,
    })
    convs = convs.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    of_base = heads.select(F.col("conv").alias("base"), F.col("j").alias("k"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    of_own = heads.select("conv", F.col("j").alias("h"), F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    convs = convs.join(of_base, ["base", "k"], "left").join(of_own, ["conv", "h"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("b1", "b2", "o1", "o2")}
    length = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = staged(convs.withColumns(zero).withColumn("len", length).select("conv", "base", "h", "k", "b1", "b2", "o1", "o2", "len"), "conversations")

    borrowed = convs.select("conv", "base", "k", "len").join(heads.withColumnRenamed("conv", "base"), "base").filter("j <= k")
    borrowed = borrowed.select(
        "conv", F.col("j").alias("depth"), F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "bytes", "len"
    )
    back = [[pow(b, -i, PRIME) for i in range(HEAD + 1)] for b in BASES]
    schema, ddl = _longs("conv", "depth", "p1", "p2", "k1", "k2", "bytes", "len")

    def shift(batches):
        names = ["conv", "j", "g1", "g2", "h1", "h2", "bytes", "h", "k", "b1", "b2", "o1", "o2", "len"]
        for conv, j, g1, g2, h1, h2, size, h, k, b1, b2, o1, o2, n in _arrow_rows(batches, names):
            s1, s2 = back[0][h - k], back[1][h - k]
            yield (
                conv, j - h + k, (b1 + (g1 - o1) * s1) % PRIME, (b2 + (g2 - o2) * s2) % PRIME,
                (b1 + (h1 - o1) * s1) % PRIME, (b2 + (h2 - o2) * s2) % PRIME, size, n,
            )

    kept = own.join(broadcast_if_small(convs.drop("base")), "conv").filter("j > h").mapInArrow(lambda b: _in_batches(shift(b), schema), ddl)
    return staged(borrowed.unionByName(kept), "prefixes"), convs.select("conv", "len")


# Subtree totals ------------------------------------------------------------------


class Messages:
    """Sums sent to nodes, taken in the order of the nodes; beyond ``limit`` nodes they wait in sorted runs on disk."""

    RUN = "<6q"

    def __init__(self, limit: int = QUEUE):
        self.limit, self.sums, self.heap, self.runs, self.spills = limit, {}, [], [], 0

    def send(self, key: tuple, sums: tuple) -> None:
        known = self.sums.get(key)
        if known is None:
            if len(self.sums) >= self.limit:
                self._spill()
            heapq.heappush(self.heap, key)
            self.sums[key] = sums
        else:
            self.sums[key] = tuple(a + b for a, b in zip(known, sums))

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for key in sorted(self.sums):
            file.write(struct.pack(self.RUN, *key, *self.sums[key]))
        file.seek(0)
        self.sums, self.heap = {}, []
        run = self._read(file)
        self.spills += 1
        key, sums = next(run)
        heapq.heappush(self.runs, (key, self.spills, sums, run))

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while block := file.read(struct.calcsize(self.RUN) * 4096):
                for *key, a, b, c in struct.iter_unpack(self.RUN, block):
                    yield tuple(key), (a, b, c)

    def take(self, key: tuple) -> tuple:
        """The sum of what was sent to a node; nodes are asked for in ascending order."""
        total = (0, 0, 0)
        if self.heap and self.heap[0] == key:
            heapq.heappop(self.heap)
            total = self.sums.pop(key)
        while self.runs and self.runs[0][0] == key:
            _, number, sums, run = self.runs[0]
            total = tuple(a + b for a, b in zip(total, sums))
            following = next(run, None)
            if following:
                heapq.heapreplace(self.runs, (following[0], number, following[1], run))
            else:
                heapq.heappop(self.runs)
        return total


_SUMS = ["children", "leaves", "saved"]


def sweep(nodes: DataFrame, limit: int = QUEUE) -> DataFrame:
    """Totals of whole subtrees of each shard.

    ``nodes`` has keys (depth, k1, k2) and parents (up, p1, p2), own ``children``,
    ``leaves`` and ``saved``, the ``shard`` columns s0, s1, s2, and ``top``: nodes
    whose parent lies elsewhere. These send nothing.
    """
    names = [*KEY, "up", "p1", "p2", *_SUMS, "top"]
    rest = [c for c in nodes.columns if c not in _SUMS]

    def run(batches):
        messages = Messages(limit)
        for batch in batches:
            totals = []
            for depth, k1, k2, up, p1, p2, *own, top in _arrow_rows([batch], names):
                children, leaves, saved = (a + b for a, b in zip(own, messages.take((-depth, k1, k2))))
                totals.append((children, leaves, saved))
                if not top:
                    messages.send((-up, p1, p2), (1, leaves, saved))
            columns = list(zip(*totals)) or [(), (), ()]
            yield pa.record_batch([*[batch.column(c) for c in rest], *[pa.array(c, pa.int64()) for c in columns]], [*rest, *_SUMS])

    spread = nodes.repartition("s0", "s1", "s2").sortWithinPartitions(F.desc("depth"), "k1", "k2")
    kinds = dict(nodes.dtypes)
    return spread.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in [*rest, *_SUMS]))


def _sent(swept: DataFrame) -> DataFrame:
    """What the tops of shards send to their parents."""
    sums = [F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    return swept.filter("top").groupBy(F.col("up").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*sums)


def _with_sent(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    more = sent.select(*KEY, *[F.col(c).alias(f"more_{c}") for c in _SUMS])
    found = nodes.join(more, KEY, "left")
    return found.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in _SUMS}).drop(*[f"more_{c}" for c in _SUMS])


def _whole_tree(nodes: DataFrame, prefixes: DataFrame, levels: int, step: int, limit: int) -> DataFrame:
    """Totals of a tree whose levels lie ``step`` apart; nodes as for ``sweep`` without shards, and their smallest member ``conv``."""
    if nodes.agg(F.max("depth")).first()[0] <= levels * step:
        one = nodes.withColumns({c: F.lit(0).cast("long") for c in ("s0", "s1", "s2")}).withColumn("top", F.col("depth") == 0)
        return sweep(one, limit).drop("s0", "s1", "s2", "top")
    wide = levels * step
    anchor = (F.floor((F.col("depth") - step) / wide) * wide).cast("long")
    placed = nodes.withColumn("s0", F.when(F.col("depth") > 0, anchor).otherwise(F.lit(-1)))
    placed = _with_ancestor(placed, prefixes, "s0", "s1", "s2")
    placed = staged(placed.withColumn("top", F.col("s0") == F.col("up")), "pieces")
    of_piece = _sent(sweep(placed, limit))
    # A node on a border stands for the piece below it; its totals are those of all pieces below.
    borders = nodes.filter(F.col("depth") % wide == 0).select(*KEY, "conv").withColumn("up", F.col("depth") - wide)
    borders = _with_ancestor(borders, prefixes, "up", "p1", "p2").join(of_piece, KEY)
    below = _whole_tree(staged(borders, "borders"), prefixes, levels, wide, limit)
    # Direct children are those of the piece; a border's children among borders are no children of it.
    whole = of_piece.select(*KEY, "children").join(below.drop("children"), KEY)
    inner = _with_sent(placed, staged(whole.select(*KEY, *_SUMS), "below"))
    return sweep(inner, limit).drop("s0", "s1", "s2", "top")


def _with_ancestor(nodes: DataFrame, prefixes: DataFrame, depth: str, k1: str, k2: str) -> DataFrame:
    """Keys of each node's ancestor at a depth: the prefix that its smallest member has there; zero for the root and beyond."""
    there = prefixes.select("conv", F.col("depth").alias(depth), F.col("k1").alias(k1), F.col("k2").alias(k2))
    return nodes.join(there, ["conv", depth], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in (k1, k2)})


# Ends ----------------------------------------------------------------------------


def _end_digests(ends: DataFrame, chunk: int) -> DataFrame:
    """(depth, k1, k2, digest) from (depth, k1, k2, conv): conversations in ascending order, comma-joined."""
    order = [*KEY, "conv"]
    spread = ends.repartitionByRange(*order).sortWithinPartitions(*order)

    def chunks(batches):
        key, texts, size, first = None, [], 0, 0
        for *own, conv in _arrow_rows(batches, order):
            if texts and (own != key or size > chunk):
                yield *key, first, ",".join(texts)
                texts, size = [], 0
            if not texts:
                key, first = own, conv
            texts.append(str(conv))
            size += len(texts[-1]) + 1
        if texts:
            yield *key, first, ",".join(texts)

    def digests(batches):
        key, state = None, None
        for *own, _, text in _arrow_rows(batches, [*KEY, "first", "text"]):
            if own != key:
                if key:
                    yield *key, state.hexdigest()
                key, state = own, hashlib.sha256(text.encode())
            else:
                state.update(f",{text}".encode())
        if key:
            yield *key, state.hexdigest()

    longs = [(c, pa.int64()) for c in [*KEY, "first"]]
    ddl = "depth long, k1 long, k2 long"
    pieces = spread.mapInArrow(lambda b: _in_batches(chunks(b), pa.schema([*longs, ("text", pa.string())])), f"{ddl}, first long, text string")
    together = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return together.mapInArrow(lambda b: _in_batches(digests(b), pa.schema([*longs[:3], ("digest", pa.string())])), f"{ddl}, digest string")


# The trie ------------------------------------------------------------------------


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def prefix_trie(turns: DataFrame, shard_rows: int | None = None, levels: int = LEVELS, queue: int = QUEUE, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    prefixes, convs = rebuilt_prefixes(turns)
    nodes = prefixes.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("bytes").alias("bytes"),
        F.count_if(F.col("depth") == F.col("len")).alias("n_ends"), F.min(F.when(F.col("depth") == F.col("len"), F.col("conv"))).alias("end"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("size"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.count_if(F.col("len") == 0).alias("n_ends"),
        F.min(F.when(F.col("len") == 0, F.col("conv"))).alias("end"), F.sum(F.col("len") + 1).alias("size"),
    ).filter("n_convs > 0").withColumns({c: zero for c in (*KEY, "p1", "p2", "bytes")})
    nodes = nodes.unionByName(root).withColumns({
        "up": F.col("depth") - 1, "children": zero, "leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("bytes"),
    })
    nodes = staged(nodes.drop("bytes"), "nodes")
    size = nodes.filter("depth = 0").select("size").first()
    if size is None:
        return _finished(nodes, nodes.select(*KEY, F.lit("").alias("digest")))
    bound = shard_rows or max(LEAST_SHARD, math.isqrt(levels * size["size"]))

    is_high = (F.col("size") > bound) | (F.col("depth") == 0)
    high = broadcast_if_small(staged(nodes.filter(is_high).select(*KEY), "high"))
    # The highest prefix of each conversation that is not above the shards.
    cut = prefixes.join(high, KEY, "left_anti").groupBy("conv").agg(F.min(F.struct(*KEY)).alias("cut"))
    cut = staged(cut.select("conv", F.col("cut.depth").alias("s0"), F.col("cut.k1").alias("s1"), F.col("cut.k2").alias("s2")), "cuts")
    low = nodes.filter(~is_high).join(broadcast_if_small(cut), "conv")
    low = staged(sweep(low.withColumn("top", F.col("depth") == F.col("s0")), queue), "shards")
    upper = staged(_with_sent(nodes.filter(is_high), _sent(low)), "above")
    upper = _whole_tree(upper, prefixes, levels, 1, queue)
    both = staged(low.drop("top", "s0", "s1", "s2").unionByName(upper.select(*nodes.columns)), "totals")

    several = nodes.filter("n_ends > 1").select(*KEY)
    at_end = prefixes.filter("depth = len").select(*KEY, "conv").unionByName(
        convs.filter("len = 0").select(*[zero.alias(c) for c in KEY], "conv")
    )
    return _finished(both, _end_digests(at_end.join(broadcast_if_small(several), KEY, "left_semi"), chunk))


def _finished(nodes: DataFrame, digests: DataFrame) -> DataFrame:
    parents = nodes.filter("children > 0").select(
        F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id")
    )
    found = nodes.join(broadcast_if_small(parents), ["up", "p1", "p2"], "left").join(digests, KEY, "left")
    alone = _sha256(F.coalesce(F.col("end").cast("string"), F.lit("")))
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(F.col("n_ends") > 1, F.col("digest")).otherwise(alone).alias("ends_sha256"),
    )
