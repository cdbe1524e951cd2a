"""Best-fit packing of tokenised documents into sequences of a fixed length.

Texts become pieces of at most ``capacity`` tokens. A linear grouping scheme
plans the large pieces: ordered by length they are cut into groups of equal
cardinality, each length is rounded up to the longest of its group, and few
configurations (multisets of rounded lengths that fit one sequence) cover all
of them. Actual pieces then take the places of their group, which leaves gaps,
and small pieces go best-fit into the gaps, by decreasing length.

Only counts reach the driver: pieces per length and sequences per gap, at most
``capacity`` + 1 rows each, whatever the number of documents. A plan says which
ranks of a length go where; executors look places up by rank. Ranks come from
counts per (length, part of the stored pieces) and a numbering within those, so
a length that a third of all pieces have is numbered by all tasks together.

Nulls and empty texts are one piece that holds the end token only. Repeated
rows are packed each on its own. An empty table gives an empty result.
"""

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.linking import stored

CAPACITY = 1024
END = 2
#: Pieces up to this share of the capacity are small.
SMALL_SHARE = 8
#: Numbers of groups tried; from as many as there are lengths on, nothing is rounded.
GROUPS = (16, 64, 256, 1024, 8192)

Encode = Callable[[str], list[int]]


def byte_bpe(path: str, pattern: str, special: dict[str, int] | None = None) -> Callable[[], Encode]:
    """Loader of a byte-level vocabulary of (token, rank) lines; ``special`` strings in a text are one token each, none by default."""
    special = special or {}

    def load() -> Encode:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        found = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        return (lambda text: found.encode(text, allowed_special="all")) if special else found.encode_ordinary

    return load


def pieces(
    docs: DataFrame, load: Callable[[], Encode], capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): only longer documents are cut, and the first piece takes the remainder."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for batch in batches:
            for top in range(0, batch.num_rows, 256):
                rows, out = batch.slice(top, 256), []
                for row, text in enumerate(rows.column("text")):
                    ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                    cut = (len(ids) - 1) % capacity + 1
                    bounds = [0, *range(cut, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        out.append((row, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b] if with_ids else None))
                row, piece, start, length, crc, ids = zip(*out)
                columns = {
                    "doc_id": rows.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema)


class Segment(NamedTuple):
    """Items with ranks from ``rank`` on, ``count`` of them, fill places ``each`` to a bin from ``bin`` on."""

    rank: int
    count: int
    bin: int
    each: int
    slot: int


def _best_configuration(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, int]]:
    """(size's index, times): the largest size left, and what fills the rest best, larger sizes first."""
    first = next(i for i, d in enumerate(demand) if d)
    room = capacity - sizes[first]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for i in range(first, len(sizes)):
        if sizes[i] > room or demand[i] <= (i == first):
            continue
        steps.append((i, reach))
        more = reach
        for _ in range(min(demand[i] - (i == first), room // sizes[i])):
            more |= (more << sizes[i]) & mask
        reach |= more
    total, used = reach.bit_length() - 1, {first: 1}
    for i, before in reversed(steps):
        while not before >> total & 1:
            total -= sizes[i]
            used[i] = used.get(i, 0) + 1
    return sorted(used.items())


class Plan(NamedTuple):
    """Segments over the large pieces in order of decreasing length, sequences, and how many have which gap as planned."""

    segments: list[Segment]
    bins: int
    gaps: dict[int, int]


def _rounded(counts: dict[int, int], groups: int) -> tuple[list[int], list[int], list[int]]:
    """Linear grouping: sizes in decreasing order, pieces of each, and the rank of each one's first piece."""
    lengths = sorted(counts, reverse=True)
    ends = np.cumsum([counts[n] for n in lengths]) if lengths else np.zeros(0, int)
    total = int(ends[-1]) if lengths else 0
    cuts = [total * g // groups for g in range(groups + 1)]
    sizes, demand, begin = [], [], []
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            size = lengths[int(np.searchsorted(ends, a, "right"))]
            if sizes and sizes[-1] == size:
                demand[-1] += b - a
            else:
                sizes.append(size)
                demand.append(b - a)
                begin.append(a)
    return sizes, demand, begin


def _by_configurations(counts: dict[int, int], capacity: int, groups: int) -> Plan:
    sizes, demand, begin = _rounded(counts, groups)
    out, bins, gaps = [], 0, {}
    while any(demand):
        used = _best_configuration(sizes, demand, capacity)
        times = min(demand[i] // c for i, c in used)
        slot, gap = 0, capacity - sum(sizes[i] * c for i, c in used)
        gaps[gap] = gaps.get(gap, 0) + times
        for i, c in used:
            out.append(Segment(begin[i], times * c, bins, c, slot))
            begin[i] += times * c
            demand[i] -= times * c
            slot += c
        bins += times
    return Plan(sorted(out), bins, gaps)


def plan(
    counts: dict[int, int], capacity: int = CAPACITY, groups: int | tuple[int, ...] = GROUPS, small_share: int = SMALL_SHARE
) -> Plan:
    """For the large pieces, the configurations that need the fewest sequences once small pieces have filled the gaps."""
    small = {n: c for n, c in counts.items() if n <= capacity // small_share}
    large = {n: c for n, c in counts.items() if n > capacity // small_share}
    plans = [_by_configurations(large, capacity, n) for n in ((groups,) if isinstance(groups, int) else groups)]
    return min(plans, key=lambda p: p.bins + plan_small(small, p.gaps, capacity, capacity)[1])


class Fill(NamedTuple):
    """Small pieces of one length, ranks from ``rank`` on, ``count`` of them: to sequences with ``gap`` left, ranks from ``bin`` on (gap -1: new ones)."""

    length: int
    rank: int
    count: int
    gap: int
    bin: int
    each: int
    slot: int


def plan_small(
    counts: dict[int, int], gaps: dict[int, int], capacity: int, first_slot: int
) -> tuple[list[Fill], int, dict[int, int]]:
    """Best fit by decreasing length over classes of alike sequences; the number of new sequences; sequences by gap left."""
    open_ = sorted((gap, gap, 0, n, first_slot) for gap, n in gaps.items())
    out, new = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(open_, (length,))
            if k == len(open_):
                each = capacity // length
                full, rest = divmod(left, each)
                for n, e in ((full, each), (1, rest)):
                    if n and e:
                        out.append(Fill(length, rank, n * e, -1, new, e, 0))
                        rank += n * e
                        insort(open_, (capacity - e * length, -1, new, n, e))
                        new += n
                break
            room, gap, first, n, slot = open_.pop(k)
            each = min(room // length, max(1, left // n))
            took = min(n, left // each)
            out.append(Fill(length, rank, took * each, gap, first, each, slot))
            rank, left = rank + took * each, left - took * each
            insort(open_, (room - each * length, gap, first, took, slot + each))
            if n > took:
                insort(open_, (room, gap, first + took, n - took, slot))
    rest = {}
    for room, _, _, n, _ in open_:
        rest[room] = rest.get(room, 0) + n
    return out, new, rest


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``rank``, from 0, among rows of equal keys. ``item`` tells each row and, in its high bits, the part it lies in."""
    rows = rows.withColumn("part", F.shiftright("item", 33))
    here = rows.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    here = here.select(*keys, "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("item")) - 1
    return rows.withColumn("within", within).join(here, [*keys, "part"]).withColumn("rank", F.col("before") + F.col("within")).drop("part", "before", "within")


def _lookup(rows: DataFrame, place: Callable[[pa.RecordBatch], dict[str, np.ndarray]], added: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = place(batch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(values[name], pa.int64()) for name in added)], names=[*batch.schema.names, *added]
            )

    columns = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(run, ", ".join(columns + [f"{name} long" for name in added]))


def _large_place(segments: list[Segment], first: dict[int, int]) -> Callable[[pa.RecordBatch], dict[str, np.ndarray]]:
    """From (length, rank) to bin and slot; ``first`` is the rank of each length's first piece among all."""
    table = np.array(segments, np.int64).reshape(-1, 5)
    offset = np.zeros(max(first, default=0) + 1, np.int64)
    for length, rank in first.items():
        offset[length] = rank

    def place(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        rank = offset[batch.column("length").to_numpy()] + batch.column("rank").to_numpy()
        row = table[np.searchsorted(table[:, 0], rank, "right") - 1]
        at = rank - row[:, 0]
        return {"bin": row[:, 2] + at // row[:, 3], "slot": row[:, 4] + at % row[:, 3]}

    return place


def _small_place(fills: list[Fill]) -> Callable[[pa.RecordBatch], dict[str, np.ndarray]]:
    table = np.array(sorted(fills), np.int64).reshape(-1, 7)
    base = np.int64(int(table[:, 1].max(initial=0)) + int(table[:, 2].max(initial=0)) + 1)
    keys = table[:, 0] * base + table[:, 1]

    def place(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        rank = batch.column("rank").to_numpy()
        row = table[np.searchsorted(keys, batch.column("length").to_numpy() * base + rank, "right") - 1]
        at = rank - row[:, 1]
        return {"gap": row[:, 3], "gap_rank": row[:, 4] + at // row[:, 5], "slot": row[:, 6] + at % row[:, 5]}

    return place


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int | tuple[int, ...] = GROUPS, small_share: int = SMALL_SHARE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length``; sequences are filled from 0 without gaps."""
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "pieces")
    found = items.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = {row.length: row.n for row in found}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    small = capacity // small_share
    large = {length: n for length, n in counts.items() if length > small}
    segments, bins, _ = plan(counts, capacity, groups, small_share)
    first, rank = {}, 0
    for length in sorted(large, reverse=True):
        first[length] = rank
        rank += large[length]
    ranked = stored(_ranked(items.select("item", "length"), "length"), "ranked")
    placed = _lookup(ranked.filter(F.col("length") > small), _large_place(segments, first), ["bin", "slot"])
    placed = stored(placed.select("item", "length", "bin", "slot"), "placed")
    filled = placed.groupBy("bin").agg((F.lit(capacity) - F.sum("length")).alias("gap"))
    filled = stored(filled.withColumn("item", F.monotonically_increasing_id()), "filled")
    gaps = {row.gap: row.n for row in filled.groupBy("gap").agg(F.count("*").alias("n")).collect()}
    fills, _, _ = plan_small({n: c for n, c in counts.items() if n <= small}, gaps, capacity, capacity)
    everything = placed.select("item", F.col("bin").alias("sequence_id"), "slot", "length")
    if fills:
        little = _lookup(ranked.filter(F.col("length") <= small), _small_place(fills), ["gap", "gap_rank", "slot"])
        target = _ranked(filled.filter("gap > 0"), "gap").select("gap", F.col("rank").alias("gap_rank"), "bin")
        sequence = F.coalesce("bin", F.col("gap_rank") + bins)
        little = little.join(target, ["gap", "gap_rank"], "left").select("item", sequence.alias("sequence_id"), "slot", "length")
        everything = everything.unionByName(little)
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = everything.select("item", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    return items.join(offsets, "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
