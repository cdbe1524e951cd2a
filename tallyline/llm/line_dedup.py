"""Fuzzy line duplicates: SimHash, pigeonhole blocks, verified edit similarity, one occurrence per group.

Lines are normalised (lower case, runs of other characters than letters and
digits as one blank); those with fewer than ``min_words`` words are left alone.
A line's 60-bit SimHash has each bit as the majority of the hashes of its first
``min_words`` words and of all words of four or more letters: frequent short
words would make all long lines alike. Words are counted bit by bit in SQL: six
10-bit counters share one long, so ten sums hold all 60 counters of up to 511
words; longer lines are counted in parts.

Lines that are equal once normalised are one class (128-bit hash). Two classes
are linked if their hashes differ in at most three bits and their edit
similarity reaches ``percent``. Of hashes cut into m blocks, m - 3 blocks agree
in any such pair, so equality of some m - 3 blocks finds them all; m follows
the number of classes, which changes the work and not the pairs. Of each group
of linked classes the occurrence that is first by (identifier, text hash, line)
stays.

Only DataFrame and SQL functions run here. Nulls stay null and have no lines;
empty texts stay. Rows that repeat identifier and text are one document and
lose the same lines. Rows with a null identifier come first. An empty table
gives an empty result; other columns are kept as they are.
"""

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.linking import link_buckets, stored
from tallyline.session import broadcast_if_small

MIN_WORDS = 5
PERCENT = 80
DISTANCE = 3
#: Letters of a word that tells lines apart.
TELLING = 4

LANES, LANE_BITS = 6, 10
BITS = LANES * LANE_BITS
PART = 511
#: One in each counter's lowest bit.
ONES = sum(1 << (LANE_BITS * lane) for lane in range(LANES))


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+", -1), "")


def normal_line(line: Column) -> Column:
    return F.array_join(line_words(line), " ")


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text_hash, text) of each row."""
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, sim) of each line that has enough words."""
    rows = _lines(docs, id_column, text_column).withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("row", "doc_id", "text_hash", F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    lines = lines.select("row", "doc_id", "text_hash", "pos", line_words(F.col("line")).alias("words"))
    norm = F.array_join("words", " ")
    lines = lines.select(
        "row", "doc_id", "text_hash", "pos", F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit(1), norm).alias("h2"), "words",
        F.size("words").alias("n_words"),
    )
    # Whatever filters on the words before they are counted, an inner explode too, would have lines split twice.
    words = lines.select("row", "doc_id", "text_hash", "pos", "h1", "h2", "n_words", F.posexplode_outer("words").alias("at", "word"))
    words = words.filter((F.col("at") < min_words) | (F.char_length("word") >= TELLING))
    words = words.withColumn("h", F.xxhash64("word")).withColumn("part", F.expr(f"at div {PART}").cast("int"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(ONES))).alias(f"s{k}") for k in range(LANE_BITS)]
    same = [F.max(c).alias(c) for c in ("doc_id", "text_hash", "n_words", "h1", "h2")]
    counted = words.groupBy("row", "pos", "part").agg(F.count("*").alias("n"), *sums, *same).filter(F.col("n_words") >= min_words)
    # More than half of n: adding 511 - n/2 carries into a counter's top bit.
    push = (F.lit(PART) - F.floor(F.col("n") / 2)).cast("long") * F.lit(ONES)
    bits = [F.shiftleft(F.shiftright(F.col(f"s{k}") + push, LANE_BITS - 1).bitwiseAND(F.lit(ONES)), k) for k in range(LANE_BITS)]
    sim = bits[0]
    for b in bits[1:]:
        sim = sim.bitwiseOR(b)
    keys = ["doc_id", "text_hash", "pos", "h1", "h2"]
    usual = counted.filter(F.col("n_words") <= PART).select(*keys, sim.alias("sim"))
    counters = F.array(*[
        F.shiftright(F.col(f"s{i % LANE_BITS}"), LANE_BITS * (i // LANE_BITS)).bitwiseAND(F.lit((1 << LANE_BITS) - 1)) for i in range(BITS)
    ])
    places = F.posexplode(counters).alias("lane", "count")
    parts = counted.filter(F.col("n_words") > PART).select("row", *keys, "n", places)
    whole = parts.groupBy("row", *keys, "lane").agg(F.sum("count").alias("count"), F.sum("n").alias("n"))
    bit = F.expr(f"if(2 * count > n, shiftleft(1L, lane % {LANE_BITS} + {LANE_BITS} * (lane div {LANE_BITS})), 0L)")
    long_ = whole.groupBy("row", *keys).agg(F.bit_or(bit).alias("sim")).drop("row")
    return usual.unionByName(long_)


def block_count(classes: int, distance: int = DISTANCE) -> int:
    """Blocks to cut a hash into: keys of so many bits that chance alone puts few of the classes together."""
    m = distance + 2
    while (m - distance) * BITS / m < log2(max(classes, 1)) + 1 and m < BITS // 4:
        m += 1
    return m


def block_keys(sim: Column, m: int, distance: int = DISTANCE) -> Column:
    """One key for each choice of m - distance blocks: the number of the choice and the blocks' bits."""
    cuts = [BITS * k // m for k in range(m + 1)]

    def key(i: int, chosen: tuple[int, ...]) -> Column:
        out = F.lit(i).cast("long")
        for k in chosen:
            width = cuts[k + 1] - cuts[k]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftright(sim, cuts[k]).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    return F.array(*[key(i, chosen) for i, chosen in enumerate(combinations(range(m), m - distance))])


def _coded(text: Column) -> Column:
    """One character for each word: 20 bits of its hash, beyond the first plane."""
    point = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(1 << 20)) + (1 << 16)), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(F.split(text, " "), point), "")), "UTF-32")


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) with texts, coded texts and word lengths (t, c, l) of both -> linked pairs.

    Where few words differ, even changing them letter by letter costs no more
    than the longest words of both have letters, which settles most pairs on
    the much shorter coded texts. The others are compared letter by letter,
    in narrow bands first, so that long texts that are close cost little.
    """
    longest = "greatest(char_length(ta), char_length(tb))"
    most = f"cast({longest} * {100 - percent} div 100 as int)"
    fits = f"100 * least(char_length(ta), char_length(tb)) >= {percent} * {longest}"
    pairs = pairs.filter(fits).withColumn("k", F.expr(f"levenshtein(ca, cb, cast({most} / 4 as int))"))
    letters = "aggregate(slice(sort_array(concat(la, lb), false), 1, k), 0, (x, y) -> x + y + 1)"
    pairs = pairs.withColumn("sure", F.expr(f"k = 0 or (k > 0 and {letters} <= {most})"))
    shares = [*(share for share in (1, 2, 4, 8, 16, 32) if share < 100 - percent), 100 - percent]
    edits = [f"nullif(levenshtein(ta, tb, cast({longest} * {share} div 100 as int)), -1)" for share in shares]
    return pairs.filter(F.expr(f"sure or 100 * coalesce({', '.join(edits)}) <= {100 - percent} * {longest}")).select("a", "b")


def line_groups(
    docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, distance: int = DISTANCE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, pos, removed) of each line that has enough words."""
    found = stored(line_hashes(docs, min_words, id_column, text_column), "lines")
    classes = found.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"), F.min("sim").alias("sim"), F.count("*").alias("n")
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    m = block_count(classes.count(), distance)
    keyed = classes.select("node", block_keys(F.col("sim"), m, distance).alias("keys"), "sim")
    rows = _lines(docs, id_column, text_column)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes, "node")
        wanted = stored(wanted.select("node", F.col("first.doc_id").alias("d"), "first.text_hash", "first.pos"), "wanted")
        holders = broadcast_if_small(stored(wanted.select("d", "text_hash").distinct(), "holders"))
        wanted = broadcast_if_small(wanted)
        lines = rows.join(holders, rows["doc_id"].eqNullSafe(holders["d"]) & (rows["text_hash"] == holders["text_hash"]), "left_semi").select("doc_id", "text_hash", F.posexplode(_split(F.col("text"))).alias("pos", "line"))
        texts = lines.join(wanted, lines["doc_id"].eqNullSafe(wanted["d"]) & (lines["text_hash"] == wanted["text_hash"]) & (lines["pos"] == wanted["pos"]))
        texts = stored(texts.select("node", normal_line(F.col("line")).alias("t")).dropDuplicates(["node"]), "texts")
        texts = texts.withColumns({"c": _coded(F.col("t")), "l": F.transform(F.split("t", " "), F.char_length)})
        texts = stored(texts, "coded")
        for side in "ab":
            pairs = pairs.join(texts.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}{side}") for c in "tcl"]), side)
        return _similar(pairs, percent)

    groups = link_buckets(
        keyed, verify, lambda a, b: F.bit_count(a("sim").bitwiseXOR(b("sim"))) <= distance,
        differ=("sim", lambda xor: F.bit_count(xor) <= distance),
    )
    # A class of one line without links has nothing to give up and is not dealt out.
    placed = classes.join(broadcast_if_small(stored(groups, "groups")), "node", "left").filter("component is not null or n > 1")
    placed = stored(placed.withColumn("component", F.coalesce("component", "node")), "placed")
    kept = placed.groupBy("component").agg(F.min("first").alias("stays"), F.sum("n").alias("total")).filter("total > 1")
    repeated = stored(placed.join(kept, "component").select("h1", "h2", "stays"), "repeated")
    here = F.struct("doc_id", "text_hash", "pos")
    removed = F.col("stays").isNotNull() & ~here.eqNullSafe(F.col("stays"))
    return found.join(repeated, ["h1", "h2"], "left").select("doc_id", "text_hash", "pos", removed.alias("removed"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines whose numbers are given in order: what lies between two of them, joined again."""
    lines = _split(text)
    n = F.size(gone)

    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = F.when(i == n, F.size(lines)).otherwise(F.get(gone, i))
        return F.slice(lines, start + 1, end - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n")


def drop_repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, distance: int = DISTANCE, id_column: str = "doc_id",
    text_column: str = "text", drop_empty: bool = False, counted: bool = True,
) -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts and, if ``counted``, ``n_removed`` as its last column.

    ``drop_empty`` leaves out documents that lost lines and keep none with a
    word; what is their own in shorter lines keeps the others.
    """
    lines = line_groups(docs, min_words, percent, distance, id_column, text_column)
    per_text = lines.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("pos")))).alias("gone"))
    per_text = broadcast_if_small(stored(per_text.filter(F.size("gone") > 0), "gone"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_name, text_name = names[docs.columns.index(id_column)], names[docs.columns.index(text_column)]
    text = F.col(text_name).cast("string")
    plain = plain.withColumn("__hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    same = plain[id_name].eqNullSafe(per_text["doc_id"]) & (plain["__hash"] == per_text["text_hash"])
    out = plain.join(per_text, same, "left")
    new = F.when(F.col("gone").isNotNull(), _without(text, F.col("gone"))).otherwise(text)
    if drop_empty:
        out = out.filter(F.col("gone").isNull() | new.rlike(r"[\p{L}\p{N}]"))
    shown = [new.alias(c) if name == text_name else F.col(name).alias(c) for name, c in zip(names, docs.columns)]
    return out.select(*shown, *([F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed")] if counted else []))
