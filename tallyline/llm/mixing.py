"""Mixing sources to target weights: a token budget handed down a tree, and seeded prefixes of its leaves.

Documents hang below a tree of levels (such as domain, language, source). A
node's budget goes to its children in proportion to their weights; a child that
has too little keeps what it has, and the shortage is shared among its siblings
again by weight. A node's capacity is the sum below it, so a shortage leaves a
subtree only when all of the subtree is used up. All amounts are whole tokens
(shares are rounded down), so results do not depend on the order of sums.

A leaf may be read several times over. Its last, unfinished reading takes a
prefix of its tokens in an order that a seed and the reading's number fix.
Documents are dealt to buckets by the first bits of their place in that order;
sums by bucket tell where a bucket begins, so no leaf is ever ordered as a
whole and a leaf with a third of all rows is spread like any other.

Null level values count as "", null texts have no tokens. Rows that repeat
identifier and text tie, and any of them may be the one that is taken. An empty
table gives an empty result. Weights come with the configuration: a few rows
by node, 1 for nodes that are not named; a weight of 0 excludes.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.linking import stored
from tallyline.session import broadcast_if_small

BUCKET_DIGITS = 4
EXACT = "decimal(20,0)"

Weights = dict[tuple[str, ...], int]


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(levels: list[str], weights: Weights) -> Column:
    named = [(path, w) for path, w in weights.items() if len(path) == len(levels)]
    out = F.lit(1)
    for path, w in named:
        here = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(levels, path)])
        out = F.when(here, F.lit(w)).otherwise(out)
    return out.cast("decimal(10,0)")


def _share(children: DataFrame, parents: list[str], levels: list[str], weights: Weights) -> DataFrame:
    """Rows (levels, capacity, given: the parent's budget) -> (levels, budget)."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    inorder = family.orderBy((F.col("capacity") / F.col("w")).cast("double"), levels[-1])
    earlier = inorder.rowsBetween(Window.unboundedPreceding, -1)
    onwards = inorder.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = children.withColumn("w", _weight(levels, weights)).filter("w > 0")
    rows = rows.withColumns({
        "used": F.coalesce(F.sum("capacity").over(earlier), F.lit(0)).cast(EXACT),
        "ahead": F.sum("w").over(onwards).cast(EXACT),
    })
    rows = rows.withColumn("whole", F.expr("capacity * ahead <= (given - used) * w"))
    rows = rows.withColumns({
        "settled": F.sum(F.expr("if(whole, capacity, 0)")).over(family).cast(EXACT),
        "open": F.sum(F.expr("if(whole, 0, w)")).over(family).cast(EXACT),
    })
    return rows.select(*levels, F.expr(f"cast(if(whole, capacity, (given - settled) * w div open) as {EXACT})").alias("budget"))


def allocate(leaves: DataFrame, levels: list[str], budget: int, weights: Weights | None = None) -> DataFrame:
    """Rows (levels, capacity) -> (levels, budget) of each leaf; leaves of weight 0 or below such nodes are left out."""
    leaves = leaves.withColumn("capacity", F.col("capacity").cast(EXACT))
    whole = leaves.agg(F.coalesce(F.sum("capacity"), F.lit(0)).cast(EXACT).alias("c")).first().c
    given, parents = None, []
    for depth in range(1, len(levels) + 1):
        here = levels[:depth]
        nodes = leaves.groupBy(*here).agg(F.sum("capacity").cast(EXACT).alias("capacity"))
        if given is None:
            nodes = nodes.withColumn("given", F.lit(min(int(whole), budget)).cast(EXACT))
        else:
            nodes = nodes.join(given.withColumnRenamed("budget", "given"), parents)
        given, parents = _share(nodes, parents, here, weights or {}), here
    return given


def mix(
    docs: DataFrame, levels: dict[str, Column], budget: int | float, weights: Weights | None = None, epochs: int = 1,
    seed: int = 0, id_column: str = "doc_id", text_column: str = "text", tokens: Column | None = None,
) -> DataFrame:
    """(doc_id, levels, n_tokens, text_md5, leaf_budget, epochs, last_tokens), one row per row of ``docs``.

    ``budget`` is a number of tokens, or as a float a share of all there are.
    A document is read ``epochs`` times in full and once more up to
    ``last_tokens``; both are 0 for what the budget does not reach. No leaf is
    read more than the given number of ``epochs``.
    """
    names = list(levels)
    text = F.col(text_column).cast("string")
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
        (word_count(text) if tokens is None else tokens.cast("long")).alias("n_tokens"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_md5"),
    )
    rows = stored(rows, "rows")
    totals = rows.groupBy(*names).agg(F.sum("n_tokens").alias("total"))
    if isinstance(budget, float):
        budget = int(budget * (rows.agg(F.sum("n_tokens")).first()[0] or 0))
    plan = allocate(totals.withColumn("capacity", F.col("total") * epochs), names, budget, weights)
    plan = totals.join(plan, names, "left").select(
        *names,
        F.coalesce(F.col("budget").cast("long"), F.lit(0)).alias("leaf_budget"),
        F.coalesce(F.expr("if(total > 0, cast(budget as long) div total, 0)"), F.lit(0)).alias("epochs"),
        F.coalesce(F.expr("if(total > 0, cast(budget as long) % total, 0)"), F.lit(0)).alias("rest"),
    )
    rows = rows.join(broadcast_if_small(stored(plan, "plan")), names)
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5").cast("binary"))
    rows = rows.withColumn("place", place).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    sums = rows.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select(*names, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")), "buckets")
    within = Window.partitionBy(*names, "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, [*names, "bucket"])
    last = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("begin") - F.col("inside")))
    return rows.select("doc_id", *names, "n_tokens", "text_md5", "leaf_budget", "epochs", last.cast("long").alias("last_tokens"))


def keep_reached(
    docs: DataFrame, levels: dict[str, Column], budget: int | float, weights: Weights | None = None, seed: int = 0,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that the budget reaches in one reading, whole; a leaf exceeds its budget by part of one document at most.

    Rows without tokens stay: they take nothing from the budget. Rows that
    repeat identifier and text stay or go together.
    """
    found = stored(mix(docs, levels, budget, weights, 1, seed, id_column, text_column), "mixed")
    out = found.filter("n_tokens > 0 and epochs = 0 and last_tokens = 0")
    # A repeat that is not reached stays with one that is.
    reached = found.filter("n_tokens > 0 and (epochs > 0 or last_tokens > 0)")
    out = out.select("doc_id", "text_md5").distinct()
    out = stored(out, "unreached")
    same = out["doc_id"].eqNullSafe(reached["doc_id"]) & (out["text_md5"] == reached["text_md5"])
    out = broadcast_if_small(stored(out.join(reached.select("doc_id", "text_md5"), same, "left_anti"), "left"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_name, text_name = names[docs.columns.index(id_column)], names[docs.columns.index(text_column)]
    plain = plain.withColumn("__md5", F.md5(F.coalesce(F.col(text_name).cast("string"), F.lit("")).cast("binary")))
    gone = plain[id_name].eqNullSafe(out["doc_id"]) & (plain["__md5"] == out["text_md5"])
    return plain.join(out, gone, "left_anti").select(*names).toDF(*docs.columns)
