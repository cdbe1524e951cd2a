"""Groups of linked nodes: connected components, and links among nodes that share a bucket.

Nothing here depends on how many nodes share a bucket or a component: buckets
are never collected, hubs are minima and joins that Spark can split, and all
state between rounds lies in the shared folder.
"""

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.session import broadcast_if_small, shared, staged


stored = staged

#: Of keys with so many nodes all pairs are looked at, if marks alone can rule them out.
FEW = 8


def _is_star(edges: DataFrame) -> bool:
    """Whether no smaller end of an edge is the larger end of another, and no larger end has two smaller ones."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); a component is named by its smallest node.

    Alternates two steps on the edge set until it is a star per component: link
    each node's larger neighbours to its smallest one, then its smaller ones
    and itself. Edges never outnumber those given, and rounds grow with the
    logarithm of a component's size.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = shared(edges.distinct())
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = shared(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def link_buckets(
    nodes: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    differ: tuple[str, Callable[[Column], Column]] | None = None,
    sharpen: Callable[[DataFrame], DataFrame] | None = None,
    nearer: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
) -> DataFrame:
    """(node, component) over the links that ``verify`` confirms among nodes that share a key.

    ``nodes`` has (node, keys: distinct longs, and marks). ``near`` tells from
    the marks of two nodes, given as ``a("name")`` and ``b("name")``, whether a
    pair may be linked at all; it runs inside joins, so only such pairs leave
    them. ``differ`` may name a mark (a long) and say the same from the bits in
    which two nodes differ there. ``verify`` takes distinct pairs (a, b) and
    returns those linked.

    Keys of two nodes give their pair at once. With ``differ`` keys of up to
    ``FEW`` give all their pairs that may be linked, and a key of three is left
    out at once, from sums over the mark, if none may: most such keys are shared
    by chance, and the number of those grows with the square of the nodes'
    number or faster. Of a key of more the best
    connected node is the pivot. First each node is compared with the best
    connected pivot among those of its keys, then (without
    ``sharpen``) those that this leaves outside a pivot's component with that
    pivot; what is linked so far is put in components each time. Then, key by key, the nodes outside the pivot's component
    are compared with the nodes of other components; for these keys
    ``sharpen`` may give further marks, from (node) of all nodes that have one
    of them, for ``nearer`` to rule pairs out. A pair that shares several such
    keys is looked at under the first of them. So each pair that shares a key
    ends ruled out, compared or within one component, whatever the number of
    nodes with a key, and a key whose nodes are all linked costs no more than
    its nodes. Nodes without links are not returned.
    """
    marks = [c for c in nodes.columns if c not in ("node", "keys")]
    each = nodes.select("node", F.posexplode("keys").alias("at", "key"), *marks)
    held = each.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"),
        *([f(differ[0]).alias(name) for name, f in (("least", F.min), ("most", F.max), ("all", F.bit_xor))] if differ else []),
    ).filter("n > 1")
    few = 2
    if differ:
        few = FEW
        of_two = differ[1](F.col("all"))
        # Of three marks all xor-ed, one leaves the bits in which the other two differ.
        of_three = reduce(Column.__or__, [differ[1](F.col(x).bitwiseXOR(F.col(y))) for x, y in combinations(("least", "most", "all"), 2)])
        held = held.filter((F.col("n") > 3) | ((F.col("n") == 2) & of_two) | ((F.col("n") == 3) & of_three))
    held = stored(held.select("key", "n", "a", "b"), "shared-keys")
    two = held.filter("n = 2").select("a", "b").distinct()
    several = broadcast_if_small(stored(held.filter("n > 2").select("key", "n"), "several"))
    rows = stored(each.select("node", "at", "key", *([differ[0]] if differ else [])).join(several, "key"), "rows")
    if differ:
        small = rows.filter(F.col("n") <= few).select("key", "node", F.col(differ[0]).alias("mark"))
        other = small.select(F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("mark").alias("mark_b"))
        alike = (F.col("key") == F.col("key_b")) & (F.col("node") < F.col("b")) & differ[1](F.col("mark").bitwiseXOR(F.col("mark_b")))
        two = stored(two.unionByName(small.join(other, alike).select(F.col("node").alias("a"), "b")).distinct(), "few")
        rows = rows.filter(F.col("n") > few).drop(differ[0])
    degree = rows.groupBy("node").agg(F.sum("n").alias("degree"))
    about = stored(degree.join(nodes, "node").select("node", "degree", "keys", *marks), "about")
    best = rows.join(about.select("node", "degree"), "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("best"))
    pivots = stored(best.select("key", F.col("best.degree").alias("degree"), F.col("best.node").alias("pivot")), "pivots")

    def side(source: DataFrame, which: str, *columns: str) -> DataFrame:
        return source.select(F.col("node").alias(which), *[F.col(c).alias(f"{which}_{c}") for c in [*columns, *marks]])

    may_link = near(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    chosen = rows.join(pivots, "key").groupBy("node").agg(F.max(F.struct("degree", "pivot")).alias("best"))
    pairs = chosen.select(F.col("node").alias("a"), F.col("best.pivot").alias("b")).filter("a <> b")
    pairs = pairs.join(side(about, "a"), "a").join(side(about, "b"), "b").filter(may_link).select("a", "b")
    if not differ:
        two = two.join(side(nodes, "a"), "a").join(side(nodes, "b"), "b").filter(may_link).select("a", "b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(two).distinct()
    links = stored(verify(pairs), "links")
    groups = shared(connected_components(links))

    def grouped(df: DataFrame, column: str, out: str) -> DataFrame:
        named = groups.select(F.col("node").alias(column), F.col("component").alias(out))
        return df.join(named, column, "left").withColumn(out, F.coalesce(out, column))

    def beyond() -> DataFrame:
        """Rows of nodes outside the component of their key's pivot."""
        placed = grouped(rows.select("node", "at", "key"), "node", "component")
        main = grouped(pivots, "pivot", "main").select("key", "main", "pivot")
        found = placed.join(main, "key").filter("component <> main")
        return stored(found.select(F.col("node").alias("a"), "at", "key", F.col("component").alias("ca"), "main", "pivot"), "outside")

    outside = beyond()
    if outside.isEmpty():
        return groups
    if not sharpen:
        pairs = outside.select("a", F.col("pivot").alias("b")).distinct().join(side(about, "a"), "a").join(side(about, "b"), "b").filter(may_link)
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        more = stored(verify(pairs), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            groups = shared(connected_components(links))
            outside = beyond()
            if outside.isEmpty():
                return groups
    placed = stored(grouped(rows.select("node", "at", "key"), "node", "component"), "placed")
    open_ = stored(outside.select("key").distinct(), "open")
    rest = placed.join(broadcast_if_small(open_), "key", "left_semi")
    if sharpen:
        rest = stored(rest, "rest")
        sharper = sharpen(rest.select("node").distinct())
        about = stored(about.join(sharper, "node"), "about")
        marks = [c for c in about.columns if c not in ("node", "keys", "degree")]
        may_link = may_link & nearer(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    rest = rest.select(F.col("node").alias("b"), "key", F.col("component").alias("cb"))
    a, b = outside.join(side(about, "a", "keys"), "a"), rest.join(side(about, "b", "keys"), "b")
    # Of two nodes outside, the smaller asks.
    once = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))
    earlier = F.expr("at > 0 and arrays_overlap(slice(a_keys, 1, at), slice(b_keys, 1, at))")
    wanted = (F.col("ca") != F.col("cb")) & once & may_link & ~earlier
    pairs = a.join(b.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & wanted)
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return groups
    more = stored(verify(pairs), "links")
    return groups if more.isEmpty() else connected_components(links.unionByName(more))
