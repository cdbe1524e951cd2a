"""The shared test tables as canonical transactions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical column -> (table it needs, expression over the joined tables).
COLUMNS = {
    "order_id": ("lineitem", "cast(l_orderkey as string)"),
    "order_date": ("orders", "o_orderdate"),
    "ship_date": ("lineitem", "l_shipdate"),
    "order_priority": ("orders", "o_orderpriority"),
    "customer_name": ("customer", "c_name"),
    "segment": ("customer", "c_mktsegment"),
    "country": ("nation", "n_name"),
    "market": ("region", "r_name"),
    "category": ("part", "p_type"),
    "sub_category": ("part", "p_brand"),
    "product_name": ("part", "p_name"),
    "sales": ("lineitem", "l_extendedprice"),
    "profit": ("lineitem", "l_extendedprice * (0.05D - l_discount)"),
    "shipping_cost": ("lineitem", "l_extendedprice * l_tax"),
    "loss": ("lineitem", "-(l_extendedprice * l_discount)"),
    "quantity": ("lineitem", "cast(l_quantity as int)"),
    "discount_rate": ("lineitem", "l_discount"),
    "discount_amount": ("lineitem", "l_extendedprice * l_discount"),
}

# Table -> (table it hangs on, join columns).
JOINS = {
    "orders": ("lineitem", "l_orderkey", "o_orderkey"),
    "customer": ("orders", "o_custkey", "c_custkey"),
    "nation": ("customer", "c_nationkey", "n_nationkey"),
    "region": ("nation", "n_regionkey", "r_regionkey"),
    "part": ("lineitem", "l_partkey", "p_partkey"),
}

# A rate that reaches the upper discount bands too.
WIDE_RATE = "round(l_discount + 2 * l_tax, 2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str, name: str, needed: set) -> DataFrame:
    """A table with all that hangs on it; what hangs on a smaller table is joined to that one first."""
    df = table(spark, sf_dir, name)
    for other, (on, left, right) in reversed(JOINS.items()):
        if on == name and other in needed:
            df = df.join(_joined(spark, sf_dir, other, needed), F.col(left) == F.col(right))
    return df


def transactions(spark: SparkSession, sf_dir: str, *columns: str, wide_rate: bool = False) -> DataFrame:
    """Canonical columns (all, if none is named) of the test tables.

    Only the tables the columns need are joined.
    """
    names = columns or tuple(COLUMNS)
    needed = set()
    for name in names:
        source = COLUMNS[name][0]
        while source != "lineitem":
            needed.add(source)
            source = JOINS[source][0]
    df = _joined(spark, sf_dir, "lineitem", needed)
    expressions = {name: COLUMNS[name][1] for name in names}
    if wide_rate:
        expressions["discount_rate"] = WIDE_RATE
    return df.select(*[F.expr(text).alias(name) for name, text in expressions.items()])
