"""Customer totals, rankings and segments.

Everything here works on the frame ``customer_totals`` gives (one row per
customer). Compute it once and pass it on; see ``plans.reports``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import round2, total
from tallyline.session import BROADCAST_ROWS


def customer_totals(tx: DataFrame) -> DataFrame:
    """Sales, profit and number of distinct orders by customer.

    Spark aggregates by (customer, order) before it shuffles by customer, so a
    customer with a third of all rows arrives as its partial counts.
    """
    return (
        tx.filter(F.col("customer_name").isNotNull())
        .groupBy(F.col("customer_name").alias("name"))
        .agg(
            total(F.col("sales")).alias("sales"),
            total(F.col("profit")).alias("profit"),
            F.count_distinct("order_id").alias("orders"),
        )
    )


def _ranked(totals: DataFrame, by: str, ascending: bool, k: int) -> DataFrame:
    key = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return totals.orderBy(key, "name").limit(k)


def _rounded(totals: DataFrame) -> DataFrame:
    return totals.select("name", round2(F.col("sales")).alias("sales"), round2(F.col("profit")).alias("profit"), "orders")


def customer_list(totals: DataFrame) -> DataFrame:
    """All customers with reported (two-decimal) totals."""
    return _rounded(totals)


def customer_ranking(totals: DataFrame, by: str = "profit", ascending: bool = False, k: int = 20) -> DataFrame:
    """The ``k`` best (or, ascending, worst) customers by sales or profit."""
    if by not in ("sales", "profit"):
        raise ValueError(f"by must be 'sales' or 'profit', not {by!r}")
    return _rounded(_ranked(totals, by, ascending, k))


def _at_most(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _in_both(totals: DataFrame, ascending: bool, k: int) -> DataFrame:
    by_profit = _ranked(totals, "profit", ascending, k)
    by_sales = _ranked(totals, "sales", ascending, k).select("name")
    return by_profit.join(_at_most(by_sales, k), "name", "left_semi").select("name")


def vip_customers(totals: DataFrame, k: int = 20) -> DataFrame:
    """Names among the top ``k`` by profit and by sales."""
    return _in_both(totals, False, k)


def critical_customers(totals: DataFrame, k: int = 20) -> DataFrame:
    """Names among the bottom ``k`` by profit and by sales."""
    return _in_both(totals, True, k)


def segment_customers(totals: DataFrame, k: int = 20) -> DataFrame:
    """Every customer with a segment: vip, critical, loss or regular.

    The two name sets hold at most ``k`` rows each, so the list itself is
    neither shuffled nor sorted.
    """
    vip = vip_customers(totals, k).withColumn("_vip", F.lit(True))
    critical = critical_customers(totals, k).withColumn("_critical", F.lit(True))
    marked = totals.join(_at_most(vip, k), "name", "left").join(_at_most(critical, k), "name", "left")
    segment = (
        F.when(F.col("_vip"), "vip").when(F.col("_critical"), "critical").when(F.col("profit") < 0, "loss")
    ).otherwise("regular")
    return marked.select("name", "sales", "profit", "orders", segment.alias("segment"))
