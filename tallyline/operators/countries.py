"""Market rankings. The rankings work on the frame ``country_totals`` gives."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import round2, total


def country_totals(tx: DataFrame) -> DataFrame:
    """Sales, profit, shipping and number of order lines by country."""
    lines = F.count("order_id")
    if "order_lines" in tx.columns:  # of ``order_partials``
        lines = F.coalesce(F.sum(F.when(F.col("order_id").isNotNull(), F.col("order_lines"))), F.lit(0))
    return (
        tx.filter(F.col("country").isNotNull())
        .groupBy("country")
        .agg(
            total(F.col("sales")).alias("sales"),
            total(F.col("profit")).alias("profit"),
            total(F.col("shipping_cost")).alias("shipping_cost"),
            lines.alias("orders"),
        )
    )


def _by_sales(totals: DataFrame) -> DataFrame:
    return totals.select("country", "sales", "profit", "orders").orderBy(F.desc_nulls_last("sales"), "country")


def market_leader(totals: DataFrame) -> DataFrame:
    """The country with the highest sales."""
    return _by_sales(totals).limit(1)


def market_bubble(totals: DataFrame, skip: int = 1, k: int = 50) -> DataFrame:
    """The ``k`` countries behind the first ``skip`` by sales."""
    return _by_sales(totals).offset(skip).limit(k)


def shipping_margin(totals: DataFrame) -> DataFrame:
    """Mean shipping cost per order line against profit margin, by country."""
    margin = F.when(F.col("sales") != 0, F.col("profit") / F.col("sales") * 100).otherwise(0.0)
    return totals.select(
        "country",
        round2(F.try_divide("shipping_cost", "orders")).alias("avg_shipping"),
        round2(margin).alias("profit_margin"),
    )


def bottom_countries(totals: DataFrame, k: int = 15) -> DataFrame:
    """Countries with the lowest profit."""
    return totals.orderBy(F.asc_nulls_last("profit"), "country").limit(k).select("country", "profit")


def critical_geography(tx: DataFrame, k: int = 15) -> DataFrame:
    """Countries with the most customers who lost money there."""
    per_customer = (
        tx.filter(F.col("customer_name").isNotNull() & F.col("country").isNotNull())
        .groupBy("customer_name", "country")
        .agg(total(F.col("profit")).alias("profit"))
    )
    losing = per_customer.filter(F.col("profit") < 0).groupBy("country").agg(F.count("*").alias("count"))
    return losing.orderBy(F.desc("count"), "country").limit(k)
