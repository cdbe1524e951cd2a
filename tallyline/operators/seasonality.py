"""Seasonality and category performance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import lead_days, month_label, total
from tallyline.operators.canonical import year_slice


def shipped(tx: DataFrame) -> DataFrame:
    """Rows with a ship date."""
    return tx.filter(F.col("ship_date").isNotNull())


def monthly_seasonality(tx: DataFrame) -> DataFrame:
    """Sales and mean lead time by calendar month, over all years."""
    by_month = (
        shipped(tx)
        .filter(F.col("order_date").isNotNull())
        .groupBy(F.month("order_date").alias("month"))
        .agg(
            total(F.col("sales")).alias("sales"),
            F.avg(lead_days(F.col("order_date"), F.col("ship_date"))).alias("days_to_ship"),
        )
    )
    return by_month.select("month", month_label(F.col("month")).alias("date"), "sales", "days_to_ship").orderBy("month")


def category_performance(tx: DataFrame) -> DataFrame:
    """Sales, profit and discount volume by category, shipped rows only."""
    return (
        shipped(tx)
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            total(F.col("sales")).alias("sales"),
            total(F.col("profit")).alias("profit"),
            F.abs(total(F.col("loss"))).alias("discount_value"),
        )
    )


def subcategory_ranking(tx: DataFrame, year: int | None = None) -> DataFrame:
    """Sub-categories of the last year, most profitable first."""
    return (
        year_slice(tx, year=year)
        .filter(F.col("sub_category").isNotNull())
        .groupBy("sub_category")
        .agg(total(F.col("sales")).alias("sales"), total(F.col("profit")).alias("profit"))
        .orderBy(F.desc("profit"), "sub_category")
    )
