"""Yearly key figures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import round2, total, trend_text
from tallyline.operators.canonical import year_slice
from tallyline.operators.checks import require_columns
from tallyline.schema import KPI_REQUIRED


def kpis(tx: DataFrame, year: int | None = None) -> DataFrame:
    """One row of figures of the last year against the year before.

    One pass over the two years: orders are counted apart from the sums, but in
    the same aggregation, which Spark plans as (year, order) then year, so no
    customer, day or order can make one task hot. The mean order value is the
    sales of identified orders over their number. Give ``year`` when it is
    known; the scan then needs no look for the newest date.
    """
    require_columns(tx, KPI_REQUIRED)
    both = year_slice(tx, years=2, year=year)
    order_id = F.col("order_id") if "order_id" in tx.columns else None
    identified = F.col("sales") if order_id is None else F.when(order_id.isNotNull(), F.col("sales"))
    orders = F.count("*") if order_id is None else F.count_distinct(order_id)
    by_year = both.groupBy(F.year("order_date").alias("year")).agg(
        total(F.col("sales")).alias("sales"),
        total(F.col("profit")).alias("profit"),
        total(identified).alias("identified"),
        orders.alias("orders"),
    )
    # At most two rows from here on.
    facts = F.struct("sales", "profit", "identified", "orders")
    years = by_year.agg(
        F.max("year").alias("year"), F.map_from_entries(F.collect_list(F.struct("year", facts))).alias("facts")
    )
    if year is not None:
        years = years.withColumn("year", F.when(F.try_element_at("facts", F.lit(year)).isNotNull(), F.lit(year)))
    last = F.try_element_at("facts", F.col("year"))
    before = F.try_element_at("facts", F.col("year") - 1)
    sales_before = F.coalesce(before["sales"], F.lit(0.0))
    orders_before = F.coalesce(before["orders"], F.lit(0))
    margin = last["profit"] / F.when(last["sales"] > 0, last["sales"]) * 100
    sales_trend = (last["sales"] - sales_before) / F.when(sales_before > 0, sales_before) * 100
    order_trend = (last["orders"] - orders_before) / F.when(orders_before > 0, orders_before) * 100
    known = F.col("year").isNotNull()
    return years.select(
        F.coalesce(round2(last["sales"]), F.lit(0.0)).alias("gross_revenue"),
        F.coalesce(round2(F.try_divide(last["identified"], last["orders"])), F.lit(0.0)).alias("avg_order"),
        F.coalesce(trend_text(F.round(margin, 9)), F.lit("0%")).alias("profit_margin"),
        F.when(known, F.coalesce(trend_text(F.round(sales_trend, 9), signed=True), F.lit("New")))
        .otherwise("0%")
        .alias("sales_trend"),
        F.when(known, F.coalesce(trend_text(F.round(order_trend, 9), signed=True), F.lit("New")))
        .otherwise("+0.0%")
        .alias("order_trend"),
        F.coalesce("year", F.year(F.current_date())).alias("current_year"),
    )
