"""Product rankings. The rankings by product work on the frame ``product_totals``
or ``product_discounts`` gives; compute it once and pass it on."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import round2, short_label, total
from tallyline.operators.canonical import losses_only, sanitize_measures


def product_totals(tx: DataFrame) -> DataFrame:
    """Profit and sales by product."""
    return (
        sanitize_measures(tx.select("product_name", "profit", "sales"))
        .filter(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(total(F.col("profit")).alias("profit"), total(F.col("sales")).alias("sales"))
    )


def product_discounts(tx: DataFrame) -> DataFrame:
    """Discount volume (absolute value of the summed loss) and profit by product."""
    return (
        tx.filter(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(
            total(F.col("sales")).alias("sales"),
            total(F.col("profit")).alias("profit"),
            F.abs(total(F.col("loss"))).alias("discount_value"),
        )
    )


def top_shipping(tx: DataFrame, k: int = 300) -> DataFrame:
    """The ``k`` rows with the highest shipping cost."""
    order_id = F.col("order_id") if "order_id" in tx.columns else F.lit("N/A")
    rows = sanitize_measures(tx).select(
        short_label(F.col("product_name")).alias("name"),
        F.col("product_name").alias("full_name"),
        "shipping_cost",
        "profit",
        order_id.cast("string").alias("order_id"),
    )
    return rows.orderBy(F.desc("shipping_cost"), "full_name", "order_id", "profit").limit(k)


def top_losses(totals: DataFrame, k: int = 20) -> DataFrame:
    """Products with the most negative profit."""
    ranked = losses_only(totals).orderBy("profit", "product_name").limit(k)
    return ranked.select(
        short_label(F.col("product_name")).alias("name"),
        F.col("product_name").alias("full_name"),
        F.col("profit").alias("loss_amount"),
        "sales",
    )


def bottom_products(totals: DataFrame, k: int = 20) -> DataFrame:
    """Products with the lowest sales."""
    ranked = totals.orderBy("sales", "product_name").limit(k)
    return ranked.select(
        short_label(F.col("product_name")).alias("name"), F.col("product_name").alias("full_name"), "sales"
    )


def top_discounts(totals: DataFrame, k: int = 25) -> DataFrame:
    """Products with the largest discount volume."""
    ranked = totals.orderBy(F.desc("discount_value"), "product_name").limit(k)
    return ranked.select(
        short_label(F.col("product_name"), 25).alias("name"),
        F.col("product_name").alias("full_name"),
        round2(F.col("discount_value")).alias("discount_value"),
        round2(F.col("profit")).alias("profit"),
    )
