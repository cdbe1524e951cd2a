"""Transactions merged by order, from which totals are drawn without reading the lines again."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import total

MERGED = ["order_id", "customer_name", "country", "order_date"]


def order_partials(tx: DataFrame) -> DataFrame:
    """One row per order, customer, country and month: sums, and the ``order_lines`` it stands for.

    A row reads as a transaction of its month: sums of sums are the same, an
    order keeps its id, so distinct orders stay exact, and lines are counted by
    ``order_lines``. So partials of several batches are merged by putting them
    together, and ``kpis``, ``customer_totals``, ``country_totals`` and
    ``critical_geography`` take them in place of the lines.
    """
    month = F.date_trunc("month", F.col("order_date")).cast("timestamp_ntz")
    keys = [month.alias("order_date") if c == "order_date" else F.col(c) for c in MERGED]
    return tx.groupBy(*keys).agg(
        *[total(F.col(c)).alias(c) for c in ("sales", "profit", "shipping_cost")], F.count("*").alias("order_lines")
    )
