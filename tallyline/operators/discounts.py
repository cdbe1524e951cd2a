"""Results by discount band."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import BAND_EDGES, BAND_LABELS, discount_band_ordinal, round2, total, usd_text


def band_totals(
    tx: DataFrame, measures=("loss", "profit"), edges=BAND_EDGES, labels=BAND_LABELS, compat: str | None = None
) -> DataFrame:
    """(band_ord, band, one total per measure); a band without rows has 0.

    One conditional sum per band and measure in a single global aggregate: each
    task sends one row, nothing is shuffled by band, and empty bands need no
    join. ``compat="float32"`` bins the rate in single precision, where a rate
    equal to an edge may fall into the next band.
    """
    if compat not in (None, "float32"):
        raise ValueError(f"compat must be None or 'float32', not {compat!r}")
    rate = F.col("discount_rate") if "discount_rate" in tx.columns else F.col("Discount")
    if compat == "float32":
        rate = rate.cast("float")
    banded = tx.select(discount_band_ordinal(rate, edges).alias("_band"), *measures)
    sums = banded.agg(
        *[
            total(F.when(F.col("_band") == band, F.col(measure))).alias(f"{measure}_{band}")
            for band in range(len(labels))
            for measure in measures
        ]
    )
    rows = [
        F.struct(
            F.lit(band).alias("band_ord"),
            F.lit(label).alias("band"),
            *[F.col(f"{measure}_{band}").alias(measure) for measure in measures],
        )
        for band, label in enumerate(labels)
    ]
    return sums.select(F.inline(F.array(*rows)))


def discount_bands(tx: DataFrame, measure: str = "profit", **options) -> DataFrame:
    """Total of ``measure`` by discount band, all bands, two decimals."""
    return band_report(band_totals(tx, [measure], **options), measure)


def discount_band_loss(tx: DataFrame, **options) -> DataFrame:
    return discount_bands(tx, "loss", **options)


def discount_band_profit(tx: DataFrame, **options) -> DataFrame:
    return discount_bands(tx, "profit", **options)


def discount_band_leak(tx: DataFrame, measure: str = "profit", **options) -> DataFrame:
    """Sum of the negative band totals, as number and as text."""
    return band_leak(band_totals(tx, [measure], **options), measure)


def band_report(totals: DataFrame, measure: str) -> DataFrame:
    return totals.select("band_ord", "band", round2(F.col(measure)).alias(measure))


def band_leak(totals: DataFrame, measure: str) -> DataFrame:
    leak = totals.agg(total(F.when(F.col(measure) < 0, F.col(measure))).alias("total"))
    return leak.select("total", usd_text(F.col("total")).alias("total_formatted"))
