"""Alignment of the sources to the canonical transaction table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import clean_number, clean_rate, discount_amount, finite_or_zero, rate_from_amount
from tallyline.operators.checks import ensure_columns, require_columns
from tallyline.schema import CSV_COLUMNS, INVOICE_COLUMNS, TRANSACTIONS

MEASURES = ["sales", "profit", "shipping_cost", "loss"]


def to_canonical(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename source columns to canonical ones; others stay as they are."""
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def conform(df: DataFrame) -> DataFrame:
    """Canonical types for the canonical columns a frame has, in their order."""
    known = [f for f in TRANSACTIONS.fields if f.name in df.columns]
    extra = [F.col(f"`{name}`") for name in df.columns if name not in TRANSACTIONS.fieldNames()]
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in known], *extra)


def clean_measures(df: DataFrame, columns=MEASURES) -> DataFrame:
    """Text measures to doubles; a measure the source lacks is 0."""
    df = ensure_columns(df, dict.fromkeys(columns, "0"))
    return df.withColumns({name: clean_number(F.col(name).cast("string")) for name in columns})


def clean_discounts(df: DataFrame, column: str = "Discount", rate_unit: str = "percent") -> DataFrame:
    """Rate from the discount text, amount from sales and rate; raw columns go."""
    rate = clean_rate(F.col(column).cast("string"), rate_unit) if column in df.columns else F.lit(0.0)
    df = df.withColumn("discount_rate", rate).drop("Discount", "Discount rate")
    return df.withColumn("discount_amount", discount_amount(F.col("sales"), F.col("discount_rate")))


def with_discount_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("discount_amount", discount_amount(F.col("sales"), F.col("discount_rate")))


def with_discount_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("discount_rate", rate_from_amount(F.col("discount_amount"), F.col("sales")))


def parse_dates(df: DataFrame, date_format: str = "M/d/yyyy") -> DataFrame:
    """Order and ship date from text; a row without order date is dropped.

    ``M/d/yyyy`` reads padded and unpadded dates, ``d/M/yyyy`` those that put
    the day first.
    """

    def parsed(name):
        return F.try_to_timestamp(F.col(name), F.lit(date_format)).cast("timestamp_ntz")

    dates = {name: parsed(name) for name in ("order_date", "ship_date") if name in df.columns}
    return df.withColumns(dates).dropna(subset=["order_date"])


def canonical_csv(raw: DataFrame, date_format: str = "M/d/yyyy", rate_unit: str = "percent") -> DataFrame:
    """CSV cells (all text) to canonical rows."""
    require_columns(raw, ["Order Date"])
    df = clean_measures(to_canonical(raw, CSV_COLUMNS))
    df = parse_dates(clean_discounts(df, rate_unit=rate_unit), date_format)
    return conform(df).withColumn("source", F.lit("csv"))


def canonical_invoices(lines: DataFrame, rate: str = "amount", compat: str | None = None) -> DataFrame:
    """Stored invoice lines to canonical rows.

    ``rate="amount"`` derives the discount rate from amount and sales,
    ``"stored"`` keeps the rate of the invoice. ``compat="literal"`` takes the
    (always zero) loss for the discount amount and leaves ship date, ship mode,
    priority, segment and market empty.
    """
    if rate not in ("amount", "stored"):
        raise ValueError(f"rate must be 'amount' or 'stored', not {rate!r}")
    if compat not in (None, "literal"):
        raise ValueError(f"compat must be None or 'literal', not {compat!r}")
    df = to_canonical(lines, INVOICE_COLUMNS)
    if compat == "literal":
        unmapped = ["ship_date", "ship_mode", "order_priority", "segment", "market", "loss"]
        df = df.withColumn("discount_amount", F.col("loss")).withColumns({c: F.lit(None) for c in unmapped})
    if rate == "amount" or compat == "literal":
        df = with_discount_rate(df)
    return conform(df).withColumn("source", F.lit("xml"))


def consolidate(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, aligned by column name; gaps are NULL."""
    present = [df for df in sources if df is not None]
    if not present:
        raise ValueError("no source to consolidate")
    result = present[0]
    for df in present[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def sanitize_measures(df: DataFrame, columns=("profit", "shipping_cost", "sales")) -> DataFrame:
    """NULL, NaN and infinite measures become 0."""
    return df.withColumns({c: finite_or_zero(F.col(c).try_cast("double")) for c in columns if c in df.columns})


def narrow_measures(df: DataFrame, columns=(*MEASURES, "discount_rate", "discount_amount")) -> DataFrame:
    """Single-precision measures, for results that must match such storage."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns if c in df.columns})


def with_loss_flag(df: DataFrame, column: str = "profit") -> DataFrame:
    """Mark rows whose profit (or margin) is negative."""
    return df.withColumn("is_loss", F.col(column) < 0)


def losses_only(df: DataFrame, column: str = "profit") -> DataFrame:
    return df.filter(F.col(column) < 0)


def last_year(tx: DataFrame) -> DataFrame:
    """One row: year of the newest order. Reads the date column, or where the
    table is stored by ``order_year`` no column at all, but opens every file;
    ``stored_last_year`` tells it from a stored table's log."""
    if "order_year" in tx.columns:
        return tx.agg(F.max("order_year").cast("int").alias("last_year"))
    return tx.agg(F.year(F.max("order_date")).alias("last_year"))


def _january_first() -> list:
    return [F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)]


def year_slice(tx: DataFrame, offset: int = 0, years: int = 1, year: int | None = None) -> DataFrame:
    """Rows of the last year (or of ``year``), ``offset`` years back.

    With ``years`` > 1 the slice reaches further back. Without a given year it
    is found by a scalar subquery, whose result is pushed to the scan: a date
    range for row groups, and a partition filter where rows lie by order year.
    """
    if year is not None:
        first, last = F.lit(year - offset - years + 1), F.lit(year - offset)
        start = F.make_timestamp_ntz(first, *_january_first())
        end = F.make_timestamp_ntz(last + 1, *_january_first())
    else:
        newest = last_year(tx)
        first = newest.select(F.col("last_year") - offset - years + 1).scalar()
        last = newest.select(F.col("last_year") - offset).scalar()
        start = newest.select(F.make_timestamp_ntz(F.col("last_year") - offset - years + 1, *_january_first())).scalar()
        end = newest.select(F.make_timestamp_ntz(F.col("last_year") - offset + 1, *_january_first())).scalar()
    kept = tx.filter(F.col("order_date") >= start)
    if offset or year is not None:
        kept = kept.filter(F.col("order_date") < end)
    if "order_year" in tx.columns:
        kept = kept.filter((F.col("order_year") >= first) & (F.col("order_year") <= last))
    return kept

