"""Number cleaning, rounding and number texts, all as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in text: plain decimal notation with optional
# exponent, or an infinity, blanks round it allowed. Spark's own cast is wider
# (5d, 0x1p3).
NUMBER_TEXT = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)\s*$"


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def as_number(text: Column) -> Column:
    """Double of a number text; NULL if it is none or too large for a double."""
    value = text.try_cast("double")
    overflow = (F.abs(value) == float("inf")) & ~F.lower(text).contains("inf")
    return F.when(text.rlike(NUMBER_TEXT) & ~overflow, value)


def clean_number(text: Column) -> Column:
    """Measure text to double: commas dropped, a lone "-" and any junk are 0."""
    return _or_zero(as_number(F.replace(text, F.lit(","), F.lit(""))))


def clean_rate(text: Column, rate_unit: str = "percent") -> Column:
    """Discount text to a fraction; junk is 0.

    ``rate_unit="percent"`` divides by 100 with or without a percent sign,
    ``"fraction"`` divides only texts that carry the sign.
    """
    if rate_unit not in ("percent", "fraction"):
        raise ValueError(f"rate_unit must be 'percent' or 'fraction', not {rate_unit!r}")
    value = _or_zero(as_number(F.translate(text, "% ", "")))
    if rate_unit == "percent":
        return value / 100
    return F.when(text.contains("%"), value / 100).otherwise(value)


def whole_quantity(text: Column) -> Column:
    """Integer part of a number text, towards zero; NULL if it has none."""
    return as_number(text).try_cast("int")


def discount_amount(sales: Column, rate: Column) -> Column:
    return sales * rate


def rate_from_amount(amount: Column, sales: Column) -> Column:
    return F.when(sales > 0, amount / sales).otherwise(0.0)


def finite_or_zero(c: Column) -> Column:
    """NULL, NaN and the infinities become 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(_or_zero(c))


def total(c: Column) -> Column:
    """Sum that skips NULL and NaN and is 0 for a group without values."""
    return _or_zero(F.sum(F.nanvl(c, F.lit(None).cast("double"))))


def round_exact(x: Column, digits: int = 2) -> Column:
    """Round the binary value, exact ties to even.

    ``F.round`` rounds the shortest decimal text (2.675 to 2.68), the results
    to match round the stored value (2.67). The number formatter does that.
    """
    small = F.abs(x) < 1e15
    rounded = _format(x, "0." + "0" * digits).cast("double") + F.lit(0.0)
    return F.when(small, rounded).otherwise(x)


def round2(x: Column) -> Column:
    """Two decimals for reported totals.

    The last bits of a distributed sum depend on the order partitions arrive
    in; they are cut first so a rerun cannot flip a cent.
    """
    return round_exact(F.round(x, 6), 2)


def number_text(x: Column) -> Column:
    """Decimal text of a double, without exponent: 5.0, 1234.5, 100000000.0."""
    long_form = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    plain = (x == 0) | ((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7))
    return F.when(plain | ~(F.abs(x) < 1e16), x.cast("string")).otherwise(long_form)


def _format(x: Column, pattern: str) -> Column:
    # The formatter takes any DecimalFormat pattern, not only a digit count.
    return F.call_function("format_number", x, F.lit(pattern))


def trend_text(value: Column, signed: bool = False) -> Column:
    """"12.5%" from 12.5, at most two decimals, optionally with a plus sign."""
    text = F.concat(_format(value, "0.0#"), F.lit("%"))
    if not signed:
        return text
    return F.concat(F.when(value >= 0, "+").otherwise(""), text)


def percent_text(rate: Column, digits: int = 2) -> Column:
    """"12.34%" from 0.1234; exact ties away from zero."""
    value = rate * 100
    steps = 2 * 10**digits
    tie = (value * steps) % 2 == F.signum(value)
    exact = F.when(tie & (value * 2 ** (digits + 1) % 1 == 0), F.round(value, digits)).otherwise(value)
    return F.concat(_format(exact, "0." + "0" * digits), F.lit("%"))


def usd_text(x: Column) -> Column:
    """"$-924,001 USD" from -924000.7."""
    return F.concat(F.lit("$"), _format(x, "#,##0"), F.lit(" USD"))
