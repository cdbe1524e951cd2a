"""Far pages of the stored table, found by a histogram that is kept beside it."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.explore import DEFAULT_LIMIT, DEFAULT_SORT, SLICES, TOP_K_ROWS, cut_values, is_sliceable, literal, rows_from, slices_of_page
from tallyline.plans.load import keep_beside
from tallyline.session import scratch_path
from tallyline.sources.tables import read_table, replace_dataset, within_folders

#: A slice of several values with so many times the even share of rows has the column cut anew.
UNEVEN = 8


def store_slices(spark: SparkSession, path: str, slices_path: str, by: str, slices: int = SLICES) -> DataFrame:
    """Keep an equi-depth histogram of a column of the stored table up to date beside it and read it.

    One row per source, year and slice: ``upper`` (the value the slice ends with;
    none for the last), ``missing`` (the slice of missing values), ``low`` and
    ``high`` (its least and largest value) and how many ``rows`` there are, exactly.
    Slices are told by ``upper``, so counts of years that were made at different
    times add up. Only years whose files changed are counted again, between the
    values known. When rows pile up in a slice (as new dates do in the last) and
    the table has twice the rows it was cut with (``cut_with``), the whole column
    is cut anew.
    """
    table = read_table(spark, path)
    if not is_sliceable(table, by):
        raise ValueError(f"{by!r} has no order to cut")
    field = table.schema[by]
    try:
        known = read_table(spark, slices_path)
    except ValueError:
        known = None
    fresh = known is None
    cut_with = None if fresh else known.agg(F.max("cut_with")).first()[0]
    if cut_with is None:
        cut_with = table.count()
    cuts = cut_values(table, by, slices) if fresh else [r.upper for r in known.select("upper").distinct().collect() if r.upper is not None]

    def count(rows: DataFrame, sources: list) -> DataFrame:
        edges = sorted(cuts, key=lambda c: c.encode() if isinstance(c, str) else c)
        key = F.col(by)
        ends = [F.when(key <= literal(edge, field), literal(edge, field)) for edge in edges]
        upper = F.coalesce(*ends, F.lit(None).cast(field.dataType))
        return rows.groupBy("source", "order_year", upper.alias("upper"), key.isNull().alias("missing")).agg(
            F.min(by).alias("low"), F.max(by).alias("high"), F.count("*").alias("rows"), F.lit(cut_with).cast("long").alias("cut_with")
        )

    folders = ["source", "order_year"]
    found = keep_beside(spark, path, slices_path, count, folders)
    if not fresh:
        totals = _merged(found)
        total = sum(r.rows for r in totals)
        if total >= 2 * cut_with and any(r.rows * slices > UNEVEN * total and r.low != r.high for r in totals):
            cuts, cut_with = cut_values(table, by, slices), total
            anew = keep_beside(spark, path, scratch_path(spark, "slices"), count, folders)
            replace_dataset(anew, slices_path, [], folders)
            found = read_table(spark, slices_path)
    return found


def _merged(slices: DataFrame) -> list:
    """The slices over all sources and years, smallest values first, missing ones last; as many rows as there are slices."""
    merged = slices.groupBy("missing", "upper").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"))
    return sorted(merged.collect(), key=lambda r: (r.missing, r.upper is None, r.upper.encode() if isinstance(r.upper, str) else r.upper or 0))


def stored_page(
    spark: SparkSession,
    path: str,
    slices_path: str,
    number: int = 1,
    limit: int = DEFAULT_LIMIT,
    by: str = DEFAULT_SORT,
    order: str = "desc",
    top_k_rows: int = TOP_K_ROWS,
) -> DataFrame:
    """A page of the stored table at any depth, sorted as ``sort_rows`` does.

    The histogram of ``store_slices`` tells in which slice the page lies and how
    many rows come before it: no row is read to count. Only the slice is
    scanned, and of it only the sources and years that have rows there. Inside
    a slice that is still large ``deep_page`` goes on.
    """
    table = read_table(spark, path)
    slices = store_slices(spark, path, slices_path, by)
    merged = _merged(slices)
    present = [r for r in merged if not r.missing]
    sequence = (present if order == "asc" else present[::-1]) + [r for r in merged if r.missing]
    start = (number - 1) * limit
    wanted, skipped = slices_of_page([r.rows for r in sequence], start, limit)
    if not wanted:
        return table.limit(0)
    key, field, ranges, here = F.col(by), table.schema[by], [], []
    for one in [sequence[place] for place in wanted]:
        here.append(F.col("upper").eqNullSafe(literal(one.upper, field)) & (F.col("missing") == one.missing))
        if one.missing:
            ranges.append(key.isNull())
        else:
            # A slice that ends with "not a number" ends with nothing larger.
            to = [key <= literal(one.high, field)] if one.high == one.high else []
            ranges.append(reduce(lambda a, b: a & b, [key >= literal(one.low, field), *to]))
    either = lambda conditions: reduce(lambda a, b: a | b, conditions)
    folders = [r.asDict() for r in slices.filter(either(here)).select("source", "order_year").distinct().collect()]
    return rows_from(table.filter(within_folders(folders)).filter(either(ranges)), start - skipped, limit, by, order, top_k_rows)
