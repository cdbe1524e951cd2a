"""Row explorer: search, column filters, sorting and paging."""

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions import number_text
from tallyline.session import shared

# Request names that are never column filters, and paging defaults.
RESERVED = ["page", "limit", "search", "sort_by", "sort_order"]
DEFAULT_SORT = "order_date"
DEFAULT_LIMIT = 100


def _cell_text(field: T.StructField) -> Column:
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DoubleType):
        return number_text(cell)
    if isinstance(field.dataType, T.FloatType):
        return number_text(cell.cast("double"))
    return cell.cast("string")


def _matches(field: T.StructField, pattern: str) -> Column:
    # A missing cell has no text and never matches.
    return F.coalesce(_cell_text(field).rlike(f"(?iu){pattern}"), F.lit(False))


def search_any(df: DataFrame, pattern: str | None, columns: list | None = None) -> DataFrame:
    """Rows with any cell that matches the regular expression, ignoring case."""
    if not pattern:
        return df
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not fields:
        return df.limit(0)
    return df.filter(reduce(lambda a, b: a | b, [_matches(f, pattern.lower()) for f in fields]))


def filter_columns(df: DataFrame, patterns: dict) -> DataFrame:
    """Rows that match every column's pattern; unknown columns are ignored."""
    fields = {f.name: f for f in df.schema.fields}
    for name, pattern in patterns.items():
        if name in fields and name not in RESERVED and pattern:
            df = df.filter(_matches(fields[name], pattern))
    return df


def _tie_names(df: DataFrame, by: str | None) -> list:
    """The columns behind the sort column: the id first, if there is one, and
    long documents last, as they are compared only where all else ties."""
    rest = [name for name in df.columns if name != by]
    return sorted(rest, key=lambda name: (name != "row_id", name == "invoice_json"))


def _sort_keys(df: DataFrame, by: str | None, order: str) -> list:
    """The sort column, then every other sortable column, so no two different
    rows tie and pages never overlap."""
    keys = []
    if by in df.columns:
        keys.append(F.asc_nulls_last(F.col(f"`{by}`")) if order == "asc" else F.desc_nulls_last(F.col(f"`{by}`")))
    return keys + [F.asc_nulls_last(F.col(f"`{name}`")) for name in _tie_names(df, by)]


def sort_rows(df: DataFrame, by: str | None = DEFAULT_SORT, order: str = "desc") -> DataFrame:
    """Sort by any column; anything but "asc" is descending; unknown: no sort."""
    return df.orderBy(*_sort_keys(df, by, order)) if by in df.columns else df


def page(df: DataFrame, number: int = 1, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page of a sorted frame, planned as top-k. For pages near the start;
    use ``page_after`` or ``deep_page`` far down."""
    return df.offset((number - 1) * limit).limit(limit)


def literal(value, field: T.StructField) -> Column:
    """A collected value as a literal; dates go as text, past any time zone."""
    return F.lit(str(value) if isinstance(value, datetime.date) else value).cast(field.dataType)


def page_after(
    df: DataFrame, last_row: dict, by: str, order: str = "desc", limit: int = DEFAULT_LIMIT, shown: int | None = None
) -> DataFrame:
    """The page behind ``last_row``, at any depth.

    Rows are compared as ``sort_rows`` orders them, missing values last, by all
    columns that ``last_row`` names: the sort column and the id where ids are
    unique and never missing, else the whole row. Rows alike in every column
    cannot be told apart; if pages may end among such, ``shown`` says how many
    rows like the last one the pages so far had. The bound is a filter, so it
    reaches the scan and no earlier page is read again.
    """
    if by not in last_row:
        raise ValueError(f"last_row must name the sort column {by!r}")
    named = [by, *[name for name in _tie_names(df, by) if name in last_row]]
    if named[1:] != _tie_names(df, by) and last_row.get("row_id") is None:
        raise ValueError("give the whole last row: it has no id of its own")
    behind, same = F.lit(False), F.lit(True)
    for name in named:
        key, value = F.col(f"`{name}`"), last_row[name]
        if value is None:
            same = same & key.isNull()
            continue
        value = literal(value, df.schema[name])
        descending = name == by and order != "asc"
        further = key < value if descending else key > value
        behind = behind | (same & (further | key.isNull()))
        same = same & F.coalesce(key == value, F.lit(False))
    rows = df.filter(behind if shown is None else behind | same)
    return sort_rows(rows, by, order).offset(shown or 0).limit(limit)


# Slices a sort column is cut into to find a deep page, and the number of rows
# up to which top-k is the way to skip inside a slice.
SLICES = 64
TEXT_SAMPLE = 4096
TOP_K_ROWS = 100_000


def cut_values(df: DataFrame, by: str, slices: int = SLICES) -> list:
    """Values that cut a column into slices of about as many rows each, in order.

    Quantiles of the column; of texts those of a sample of the different values.
    """
    if isinstance(df.schema[by].dataType, T.StringType):
        place = F.xxhash64(by)
        some = df.filter(F.col(by).isNotNull()).select(by, place.alias("_place")).distinct().orderBy("_place").limit(TEXT_SAMPLE)
        values = sorted((row[by] for row in some.collect()), key=lambda value: value.encode())
        cuts = values[len(values) // slices :: max(1, len(values) // slices)]
    else:
        cuts = df.agg(F.percentile_approx(by, [i / slices for i in range(1, slices)])).first()[0]
    return sorted({c for c in cuts or [] if c == c}, key=lambda c: c.encode() if isinstance(c, str) else c)


def slices_of_page(counts: list, start: int, limit: int) -> tuple:
    """(places of the slices that hold the page, rows before the first of them), from the rows of each slice in order."""
    before, wanted, skipped = 0, [], 0
    for place, count in enumerate(counts):
        after = before + count
        if after <= start:
            skipped = after
        elif before < start + limit:
            wanted.append(place)
        before = after
    return wanted, skipped


def is_sliceable(df: DataFrame, by: str | None) -> bool:
    kinds = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
    return by in df.columns and isinstance(df.schema[by].dataType, kinds)


def _slice_of(df: DataFrame, start: int, by: str, order: str, limit: int) -> tuple:
    """(rows of the value range that holds the page, rows before that range).

    Two narrow passes: values to cut at, then exact counts between them. A bad
    cut makes slices uneven, never wrong.
    """
    edges = [literal(v, df.schema[by]) for v in cut_values(df, by)]
    if not edges:
        return df, 0
    key = F.col(by)
    number = reduce(lambda a, b: a + b, [(key > edge).cast("int") for edge in edges])
    counts = {r["slice"]: r["count"] for r in df.groupBy(number.alias("slice")).count().collect()}
    slices = range(len(edges) + 1)
    sequence = [*(slices if order == "asc" else reversed(slices)), None]
    wanted, skipped = slices_of_page([counts.get(one, 0) for one in sequence], start, limit)
    ranges = []
    for one in [sequence[place] for place in wanted]:
        if one is None:
            ranges.append(key.isNull())
        else:
            low = [key > edges[one - 1]] if one else []
            high = [key <= edges[one]] if one < len(edges) else []
            ranges.append(reduce(lambda a, b: a & b, low + high))
    if not ranges:
        return df.limit(0), 0
    return df.filter(reduce(lambda a, b: a | b, ranges)), skipped


def deep_page(
    df: DataFrame,
    number: int,
    limit: int = DEFAULT_LIMIT,
    by: str | None = DEFAULT_SORT,
    order: str = "desc",
    top_k_rows: int = TOP_K_ROWS,
) -> DataFrame:
    """A page at any depth without sending all earlier rows through one task.

    Counting finds the value range the page lies in, and only its rows are
    read. If still many of them come before the page (one value may hold a
    third of all rows), they are range-sorted and kept; counts per partition
    then tell where the page is. Without a sort column the order of all
    columns holds.
    """
    return rows_from(df, (number - 1) * limit, limit, by, order, top_k_rows)


def rows_from(df: DataFrame, start: int, limit: int, by: str | None, order: str, top_k_rows: int = TOP_K_ROWS) -> DataFrame:
    """``limit`` rows behind the first ``start``, as ``deep_page`` finds them."""
    if is_sliceable(df, by) and start + limit > top_k_rows:
        df, skipped = _slice_of(df, start, by, order, limit)
        start -= skipped
    keys = _sort_keys(df, by, order)
    if start + limit <= top_k_rows:
        return df.orderBy(*keys).offset(start).limit(limit)
    return _sorted_rows(df, keys, start, limit)


def _sorted_rows(df: DataFrame, keys: list, start: int, limit: int) -> DataFrame:
    ordered = shared(df.orderBy(*keys))
    placed = ordered.withColumn("_at", F.monotonically_increasing_id())
    partition = F.shiftrightunsigned("_at", 33)
    counts = placed.groupBy(partition.alias("part")).count().orderBy("part").collect()
    seen, wanted = 0, []
    for row in counts:  # as many rows as there are partitions
        low, high = max(start - seen, 0), min(start + limit - seen, row["count"])
        if low < high:
            first = row["part"] << 33
            wanted.append(F.col("_at").between(first + low, first + high - 1))
        seen += row["count"]
    if not wanted:
        return df.sparkSession.createDataFrame([], df.schema)
    return placed.filter(reduce(lambda a, b: a | b, wanted)).orderBy("_at").drop("_at")


def page_info(df: DataFrame, limit: int = DEFAULT_LIMIT, compat: str | None = None) -> DataFrame:
    """Number of rows and pages. ``compat="literal"`` counts one page more on
    exact multiples of ``limit``."""
    total = F.count("*").alias("total")
    if limit <= 0:
        pages = F.lit(1)
    elif compat == "literal":
        pages = F.floor(F.col("total") / limit) + 1
    else:
        pages = F.ceil(F.col("total") / limit)
    return df.agg(total).select("total", pages.cast("long").alias("pages"))


def explore(
    tx: DataFrame,
    number: int = 1,
    limit: int = DEFAULT_LIMIT,
    search: str | None = None,
    sort_by: str | None = DEFAULT_SORT,
    sort_order: str = "desc",
    filters: dict | None = None,
    top_k_rows: int = TOP_K_ROWS,
) -> tuple:
    """(rows of the page, counts) for one explorer request.

    Both are lazy; who needs only the rows pays only for them. A page far down
    is found by counting first, so no task ever gets all rows before it.
    Infinite numbers, which records cannot hold, are shown as 0.
    """
    found = filter_columns(search_any(tx, search), filters or {})
    rows = deep_page(found, number, limit, sort_by, sort_order, top_k_rows)
    shown = {
        f.name: F.when(F.abs(F.col(f.name)) == float("inf"), 0.0).otherwise(F.col(f.name))
        for f in tx.schema.fields
        if isinstance(f.dataType, T.DoubleType)
    }
    return rows.withColumns(shown), page_info(found, limit)
