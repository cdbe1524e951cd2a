"""Historical transactions from CSV."""

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.schema import UPLOAD_REQUIRED

REQUIRED = UPLOAD_REQUIRED
BYTE_ORDER_MARK = "\ufeff"

# Cell texts that mean "missing" in the historical files.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip blanks round column names."""
    return df.toDF(*[name.strip() for name in df.columns])


def read_transactions_csv(spark: SparkSession, path, multi_line: bool | None = None) -> DataFrame:
    """All cells as text, missing texts as NULL; types are resolved later.

    Files are aligned by the names in their own headers; a column that a file
    lacks is NULL there. One pass over the lines finds all headers and the files
    with line breaks inside quotes: only those are read whole, one task each,
    others are split between tasks. ``multi_line`` tells what is known of all
    files; then nothing but headers is looked for.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = _about_files(spark, paths, multi_line)
    if not files:  # nothing but blank lines
        return _scan(spark, paths, True if multi_line is None else multi_line)
    groups = {}
    for row in files:
        # A header that goes on behind its first line is left to Spark, file by file.
        name = row["file"] if row["broken_header"] else None
        groups.setdefault((row["header"], row["whole"], name), []).append(row["file"])
    headers = {key: _names(key[0]) if key[2] is None else _scan(spark, own, True).columns for key, own in groups.items()}
    for key, own in groups.items():
        missing = [n for n in REQUIRED if n not in headers[key] and any(n in other for other in headers.values())]
        if missing:
            raise ValueError(f"{own[0]} lacks the columns {missing}, which other files have")
    if len(groups) == 1:
        groups = {key: paths for key in groups}
    parts = [_scan(spark, own, key[1], headers[key]) for key, own in groups.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _about_files(spark: SparkSession, paths: list, multi_line: bool | None) -> list:
    """(file, header: its first line, whole, broken_header) of each file: as many rows as Spark lists files."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        F.when(F.startswith("value", F.lit(BYTE_ORDER_MARK)), F.substr("value", F.lit(2))).otherwise(F.col("value")).alias("line"),
    )
    lines = lines.filter(F.trim("line") != "")
    if multi_line is None:
        # Without escaped quotes and whole quoted cells, a quote at the start of a cell is one that the line does not close.
        rest = F.regexp_replace(F.replace("line", F.lit('""'), F.lit("")), r'(?<=^|,)"[^"]*+"(?=,|\z)', "")
        open_ = F.contains("line", F.lit('"')) & rest.rlike('(?:^|,)"')
        whole = F.bool_or(open_)
    else:
        open_, whole = F.lit(False), F.lit(multi_line)
    found = lines.groupBy("file").agg(F.min_by(F.struct("line", open_.alias("open")), "at").alias("first"), whole.alias("whole"))
    return found.select("file", F.col("first.line").alias("header"), "whole", F.col("first.open").alias("broken_header")).orderBy("file").collect()


def _names(header: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([header]))]


def _scan(spark: SparkSession, paths: list, multi_line: bool, names: list | None = None) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("inferSchema", False)
    )
    if names and all(names) and len({n.lower() for n in names}) == len(names):
        reader = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in names]))
    raw = reader.csv(paths)
    # The header of a file with a byte order mark may carry it in its first name.
    named = trim_headers(raw.toDF(*[name.lstrip(BYTE_ORDER_MARK) for name in raw.columns]))
    return named.select(*[_missing_to_null(name).alias(name) for name in named.columns])


def _missing_to_null(name: str):
    cell = F.col(f"`{name}`")
    # The byte length is at hand; most cells need no look into the list.
    longest = max(len(text) for text in MISSING_TEXTS)
    return F.when((F.octet_length(cell) > longest) | ~cell.isin(MISSING_TEXTS), cell)
