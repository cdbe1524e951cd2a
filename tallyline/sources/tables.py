"""Stored tables: plain Parquet folders, by version, batch and order year.

``<table>/version=<n>/stored_batch=<b>/order_year=<y>/``: a batch is written into a
hidden folder, its rows are counted while they are written, and only if all are
there the folder gets its name. The newest version with a batch counts, so
readers see a batch, and a replaced dataset, whole or not at all. A batch's name
tells its number, the last row id so far, whether its invoice keys are stored
too, and what the writer called it; so one listing tells all there is to know.

Deleting and rebuilding rewrite the year folders that change and no others, by
Spark's dynamic partition overwrite. Each table has one writer at a time: a
second one is refused if it finds its batch number taken, and a reader that
meets a rewrite may have to read again.
"""

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators.checks import require_columns
from tallyline.operators.duplicates import with_bucket
from tallyline.operators.maintain import id_frame
from tallyline.schema import INVOICE_LINES
from tallyline.session import broadcast_if_small, shared, staged

#: How Spark names the folder of a missing year.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Batch(NamedTuple):
    folder: str
    number: int
    last_row_id: int
    keyed: bool
    name: str


class State(NamedTuple):
    """The version that counts (0 before the first write) and its batches, oldest first."""

    version: int
    batches: list

    def last_row_id(self) -> int:
        return max((b.last_row_id for b in self.batches), default=0)


def _files(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Spark's own writers see them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    fs, target = _files(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(target) or []]


def _files_in(spark: SparkSession, folder: str) -> set[str]:
    fs, target = _files(spark, folder)
    return {status.getPath().getName() for status in fs.listStatus(target)} if fs.exists(target) else set()


def _remove(spark: SparkSession, path: str) -> None:
    fs, target = _files(spark, path)
    fs.delete(target, True)


def rename(spark: SparkSession, path: str, new: str) -> bool:
    """Give a folder another name; whether that could be done."""
    fs, target = _files(spark, path)
    return fs.rename(target, _files(spark, new)[1])


def _quoted(name: str | None) -> str:
    return quote(name or "", safe="").replace("%", "~")


def _state(spark: SparkSession, path: str) -> State:
    found = {}
    for done in _listed(spark, f"{path}/version=*/stored_batch=*/_SUCCESS"):
        version, batch = re.search(r"/version=(\d+)/stored_batch=([^/]+)/_SUCCESS$", done).groups()
        number, last, keyed, name = re.fullmatch(r"b(\d+)-(\d+)-([ku])-(.*)", batch).groups()
        found.setdefault(int(version), []).append(Batch(batch, int(number), int(last), keyed == "k", name))
    version = max(found, default=0)
    return State(version, sorted(found.get(version, []), key=lambda b: b.number))


def stored_batches(spark: SparkSession, path: str) -> list[Batch]:
    """What has been stored, oldest first."""
    return _state(spark, path).batches


def _root(path: str, version: int) -> str:
    return f"{path}/version={version}"


# Columns -------------------------------------------------------------------------


def _columns(spark: SparkSession, path: str, version: int) -> tuple[T.StructType, list[str]]:
    """(columns, those that name folders) of a version: what the newest of its notes says."""
    notes = sorted(_listed(spark, f"{path}/columns/v{version}-*/_SUCCESS"), key=lambda n: int(re.search(r"-(\d+)/_SUCCESS$", n)[1]))
    if not notes:
        return T.StructType([]), []
    note = json.loads(spark.read.text(notes[-1].removesuffix("/_SUCCESS")).first().value)
    return T.StructType.fromJson(note["columns"]), note["by"]


def _note_columns(spark: SparkSession, path: str, version: int, rows: DataFrame, by: list[str]) -> None:
    """Note the columns of new rows beside those known, before the rows are there."""
    known, _ = _columns(spark, path, version)
    fields = {f.name: f for f in known.fields} | {f.name: f for f in rows.schema.fields}
    columns = T.StructType(list(fields.values()))
    if columns != known:
        number = len(_listed(spark, f"{path}/columns/v{version}-*"))
        note = json.dumps({"columns": columns.jsonValue(), "by": by})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{path}/columns/v{version}-{number}")


def _rows(spark: SparkSession, path: str, state: State, batches: list | None = None) -> DataFrame:
    """Rows of some batches with the batch they lie in; no file is opened to plan."""
    columns, by = _columns(spark, path, state.version)
    own = [f for f in columns.fields if f.name not in by]
    folders = [T.StructField("stored_batch", T.StringType()), *[columns[name] for name in by]]
    root = _root(path, state.version)
    chosen = [f"{root}/stored_batch={b.folder}" for b in (state.batches if batches is None else batches)]
    return spark.read.option("basePath", root).schema(T.StructType([*own, *folders])).parquet(*chosen)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Current rows. ``schema`` is what a table without any batch reads as."""
    state = _state(spark, path)
    if not state.version:
        if schema is None:
            raise ValueError(f"no data has been stored in {path}")
        return spark.createDataFrame([], schema)
    return _rows(spark, path, state).drop("stored_batch")


def read_invoice_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stored invoice lines with their ids; empty before the first intake."""
    return read_table(spark, path, T.StructType([T.StructField("row_id", T.LongType()), *INVOICE_LINES.fields]))


def read_jdbc_lines(spark: SparkSession, url: str, table: str, bounds: tuple, partitions: int, **options) -> DataFrame:
    """Invoice lines still in a database, read in parallel by id range."""
    lower, upper = bounds
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", lowerBound=lower, upperBound=upper)
        .options(numPartitions=partitions, **options)
        .load()
        .withColumnRenamed("id", "row_id")
    )


def stored_last_year(spark: SparkSession, path: str) -> int | None:
    """Year of the newest stored order, from the names of the folders alone.

    Analyses that take a ``year`` then prune files while they are planned.
    """
    return max((f["order_year"] for f in stored_folders(spark, path) if f.get("order_year")), default=None)


# Writing -------------------------------------------------------------------------


def number_rows(df: DataFrame, start: int, name: str = "row_id", fixed: bool = False, by_file: bool = False) -> tuple:
    """(rows with consecutive ids from ``start``, how many), no row in one task.

    Rows are counted per partition first, then each partition numbers its own.
    Both passes must see the same partitions, so ``df`` is kept in the shared
    folder first unless it is ``fixed``: a ``shared`` frame, or made from one
    without a shuffle (a ``staged`` frame too, as long as all comes from one reader).
    ``by_file`` numbers the rows of a reader of Parquet files by their place in
    each file instead, which no cut of the files into partitions changes.
    """
    df = df if fixed or by_file else shared(df)
    spark = df.sparkSession
    if by_file:
        placed = df.select("*", F.col("_metadata.row_index").alias("_at"), F.col("_metadata.file_name").alias("_part"))
        partition, within = F.col("_part"), F.col("_at")
    else:
        placed = df.withColumn("_at", F.monotonically_increasing_id())
        partition, within = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(partition.alias("_part")).count().orderBy("_part").collect()
    offsets, following = [], start
    for row in counts:  # as many rows as df has partitions or files
        offsets.append((row["_part"], following))
        following += row["count"]
    offsets = spark.createDataFrame(offsets, f"_part {'string' if by_file else 'long'}, _start long")
    numbered = (
        placed.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .select((F.col("_start") + within).alias(name), *df.columns)
    )
    return numbered, following - start


def _write(df: DataFrame, path: str, by: list[str], mode: str = "error") -> None:
    """Write by folders, each task the rows it has: nothing is shuffled, and a hot year is split over files."""
    if by:
        # Folders first, as the writer wants it; then dates, for row-group statistics.
        df = df.sortWithinPartitions(*by, *[c for c in ("order_date",) if c in df.columns])
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _write_counted(df: DataFrame, path: str, by: list[str]) -> dict:
    """Write; how many rows and the last row id, seen in the same pass."""
    seen = Observation()
    last = F.max(F.col("row_id").try_cast("long")) if "row_id" in df.columns else F.lit(None).cast("long")
    facts = [F.count(F.lit(1)).alias("rows"), F.coalesce(last, F.lit(0)).alias("last")]
    _write(df.observe(seen, *facts), path, by)
    try:
        return seen.get
    except Py4JJavaError:  # of a plan found to be empty while it ran, nothing is seen
        return df.sparkSession.read.schema(df.schema).parquet(path).agg(*facts).first().asDict()


def _with_year(df: DataFrame) -> tuple[DataFrame, list[str]]:
    return (df.withColumn("order_year", F.year("order_date")), ["order_year"]) if "order_date" in df.columns else (df, [])


def _add_batch(
    df: DataFrame, path: str, version: int, number: int, by: list[str], last: int = 0, keyed: bool = False, name: str | None = None, expected: int | None = None,
    settle: Callable[[DataFrame], DataFrame | None] | None = None,
) -> int:
    """Write a batch aside, check its size, then give it its name; its rows.

    ``settle`` gets the rows written aside and returns what to store in their stead, or None.
    """
    spark, root = df.sparkSession, _root(path, version)
    _note_columns(spark, path, version, df, by)
    aside = f"{root}/_writing-{uuid.uuid4().hex}"
    seen = _write_counted(df, aside, by)
    if settle is not None and (settled := settle(spark.read.schema(df.schema).parquet(aside))) is not None:
        first, aside = aside, f"{root}/_writing-{uuid.uuid4().hex}"
        seen = _write_counted(settled, aside, by)
        _remove(spark, first)
    if expected is not None and seen["rows"] != expected:
        _remove(spark, aside)
        raise RuntimeError(f"{seen['rows']} rows were written to {path} where {expected} were counted; nothing was stored")
    if _listed(spark, f"{root}/stored_batch=b{number:07d}-*"):
        _remove(spark, aside)
        raise RuntimeError(f"another writer has changed {path} meanwhile; nothing was stored")
    folder = f"b{number:07d}-{max(last, seen['last'])}-{'k' if keyed else 'u'}-{_quoted(name)}"
    if not rename(spark, aside, f"{root}/stored_batch={folder}"):
        raise RuntimeError(f"{aside} could not be renamed; nothing was stored")
    return seen["rows"]


def append_invoice_lines(df: DataFrame, path: str, part: str | None = None, stable: bool = False, keys: DataFrame | None = None) -> int:
    """Add lines as one batch and number them; returns how many were added.

    A batch that names its ``part`` is stored once: repeating it (as a stream
    does after a failure) adds nothing. ``stable`` tells that ``df`` is
    ``fixed`` in the sense of ``number_rows``. ``keys`` are the ``order_id`` of all
    the lines; they are stored first, and count once the batch does.
    """
    spark = df.sparkSession
    state = _state(spark, path)
    if part is not None and any(b.name == _quoted(part) for b in state.batches):
        return 0
    version, number = state.version or 1, max((b.number for b in state.batches), default=0) + 1
    aside = f"{_root(path, version)}/_writing-{uuid.uuid4().hex}"
    if not stable:
        # Rows that would be computed anew lie packed beside the table until the batch is there.
        _write(df, aside, [])
        df = spark.read.schema(df.schema).parquet(aside)
    try:
        numbered, count = number_rows(df, 1 + state.last_row_id(), fixed=stable, by_file=not stable)
        if count == 0:
            return 0
        if keys is not None:
            own = keys.select("order_id").distinct().withColumn("batch_number", F.lit(number))
            own = with_bucket(own).hint("rebalance", "bucket").sortWithinPartitions("bucket", "order_id")
            own.write.mode("append").partitionBy("bucket").parquet(_keys(path, version))
        rows, by = _with_year(numbered)
        return _add_batch(rows, path, version, number, by, state.last_row_id(), keys is not None, part, count)
    finally:
        if not stable:
            _remove(spark, aside)


def replace_dataset(
    df: DataFrame, path: str, required: list, by: list[str] = (), settle: Callable[[DataFrame], DataFrame | None] | None = None
) -> int:
    """Check the columns, then make ``df`` the whole dataset; returns its size.

    It becomes a new version; the last one before stays for those who read it.
    ``by`` names columns whose values become folders above the years. ``settle``
    may look at the rows as they are written and give others for them.
    """
    require_columns(df, required)
    spark = df.sparkSession
    state = _state(spark, path)
    rows, year = _with_year(df)
    written = _add_batch(rows, path, state.version + 1, 1, [*by, *year], state.last_row_id(), settle=settle)
    for old in range(1, state.version):
        for folder in (_root(path, old), _keys(path, old)):
            _remove(spark, folder)
    return written


def stored_folders(spark: SparkSession, path: str, *columns: str) -> list[dict]:
    """The folders that hold rows, by what names them (or some of it), from their names alone."""
    state = _state(spark, path)
    types, by = _columns(spark, path, state.version)
    found = {}
    for name in _listed(spark, f"{_root(path, state.version)}/stored_batch=*" + "/*=*" * len(by)):
        parts = dict(p.split("=", 1) for p in name.split("/")[-1 - len(by) :])
        values = {c: None if v == NO_VALUE else v for c, v in parts.items()}
        values = {c: int(v) if v is not None and c in by and types[c].dataType == T.IntegerType() else v for c, v in values.items()}
        found[tuple(values.items())] = values
    wanted = [{c: f[c] for c in columns or f} for f in found.values()]
    return [f for i, f in enumerate(wanted) if f not in wanted[:i]]


def folder_marks(spark: SparkSession, path: str) -> list[tuple[dict, str]]:
    """(folder, mark) of each folder with rows; the mark changes whenever its files do. No file is opened."""
    state = _state(spark, path)
    _, by = _columns(spark, path, state.version)
    names = _listed(spark, f"{_root(path, state.version)}/stored_batch=*" + "/*=*" * len(by) + "/*.parquet")
    files = {}
    for name in names:
        folder, file = name.rsplit("/", 1)
        files.setdefault(tuple(folder.split("/")[-1 - len(by) :]), []).append(file)
    found = {tuple(f"{c}={NO_VALUE if v is None else v}" for c, v in f.items()): f for f in stored_folders(spark, path)}
    return [(found[key], hashlib.md5("/".join(sorted(own)).encode()).hexdigest()) for key, own in files.items()]


def overwrite_folders(spark: SparkSession, path: str, rows: DataFrame, folders: list[dict]) -> None:
    """Make ``rows`` all there is in some folders (values of ``stored_batch`` and of the columns that name folders).

    Other folders keep their files; a folder for which there is no row goes.
    ``rows`` may come from the table itself: its files go when all are written.
    """
    version = _state(spark, path).version
    _, by = _columns(spark, path, version)
    _note_columns(spark, path, version, rows.drop("stored_batch"), by)
    _overwrite(rows, _root(path, version), ["stored_batch", *by], folders)


def _overwrite(rows: DataFrame, root: str, by: list[str], folders: list[dict]) -> None:
    spark = rows.sparkSession
    paths = [f"{root}/" + "/".join(f"{c}={NO_VALUE if folder[c] is None else folder[c]}" for c in by) for folder in folders]
    before = {path: _files_in(spark, path) for path in paths}
    _write(rows, root, by, "overwrite")
    for path, files in before.items():
        # A folder that got a row has new files only.
        if files & _files_in(spark, path):
            _remove(spark, path)


def delete_rows(spark: SparkSession, path: str, ids) -> int:
    """Delete by id; returns how many of the ids were there.

    Only the year folders that hold one of them are rewritten.
    """
    wanted = broadcast_if_small(id_frame(spark, ids))
    state = _state(spark, path)
    if not state.version:
        raise ValueError(f"no data has been stored in {path}")
    rows = _rows(spark, path, state)
    _, by = _columns(spark, path, state.version)
    keyed = [b.number for b in state.batches if b.keyed]
    about = ["row_id", "stored_batch", *by, *(["order_id"] if keyed else [])]
    hits = staged(rows.select(*about).join(wanted, "row_id", "left_semi"), "deleted")
    folders = [row.asDict() for row in hits.select("stored_batch", *by).distinct().collect()]
    if not folders:
        return 0
    touched = rows.filter(within_folders(folders))
    overwrite_folders(spark, path, touched.join(wanted, "row_id", "left_anti"), folders)
    if keyed:
        _forget_keys(spark, path, state.version, hits, _rows(spark, path, state).filter(within_folders(folders)))
    return hits.count()


def within_folders(folders: list[dict]) -> Column:
    """Condition on the columns that name folders; Spark opens no others."""
    each = [reduce(Column.__and__, [F.col(name).eqNullSafe(F.lit(value)) for name, value in f.items()]) for f in folders]
    return reduce(Column.__or__, each)


# Keys of stored invoices ---------------------------------------------------------


def _keys(path: str, version: int) -> str:
    return f"{path}/keys/version={version}"


def _stored_keys(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("order_id string, batch_number int, bucket int").parquet(_keys(path, version))


def read_invoice_keys(spark: SparkSession, path: str) -> DataFrame:
    """(order_id, bucket) of all stored invoices, from the narrow key table.

    Batches stored without keys give those of their lines. Who joins by
    ``bucket`` too reads only the folders of the keys asked for.
    """
    state = _state(spark, path)
    keyed, others = ([b for b in state.batches if b.keyed is k] for k in (True, False))
    found = spark.createDataFrame([], "order_id string, bucket int")
    if keyed:
        found = _stored_keys(spark, path, state.version).filter(F.col("batch_number").isin([b.number for b in keyed])).select("order_id", "bucket")
    if others and "order_id" in _columns(spark, path, state.version)[0].names:
        lines = with_bucket(_rows(spark, path, state, others).select("order_id"))
        found = found.unionByName(lines) if keyed else lines
    return found


def _forget_keys(spark: SparkSession, path: str, version: int, deleted: DataFrame, left: DataFrame) -> None:
    """Take out the keys of invoices without any line left, in the folders that hold one."""
    number = F.regexp_extract("stored_batch", "^b([0-9]+)-", 1).cast("int").alias("batch_number")
    gone = deleted.select("order_id", number).distinct()
    gone = staged(with_bucket(gone.join(left.select("order_id", number), ["order_id", "batch_number"], "left_anti")), "gone-keys")
    folders = [row.asDict() for row in gone.select("bucket").distinct().collect()]
    if folders:
        kept = _stored_keys(spark, path, version).filter(F.col("bucket").isin([f["bucket"] for f in folders]))
        kept = kept.join(broadcast_if_small(gone.drop("bucket")), ["order_id", "batch_number"], "left_anti")
        _overwrite(kept, _keys(path, version), ["bucket"], folders)
