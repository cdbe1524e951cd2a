"""Session set-up and the few helpers that need the session itself."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app_name: str = "tallyline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    Sizes that depend on the cluster (shuffle partitions, memory) are left to
    its configuration or to ``conf``; AQE coalesces and splits partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # State of streams lies on disk, not in the executors' heaps.
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        # Checkpoint files go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder of the session; a folder of our own only on one machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tallyline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared(df: DataFrame) -> DataFrame:
    """Compute once, reliably, for several readers.

    Uses the reliable checkpoint: losing an executor costs a re-read, not a
    recomputation, and the partitions and their row order stay as they are.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Compute once into Parquet in the shared folder; readers read the columns they need.

    Texts that are alike, as invoices are, take a small part of what a ``shared``
    frame takes. All readers made from the frame that comes back see the same partitions.
    """
    return _staged_in(df, scratch_path(df.sparkSession, name))


def _staged_in(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged_meanwhile(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A ``staged`` frame whose files go when the block ends."""
    path = scratch_path(df.sparkSession, name)
    try:
        yield _staged_in(df, path)
    finally:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that run in the block give their shuffle files back as soon as they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32_000_000


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and arrays by their length."""
    size = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(cell), F.lit(0))
        elif not isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DatetimeType, T.DayTimeIntervalType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(cell))), F.lit(0))
    return size


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring rows and bytes; larger frames join by shuffle.

    ``df`` should be cheap to read twice: a stored or ``shared`` frame.
    """
    found = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["n"] <= max_rows and found["size"] <= max_bytes else df
