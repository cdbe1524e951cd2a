"""Maintenance: deletions, annotations, change log, listings."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.checks import require_columns
from tallyline.session import broadcast_if_small, shared

# What a page without annotation shows.
NO_ANNOTATION = "Sin comentarios estratégicos registrados aún."
NO_AUTHOR = "Sistema"

# Actions and texts of the change log.
CHANGED, DELETED = "MODIFICACION_GOBERNANZA", "ELIMINACION_USUARIO"
DELETED_DETAILS = "Usuario eliminado permanentemente por el administrador."


def id_frame(spark: SparkSession, ids) -> DataFrame:
    """Distinct ids, computed once, from a list or a frame; none is an error."""
    if isinstance(ids, DataFrame):
        wanted = shared(ids.select("row_id").distinct())
        if wanted.isEmpty():
            raise ValueError("no ids given")
        return wanted
    if not ids:
        raise ValueError("no ids given")
    return spark.createDataFrame([(int(i),) for i in set(ids)], "row_id long")


def delete_by_ids(df: DataFrame, ids) -> tuple:
    """(rows kept, one row with ``deleted_count``)."""
    wanted = broadcast_if_small(id_frame(df.sparkSession, ids))
    kept = df.join(wanted, "row_id", "left_anti")
    found = df.join(wanted, "row_id", "left_semi").agg(F.count("*").alias("deleted_count"))
    return kept, found


def upsert_annotations(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The newest text per page.

    A maximum per page, not a ranking: partial results are merged, so a page
    with very many versions is no hot task.
    """
    both = current.unionByName(changes)
    others = [name for name in both.columns if name != "page_name"]
    newest = F.max_by(F.struct(*others), F.struct("updated_at", *[n for n in others if n != "updated_at"]))
    return both.groupBy("page_name").agg(newest.alias("_newest")).select(
        "page_name", *[F.col("_newest")[name].alias(name) for name in others]
    )


def latest_annotation(annotations: DataFrame, pages) -> DataFrame:
    """Text and author for each requested page, or the default text."""
    spark = annotations.sparkSession
    if not isinstance(pages, DataFrame):
        names = [pages] if isinstance(pages, str) else list(pages)
        pages = spark.createDataFrame([(name,) for name in names], "page_name string")
    found = pages.join(annotations, "page_name", "left")
    missing = F.col("content").isNull()
    return found.select(
        "page_name",
        F.when(missing, NO_ANNOTATION).otherwise(F.col("content")).alias("content"),
        F.when(missing, NO_AUTHOR).otherwise(F.col("updated_by_name")).alias("updated_by_name"),
    )


def newest_first(df: DataFrame, ts_col: str, *tie_keys: str) -> DataFrame:
    """Listing by time, newest first."""
    return df.orderBy(F.desc_nulls_last(ts_col), *tie_keys)


def snapshot_changes(
    old: DataFrame, new: DataFrame, key: str, columns: dict, carry: list = ()
) -> DataFrame:
    """Change-log rows between two snapshots of a keyed table.

    ``columns`` maps a column to its label. A key in both snapshots with any
    difference gives "Status: old->new | Role: old->new", with all labels; a
    key that is gone gives a deletion row. New keys are no change. ``carry``
    names columns to copy along, from the new row if there is one.
    """
    require_columns(old, [key, *columns, *carry])
    require_columns(new, [key, *columns, *carry])
    names = [*columns, *carry]
    before = old.select(key, F.struct(*names).alias("_old"))
    after = new.select(key, F.struct(*names).alias("_new"))
    both = before.join(after, key, "left")

    def was(name) -> Column:
        return F.col("_old")[name]

    def now(name) -> Column:
        return F.col("_new")[name]

    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    gone = F.col("_new").isNull()
    differs = F.lit(False)
    for name in columns:
        differs = differs | ~was(name).eqNullSafe(now(name))
    details = F.concat_ws(
        " | ",
        *[F.concat(F.lit(f"{label}: "), shown(was(n)), F.lit("->"), shown(now(n))) for n, label in columns.items()],
    )
    return both.filter(gone | differs).select(
        key,
        *[F.when(gone, was(name)).otherwise(now(name)).alias(name) for name in carry],
        F.when(gone, DELETED).otherwise(CHANGED).alias("action"),
        F.when(gone, DELETED_DETAILS).otherwise(details).alias("details"),
    )


def append_change_log(
    changes: DataFrame, path: str, admin_id: str, admin_name: str, key: str = "id", email: str = "email"
) -> None:
    """Add changes to the log, which is only ever appended to."""
    entries = changes.select(
        F.lit(admin_id).alias("admin_id"),
        F.lit(admin_name).alias("admin_name"),
        F.col(key).cast("string").alias("target_user_id"),
        F.col(email).cast("string").alias("target_user_email"),
        "action",
        "details",
        F.current_timestamp().alias("timestamp"),
    )
    entries.write.mode("append").parquet(path)
