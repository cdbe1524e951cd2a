"""Duplicate invoices and the intake report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import broadcast_if_small, staged

IDENTITY = ["archive", "member_no", "member"]
#: Folders that the keys of stored invoices are spread over.
KEY_BUCKETS = 64


def with_bucket(df: DataFrame, key: str = "order_id") -> DataFrame:
    """The folder that a key's row lies in, as a column."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int"))


def document_keys(documents: DataFrame) -> DataFrame:
    """What duplicate check and report need of documents: no JSON, no lines but their number."""
    return documents.select(*IDENTITY, "order_id", "has_uuid", "problem", F.size("lines").alias("lines"))


def find_duplicates(documents: DataFrame, existing: DataFrame, key: str = "order_id", literal: bool = False) -> DataFrame:
    """Documents (archive, member_no, member) whose invoice is stored already
    or comes earlier in the same batch.

    Invoices without a stamp share a placeholder key and are never duplicates,
    unless ``literal``. The first document per key is a minimum, so one key
    with very many copies is merged from partial results; every join is by
    keys that are unique on one side. If ``existing`` has the ``bucket`` of its
    keys, only the folders of those that this batch asks for are read.
    """
    usable = documents.filter(F.col("problem").isNull())
    if not literal:
        usable = usable.filter("has_uuid")
    ids = usable.select(*IDENTITY, key)
    firsts = staged(ids.groupBy(key).agg(F.min(F.struct(*IDENTITY)).alias("first")), "first-documents")
    # Only stored keys this batch asks for; a small batch is sent to the scan.
    asked, on = firsts.select(key), [key]
    if "bucket" in existing.columns:
        # A join whose other side is filtered prunes the folders at run time.
        asked, on = with_bucket(asked, key).filter("bucket >= 0"), ["bucket", key]
    stored = existing.select(*on).join(broadcast_if_small(asked), on, "left_semi").select(key).distinct()
    accepted = firsts.join(stored, key, "left_anti").select("first.*")
    return ids.join(accepted, IDENTITY, "left_anti").select(*IDENTITY)


def suppress_duplicates(
    documents: DataFrame, existing: DataFrame, key: str = "order_id", literal: bool = False
) -> tuple:
    """(documents that are new, duplicates). Pass a ``staged`` document frame, of
    which the check reads only the keys (a ``shared`` one is read whole); it
    comes back as it is if there are no duplicates."""
    duplicates = staged(find_duplicates(documents, existing, key, literal), "duplicates")
    if duplicates.isEmpty():
        return documents, duplicates
    return documents.join(broadcast_if_small(duplicates), IDENTITY, "left_anti"), duplicates


def ingest_report(documents: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: lines to insert, invoices skipped, documents held back."""
    skipped = duplicates.withColumn("_skipped", F.lit(True))
    usable = F.col("problem").isNull()
    # Counts only: of a staged frame neither the JSON texts nor the fields of lines are read.
    counted = "lines" if dict(documents.dtypes)["lines"] == "int" else F.size("lines").alias("lines")
    narrow = documents.select(*IDENTITY, "problem", counted)
    outcome = narrow.join(broadcast_if_small(skipped), IDENTITY, "left")
    new = usable & F.col("_skipped").isNull()
    held = F.col("problem").isNotNull() & (F.col("problem") != "no lines")
    return outcome.agg(
        F.coalesce(F.sum(F.when(new, F.col("lines"))), F.lit(0)).cast("long").alias("records_inserted"),
        F.count(F.when(usable & F.col("_skipped"), 1)).alias("invoices_skipped"),
        F.count(F.when(held, 1)).alias("documents_held"),
    )
