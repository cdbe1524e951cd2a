"""From the sources to the stored canonical table."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators.canonical import canonical_csv, canonical_invoices, consolidate
from tallyline.operators.checks import require_columns
from tallyline.operators.maintain import id_frame, latest_annotation, upsert_annotations
from tallyline.operators.partials import order_partials
from tallyline.schema import UPLOAD_REQUIRED
from tallyline.session import broadcast_if_small, staged
from tallyline.sources.csv_files import read_transactions_csv
from tallyline.sources.tables import (
    delete_rows,
    folder_marks,
    overwrite_folders,
    read_invoice_lines,
    read_table,
    replace_dataset,
    stored_batches,
    stored_folders,
    within_folders,
)

#: Keys below are source ids, keys from here on are made of contents.
CONTENT_KEYS = 1 << 62


def load_transactions(
    spark: SparkSession,
    csv_path=None,
    invoices_path: str | None = None,
    date_format: str = "M/d/yyyy",
    rate_unit: str = "percent",
    rate: str = "amount",
) -> DataFrame:
    """Canonical rows of whichever sources are given, in one frame."""
    csv = xml = None
    if csv_path is not None:
        csv = canonical_csv(read_transactions_csv(spark, csv_path), date_format, rate_unit)
    if invoices_path is not None:
        xml = canonical_invoices(read_invoice_lines(spark, invoices_path), rate)
    return consolidate(csv, xml)


def with_stable_ids(tx: DataFrame, scanned: bool = False) -> DataFrame:
    """Rows with an id that follows from source and content alone, each its own.

    Row n of a source is 2n, of the invoices 2n + 1. Rows without a source id,
    and all rows that would share an id, get one from their content (large and
    even): of equal rows the k-th gets the hash of content and k, so a file that
    is read again gives the same ids, however it is split. Ids are compared in
    full until none is left twice. ``source_id`` keeps the source's own id.
    ``scanned`` tells that ``tx`` only reads stored files, so that it is not
    staged before its ids are looked at.
    """
    rows, content = _with_first_ids(tx)
    if scanned and _repeated_ids(rows).isEmpty():
        return rows
    rows = staged(rows, "transactions")
    settled = _settled_ids(rows, content)
    return rows if settled is None else settled


def _with_first_ids(tx: DataFrame) -> tuple[DataFrame, list[str]]:
    """(rows with the id each would have alone, the columns that are their content)."""
    own = F.col("row_id") if "row_id" in tx.columns else F.lit(None)
    known = own if "source_id" not in tx.columns else F.coalesce("source_id", own)
    tx = tx.withColumn("source_id", known.cast("long")).drop("row_id")
    content = sorted(tx.columns)
    is_invoice = (F.col("source") == "xml") if "source" in tx.columns else F.lit(False)
    direct = F.col("source_id").between(0, (CONTENT_KEYS >> 1) - 1)
    first = F.when(direct, F.col("source_id") * 2 + F.when(is_invoice, 1).otherwise(0)).otherwise(_content_key(F.xxhash64(*content)))
    return tx.withColumn("row_id", first), content


def _repeated_ids(rows: DataFrame) -> DataFrame:
    return staged(rows.groupBy("row_id").count().filter("count > 1").select("row_id"), "repeated-ids")


def _settled_ids(rows: DataFrame, content: list[str]) -> DataFrame | None:
    """``rows`` (a reader of files) with an id of its own for each; None if they have that already."""
    salt, settled, repeated = 0, None, _repeated_ids(rows)
    while not repeated.isEmpty():
        salt += 1
        rows = rows if settled is None else staged(settled, "transactions")
        few = broadcast_if_small(repeated)
        placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        again = placed.join(few, "row_id", "left_semi").withColumn("_text", F.to_json(F.struct(*content)))
        again = again.withColumn("_hash", F.xxhash64("_text"))
        # Only rows that may have an equal one are dealt out to be numbered.
        equal = staged(again.groupBy("_hash").count().filter("count > 1").select("_hash"), "equal-rows")
        few_equal = broadcast_if_small(equal)
        alone = again.join(few_equal, "_hash", "left_anti").withColumn("_digest", F.sha2("_text", 256)).withColumn("_copy", F.lit(1).cast("long"))
        numbered = [alone]
        if not equal.isEmpty():
            numbered.append(_numbered_copies(again.join(few_equal, "_hash", "left_semi").withColumn("_digest", F.sha2("_text", 256)).drop("_text", "_hash")))
        new = _content_key(F.xxhash64("_digest", "_copy", F.lit(salt)))
        parts = [part.withColumn("row_id", new).select(*rows.columns) for part in numbered]
        settled = reduce(DataFrame.unionByName, parts, rows.join(few, "row_id", "left_anti"))
        if few is repeated or few_equal is equal or len(numbered) > 1:  # shuffled: once is enough
            settled = staged(settled, "transactions")
        repeated = _repeated_ids(settled)
    return settled


def _numbered_copies(rows: DataFrame) -> DataFrame:
    """Equal rows (by ``_digest``) with their number, ``_copy``."""
    # Copies are counted by file first, so that equal rows are numbered in many tasks.
    by_file = rows.groupBy("_digest", "_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_digest").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_file.select("_digest", "_file", F.coalesce(before, F.lit(0)).alias("_before"))
    copy = F.row_number().over(Window.partitionBy("_digest", "_file").orderBy("_at"))
    numbered = rows.withColumn("_copy", copy).join(offsets, ["_digest", "_file"])
    return numbered.withColumn("_copy", F.col("_copy") + F.col("_before"))


def _content_key(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit(CONTENT_KEYS - 2)).bitwiseOR(F.lit(CONTENT_KEYS))


def _rated(rows: DataFrame, rate: str | None) -> DataFrame:
    """Note beside the column how the invoices' discount rates were taken."""
    return rows.withColumn("source_id", F.col("source_id").alias("source_id", metadata={"rate": rate}))


def store_transactions(tx: DataFrame, path: str, rate: str | None = None) -> DataFrame:
    """Keep the canonical table as Parquet by source and order year and read it back.

    Rows get the ids of ``with_stable_ids``, the same at every rebuild; the id a
    row has in its source is kept as ``source_id``. The analyses read the table
    many times; year filters then open only the folders of the years they need.
    """
    rows, content = _with_first_ids(tx)
    by = ["source"] if "source" in rows.columns else []
    # Ids are looked at in the files written aside, so rows that have their own are written once.
    replace_dataset(_rated(rows, rate), path, ["order_date", "sales", "profit"], by, lambda written: _settled_ids(written, content))
    return read_table(tx.sparkSession, path)


def _is_stored(spark: SparkSession, path: str) -> bool:
    return "source" in read_table(spark, path, T.StructType([])).columns


def upload_csv(
    spark: SparkSession,
    csv_path,
    path: str,
    date_format: str = "M/d/yyyy",
    rate_unit: str = "percent",
    invoices_path: str | None = None,
    rate: str = "amount",
) -> int:
    """Check a new historical file and make it the CSV part of the stored table; rows of all sources.

    Only the folders of the CSV part are written. Invoices stay: those of the
    invoice store if it is given, else those that the table holds.
    """
    raw = read_transactions_csv(spark, csv_path)
    require_columns(raw, UPLOAD_REQUIRED)
    csv = canonical_csv(raw, date_format, rate_unit)
    if not _is_stored(spark, path):
        xml = None if invoices_path is None else canonical_invoices(read_invoice_lines(spark, invoices_path), rate)
        return store_transactions(consolidate(csv, xml), path, rate).count()
    _replace(spark, path, _rated(with_stable_ids(csv), _rate(read_table(spark, path))), "csv")
    return (read_table(spark, path) if invoices_path is None else refresh_transactions(spark, path, invoices_path, rate)).count()


def _replace(spark: SparkSession, path: str, rows: DataFrame, source: str, years: list | None = None) -> None:
    """Make ``rows`` all there is of a source, or of some of its years."""
    folders = [f for f in stored_folders(spark, path) if f["source"] == source and (years is None or f["order_year"] in years)]
    (batch,) = stored_batches(spark, path)
    rows = rows.withColumns({"order_year": F.year("order_date"), "stored_batch": F.lit(batch.folder)})
    overwrite_folders(spark, path, rows, folders)


def _rate(tx: DataFrame) -> str | None:
    return tx.schema["source_id"].metadata.get("rate")


def _by_year(rows: DataFrame, source_id: str) -> dict:
    """{year: what tells two sets of ids apart}; reads the id column only."""
    hashed = F.xxhash64(source_id)
    found = rows.groupBy("order_year").agg(
        F.count("*").alias("n"), F.bit_xor(hashed).alias("x"), F.sum(hashed.cast("decimal(20,0)")).alias("s"), F.sum(F.col(source_id).cast("decimal(20,0)")).alias("i")
    )
    return {row["order_year"]: (row["n"], row["x"], row["s"], row["i"]) for row in found.collect()}  # a row per year


def refresh_transactions(spark: SparkSession, path: str, invoices_path: str, rate: str = "amount") -> DataFrame:
    """Bring the stored table up to the invoices that came in or went.

    Stored invoice lines never change, so a year whose ids are those of the
    invoice store is left alone; other years are rewritten from the store, as
    are all if their discount rates were taken in another way. CSV rows stay.
    """
    lines = read_invoice_lines(spark, invoices_path)
    if "order_year" not in lines.columns:
        lines = lines.withColumn("order_year", F.year("order_date"))
    if not _is_stored(spark, path):
        return store_transactions(canonical_invoices(lines.drop("order_year"), rate), path, rate)
    stored = read_table(spark, path)
    now, wanted = _by_year(stored.filter("source = 'xml'"), "source_id"), _by_year(lines, "row_id")
    years = [y for y in now.keys() | wanted.keys() if _rate(stored) != rate or now.get(y) != wanted.get(y)]
    if years:
        own = lines.filter(within_folders([{"order_year": y} for y in years])).drop("order_year")
        _replace(spark, path, _rated(with_stable_ids(canonical_invoices(own, rate), scanned=True), rate), "xml", years)
    return read_table(spark, path)


def delete_selected(spark: SparkSession, path: str, ids, invoices_path: str) -> int:
    """Delete the invoice lines among the selected rows of the stored table; how many there were.

    Rows of the historical file stay. The lines go from the invoice store, and
    the years that held them are rewritten in both. Ids outlive refreshes, so a
    selection made before one deletes the same lines after it.
    """
    wanted = broadcast_if_small(id_frame(spark, ids))
    stored = read_table(spark, path)
    lines = stored.filter("source = 'xml'").join(wanted, "row_id", "left_semi")
    lines = staged(lines.select(F.col("source_id").alias("row_id")), "selected")
    if lines.isEmpty():
        return 0
    count = delete_rows(spark, invoices_path, lines)
    refresh_transactions(spark, path, invoices_path, _rate(stored) or "amount")
    return count


def keep_beside(spark: SparkSession, path: str, beside: str, summarise: Callable[[DataFrame, list], DataFrame], by: list[str]) -> DataFrame:
    """Keep a summary of each source and year of the stored table up to date in the table ``beside`` and read it.

    Each source and year carries a mark of the files it was made from. Only
    those whose files changed since are read and summarised again; the others
    are told by their names alone. ``summarise`` gets their rows and sources and
    returns rows with ``source`` and ``order_year``; ``by`` names folders of ``beside``.
    """
    marks = [({c: v for c, v in folder.items() if c != "stored_batch"}, mark) for folder, mark in folder_marks(spark, path)]
    known, first = {}, not _is_stored(spark, beside)
    if not first:
        made = read_table(spark, beside).groupBy("source", "order_year").agg(F.min("made_from").alias("made_from"))
        known = {(r["source"], r["order_year"]): r["made_from"] for r in made.collect()}  # a row per source and year
    changed = [(f, mark) for f, mark in marks if known.get((f["source"], f["order_year"])) != mark]
    gone = [{"source": s, "order_year": y} for s, y in known if (s, y) not in {(f["source"], f["order_year"]) for f, _ in marks}]
    if first or changed or gone:
        rows = read_table(spark, path)
        own = rows.filter(within_folders([f for f, _ in changed])) if changed else rows.limit(0)
        noted = spark.createDataFrame([(f["source"], f["order_year"], mark) for f, mark in changed], "source string, order_year int, made_from string")
        merged = summarise(own, sorted({f["source"] for f, _ in changed}) or [None])
        same = merged["source"].eqNullSafe(noted["source"]) & merged["order_year"].eqNullSafe(noted["order_year"])
        merged = merged.join(F.broadcast(noted), same).select(*[merged[c] for c in merged.columns], "made_from")
        if first:
            replace_dataset(merged if "order_year" in by else merged.drop("order_year"), beside, [], by)
        else:
            (batch,) = stored_batches(spark, beside)
            folders = [{"stored_batch": batch.folder, **f} for f in [f for f, _ in changed] + gone]
            overwrite_folders(spark, beside, merged.withColumn("stored_batch", F.lit(batch.folder)), folders)
    return read_table(spark, beside)


def store_partials(spark: SparkSession, path: str, partials_path: str) -> DataFrame:
    """Keep ``order_partials`` of the stored table up to date beside it and read them.

    Only sources and years whose files changed since are read and merged again.
    """

    def merge(rows: DataFrame, sources: list) -> DataFrame:
        parts = []
        for source in sources:
            one = order_partials(rows.filter(F.col("source").eqNullSafe(F.lit(source)))).withColumn("source", F.lit(source).cast("string"))
            parts.append(one.withColumn("order_year", F.year("order_date")))
        return reduce(DataFrame.unionByName, parts)

    return keep_beside(spark, path, partials_path, merge, ["source"])


def save_annotations(spark: SparkSession, changes: DataFrame, path: str) -> int:
    """Store the newest text per page; how many pages have one."""
    try:
        both = upsert_annotations(read_table(spark, path), changes)
    except ValueError:
        both = upsert_annotations(changes.limit(0), changes)
    return replace_dataset(both, path, ["page_name", "content", "updated_by_name", "updated_at"])


def stored_annotation(spark: SparkSession, path: str, pages) -> DataFrame:
    """Text and author stored for each page, or the default text."""
    empty = T.StructType.fromDDL("page_name string, content string, updated_by_name string, updated_at timestamp")
    return latest_annotation(read_table(spark, path, empty), pages)
