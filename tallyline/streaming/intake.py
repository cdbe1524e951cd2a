"""Invoice archives as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.operators.duplicates import IDENTITY, find_duplicates
from tallyline.plans.intake import intake_invoices
from tallyline.session import broadcast_if_small, staged, staged_meanwhile
from tallyline.sources.invoices import ARCHIVE_ROWS, expand_archives, invoice_lines, read_documents
from tallyline.sources.tables import append_invoice_lines, read_invoice_keys, stored_batches

#: Keyed state lies on disk, whatever the session says of other streams; all its partitions on an executor share this memory.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


def stream_archives(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    """ZIP files below ``source`` as they arrive: (path, content)."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.zip")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
        .select("path", "content")
    )


def start_invoice_intake(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    name: str = "invoices",
    files_per_batch: int = 1000,
    **options,
) -> StreamingQuery:
    """Take in all archives below ``source`` not taken yet, then stop.

    Every batch runs the ordinary intake. Its part is named after the query (as
    the checkpoint knows it) and the batch, so a batch repeated after a failure
    is stored once, and a stream with a new checkpoint is another query.
    """
    archives = stream_archives(spark, source, files_per_batch)

    def take_in(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        part = f"{name}-{query}-{number}"
        intake_invoices(expand_archives(batch), path, part=part, **options)

    return (
        archives.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- with keyed state ---------------------------------------------------------


def start_document_stream(archives: DataFrame, documents: str, checkpoint: str, **options) -> StreamingQuery:
    """Parse all archives of a stream (path, content) not parsed yet into the folder ``documents``, then stop.

    The file sink notes which files belong to which batch, so a batch repeated
    after a failure leaves no document twice. ``options`` are those of
    ``read_documents``.
    """
    parsed = read_documents(expand_archives(archives), **{"at_once": True, **options})
    return (
        parsed.writeStream.format("parquet").option("path", documents).option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_seen(documents: DataFrame, literal: bool = False) -> DataFrame:
    """(order_id, unstamped, first, last): of each invoice in a stream of documents the one that came first.

    The aggregate is the stream's state. Of documents that arrive in one batch
    the first by archive and member counts. Documents of one invoice are merged
    before they are sent to its state, so an invoice with very many copies is
    one row per task. ``first`` says when that document arrived, ``last`` when
    the newest did: an invoice is new in a batch if both are the same.
    Documents without a stamp share no key (unless ``literal``): each is its
    own, by arrival, archive and member.
    """
    here = ["arrival", *IDENTITY]
    keyed = F.lit(True) if literal else F.col("has_uuid")
    usable = documents.filter("problem is null").withColumn("arrival", F.current_timestamp())
    keys = [F.when(keyed, F.col("order_id")).alias("order_id"), F.when(~keyed, F.struct(*here)).alias("unstamped")]
    return usable.groupBy(*keys).agg(F.min(F.struct(*here, "file")).alias("first"), F.max("arrival").alias("last"))


def start_keyed_intake(
    spark: SparkSession,
    documents: str,
    path: str,
    checkpoint: str,
    name: str = "invoices",
    files_per_batch: int = 1000,
    compat: str | None = None,
    literal: bool = False,
) -> StreamingQuery:
    """Store the lines of all new invoices among documents not looked at yet, then stop.

    ``documents`` is a folder that ``start_document_stream`` writes. Which
    invoices came before is kept as keyed state by ``first_seen``, so a batch reads
    its own documents and no stored key: their keys for the state, then whole
    those of the (at most ``files_per_batch``) files that hold a new invoice. Only
    if the store has batches that this query did not write are the new ones
    looked up among the stored keys too; so a lost checkpoint adds no stamped
    invoice twice. An invoice that is deleted from the store stays seen. A batch that is
    repeated after a failure finds the same new invoices, and its part stored.
    """
    schema = read_documents(spark.createDataFrame([], ARCHIVE_ROWS)).schema
    narrow = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
        .select(*IDENTITY, "order_id", "has_uuid", "problem", F.col("_metadata.file_name").alias("file"))
    )

    def take_in(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = f"{name}-{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-"
        with staged_meanwhile(batch.filter("first.arrival = last").select("order_id", "first.*"), "new-invoices") as new:
            store(session, own, number, new)

    def store(session: SparkSession, own: str, number: int, new: DataFrame) -> None:
        if any(not b.name.startswith(own) for b in stored_batches(session, path)):
            asked = new.withColumns({"problem": F.lit(None).cast("string"), "has_uuid": F.col("order_id").isNotNull()})
            known = staged(find_duplicates(asked, read_invoice_keys(session, path)), "known")
            new = staged(new.join(broadcast_if_small(known), IDENTITY, "left_anti"), "new-invoices")
        files = [row.file for row in new.select("file").distinct().collect()]
        if files:
            whole = session.read.schema(schema).parquet(*[f"{documents}/{file}" for file in files])
            whole = whole.withColumn("file", F.col("_metadata.file_name"))
            fresh = whole.join(broadcast_if_small(new.select("file", *IDENTITY)), ["file", *IDENTITY], "left_semi")
            with staged_meanwhile(fresh.drop("file"), "fresh-documents") as fresh:
                append_invoice_lines(invoice_lines(fresh, compat), path, f"{own}{number}", stable=True, keys=fresh)

    # The query keeps the settings that the session has when it starts.
    own = {key: value for key, value in STATE_ON_DISK.items() if spark.conf.get(key, None) is None}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        return (
            first_seen(narrow, literal).writeStream.outputMode("update").foreachBatch(take_in)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key in own:
            spark.conf.unset(key)
