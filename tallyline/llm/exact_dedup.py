"""Exact duplicates by a 128-bit content hash, compared byte by byte within each group.

Rows are grouped by hash first, in narrow rows. Only texts whose hash occurs
more than once are then grouped by (hash, text) itself: grouping compares the
key's bytes, so two texts that share a hash end up in two groups. Both groupings
combine copies before the shuffle, so a text that fills a third of all rows
reaches the reducers as one row per task. Groups of more than one row are then
looked up by the rows: sent to them if they are few, else by a join of two
stored frames, which Spark splits where one hash has very many rows.

Nulls count as empty text and are copies of each other and of empty texts. Of
equal texts the row with the smallest (or, by ``keep="largest"``, the largest)
identifier stays; rows that repeat that identifier stay with it. Rows with a
null identifier never stay unless their whole group has none; they then all
stay, with a null ``keep_id``. An empty table gives an empty result. Other
columns are neither read nor returned by ``exact_groups``.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.session import broadcast_if_small, shared


def md5_bits(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest",
    content_hash: Callable[[Column], Column] = md5_bits,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    if keep not in ("smallest", "largest"):
        raise ValueError('keep is "smallest" or "largest"')
    chosen = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("hash", content_hash(F.col("text")))

    keys = shared(rows.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256")))
    counted = keys.groupBy("hash").agg(F.count("*").alias("group_size"), chosen("doc_id").alias("keep_id"))
    repeated = shared(counted.filter("group_size > 1"))
    few = broadcast_if_small(repeated)
    compared = shared(
        rows.join(few, "hash", "left_semi")
        .groupBy("hash", "text")
        .agg(F.count("*").alias("group_size"), chosen("doc_id").alias("keep_id"))
    )
    collided = shared(compared.groupBy("hash").agg(F.count("*").alias("texts")).filter("texts > 1").select("hash"))
    # Most texts occur once and meet no group; rows of a text that fills many stay where they are, or are split by AQE.
    alone = {"group_size": F.coalesce("group_size", F.lit(1).cast("long")), "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))}
    out = keys.join(few, "hash", "left").withColumns(alone)
    if not collided.isEmpty():
        clash = broadcast_if_small(collided)
        apart = (
            rows.join(clash, "hash", "left_semi").withColumn("text_sha256", F.sha2("text", 256))
            .join(compared, ["hash", "text"]).select(*out.columns)
        )
        out = out.join(clash, "hash", "left_anti").unionByName(apart)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("doc_id").alias(id_column), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
