"""Documents from raw to packed: rules, repeated lines, near duplicates, mixing, packing.

Each stage takes the documents that its predecessor kept, as read back from
Parquet, and returns those it keeps, with the columns of ``documents``; the last
returns packed pieces. Nulls, empty and very long texts, repeated rows, empty
tables and further columns are handled as the operators' modules state.

* ``quality_rules`` drops documents that the rules reject; short texts pass.
* ``line_dedup`` takes repeated lines out of the texts, and drops documents
  that lose lines and keep none with a word.
* ``near_dedup`` keeps one document of each group linked at five words, 80 %.
* ``mixing`` shares 95 % of the tokens over domains, languages and sources of
  equal weight, and drops documents that the budget does not reach.
* ``packing`` puts the documents' tokens into sequences of 1,024.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.line_dedup import drop_repeated_lines
from tallyline.llm.linking import stored
from tallyline.llm.mixing import keep_reached
from tallyline.llm.near_dedup import keep_one_of_each
from tallyline.llm.packing import pack, pieces
from tallyline.llm.quality_rules import keep_documents
from tallyline.llm.queries import domain, tokenizer

BUDGET_SHARE = 0.95
SEED = 11


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(docs, drop_empty=True, counted=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    return keep_reached(docs, levels, BUDGET_SHARE, seed=SEED)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, tokenizer()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Similarity of hashes and token ids are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
