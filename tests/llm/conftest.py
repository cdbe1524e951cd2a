import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__  # noqa: F401  # sends the package's functions to the workers by value

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def texts(sf_dir):
    """{doc_id: text} of the small documents table."""
    return dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long, repeated and tied texts, and columns whose names operators use inside."""
    clash = "node long, keys string, text_hash string, gone int, row int, n int, part int, item int, place string"
    long_line = " ".join(f"w{i % 977}x{i}" for i in range(3000))
    rows = [
        (1, None), (2, ""), (None, "a line of five words here\nand then one more for it all"), (4, " \n\t "),
        (5, "A line, of five WORDS here!\nquite another line with some words"), (5, "A line, of five WORDS here!\nquite another line with some words"),
        (6, long_line), (7, long_line + " end"), (8, "x" * 200_000), (9, "one"), (10, "One"), (11, "one two"),
        (None, None), (12, "é ü \x85 tail\x00nul"), (5, "the same identifier with another text of words"),
        (13, long_line), (14, "\n".join(["again and again and again the same"] * 5)),
    ]
    rows = [(i, t, None, None, None) + (None, "x", "y", 1, 2, 3, 4, 5, "p") for i, t in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
