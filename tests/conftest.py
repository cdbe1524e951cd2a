import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def values(spark):
    """One Column over a list of inputs -> list of results, in order."""

    def run(expression, inputs, kind="string"):
        from pyspark.sql import functions as F

        rows = [(i, value) for i, value in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, x {kind}").repartition(2)
        return [row.y for row in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
