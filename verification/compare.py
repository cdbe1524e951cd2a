"""Run every query next to its SQL: python -m verification.compare [sf] [name ...]"""

import math
import sys
import time

import duckdb

from tallyline.session import build_session
from verification.oracles import ORACLES
from verification.queries import QUERIES, plain

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(value):
        if isinstance(value, float) and not math.isnan(value):
            return repr(value + 0.0)
        return str(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, db, sf_dir, name):
    """(seconds in Spark, None or the difference found)."""
    started = time.time()
    df = plain(QUERIES[name](spark, sf_dir))
    found = canonical([tuple(row) for row in df.collect()], df.columns)
    seconds = time.time() - started
    cursor = db.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    expected = canonical(cursor.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return seconds, f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if found == expected:
        return seconds, None
    more, less = sorted(set(found) - set(expected)), sorted(set(expected) - set(found))
    return seconds, f"{len(found)} rows instead of {len(expected)}; only here {more[:2]}; only in SQL {less[:2]}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            seconds, difference = compare(spark, db, sf_dir, name)
        except Exception as error:
            seconds, difference = 0, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += difference is not None
        print(f"{'FAIL' if difference else 'ok  '} {seconds:6.2f} {name} {difference or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
