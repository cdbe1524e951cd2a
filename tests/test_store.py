"""What is stored, reloaded and paged stays complete."""

import io
import sys
import zipfile
from contextlib import redirect_stdout

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import tallyline as tl
from tallyline.plans import load
from tallyline.plans.load import with_stable_ids
from tallyline.session import broadcast_if_small
from tallyline.sources import csv_files, tables

LINES = "order_id string, order_date timestamp_ntz, sales double"


def lines(spark, *ids):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("order_id")).selectExpr(
        "order_id", "timestamp_ntz'2024-05-01' as order_date", "1.0D as sales"
    )


def orders(spark, path):
    return sorted(row.order_id for row in tl.read_table(spark, path).collect())


def test_batch_names_are_compared_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tl.append_invoice_lines(lines(spark, "a"), path, "2024-01") == 1
    assert tl.append_invoice_lines(lines(spark, "b"), path, "2024") == 1
    assert tl.append_invoice_lines(lines(spark, "c"), path) == 1
    assert tl.append_invoice_lines(lines(spark, "d"), path, "batch") == 1
    assert tl.append_invoice_lines(lines(spark, "e"), path, "2024") == 0
    assert orders(spark, path) == ["a", "b", "c", "d"]


def test_folder_names_tell_the_state(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tl.stored_last_year(spark, path) is None
    for i in range(6):
        tl.append_invoice_lines(lines(spark, str(i)), path, f"day {i}/%é")
    assert [(b.number, b.last_row_id) for b in tables.stored_batches(spark, path)] == [(i, i) for i in range(1, 7)]
    assert tl.append_invoice_lines(lines(spark, "x"), path, "day 3/%é") == 0
    assert orders(spark, path) == list("012345")
    assert tl.stored_last_year(spark, path) == 2024
    assert tl.delete_rows(spark, path, [1, 2, 3, 4, 5, 6]) == 6
    assert tl.stored_last_year(spark, path) is None and tl.read_table(spark, path).count() == 0
    assert tl.append_invoice_lines(lines(spark, "new"), path) == 1
    assert [r.row_id for r in tl.read_table(spark, path).collect()] == [7]


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tl.append_invoice_lines(lines(spark, "a"), path)
    old = tables._state(spark, path)
    tl.append_invoice_lines(lines(spark, "b", "bb"), path)
    with monkeypatch.context() as m:
        m.setattr(tables, "_state", lambda *_: old)
        with pytest.raises(RuntimeError, match="another writer"):
            tl.append_invoice_lines(lines(spark, "c"), path)
    assert orders(spark, path) == ["a", "b", "bb"]


def test_a_batch_of_another_size_is_not_stored(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tl.append_invoice_lines(lines(spark, "a"), path)
    with monkeypatch.context() as m:
        numbered = tables.number_rows
        m.setattr(tables, "number_rows", lambda *a, **k: (numbered(*a, **k)[0], 3))
        with pytest.raises(RuntimeError, match="2 rows were written .* where 3 were counted"):
            tl.append_invoice_lines(lines(spark, "b", "c"), path)
    assert orders(spark, path) == ["a"]


def test_rows_are_numbered_whatever_the_splits(spark, tmp_path):
    """Files are cut into other partitions between counting and reading."""
    spark.range(30_000).repartition(3).write.parquet(str(tmp_path / "p"))
    keys = {"spark.sql.files.openCostInBytes": "1024", "spark.sql.files.minPartitionNum": "8"}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        rows = spark.read.parquet(str(tmp_path / "p"))
        tx = rows.selectExpr("id as row_id", "timestamp_ntz'2024-05-01' as order_date", "1.0D as sales", "1.0D as profit", "'csv' as source")
        numbered, n = tables.number_rows(rows, 1)
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        assert n == 30_000 and numbered.agg(F.count_distinct("row_id")).first()[0] == n
        stored = tl.store_transactions(tx, str(tmp_path / "t"))
        spark.conf.set("spark.sql.files.minPartitionNum", "40")
        assert stored.agg(F.count_distinct("row_id")).first()[0] == stored.count() == n
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_rows_to_be_numbered_are_kept_packed(spark, tmp_path, monkeypatch):
    """Appended rows are numbered in Parquet files, without gaps over several tasks, and never kept as a checkpoint."""
    rows = spark.range(5_000).repartition(7).select(F.col("id").cast("string").alias("order_id"), F.lit("2024-05-01").cast("timestamp_ntz").alias("order_date"))
    with monkeypatch.context() as m:
        m.setattr(type(rows), "checkpoint", None)
        assert [tl.append_invoice_lines(part, str(tmp_path / "t")) for part in (rows, rows.limit(0), rows.filter("id < 10"))] == [5_000, 0, 10]
    found = tl.read_table(spark, str(tmp_path / "t"))
    assert found.agg(F.count("*"), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first() == (5_010, 5_010, 1, 5_010)


def test_ids_follow_from_source_and_content(spark):
    rows = [(1, "xml", "a"), (1, "csv", "a"), (2, "csv", "b"), (2, "csv", "c"), (None, "csv", "d"), (None, "csv", "d"), (None, "csv", "e"), (-4, "csv", "f")]
    rows += [(9, "csv", "copy")] * 40
    df = spark.createDataFrame(rows, "row_id long, source string, product_name string")
    found = [tl.with_stable_ids(df.repartition(n)).collect() for n in (1, 5)]
    assert all(len({r.row_id for r in f}) == len(rows) and min(r.row_id for r in f) > 0 for f in found)
    assert sorted((r.row_id, str(r.source_id), r.product_name) for r in found[0]) == sorted((r.row_id, str(r.source_id), r.product_name) for r in found[1])
    direct = {(r.source, r.product_name): r.row_id for r in found[0]}
    assert direct["xml", "a"] == 3 and direct["csv", "a"] == 2 and direct["csv", "b"] > 1 << 61


def test_equal_rows_get_ids_by_their_number(spark, tmp_path):
    """Rows without an id: alone, or several equal ones; the ids are those of content, number and round."""
    rows = [("csv", "a", 1.0)] * 3 + [("csv", "b", 2.0), ("csv", None, 2.0)] + [("csv", "c", 3.0)] * 2
    tx = spark.createDataFrame(rows, "source string, order_id string, sales double").repartition(3)
    tx = tx.withColumn("row_id", F.lit(7).cast("long"))
    found = with_stable_ids(tx).collect()
    text = F.to_json(F.struct("order_id", "sales", "source", "source_id"))
    expected = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, order_id string, sales double, n int")
    number = F.row_number().over(Window.partitionBy("source", "order_id", "sales").orderBy("n")).cast("long")
    hashed = F.xxhash64(F.sha2(text, 256), number, F.lit(1)).bitwiseAND(F.lit((1 << 62) - 2)).bitwiseOR(F.lit(1 << 62))
    expected = expected.withColumn("source_id", F.lit(7).cast("long")).select("order_id", hashed.alias("id"))
    assert sorted((str(r.order_id), r.row_id) for r in found) == sorted((str(r.order_id), r.id) for r in expected.collect())


def test_rows_with_their_own_ids_are_written_once(spark, tmp_path, three_years, monkeypatch):
    """Storing and refreshing invoices keeps no copy of the rows and shuffles no row but its id."""
    invoices, _, dated = three_years
    kept, path = [], str(tmp_path / "own-tx")
    real = load.staged
    monkeypatch.setattr(load, "staged", lambda df, name: (kept.append(name), real(df, name))[1])
    monkeypatch.setattr(tables, "staged", lambda df, name: (kept.append(name), real(df, name))[1])
    tl.store_transactions(tl.load_transactions(spark, invoices_path=invoices), path, rate="amount")
    tl.append_invoice_lines(dated(2024, "C"), invoices)
    assert tl.refresh_transactions(spark, path, invoices).count() == 7
    assert set(kept) == {"repeated-ids"}
    plans = []
    writer = tables._write

    def seen(df, *args):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain()
        plans.append(out.getvalue())
        writer(df, *args)

    monkeypatch.setattr(tables, "_write", seen)
    tl.append_invoice_lines(dated(2023, "D"), invoices)
    tl.refresh_transactions(spark, path, invoices)
    assert plans and not any("REBALANCE" in text for text in plans)


def test_a_table_is_rewritten_while_it_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("order_year"), F.lit(0.0).alias("x"))
    tl.replace_dataset(rows, path, [], ["order_year"])
    folders = [{"stored_batch": b.folder, "order_year": y} for b in tables.stored_batches(spark, path) for y in range(3)]
    state = tables._state(spark, path)
    left = tables._rows(spark, path, state).filter("order_year < 2 and id % 3 = 0").withColumn("x", F.lit(1.0))
    tables.overwrite_folders(spark, path, left, folders)
    found = {r.id: r.x for r in tl.read_table(spark, path).collect()}
    assert found == {i: 1.0 for i in range(40) if i % 4 < 2 and i % 3 == 0} | {i: 0.0 for i in range(40) if i % 4 == 3}


def files_by_folder(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet") if "stored_batch=" in str(f)}


@pytest.fixture
def three_years(spark, tmp_path):
    invoices, path = str(tmp_path / "i"), str(tmp_path / "t")
    empty = spark.createDataFrame([], tl.read_invoice_lines(spark, invoices).schema).drop("row_id")
    dated = lambda year, *ids: empty.unionByName(
        lines(spark, *ids).withColumn("order_date", F.lit(f"{year}-05-01").cast("timestamp_ntz")), allowMissingColumns=True
    )
    for year in (2022, 2023, 2024):
        tl.append_invoice_lines(dated(year, f"a{year}", f"b{year}"), invoices, keys=dated(year, f"a{year}", f"b{year}"))
    (tmp_path / "h.csv").write_text("Row ID,Order Date,Ship Date,Sales,Profit,Category\n1,1/1/2022,,5,1,x\n2,1/1/2024,,6,1,x\n")
    assert tl.upload_csv(spark, str(tmp_path / "h.csv"), path, invoices_path=invoices) == 8
    return invoices, path, dated


def test_only_years_that_change_are_rewritten(spark, tmp_path, three_years):
    invoices, path, dated = three_years
    before = {name: files_by_folder(tmp_path / name) for name in "it"}
    chosen = tl.read_table(spark, path).filter("order_id = 'a2023'")
    assert tl.delete_selected(spark, path, chosen, invoices) == 1
    after = {name: files_by_folder(tmp_path / name) for name in "it"}
    for name in "it":
        changed = before[name] ^ after[name]
        assert changed and all("order_year=2023" in f and "source=csv" not in f for f in changed)
    assert sorted(r.order_id for r in tl.read_table(spark, path).filter("source = 'xml'").collect()) == ["a2022", "a2024", "b2022", "b2023", "b2024"]
    # New invoices of one year, a new file of another: the rest stays as it is.
    tl.append_invoice_lines(dated(2024, "c2024"), invoices)
    before = files_by_folder(tmp_path / "t")
    tl.refresh_transactions(spark, path, invoices)
    assert all("source=xml/order_year=2024" in f for f in before ^ files_by_folder(tmp_path / "t"))
    before = files_by_folder(tmp_path / "t")
    tl.refresh_transactions(spark, path, invoices)
    assert before == files_by_folder(tmp_path / "t")
    (tmp_path / "n.csv").write_text("Order Date,Ship Date,Sales,Profit,Category,Extra\n1/1/2023,,7,1,x,more\n")
    assert tl.upload_csv(spark, str(tmp_path / "n.csv"), path) == 7
    assert all("source=csv" in f for f in before ^ files_by_folder(tmp_path / "t"))
    assert [(r.sales, r.Extra) for r in tl.read_table(spark, path).filter("source = 'csv'").collect()] == [(7.0, "more")]
    # Rates taken in another way concern all years.
    before = files_by_folder(tmp_path / "t")
    tl.refresh_transactions(spark, path, invoices, rate="stored")
    assert {f.split("order_year=")[1][:4] for f in before ^ files_by_folder(tmp_path / "t")} == {"2022", "2023", "2024"}


def test_a_selection_outlives_a_refresh(spark, three_years):
    invoices, path, dated = three_years
    selection = [r.row_id for r in tl.read_table(spark, path).filter("order_id in ('b2022', 'a2024')").collect()]
    tl.delete_selected(spark, path, tl.read_table(spark, path).filter("order_id = 'a2022'"), invoices)
    tl.append_invoice_lines(dated(2021, "z2021"), invoices)
    tl.refresh_transactions(spark, path, invoices)
    assert tl.delete_selected(spark, path, selection, invoices) == 2
    assert sorted(r.order_id for r in tl.read_table(spark, path).filter("source = 'xml'").collect()) == ["a2023", "b2023", "b2024", "z2021"]
    assert tl.delete_selected(spark, path, selection, invoices) == 0


def test_partials_follow_the_files_that_change(spark, tmp_path, three_years):
    invoices, path, dated = three_years
    stored = str(tmp_path / "p")
    totals = lambda df: sorted((r.country or "", r.sales, r.orders) for r in tl.country_totals(df.fillna("x", "country")).collect())
    full = lambda: totals(tl.read_table(spark, path))
    assert totals(tl.store_partials(spark, path, stored)) == full()
    before = files_by_folder(tmp_path / "p")
    tl.store_partials(spark, path, stored)
    assert files_by_folder(tmp_path / "p") == before
    tl.append_invoice_lines(dated(2024, "c2024", "c2024"), invoices)
    tl.delete_selected(spark, path, tl.read_table(spark, path).filter("order_id in ('a2023', 'b2023')"), invoices)
    assert totals(tl.store_partials(spark, path, stored)) == full()
    assert {f.split("source=")[1].rsplit("/", 1)[0] for f in before ^ files_by_folder(tmp_path / "p")} == {"xml/order_year=2023", "xml/order_year=2024"}


@pytest.mark.parametrize("by,order", [("order_date", "desc"), ("sales", "asc"), ("product_name", "desc")])
def test_stored_pages_against_a_full_sort(spark, tmp_path, by, order):
    """Ties, missing values, values that are no number, and one value that a third of the rows hold."""
    rows = spark.range(600).selectExpr(
        "cast(id % 5 * 4 + id % 3 as string) as order_id",
        "if(id % 11 = 0, null, timestamp_ntz'2020-01-01' + make_dt_interval(cast(id * 7 % 1500 as int))) as order_date",
        "case when id % 3 = 0 then 5D when id % 17 = 0 then null when id % 19 = 0 then double('nan') else id * 37 % 101 end as sales",
        "if(id % 13 = 0, null, concat('ñandú ', id * 31 % 57)) as product_name", "0D as profit", "if(id % 2 = 0, 'csv', 'xml') as source",
    )
    path, slices = str(tmp_path / "t"), str(tmp_path / "s")
    stored = tl.store_transactions(rows, path)
    full = [str(r) for r in tl.sort_rows(stored, by, order).collect()]
    for number, limit, top_k_rows in ((1, 7, 1000), (3, 100, 20), (6, 100, 1000), (7, 100, 20)):
        page = tl.stored_page(spark, path, slices, number, limit, by, order, top_k_rows)
        assert [str(r) for r in page.collect()] == full[(number - 1) * limit :][:limit]
    counts = tl.read_table(spark, slices).agg(F.sum("rows"), F.max(F.when(F.expr("low <> high"), F.col("rows")))).first()
    assert counts[0] == 600 and (counts[1] or 0) < 60


def test_slices_follow_the_files_that_change(spark, tmp_path, three_years):
    invoices, path, dated = three_years
    slices = str(tmp_path / "s")
    names = lambda number, **options: [r.order_id for r in tl.stored_page(spark, path, slices, number, 3, "order_date", **options).collect()]
    full = lambda: [r.order_id for r in tl.sort_rows(tl.read_table(spark, path), "order_date").collect()]
    assert names(1) + names(2, top_k_rows=2) + names(3) == full()
    before = files_by_folder(tmp_path / "s")
    assert names(1) == full()[:3] and files_by_folder(tmp_path / "s") == before
    tl.append_invoice_lines(dated(2024, "c2024", "d2024"), invoices)
    tl.delete_selected(spark, path, tl.read_table(spark, path).filter("order_id in ('a2023', 'b2023')"), invoices)
    assert names(1) + names(2) + names(3) == full()
    assert {f.split("source=")[1].rsplit("/", 1)[0] for f in before ^ files_by_folder(tmp_path / "s")} == {"xml/order_year=2023", "xml/order_year=2024"}
    # New dates pile up behind the last value known until the column is cut anew.
    for month in range(1, 13):
        more = dated(2025, *[f"{month}-{i}" for i in range(4)]).withColumn("order_date", F.lit(f"2025-{month:02}-01").cast("timestamp_ntz"))
        tl.append_invoice_lines(more, invoices)
    tl.refresh_transactions(spark, path, invoices)
    assert names(1) + names(2) == full()[:6]
    assert tl.read_table(spark, slices).filter("upper >= '2025-01-01'").select("upper").distinct().count() > 5
    # Nothing left.
    tl.delete_selected(spark, path, tl.read_table(spark, path).filter("source = 'xml'"), invoices)
    assert names(1) == full() and names(2) == []
    with pytest.raises(ValueError):
        tl.store_slices(spark, path, slices, "no_such")


def test_keys_of_stored_invoices(spark, three_years):
    invoices, path, dated = three_years
    keys = lambda: sorted(r.order_id for r in tl.read_invoice_keys(spark, invoices).collect())
    assert keys() == sorted(f"{c}{y}" for c in "ab" for y in (2022, 2023, 2024))
    tl.append_invoice_lines(dated(2024, "u", "u"), invoices)  # without keys: those of its lines
    assert keys().count("u") == 2
    ids = {r.order_id: r.row_id for r in tl.read_invoice_lines(spark, invoices).collect()}
    tl.delete_rows(spark, invoices, [ids["a2022"], ids["u"]])
    assert "a2022" not in keys() and "b2022" in keys() and keys().count("u") == 1
    documents = spark.createDataFrame([("z", 0, "m", "b2023", True, None), ("z", 1, "m", "new", True, None)], "archive string, member_no int, member string, order_id string, has_uuid boolean, problem string")
    found = tl.find_duplicates(documents, tl.read_invoice_keys(spark, invoices))
    assert [r.member_no for r in found.collect()] == [0]


def test_ids_are_unique_over_sources_and_only_invoices_are_deleted(spark, tmp_path):
    csv, invoices, path = str(tmp_path / "h.csv"), str(tmp_path / "i"), str(tmp_path / "t")
    text = "Row ID,Order Date,Ship Date,Sales,Profit,Category\n1,1/1/2024,1/2/2024,5,1,x\n2,1/1/2024,1/2/2024,6,1,x\n"
    (tmp_path / "h.csv").write_text(text)
    schema = spark.createDataFrame([], tl.read_invoice_lines(spark, invoices).schema).drop("row_id")
    tl.append_invoice_lines(schema.unionByName(lines(spark, "u1", "u2"), allowMissingColumns=True), invoices)
    assert tl.upload_csv(spark, csv, path, invoices_path=invoices) == 4
    stored = tl.read_table(spark, path).collect()
    assert len({r.row_id for r in stored}) == 4 and sorted(r.source_id for r in stored) == [1, 1, 2, 2]
    first = [r.row_id for r in stored if r.source_id == 1]
    assert tl.delete_selected(spark, path, first, invoices) == 1
    assert sorted((r.source, r.source_id) for r in tl.read_table(spark, path).collect()) == [("csv", 1), ("csv", 2), ("xml", 2)]
    assert tl.upload_csv(spark, csv, path) == 3
    tl.append_invoice_lines(schema.unionByName(lines(spark, "u3"), allowMissingColumns=True), invoices)
    again = tl.refresh_transactions(spark, path, invoices)
    assert sorted(r.order_id for r in again.filter("source = 'xml'").collect()) == ["u2", "u3"] and again.count() == 4


def test_files_are_aligned_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order Date,Ship Date,Sales,Profit,Category\n1/1/2024,,1,2,x\n")
    (tmp_path / "b.csv").write_text("Profit,Sales,Category,Order Date,Ship Date\n4,3,y,1/1/2024,\n")
    read = tl.read_transactions_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r.Sales, r.Profit) for r in read.collect()) == [("1", "2"), ("3", "4")]
    (tmp_path / "c.csv").write_text("Sales,Category,Order Date,Ship Date\n3,y,1/1/2024,\n")
    with pytest.raises(ValueError, match=r"c\.csv lacks the columns \['Profit'\]"):
        tl.read_transactions_csv(spark, str(tmp_path / "*.csv"))


def test_stray_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b,c,d\n1,5" pipe,"two\nlines",6" pipe\n')
    assert [tuple(r) for r in tl.read_transactions_csv(spark, str(tmp_path / "q.csv")).collect()] == [("1", '5" pipe', "two\nlines", '6" pipe')]


def test_only_files_with_quoted_line_breaks_are_read_whole(spark, tmp_path):
    bodies = {
        "plain": "1,2\n3,4\n", "quoted": '"1","a, b"\n"say ""x"", twice",""\n"""",4\n', "stray": '5" pipe,x"\n',
        "broken": '1,"two\nlines"\n', "even": '5" pipe,"two\nlines 6"" pipe"\n', "escaped": '1,"ends with """\n1,"goes on ""\nhere"\n', "odd": '"1" x,2\n',
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_bytes(b"\xef\xbb\xbf" + f'"a",b\n{body}'.encode())
    (tmp_path / "header.csv").write_text('"a","b\nc"\n1,2\n')
    (tmp_path / "empty.csv").write_text("\n")
    files = {r.file.rsplit("/", 1)[1][:-4]: r for r in csv_files._about_files(spark, [str(tmp_path)], None)}
    assert {name for name, r in files.items() if r.whole} == {"broken", "even", "escaped", "odd", "header"}
    assert {name for name, r in files.items() if r.broken_header} == {"header"}
    assert {r.header for name, r in files.items() if name != "header"} == {'"a",b'}
    for name in bodies:
        path = str(tmp_path / f"{name}.csv")
        rows = lambda **o: sorted(map(str, tl.read_transactions_csv(spark, path, **o).collect()))
        assert rows() == rows(multi_line=True)
        if not files[name].whole:
            assert rows() == rows(multi_line=False)
    read = tl.read_transactions_csv(spark, str(tmp_path))
    assert read.columns == ["a", "b", "b\nc"] and read.count() == 12


def test_many_files_cost_one_job_for_their_headers(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.csv").write_text(f"a,b\n{i},x\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        read = tl.read_transactions_csv(spark, str(tmp_path))
        # Listing 40 files is a job of its own; headers are one query of two jobs at most.
        assert len(tracker.getJobIdsForGroup("headers")) <= 5
        assert read.count() == 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_broken_archive_stops_nothing(spark, tmp_path):
    def archive(*members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
            for name, text in members:
                out.writestr(name, text)
        return buffer.getvalue()

    invoice = (
        '<c:Comprobante xmlns:c="u" Fecha="2024-01-02T03:04:05"><c:Conceptos><c:Concepto Importe="5" Cantidad="1"/></c:Conceptos>'
        '<c:Complemento><t:TimbreFiscalDigital xmlns:t="t" UUID="{}"/></c:Complemento></c:Comprobante>'
    )
    whole = archive(("1.xml", invoice.format("A")), ("2.xml", invoice.format("B") + " " * 5000), ("x.txt", "no"))
    at = whole.index(b"2.xml") + 12
    (tmp_path / "good.zip").write_bytes(archive(("9.xml", invoice.format("C"))))
    (tmp_path / "cut.zip").write_bytes(whole[:60])
    (tmp_path / "bent.zip").write_bytes(whole[:at] + bytes(b ^ 0x55 for b in whole[at : at + 8]) + whole[at + 8 :])
    path = str(tmp_path / "store")
    result = tl.intake_invoices(tl.read_invoice_archives(spark, str(tmp_path)), path)
    assert result["report"] == {"records_inserted": 2, "invoices_skipped": 0, "documents_held": 2}
    held = result["quarantine"].collect()
    assert sorted((r.archive.rsplit("/", 1)[1], r.member, r.problem) for r in held) == [
        ("bent.zip", "2.xml", "bad archive"), ("cut.zip", "", "bad archive")
    ]
    assert orders(spark, path) == ["A", "C"]


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_behind_a_row_lose_nothing(spark, order):
    rows = [(None if i % 3 else i // 6, f"d{i % 4}" if i % 5 else None, float(i % 7)) for i in range(90)] + [(None, "d1", 1.0)] * 5
    df = spark.createDataFrame(rows, "row_id long, name string, sales double")
    everything = [tuple(r) for r in tl.sort_rows(df, "name", order).collect()]
    found = [tuple(r) for r in tl.page(tl.sort_rows(df, "name", order), 1, 10).collect()]
    while len(found) < len(everything):
        last = dict(zip(df.columns, found[-1]))
        page = tl.page_after(df, last, "name", order, 10, shown=found.count(found[-1])).collect()
        assert page
        found += [tuple(r) for r in page]
    assert found == everything
    with pytest.raises(ValueError, match="whole last row"):
        tl.page_after(df, {"name": "d1"}, "name", order)


def test_far_pages_of_texts_and_without_sort_column(spark):
    df = spark.range(3000).selectExpr("id as row_id", "concat('n', cast(id % 700 as string)) as name", "cast(id % 10 as double) as sales")
    for by in ("name", "no such column"):
        keys = [F.asc_nulls_last(by)] if by == "name" else []
        everything = [r.row_id for r in df.orderBy(*keys, "row_id").collect()]
        for number in (1, 20, 59, 60, 61):
            rows, _ = tl.explore(df, number, 50, sort_by=by, sort_order="asc", top_k_rows=200)
            assert [r.row_id for r in rows.collect()] == everything[(number - 1) * 50 : number * 50]


def test_no_task_gets_all_rows_before_a_far_page(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id as row_id", "concat('n', cast(id as string)) as name")
    monkeypatch.setattr(sys.modules["tallyline.operators.explore"], "_sorted_rows", lambda *_: pytest.fail("all rows were sorted and kept"))
    rows, _ = tl.explore(df, 90, 50, sort_by="name", sort_order="asc", top_k_rows=400)
    plan = rows._jdf.queryExecution().toString()
    limits = [int(part.split("limit=")[1].split(",")[0].split(")")[0]) for part in plan.split("TakeOrderedAndProject(")[1:] if "limit=" in part.split("\n")[0]]
    assert limits and max(limits) <= 400


def test_annotations_are_stored(spark, tmp_path):
    path = str(tmp_path / "notes")
    assert [r.content for r in tl.stored_annotation(spark, path, "a").collect()] == ["Sin comentarios estratégicos registrados aún."]
    schema = "page_name string, content string, updated_by_name string, updated_at timestamp"
    notes = spark.createDataFrame([("a", "one", "Ana", None), ("b", "two", "Eva", None)], schema).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    assert tl.save_annotations(spark, notes, path) == 2
    assert tl.save_annotations(spark, notes.filter("page_name = 'a'").withColumns({"content": F.lit("new"), "updated_at": F.lit("2024-02-01").cast("timestamp")}), path) == 2
    assert {r.page_name: r.content for r in tl.stored_annotation(spark, path, ["a", "b"]).collect()} == {"a": "new", "b": "two"}


def test_broadcasts_are_bounded_in_bytes(spark):
    long = spark.range(50).select(F.repeat(F.lit("x"), 10_000).alias("t"), F.array(F.lit(1), F.lit(2)).alias("a"))
    hinted = lambda df, **b: "ResolvedHint" in broadcast_if_small(df, **b)._jdf.queryExecution().analyzed().toString()
    assert hinted(long) and not hinted(long, max_bytes=100_000) and not hinted(long, max_rows=10)
    assert hinted(long.limit(0))
