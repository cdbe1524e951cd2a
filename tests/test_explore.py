import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import tallyline as tl


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(4)
    data = [
        (i, f"O-{i % 40}", dt.datetime(2024, 1, 1) + dt.timedelta(days=random.choice([0, 0, 0, 5, 9])),
         random.choice(["Ángel", "berta", None]), random.choice([1.5, 2e8, None]))
        for i in range(311)
    ]
    schema = "row_id long, order_id string, order_date timestamp_ntz, customer_name string, sales double"
    return spark.createDataFrame(data, schema).repartition(5).cache()


def ids(df):
    return [r.row_id for r in df.collect()]


def test_search_looks_into_every_column(rows):
    assert tl.search_any(rows, "ÁNGEL").count() == rows.filter("customer_name = 'Ángel'").count()
    assert tl.search_any(rows, "200000000").count() == rows.filter("sales = 2e8").count()
    assert tl.search_any(rows, "2024-01-06").count() == rows.filter("order_date = '2024-01-06'").count()
    assert tl.search_any(rows, "^o-1$|BERTA").count() == rows.filter("order_id = 'O-1' or customer_name = 'berta'").count()
    assert tl.search_any(rows, "").count() == rows.count()
    assert tl.search_any(rows, "berta", ["order_id"]).count() == 0


def test_missing_cells_never_match(rows):
    assert tl.search_any(rows.select("customer_name"), "nan|none|null").count() == 0
    assert tl.filter_columns(rows, {"sales": "."}).count() == rows.filter("sales is not null").count()


def test_column_filters(rows):
    found = tl.filter_columns(rows, {"customer_name": "Berta", "order_id": "1$", "page": "x", "nothing": "x", "sales": ""})
    assert found.count() == rows.filter("customer_name = 'berta' and order_id like '%1'").count()


def test_sort(rows):
    assert ids(tl.sort_rows(rows, "row_id", "asc")) == list(range(311))
    assert ids(tl.sort_rows(rows, "row_id", "anything")) == list(range(310, -1, -1))
    assert tl.sort_rows(rows, "nothing") is rows
    for order in ("asc", "desc"):
        names = [r.customer_name for r in tl.sort_rows(rows, "customer_name", order).collect()]
        assert names[-1] is None and names[0] is not None


@pytest.mark.parametrize("by,order", [("order_date", "desc"), ("sales", "asc"), ("customer_name", "desc"), ("row_id", "desc")])
def test_pages_partition_the_rows(rows, by, order):
    everything = ids(tl.sort_rows(rows, by, order))
    pages = [ids(tl.page(tl.sort_rows(rows, by, order), n, 50)) for n in range(1, 8)]
    assert [i for page in pages for i in page] == everything
    assert len(set(everything)) == 311
    for bound in (100_000, 120, 0):  # top-k only; slices and top-k; slices and sorted partitions
        for number in (1, 4, 7, 8):
            assert ids(tl.deep_page(rows, number, 50, by, order, bound)) == everything[(number - 1) * 50:number * 50]
    walked, last = [], None
    while True:
        found = (tl.page(tl.sort_rows(rows, by, order), 1, 50) if last is None
                 else tl.page_after(rows, last, by, order, 50)).collect()
        if not found:
            break
        walked += [r.row_id for r in found]
        last = found[-1].asDict()
    assert walked == everything


def test_counts(rows, spark):
    def info(n, limit, **options):
        return tuple(tl.page_info(spark.range(n), limit, **options).first())

    assert [info(0, 50), info(50, 50), info(51, 50)] == [(0, 0), (50, 1), (51, 2)]
    assert [info(50, 50, compat="literal"), info(49, 50, compat="literal")] == [(50, 2), (49, 1)]
    assert info(5, 0) == (5, 1)


def test_explore(rows):
    page, counts = tl.explore(rows, 2, 10, search="berta", sort_by="row_id", sort_order="asc", filters={"order_id": "1"})
    wanted = rows.filter("customer_name = 'berta' and order_id like '%1%'")
    assert ids(page) == sorted(ids(wanted))[10:20]
    assert counts.first().total == wanted.count()


def test_explorer_shows_no_infinities(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, None), (3, 2.0)], "row_id long, sales double")
    shown, _ = tl.explore(df, sort_by="sales", sort_order="asc")
    assert [tuple(r) for r in shown.collect()] == [(3, 2.0), (1, 0.0), (2, None)]


def test_audit_export(spark):
    schema = (
        "row_id long, order_id string, order_date timestamp_ntz, customer_name string, sales double, profit double, "
        "discount_rate double, invoice_json string, payment_method string, ship_date timestamp_ntz"
    )
    day = dt.datetime(2024, 3, 5)
    tx = spark.createDataFrame(
        [(0, "0", day, None, None, float("nan"), 0.1234, '{"a": "1"}', "PUE", None),
         (7, "X", None, "Ana", 2.5, -1.0, None, None, "0", day)], schema
    )
    first, second = [r.asDict() for r in tl.audit_export(tx).collect()]
    assert list(first) == [
        "Row ID", "Order ID", "Fecha", "Cliente", "Categoría", "Sub-Categoría", "Producto", "Estado / Región", "Ventas",
        "Utilidad", "Pérdida", "Monto Descuento", "Tasa Descuento", "Método de Pago", "Fecha de Envío", "Modo de Envío",
        "Prioridad", "Metadata XML",
    ]
    assert (first["Row ID"], first["Order ID"], first["Fecha"], first["Cliente"]) == ("-", "-", "2024-03-05T00:00:00", "-")
    assert (first["Ventas"], first["Utilidad"], first["Pérdida"], first["Tasa Descuento"]) == (0.0, 0.0, 0.0, "12.34%")
    assert (first["Metadata XML"], second["Metadata XML"]) == ('{"a": "1"}', "Sin datos XML")
    assert (second["Row ID"], second["Tasa Descuento"], second["Método de Pago"]) == ("7", "0.00%", "-")
    assert second["Fecha de Envío"] == "2024-03-05T00:00:00"
    assert tl.audit_export(tx, pretty=True).first()["Metadata XML"] == '{\n  "a": "1"\n}'


def test_export_file_survives_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([('say "a", b\nnext', "Ñ")], "`Producto` string, `Cliente` string")
    tl.write_export(df, str(tmp_path / "out"))
    back = tl.read_transactions_csv(spark, str(tmp_path / "out"))
    assert tuple(back.first()) == ('say "a", b\nnext', "Ñ")
    assert back.filter(F.col("Cliente") == "Ñ").count() == 1
