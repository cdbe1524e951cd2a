import datetime as dt
import io
import json
import random
import zipfile
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import tallyline as tl
from tallyline.plans.load import upload_csv
from tallyline.schema import INVOICE_LINES, UPLOAD_REQUIRED
from tallyline.session import checkpoint_dir
from tallyline.sources import invoices
from tallyline.sources.tables import stored_batches
from verification.queries import _zip_batches

HEADER = " Row ID , Order ID,Order Date,Ship Date,Category,Product Name, Sales ,Profit,Discount,Discount rate,City\n"


@pytest.fixture
def csv(tmp_path):
    def write(text, name="tx.csv"):
        path = tmp_path / name
        path.write_bytes(b"\xef\xbb\xbf" + text.encode())
        return str(path)

    return write


def test_csv_cells(spark, csv):
    path = csv(HEADER + '''1,A,01/13/2024,1/14/2024,Furniture,"say ""hi"", you","1,234.50",-12.3,40.00%,x,Puebla
2,B,13/01/2024,01/14/2024,Furniture,dropped,1,1,0%,x,Puebla
3,C,2/3/2024,N/A,NA, - ,(5),-,x,x,
4,NULL,2/3/2024,bad,Technology,nan,5d,$7,0.15,x,León
''')
    found = tl.canonical_csv(tl.read_transactions_csv(spark, path)).orderBy("row_id").collect()
    assert [r.row_id for r in found] == [1, 3, 4]
    one, three, four = [r.asDict() for r in found]
    assert (one["sales"], one["profit"], one["discount_rate"]) == (1234.5, -12.3, 0.4)
    assert one["discount_amount"] == pytest.approx(493.8)
    assert (one["product_name"], one["order_date"], one["City"]) == ('say "hi", you', dt.datetime(2024, 1, 13), "Puebla")
    assert (one["shipping_cost"], one["loss"], one["source"]) == (0.0, 0.0, "csv")
    assert (three["sales"], three["profit"], three["ship_date"], three["category"]) == (0.0, 0.0, None, None)
    assert (three["product_name"], three["City"]) == (" - ", None)
    assert (four["order_id"], four["sales"], four["profit"], four["discount_rate"]) == (None, 0.0, 0.0, 0.0015)
    assert four["product_name"] is None and "Discount rate" not in four


def test_csv_day_first(spark, csv):
    path = csv("Order Date,Ship Date,Sales,Profit,Category\n13/01/2024,14/01/2024,1,1,x\n01/13/2024,,1,1,x\n")
    found = tl.canonical_csv(tl.read_transactions_csv(spark, path), date_format="d/M/yyyy").collect()
    assert [r.order_date for r in found] == [dt.datetime(2024, 1, 13)]


def test_csv_line_breaks_in_quotes(spark, csv):
    """Only the file that needs it is read whole; the rows are the same."""
    csv('Order Date,Name,Sales\n1/1/2024,"two\nlines, ""quoted""\n",1\n1/2/2024,plain,2\n', "a.csv")
    folder = csv('Order Date,Name,Sales\n1/3/2024,"one ""line""",3\n1/4/2024,5" pipe,4\n', "b.csv").rsplit("/", 1)[0]
    auto = sorted(tuple(r) for r in tl.read_transactions_csv(spark, folder).collect())
    assert auto == [
        ("1/1/2024", 'two\nlines, "quoted"\n', "1"), ("1/2/2024", "plain", "2"), ("1/3/2024", 'one "line"', "3"),
        ("1/4/2024", '5" pipe', "4"),
    ]
    assert auto == sorted(tuple(r) for r in tl.read_transactions_csv(spark, folder, multi_line=True).collect())


def test_upload_checks_columns_and_replaces(spark, csv, tmp_path):
    path = str(tmp_path / "stored")
    with pytest.raises(tl.MissingColumns) as error:
        upload_csv(spark, csv("Sales,Profit,Category\n1,1,x\n"), path)
    assert error.value.missing == [c for c in UPLOAD_REQUIRED if c.endswith("Date")]
    text = "Sales,Profit,Order Date,Ship Date,Category\n"
    assert upload_csv(spark, csv(text + "1,1,1/1/2024,,x\n2,1,1/1/2023,,x\n"), path) == 2
    assert upload_csv(spark, csv(text + "5,1,1/1/2024,,x\n"), path) == 1
    assert [r.sales for r in tl.read_table(spark, path).collect()] == [5.0]


# --- invoices --------------------------------------------------------------


def invoice(uuid="U1", date="2024-01-05T10:20:30", lines="", attributes="", receiver='<r:Receptor Nombre="Ana &amp; Co"/>'):
    stamp = f'<t:TimbreFiscalDigital UUID="{uuid}"/>' if uuid else ""
    fecha = f' Fecha="{date}"' if date is not None else ""
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><r:Comprobante xmlns:r="urn:r" xmlns:t="urn:t"{fecha}{attributes}>'
        f"{receiver}<r:Conceptos>{lines}</r:Conceptos><r:Complemento>{stamp}</r:Complemento></r:Comprobante>"
    )


LINE = '<r:Concepto Importe="2.30" Descuento="0.20" ClaveProdServ="43211500" Cantidad="2.7" Descripcion="Cable"/>'
OTHER = '<r:Concepto Importe="10" ClaveProdServ="56101500" ClaveUnidad="H87"/>'


@pytest.fixture
def documents(spark):
    def build(*texts):
        rows = [("a.zip", i, f"{i}.xml", bytearray(t if isinstance(t, bytes) else t.encode())) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "archive string, member_no int, member string, xml binary")

    return build


def test_invoice_lines(documents):
    text = invoice(lines=LINE + OTHER, attributes=' LugarExpedicion="01500" MetodoPago="PPD"')
    lines = tl.parse_invoices(documents(text))
    assert lines.columns == INVOICE_LINES.fieldNames()
    first, second = [r.asDict() for r in lines.collect()]
    json_text = first.pop("raw_xml_data")
    assert first == {
        "order_id": "U1", "order_date": dt.datetime(2024, 1, 5, 10, 20, 30),
        "ship_date": dt.datetime(2024, 1, 6, 10, 20, 30), "ship_mode": "Estándar", "customer_name": "Ana & Co",
        "segment": None, "country": "CDMX", "market": None, "category": "Technology", "sub_category": "Unidad",
        "product_name": "Cable", "sales": 2.3, "quantity": 2, "discount_amount": 0.2, "profit": round(2.3 * 0.25, 2),
        "shipping_cost": 0.0, "order_priority": "Media", "perdida": 0.0, "discount_rate": 0.08, "metodo_pago": "PPD",
    }
    assert (second["category"], second["sub_category"], second["product_name"]) == (
        "Furniture", "H87", "Producto sin descripción",
    )
    assert (second["sales"], second["quantity"], second["discount_amount"], second["profit"]) == (10.0, 1, 0.0, 1.0)
    parsed = json.loads(json_text)
    assert json_text == second["raw_xml_data"] == json.dumps(parsed)
    assert parsed["LugarExpedicion"] == "01500" and len(parsed["Conceptos"]["Concepto"]) == 2


def test_last_line_compat(documents):
    found = tl.parse_invoices(documents(invoice(lines=LINE + OTHER)), compat="last_line").collect()
    assert [(r.category, r.profit, r.discount_rate, r.sales) for r in found] == [
        ("Furniture", 1.0, 0.0, 2.3), ("Furniture", 1.0, 0.0, 10.0),
    ]


def test_absent_parts_have_defaults(documents):
    no_name = invoice(uuid=None, receiver="<r:Receptor/>", lines="<r:Concepto/>")
    no_receiver = invoice(receiver="", lines="<r:Concepto/>")
    first, second = tl.parse_invoices(documents(no_name, no_receiver)).collect()
    assert (first.order_id, first.customer_name, first.country) == ("SIN-UUID", "Público en General", "CDMX")
    assert (first.metodo_pago, first.ship_mode, first.sales, first.category) == ("PUE", "Express", 0.0, "Office Supplies")
    assert second.customer_name == "N/A"


def test_any_depth_any_prefix_any_encoding(documents):
    deep = (
        '<Factura Fecha="2024-01-05"><x><Concepto Importe="1"/><y xmlns="urn:z"><Concepto Importe="2"/></y></x>'
        '<z><Receptor Nombre="primero"/></z><Receptor Nombre="segundo"/><TimbreFiscalDigital UUID="D"/></Factura>'
    )
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><C Fecha="2024-01-05"><Receptor Nombre="Peña"/><Concepto/></C>'
    found = tl.parse_invoices(documents(deep, latin.encode("latin-1"))).collect()
    assert [(r.order_id, r.customer_name, r.sales) for r in found] == [
        ("D", "primero", 1.0), ("D", "primero", 2.0), ("SIN-UUID", "Peña", 0.0),
    ]


def test_elements_are_read_without_a_tree(monkeypatch):
    """What is found without a tree is what a tree holds, and nothing is taken for XML that the tree's parser refuses."""
    inner = '<p:Receptor Nombre="\u00f1 &amp; &lt;"/><Concepto Importe=" 1 " p:Importe="2"/><c><d><Concepto/></d></c>text<!-- <Concepto/> -->'
    whole = f'<p:Comprobante xmlns:p="urn:p" Fecha="x">{inner}</p:Comprobante>'
    entity = '<!DOCTYPE a [<!ENTITY e "five">]><a Fecha="&e;"><Concepto Descripcion="&e;"/></a>'
    outside = '<!DOCTYPE a SYSTEM "a.dtd"><a><Concepto/>&unknown;</a>'
    texts = [
        whole.encode(), f'<?xml version="1.0" encoding="ISO-8859-1"?>{whole}'.encode("latin-1"), whole.encode("utf-16"), b"\xef\xbb\xbf" + whole.encode(),
        f'<?xml version="1.0" encoding="nope"?>{whole}'.encode(), f'<?xml version="1.0" encoding="cp1252"?>{whole}'.encode("cp1252"),
        whole.encode() + b"<a/>", whole.encode()[:-1], whole.encode("latin-1"), b"", b" ", b"plain", b'<a b="1" b="2"/>', b"<x:a/>", b"<a>&unknown;</a>",
        entity.encode(), outside.encode(), b"<a>\0</a>", whole, None, b"<Concepto Importe='3'/>", b"<a>" * 500 + b"</a>" * 500,
    ]
    for text in texts:
        root = invoices._root(text)
        wanted = None if root is None else [
            (name if name in invoices._NODES else "", node.attrib.get("Importe"), node.attrib.get("Fecha"), node.attrib.get("Nombre"), node.attrib.get("Descripcion"))
            for node in root.iter() if (name := node.tag.rpartition("}")[2]) in invoices._NODES or node is root
        ]
        found = invoices._starts(text, {})
        found = found and [(n, a.get("Importe"), a.get("Fecha"), a.get("Nombre"), a.get("Descripcion")) for n, a in found]
        assert found == wanted, text
    # No tree is built of a usual document.
    monkeypatch.setattr(invoices, "_root", None)
    assert [name for name, _ in invoices._starts(whole.encode(), {})] == ["", "Receptor", "Concepto", "Concepto"]


def test_held_back_documents(documents):
    texts = [
        invoice("ok", lines=LINE), "<broken", b"", invoice("empty"), invoice("bad", lines=LINE + '<r:Concepto Importe="x"/>'),
        invoice("bad2", lines='<r:Concepto Cantidad=""/>'), invoice("date", date="5 de enero", lines=LINE),
        invoice("none", date=None, lines=LINE),
    ]
    docs = tl.read_documents(documents(*texts))
    assert [r.problem for r in docs.orderBy("member_no").collect()] == [
        None, "malformed", "malformed", "no lines", "bad number", "bad number", "bad date", "bad date",
    ]
    assert [r.order_id for r in tl.invoice_lines(docs).collect()] == ["ok"]
    assert tl.quarantine(docs).count() == 6
    dated = tl.parse_invoices(documents(*texts), on_bad_date="2000-01-01 00:00:00")
    assert {r.order_id for r in dated.collect()} == {"ok", "date", "none"}
    with pytest.raises(Exception, match="bad number in invoice bad"):
        tl.parse_invoices(documents(*texts), fail_fast=True).collect()


def test_json_keeps_everything_as_text(documents):
    text = '<a n="01000" b="x" xmlns:q="urn:q" q:z="1">text<b k="1"/><b/><!-- c --><q:c><d/>tail</q:c></a>'
    found = tl.invoice_to_json(documents(text, "<no")).orderBy("member_no").collect()
    assert found[0].invoice_json == '{"n": "01000", "b": ["x", {"k": "1"}, {}], "{urn:q}z": "1", "c": {"d": {}}}'
    assert found[1].invoice_json is None


def write_zip(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members:
            archive.writestr(name, text)


def test_archives_and_loose_files(spark, tmp_path):
    write_zip(tmp_path / "one.zip", [("b.xml", invoice("B", lines=LINE)), ("note.txt", "no"), ("d/a.xml", invoice("A"))])
    write_zip(tmp_path / "two.zip", [("c.XML", "upper case is no invoice")])
    (tmp_path / "loose.xml").write_text(invoice("L", lines=OTHER))
    members = tl.read_invoice_archives(spark, str(tmp_path)).collect()
    assert sorted((r.member_no, r.member) for r in members) == [(0, "b.xml"), (2, "d/a.xml")]
    assert [r.order_id for r in tl.parse_invoices(tl.read_invoice_files(spark, str(tmp_path))).collect()] == ["L"]


def test_large_archive_comes_in_batches(spark, tmp_path, monkeypatch):
    write_zip(tmp_path / "many.zip", [(f"{i}.xml", invoice(f"U{i}", lines=LINE)) for i in range(2500)])
    assert tl.read_invoice_archives(spark, str(tmp_path), partitions=3).count() == 2500


# --- duplicates and intake --------------------------------------------------


def test_intake(spark, documents, tmp_path):
    path = str(tmp_path / "lines")
    first = documents(
        invoice("A", lines=LINE), invoice("A", lines=OTHER), invoice(None, lines=LINE), invoice(None, lines=LINE),
        invoice("E"), "<broken", invoice("B", lines=LINE + OTHER), invoice("X", lines='<r:Concepto Importe="?"/>'),
    )
    result = tl.intake_invoices(first, path)
    assert result["report"] == {"records_inserted": 5, "invoices_skipped": 1, "documents_held": 2}
    assert {r.problem for r in result["quarantine"].collect()} == {"malformed", "bad number"}
    stored = tl.read_invoice_lines(spark, path).orderBy("row_id").collect()
    assert [r.row_id for r in stored] == [1, 2, 3, 4, 5]
    assert [r.category for r in stored if r.order_id == "A"] == ["Technology"]

    again = documents(invoice("B", lines=OTHER), invoice("C", lines=OTHER), invoice("X", lines=OTHER))
    assert tl.intake_invoices(again, path)["report"] == {
        "records_inserted": 2, "invoices_skipped": 1, "documents_held": 0,
    }
    assert {r.row_id for r in tl.read_invoice_lines(spark, path).collect()} == set(range(1, 8))


def test_placeholder_is_a_key_in_literal_mode(spark, documents, tmp_path):
    path = str(tmp_path / "lines")
    docs = documents(invoice(None, lines=LINE), invoice(None, lines=LINE))
    assert tl.intake_invoices(docs, path, literal=True)["report"]["records_inserted"] == 1
    assert tl.intake_invoices(docs, path, literal=True)["report"]["invoices_skipped"] == 2


def test_duplicates_match_brute_force_with_a_hot_key(spark):
    random.seed(6)
    docs, seen, expected = [], {"k1", "k9"}, set()
    for number in range(900):
        key = "hot" if number % 3 == 0 else f"k{random.randint(0, 200)}"
        identity = (f"{random.randint(0, 3)}.zip", number, "m")
        docs.append((*identity, key, random.random() > 0.1, random.choice([None, None, None, "bad number"])))
    for archive, number, member, key, has_uuid, problem in sorted(docs, key=lambda d: d[:3]):
        if problem:
            continue
        if not has_uuid or key not in seen:
            expected.add((archive, number))
        if has_uuid:
            seen.add(key)
    schema = "archive string, member_no int, member string, order_id string, has_uuid boolean, problem string"
    frame = spark.createDataFrame(docs, schema).repartition(6)
    existing = spark.createDataFrame([("k1",), ("k9",), ("k9",), ("zz",)], "order_id string")
    fresh, _ = tl.suppress_duplicates(frame, existing)
    assert {(r.archive, r.member_no) for r in fresh.filter("problem is null").collect()} == expected


def test_canonical_modes(documents, spark):
    lines = tl.parse_invoices(documents(invoice(lines=LINE)))
    by_amount = tl.canonical_invoices(lines).first()
    assert by_amount.discount_rate == pytest.approx(0.2 / 2.3) and by_amount.discount_amount == 0.2
    assert tl.canonical_invoices(lines, rate="stored").first().discount_rate == 0.08
    literal = tl.canonical_invoices(lines, compat="literal").first()
    assert (literal.discount_amount, literal.discount_rate, literal.ship_date, literal.ship_mode) == (0.0, 0.0, None, None)


def test_load_both_sources(spark, csv, documents, tmp_path):
    path = str(tmp_path / "lines")
    tl.intake_invoices(documents(invoice(lines=LINE)), path)
    tx = tl.load_transactions(spark, csv("Order Date,Sales\n1/1/2024,5\n"), path)
    assert sorted((r.source, r.sales) for r in tx.collect()) == [("csv", 5.0), ("xml", 2.3)]
    assert tl.load_transactions(spark, invoices_path=path).count() == 1
    stored = tl.store_transactions(tx, str(tmp_path / "tx"))
    assert tl.kpis(stored).first().gross_revenue == 7.3
    with pytest.raises(ValueError):
        tl.load_transactions(spark)


def test_stream_takes_each_archive_once(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / name) for name in ("in", "lines", "state"))
    (tmp_path / "in").mkdir()
    write_zip(tmp_path / "in" / "1.zip", [("a.xml", invoice("A", lines=LINE)), ("b.xml", invoice("B", lines=LINE))])
    tl.start_invoice_intake(spark, source, path, checkpoint).awaitTermination(120)
    write_zip(tmp_path / "in" / "2.zip", [("b.xml", invoice("B", lines=LINE)), ("c.xml", invoice("C", lines=LINE + OTHER))])
    tl.start_invoice_intake(spark, source, path, checkpoint).awaitTermination(120)
    stored = tl.read_invoice_lines(spark, path)
    assert sorted(r.order_id for r in stored.collect()) == ["A", "B", "C", "C"]
    # A batch that is repeated after a failure finds its part stored.
    lines = stored.drop("row_id", "order_year")
    first = stored_batches(spark, path)[0].name
    assert first.startswith("invoices-") and first.endswith("-0") and "None" not in first
    assert tl.append_invoice_lines(lines, path, part=first) == 0
    # The same stream with a new checkpoint starts over and skips by invoice.
    tl.start_invoice_intake(spark, source, path, str(tmp_path / "other")).awaitTermination(120)
    assert tl.read_invoice_lines(spark, path).count() == 4


def drain(spark, tmp_path, state="state", **options):
    archives = tl.stream_archives(spark, str(tmp_path / "in"))
    documents, path = str(tmp_path / "documents"), str(tmp_path / "lines")
    tl.start_document_stream(archives, documents, str(tmp_path / "state" / "documents")).awaitTermination(120)
    tl.start_keyed_intake(spark, documents, path, str(tmp_path / state / "intake"), **options).awaitTermination(120)
    return tl.read_invoice_lines(spark, path)


def test_stream_remembers_invoices_as_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = invoice("A", lines=LINE)
    write_zip(tmp_path / "in" / "1.zip", [("a.xml", one), ("a2.xml", invoice("A", lines=LINE + OTHER)), ("b.xml", invoice("B", lines=LINE)), ("bad.xml", "<x")])
    write_zip(tmp_path / "in" / "0.zip", [("u.xml", invoice(None, lines=LINE)), ("v.xml", invoice(None, lines=LINE)), ("b.xml", invoice("B", lines=LINE + OTHER))])
    first = drain(spark, tmp_path)
    # The first by archive and member stays: A of a.xml (one line), B of 0.zip (two); documents without a stamp both do.
    assert sorted(r.order_id for r in first.collect()) == ["A", "B", "B"] + ["SIN-UUID"] * 2
    assert drain(spark, tmp_path).count() == 5
    # The same archive under another name, sorted before all others, and one new invoice.
    write_zip(tmp_path / "in" / "+.zip", [("a.xml", one), ("c.xml", invoice("C", lines=LINE)), ("u.xml", invoice(None, lines=LINE))])
    second = drain(spark, tmp_path)
    assert sorted(r.order_id for r in second.collect()) == ["A", "B", "B", "C"] + ["SIN-UUID"] * 3
    assert sorted(r.row_id for r in second.collect()) == list(range(1, 8))
    # The state is what tells: no stored key is read for what this query stored itself. With its state lost the stored keys do.
    third = drain(spark, tmp_path, state="lost", literal=True)
    assert sorted(r.order_id for r in third.collect()) == sorted(r.order_id for r in second.collect())


def test_stream_state_against_plain_reading(spark, tmp_path):
    """In order of arrival, with an invoice that a third of the documents hold; then in batches of one file."""
    (tmp_path / "in").mkdir()
    random.seed(4)
    expected = {}
    for number in range(3):
        members = []
        for at in range(30):
            key, lines = "hot" if at % 3 == 0 else f"K{random.randint(0, 30)}", random.choice([LINE, LINE + OTHER])
            expected.setdefault(key, 1 if lines == LINE else 2)
            members.append((f"{at:02}.xml", invoice(key, lines=lines)))
        write_zip(tmp_path / "in" / f"{9 - number}.zip", members)
        stored = drain(spark, tmp_path)
    assert {r.order_id: r["count"] for r in stored.groupBy("order_id").count().collect()} == expected
    other = str(tmp_path / "other")
    tl.start_keyed_intake(spark, str(tmp_path / "documents"), other, str(tmp_path / "state" / "other"), files_per_batch=1).awaitTermination(120)
    assert len(stored_batches(spark, other)) > 1
    found = tl.read_invoice_lines(spark, other).groupBy("order_id").agg(F.count_distinct("raw_xml_data").alias("documents")).collect()
    assert {r.order_id: r.documents for r in found} == dict.fromkeys(expected, 1)


def checkpoints(spark):
    checkpoint_dir(spark)
    return {f.name for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("rdd-*")}


def test_intake_keeps_documents_packed(spark, documents, tmp_path):
    """No checkpoint, which would hold each document and key as plain bytes."""
    docs = documents(*[invoice(f"I{i % 9}", lines=LINE + OTHER) for i in range(12)])
    before = checkpoints(spark)
    report = tl.intake_invoices(docs, str(tmp_path / "lines"))["report"]
    assert report["records_inserted"] == 18 and report["invoices_skipped"] == 3
    assert sorted(r.row_id for r in tl.read_invoice_lines(spark, str(tmp_path / "lines")).collect()) == list(range(1, 19))
    assert not checkpoints(spark) - before


def test_state_of_invoices_lies_on_disk_in_any_session(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    set_before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        (tmp_path / "in").mkdir()
        write_zip(tmp_path / "in" / "1.zip", [("a.xml", invoice("A", lines=LINE))])
        archives = tl.stream_archives(spark, str(tmp_path / "in"))
        tl.start_document_stream(archives, str(tmp_path / "documents"), str(tmp_path / "s1")).awaitTermination(120)
        query = tl.start_keyed_intake(spark, str(tmp_path / "documents"), str(tmp_path / "lines"), str(tmp_path / "s2"))
        assert spark.conf.get(key, None) is None
        query.awaitTermination(120)
        assert any(name.startswith("rocksdb") for name in query.lastProgress["stateOperators"][0]["customMetrics"])
    finally:
        spark.conf.set(key, set_before)


def test_made_archives_are_small_cells():
    batch = pd.DataFrame({"member": [f"m{i}" for i in range(1203)], "xml": [b"<a/>"] * 1203})
    made = list(_zip_batches([batch]))
    names = [[n for n in zipfile.ZipFile(io.BytesIO(m["content"][0])).namelist() if n.endswith(".xml")] for m in made]
    assert [len(n) for n in names] == [500, 500, 203] and sum(names, []) == [f"m{i}.xml" for i in range(1203)]


# --- maintenance --------------------------------------------------------------


def test_stored_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        tl.read_table(spark, path)
    rows = spark.range(10).select(F.col("id").alias("row_id"), F.lit(None).cast("timestamp_ntz").alias("order_date"))
    assert tl.replace_dataset(rows, path, ["row_id"]) == 10
    with pytest.raises(tl.MissingColumns):
        tl.replace_dataset(rows, path, ["row_id", "sales"])
    assert tl.delete_rows(spark, path, [3, 3, 4, 99]) == 2
    assert tl.delete_rows(spark, path, [3]) == 0
    assert sorted(r.row_id for r in tl.read_table(spark, path).collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        tl.delete_rows(spark, path, [])
    assert tl.replace_dataset(tl.read_table(spark, path), path, []) == 8
    assert tl.replace_dataset(rows.limit(0), path, []) == 0
    assert tl.read_table(spark, path).count() == 0 and "row_id" in tl.read_table(spark, path).columns


def test_stored_files_are_sorted_by_date(spark, tmp_path):
    days = spark.range(5000).select(
        (F.lit("2023-06-01").cast("date") + (F.col("id") * 7919 % 400).cast("int")).cast("timestamp_ntz").alias("order_date")
    )
    tl.replace_dataset(days.repartition(4), str(tmp_path / "t"), [])
    stored = tl.read_table(spark, str(tmp_path / "t"))
    placed = stored.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    files = {}
    for r in placed.orderBy("at").collect():
        files.setdefault(r.file, []).append(r.order_date)
    assert sum(len(dates) for dates in files.values()) == 5000
    assert all(dates == sorted(dates) for dates in files.values())


def test_delete_by_ids(spark):
    kept, found = tl.delete_by_ids(spark.range(5).withColumnRenamed("id", "row_id"), [1, 4, 7])
    assert [r.row_id for r in kept.collect()] == [0, 2, 3] and found.first().deleted_count == 2


def test_annotations(spark):
    schema = "page_name string, content string, updated_by_name string, updated_at timestamp_ntz"
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    current = spark.createDataFrame([("a", "first", "Ana", new), ("b", "b", "Ana", old)], schema)
    changes = spark.createDataFrame([("a", "late", "Eva", old), ("b", "newer", "Eva", new), ("c", "c", "Eva", old)], schema)
    table = tl.upsert_annotations(current, changes)
    assert sorted((r.page_name, r.content) for r in table.collect()) == [("a", "first"), ("b", "newer"), ("c", "c")]
    assert tuple(tl.latest_annotation(table, "none").first()) == (
        "none", "Sin comentarios estratégicos registrados aún.", "Sistema",
    )
    assert tl.latest_annotation(table, ["a", "b"]).count() == 2


def test_snapshot_changes(spark):
    schema = "id int, email string, status string, role string"
    old = spark.createDataFrame([(1, "a", "pending", "viewer"), (2, "b", "active", None), (3, "c", "active", "admin"),
                                 (4, "d", "active", None)], schema)
    new = spark.createDataFrame([(1, "a2", "active", "viewer"), (2, "b", "active", "admin"), (4, "d2", "active", None),
                                 (5, "e", "pending", "viewer")], schema)
    log = tl.snapshot_changes(old, new, "id", {"status": "Status", "role": "Role"}, carry=["email"])
    assert sorted(tuple(r) for r in log.collect()) == [
        (1, "a2", "MODIFICACION_GOBERNANZA", "Status: pending->active | Role: viewer->viewer"),
        (2, "b", "MODIFICACION_GOBERNANZA", "Status: active->active | Role: None->admin"),
        (3, "c", "ELIMINACION_USUARIO", "Usuario eliminado permanentemente por el administrador."),
    ]


def test_change_log_is_appended(spark, tmp_path):
    schema = "id int, email string, status string"
    old = spark.createDataFrame([(1, "a", "pending"), (2, "b", "active")], schema)
    new = spark.createDataFrame([(1, "a", "active")], schema)
    changes = tl.snapshot_changes(old, new, "id", {"status": "Status"}, carry=["email"])
    for _ in range(2):
        tl.append_change_log(changes, str(tmp_path / "log"), "7", "Ana")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.columns == [
        "admin_id", "admin_name", "target_user_id", "target_user_email", "action", "details", "timestamp",
    ]
    assert log.count() == 4 and log.filter("admin_name = 'Ana' and timestamp is not null").count() == 4


def test_newest_first(spark):
    df = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1)), (3, dt.datetime(2024, 1, 2))], "id int, at timestamp_ntz")
    assert [r.id for r in tl.newest_first(df, "at", "id").collect()] == [3, 2, 1]
