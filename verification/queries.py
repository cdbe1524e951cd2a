"""One query per operator over the shared test tables.

Each takes (spark, sf_dir), reads whole tables, and returns plain columns:
timestamps as text and unrounded doubles cut to four decimals (the test data
has at most four), so that any engine's sums compare equal.
"""

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tallyline as tl
from tallyline.fixtures import table, transactions
from tallyline.functions.numbers import number_text
from tallyline.schema import CSV_COLUMNS, INVOICE_LINES
from tallyline.session import scratch_path, staged
from tallyline.sources.tables import number_rows, rename


def plain(df):
    """Result columns in types every engine prints alike."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 4) + F.lit(0.0)
        elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        columns.append(c.alias(field.name))
    return df.select(*columns)


# --- key figures, seasonality, categories -----------------------------------


def kpis(spark, sf):
    return tl.kpis(transactions(spark, sf, "order_id", "order_date", "sales", "profit"))


def monthly_seasonality(spark, sf):
    return tl.monthly_seasonality(transactions(spark, sf, "order_date", "ship_date", "sales"))


def category_performance(spark, sf):
    return tl.category_performance(transactions(spark, sf, "ship_date", "category", "sales", "profit", "loss"))


def subcategory_ranking(spark, sf):
    return tl.subcategory_ranking(transactions(spark, sf, "order_date", "sub_category", "sales", "profit"))


def previous_year_rows(spark, sf):
    return tl.year_slice(transactions(spark, sf, "order_id", "order_date", "sales"), offset=1)


# --- products -----------------------------------------------------------------


def product_totals(spark, sf):
    return tl.product_totals(transactions(spark, sf, "product_name", "sales", "profit"))


def product_discounts(spark, sf):
    return tl.product_discounts(transactions(spark, sf, "product_name", "sales", "profit", "loss"))


def top_shipping(spark, sf):
    return tl.top_shipping(transactions(spark, sf, "product_name", "sales", "shipping_cost", "profit", "order_id"))


def top_losses(spark, sf):
    return tl.top_losses(product_totals(spark, sf))


def bottom_products(spark, sf):
    return tl.bottom_products(product_totals(spark, sf))


def top_discounts(spark, sf):
    return tl.top_discounts(product_discounts(spark, sf))


# --- discount bands -------------------------------------------------------------


def _rates(spark, sf, measure, wide=True):
    return transactions(spark, sf, "discount_rate", measure, wide_rate=wide)


def discount_band_loss(spark, sf):
    return tl.discount_band_loss(_rates(spark, sf, "loss"))


def discount_band_profit(spark, sf):
    return tl.discount_band_profit(_rates(spark, sf, "profit"))


def discount_band_profit_empty_bands(spark, sf):
    return tl.discount_band_profit(_rates(spark, sf, "profit", wide=False))


def discount_band_profit_float32(spark, sf):
    return tl.discount_band_profit(_rates(spark, sf, "profit", wide=False), compat="float32")


def discount_band_leak_loss(spark, sf):
    return tl.discount_band_leak(_rates(spark, sf, "loss"), "loss")


def discount_band_leak_profit(spark, sf):
    return tl.discount_band_leak(_rates(spark, sf, "profit"), "profit")


def discount_impact(spark, sf):
    """Both measures by band, from one pass."""
    tx = transactions(spark, sf, "discount_rate", "loss", "profit", wide_rate=True)
    impact = tl.discount_impact(tx)
    return impact["loss"].join(impact["profit"].drop("band"), "band_ord")


def discount_bands_by_row(spark, sf):
    rates = transactions(spark, sf, "discount_rate", wide_rate=True)
    band = tl.discount_band(F.col("discount_rate"))
    return rates.groupBy(band.alias("band")).agg(F.count("*").alias("lines"))


# --- customers --------------------------------------------------------------------


def _customers(spark, sf):
    return tl.customer_totals(transactions(spark, sf, "customer_name", "order_id", "sales", "profit"))


def customer_totals(spark, sf):
    return _customers(spark, sf)


def customer_list(spark, sf):
    return tl.customer_list(_customers(spark, sf))


def top_profit_customers(spark, sf):
    return tl.customer_ranking(_customers(spark, sf), "profit")


def top_revenue_customers(spark, sf):
    return tl.customer_ranking(_customers(spark, sf), "sales")


def bottom_profit_customers(spark, sf):
    return tl.customer_ranking(_customers(spark, sf), "profit", ascending=True)


def bottom_revenue_customers(spark, sf):
    return tl.customer_ranking(_customers(spark, sf), "sales", ascending=True)


def vip_customers(spark, sf):
    return tl.vip_customers(tl.shared(_customers(spark, sf)), k=200)


def critical_customers(spark, sf):
    return tl.critical_customers(tl.shared(_customers(spark, sf)), k=200)


def segment_customers(spark, sf):
    return tl.segment_customers(tl.shared(_customers(spark, sf)), k=200)


# --- countries ----------------------------------------------------------------------


def _countries(spark, sf):
    return tl.country_totals(transactions(spark, sf, "country", "order_id", "sales", "profit", "shipping_cost"))


def country_totals(spark, sf):
    return _countries(spark, sf)


def shipping_margin(spark, sf):
    return tl.shipping_margin(_countries(spark, sf))


def market_leader(spark, sf):
    return tl.market_leader(_countries(spark, sf))


def market_bubble(spark, sf):
    return tl.market_bubble(_countries(spark, sf))


def bottom_countries(spark, sf):
    return tl.bottom_countries(_countries(spark, sf))


def critical_geography(spark, sf):
    return tl.critical_geography(transactions(spark, sf, "customer_name", "country", "profit"))


# --- whole reports ------------------------------------------------------------------


def dashboard(spark, sf):
    """Every list of the dashboard under its name, one below the other; the key figures' margin is a text."""
    lists = tl.dashboard(staged(transactions(spark, sf, wide_rate=True), "tx"))
    lists["kpis"] = lists["kpis"].withColumnRenamed("profit_margin", "margin_text")
    parts = [df.select(F.lit(name).alias("list"), *[F.col(f"`{c}`").alias(c.lower()) for c in df.columns]) for name, df in lists.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- explorer -----------------------------------------------------------------------


def _documents_tx(spark, sf):
    return transactions(spark, sf, "order_id", "order_date", "customer_name", "country", "product_name", "sales")


def search_any(spark, sf):
    return tl.search_any(_documents_tx(spark, sf), "RED w|_24$|1999-0[1-3]-1")


def filter_columns(spark, sf):
    return tl.filter_columns(
        _documents_tx(spark, sf), {"customer_name": "000[12]", "country": "nation_1", "page": "9", "no_such": "x"}
    )


def sorted_page(spark, sf):
    return tl.page(tl.sort_rows(_documents_tx(spark, sf), "sales", "asc"), 3, 100)


def deep_page(spark, sf):
    """A page found by its value range."""
    return tl.deep_page(_documents_tx(spark, sf), 101, 50, top_k_rows=1000)


def deep_page_by_name(spark, sf):
    """A page found by ranges of names."""
    return tl.deep_page(_documents_tx(spark, sf), 91, 50, by="customer_name", order="asc", top_k_rows=1000)


def page_after(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("order_date"), "o_totalprice"
    )
    end_of_1998 = spark.range(1).select(F.expr("timestamp_ntz'1998-12-31 00:00:00'").alias("at")).first()["at"]
    return tl.page_after(orders, {"order_date": end_of_1998, "row_id": 100}, "order_date", "desc", 500)


def page_after_ties(spark, sf):
    """The page behind page 10, found by its last row: dates tie, and there is no id."""
    tx = _documents_tx(spark, sf)
    tenth = tl.page(tl.sort_rows(tx, "order_date", "desc"), 10, 50).collect()
    last = tenth[-1].asDict()
    return tl.page_after(tx, last, "order_date", "desc", 50, shown=sum(row == tenth[-1] for row in tenth))


def explore_far_page(spark, sf):
    rows, _ = tl.explore(_documents_tx(spark, sf), 101, 50, sort_by="product_name", sort_order="asc", top_k_rows=1000)
    return rows


def page_info(spark, sf):
    return tl.page_info(tl.search_any(_documents_tx(spark, sf), "widget"), 50)


def page_info_literal(spark, sf):
    return tl.page_info(_documents_tx(spark, sf), 100, compat="literal")


def explore_rows(spark, sf):
    rows, _ = tl.explore(_documents_tx(spark, sf), 2, 50, search="gizmo", filters={"country": "nation_7$"})
    return rows


def explore_counts(spark, sf):
    _, counts = tl.explore(_documents_tx(spark, sf), 2, 50, search="gizmo", filters={"country": "nation_7$"})
    return counts


def audit_export(spark, sf):
    return tl.audit_export(transactions(spark, sf))


def _with_documents(spark, sf):
    """Transactions with a payment method and a document; some documents are missing, in the three ways they can be."""
    tx = transactions(spark, sf)
    document = F.to_json(F.struct(
        F.col("order_id").alias("Folio"), F.struct(F.concat(F.lit('say "'), "customer_name", F.lit('"')).alias("Nombre")).alias("Receptor"),
        F.struct(F.array(F.struct(F.col("quantity").cast("string").alias("Cantidad"))).alias("Concepto")).alias("Conceptos"),
    ))
    missing = F.when(F.col("quantity") == 7, "0").when(F.col("quantity") == 8, "-").when(F.col("quantity") != 9, document)
    return tx.withColumns({"invoice_json": missing, "payment_method": F.when(F.col("quantity") % 2 == 0, "PPD").when(F.col("quantity") % 3 == 0, "0")})


def audit_export_documents(spark, sf):
    """The export of rows with documents and payment methods."""
    return tl.audit_export(_with_documents(spark, sf)).select("Order ID", "Ventas", "Método de Pago", "Metadata XML")


def document_fields(spark, sf):
    json = F.col("invoice_json")
    return _with_documents(spark, sf).select(
        "order_id", tl.document_field(json, "$.Receptor.Nombre").alias("receiver"),
        tl.document_field(json, "$.Conceptos.Concepto[0].Cantidad", "int").alias("quantity"), tl.document_field(json, "$.Emisor.Nombre").alias("issuer"),
    )


# --- expressions ----------------------------------------------------------------------


def date_functions(spark, sf):
    order, ship = F.col("order_date"), F.col("ship_date")
    return transactions(spark, sf, "order_id", "order_date", "ship_date").select(
        "order_id",
        tl.lead_days(order, ship).alias("lead_days"),
        tl.month_label(F.month(order)).alias("month_label"),
        tl.estimated_ship_date(order).alias("estimated"),
        tl.short_date(order).alias("short_date"),
        tl.date_text(ship).alias("date_text"),
    )


def event_times(spark, sf):
    """Times with a fraction: text, Mexico City time, whole days to a midnight."""
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        tl.mexico_time(ts).alias("mexico_time"),
        tl.date_text(ts).alias("date_text"),
        tl.lead_days(ts, F.date_trunc("year", ts).cast("timestamp_ntz")).alias("lead_days"),
        tl.json_preview(F.col("props"), 6).alias("preview"),
    )


def label_functions(spark, sf):
    name = F.concat(F.col("c_name"), F.lit(" S.A. de C.V. "), F.lower("c_mktsegment"), F.lit(" INDUSTRIAL y familia"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        tl.short_label(F.col("c_name"), 12).alias("label"),
        tl.clean_customer_name(name).alias("cut_name"),
        tl.clean_customer_name(name, 60).alias("whole_name"),
    )


def number_functions(spark, sf):
    price, rate = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        tl.round_exact(price * rate, 2).alias("rounded"),
        tl.percent_text(rate * F.col("l_tax")).alias("percent"),
        number_text(price * 1000).alias("text"),
        tl.usd_text(-price).alias("usd"),
        tl.trend_text(rate * 100 - 5, signed=True).alias("trend"),
        tl.rate_from_amount(price * rate, price).alias("rate"),
        tl.discount_amount(price, rate).alias("amount"),
    )


def catalogue_lookups(spark, sf):
    price, rate = F.col("l_extendedprice"), F.col("l_discount")
    key = F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0")
    category = tl.category_from_key(F.concat(key, F.lit("1015")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        tl.state_from_postal(F.concat(key, F.lit("000"))).alias("state"),
        category.alias("category"),
        tl.estimated_profit(category, price).alias("profit"),
        tl.line_discount_rate(price, price * rate).alias("rate"),
        tl.ship_mode_from_payment(F.when(F.col("l_returnflag") == "A", "PUE").otherwise("PPD")).alias("mode"),
        tl.whole_quantity(F.concat(F.col("l_quantity").cast("string"), F.lit("7"))).alias("quantity"),
    )


def sanitized_measures(spark, sf):
    """Measures with missing and infinite values, cleaned, with the loss flag."""
    tx = transactions(spark, sf, "order_id", "quantity", "sales", "profit", "shipping_cost")
    broken = tx.withColumns(
        {
            "sales": F.when(F.col("quantity") > 40, float("inf")).otherwise(F.col("sales")),
            "profit": F.when(F.col("quantity") < 10, None).otherwise(F.col("profit")),
            "shipping_cost": F.when(F.col("quantity") == 25, float("nan")).otherwise(F.col("shipping_cost")),
        }
    )
    return tl.with_loss_flag(tl.sanitize_measures(broken))


def narrow_measures(spark, sf):
    """Single-precision measures, shown as the doubles they stand for."""
    tx = tl.narrow_measures(transactions(spark, sf, "order_id", "sales", "profit", "discount_rate"))
    return tx.select("order_id", *[F.col(c).cast("double").alias(c) for c in ("sales", "profit", "discount_rate")])


# --- ingest ---------------------------------------------------------------------------


def _csv_texts(spark, sf):
    """The transactions as the cells of a historical file."""
    tx = transactions(spark, sf)

    def money(name):
        # Thousands separators; zero is written as a dash.
        return F.when(F.col(name) == 0, "-").otherwise(F.format_number(F.col(name), 4))

    def day(name):
        return F.date_format(name, "MM/dd/yyyy")

    texts = {
        "sales": money("sales"),
        "profit": money("profit"),
        "shipping_cost": money("shipping_cost"),
        "loss": money("loss"),
        "quantity": F.col("quantity").cast("string"),
        # An unreadable order date, whose row is to be dropped.
        "order_date": F.when(F.col("quantity") == 13, "13/13/2013").otherwise(day("order_date")),
        "ship_date": F.when(F.col("quantity") == 14, "N/A").otherwise(day("ship_date")),
        "Discount": F.concat(F.format_number(F.col("discount_rate") * 100, 2), F.lit(" %")),
        "product_name": F.concat(F.lit('say "'), F.col("product_name"), F.lit('", twice')),
    }
    headers = {name: f" {header} " for header, name in CSV_COLUMNS.items()}
    cells = tx.withColumns(texts).drop("discount_rate", "discount_amount")
    return cells.withColumnsRenamed({name: headers.get(name, name) for name in cells.columns})


def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    _csv_texts(spark, sf).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return tl.canonical_csv(tl.read_transactions_csv(spark, path))


def csv_mixed_headers(spark, sf):
    """Two sets of files whose columns stand in another order, read as one."""
    cells = _csv_texts(spark, sf)
    odd = F.col(" Quantity ") % 2 == 1
    paths = [scratch_path(spark, "csv"), scratch_path(spark, "csv")]
    cells.filter(odd).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(paths[0])
    cells.filter(~odd).select(*reversed(cells.columns)).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(paths[1])
    return tl.canonical_csv(tl.read_transactions_csv(spark, paths))


def _invoice_documents(spark, sf):
    """One document per order line, holding two invoice lines."""
    line = table(spark, sf, "lineitem")
    member = F.concat_ws("-", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
    parts = table(spark, sf, "part")
    source = line.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    two = F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0")

    def attribute(name, value):
        return F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))

    price = F.format_string("%.2f", "l_extendedprice")
    discount = F.format_string("%.4f", F.col("l_extendedprice") * F.col("l_discount"))
    payment = F.when(F.col("l_returnflag") == "N", "").otherwise(
        attribute("MetodoPago", F.when(F.col("l_returnflag") == "A", F.lit("PUE")).otherwise(F.lit("PPD")))
    )
    first = F.concat(
        F.lit("<cfdi:Concepto"), attribute("ClaveProdServ", F.concat(two, F.lit("0101"))),
        attribute("Cantidad", F.col("l_quantity").cast("string")), attribute("Descripcion", F.col("p_name")),
        attribute("Importe", price), attribute("Descuento", discount), F.lit("/>"),
    )
    second = F.concat(
        F.lit("<cfdi:Concepto"), attribute("ClaveProdServ", F.lit("56101500")),
        attribute("ClaveUnidad", F.col("p_brand")), attribute("Importe", price), F.lit("/>"),
    )
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><cfdi:Comprobante xmlns:cfdi="http://www.sat.gob.mx/cfd/4"'),
        attribute("Fecha", F.regexp_replace(F.col("l_shipdate").cast("string"), " ", "T")),
        attribute("LugarExpedicion", F.concat(two, F.lit("500"))), payment,
        F.lit('><cfdi:Receptor Nombre="Peña &amp; Co"/><cfdi:Conceptos>'), first, second,
        F.lit('</cfdi:Conceptos><cfdi:Complemento><t:TimbreFiscalDigital xmlns:t="urn:t"'),
        attribute("UUID", F.concat_ws("-", "l_orderkey", "l_linenumber", member)),
        F.lit("/></cfdi:Complemento></cfdi:Comprobante>"),
    )
    return source.select(
        F.col("l_orderkey").cast("string").alias("archive"),
        F.col("l_linenumber").alias("member_no"),
        member.alias("member"),
        F.encode(xml, "UTF-8").alias("xml"),
    )


def parse_invoices(spark, sf):
    return tl.parse_invoices(_invoice_documents(spark, sf), keep_document=False).drop("raw_xml_data")


def parse_invoices_last_line(spark, sf):
    return tl.parse_invoices(_invoice_documents(spark, sf), compat="last_line", keep_document=False).drop("raw_xml_data")


def invoice_json(spark, sf):
    docs = tl.invoice_to_json(_invoice_documents(spark, sf))
    return docs.select("archive", "member_no", "member", "invoice_json")


#: Documents in an archive; one of 10,000 would take some megabytes, of which Parquet gathers a hundred rows before it looks at their size.
ARCHIVE_DOCUMENTS = 500


def _zip_batches(batches):
    """Each few hundred documents as one archive, next to a member to be ignored."""
    for batch in (b.iloc[i : i + ARCHIVE_DOCUMENTS] for b in batches for i in range(0, len(b), ARCHIVE_DOCUMENTS)):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
            archive.writestr("readme.txt", "no invoice")
            for name, xml in zip(batch["member"], batch["xml"]):
                archive.writestr(f"{name}.xml", xml)
        yield pd.DataFrame({"path": [batch["member"].iloc[0]], "content": [buffer.getvalue()]})


def invoice_archives(spark, sf):
    docs = _invoice_documents(spark, sf).select(
        F.concat_ws("/", "archive", "member_no", "member").alias("member"), "xml"
    )
    # Packing and expanding are bound by processors; a scan alone has few tasks.
    docs = docs.repartition("member")
    archives = docs.mapInPandas(_zip_batches, "path string, content binary")
    members = tl.expand_archives(archives)
    return members.select("member", F.length("xml").alias("bytes"), F.md5("xml").alias("digest"))


def canonical_invoices(spark, sf):
    return tl.canonical_invoices(tl.parse_invoices(_invoice_documents(spark, sf))).drop("invoice_json")


def consolidated_sources(spark, sf):
    """Historical rows and invoice rows in one table, counted by source and category."""
    csv = transactions(spark, sf, "order_id", "order_date", "category", "sales", "shipping_cost")
    xml = tl.canonical_invoices(tl.parse_invoices(_invoice_documents(spark, sf)))
    both = tl.consolidate(csv.withColumn("source", F.lit("csv")), xml)
    return both.groupBy("source", "category").agg(
        F.count("*").alias("rows"),
        F.count("payment_method").alias("with_payment"),
        F.sum("sales").alias("sales"),
    )


def _order_documents(spark, sf):
    """Order lines as parsed documents; all lines of an order share its invoice id."""
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("string").alias("archive"),
        F.col("l_linenumber").alias("member_no"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_extendedprice").alias("member"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.lit(True).alias("has_uuid"),
        F.lit(None).cast("string").alias("problem"),
        F.array(F.struct(F.col("l_extendedprice").alias("amount"))).alias("lines"),
    )


def _stored_orders(spark, sf):
    finished = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return finished.select(F.col("o_orderkey").cast("string").alias("order_id"))


def suppress_duplicates(spark, sf):
    fresh, _ = tl.suppress_duplicates(_order_documents(spark, sf), _stored_orders(spark, sf))
    return fresh.select("archive", "member_no", "member", "order_id")


def ingest_report(spark, sf):
    docs = tl.document_keys(_order_documents(spark, sf))
    _, duplicates = tl.suppress_duplicates(docs, _stored_orders(spark, sf))
    return tl.ingest_report(docs, duplicates)


def invoice_intake(spark, sf):
    """All documents taken in, then taken in again: the second time adds nothing."""
    path = scratch_path(spark, "invoices")
    docs = staged(_invoice_documents(spark, sf), "arrived")
    tl.intake_invoices(docs, path)
    tl.intake_invoices(docs, path)
    stored = tl.read_invoice_lines(spark, path)
    return stored.agg(
        F.count("*").alias("lines"),
        F.count_distinct("row_id").alias("ids"),
        F.min("row_id").alias("first_id"),
        F.max("row_id").alias("last_id"),
        F.count_distinct("order_id").alias("invoices"),
        F.sum("sales").alias("sales"),
    )


def overlapping_intake(spark, sf):
    """Two batches that share invoices: what the second adds and skips, and what is stored."""
    path = scratch_path(spark, "invoices")
    docs = staged(_invoice_documents(spark, sf), "arrived")
    tl.intake_invoices(docs.filter("member_no <= 4"), path)
    report = tl.intake_invoices(docs.filter("member_no >= 3"), path)["report"]
    return tl.read_invoice_lines(spark, path).agg(
        F.count("*").alias("lines"), F.count_distinct("row_id").alias("ids"), F.count_distinct("order_id").alias("invoices"),
        *[F.lit(n).cast("long").alias(name) for name, n in report.items()],
    )


def keyed_intake(spark, sf):
    """Archives of all documents drained twice, the second time under other names: what each time adds."""
    source, documents, path, state = (scratch_path(spark, name) for name in ("archives", "documents", "invoices", "state"))
    docs = _invoice_documents(spark, sf).select(F.concat_ws("/", "archive", "member_no", "member").alias("member"), "xml")
    # Archives are large cells: few of them to a row group, which readers take whole.
    small = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 4, "compression": "zstd"}
    docs.mapInPandas(_zip_batches, "path string, content binary").write.options(**small).parquet(f"{source}/turn=first")
    counts = []
    for turn in ("first", "second"):
        if turn == "second":
            # The same archives come again as new files: the folder, which is part of their names, gets another one.
            rename(spark, f"{source}/turn=first", f"{source}/turn=second")
        arriving = spark.readStream.schema("path string, content binary, turn string").parquet(source)
        arriving = arriving.select(F.concat_ws("/", "turn", "path").alias("path"), "content")
        tl.start_document_stream(arriving, documents, f"{state}/documents").awaitTermination()
        tl.start_keyed_intake(spark, documents, path, f"{state}/intake").awaitTermination()
        counts.append(tl.read_invoice_lines(spark, path).count())
    return tl.read_invoice_lines(spark, path).agg(
        F.lit(counts[0]).cast("long").alias("first_lines"), F.lit(counts[1] - counts[0]).cast("long").alias("second_lines"),
        F.count_distinct("row_id").alias("ids"), F.count_distinct("order_id").alias("invoices"), F.sum("sales").alias("sales"),
    )


# --- stored tables ----


def _lines(spark, sf, condition):
    """Stored invoice lines made of the test tables' order lines."""
    tx = transactions(spark, sf).filter(condition)
    fixed = {"perdida": F.lit(0.0), "metodo_pago": F.lit("PUE"), "raw_xml_data": F.lit("{}"), "ship_mode": F.lit("Express")}
    return tx.select(*[fixed.get(f.name, F.col(f.name) if f.name in tx.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in INVOICE_LINES.fields])


def _csv_file(spark, sf, condition):
    """Historical files whose row ids are those that invoice lines get too."""
    names = {new: old for old, new in CSV_COLUMNS.items()}
    tx = transactions(spark, sf, "order_id", "order_date", "ship_date", "category", "country", "sales", "profit", "quantity")
    tx = tx.filter(condition).withColumn("row_id", F.monotonically_increasing_id() % 1000 + 1)
    tx = tx.withColumns({c: F.date_format(c, "M/d/yyyy") for c in ("order_date", "ship_date")})
    path = scratch_path(spark, "csv")
    tx.withColumnsRenamed({c: names[c] for c in tx.columns}).write.option("header", True).option("compression", "gzip").csv(path)
    return path


def _by_source(tx):
    return tx.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_distinct("row_id").alias("ids"), F.sum("quantity").alias("quantity"), F.sum("sales").alias("sales")
    )


def named_batches(spark, sf):
    """Batches whose names begin alike, one of them sent twice."""
    path = scratch_path(spark, "batches")
    lines = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_shipdate").alias("order_date"), "l_quantity")
    for part, flag in (("2024-01", "A"), ("2024", "N"), ("2024", "N"), ("batch", "R")):
        tl.append_invoice_lines(lines.filter(F.col("l_returnflag") == flag), path, part)
    return tl.read_table(spark, path).groupBy("l_returnflag").agg(
        F.count("*").alias("lines"), F.count_distinct("row_id").alias("ids"), F.sum("l_quantity").alias("quantity")
    )


def upload_then_refresh(spark, sf):
    """A second upload replaces the first and keeps the invoices; new invoices join them."""
    path, invoices = scratch_path(spark, "tx"), scratch_path(spark, "invoices")
    tl.append_invoice_lines(_lines(spark, sf, "quantity % 2 = 1 and quantity < 25"), invoices)
    tl.upload_csv(spark, _csv_file(spark, sf, "quantity % 3 = 0"), path, invoices_path=invoices)
    tl.upload_csv(spark, _csv_file(spark, sf, "quantity % 2 = 0"), path)
    tl.append_invoice_lines(_lines(spark, sf, "quantity % 2 = 1 and quantity >= 25"), invoices)
    return _by_source(tl.refresh_transactions(spark, path, invoices))


def delete_in_consolidated(spark, sf):
    """Rows of one country selected and deleted: only invoices go, though ids of both sources overlap."""
    path, invoices = scratch_path(spark, "tx"), scratch_path(spark, "invoices")
    tl.append_invoice_lines(_lines(spark, sf, "quantity % 2 = 1"), invoices)
    tl.upload_csv(spark, _csv_file(spark, sf, "quantity % 2 = 0"), path, invoices_path=invoices)
    chosen = tl.filter_columns(tl.read_table(spark, path), {"country": "nation_7$"})
    tl.delete_selected(spark, path, chosen, invoices)
    return _by_source(tl.read_table(spark, path))


def selection_outlives_refresh(spark, sf):
    """Rows selected, new invoices and a new file taken in, then the selection deleted: the same invoices go."""
    path, invoices = scratch_path(spark, "tx"), scratch_path(spark, "invoices")
    tl.append_invoice_lines(_lines(spark, sf, "quantity % 2 = 1 and quantity < 25"), invoices)
    tl.upload_csv(spark, _csv_file(spark, sf, "quantity % 3 = 0"), path, invoices_path=invoices)
    chosen = tl.filter_columns(tl.read_table(spark, path), {"country": "nation_[78]$"}).select("row_id")
    chosen = tl.shared(chosen)
    tl.append_invoice_lines(_lines(spark, sf, "quantity % 2 = 1 and quantity >= 25"), invoices)
    tl.refresh_transactions(spark, path, invoices)
    tl.upload_csv(spark, _csv_file(spark, sf, "quantity % 2 = 0"), path)
    tl.delete_selected(spark, path, chosen, invoices)
    return _by_source(tl.read_table(spark, path))


def _partials(spark, sf):
    """Merged orders of a stored table after a second batch of invoices came in."""
    path, invoices, partials = (scratch_path(spark, name) for name in ("tx", "invoices", "partials"))
    # Both batches are cut from lines that are joined and staged once.
    lines = staged(_lines(spark, sf, F.lit(True)), "lines")
    tl.append_invoice_lines(lines.filter("year(order_date) < 2000 or quantity < 10"), invoices, stable=True)
    tl.store_transactions(tl.load_transactions(spark, invoices_path=invoices), path, rate="amount")
    tl.store_partials(spark, path, partials)
    tl.append_invoice_lines(lines.filter("year(order_date) >= 2000 and quantity >= 10"), invoices, stable=True)
    tl.refresh_transactions(spark, path, invoices)
    return tl.store_partials(spark, path, partials)


def kpis_from_partials(spark, sf):
    return tl.kpis(_partials(spark, sf))


def customer_totals_from_partials(spark, sf):
    return tl.customer_totals(_partials(spark, sf))


def country_totals_from_partials(spark, sf):
    return tl.country_totals(_partials(spark, sf))


def _far_pages(spark, sf, **wanted):
    """A far page of a stored table whose histogram was made before its second batch of invoices."""
    path, invoices, slices = (scratch_path(spark, name) for name in ("tx", "invoices", "slices"))
    # Both batches are cut from lines that are joined and staged once.
    lines = staged(_lines(spark, sf, F.lit(True)), "lines")
    tl.append_invoice_lines(lines.filter("year(order_date) < 2000 or quantity < 10"), invoices, stable=True)
    tl.store_transactions(tl.load_transactions(spark, invoices_path=invoices), path, rate="amount")
    tl.store_slices(spark, path, slices, wanted["by"])
    tl.append_invoice_lines(lines.filter("year(order_date) >= 2000 and quantity >= 10"), invoices, stable=True)
    tl.refresh_transactions(spark, path, invoices)
    return tl.stored_page(spark, path, slices, 41, 100, top_k_rows=1000, **wanted).select(wanted["by"])


def stored_page_by_date(spark, sf):
    return _far_pages(spark, sf, by="order_date", order="desc")


def stored_page_by_sales(spark, sf):
    return _far_pages(spark, sf, by="sales", order="asc")


def stored_page_by_name(spark, sf):
    return _far_pages(spark, sf, by="product_name", order="asc")


def stored_annotations(spark, sf):
    path = scratch_path(spark, "notes")
    first, second = _notes(spark, sf)
    tl.save_annotations(spark, first, path)
    tl.save_annotations(spark, second, path)
    requested = table(spark, sf, "region").select(F.col("r_name").alias("page_name")).union(
        table(spark, sf, "orders").select("o_orderpriority").distinct()
    )
    return tl.stored_annotation(spark, path, requested)


# --- maintenance ----------------------------------------------------------------------


def _order_rows(spark, sf):
    return table(spark, sf, "orders").withColumnRenamed("o_orderkey", "row_id")


def _large_line_orders(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("row_id"))


def delete_by_ids(spark, sf):
    kept, _ = tl.delete_by_ids(_order_rows(spark, sf), _large_line_orders(spark, sf))
    return kept


def deleted_count(spark, sf):
    _, count = tl.delete_by_ids(_order_rows(spark, sf), _large_line_orders(spark, sf))
    return count


def stored_delete(spark, sf):
    """The same deletion on a stored table, read back."""
    path = scratch_path(spark, "orders")
    rows = _order_rows(spark, sf).withColumnRenamed("o_orderdate", "order_date")
    tl.replace_dataset(rows, path, ["row_id", "order_date"])
    tl.delete_rows(spark, path, _large_line_orders(spark, sf))
    return tl.read_table(spark, path)


def replace_dataset(spark, sf):
    """A stored dataset, replaced: only the second one is left."""
    path = scratch_path(spark, "dataset")
    tx = transactions(spark, sf, "order_id", "order_date", "sales", "profit")
    tl.replace_dataset(tl.losses_only(tx), path, ["order_date", "sales"])
    tl.replace_dataset(tx, path, ["order_date", "sales"])
    return tl.read_table(spark, path)


def _notes(spark, sf):
    orders = table(spark, sf, "orders")
    notes = orders.select(
        F.col("o_orderpriority").alias("page_name"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("content"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("updated_by_name"),
        F.col("o_orderdate").alias("updated_at"),
        "o_orderstatus",
    )
    finished = F.col("o_orderstatus") == "F"
    return notes.filter(finished).drop("o_orderstatus"), notes.filter(~finished).drop("o_orderstatus")


def upsert_annotations(spark, sf):
    return tl.upsert_annotations(*_notes(spark, sf))


def latest_annotation(spark, sf):
    requested = table(spark, sf, "region").select(F.col("r_name").alias("page_name")).union(
        table(spark, sf, "orders").select("o_orderpriority").distinct()
    )
    return tl.latest_annotation(tl.upsert_annotations(*_notes(spark, sf)), requested)


def newest_first(spark, sf):
    return tl.newest_first(table(spark, sf, "events"), "ts", "event_id").select("event_id", "ts", "event_type")


def snapshot_changes(spark, sf):
    old = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("role"),
        F.col("o_custkey").alias("email"), "o_totalprice",
    )
    new = old.filter("role <> '5-LOW'").withColumn(
        "status", F.when(F.col("o_totalprice") > 300000, "F").otherwise(F.col("status"))
    )
    return tl.snapshot_changes(old, new, "id", {"status": "Status", "role": "Role"}, carry=["email"])


def record_count(spark, sf):
    return transactions(spark, sf).agg(F.count("*").alias("records"))


def numbered_rows(spark, sf):
    """Row ids without gaps, whatever the partitions."""
    rows, _ = number_rows(tl.shared(table(spark, sf, "lineitem").select("l_orderkey")), 1)
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_distinct("row_id").alias("ids"),
        F.min("row_id").alias("first_id"),
        F.max("row_id").alias("last_id"),
    )


QUERIES = {
    query.__name__: query
    for query in [
        kpis, monthly_seasonality, category_performance, subcategory_ranking, previous_year_rows,
        product_totals, product_discounts, top_shipping, top_losses, bottom_products, top_discounts,
        discount_band_loss, discount_band_profit, discount_band_profit_empty_bands, discount_band_profit_float32,
        discount_band_leak_loss, discount_band_leak_profit, discount_impact, discount_bands_by_row,
        customer_totals, customer_list, top_profit_customers, top_revenue_customers, bottom_profit_customers,
        bottom_revenue_customers, vip_customers, critical_customers, segment_customers,
        country_totals, shipping_margin, market_leader, market_bubble, bottom_countries, critical_geography,
        dashboard,
        search_any, filter_columns, sorted_page, deep_page, deep_page_by_name, page_after, page_after_ties, explore_far_page, page_info, page_info_literal,
        explore_rows, explore_counts, audit_export, audit_export_documents, document_fields,
        date_functions, event_times, label_functions, number_functions, catalogue_lookups, sanitized_measures, narrow_measures,
        csv_round_trip, csv_mixed_headers, parse_invoices, parse_invoices_last_line, invoice_json, invoice_archives,
        canonical_invoices, consolidated_sources, suppress_duplicates, ingest_report, invoice_intake, overlapping_intake, keyed_intake,
        delete_by_ids, deleted_count, stored_delete, replace_dataset, upsert_annotations, latest_annotation,
        named_batches, upload_then_refresh, delete_in_consolidated, selection_outlives_refresh, stored_annotations,
        kpis_from_partials, customer_totals_from_partials, country_totals_from_partials,
        stored_page_by_date, stored_page_by_sales, stored_page_by_name,
        newest_first, snapshot_changes, record_count, numbered_rows,
    ]
}
