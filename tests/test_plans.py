"""What the planner makes of the operators."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import tallyline as tl
from tallyline.fixtures import transactions
from verification.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

PYTHON_QUERIES = {
    "parse_invoices", "parse_invoices_last_line", "invoice_json", "invoice_archives", "canonical_invoices",
    "consolidated_sources", "invoice_intake", "keyed_intake",
}
WRITERS = {"invoice_intake", "keyed_intake", "overlapping_intake", "selection_outlives_refresh", "kpis_from_partials", "customer_totals_from_partials", "country_totals_from_partials", "stored_page_by_date", "stored_page_by_sales", "stored_page_by_name", "stored_delete", "replace_dataset", "csv_round_trip", "deep_page", "deep_page_by_name"}


def plan(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize(
    "name",
    ["top_shipping", "top_losses", "bottom_products", "top_discounts", "top_profit_customers", "bottom_revenue_customers",
     "market_leader", "market_bubble", "bottom_countries", "critical_geography", "sorted_page", "explore_rows", "page_after"],
)
def test_rankings_are_top_k(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_window_no_cross_join_no_stray_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "Window" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    if name not in PYTHON_QUERIES:
        assert "EvalPython" not in text and "InPandas" not in text


def test_lines_are_not_sent_by_what_hangs_on_their_orders(spark):
    """Customers are joined to orders before order lines come in."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(transactions(spark, SF_DIR), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(o_custkey" in text
    below = text.split("hashpartitioning(o_custkey")[1]
    assert "l_orderkey" not in below and "l_partkey" not in below.split("hashpartitioning(c_custkey")[0]


def test_documents_are_parsed_once(spark):
    text = plan(QUERIES["parse_invoices"](spark, SF_DIR), "simple")
    assert text.count("ArrowEvalPython [") == 1


def test_documents_become_json_only_if_it_is_read(spark):
    text = plan(QUERIES["canonical_invoices"](spark, SF_DIR), "simple")
    assert text.count("ArrowEvalPython [") == 1 and "_document_json" not in text
    lines = tl.parse_invoices(spark.createDataFrame([], "member string, xml binary"))
    text = plan(lines.select("raw_xml_data", "sales"), "simple")
    assert text.count("ArrowEvalPython [") == 1 and "_document_json" in text


def test_archives_are_packed_in_more_tasks_than_the_scan_has(spark):
    assert "hashpartitioning(member" in plan(QUERIES["invoice_archives"](spark, SF_DIR), "simple")


def test_scans_read_only_needed_columns(spark):
    text = plan(tl.discount_band_profit(transactions(spark, SF_DIR, "discount_rate", "profit")))
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double>" in text
    text = plan(tl.product_totals(transactions(spark, SF_DIR)).select("product_name"))
    assert "customer_name" not in text.split("ReadSchema")[1]


def test_year_filter_reaches_the_stored_folders(spark, tmp_path):
    tx = transactions(spark, SF_DIR, "order_id", "order_date", "sales", "profit")
    stored = tl.store_transactions(tx, str(tmp_path / "tx"))
    text = plan(tl.kpis(stored, year=2001))
    assert "PartitionFilters: [isnotnull(order_year" in text and "(order_year" in text
    assert "GreaterThanOrEqual(order_date,2000-01-01T00:00" in text
    found = plan(tl.kpis(stored))
    assert "order_year" in found.split("PartitionFilters")[1] and "Subquery" in found
    assert tl.kpis(stored).collect() == tl.kpis(tx).collect() == tl.kpis(stored, year=2001).collect()


def test_a_far_page_scans_one_slice(spark, tmp_path):
    path, slices = str(tmp_path / "tx"), str(tmp_path / "slices")
    stored = tl.store_transactions(transactions(spark, SF_DIR, "order_id", "order_date", "sales", "profit").withColumn("source", F.lit("csv")), path)
    years = {r.order_year for r in stored.select("order_year").distinct().collect()}
    text = plan(tl.stored_page(spark, path, slices, 40, 50, "order_date"))
    # Each scan is named in the tree and in its details.
    assert text.count("Scan parquet") == 2 and "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    filters = text.split("PartitionFilters: ")[1].split("\n")[0]
    assert sum(str(year) in filters for year in years) < len(years)
    assert "GreaterThanOrEqual(order_date," in text and "LessThanOrEqual(order_date," in text


def test_intake_reads_only_the_key_folders_it_asks_for(spark, tmp_path):
    path = str(tmp_path / "lines")
    lines = transactions(spark, SF_DIR, "order_id", "order_date", "sales")
    tl.append_invoice_lines(lines, path, keys=lines)
    documents = spark.createDataFrame([("z", 0, "m", "1", True, None)], "archive string, member_no int, member string, order_id string, has_uuid boolean, problem string")
    text = plan(tl.find_duplicates(documents, tl.read_invoice_keys(spark, path)))
    scans = [part for part in text.split("Scan parquet")[1:] if "keys/version" in part.split("\n\n")[0]]
    assert scans and all("dynamicpruning" in s and "ReadSchema: struct<order_id:string,batch_number:int>" in s for s in scans)
    assert "stored_batch" not in text


def test_stream_state_is_merged_before_it_is_sent(spark, tmp_path):
    schema = "archive string, member_no int, member string, order_id string, has_uuid boolean, problem string, file string"
    text = plan(tl.first_seen(spark.readStream.schema(schema).parquet(str(tmp_path))), "simple")
    before, after = text[text.index("StateStoreSave"):].rsplit("Exchange hashpartitioning", 1)
    assert "StateStoreRestore" in before and "partial_min" in after and "Python" not in text


def test_hot_customer_is_pre_aggregated(spark):
    """Rows are merged by customer and order before they are sent by customer."""
    text = plan(tl.customer_totals(transactions(spark, SF_DIR, "customer_name", "order_id", "sales", "profit")))
    assert text.count("HashAggregate") >= 4 and "partial_sum" in text


def test_large_sides_are_not_broadcast(spark):
    from tallyline.session import broadcast_if_small

    ids = spark.range(100).withColumnRenamed("id", "row_id")
    rows = spark.range(1000).select(F.col("id").alias("row_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(rows.join(broadcast_if_small(ids), "row_id", "left_anti"))
        assert "SortMergeJoin" in plan(rows.join(broadcast_if_small(ids, max_rows=99), "row_id", "left_anti"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
