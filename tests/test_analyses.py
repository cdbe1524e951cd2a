import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import tallyline as tl

SCHEMA = (
    "order_id string, order_date timestamp_ntz, ship_date timestamp_ntz, customer_name string, country string, "
    "category string, sub_category string, product_name string, sales double, profit double, shipping_cost double, "
    "loss double, discount_rate double"
)


def day(text):
    return dt.datetime.fromisoformat(text) if text else None


def row(order="A", date="2024-03-01", ship="2024-03-03", customer="Ana", country="Puebla", product="Silla",
        sales=10.0, profit=1.0, shipping=2.0, loss=-1.0, rate=0.0, category="Furniture", sub="Chairs"):
    return (order, day(date), day(ship), customer, country, category, sub, product, sales, profit, shipping, loss, rate)


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def test_kpis(frame):
    tx = frame(
        row("A", "2024-03-01", sales=10.0, profit=1.0),
        row("A", "2024-04-01", sales=30.0, profit=2.0),
        row("B", "2024-05-01", sales=20.0, profit=-1.0),
        row(None, "2024-05-01", sales=5.0, profit=None),
        row("C", "2023-05-01", sales=50.0),
        row("D", "2022-05-01", sales=1000.0),
    )
    expected = {
        "gross_revenue": 65.0, "avg_order": 30.0, "profit_margin": "3.08%", "sales_trend": "+30.0%",
        "order_trend": "+100.0%", "current_year": 2024,
    }
    assert as_dicts(tl.kpis(tx)) == [expected]
    assert as_dicts(tl.kpis(tx, year=2024)) == [expected]
    assert as_dicts(tl.kpis(tx.withColumn("order_year", F.year("order_date")))) == [expected]
    assert as_dicts(tl.kpis(tx.drop("order_id")))[0]["avg_order"] == 16.25


def test_kpis_without_earlier_year_or_sales(frame):
    first = as_dicts(tl.kpis(frame(row(sales=-1.0))))[0]
    assert (first["sales_trend"], first["order_trend"], first["profit_margin"]) == ("New", "New", "0%")


def test_kpis_of_nothing(frame):
    expected = {
        "gross_revenue": 0.0, "avg_order": 0.0, "profit_margin": "0%", "sales_trend": "0%", "order_trend": "+0.0%",
        "current_year": dt.date.today().year,
    }
    assert as_dicts(tl.kpis(frame())) == [expected]
    with pytest.raises(tl.MissingColumns) as error:
        tl.kpis(frame().drop("profit", "sales"))
    assert error.value.missing == ["sales", "profit"]


def test_every_analysis_takes_an_empty_frame(frame):
    tx = frame()
    frames = [tl.monthly_seasonality(tx), tl.category_performance(tx), tl.subcategory_ranking(tx)]
    for report in (tl.charts, tl.products_analysis, tl.customers_analysis, tl.countries_analysis):
        frames += report(tx).values()
    assert [df.count() for df in frames] == [0] * len(frames)
    assert [r.profit for r in tl.discount_band_profit(tx).collect()] == [0.0] * 6
    assert as_dicts(tl.discount_band_leak(tx)) == [{"total": 0.0, "total_formatted": "$0 USD"}]


def test_missing_keys_are_dropped_and_missing_measures_are_zero(frame):
    tx = frame(row(customer=None), row(customer="Ana", sales=None, profit=float("nan")), row(customer="Ana", sales=None,
               profit=None, order=None))
    assert as_dicts(tl.customer_totals(tx)) == [{"name": "Ana", "sales": 0.0, "profit": 0.0, "orders": 1}]
    assert as_dicts(tl.product_totals(frame(row(product=None)))) == []
    assert as_dicts(tl.country_totals(frame(row(country=None)))) == []


def test_seasonality_needs_ship_dates_and_floors_lead_time(frame):
    tx = frame(
        row(date="2024-03-01", ship="2024-03-03"),
        row(date="2023-03-02T06:00:00", ship="2023-03-01T12:00:00"),
        row(date="2024-05-02", ship=None),
    )
    assert as_dicts(tl.monthly_seasonality(tx)) == [{"month": 3, "date": "Mar", "sales": 20.0, "days_to_ship": 0.5}]
    assert as_dicts(tl.category_performance(tx)) == [
        {"category": "Furniture", "sales": 20.0, "profit": 2.0, "discount_value": 2.0}
    ]


def test_discount_volume_is_the_absolute_sum(frame):
    tx = frame(row(loss=-5.0), row(loss=3.0), row(product="Mesa", loss=-1.0))
    found = [(r.full_name, r.discount_value) for r in tl.top_discounts(tl.product_discounts(tx)).collect()]
    assert found == [("Silla", 2.0), ("Mesa", 1.0)]


def test_bands_fill_gaps_and_ignore_rates_outside(frame):
    tx = frame(*[row(rate=r, profit=p) for r, p in
                 [(0.0, -1.0), (0.05, 2.0), (0.2, -4.0), (2.0, 8.0), (2.5, 100.0), (None, 100.0), (-1.0, 100.0)]])
    totals = [r.profit for r in tl.discount_band_profit(tx).collect()]
    assert totals == [-1.0, 2.0, 0.0, 0.0, -4.0, 8.0]
    assert as_dicts(tl.discount_band_leak(tx)) == [{"total": -5.0, "total_formatted": "$-5 USD"}]
    single = [r.profit for r in tl.discount_band_profit(tx, compat="float32").collect()]
    assert single == [-1.0, 0.0, 2.0, 0.0, 0.0, 4.0]


def test_band_totals_add_up(frame):
    random.seed(2)
    rows = [row(rate=random.choice([0.0, 0.07, 0.3, 1.9, 3.0]), profit=float(random.randint(-9, 9))) for _ in range(200)]
    inside = sum(r[9] for r in rows if -0.001 < r[12] <= 2)
    assert sum(r.profit for r in tl.discount_band_profit(frame(*rows)).collect()) == inside


def test_shipping_without_orders_is_null(frame):
    tx = frame(row(order=None, sales=0.0), row(country="Jalisco", sales=4.0, profit=1.0, shipping=3.0))
    found = {r.country: (r.avg_shipping, r.profit_margin) for r in tl.shipping_margin(tl.country_totals(tx)).collect()}
    assert found == {"Puebla": (None, 0.0), "Jalisco": (3.0, 25.0)}


def test_rankings_break_ties_by_name(frame):
    tx = frame(*[row(customer=c, sales=1.0) for c in "dbca"])
    totals = tl.customer_totals(tx)
    assert [r.name for r in tl.customer_ranking(totals, "sales", k=3).collect()] == ["a", "b", "c"]
    assert [r.name for r in tl.customer_ranking(totals, "sales", ascending=True, k=3).collect()] == ["a", "b", "c"]


def test_segments(frame):
    random.seed(3)
    rows = [row(order=f"o{i % 70}", customer=f"c{i % 40}", sales=random.uniform(0, 100), profit=random.uniform(-50, 50))
            for i in range(400)]
    totals = tl.shared(tl.customer_totals(frame(*rows)))
    names = lambda df: {r.name for r in df.collect()}
    top_profit = names(tl.customer_ranking(totals, "profit", k=12))
    top_sales = names(tl.customer_ranking(totals, "sales", k=12))
    vip, critical = names(tl.vip_customers(totals, 12)), names(tl.critical_customers(totals, 12))
    assert vip == top_profit & top_sales
    for r in tl.segment_customers(totals, 12).collect():
        expected = "vip" if r.name in vip else "critical" if r.name in critical else "loss" if r.profit < 0 else "regular"
        assert r.segment == expected


def test_leader_and_bubble_do_not_overlap(frame):
    tx = frame(*[row(country=f"c{i}", sales=float(i)) for i in range(60)])
    totals = tl.country_totals(tx)
    bubble = [r.country for r in tl.market_bubble(totals).collect()]
    assert [r.country for r in tl.market_leader(totals).collect()] == ["c59"]
    assert bubble == [f"c{i}" for i in range(58, 8, -1)]


def test_critical_geography_counts_customers_not_rows(frame):
    tx = frame(
        row(customer="a", profit=-5.0), row(customer="a", profit=-1.0), row(customer="b", profit=-5.0),
        row(customer="b", profit=9.0), row(customer="a", country="Jalisco", profit=-1.0),
        row(customer="c", country="Jalisco", profit=-1.0),
    )
    assert as_dicts(tl.critical_geography(tx)) == [{"country": "Jalisco", "count": 2}, {"country": "Puebla", "count": 1}]


def test_hot_key_gives_whole_results(frame):
    """A third of the rows under one customer, product, country and order."""
    rows = [row(order="hot", customer="hot", product="hot", country="hot", sales=1.0) for _ in range(500)]
    rows += [row(order=f"o{i}", customer=f"c{i}", sales=1.0) for i in range(1000)]
    totals = {r.name: (r.sales, r.orders) for r in tl.customer_totals(frame(*rows).repartition(8)).collect()}
    assert totals["hot"] == (500.0, 1) and len(totals) == 1001
    assert {r.product_name: r.sales for r in tl.product_totals(frame(*rows)).collect()} == {"hot": 500.0, "Silla": 1000.0}


def test_sanitize_and_flags(frame):
    tx = frame(row(sales=float("inf"), profit=float("nan")), row(sales=None, profit=-2.0))
    found = [(r.sales, r.profit, r.is_loss) for r in tl.with_loss_flag(tl.sanitize_measures(tx)).collect()]
    assert found == [(0.0, 0.0, False), (0.0, -2.0, True)]


def test_year_slice_by_given_year(frame):
    tx = frame(row(date="2024-01-01"), row(date="2023-12-31T23:59:59"), row(date="2023-01-01"), row(date="2022-12-31"))
    assert tl.year_slice(tx).count() == 1
    assert tl.year_slice(tx, offset=1).count() == 2
    assert tl.year_slice(tx, year=2023).count() == 2
    assert tl.year_slice(tx, years=2).count() == 3


def test_dashboard_has_every_list_with_its_fields(frame):
    found = tl.dashboard(frame(row(), row(order="B", customer="Eva", country="Jalisco", profit=-3.0, rate=0.3)))
    assert set(found) == {
        "kpis", "sales_over_time", "category_data", "subcategories", "shipping", "top_losses", "bottom_20",
        "top_discounts", "discount_margin_impact", "total_loss", "discount_margin_netimpact", "total_net_loss",
        "topProfitable", "topRevenue", "bottomProfitable", "bottomRevenue", "segmentation", "outlier", "bubble_data",
        "shipping_relation", "bottom_countries", "critical_geo",
    }
    assert as_dicts(found["sales_over_time"]) == [{"date": "Mar", "Sales": 20.0, "Days_to_Ship": 2.0}]
    assert as_dicts(found["total_net_loss"]) == [{"total_net_loss_formatted": "$-3 USD"}]
    assert [r.group for r in found["discount_margin_impact"].collect()][-1] == "Más de 20%"
    assert as_dicts(found["outlier"])[0]["country"] == "Jalisco"
    assert found["topRevenue"].columns == ["name", "sales", "profit", "orders"]
    assert found["shipping"].columns == ["name", "fullName", "shipping_cost", "profit", "order_id"]
