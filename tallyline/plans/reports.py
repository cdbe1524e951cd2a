"""Whole reports: the frames a dashboard page needs, from one canonical table.

Each report computes its shared aggregate once (``shared``) and ranks from it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators import (
    band_leak,
    band_report,
    band_totals,
    bottom_countries,
    bottom_products,
    category_performance,
    country_totals,
    critical_geography,
    customer_list,
    customer_ranking,
    customer_totals,
    market_bubble,
    market_leader,
    kpis,
    monthly_seasonality,
    product_discounts,
    product_totals,
    segment_customers,
    shipping_margin,
    subcategory_ranking,
    top_discounts,
    top_losses,
    top_shipping,
)
from tallyline.session import shared


def charts(tx: DataFrame) -> dict:
    return {"sales_over_time": monthly_seasonality(tx), "category_data": category_performance(tx)}


def products_analysis(tx: DataFrame) -> dict:
    totals = shared(product_totals(tx))
    return {"shipping": top_shipping(tx), "top_losses": top_losses(totals), "bottom_20": bottom_products(totals)}


def discount_impact(tx: DataFrame, **options) -> dict:
    """Loss and profit by discount band, from one pass over the transactions."""
    totals = shared(band_totals(tx, ["loss", "profit"], **options))
    return {
        "loss": band_report(totals, "loss"),
        "loss_total": band_leak(totals, "loss"),
        "profit": band_report(totals, "profit"),
        "profit_total": band_leak(totals, "profit"),
    }


def customers_analysis(tx: DataFrame) -> dict:
    totals = shared(customer_totals(tx))
    return {
        "top_profitable": customer_ranking(totals, "profit"),
        "top_revenue": customer_ranking(totals, "sales"),
        "bottom_profitable": customer_ranking(totals, "profit", ascending=True),
        "bottom_revenue": customer_ranking(totals, "sales", ascending=True),
        "segmentation": customer_list(totals),
        "segments": segment_customers(totals),
    }


def countries_analysis(tx: DataFrame) -> dict:
    totals = shared(country_totals(tx))
    return {
        "outlier": market_leader(totals),
        "bubble_data": market_bubble(totals),
        "shipping_relation": shipping_margin(totals),
        "bottom_countries": bottom_countries(totals),
        "critical_geo": critical_geography(tx),
    }


# Result field -> our column, for each list of the dashboard.
FIELDS = {
    "sales_over_time": {"date": "date", "Sales": "sales", "Days_to_Ship": "days_to_ship"},
    "category_data": {
        "Category": "category", "Sales": "sales", "Profit": "profit", "Discount_Value": "discount_value",
    },
    "subcategories": {"Sub-Category": "sub_category", "Sales": "sales", "Profit": "profit"},
    "shipping": {
        "name": "name", "fullName": "full_name", "shipping_cost": "shipping_cost", "profit": "profit",
        "order_id": "order_id",
    },
    "top_losses": {"name": "name", "fullName": "full_name", "loss_amount": "loss_amount", "sales": "sales"},
    "bottom_20": {"name": "name", "fullName": "full_name", "sales": "sales"},
    "top_discounts": {
        "name": "name", "fullName": "full_name", "discountValue": "discount_value", "profit": "profit",
    },
    "discount_margin_impact": {"group": "band", "profit": "loss"},
    "total_loss": {"total_loss_formatted": "total_formatted"},
    "discount_margin_netimpact": {"group": "band", "profit": "profit"},
    "total_net_loss": {"total_net_loss_formatted": "total_formatted"},
}


def dashboard(tx: DataFrame) -> dict:
    """Every list of the dashboard under its name, with its field names.

    Write a frame with ``df.write.json`` to get the records.
    """
    impact = discount_impact(tx)
    customers = customers_analysis(tx)
    lists = {
        "kpis": kpis(tx),
        **charts(tx),
        "subcategories": subcategory_ranking(tx),
        **products_analysis(tx),
        "top_discounts": top_discounts(product_discounts(tx)),
        "discount_margin_impact": impact["loss"],
        "total_loss": impact["loss_total"],
        "discount_margin_netimpact": impact["profit"],
        "total_net_loss": impact["profit_total"],
        "topProfitable": customers["top_profitable"],
        "topRevenue": customers["top_revenue"],
        "bottomProfitable": customers["bottom_profitable"],
        "bottomRevenue": customers["bottom_revenue"],
        "segmentation": customers["segmentation"],
        **countries_analysis(tx),
    }
    return {
        name: df.select(*[F.col(column).alias(field) for field, column in FIELDS[name].items()]) if name in FIELDS else df
        for name, df in lists.items()
    }
