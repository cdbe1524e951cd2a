from tallyline.operators.canonical import (
    canonical_csv,
    canonical_invoices,
    clean_discounts,
    clean_measures,
    conform,
    consolidate,
    last_year,
    losses_only,
    narrow_measures,
    parse_dates,
    sanitize_measures,
    to_canonical,
    with_discount_amount,
    with_discount_rate,
    with_loss_flag,
    year_slice,
)
from tallyline.operators.checks import MissingColumns, ensure_columns, require_columns
from tallyline.operators.countries import (
    bottom_countries,
    country_totals,
    critical_geography,
    market_bubble,
    market_leader,
    shipping_margin,
)
from tallyline.operators.customers import (
    critical_customers,
    customer_list,
    customer_ranking,
    customer_totals,
    segment_customers,
    vip_customers,
)
from tallyline.operators.discounts import (
    band_leak,
    band_report,
    band_totals,
    discount_band_leak,
    discount_band_loss,
    discount_band_profit,
    discount_bands,
)
from tallyline.operators.duplicates import document_keys, find_duplicates, ingest_report, suppress_duplicates
from tallyline.operators.explore import (
    deep_page,
    explore,
    filter_columns,
    page,
    page_after,
    page_info,
    search_any,
    sort_rows,
)
from tallyline.operators.export import audit_export, write_export
from tallyline.operators.kpis import kpis
from tallyline.operators.maintain import (
    append_change_log,
    delete_by_ids,
    latest_annotation,
    newest_first,
    snapshot_changes,
    upsert_annotations,
)
from tallyline.operators.partials import order_partials
from tallyline.operators.products import (
    bottom_products,
    product_discounts,
    product_totals,
    top_discounts,
    top_losses,
    top_shipping,
)
from tallyline.operators.seasonality import category_performance, monthly_seasonality, shipped, subcategory_ranking

__all__ = [
    name for name, value in list(globals().items()) if not name.startswith("_") and (callable(value) or name.isupper())
]
