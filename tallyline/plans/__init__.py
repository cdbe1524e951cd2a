from tallyline.plans.intake import intake_invoices
from tallyline.plans.load import (
    delete_selected,
    load_transactions,
    refresh_transactions,
    save_annotations,
    store_partials,
    store_transactions,
    stored_annotation,
    upload_csv,
    with_stable_ids,
)
from tallyline.plans.pages import store_slices, stored_page
from tallyline.plans.reports import (
    charts,
    countries_analysis,
    customers_analysis,
    dashboard,
    discount_impact,
    products_analysis,
)

__all__ = [
    name for name, value in list(globals().items()) if not name.startswith("_") and (callable(value) or name.isupper())
]
