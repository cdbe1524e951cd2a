from tallyline.functions.bands import BAND_EDGES, BAND_LABELS, discount_band, discount_band_ordinal
from tallyline.functions.catalog import (
    category_from_key,
    estimated_profit,
    line_discount_rate,
    ship_mode_from_payment,
    state_from_postal,
)
from tallyline.functions.dates import (
    date_text,
    estimated_ship_date,
    invoice_date,
    lead_days,
    mexico_time,
    month_label,
    short_date,
)
from tallyline.functions.numbers import (
    as_number,
    clean_number,
    clean_rate,
    discount_amount,
    finite_or_zero,
    number_text,
    percent_text,
    rate_from_amount,
    round2,
    round_exact,
    total,
    trend_text,
    usd_text,
    whole_quantity,
)
from tallyline.functions.text import (
    clean_customer_name,
    document_field,
    json_preview,
    pretty_json,
    short_label,
)

__all__ = [
    name for name, value in list(globals().items()) if not name.startswith("_") and (callable(value) or name.isupper())
]
