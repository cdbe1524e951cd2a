from tallyline.sources.csv_files import read_transactions_csv, trim_headers
from tallyline.sources.invoices import (
    expand_archives,
    invoice_lines,
    invoice_to_json,
    parse_invoices,
    quarantine,
    read_documents,
    read_invoice_archives,
    read_invoice_files,
)
from tallyline.sources.tables import (
    append_invoice_lines,
    delete_rows,
    read_invoice_keys,
    read_invoice_lines,
    read_table,
    replace_dataset,
    stored_last_year,
)

__all__ = [
    name for name, value in list(globals().items()) if not name.startswith("_") and (callable(value) or name.isupper())
]
