"""Audit export: fixed columns, cleaned for people."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import date_text, finite_or_zero, percent_text, pretty_json

# Exported text columns, in order, and the canonical column behind each.
EXPORT_TEXT = {
    "Row ID": "row_id",
    "Order ID": "order_id",
    "Fecha": "order_date",
    "Cliente": "customer_name",
    "Categoría": "category",
    "Sub-Categoría": "sub_category",
    "Producto": "product_name",
    "Estado / Región": "country",
}
EXPORT_NUMBERS = {
    "Ventas": "sales",
    "Utilidad": "profit",
    "Pérdida": "loss",
    "Monto Descuento": "discount_amount",
}
EXPORT_MORE_TEXT = {
    "Método de Pago": "payment_method",
    "Fecha de Envío": "ship_date",
    "Modo de Envío": "ship_mode",
    "Prioridad": "order_priority",
}
NO_DOCUMENT = "Sin datos XML"


def _first_of(df: DataFrame, *names: str) -> Column:
    present = [F.col(f"`{name}`") for name in names if name in df.columns]
    return F.coalesce(*present) if present else F.lit(None)


def audit_export(df: DataFrame, pretty: bool = False) -> DataFrame:
    """The 18 columns of the audit file.

    Missing or zero texts become "-", missing or bad numbers 0. ``pretty``
    indents the document JSON, which needs Python and suits selected rows.
    """

    def text(name: str) -> Column:
        other = {"row_id": "id", "loss": "perdida", "payment_method": "metodo_pago"}.get(name, name)
        cell = _first_of(df, other, name)
        if name in ("order_date", "ship_date"):
            cell = date_text(cell)
        cell = cell.cast("string")
        return F.when(cell.isNull() | (cell == "0"), "-").otherwise(cell)

    def number(name: str) -> Column:
        other = {"loss": "perdida"}.get(name, name)
        value = _first_of(df, name, other).try_cast("double")
        return F.when(F.isnan(value), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))

    rate = finite_or_zero(_first_of(df, "discount_rate").try_cast("double"))
    json = _first_of(df, "raw_xml_data", "invoice_json").cast("string")
    document = F.when(json.isNull() | json.isin("", "0", "-"), NO_DOCUMENT)
    columns = {
        **{label: text(name) for label, name in EXPORT_TEXT.items()},
        **{label: number(name) for label, name in EXPORT_NUMBERS.items()},
        "Tasa Descuento": percent_text(rate),
        **{label: text(name) for label, name in EXPORT_MORE_TEXT.items()},
        "Metadata XML": document.otherwise(pretty_json(json) if pretty else json),
    }
    return df.select(*[column.alias(label) for label, column in columns.items()])


def write_export(df: DataFrame, path: str) -> None:
    """CSV files with header; texts quoted so JSON and names survive."""
    df.write.option("header", True).option("escape", '"').csv(path)
