"""Names and types shared by every part of the library.

``transactions`` is the canonical table: one row per sold line, whatever the
source it came from. Dates are naive (``TIMESTAMP_NTZ``) so results do not move
with the session time zone.
"""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("order_date", T.TimestampNTZType()),
        T.StructField("ship_date", T.TimestampNTZType()),
        T.StructField("ship_mode", T.StringType()),
        T.StructField("order_priority", T.StringType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("sales", T.DoubleType()),
        T.StructField("profit", T.DoubleType()),
        T.StructField("shipping_cost", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("discount_rate", T.DoubleType()),
        T.StructField("discount_amount", T.DoubleType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("invoice_json", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

# Stored invoice lines: the fields of the parsed invoices, before alignment.
INVOICE_LINES = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("order_date", T.TimestampNTZType()),
        T.StructField("ship_date", T.TimestampNTZType()),
        T.StructField("ship_mode", T.StringType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("sales", T.DoubleType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("discount_amount", T.DoubleType()),
        T.StructField("profit", T.DoubleType()),
        T.StructField("shipping_cost", T.DoubleType()),
        T.StructField("order_priority", T.StringType()),
        T.StructField("perdida", T.DoubleType()),
        T.StructField("discount_rate", T.DoubleType()),
        T.StructField("metodo_pago", T.StringType()),
        T.StructField("raw_xml_data", T.StringType()),
    ]
)

# Header of the historical CSV -> canonical column.
CSV_COLUMNS = {
    "Row ID": "row_id",
    "Order ID": "order_id",
    "Order Date": "order_date",
    "Ship Date": "ship_date",
    "Ship Mode": "ship_mode",
    "Order Priority": "order_priority",
    "Customer Name": "customer_name",
    "Segment": "segment",
    "Country": "country",
    "Market": "market",
    "Category": "category",
    "Sub-Category": "sub_category",
    "Product Name": "product_name",
    "Sales": "sales",
    "Profit": "profit",
    "Shipping Cost": "shipping_cost",
    "Pérdida": "loss",
    "Quantity": "quantity",
    "Tasa Descuento": "discount_rate",
    "Monto Descuento": "discount_amount",
    "Metodo Pago": "payment_method",
    "Metadata XML": "invoice_json",
}

# Stored invoice field -> canonical column, where they differ.
INVOICE_COLUMNS = {
    "perdida": "loss",
    "metodo_pago": "payment_method",
    "raw_xml_data": "invoice_json",
}

# Columns a CSV upload must have, and columns the KPIs need.
UPLOAD_REQUIRED = ["Sales", "Profit", "Order Date", "Ship Date", "Category"]
KPI_REQUIRED = ["order_date", "sales", "profit"]
