"""Labels, names and JSON texts."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Company endings dropped from customer names, in this order.
COMPANY_SUFFIXES = [
    " S.A. de C.V.",
    " S. de R.L. de C.V.",
    " S.C.",
    " e Hijos",
    " Group México",
    " y Familia",
    " Industrial",
]


def short_label(name: Column, n: int = 20) -> Column:
    """First ``n`` characters, always followed by dots."""
    return F.concat(F.substring(name, 1, n), F.lit("..."))


def clean_customer_name(name: Column, n: int = 20) -> Column:
    """Drop company endings, then cut names longer than ``n``."""
    cleaned = name
    for suffix in COMPANY_SUFFIXES:
        cleaned = F.regexp_replace(cleaned, "(?iu)" + suffix.replace(".", r"\."), "")
    cleaned = F.coalesce(cleaned, F.lit(""))
    return F.when(F.length(cleaned) > n, short_label(cleaned, n)).otherwise(cleaned)


def json_preview(text: Column, n: int = 25) -> Column:
    """Start of a JSON text for a table cell; "-" if missing."""
    return F.coalesce(short_label(text, n), F.lit("-"))


@F.pandas_udf(T.StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """Indent JSON for people; a text that is no JSON stays as it is.

    For exports of selected rows: Spark's JSON writer has no indented form.
    """

    def indent(text):
        try:
            return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except ValueError:
            return text

    return texts.map(indent, na_action="ignore")


def document_field(json: Column, path: str, kind: str = "string") -> Column:
    """One field of a stored document, by a path such as ``$.Receptor.Nombre`` or ``$.Conceptos.Concepto[0].Importe``.

    The text is read as a VARIANT, inside Spark; what is no JSON, has no such
    field or does not fit ``kind`` gives NULL.
    """
    return F.try_variant_get(F.try_parse_json(json), path, kind)
