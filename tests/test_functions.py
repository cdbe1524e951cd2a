import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import tallyline as tl
from tallyline.functions.bands import BAND_EDGES, BAND_LABELS
from tallyline.functions.numbers import number_text

NUMBER_TEXTS = [
    "1,234.50", "-12.3", "-", " - ", "(5)", "$7", "", "5d", "5f", " 5 ", "5.", ".5", "1e3", "1E+3", "+5", "--5", "5-",
    "1_000", "0x1A", "0x1p3", "inf", "-inf", "Infinity", "-INFINITY", "nan", "1d", "True", "5\t", "\n5", "1 000",
    "1e400", "- 5", "1e", "e5", ".", "1.5.2", "-.5e-3", "5L", "None", "null", "1,2,3.4", "infinit",
]


def test_clean_number_matches_brute_force(values):
    cells = pd.Series(NUMBER_TEXTS).str.replace(",", "").replace("-", "0")
    expected = [0.0 if math.isnan(x) else x for x in (pd.to_numeric(pd.Series([c]), errors="coerce")[0] for c in cells)]
    assert values(tl.clean_number, NUMBER_TEXTS) == expected


def test_clean_number_of_missing_is_zero(values):
    assert values(tl.clean_number, [None]) == [0.0]


def test_clean_rate(values):
    texts = ["40.00%", " 5 %", "0.15", "x", None, "", "-5%", "12"]
    assert values(tl.clean_rate, texts) == pytest.approx([0.4, 0.05, 0.0015, 0, 0, 0, -0.05, 0.12])
    fraction = values(lambda c: tl.clean_rate(c, "fraction"), texts)
    assert fraction == pytest.approx([0.4, 0.05, 0.15, 0, 0, 0, -0.05, 12])
    with pytest.raises(ValueError):
        tl.clean_rate(F.lit("1"), "permille")


def test_round_exact_is_binary_rounding(values):
    random.seed(5)
    numbers = [2.675, 0.125, 0.375, 1.005, -0.575, 0.0, 1e14 + 0.125, 12345678.905]
    numbers += [random.uniform(-1e6, 1e6) for _ in range(500)] + [round(random.random() * 100, 3) for _ in range(500)]
    assert values(tl.round_exact, numbers, "double") == [round(x, 2) for x in numbers]
    assert values(lambda c: tl.round_exact(c, 4), numbers, "double") == [round(x, 4) for x in numbers]


def test_round_exact_passes_what_it_cannot_round(values):
    found = values(tl.round_exact, [None, float("inf"), 1e300], "double")
    assert found == [None, float("inf"), 1e300]


def test_texts_of_numbers(values):
    assert values(number_text, [5.0, 1234.5, 1e8, 123456789.25, 0.0, -2e7, None, 0.00025], "double") == [
        "5.0", "1234.5", "100000000.0", "123456789.25", "0.0", "-20000000.0", None, "0.00025",
    ]
    assert values(tl.percent_text, [0.1234, 0.0, 0.00125, 1.0, 12.5, -0.00125], "double") == [
        "12.34%", "0.00%", "0.13%", "100.00%", "1250.00%", "-0.13%",
    ]
    assert values(tl.usd_text, [-924000.7, 0.0, 1234567.4], "double") == ["$-924,001 USD", "$0 USD", "$1,234,567 USD"]
    assert values(lambda c: tl.trend_text(c, signed=True), [5.0, -3.456, 0.0], "double") == ["+5.0%", "-3.46%", "+0.0%"]


def test_finite_or_zero(values):
    found = values(tl.finite_or_zero, [1.5, None, float("nan"), float("inf"), float("-inf")], "double")
    assert found == [1.5, 0, 0, 0, 0]


def test_whole_quantity(values):
    assert values(tl.whole_quantity, ["2.7", "-2.7", "1e2", "x", None]) == [2, -2, 100, None, None]


def test_lead_days_floor(spark):
    pairs = [
        ("2024-01-02 00:00:00", "2024-01-01 06:00:00", -1),  # 18 hours back
        ("2024-01-01 12:00:00", "2024-01-02 11:59:59", 0),
        ("2024-01-01 12:00:00", "2024-01-02 12:00:00", 1),
        ("2024-01-01 00:00:00", "2024-01-01 00:00:00", 0),
        ("2024-01-03 00:00:00", "2024-01-01 00:00:00", -2),
        ("2024-03-31 01:00:00", "2024-04-01 00:30:00", 0),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    a, b = F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")
    for row in df.select(tl.lead_days(a, b).alias("d"), "n").collect():
        assert row.d == row.n


def test_calendar_labels(values):
    assert values(tl.month_label, [1, 12, 13, None], "int") == ["Ene", "Dic", None, None]
    day = dt.datetime(2024, 3, 5, 7, 8, 9)
    assert values(tl.short_date, [day, None], "timestamp_ntz") == ["5/3/2024", "-"]
    assert values(tl.date_text, [day, day.replace(microsecond=500000)], "timestamp_ntz") == [
        "2024-03-05T07:08:09", "2024-03-05T07:08:09.5",
    ]
    noon, night = dt.datetime(2020, 7, 1, 17, 5), dt.datetime(2020, 1, 1, 6, 0)
    assert values(tl.mexico_time, [noon, night, None], "timestamp_ntz") == [
        "01/07/2020 12:05 PM", "01/01/2020 12:00 AM", "-",
    ]


def test_invoice_date(values):
    texts = ["2024-01-05", "2024-01-05T10:20:30", "2024-01-05T10:20", "2024-01-05T10:20:30-06:00", "5/1/2024",
             "2024-13-01", "2024-1-5", "", None]
    day = dt.datetime(2024, 1, 5)
    expected = [day, day.replace(hour=10, minute=20, second=30), day.replace(hour=10, minute=20),
                day.replace(hour=10, minute=20, second=30)] + [None] * 5
    assert values(tl.invoice_date, texts) == expected
    filled = values(lambda c: tl.invoice_date(c, "2000-01-01 00:00:00"), texts)
    assert filled[4:] == [dt.datetime(2000, 1, 1)] * 5


def test_catalogues(values):
    assert values(tl.state_from_postal, ["01000", "72500", "9", "", None, "99123"]) == [
        "CDMX", "Puebla", "CDMX", "CDMX", "CDMX", "Otros Estados",
    ]
    assert values(tl.category_from_key, ["43211500", "81", "56101500", "4", "", None, "01010101"]) == [
        "Technology", "Technology", "Furniture", "Office Supplies", "Office Supplies", "Office Supplies",
        "Office Supplies",
    ]
    assert values(lambda c: tl.estimated_profit(c, F.lit(2.3)), ["Technology", "Furniture", "Office Supplies", "x"]) == [
        round(2.3 * 0.25, 2), round(2.3 * 0.10, 2), round(2.3 * 0.30, 2), round(2.3 * 0.20, 2),
    ]
    assert values(lambda c: tl.line_discount_rate(c, F.lit(1.0)), [2.0, -1.0, 0.0], "double") == [0.3333, 0.0, 1.0]
    assert values(tl.ship_mode_from_payment, ["PUE", "PPD", None]) == ["Express", "Estándar", "Express"]


def test_names(values):
    names = ["Uno S.A. de C.V.", "Dos s. DE r.l. de c.v.", "Muebles Industrial e Hijos y Familia", "GROUP México",
             "Tres GROUP MÉXICO", "Un nombre que es bastante largo", None, "S.C. Abc S.C."]
    assert values(tl.clean_customer_name, names) == [
        "Uno", "Dos", "Muebles", "GROUP México", "Tres", "Un nombre que es bas...", "", "S.C. Abc",
    ]
    assert values(tl.short_label, ["abc", "x" * 30]) == ["abc...", "x" * 20 + "..."]
    assert values(tl.json_preview, ['{"a": 1}', None]) == ['{"a": 1}...', "-"]
    assert values(tl.pretty_json, ['{"a": ["é"]}', "no json", None]) == [
        '{\n  "a": [\n    "é"\n  ]\n}', "no json", None,
    ]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_bands_match_brute_force(values, kind):
    random.seed(1)
    rates = [-1, -0.001, -0.0005, 0, 0.05, 0.1, 0.15, 0.2, 2.0, 2.0001, 0.0500001, None, float("nan")]
    rates += [round(random.random() * 0.3, 2) for _ in range(300)]
    rates = [None if r is None else float(r) for r in rates]
    cells = pd.Series(rates, dtype="float32" if kind == "float" else "float64")
    expected = [None if pd.isna(b) else b for b in pd.cut(cells, BAND_EDGES, labels=BAND_LABELS)]
    assert values(tl.discount_band, rates, kind) == expected
