"""Column checks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MissingColumns(ValueError):
    """A dataset lacks columns it must have."""

    def __init__(self, missing: list):
        self.missing = missing
        super().__init__("missing columns: " + ", ".join(missing))


def require_columns(df: DataFrame, required: list) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise MissingColumns(missing)
    return df


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add the columns ``df`` lacks with their default value."""
    return df.withColumns({name: F.lit(value) for name, value in defaults.items() if name not in df.columns})
