"""Input checks. Only these functions run a job before the caller asks for rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import POLARITIES


class MissingInput(RuntimeError):
    """A table or column an operator needs is not there."""


class InvalidLabels(ValueError):
    """A label column holds values outside the allowed set."""


def require_data(*tables) -> None:
    if any(t is None for t in tables):
        raise MissingInput("pre-computed cube or product table not found; build and write it first")


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingInput(f"missing required columns: {missing}")
    return df


def invalid_values(df: DataFrame, column: str, allowed=POLARITIES) -> DataFrame:
    """Distinct values outside the allowed set."""
    return df.select(column).where(~F.col(column).isin(*allowed)).distinct()


def require_values(df: DataFrame, column: str, allowed=POLARITIES, show: int = 20) -> DataFrame:
    bad = invalid_values(df, column, allowed)
    first = [r[0] for r in bad.orderBy(column).take(show)]
    if first:
        more = bad.count() - len(first)
        rest = f" and {more} more" if more else ""
        raise InvalidLabels(f"invalid values in {column}: {first}{rest}; use one of {sorted(allowed)}")
    return df


def or_none(df: DataFrame):
    """None in place of an empty table, for the presentation edge."""
    return None if df.isEmpty() else df
