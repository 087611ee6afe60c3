"""One rule for missing values: NULL and NaN are missing, and missing never passes, matches or groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a number looks like; Spark alone would read "1d" as 1.0.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def missing(df: DataFrame, name: str) -> Column:
    """True where a column of ``df`` holds no value."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return column.isNull() | F.isnan(column)
    if isinstance(kind, T.VariantType):
        return column.isNull() | F.is_variant_null(column)
    return column.isNull()


def present(df: DataFrame, name: str) -> Column:
    return ~missing(df, name)


def to_number(column: Column) -> Column:
    """Text or number as DOUBLE; what is no finite number is NULL."""
    text = column.cast("string")
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def clean(column: Column) -> Column:
    """NaN as NULL and -0.0 as 0.0."""
    return F.when(~F.isnan(column), column + F.lit(0.0))


def to_timestamp(column: Column) -> Column:
    """Text as TIMESTAMP_NTZ; what can't be read is NULL."""
    return column.try_cast("timestamp_ntz")
