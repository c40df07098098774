"""Missing values and numbers as text: one meaning of null at the edge of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pocketloom.runtime import SPACE

# What a CSV reader of data frames takes as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def present(column: Column) -> Column:
    """Text as it stands, null where it is one of the tokens for a missing value."""
    return F.when(~column.isin(NA_TOKENS), column)


def no_nan(column: Column) -> Column:
    """A number, null where it is NaN."""
    return F.when(~F.isnan(column.cast("double")), column)


def lenient_double(column: Column) -> Column:
    """Text as a number; null where it is none or NaN. Suffixes such as 1.5d, which a cast accepts, are no numbers."""
    text = column.cast("string")
    return no_nan(F.when(text.rlike(_NUMBER) | text.rlike(_SPECIAL), F.trim(text).try_cast("double")))


def strict_double(column: Column, name: str = "value") -> Column:
    """Text as a number; null stays null, NaN becomes null, anything else fails when the row is computed."""
    text = column.cast("string")
    bad = text.isNotNull() & ~(text.rlike(_NUMBER) | text.rlike(_SPECIAL))
    fail = F.raise_error(F.concat(F.lit(f"{name} is not a number: "), text)).cast("double")
    return F.when(bad, fail).otherwise(lenient_double(column))


def whole_number(column: Column) -> Column:
    """A number that is a whole one, as int; null for others."""
    number = lenient_double(column)
    return F.when((number == F.floor(number)) & (F.abs(number) < 2**31), number.cast("int"))


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN of all float columns as null."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")]
    return df.withColumns({c: no_nan(F.col(f"`{c}`")) for c in floats})


def stripped(column: Column) -> Column:
    """Text without white space at either end, tabs and line breaks included."""
    return F.btrim(column.cast("string"), F.lit(SPACE))
