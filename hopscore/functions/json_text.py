"""Whether a text is JSON: readers of stored texts reject what is not, instead of reading NULLs from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json(text: Column) -> Column:
    """True for a JSON text of any kind, false for any other text, and for NULL."""
    return F.try_parse_json(text).isNotNull()


def is_object(text: Column) -> Column:
    """True for a JSON object."""
    return is_json(text) & F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{"))


def required(text: Column, good: Column, problem: str) -> Column:
    """The text; an error with its beginning where it is there and not good."""
    broken = F.raise_error(F.concat(F.lit(f"{problem}: "), F.left(text, F.lit(200)))).cast("string")
    return F.when(text.isNull() | good, text).otherwise(broken)
