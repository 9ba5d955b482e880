"""Identifier columns: one textual form and one notion of absence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that mean that no reference is given.
ABSENT = ("", "nan", "none", "null")


def reference_id(c: Column) -> Column:
    """The id without outer spaces as a string; null where it names nothing."""
    s = F.regexp_replace(c.cast("string"), r"^[\s ]+|[\s ]+$", "")
    return F.when(~F.lower(s).isin(*ABSENT), s)
