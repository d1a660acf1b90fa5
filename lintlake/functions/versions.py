"""Three-part versions out of requirement texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of


def bare_version(spec) -> Column:
    """Text from the first digit on."""
    return F.regexp_replace(col_of(spec), r"\A[^0-9]*", "")


def parse_version(spec) -> Column:
    """Struct (major, minor, patch); parts that are no number count as 0."""
    parts = F.split(bare_version(spec), r"\.", -1)
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def version_less(left, right) -> Column:
    return parse_version(left) < parse_version(right)


def has_digits(spec) -> Column:
    return col_of(spec).rlike("[0-9]")
