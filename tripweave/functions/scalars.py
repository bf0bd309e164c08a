"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_pad(text: Column, width: int = 3) -> Column:
    """Left-pad with zeros; text that is already longer stays whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def concat_ids(*parts: Column) -> Column:
    """Joined id, null when any part is null."""
    return F.concat(*parts)


def round_to_multiple(value: Column, factor: float) -> Column:
    """Nearest multiple of ``factor``, halves to even."""
    return F.rint(value / F.lit(float(factor))) * F.lit(float(factor))


def expansion_factor(population: Column, users: Column) -> Column:
    """People represented by one user; null where a zone has no user."""
    return F.try_divide(population.cast("double"), users.cast("double"))


def log10_positive(value: Column) -> Column:
    """log10, null for values that have none."""
    return F.when(value > 0, F.log10(value))


def fill_int(value: Column, dtype: str = "bigint") -> Column:
    return F.coalesce(value, F.lit(0)).cast(dtype)


def truncated_weight(weight: Column) -> Column:
    """Survey weight as the whole number of people it stands for."""
    return F.coalesce(weight.cast("bigint"), F.lit(0).cast("bigint"))
