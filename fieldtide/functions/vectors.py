"""Array expressions: masking, encoding, argmax."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtide.constants import BANDS
from fieldtide.functions import text


def zscore(x: Column, mean: Column | float, std: Column | float) -> Column:
    """(x - mean) / std, with zero kept as zero (padding)."""
    return F.when(x != 0, (x - mean) / std).otherwise(F.lit(0.0))


def one_hot(label: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == label).cast("int"))


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def name_of(index: Column, names: Sequence[str]) -> Column:
    return F.element_at(text.words(names), index + 1)


def probability_columns(probs: str, names: Sequence[str]) -> list[Column]:
    return [F.col(probs)[i].alias(f"prob_{n}") for i, n in enumerate(names)]


def band_array() -> Column:
    return F.array(*BANDS)


def entries(values: str) -> Column:
    """An array column as the argument of explode or inline.

    Exploding a bare column makes the optimizer derive a non-empty filter and
    carry it through every projection below; over wide derived arrays those
    constraints double with each column. A guarded expression keeps the same rows
    (null and empty arrays give none) without that.
    """
    return F.when(F.size(values) > 0, F.col(values))


def held(values: str) -> Column:
    """An array column as the argument of explode, computed once per row.

    Like `entries`; but a derived column would be computed there for its size and for its values.
    """
    return let(F.col(values), lambda v: F.when(F.size(v) > 0, v))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row.

    A plain expression used inside a lambda runs again for every element, and
    the optimizer may inline a column that looks like it is used only once there.
    """
    return F.transform(F.array(value), body)[0]
