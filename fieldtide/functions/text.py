"""Scene ids, catalog properties, hashes and small text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtide.constants import COVERAGE_KEYS, SCL_NAMES


def scene_base(scene_id: Column) -> Column:
    """Id without its version and level parts."""
    return F.regexp_extract(scene_id, r"^(.*)_[^_]*_[^_]*$", 1)


def scene_version(scene_id: Column) -> Column:
    return F.element_at(F.split(scene_id, "_"), -2).cast("int")


def scene_grid(scene_id: Column) -> Column:
    """Grid square, the second part of the id."""
    return F.split(scene_id, "_")[1]


def scene_tile(scene_id: Column) -> Column:
    """Tile key: grid square and version."""
    return F.concat_ws("_", scene_grid(scene_id), F.element_at(F.split(scene_id, "_"), -2))


def scene_date(datetime: Column) -> Column:
    """Date part of an ISO datetime (text or timestamp)."""
    return F.to_date(F.substring_index(datetime.cast("string").substr(1, 10), "T", 1))


def json_property(doc: Column, key: str, default: float = 0) -> Column:
    """Numeric property of a JSON document, or the default when it is absent."""
    value = F.get_json_object(doc, f"$['{key}']").cast("double")
    return F.coalesce(value, F.lit(float(default)))


def coverage(doc: Column) -> Column:
    total = json_property(doc, COVERAGE_KEYS[0])
    for key in COVERAGE_KEYS[1:]:
        total = total + json_property(doc, key)
    return total


def missing_keys(doc: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.get_json_object(doc, f"$['{k}']").isNull(), F.lit(k)) for k in COVERAGE_KEYS]))


def split_list(text: Column) -> Column:
    """One argument text to a list: on "|" when it has one, else on ","."""
    return F.when(text.contains("|"), F.split(text, "\\|")).otherwise(F.split(text, ","))


def scl_name(code: Column) -> Column:
    pairs = [F.lit(x) for item in SCL_NAMES.items() for x in item]
    return F.element_at(F.create_map(*pairs), code)


def words(values: Sequence[str]) -> Column:
    """Constant list of strings (one expression, folded to a literal)."""
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({', '.join(quoted)})")


def seeded_hash(*parts: Column, seed: int = 42) -> Column:
    """Portable 32-bit hash of text parts (first eight hex digits of their md5)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def micro_degrees(x: Column) -> Column:
    """Coordinate as whole millionths: an engine-independent key text."""
    return F.round(x * 1000000).cast("bigint")


def prediction_date(year: Column, start_day: Column, days_in_series: int) -> Column:
    """Date of day-of-year `start_day + days_in_series`."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)),
                      (start_day + (days_in_series - 1)).cast("int"))
