"""Text keys, identities, seasons and deterministic draws as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(value: Column) -> Column:
    """White space removed and letters lowered; a blank key is NULL."""
    return F.nullif(F.lower(F.regexp_replace(value, r"\s+", "")), F.lit(""))


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def identity(prefix: str, value: Column) -> Column:
    """A stable id: the prefix and 20 hexadecimal digits of the value's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, 20))


def seed_for(base: int, name: Column) -> Column:
    """A scope's seed in [0, 2**32) from a base and the scope's name."""
    return (F.lit(base) + F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")) % F.lit(1 << 32)


def draw(seed: int | str, *parts: Column) -> Column:
    """A reproducible uniform in (0, 1) from MD5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def season(day: Column) -> Column:
    month = F.month(day)
    return F.when(month.between(3, 5), "spring").when(month.between(6, 8), "summer").when(month.between(9, 11), "autumn").when(month.isNotNull(), "winter")


def season_year(day: Column, winter_only: bool = False) -> Column:
    """The year a season belongs to: December counts to the next one (in one rule only within winter)."""
    late = F.month(day) == 12
    if winter_only:
        late = late & (season(day) == "winter")
    return F.year(day) + late.cast("int")


def set_digest(values: Column) -> Column:
    """SHA-256 over the sorted distinct values of a group, joined by new lines."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(values)), "\n"), 256)
