"""Column helpers: names with any characters, finite values, fixed order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def c(name: str) -> Column:
    """The column of exactly this name: dots, stars and blanks have no meaning."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(value: Column) -> Column:
    """The value, or null where it isn't a finite number."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != INF), x)


def order_hash(seed: int, keys: Iterable[str]) -> Column:
    """A digest of seed and key whose order is a reproducible shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c(k).cast("string") for k in keys)))


def unique(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))


def check_names(names: list[str], what: str) -> list[str]:
    if not names or not all(isinstance(n, str) and n for n in names):
        raise ValueError(f"{what} must contain non-empty strings")
    if len(set(names)) != len(names):
        raise ValueError(f"{what} must not contain duplicate names")
    return list(names)


def others(df: DataFrame, keys: Iterable[str]) -> list[str]:
    held = set(keys)
    return [n for n in df.columns if n not in held]
