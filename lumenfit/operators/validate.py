"""Fail-closed checks and alignment of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.functions.columns import INF, c, check_names, others


def require_unique_keys(df: DataFrame, keys: list[str], what: str = "table") -> None:
    lost = [k for k in keys if k not in df.columns]
    if lost:
        raise ValueError(f"{what} lacks key columns {lost}")
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"{what} has repeated keys")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n of the keys that stand in more than one row."""
    return df.groupBy(*map(c, keys)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_keys(X: DataFrame, Y: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of only one side, with ``side`` (x or y)."""
    mine = lambda d: d.select(*map(c, keys)).distinct()
    one = lambda a, b, s: mine(a).join(mine(b), keys, "left_anti").withColumn("side", F.lit(s))
    return one(X, Y, "x").unionByName(one(Y, X, "y"))


def require_matching_xy(X: DataFrame, Y: DataFrame, keys: list[str]) -> None:
    """Unique keys, the same keys on both sides, string names without repeats."""
    for d, what in ((X, "X"), (Y, "Y")):
        check_names(others(d, keys), f"{what} columns")
        require_unique_keys(d, keys, what)
    if not missing_keys(X, Y, keys).isEmpty():
        raise ValueError("X and Y must have the same keys")


def align_xy(X: DataFrame, Y: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides reduced to the keys that they share."""
    shared = X.select(*map(c, keys)).join(Y.select(*map(c, keys)), keys, "left_semi")
    if shared.isEmpty():
        raise ValueError("X and Y share no rows")
    return X.join(Y.select(*map(c, keys)), keys, "left_semi"), Y.join(X.select(*map(c, keys)), keys, "left_semi")


def joined(X: DataFrame, Y: DataFrame, keys: list[str], message: str = "X and Y must have the same keys") -> DataFrame:
    """Rows of both tables by key; a key of one side alone is an error when the rows are read."""
    one, two = X.withColumn("_in_x", F.lit(True)), Y.withColumn("_in_y", F.lit(True))
    both = F.col("_in_x") & F.col("_in_y")
    marked = one.join(two, keys, "full_outer").withColumn("_both", paired(both, F.lit(True), message))
    return marked.filter("_both").drop("_in_x", "_in_y", "_both")


def paired(both: Column, value: Column, message: str) -> Column:
    """The value where both sides have a row, else an error when the row is read."""
    return F.when(F.coalesce(both, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def numeric(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """Columns cast to double; empty tables, text that isn't a number, nulls and non-finite values are errors."""
    out = df.withColumns({n: c(n).try_cast("double") for n in columns})
    rows, odd = numeric_report(out, columns).first()
    if not rows:
        raise ValueError(f"{what} is empty")
    if odd:
        raise ValueError(f"{what} has {odd} rows with missing or non-finite values")
    return out


def numeric_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, and n_bad: rows where one of the columns is missing or isn't a finite number."""
    some = F.lit(False)
    for n in columns:
        x = c(n).try_cast("double")
        some = some | x.isNull() | F.isnan(x) | (F.abs(x) == INF)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(some).alias("n_bad"))


def ensure_id_columns(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """The table, if it has all id columns: a DataFrame has no index to take them from."""
    lost = [n for n in id_columns if n not in df.columns]
    if lost:
        raise KeyError(f"missing id columns {lost}")
    return df


def require_same_columns(train: DataFrame, holdout: DataFrame) -> None:
    if train.columns != holdout.columns:
        raise ValueError("train and holdout columns must match exactly and in order")
