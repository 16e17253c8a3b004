"""Deterministic stratified sampling and splitting.

Rows of a stratum are ordered by a digest of seed and key, so the choice doesn't
depend on partitioning and any engine can repeat it.  Places are counted in two
steps, by blocks of the digest and inside blocks, so that a stratum with most of
the rows isn't sorted in one task.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenfit.functions.columns import c, order_hash, unique
from lumenfit.operators import validate

BLOCK_DIGITS = 3  # of the hex digest: 4096 blocks to a stratum


def places(df: DataFrame, strata: list[str], keys: list[str], seed: int) -> DataFrame:
    """``df`` with ``_place`` (1, 2, .. in its stratum's shuffle) and ``_size`` (rows of the stratum)."""
    by = [c(s) for s in strata]
    order = order_hash(seed, keys)
    marked = df.withColumn("_block", F.substring(order, 1, BLOCK_DIGITS))
    named = [f"_s{i}" for i in range(len(strata))]
    counts = marked.groupBy(*(b.alias(n) for b, n in zip(by, named, strict=True)), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*named).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_size", F.sum("_n").over(W.partitionBy(*named)))
    on = F.col("_block") == F.col("_b")
    for b, n in zip(by, named, strict=True):
        on = on & b.eqNullSafe(F.col(n))
    inside = W.partitionBy(*by, "_block").orderBy("_order", *map(c, keys))
    dealt = marked.join(F.broadcast(counts) if not strata else counts, on).repartition(*by, "_block")
    # digests are made anew where blocks are sorted: sent along, they would be most of the shuffle
    out = dealt.withColumn("_order", order).withColumn("_place", F.row_number().over(inside) + F.col("_before"))
    return out.drop(*named, "_b", "_n", "_before", "_order", "_block")


def quotas(sizes: dict, fraction: float) -> dict:
    """Rows of each stratum for a share of all: largest remainders, ties by stratum order."""
    total = int(sum(sizes.values()) * fraction + 0.5)
    exact = {k: n * fraction for k, n in sizes.items()}
    out = {k: int(v) for k, v in exact.items()}
    order = sorted(sizes, key=lambda k: (-(exact[k] - out[k]), [(x is not None, str(x)) for x in k]))
    for k in order[: max(0, total - sum(out.values()))]:
        out[k] += 1
    return out


def _assign(df: DataFrame, strata: list[str], keys: list[str], shares: list[tuple[str, float]], rest: str, seed: int) -> DataFrame:
    """``df`` with ``partition``: the first places of each stratum to the first share, and so on."""
    placed = places(df, strata, keys, seed)
    sizes = {tuple(r[:-1]): r[-1] for r in df.groupBy(*map(c, strata)).count().collect()} if strata else {(): df.count()}
    left, cut = dict(sizes), dict.fromkeys(sizes, 0)
    label: Column = F.lit(rest)
    bounds: list[tuple[str, dict, dict]] = []
    taken = 0.0
    for name, share in shares:
        got = quotas(left, share / (1 - taken))
        bounds.append((name, dict(cut), {k: cut[k] + got[k] for k in cut}))
        cut = bounds[-1][2]
        left = {k: left[k] - got[k] for k in left}
        taken += share
    spark = df.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"_t{i} {kinds[s]}" for i, s in enumerate(strata)), *(f"_u{i} long" for i in range(len(bounds)))])
    rows = [(*k, *(b[2][k] for b in bounds)) for k in sizes]
    if not rows:
        return placed.withColumn("partition", label).drop("_place", "_size")
    table = spark.createDataFrame(rows, schema)  # one row a stratum
    on = F.lit(True)
    for i, s in enumerate(strata):
        on = on & c(s).eqNullSafe(F.col(f"_t{i}"))
    out = placed.join(F.broadcast(table) if len(rows) <= 10_000 else table, on)
    for i in reversed(range(len(bounds))):
        label = F.when(F.col("_place") <= F.col(f"_u{i}"), bounds[i][0]).otherwise(label)
    return out.withColumn("partition", label).drop("_place", "_size", *(f"_t{i}" for i in range(len(strata))), *(f"_u{i}" for i in range(len(bounds))))


class SealedTestAccessError(RuntimeError):
    """The test part was asked for before it was unsealed."""


@dataclass
class SealedSplitResult:
    train: DataFrame
    val: DataFrame
    balance: DataFrame
    _test: DataFrame
    _log: list[dict[str, str]] = field(default_factory=list)
    _open: bool = False

    @property
    def test(self) -> DataFrame:
        if not self._open:
            raise SealedTestAccessError("the test part is sealed; call unseal(reason=...) once model choices are final")
        return self._test

    @property
    def is_unsealed(self) -> bool:
        return self._open

    def unseal(self, *, reason: str) -> DataFrame:
        if not isinstance(reason, str) or not reason.strip():
            raise ValueError("unsealing needs a reason")
        self._log.append({"reason": reason, "unsealed_at": datetime.datetime.now(datetime.UTC).isoformat()})
        self._open = True
        return self._test

    @property
    def unseal_log(self) -> list[dict[str, str]]:
        return [dict(e) for e in self._log]


def split_partitions(df: DataFrame, *, strata_column: str, keys: list[str], val_fraction: float = 0.15, test_fraction: float = 0.15, random_state: int = 42) -> DataFrame:
    """``df`` with ``partition``: test, val or train."""
    if not (0 < val_fraction < 1 and 0 < test_fraction < 1 and val_fraction + test_fraction < 1):
        raise ValueError("val_fraction and test_fraction must be positive and leave a training part")
    if strata_column not in df.columns:
        raise ValueError(f"no column {strata_column!r}")
    return _assign(df, [strata_column], keys, [("test", test_fraction), ("val", val_fraction)], "train", random_state)


def make_sealed_split(df: DataFrame, *, strata_column: str, keys: list[str], val_fraction: float = 0.15, test_fraction: float = 0.15, random_state: int = 42) -> SealedSplitResult:
    """Stratified train, validation and sealed test parts, and their balance table."""
    validate.require_unique_keys(df, keys, "data")
    marked = split_partitions(df, strata_column=strata_column, keys=keys, val_fraction=val_fraction, test_fraction=test_fraction, random_state=random_state)
    part = lambda p: marked.filter(F.col("partition") == p).drop("partition")
    balance = marked.groupBy(c(strata_column).alias("stratum")).pivot("partition", ["train", "val", "test"]).count().na.fill(0).orderBy("stratum")
    return SealedSplitResult(part("train"), part("val"), balance, part("test"))


def stratified_holdout_split(X: DataFrame, Y: DataFrame, *, keys: list[str], holdout_fraction: float = 0.05, random_state: int = 123, scenario_column: str = "scenario", stratify_columns: Iterable[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """X_train, X_holdout, Y_train, Y_holdout of the shared keys.

    Strata are the given columns themselves, else the scenario column if there is one, else none.
    """
    if not 0 < holdout_fraction < 1:
        raise ValueError("holdout_fraction must lie between 0 and 1")
    strata = unique(stratify_columns)
    if lost := [s for s in strata if s not in X.columns]:
        raise ValueError(f"no columns {lost}")
    if not strata and scenario_column in X.columns:
        strata = [scenario_column]
    X, Y = validate.align_xy(X, Y, keys)
    marked = _assign(X.select(*map(c, unique([*keys, *strata]))), strata, keys, [("holdout", holdout_fraction)], "train", random_state)
    ids = lambda p: marked.filter(F.col("partition") == p).select(*map(c, keys))
    pick = lambda d, p: d.join(ids(p), keys, "left_semi")
    return pick(X, "train"), pick(X, "holdout"), pick(Y, "train"), pick(Y, "holdout")


def combination_labels(df: DataFrame, *, columns: list[str], output_column: str = "combination") -> DataFrame:
    """``df`` with labels like ``a=1|b=x``."""
    if not columns:
        raise ValueError("columns must not be empty")
    if lost := [n for n in columns if n not in df.columns]:
        raise ValueError(f"no columns {lost}")
    return df.withColumn(output_column, F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.coalesce(c(n).cast("string"), F.lit("null"))) for n in columns)))


def stratified_subset_by_combination(df: DataFrame, *, columns: list[str], keys: list[str], n_per_combination: int = 5000, random_state: int = 123, require_all_combinations: bool = True) -> DataFrame:
    """Exactly n rows of each combination; one that has fewer is an error, or left out."""
    if n_per_combination <= 0:
        raise ValueError("n_per_combination must be positive")
    if not columns or any(n not in df.columns for n in columns):
        raise ValueError("columns must be present")
    if require_all_combinations:
        short = df.groupBy(*map(c, columns)).count().filter(F.col("count") < n_per_combination)
        if not short.isEmpty():
            raise ValueError(f"some combinations have fewer than {n_per_combination} rows")
    return places(df, columns, keys, random_state).filter((F.col("_place") <= n_per_combination) & (F.col("_size") >= n_per_combination)).drop("_place", "_size")


def fold_ids(df: DataFrame, keys: list[str], cv: int, seed: int | None = None) -> DataFrame:
    """``df`` with ``fold``: contiguous shares of the order of the key's digest; folds differ by a row at most."""
    if cv < 2:
        raise ValueError("cross-validation needs two folds")
    return places(df, [], keys, 0 if seed is None else seed).withColumn("fold", F.floor((F.col("_place") - 1) * cv / F.col("_size")).cast("int")).drop("_place", "_size")
