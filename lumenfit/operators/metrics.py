"""Range-normalised errors over long tables (output_name, value by key)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.functions.columns import c, others
from lumenfit.operators import validate


def long(df: DataFrame, keys: list[str], value: str, outputs: list[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each key and output: keys, keep, output_name, output_position, ``value`` (NaN as null)."""
    outputs = others(df, [*keys, *keep]) if outputs is None else outputs
    cells = F.array(*(F.struct(F.lit(n).alias("output_name"), F.nanvl(c(n).cast("double"), F.lit(None).cast("double")).alias(value)) for n in outputs))
    return df.select(*map(c, [*keys, *keep]), F.posexplode(cells).alias("output_position", "_c")).select(*map(c, [*keys, *keep]), "output_position", "_c.*")


def ranges(Y_ref: DataFrame, keys: list[str], outputs: list[str] | None = None) -> DataFrame:
    """output_name, output_position, ref_min, ref_max, ref_range, ref_variance (population; missing values left out)."""
    v = F.col("v")
    return long(Y_ref, keys, "v", outputs).groupBy("output_name", "output_position").agg(F.min(v).alias("ref_min"), F.max(v).alias("ref_max"), (F.max(v) - F.min(v)).alias("ref_range"), F.var_pop(v).alias("ref_variance"))


def errors(Y_true: DataFrame, Y_pred: DataFrame, keys: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """keys, keep, output_name, output_position, e2: squared differences.

    Both tables must have the same outputs and the same keys; a key of one side
    alone is an error when the rows are read.
    """
    outputs = others(Y_true, [*keys, *keep])
    if outputs != others(Y_pred, keys):
        raise ValueError("Y_true and Y_pred must have the same output columns in order")
    pred = Y_pred.select(*map(c, keys), *(c(n).alias(f"_p_{n}") for n in outputs))
    rows = validate.joined(Y_true, pred, keys, "Y_true and Y_pred must have the same rows")
    squares = (F.pow(c(n).cast("double") - c(f"_p_{n}").cast("double"), 2).alias(n) for n in outputs)
    return long(rows.select(*map(c, [*keys, *keep]), *squares), keys, "e2", outputs, keep)


def errors_of_two(Y_true: DataFrame, Y_pred_a: DataFrame, Y_pred_b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, output_name, e2, b2: squared differences of two predictions, for keys that all three tables have.

    Rows are joined before they are cut into cells, by keys alone, so tables
    that lie together by key aren't dealt anew.
    """
    outputs = others(Y_true, keys)
    rows = Y_true
    for mark, pred in (("a", Y_pred_a), ("b", Y_pred_b)):
        rows = rows.join(pred.select(*map(c, keys), *(c(n).alias(f"_{mark}_{n}") for n in outputs)), keys)
    square = lambda n, mark: F.pow(c(n).cast("double") - c(f"_{mark}_{n}").cast("double"), 2)
    known = lambda x: F.nanvl(x, F.lit(None).cast("double"))
    cells = F.array(*(F.struct(F.lit(n).alias("output_name"), known(square(n, "a")).alias("e2"), known(square(n, "b")).alias("b2")) for n in outputs))
    return rows.select(*map(c, keys), F.explode(cells).alias("_c")).select(*map(c, keys), "_c.*")


def _mean_all(x: Column) -> Column:
    """Mean of all rows: null as soon as one is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def per_output(err: DataFrame, ref: DataFrame, min_range: float = 1e-6, by: Sequence[str] = ()) -> DataFrame:
    """by, output_name, rmse, ref_range, nrmse (null if not included), included_in_macro."""
    rmse = err.groupBy(*map(c, by), "output_name", "output_position").agg(F.sqrt(_mean_all(F.col("e2"))).alias("rmse"), F.count(F.lit(1)).alias("n_rows"))
    out = rmse.join(ref.drop("output_position"), "output_name").withColumn("included_in_macro", F.coalesce(F.col("ref_range") >= min_range, F.lit(False)))
    return out.withColumn("nrmse", F.when(F.col("included_in_macro"), F.col("rmse") / F.col("ref_range")))


def per_output_nrmse_frame(Y_true: DataFrame, Y_pred: DataFrame, Y_ref: DataFrame, *, keys: list[str], min_range: float = 1e-6) -> DataFrame:
    table = per_output(errors(Y_true, Y_pred, keys), ranges(Y_ref, keys, others(Y_true, keys)), min_range)
    return table.select("output_name", "rmse", "ref_range", "nrmse", "included_in_macro")


def summarise(table: DataFrame, by: Sequence[str] = (), tails: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """Macro, median, tails and worst output (the first of equals) of a per-output table."""
    used = F.col("included_in_macro")
    worst = F.max(F.when(F.col("nrmse").isNotNull(), F.struct(F.col("nrmse").alias("v"), (-F.col("output_position")).alias("p"), F.col("output_name").alias("n"))))
    return table.groupBy(*map(c, by)).agg(
        F.count_if(used).alias("n_outputs_used"), F.count(F.lit(1)).alias("n_outputs_total"), F.avg("nrmse").alias("macro_nrmse"), F.percentile("nrmse", F.lit(0.5)).alias("median_nrmse"),
        *(F.percentile("nrmse", F.lit(float(q))).alias(f"tail_{int(round(q * 100))}") for q in tails), worst["n"].alias("worst_output"), worst["v"].alias("worst_nrmse"), F.max("n_rows").alias("n_rows"), F.avg("rmse").alias("rmse_macro"),
    )


def macro_nrmse_with_ref(Y_true: DataFrame, Y_pred: DataFrame, Y_ref: DataFrame, *, keys: list[str], min_range: float = 1e-6) -> DataFrame:
    """macro_nrmse, k_used, k_total in one row."""
    table = per_output(errors(Y_true, Y_pred, keys), ranges(Y_ref, keys, others(Y_true, keys)), min_range)
    some = F.count(F.lit(1)) > 0
    none = "metrics need at least one evaluation row, reference row and output"
    used = F.count_if("included_in_macro").alias("k_used")
    return table.agg(F.avg("nrmse").alias("macro_nrmse"), used, validate.paired(some, F.count(F.lit(1)), none).alias("k_total"))


def stratified_nrmse_summary(Y_true: DataFrame, Y_pred: DataFrame, Y_ref: DataFrame, *, keys: list[str], strata: Sequence[str], min_range: float = 1e-6, tail_quantiles: Sequence[float] = (0.95, 0.99), metric_population: str = "included_outputs_all_rows") -> DataFrame:
    """One row overall and one for each value of each stratum column of Y_true; ranges are those of all reference rows.

    Rows are expanded once to their marginal groups, and one aggregation serves all.
    """
    outputs = others(Y_true, [*keys, *strata])
    err = errors(Y_true, Y_pred, keys, strata)
    groups = F.array(F.struct(F.lit("").alias("stratum_key"), F.lit("").alias("stratum_value")), *(F.struct(F.lit(s).alias("stratum_key"), c(s).cast("string").alias("stratum_value")) for s in strata))
    spread = err.withColumn("_g", F.explode(groups)).select("output_name", "output_position", "e2", "_g.*")
    by = ["stratum_key", "stratum_value"]
    table = summarise(per_output(spread, ranges(Y_ref, keys, outputs), min_range, by), by, tail_quantiles)
    label = F.when(F.col("stratum_key") == "", metric_population).otherwise(F.concat(F.lit(f"{metric_population}|"), "stratum_key", F.lit("="), F.coalesce("stratum_value", F.lit("null"))))
    return table.withColumn("metric_population", label)


def excluded_output_error_summary(Y_true: DataFrame, Y_pred: DataFrame, Y_ref: DataFrame, *, keys: list[str], min_range: float = 1e-6, domain_scale: dict[str, float] | None = None) -> DataFrame:
    """output_name, rmse, included, and the error over a domain scale (null for a scale that isn't positive)."""
    table = per_output(errors(Y_true, Y_pred, keys), ranges(Y_ref, keys, others(Y_true, keys)), min_range)
    scale = F.lit(None).cast("double")
    for name, s in (domain_scale or {}).items():
        scale = F.when(F.col("output_name") == name, F.lit(float(s))).otherwise(scale)
    return table.select("output_name", "rmse", F.col("included_in_macro").alias("included"), F.when(scale > 0, F.col("rmse") / scale).alias("scaled_rmse"))


def excluded_totals(table: DataFrame) -> DataFrame:
    """Count, mean and median error of the excluded outputs."""
    left = table.filter("NOT included")
    return left.agg(F.count(F.lit(1)).alias("n_excluded"), F.avg("rmse").alias("mean_rmse_excluded"), F.percentile("rmse", F.lit(0.5)).alias("median_rmse_excluded"))


def build_output_eligibility_ledger(Y_ref: DataFrame, *, keys: list[str], output_ids: list[str] | None = None, min_range: float = 1e-6) -> DataFrame:
    """output_id, ref_min, ref_max, ref_range, ref_variance, passes, exclusion_reason (empty if it passes)."""
    r = ranges(Y_ref, keys, output_ids)
    short, flat = ~F.coalesce(F.col("ref_range") >= min_range, F.lit(False)), ~F.coalesce(F.col("ref_variance") > 0, F.lit(False))
    reason = F.concat_ws(";", F.when(short, "range_below_threshold"), F.when(flat, "zero_variance"))
    return r.select(F.col("output_name").alias("output_id"), "ref_min", "ref_max", "ref_range", "ref_variance", (~short & ~flat).alias("passes"), reason.alias("exclusion_reason"))


def macro_nrmse_from_ledger(Y_true: DataFrame, Y_pred: DataFrame, ledger: DataFrame, *, keys: list[str]) -> DataFrame:
    """macro_nrmse and k_used over the ledger's passing outputs."""
    bad = ledger.filter("passes AND (ref_range IS NULL OR NOT ref_range > 0)")
    if not bad.isEmpty():
        raise ValueError("eligible outputs need positive finite ranges")
    used = ledger.filter("passes").select(F.col("output_id").alias("output_name"), F.col("ref_range").alias("r"))
    rmse = errors(Y_true, Y_pred, keys).groupBy("output_name").agg(F.sqrt(_mean_all(F.col("e2"))).alias("rmse"))
    return rmse.join(used, "output_name").agg(F.avg(F.col("rmse") / F.col("r")).alias("macro_nrmse"), F.count(F.lit(1)).alias("k_used"))


def make_null_mean_prediction(Y_train: DataFrame, rows: DataFrame, *, keys: list[str]) -> DataFrame:
    """The training means (missing values left out) for each key of rows."""
    outputs = others(Y_train, keys)
    means = Y_train.agg(*(F.avg(F.nanvl(c(n).cast("double"), F.lit(None).cast("double"))).alias(n) for n in outputs)).first()
    return rows.select(*map(c, keys), *(F.lit(m).cast("double").alias(n) for n, m in zip(outputs, means, strict=True)))


def table_digest(df: DataFrame) -> tuple[int, str]:
    """Row count and a digest that doesn't depend on row order."""
    n, a, b = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*map(c, df.columns))), F.sum(F.pmod(F.xxhash64(F.lit(1), *map(c, df.columns)), F.lit(1 << 40)))).first()
    return n, f"{(a or 0) & (1 << 64) - 1:016x}{b or 0:016x}"
