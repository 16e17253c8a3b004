"""The operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.functions import transforms
from lumenfit.functions.columns import c
from lumenfit.operators import baselines, bootstrap, features, linear, metrics, split, validate
from lumenfit.operators.moments import moments
from lumenfit.plans import workflow
from lumenfit.sources import artifacts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = ["o_orderkey"]
XS, YS = ["qty", "disc"], ["price", "net"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def model(spark: SparkSession, sf: str) -> DataFrame:
    """One row an order that has lines: strata, features qty and disc, outputs price and net."""
    price = F.col("l_extendedprice")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.sum(price).alias("price"), F.sum(price * (1 - F.col("l_discount"))).alias("net"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).drop("l_orderkey")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c(n), digits).alias(n) if t == "double" else c(n) for n, t in df.dtypes))


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return rounded(spark.createDataFrame(rows, schema))


def truth(m: DataFrame, *keep: str) -> DataFrame:
    return m.select("o_orderkey", *keep, "price", "net", F.lit(1.0).alias("flat"))


def guess(m: DataFrame, a: float = 1530.0, b: float = 1460.0) -> DataFrame:
    return m.select("o_orderkey", (F.col("qty") * a).alias("price"), (F.col("qty") * b).alias("net"), F.lit(1.5).alias("flat"))


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """The table kept in executors (on disk where memory is short) while a query with several jobs runs over it."""
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_partitions(model(spark, sf), strata_column="o_orderpriority", keys=KEY)


# ---- validation and alignment


@query
def repeated_keys(spark, sf):
    """Key values of lineitem that occur more than once (P1, P2)."""
    return validate.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def missing_keys(spark, sf):
    """Orders without lines, and lines without orders (J2)."""
    x = table(spark, sf, "orders").select("o_orderkey")
    y = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return validate.missing_keys(x, y, KEY)


@query
def align_xy(spark, sf):
    """Rows of orders and of per-order sums on shared keys (J1)."""
    m = model(spark, sf)
    x, y = validate.align_xy(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), m.select("o_orderkey", "price"), KEY)
    return rounded(x.join(y, KEY))


@query
def numeric_check(spark, sf):
    """Rows, and rows with a missing or non-finite value (P3)."""
    return validate.numeric_report(model(spark, sf), XS + YS)


@query
def combination_labels(spark, sf):
    m = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return split.combination_labels(m, columns=["o_orderpriority", "o_orderstatus"]).groupBy("combination").agg(F.count(F.lit(1)).alias("n"))


# ---- sampling


@query
def stratified_subset(spark, sf):
    return split.stratified_subset_by_combination(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), columns=["o_orderpriority", "o_orderstatus"], keys=KEY, n_per_combination=20, require_all_combinations=False)


@query
def sealed_split(spark, sf):
    return parts(spark, sf).select("o_orderkey", "o_orderpriority", "partition")


@query
def sealed_split_balance(spark, sf):
    return parts(spark, sf).groupBy(F.col("o_orderpriority").alias("stratum")).pivot("partition", ["train", "val", "test"]).count().na.fill(0)


@query
def holdout_split(spark, sf):
    m = model(spark, sf)
    x, y = m.select("o_orderkey", "o_orderstatus", *XS), m.select("o_orderkey", *YS)
    _, hold, _, _ = split.stratified_holdout_split(x, y, keys=KEY, stratify_columns=["o_orderstatus"])
    return hold.select("o_orderkey", "o_orderstatus")


@query
def fold_ids(spark, sf):
    return split.fold_ids(table(spark, sf, "orders").select("o_orderkey"), KEY, 5, 7)


# ---- features


@query
def feature_expansion(spark, sf):
    """Transforms and an interaction of part columns (F14 to F16)."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    spec = features.default_feature_expansion_spec(["size", "price"], interactions=[("size", "price")])
    return rounded(features.apply_feature_expansion(p, spec, keys=["p_partkey"], warn=False).expanded_frame.withColumnRenamed("size*price", "size_x_price"), 6)


@query
def transform_validity(spark, sf):
    """Share of finite results of each transform of c_acctbal, which has negative values (F5)."""
    d = table(spark, sf, "customer").select("c_acctbal")
    library = transforms.DEFAULT_TRANSFORM_LIBRARY
    row = tuple(round(t.valid_fraction(d, "c_acctbal"), 6) for t in library)
    return spark.createDataFrame([row], ", ".join(f"{t.label} double" for t in library))


@query
def custom_transform(spark, sf):
    t = transforms.TransformDef("(x - 1)**3 / (1 + abs(x))", "own")
    return rounded(table(spark, sf, "part").select("p_partkey", t.apply(F.col("p_size")).alias("own")), 6)


@query
def design_matrix(spark, sf):
    spec = features.DesignMatrixSpec([features.CategoricalInputDecl("o_orderstatus")], [("o_orderstatus", "o_totalprice")])
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    m = features.build_design_matrix(d, spec, keys=KEY).matrix
    return rounded(m.select(*(c(n).cast("int").alias(n) if t == "tinyint" else c(n) for n, t in m.dtypes)))


@query
def resolve_levels(spark, sf):
    spec = features.resolve_spec_levels(table(spark, sf, "orders"), features.DesignMatrixSpec([features.CategoricalInputDecl("o_orderpriority"), features.CategoricalInputDecl("o_orderstatus")]))
    return spark.createDataFrame([(d.name, i, v) for d in spec.categorical_inputs for i, v in enumerate(d.levels)], "name string, position int, level string")


def _names(spark, sf):
    """Names of all three kinds, from part types and brands."""
    p = table(spark, sf, "part").select("p_type", "p_brand").distinct()
    forms = F.array(F.col("p_type"), F.concat("p_type", F.lit("_sqrt")), F.concat("p_type", F.lit("_log1p")), F.concat("p_type", F.lit("_exp")), F.concat(F.lit("["), "p_type", F.lit(" * "), "p_brand", F.lit("]")))
    return p.select(F.explode(forms).alias("feature_name")).distinct()


@query
def name_structure(spark, sf):
    return features.name_structure(_names(spark, sf))


@query
def name_type_counts(spark, sf):
    return features.name_structure(_names(spark, sf)).groupBy("input_type").agg(F.count(F.lit(1)).alias("n"))


@query
def module_prefix(spark, sf):
    u = table(spark, sf, "pages").select("page_id", "url")
    return u.select("page_id", features.canonical_module_from_factor_name(F.col("url")).alias("module"))


# ---- fits


@query
def standardizers(spark, sf):
    m = model(spark, sf)
    x, y = m.select("o_orderkey", *XS), m.select("o_orderkey", *YS)
    b = linear.fit_standardizers(x, x, y, y, keys=KEY)
    means, scales = [*b.x_means, *b.y_means], [*b.x_scales, *b.y_scales]
    rows = [(n, i, float(a), float(s)) for i, (n, a, s) in enumerate(zip(XS + YS, means, scales, strict=True))]
    return rows_of(spark, rows, "name string, original_position int, mean double, scale double")


@query
def standardized_rows(spark, sf):
    m = model(spark, sf)
    b = linear.fit_standardizers(m.select("o_orderkey", *XS), m.select("o_orderkey", *XS), m.select("o_orderkey", *YS), m.select("o_orderkey", *YS), keys=KEY)
    return rounded(b.X_train_scaled.join(b.Y_train_scaled, KEY), 6)


def _fit(rows: DataFrame) -> linear.FinalOLSFitResult:
    return linear.result_of(moments(rows, XS, YS)[()], XS, YS)


@query
def final_ols(spark, sf):
    m = model(spark, sf)
    r = linear.fit_final_ols(m.select("o_orderkey", *XS), m.select("o_orderkey", *YS), keys=KEY)
    return rows_of(spark, [(o, *map(float, r.coef_raw_scale[j]), float(r.intercept_raw_scale[j])) for j, o in enumerate(YS)], "output_name string, qty double, disc double, intercept double")


@query
def final_ols_standardized(spark, sf):
    r = _fit(model(spark, sf))
    return rows_of(spark, [(o, *map(float, r.coef_standardized[j])) for j, o in enumerate(YS)], "output_name string, qty double, disc double")


@query
def predict_ols(spark, sf):
    m = model(spark, sf)
    return rounded(linear.predict_final_ols(_fit(m), m, keys=KEY, check=False), 2)


@query
def per_stratum_fit(spark, sf):
    """Predictions of price by quantity, fitted for each priority (L15)."""
    m = model(spark, sf)
    x, y = m.select("o_orderkey", "o_orderpriority", "qty"), m.select("o_orderkey", "price")
    return rounded(baselines.PerStratumFirstOrderBaseline("o_orderpriority").fit(x, y, keys=KEY).predict(x, keys=KEY), 2)


@query
def ridge_fit(spark, sf):
    m = model(spark, sf)
    b = baselines.RidgeBaseline(alpha=100.0).fit(m.select("o_orderkey", "qty"), m.select("o_orderkey", *YS), keys=KEY)
    return rows_of(spark, [(o, float(b.coef[j, 0]), float(b.intercept[j])) for j, o in enumerate(YS)], "output_name string, qty double, intercept double")


@query
def coef_importance(spark, sf):
    m = model(spark, sf)
    r = linear.compute_enriched_coef_magnitudes(m.select("o_orderkey", *XS), m.select("o_orderkey", *YS), keys=KEY)
    return rounded(spark.createDataFrame([(n, float(v)) for n, v in zip(r.feature_names, r.coef_magnitudes, strict=True)], "feature_name string, magnitude double"), 6)


@query
def support_thresholds(spark, sf):
    """Validation error by importance threshold (L11)."""
    with held(parts(spark, sf)) as p:
        sealed = split.SealedSplitResult(p.filter("partition = 'train'"), p.filter("partition = 'val'"), p, p.filter("partition = 'test'"))
        r = linear.select_support_via_refit(XS, YS, sealed, [0.0, 0.01, 0.1])
    return rows_of(spark, [(t["threshold"], t["n_selected"], t["val_score"]) for t in r.sensitivity_table], "threshold double, n_selected int, val_score double")


@query
def screening(spark, sf):
    noise = F.pmod(F.xxhash64("o_orderkey"), F.lit(1000)) / 1000
    with held(model(spark, sf).withColumn("noise", noise)) as m:
        x, y = m.select("o_orderkey", *XS, "noise"), m.select("o_orderkey", *YS)
        r = linear.fit_multitask_elastic_net_screen(x, y, keys=KEY, selection_tol=1e-6)
    rows = [tuple(t.values()) for t in linear.screening_selection_table(r)]
    return rounded(spark.createDataFrame(rows, "feature_name string, original_position int, selected boolean, nonzero_output_count int, max_abs_coef double"))


@query
def pls_fit(spark, sf):
    m = model(spark, sf)
    b = baselines.PLSBaseline(1).fit(m.select("o_orderkey", *XS), m.select("o_orderkey", *YS), keys=KEY)
    return rows_of(spark, [(o, *map(float, b.coef[j]), float(b.intercept[j])) for j, o in enumerate(YS)], "output_name string, qty double, disc double, intercept double")


@query
def baseline_comparison(spark, sf):
    models = [baselines.RidgeBaseline(), baselines.PLSBaseline(2), baselines.ElasticNetBaseline(), baselines.OracleOLSBaseline(["qty"]), baselines.GBTBaseline()]
    with held(model(spark, sf)) as m, held(split.split_partitions(m, strata_column="o_orderpriority", keys=KEY)) as p:
        x = lambda k: p.filter(F.col("partition") == k).select("o_orderkey", *XS)
        y = lambda k: p.filter(F.col("partition") == k).select("o_orderkey", *YS)
        out = baselines.compare_baselines(models, x("train"), y("train"), x("test"), y("test"), keys=KEY)
    return rounded(out.select("name", "rmse", "r2"))


# ---- metrics


@query
def null_mean_prediction(spark, sf):
    p = parts(spark, sf)
    train, test = p.filter("partition = 'train'").select("o_orderkey", *YS), p.filter("partition = 'test'")
    return rounded(metrics.make_null_mean_prediction(train, test, keys=KEY))


@query
def per_output_nrmse(spark, sf):
    m = model(spark, sf)
    return rounded(metrics.per_output_nrmse_frame(truth(m), guess(m), truth(m), keys=KEY), 5)


@query
def macro_nrmse(spark, sf):
    m = model(spark, sf)
    return rounded(metrics.macro_nrmse_with_ref(truth(m), guess(m), truth(m), keys=KEY), 6)


@query
def eligibility_ledger(spark, sf):
    return rounded(metrics.build_output_eligibility_ledger(truth(model(spark, sf)), keys=KEY), 2)


@query
def macro_from_ledger(spark, sf):
    m = model(spark, sf)
    ledger = metrics.build_output_eligibility_ledger(truth(m), keys=KEY)
    return rounded(metrics.macro_nrmse_from_ledger(truth(m), guess(m), ledger, keys=KEY), 6)


@query
def stratified_nrmse(spark, sf):
    m = model(spark, sf)
    out = metrics.stratified_nrmse_summary(truth(m, "o_orderpriority", "o_orderstatus"), guess(m), truth(m), keys=KEY, strata=["o_orderpriority", "o_orderstatus"])
    return rounded(out.drop("rmse_macro"), 6)


@query
def excluded_outputs(spark, sf):
    m = model(spark, sf)
    return rounded(metrics.excluded_output_error_summary(truth(m), guess(m), truth(m), keys=KEY, domain_scale={"flat": 2.0, "net": -1.0}), 4)


@query
def excluded_output_totals(spark, sf):
    m = model(spark, sf)
    return rounded(metrics.excluded_totals(metrics.excluded_output_error_summary(truth(m), guess(m), truth(m), keys=KEY)), 6)


@query
def holdout_nrmse(spark, sf):
    """OLS on the training part, error on the test part by output, with the training range."""
    p = parts(spark, sf)
    train, test = p.filter("partition = 'train'"), p.filter("partition = 'test'")
    pred = linear.predict_final_ols(_fit(train), test, keys=KEY, check=False)
    return rounded(metrics.per_output_nrmse_frame(test.select("o_orderkey", *YS), pred, train.select("o_orderkey", *YS), keys=KEY), 5)


# replicates: as many as the operators make by default, each of as many rows as the table has
BOOT = 1000
INTERVAL = ["ci_lower", "ci_upper", "bootstrap_mean", "bootstrap_std"]


def told(spark: SparkSession, found: dict, names: list[str]) -> DataFrame:
    return rounded(spark.createDataFrame([tuple(float(found[n]) for n in names)], ", ".join(f"{n} double" for n in names)), 8)


@query
def bootstrap_replicates(spark, sf):
    with held(model(spark, sf)) as m:
        t = truth(m)
        err = metrics.errors(t, guess(m), KEY)
        included = metrics.per_output(err, metrics.ranges(t, KEY)).filter("included_in_macro")
        values = bootstrap.replicate_values(err, included, bootstrap.indexed(m.select("o_orderkey"), KEY), range(BOOT), 123, KEY)
    return rounded(values.select("rep", F.col("e2").alias("macro_nrmse")), 8)


@query
def bootstrap_ci(spark, sf):
    with held(model(spark, sf)) as m:
        return told(spark, bootstrap.bootstrap_macro_nrmse_ci(truth(m), guess(m), truth(m), keys=KEY), ["point_estimate", *INTERVAL])


@query
def stratified_bootstrap(spark, sf):
    strata = ["o_orderpriority"]
    with held(model(spark, sf)) as m:
        found = bootstrap.stratified_bootstrap_macro_nrmse_ci(truth(m, *strata), guess(m), truth(m), keys=KEY, strata=strata, round_digits=None)
    return told(spark, found, ["point_estimate", *INTERVAL])


@query
def paired_bootstrap(spark, sf):
    with held(model(spark, sf)) as m:
        found = bootstrap.bootstrap_paired_difference_ci(truth(m), guess(m), guess(m, 1500.0, 1500.0), truth(m), keys=KEY, round_digits=None)
    return told(spark, found, ["point_estimate", *INTERVAL])


# ---- artifacts and runs


@query
def artifact_table(spark, sf):
    return artifacts.postfit_artifact_table(spark).select("artifact_name", "artifact_position", "category")


@query
def coefficient_frame(spark, sf):
    r = _fit(model(spark, sf))
    return rounded(artifacts.make_coefficient_matrix_frame(spark, r.coef_raw_scale, YS, XS))


@query
def standardization_frame(spark, sf):
    r = _fit(model(spark, sf))
    return rounded(artifacts.make_standardization_frame(spark, YS, r.y_means, r.y_scales, name_column="output_name"))


@query
def canonical_workflow(spark, sf):
    with held(model(spark, sf)) as m, held(split.split_partitions(m, strata_column="o_orderpriority", keys=KEY)) as p:
        x = lambda k: p.filter(F.col("partition") == k).select("o_orderkey", *XS)
        y = lambda k: p.filter(F.col("partition") == k).select("o_orderkey", *YS)
        run = workflow.run_canonical_workflow(x("train"), y("train"), x("test"), y("test"), keys=KEY, dataset_tag="orders")
    return rounded(run.artifacts["nrmse_summary"].select("point_estimate", "ci_lower", "ci_upper", "k_used", "holdout_rows", "n_features"), 6)
