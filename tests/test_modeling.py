"""Fits, selection and splits on planted data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfit.operators import baselines, bootstrap, features, linear, metrics, moments, solvers, split, validate
from lumenfit.plans import workflow
from lumenfit.sources import bundle

K = ["id"]


def frame(spark, X, names, first=0):
    return spark.createDataFrame([(i + first, *map(float, r)) for i, r in enumerate(X)], "id long, " + ", ".join(f"`{n}` double" for n in names))


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 5))
    Y = np.c_[3 * X[:, 0] - 2 * X[:, 2], -1.5 * X[:, 0] + X[:, 2]] + rng.normal(scale=0.05, size=(200, 2))
    names, outs = ["x1", "x2", "x3", "x4", "a*b.c"], ["y1", "y2"]
    return X, Y, frame(spark, X, names).cache(), frame(spark, Y, outs).cache(), names, outs


def test_exact_coefficients(spark):
    X = np.array([[1, 2], [2, 1], [3, 5], [4, 4], [5, 0.0]])
    Y = np.c_[1.5 + 2 * X[:, 0] - X[:, 1], -0.5 + 0.25 * X[:, 0] + 3 * X[:, 1]]
    r = linear.fit_final_ols(frame(spark, X, ["x1", "x2"]), frame(spark, Y, ["y1", "y2"]), keys=K)
    assert np.allclose(r.coef_raw_scale, [[2, -1], [0.25, 3]]) and np.allclose(r.intercept_raw_scale, [1.5, -0.5])
    b = linear.fit_final_ols(frame(spark, X, ["x1", "x2"]), frame(spark, Y, ["y1", "y2"]), keys=K, output_batch_size=1)
    assert np.allclose(b.coef_raw_scale, r.coef_raw_scale)


def test_moments_agree(planted):
    X, Y, dx, dy, names, outs = planted
    rows = validate.joined(dx, dy, K).withColumn("g", F.pmod("id", F.lit(3)))
    native, dense = moments._native(rows, names, outs, ["g"]), moments._dense(rows, names, outs, ["g"])
    assert native.keys() == dense.keys() == {(0,), (1,), (2,)}
    total = moments.Moments.of(X, Y)
    merged = moments.Moments.empty(5, 2)
    for k in native:
        for a in ("x", "y", "sxx", "sxy", "syy", "low", "high"):
            assert np.allclose(getattr(native[k], a), getattr(dense[k], a))
        merged = merged + native[k]
    assert np.allclose(merged.sxx, total.sxx) and np.allclose((total - native[(0,)]).sxy, (native[(1,)] + native[(2,)]).sxy)
    B, b = solvers.ols(total)
    assert np.allclose(B, np.linalg.lstsq(np.c_[X, np.ones(200)], Y, rcond=None)[0][:5].T)
    assert np.allclose(total.sse(B, b), ((Y - X @ B.T - b) ** 2).sum(0))


def test_offset_columns(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(100, 3)) + 1e7
    Y = X @ [[1.0], [2.0], [3.0]]
    r = linear.fit_final_ols(frame(spark, X, ["a", "b", "c"]), frame(spark, Y, ["y"]), keys=K)
    assert np.allclose(r.coef_raw_scale, [[1, 2, 3]], atol=1e-4)


def test_screening_finds_support(planted):
    _, _, dx, dy, names, _ = planted
    r = linear.fit_multitask_elastic_net_screen(dx, dy, keys=K, alphas=30, selection_tol=1e-6, l1_ratio=(0.9, 1.0))
    table = linear.screening_selection_table(r)
    assert {"x1", "x3"} <= set(r.selected_features) and [t["original_position"] for t in table] == list(range(5))


def test_elastic_net_kkt():
    rng = np.random.default_rng(1)
    X, Y = rng.normal(size=(200, 8)), rng.normal(size=(200, 3))
    m = moments.Moments.of(X, Y)
    alpha, ratio = 0.05, 0.7
    W = solvers.elastic_net(m.sxx, m.sxy, m.n, alpha, ratio, 10000, 1e-12)
    g = (m.sxy - m.sxx @ W) / m.n - alpha * (1 - ratio) * W
    size = np.linalg.norm(W, axis=1)
    for f in range(8):
        if size[f]:
            assert np.allclose(g[f], alpha * ratio * W[f] / size[f], atol=1e-8)
        else:
            assert np.linalg.norm(g[f]) <= alpha * ratio + 1e-9
    top = solvers.alpha_grid(m.sxy, m.n, ratio, 3)[0]
    assert not solvers.elastic_net(m.sxx, m.sxy, m.n, top * 1.001, ratio).any()


def test_support_selection_and_seal(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 8))
    y = X[:, :3] @ [2, 2, 2] + rng.normal(scale=0.5, size=300)
    names = [f"x{i}" for i in range(8)]
    df = frame(spark, np.c_[X, y], [*names, "y"]).withColumn("stratum", F.element_at(F.array(*map(F.lit, "ABCD")), (F.pmod("id", F.lit(4)) + 1).cast("int")))
    s = split.make_sealed_split(df, strata_column="stratum", keys=K)
    assert [s.train.count(), s.val.count()] == [210, 45]
    with pytest.raises(split.SealedTestAccessError):
        _ = s.test
    r = linear.select_support_via_refit(names, ["y"], s, [0.0, 0.1, 0.3, 99.0])
    assert r.selected_features == names[:3] or set(names[:3]) <= set(r.selected_features)
    assert r.sensitivity_table[-1]["val_score"] == float("inf")
    assert s.unseal(reason="final").count() == 45 and len(s.unseal_log) == 1
    with pytest.raises(split.SealedTestAccessError):
        linear.select_support_via_refit(names, ["y"], s, [0.0])


def test_categorical_fit(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v), "AB"[i % 2]) for i, v in enumerate(rng.normal(size=60))]
    X = spark.createDataFrame(rows, "id long, score double, `group` string")
    Y = X.select("id", (2 * F.col("score") + 5 * (F.col("group") == "B").cast("int")).alias("outcome"))
    spec = features.DesignMatrixSpec([features.CategoricalInputDecl("group")])
    r = linear.fit_final_ols_with_design(X, Y, spec, keys=K)
    assert r.feature_names == ["score", "group__B"] and np.allclose(r.coef_raw_scale, [[2, 5]])
    with pytest.raises(ValueError, match="unknown"):
        linear.predict_from_raw_records(r, spark.createDataFrame([(1, 0.0, "C")], "id long, score double, `group` string"), keys=K)
    assert linear.predict_from_raw_records(r, X, keys=K).count() == 60


def test_validation(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0)], "id long, x double")
    b = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "id long, y double")
    with pytest.raises(ValueError, match="repeated"):
        validate.require_matching_xy(a, b, K)
    with pytest.raises(ValueError, match="non-finite"):
        validate.numeric(b, ["y"])
    with pytest.raises(ValueError, match="empty"):
        validate.numeric(b.limit(0), ["y"])
    with pytest.raises(ValueError, match="share no rows"):
        validate.align_xy(a, spark.createDataFrame([(9, 1.0)], "id long, y double"), K)
    with pytest.raises(KeyError):
        validate.ensure_id_columns(a, ["nope"])
    with pytest.raises(ValueError, match="non-finite"):
        validate.numeric(spark.createDataFrame([(1, "ten")], "id long, x string"), ["x"])


def test_metric_values(spark):
    yt, yp = frame(spark, [[0], [1], [2], [3]], ["y"]), frame(spark, [[0.5], [1.5], [2.5], [3.5]], ["y"])
    ref = frame(spark, [[0], [5]], ["y"])
    r = metrics.macro_nrmse_with_ref(yt, yp, ref, keys=K).first()
    assert r.macro_nrmse == pytest.approx(0.1) and (r.k_used, r.k_total) == (1, 1)
    none = metrics.macro_nrmse_with_ref(yt, yp, ref, keys=K, min_range=99).first()
    assert none.macro_nrmse is None and none.k_used == 0


def test_rows_must_match(spark):
    """Predictions for some of the rows are an error, not a score of those rows."""
    yt, yp = frame(spark, [[float(i)] for i in range(10)], ["y"]), frame(spark, [[float(i)] for i in range(3)], ["y"])
    for got in (metrics.macro_nrmse_with_ref(yt, yp, yt, keys=K), metrics.macro_nrmse_with_ref(yp, yt, yt, keys=K), metrics.per_output_nrmse_frame(yt, yp, yt, keys=K)):
        with pytest.raises(Exception, match="same rows"):
            got.collect()
    with pytest.raises(Exception, match="at least one"):
        metrics.macro_nrmse_with_ref(yt.limit(0), yp.limit(0), yt, keys=K).collect()
    x = yt.withColumnRenamed("y", "x")
    for model in (baselines.RidgeBaseline(), baselines.PerStratumFirstOrderBaseline("x")):
        with pytest.raises(Exception, match="same keys"):
            model.fit(x.withColumn("z", F.col("x")), yp, keys=K)


def test_missing_values_are_errors(spark):
    rows = frame(spark, [[float(i), 2.0 * i] for i in range(20)], ["x", "y"])
    holes = rows.withColumn("x", F.when(F.col("id") % 5 != 0, F.col("x")))
    odd = rows.withColumn("y", F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("y")))
    for route in (moments._native, moments._dense):
        for bad in (holes, odd):
            with pytest.raises(ValueError, match="missing or non-finite"):
                route(bad, ["x"], ["y"], [])
    with pytest.raises(ValueError, match="missing"):
        baselines.RidgeBaseline().fit(holes.select("id", "x"), rows.select("id", "y"), keys=K)


def test_comparison_harness(planted):
    X, Y, dx, dy, names, outs = planted
    strata = dx.select("id", (F.col("id") % 2).cast("string").alias("s"))
    train, rest = (lambda d: d.filter("id < 150")), (lambda d: d.filter("id >= 150"))
    extra = {"per_stratum": {"strata": strata.filter("id < 150")}}, {"per_stratum": {"strata": strata.filter("id >= 150")}}
    models = [baselines.RidgeBaseline(1e-6), baselines.PerStratumFirstOrderBaseline("s"), baselines.GBTBaseline(3)]
    table = baselines.compare_baselines(models, train(dx), train(dy), rest(dx), rest(dy), keys=K, fit_kwargs=extra[0], predict_kwargs=extra[1])
    assert table.columns == ["name", "rmse", "r2", "model_size_bytes", "fit_time_s", "eval_time_s", "peak_memory_mb"]
    got = {r.name: r for r in table.collect()}
    one = np.c_[X[:150], np.ones(150)]
    B = np.linalg.lstsq(one, Y[:150], rcond=None)[0]
    err = Y[150:] - np.c_[X[150:], np.ones(50)] @ B
    assert got["ridge"].rmse == pytest.approx(np.sqrt((err**2).mean()), rel=1e-4) and got["per_stratum"].r2 > 0.99
    assert got["gbt"].model_size_bytes > 0 and got["gbt"].r2 < got["ridge"].r2
    with pytest.raises(ValueError, match="match exactly"):
        baselines.compare_baselines(models[:1], train(dx), train(dy), rest(dx).drop("x1"), rest(dy), keys=K)


def test_rotated_outputs_give_the_same_fit():
    rng = np.random.default_rng(4)
    X, Y = rng.normal(size=(120, 4)), rng.normal(size=(120, 30))
    Y[:, :5] += X @ rng.normal(size=(4, 5))
    train, val = moments.Moments.of(X[:90], Y[:90]), moments.Moments.of(X[90:], Y[90:])
    Q, R = solvers.rotation(train.sxy)
    assert Q.shape == (30, 4) and np.allclose(R @ Q.T, train.sxy)
    grid = solvers.alpha_grid(train.sxy, train.n, 0.7, 6)
    want, W = [], None
    for a in grid:
        W = solvers.elastic_net(train.sxx, train.sxy, train.n, a, 0.7, 10_000, 1e-10, W)
        want.append(val.sse(W.T, train.y - W.T @ train.x).sum())
    dy = val.y - train.y
    arrays = (train.sxx, R, val.sxx, val.sxy @ Q, val.x - train.x, dy @ Q, np.array([train.n, val.n, val.syy.sum() + val.n * (dy @ dy)], float))
    got = linear.path_errors(np.concatenate([np.ravel(a) for a in arrays]), 4, 4, grid, 0.7, 10_000, 1e-10)
    assert np.allclose(got, want, rtol=1e-6)


def test_bootstrap_after_a_broken_run(spark, tmp_path):
    y = np.random.default_rng(0).normal(size=(20, 1))
    yt, yp = frame(spark, y, ["a"]), frame(spark, y + 0.1, ["a"])
    args = dict(keys=K, n_boot=4, checkpoint_dir=str(tmp_path))
    first = bootstrap.bootstrap_macro_nrmse_ci(yt, yp, yt, **args)
    folder = next(tmp_path.iterdir())
    files = sorted(folder.glob("*.parquet"))
    files[0].write_bytes(b"no parquet")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    again = bootstrap.bootstrap_macro_nrmse_ci(yt, yp, yt, **args)
    for f in folder.glob("*"):
        f.unlink()
    empty = bootstrap.bootstrap_macro_nrmse_ci(yt, yp, yt, **args)  # the folder is there, without any data
    assert first["n_valid_boot"] == again["n_valid_boot"] == empty["n_valid_boot"] == 4 and first["ci_lower"] == pytest.approx(again["ci_lower"])


def test_bootstrap_routes_agree(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=(50, 2))
    yt, yp = frame(spark, y, ["a", "b"]), frame(spark, y + rng.normal(size=(50, 2)), ["a", "b"])
    err, rows = metrics.errors(yt, yp, K), bootstrap.indexed(yt.select("id"), K)
    included = metrics.per_output(err, metrics.ranges(yt, K)).filter("included_in_macro")
    bootstrap.DRAWS, was = 7, bootstrap.DRAWS
    one, two = ({r.rep: r.e2 for r in bootstrap.replicate_values(err, included, rows, [0, 1, 5], 9, K, most_broadcast=m).collect()} for m in (10**6, 0))
    bootstrap.DRAWS = was
    assert one.keys() == {0, 1, 5} and all(one[k] == pytest.approx(two[k]) for k in one)


def test_bootstrap_resumes(spark, tmp_path):
    rng = np.random.default_rng(0)
    y = rng.normal(size=(30, 2))
    yt, yp = frame(spark, y, ["a", "b"]), frame(spark, y + 0.1, ["a", "b"])
    args = dict(keys=K, n_boot=8, random_state=1)
    plain = bootstrap.bootstrap_macro_nrmse_ci(yt, yp, yt, **args)
    part = bootstrap.bootstrap_macro_nrmse_ci(yt, yp, yt, checkpoint_dir=str(tmp_path), active_bootstrap_indices={0, 1, 2}, **args)
    full = bootstrap.bootstrap_macro_nrmse_ci(yt, yp, yt, checkpoint_dir=str(tmp_path), **args)
    assert part["n_valid_boot"] == 3 and full["n_valid_boot"] == 8
    assert full["ci_lower"] == pytest.approx(plain["ci_lower"]) and full["k_used"] == 2
    with pytest.raises(ValueError):
        bootstrap.bootstrap_macro_nrmse_ci(yt, yp, yt, sample_size=0, **args)


def test_stratified_and_paired_bootstrap(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=(40, 1))
    yt = frame(spark, y, ["a"])
    st = yt.withColumn("s", F.when(F.col("id") < 30, "A").otherwise("B"))
    good, bad = frame(spark, y + 0.01, ["a"]), frame(spark, y + rng.normal(size=(40, 1)), ["a"])
    r = bootstrap.stratified_bootstrap_macro_nrmse_ci(st, bad, yt, keys=K, strata=["s"], n_boot=20, n_stability_batches=4)
    assert r["strata_counts"] == [30, 10] and r["ci_lower"] <= r["ci_upper"] and r["mc_stability"]["n_batches"] == 4
    d = bootstrap.bootstrap_paired_difference_ci(yt, good, bad, yt, keys=K, n_boot=20)
    assert d["ci_upper"] < 0
    rows = bootstrap.indexed(st.select("id", "s"), K, ["s"])
    w = bootstrap.multiplicities(rows, range(3), 5)
    assert sorted(tuple(x) for x in w.groupBy("rep", "_first").agg(F.sum("w")).collect()) == sorted((i, f, n) for i in range(3) for f, n in ((0, 30), (30, 10)))


def test_baselines(planted):
    X, Y, dx, dy, names, outs = planted
    strat = dx.withColumn("s", (F.col("id") % 2).cast("string"))
    for b in (baselines.RidgeBaseline(1e-6), baselines.PLSBaseline(5), baselines.OracleOLSBaseline(["x1", "x3"]), baselines.ElasticNetBaseline(1e-4)):
        p = b.fit(dx, dy, keys=K).predict(dx, keys=K)
        got = np.array([r[1:] for r in sorted(p.collect())])
        assert isinstance(b, baselines.BaselineProtocol) and np.abs(got - Y).mean() < 0.1, b.name
    p = baselines.PerStratumFirstOrderBaseline("s").fit(strat, dy, keys=K).predict(strat.withColumn("s", F.lit("new")), keys=K)
    assert np.abs(np.array([r[1:] for r in sorted(p.collect())]) - Y).mean() < 0.1


def test_workflow_and_bundle(spark, tmp_path):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(40, 3))
    Y = np.c_[1 + 2 * X[:, 0] - X[:, 1], -0.5 + 0.75 * X[:, 0] + 0.5 * X[:, 1]]
    xs, ys = ["x1", "x2", "x*3"], ["001", "y2"]
    f = lambda a, n, lo, hi: frame(spark, a[lo:hi], n, lo)
    run = workflow.run_canonical_workflow(f(X, xs, 0, 32), f(Y, ys, 0, 32), f(X, xs, 32, 40), f(Y, ys, 32, 40), keys=K, dataset_tag="t", alphas=15, n_boot=10)
    assert {"x1", "x2"} <= set(run.screening.selected_features) and run.holdout_summary["point_estimate"] < 1e-6
    for kind in ("parquet", "csv"):
        root = str(tmp_path / kind)
        built = run.artifacts | {"manifest": run.artifacts["manifest"] | {"files": {k: v.replace("parquet", kind) for k, v in run.artifacts["manifest"]["files"].items()}}}
        bundle.write_postfit_bundle(built, root)
        assert len(bundle.load_postfit_bundle(spark, root)) == 8
        got = bundle.predict_from_postfit_bundle(root, f(X, xs, 32, 40), keys=K)
        assert np.allclose(np.array([r[1:] for r in sorted(got.collect())]), Y[32:40], atol=1e-6)
    for bad in ("/abs.parquet", "../up.parquet", "a.txt"):
        with pytest.raises(ValueError):
            bundle.artifact_path("/r", bad)
    broken = {**run.artifacts, "manifest": run.artifacts["manifest"] | {"n_outputs": 5}}
    with pytest.raises(ValueError, match="n_outputs"):
        bundle.write_postfit_bundle(broken, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_canonical_query_draws_all_rows(spark):
    """1000 replicates of all holdout rows, by hand."""
    import hashlib
    import os

    from lumenfit.plans import queries as q

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    rows = q.parts(spark, data).select("o_orderkey", *q.XS, *q.YS, "partition").collect()
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    of = lambda k: np.array([[float(x) for x in r[1:5]] for r in sorted((r for r in rows if r.partition == k), key=lambda r: (md5(f"0|{r.o_orderkey}"), r.o_orderkey))])
    train, test = of("train"), of("test")
    n = len(test)
    one = lambda a: np.c_[np.ones(len(a)), a[:, :2]]
    e2 = (test[:, 2:] - one(test) @ np.linalg.lstsq(one(train), train[:, 2:], rcond=None)[0]) ** 2
    span = np.ptp(train[:, 2:], axis=0)
    draws = np.array([[int(md5(f"123|{rep}|{draw}")[:8], 16) % n for draw in range(n)] for rep in range(1000)])
    values = (np.sqrt(e2[draws].mean(axis=1)) / span).mean(axis=1)
    got = q.canonical_workflow(spark, data).first()
    assert got.holdout_rows == n and got.n_features == 2
    assert [got.ci_lower, got.ci_upper] == pytest.approx(np.percentile(values, [2.5, 97.5]).tolist(), abs=2e-6)


def test_streams(spark, tmp_path):
    """Scores and windowed errors of a file stream are those of a batch; late records are left out."""
    import datetime

    from lumenfit import streaming

    X = np.array([[1, 2], [2, 1], [3, 5], [4, 4], [5, 0.0]])
    Y = 1.5 + 2 * X[:, :1] - X[:, 1:]
    fit = linear.fit_final_ols(frame(spark, X, ["x1", "x2"]), frame(spark, Y, ["y"]), keys=K)
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(at(0), 1.0, 2.0, 1.5), (at(4), 2.0, 1.0, 5.5), (at(12), 3.0, 5.0, 2.5), (at(50), 0.0, 0.0, 1.5)]
    late = [(at(1), 9.0, 9.0, 0.0), (at(55), 0.0, 0.0, 2.5), (at(59), 1.0, None, 2.5)]
    schema, source = "ts timestamp, x1 double, x2 double, y double", str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    out = streaming.windowed_rmse(fit, stream, time="ts", window="10 minutes", late="5 minutes")
    run = out.writeStream.format("memory").queryName("rmse").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    spark.createDataFrame(late, schema).write.mode("append").parquet(source)
    run.processAllAvailable()
    run.stop()
    got: dict = {}
    for r in spark.table("rmse").collect():
        got[r.window.start.minute] = max(got.get(r.window.start.minute, (0, 0.0)), (r.n, round(r.rmse_y, 6)))
    # minute 0: errors 0 and 0 + 1; the late record would make it 3 rows
    assert got[0] == (2, round(float(np.sqrt(((5.5 - 4.5) ** 2) / 2)), 6)) and got[10][0] == 1 and got[50][0] == 3
    batch = streaming.score_stream(fit, spark.createDataFrame(rows, schema), keep=["ts"]).orderBy("ts").collect()
    assert [r.pred_y for r in batch] == pytest.approx([1.5, 4.5, 2.5, 1.5])
    with pytest.raises(ValueError, match="missing"):
        streaming.score_stream(fit, spark.createDataFrame(rows, schema).drop("x1"), keep=["ts"])


@pytest.mark.parametrize("first, last", [(0, 120), (995, 1003), (9_990, 20_011), (1_234_567, 1_234_600)])
def test_bootstrap_digests(first, last):
    import hashlib

    for seed, rep in ((123, 7), (-5, 999), (10**60, 0)):
        got = np.concatenate(list(bootstrap.heads(seed, rep, first, last)))
        assert got.tolist() == [int(hashlib.md5(f"{seed}|{rep}|{k}".encode()).hexdigest()[:8], 16) for k in range(first, last)]


def test_bootstrap_counts_by_strata(spark):
    """The counts of a replicate are those of the draws that Spark makes, also where a byte is too small."""
    rows = bootstrap.indexed(spark.range(40).select("id", (F.col("id") < 30).alias("s")), K, ["s"])
    for sample in (None, 3):
        want = {(r.rep, r._first + r._row): r.w for r in bootstrap.multiplicities(rows, range(3), 5, sample).collect()}
        for rep in range(3):
            assert bootstrap.drawn_counts(5, rep, [(0, 10), (10, 30)], sample).tolist() == [want.get((rep, k), 0) for k in range(40)]
    many = bootstrap.drawn_counts(5, 0, [(0, 2)], 1000)
    assert many.sum() == 1000 and many.min() > 255


def test_bootstrap_missing_errors_by_either_route(spark):
    """A missing error counts as a draw without a square, and an output whose drawn errors are all missing is left out."""
    err = spark.createDataFrame([(i, n, None if n == "b" or i == 3 else float(i)) for i in range(20) for n in "ab"], "id long, output_name string, e2 double")
    included = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "output_name string, ref_range double")
    rows = bootstrap.indexed(spark.range(20), K)
    one, two = ({r.rep: r.e2 for r in bootstrap.replicate_values(err, included, rows, [0, 4], 9, K, most_broadcast=m).collect()} for m in (10**6, 0))
    assert one.keys() == {0, 4} and all(one[k] == pytest.approx(two[k]) for k in one)


def exchanges(df):
    """What joins and aggregations deal anew."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "ENSURE_REQUIREMENTS" in line]


def test_paired_errors_of_tables_that_lie_together(spark):
    """Both errors of a cell as by two tables of errors; rows that lie by key aren't dealt again, neither by key nor by output."""
    rng = np.random.default_rng(0)
    y = rng.normal(size=(40, 3))
    y[3, 1] = np.nan
    m = frame(spark, np.c_[y, y + 0.1, y * 2], [n + k for k in ("", "1", "2") for n in "abc"]).repartition(4, "id").persist()
    m.count()
    t, p, q = (m.select("id", *(F.col(n + k).alias(n) for n in "abc")) for k in ("", "1", "2"))
    got = metrics.errors_of_two(t, p, q, K)
    want = {(r.id, r.output_name): [r.e2] for r in metrics.errors(t, p, K).collect()}
    for r in metrics.errors(t, q, K).collect():
        want[r.id, r.output_name].append(r.e2)
    assert {(r.id, r.output_name): [r.e2, r.b2] for r in got.collect()} == want and want[3, "b"] == [None, None]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not exchanges(metrics.errors_of_two(t, p, q, K))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    with pytest.raises(Exception, match="same rows"):
        bootstrap.bootstrap_paired_difference_ci(t, p, q.filter("id > 0"), t, keys=K, n_boot=3)
    m.unpersist()


def test_places_deal_rows_without_digests(spark):
    """What is dealt to the blocks is the rows' own columns and the block's numbers: a digest would be most of it."""
    strata = spark.range(30).withColumn("s", F.col("id") % 2)
    for by in ([], ["s"]):
        placed = split.places(strata, by, K, 7)
        plan = placed._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("RepartitionByExpression") :]
        assert "_order" not in below and "_order" in plan
        order = {r.id: r.d for r in strata.select("id", split.order_hash(7, K).alias("d")).collect()}
        for part in {tuple(r[b] for b in by) for r in strata.collect()}:
            rows = [r for r in placed.collect() if tuple(r[b] for b in by) == part]
            assert [r.id for r in sorted(rows, key=lambda r: r._place)] == sorted((r.id for r in rows), key=order.get)
            assert sorted(r._place for r in rows) == list(range(1, len(rows) + 1)) and {r._size for r in rows} == {len(rows)}


def test_bootstrap_counts_travel_packed():
    few = np.random.default_rng(0).poisson(1, 1 << 16).astype(np.uint8)
    for counts in (few, few[:7], np.array([16, 1, 3], np.uint8), np.array([300, 2], np.uint16), np.array([1 << 20], np.uint32)):
        got = bootstrap.unpacked(*bootstrap.packed(counts))
        assert got[: len(counts)].tolist() == counts.tolist() and not got[len(counts) :].any()
    assert len(bootstrap.packed(few)[1]) < 0.245 * len(few)  # a draw a row: 0.235 bytes at best
