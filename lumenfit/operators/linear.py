"""Final OLS, screening, support selection and prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.functions.columns import c, check_names, others
from lumenfit.operators import features as feats
from lumenfit.operators import solvers, split, validate
from lumenfit.operators.moments import Moments, moments

#: Up to so many coefficients a prediction is generated as columns; beyond, numpy multiplies batches.
GENERATED = 4000


def linear_columns(features: list[str], B: np.ndarray, b: np.ndarray) -> list[Column]:
    """One column for each row of B."""
    out = []
    for row, const in zip(B, b, strict=True):
        total = F.lit(float(const))
        for n, w in zip(features, row, strict=True):
            total = total + F.lit(float(w)) * c(n).cast("double")
        out.append(total)
    return out


def project(df: DataFrame, keys: list[str], features: list[str], names: list[str], B: np.ndarray, b: np.ndarray) -> DataFrame:
    """keys and a linear function of the features for each name."""
    if B.size <= GENERATED:
        return df.select(*map(c, keys), *(v.alias(n) for v, n in zip(linear_columns(features, B, b), names, strict=True)))
    p = len(features)
    flat = df.select(*map(c, keys), F.array(*(c(n).cast("double") for n in features)).alias("_v"))
    schema = df.select(*map(c, keys), *(F.lit(0.0).alias(n) for n in names)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                Y = part.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) @ B.T + b
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *(pa.array(col) for col in Y.T)], [*keys, *names])

    return flat.mapInArrow(run, schema)


# ---- standardisation


@dataclass(frozen=True)
class StandardizationBundle:
    x_names: list[str]
    y_names: list[str]
    x_means: np.ndarray
    x_scales: np.ndarray
    y_means: np.ndarray
    y_scales: np.ndarray
    X_train_scaled: DataFrame
    X_holdout_scaled: DataFrame
    Y_train_scaled: DataFrame
    Y_holdout_scaled: DataFrame


def fit_standardizers(X_train: DataFrame, X_holdout: DataFrame, Y_train: DataFrame, Y_holdout: DataFrame, *, keys: list[str]) -> StandardizationBundle:
    """Means and population deviations of the training rows (1 for constants), applied to all four tables."""
    xs, ys = others(X_train, keys), others(Y_train, keys)
    validate.require_same_columns(X_train, X_holdout)
    validate.require_same_columns(Y_train, Y_holdout)
    none: list[str] = []
    mx, my = moments(X_train, none, xs)[()], moments(Y_train, none, ys)[()]
    scaled = lambda d, ns, m: d.select(*map(c, keys), *(((c(n).cast("double") - float(a)) / float(s)).alias(n) for n, a, s in zip(ns, m.y, m.y_scale, strict=True)))
    return StandardizationBundle(xs, ys, mx.y, mx.y_scale, my.y, my.y_scale, scaled(X_train, xs, mx), scaled(X_holdout, xs, mx), scaled(Y_train, ys, my), scaled(Y_holdout, ys, my))


# ---- final OLS


@dataclass(frozen=True)
class FinalOLSFitResult:
    feature_names: list[str]
    output_names: list[str]
    coef_raw_scale: np.ndarray
    intercept_raw_scale: np.ndarray
    coef_standardized: np.ndarray
    intercept_standardized: np.ndarray
    x_means: np.ndarray
    x_scales: np.ndarray
    y_means: np.ndarray
    y_scales: np.ndarray
    n_rows: int
    y_range: np.ndarray
    design_spec: feats.DesignMatrixSpec | None = None
    categorical_feature_columns: tuple[str, ...] = field(default=())


def result_of(m: Moments, xs: list[str], ys: list[str]) -> FinalOLSFitResult:
    B, b = solvers.ols(m)
    sx, sy = m.x_scale, m.y_scale
    std = B * sx[None] / sy[:, None]
    return FinalOLSFitResult(list(xs), list(ys), B, b, std, (B @ m.x + b - m.y) / sy, m.x, sx, m.y, sy, m.n, m.y_range)


def fit_final_ols(X: DataFrame, Y: DataFrame, *, keys: list[str], output_batch_size: int | None = None) -> FinalOLSFitResult:
    """OLS of all outputs from one aggregation; batches of outputs bound the size of a partial and change nothing else."""
    validate.require_matching_xy(X, Y, keys)
    xs, ys = others(X, keys), others(Y, keys)
    if output_batch_size is not None and output_batch_size < 1:
        raise ValueError("output_batch_size must be positive")
    rows = validate.joined(validate.numeric(X, xs, "X"), validate.numeric(Y, ys, "Y"), keys)
    size = output_batch_size or len(ys)
    parts = [result_of(moments(rows, xs, ys[k : k + size])[()], xs, ys[k : k + size]) for k in range(0, len(ys), size)]
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return replace(parts[0], output_names=ys, **{n: join(n) for n in ("coef_raw_scale", "intercept_raw_scale", "coef_standardized", "intercept_standardized", "y_means", "y_scales", "y_range")})


def predict_final_ols(result: FinalOLSFitResult, X: DataFrame, *, keys: list[str], check: bool = True) -> DataFrame:
    """keys and predictions by output; missing features or non-finite values are errors (``check=False`` skips that scan)."""
    if lost := [n for n in result.feature_names if n not in X.columns]:
        raise ValueError(f"missing features {lost}")
    X = validate.numeric(X, result.feature_names, "X") if check else X
    return project(X, keys, result.feature_names, result.output_names, result.coef_raw_scale, result.intercept_raw_scale)


def fit_final_ols_with_design(X: DataFrame, Y: DataFrame, spec: feats.DesignMatrixSpec, *, keys: list[str]) -> FinalOLSFitResult:
    spec = feats.resolve_spec_levels(X, spec)
    design = feats.build_design_matrix(X, spec, keys=keys)
    return replace(fit_final_ols(design.matrix, Y, keys=keys), design_spec=spec, categorical_feature_columns=(*design.categorical_columns, *design.interaction_columns))


def predict_from_raw_records(result: FinalOLSFitResult, X: DataFrame, *, keys: list[str]) -> DataFrame:
    if result.design_spec is None:
        raise ValueError("the fit has no design spec")
    return predict_final_ols(result, feats.build_design_matrix(X, result.design_spec, keys=keys).matrix, keys=keys)


# ---- screening


@dataclass(frozen=True)
class ScreeningSelectionResult:
    feature_names: list[str]
    output_names: list[str]
    coef: np.ndarray  # outputs x features, on z-scores
    selected_mask: np.ndarray
    selected_features: list[str]
    best_alpha: float
    best_l1_ratio: float
    cv_mse: float
    selection_tol: float
    n_rows: int


def fit_multitask_elastic_net_screen(X: DataFrame, Y: DataFrame, *, keys: list[str], cv: int = 5, l1_ratio: tuple[float, ...] = (0.2, 0.5, 0.8, 1.0), alphas: int = 100, max_iter: int = 5000, tol: float = 1e-4, random_state: int = 123, selection_tol: float = 1e-8) -> ScreeningSelectionResult:
    """Multitask elastic net on z-scores, alpha and l1_ratio by cross-validation.

    One aggregation gives the moments of each fold; all fits and validation
    errors follow from them.  Folds are contiguous in the order of the key's
    digest under random_state.
    """
    validate.require_matching_xy(X, Y, keys)
    xs, ys = others(X, keys), others(Y, keys)
    rows = validate.joined(validate.numeric(X, xs, "X"), validate.numeric(Y, ys, "Y"), keys)
    n = rows.count()
    folds = min(cv, n)
    by_fold = moments(split.fold_ids(rows, keys, folds, random_state), xs, ys, ["fold"])
    total = Moments.empty(len(xs), len(ys))
    for m in by_fold.values():
        total = total + m
    # z-scores are those of all rows, as the folds share one scale
    sx, sy = total.x_scale, total.y_scale

    def z(m: Moments) -> Moments:
        return Moments(m.n, (m.x - total.x) / sx, (m.y - total.y) / sy, m.sxx / np.outer(sx, sx), m.sxy / np.outer(sx, sy), m.syy / sy**2, m.low, m.high)

    whole, parts = z(total), [z(m) for m in by_fold.values()]
    trains = [whole - m for m in parts]
    errors = fold_errors(X.sparkSession, trains, parts, {r: solvers.alpha_grid(whole.sxy, whole.n, r, alphas) for r in l1_ratio}, max_iter, tol)
    best = (np.inf, 0.0, 0.0)
    for r in l1_ratio:
        grid, sums = solvers.alpha_grid(whole.sxy, whole.n, r, alphas), sum(errors[r, f] for f in range(len(parts)))
        k = int(np.argmin(sums))
        if sums[k] < best[0]:
            best = (float(sums[k]), float(grid[k]), float(r))
    Q, R = solvers.rotation(whole.sxy)
    W = solvers.elastic_net(whole.sxx, R, whole.n, best[1], best[2], max_iter, tol) @ Q.T
    mask = (np.abs(W) > selection_tol).any(axis=1)
    return ScreeningSelectionResult(xs, ys, W.T, mask, [f for f, k in zip(xs, mask, strict=True) if k], best[1], best[2], best[0] / (n * len(ys)), selection_tol, n)


def fold_errors(spark: SparkSession, trains: list[Moments], vals: list[Moments], grids: dict[float, np.ndarray], max_iter: int, tol: float) -> dict[tuple[float, int], np.ndarray]:
    """Squared validation errors along the grid of alphas, by l1_ratio and fold: one task each.

    A task gets p x p arrays, whatever the number of outputs: the outputs are
    rotated onto the at most p directions that the training products have, which
    leaves row norms, and with them penalty and solution, as they are.
    """
    work = []
    for f, (train, val) in enumerate(zip(trains, vals, strict=True)):
        Q, R = solvers.rotation(train.sxy)
        dy = val.y - train.y
        arrays = (train.sxx, R, val.sxx, val.sxy @ Q, val.x - train.x, dy @ Q, np.array([float(train.n), float(val.n), val.syy.sum() + val.n * (dy @ dy)]))
        work += [(float(r), f, len(train.x), R.shape[1], bytearray(b"".join(np.asarray(a, "<f8").tobytes() for a in arrays))) for r in grids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, f, p, k, data in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                got = path_errors(np.frombuffer(data, "<f8"), p, k, grids[r], r, max_iter, tol)
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([f], pa.int64()), pa.array([got.tolist()])], ["ratio", "fold", "errors"])

    tasks = spark.createDataFrame(work, "ratio double, fold long, p long, k long, data binary").repartition(len(work), "ratio", "fold")
    return {(r.ratio, r.fold): np.array(r.errors) for r in tasks.mapInArrow(run, "ratio double, fold long, errors array<double>").collect()}


def path_errors(data: np.ndarray, p: int, k: int, grid: np.ndarray, ratio: float, max_iter: int, tol: float) -> np.ndarray:
    """Squared errors of a fold along the grid, each fit beginning with the one before."""
    at, arrays = 0, []
    for shape in ((p, p), (p, k), (p, p), (p, k), (p,), (k,), (3,)):
        size = int(np.prod(shape))
        arrays.append(data[at : at + size].reshape(shape))
        at += size
    sxx, sxy, vxx, vxy, dx, dy, (n, m, syy) = arrays
    out, V = [], None
    for a in grid:
        V = solvers.elastic_net(sxx, sxy, int(n), a, ratio, max_iter, tol, V)
        gap = V.T @ dx
        out.append(syy - 2 * (V * vxy).sum() + (V * (vxx @ V)).sum() + m * (gap @ gap - 2 * dy @ gap))
    return np.maximum(np.array(out), 0)


def screening_selection_table(result: ScreeningSelectionResult) -> list[dict]:
    """feature, position, selected, nonzero outputs and the largest coefficient, in order."""
    size = np.abs(result.coef)
    return [{"feature_name": f, "original_position": i, "selected": bool(result.selected_mask[i]), "nonzero_output_count": int((size[:, i] > 0).sum()), "max_abs_coef": float(size[:, i].max(initial=0.0))} for i, f in enumerate(result.feature_names)]


@dataclass(frozen=True)
class ScreeningImportanceResult:
    feature_names: list[str]
    coef_magnitudes: np.ndarray


def importance(m: Moments) -> np.ndarray:
    """Mean over outputs of the absolute OLS coefficients on z-scores."""
    sxx, sxy = solvers.standardized(m)
    return np.abs(np.linalg.pinv(sxx, hermitian=True) @ sxy).mean(axis=1)


def compute_enriched_coef_magnitudes(X: DataFrame, Y: DataFrame, *, keys: list[str]) -> ScreeningImportanceResult:
    xs, ys = others(X, keys), others(Y, keys)
    rows = validate.joined(validate.numeric(X, xs, "X"), validate.numeric(Y, ys, "Y"), keys)
    return ScreeningImportanceResult(xs, importance(moments(rows, xs, ys)[()]))


# ---- support selection


@dataclass(frozen=True)
class SupportSelectionResult:
    selected_features: list[str]
    selected_mask: np.ndarray
    best_threshold: float
    sensitivity_table: list[dict]
    coef_magnitudes: np.ndarray


def _closed(sealed: split.SealedSplitResult) -> None:
    if sealed.is_unsealed:
        raise split.SealedTestAccessError("thresholds must be chosen before the test part is unsealed")


def select_threshold_on_internal_validation(sealed: split.SealedSplitResult, thresholds: list[float], scorer: Callable[[float, DataFrame, DataFrame], float], *, seed: int = 0) -> float:
    """The threshold with the least score; of ties the smallest."""
    _closed(sealed)
    if not thresholds:
        raise ValueError("thresholds must not be empty")
    scores = [(scorer(t, sealed.train, sealed.val), t) for t in thresholds]
    return min(scores)[1]


def select_support_via_refit(features: list[str], responses: list[str], sealed: split.SealedSplitResult, thresholds: list[float], *, seed: int = 0) -> SupportSelectionResult:
    """Features whose importance exceeds the threshold with the best validation error after refitting.

    One aggregation of each part; every refit solves a part of the training
    moments, and errors come from the validation moments.
    """
    _closed(sealed)
    check_names(list(features), "features"), check_names(list(responses), "responses")
    if lost := [n for n in [*features, *responses] if n not in sealed.train.columns]:
        raise ValueError(f"missing columns {lost}")
    train, val = (moments(d, list(features), list(responses))[()] for d in (sealed.train, sealed.val))
    size = importance(train)
    table = []
    for t in thresholds:
        pick = np.flatnonzero(size > t).tolist()
        score = float("inf")
        if pick:
            B, b = solvers.ols(train.features(pick))
            score = float(np.sqrt(val.features(pick).sse(B, b).sum() / (val.n * len(responses))))
        table.append({"threshold": float(t), "n_selected": len(pick), "val_score": score})
    best = select_threshold_on_internal_validation(sealed, list(thresholds), lambda t, *_: next(r["val_score"] for r in table if r["threshold"] == t), seed=seed)
    mask = size > best
    if not mask.any():
        raise ValueError("no threshold leaves a feature")
    return SupportSelectionResult([f for f, k in zip(features, mask, strict=True) if k], mask, best, table, size)
