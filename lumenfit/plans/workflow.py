"""The canonical run: screen, refit, evaluate, assemble; nothing is written."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from lumenfit.functions.columns import c, others
from lumenfit.operators import bootstrap, linear, validate
from lumenfit.sources import artifacts
from lumenfit.sources.bundle import resolve_artifact_format


def make_holdout_nrmse_summary(result: linear.FinalOLSFitResult, X_holdout: DataFrame, Y_holdout: DataFrame, Y_ref: DataFrame, *, keys: list[str], **options: Any) -> dict[str, Any]:
    pred = linear.predict_final_ols(result, X_holdout, keys=keys)
    out = bootstrap.bootstrap_macro_nrmse_ci(Y_holdout, pred, Y_ref, keys=keys, **options)
    return out | {"holdout_rows": Y_holdout.count(), "n_features": len(result.feature_names), "n_outputs": len(result.output_names)}


@dataclass(frozen=True)
class CanonicalWorkflowRun:
    screening: linear.ScreeningSelectionResult
    final_fit: linear.FinalOLSFitResult
    holdout_summary: dict[str, Any]
    artifacts: dict[str, Any]


def run_canonical_workflow(X_train: DataFrame, Y_train: DataFrame, X_holdout: DataFrame, Y_holdout: DataFrame, *, keys: list[str], dataset_tag: str, all_input_features: list[str] | None = None, cv: int = 5, l1_ratio: tuple[float, ...] = (0.9, 1.0), alphas: int = 100, max_iter: int = 10_000, tol: float = 1e-4, selection_tol: float = 1e-6, random_state: int = 123, n_boot: int = 1000, alpha: float = 0.05, bootstrap_sample_size: int | None = None, min_range: float = 1e-6, artifact_format: str = "auto", upstream_provenance: dict[str, Any] | None = None) -> CanonicalWorkflowRun:
    validate.require_matching_xy(X_train, Y_train, keys)
    validate.require_matching_xy(X_holdout, Y_holdout, keys)
    validate.require_same_columns(X_train, X_holdout)
    validate.require_same_columns(Y_train, Y_holdout)
    kind = resolve_artifact_format(artifact_format)
    every = all_input_features or others(X_train, keys)
    screen = linear.fit_multitask_elastic_net_screen(X_train, Y_train, keys=keys, cv=cv, l1_ratio=l1_ratio, alphas=alphas, max_iter=max_iter, tol=tol, random_state=random_state, selection_tol=selection_tol)
    if not screen.selected_features:
        raise ValueError("screening selected no features")
    kept = [*keys, *screen.selected_features]
    fit = linear.fit_final_ols(X_train.select(*map(c, kept)), Y_train, keys=keys)
    summary = make_holdout_nrmse_summary(fit, X_holdout.select(*map(c, kept)), Y_holdout, Y_train, keys=keys, n_boot=n_boot, alpha=alpha, random_state=random_state, sample_size=bootstrap_sample_size, min_range=min_range)
    built = artifacts.build_postfit_artifacts(
        X_train.sparkSession, fit, dataset_tag=dataset_tag, all_input_features=every, selected_features=screen.selected_features, evaluation_summary=summary, artifact_format=kind,
        metrics={"holdout_macro_nrmse": summary["point_estimate"], "ci_lower": summary["ci_lower"], "ci_upper": summary["ci_upper"]},
        evaluation={"n_boot": n_boot, "alpha": alpha, "bootstrap_sample_size": summary["bootstrap_sample_size"], "random_state": random_state, "min_range": min_range, "holdout_rows": summary["holdout_rows"]},
        upstream_provenance={"screening_alpha": screen.best_alpha, "screening_l1_ratio": screen.best_l1_ratio, "cv": cv} | (upstream_provenance or {}),
    )
    return CanonicalWorkflowRun(screen, fit, summary, built)
