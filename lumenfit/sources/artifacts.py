"""Fixed-schema artifact tables, the pipeline manifest, and frozen configurations."""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumenfit.functions.columns import check_names
from lumenfit.operators.linear import FinalOLSFitResult


class FrozenConfigRequiredError(RuntimeError):
    """A sealed evaluation was tried without a frozen configuration."""


class ConfigDriftError(RuntimeError):
    """The configuration isn't the one that was frozen."""


@dataclass(frozen=True)
class FrozenConfigStamp:
    config_hash: str
    frozen_at: str


def freeze_config(config: Any) -> FrozenConfigStamp:
    """A stamp that holds for exactly this configuration: the digest of its JSON text with sorted keys."""
    digest = hashlib.sha256()
    for piece in json.JSONEncoder(sort_keys=True, default=str).iterencode(config):
        digest.update(piece.encode())
    return FrozenConfigStamp(digest.hexdigest(), datetime.datetime.now(datetime.UTC).isoformat())


def require_frozen_stamp(config: Any, stamp: FrozenConfigStamp | None) -> None:
    """Nothing, if the stamp is this configuration's; else the error that says what is wrong with it."""
    match stamp:
        case FrozenConfigStamp(config_hash=known) if known == freeze_config(config).config_hash:
            return
        case None:
            raise FrozenConfigRequiredError("no stamp: freeze the configuration before the sealed part is evaluated")
    raise ConfigDriftError("the stamp belongs to another configuration")


@dataclass(frozen=True)
class PostfitArtifactSpec:
    artifact_name: str
    category: str
    description: str


#: Names and order of a bundle's tables.
POSTFIT_ARTIFACTS = [
    PostfitArtifactSpec("all_input_metadata", "metadata", "One row for each column that screening was offered, with its place"),
    PostfitArtifactSpec("selected_input_metadata", "metadata", "What the screen kept, numbered anew"),
    PostfitArtifactSpec("output_metadata", "metadata", "One row for each modeled response, with its place"),
    PostfitArtifactSpec("coef_matrix_standardized", "coefficients", "Responses by features, for z-scores of both sides"),
    PostfitArtifactSpec("coef_matrix_raw_scale", "coefficients", "Responses by features, in the units of the data"),
    PostfitArtifactSpec("x_standardization", "standardization", "Centre and spread of each feature in the training rows"),
    PostfitArtifactSpec("y_standardization", "standardization", "Centre and spread of each response in the training rows"),
    PostfitArtifactSpec("nrmse_summary", "evaluation", "One row: how far predictions are off on unseen rows"),
]
#: Keys of a manifest.
POSITION_MAPS = ["all_input_position_map", "selected_input_position_map", "retained_input_position_map", "output_position_map"]
MANIFEST_KEYS = ["dataset_tag", "n_all_input_features", "n_selected_features", "n_retained_features", "n_outputs", "all_input_features", "selected_features", "retained_features", "output_names", "files", "metrics", "evaluation", "upstream_provenance", *POSITION_MAPS]


def canonical_postfit_artifact_names() -> list[str]:
    return [a.artifact_name for a in POSTFIT_ARTIFACTS]


def canonical_bundle_loader_keys() -> list[str]:
    return canonical_postfit_artifact_names()


def canonical_manifest_position_map_keys() -> list[str]:
    return list(POSITION_MAPS)


def canonical_manifest_top_level_keys() -> list[str]:
    return list(MANIFEST_KEYS)


def postfit_artifact_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a.artifact_name, i, a.category, a.description) for i, a in enumerate(POSTFIT_ARTIFACTS)], "artifact_name string, artifact_position int, category string, description string")


def build_position_map(names: Sequence[str]) -> dict[str, int]:
    return {n: i for i, n in enumerate(names)}


@dataclass(frozen=True)
class PipelineManifest:
    dataset_tag: str
    n_all_input_features: int
    n_selected_features: int
    n_retained_features: int
    n_outputs: int
    all_input_features: list[str]
    selected_features: list[str]
    retained_features: list[str]
    output_names: list[str]
    files: dict[str, str]
    metrics: dict[str, Any] = field(default_factory=dict)
    evaluation: dict[str, Any] = field(default_factory=dict)
    upstream_provenance: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        lists = (self.all_input_features, self.selected_features, self.retained_features, self.output_names)
        return asdict(self) | {k: build_position_map(v) for k, v in zip(POSITION_MAPS, lists, strict=True)}


def make_metadata_frame(spark: SparkSession, names: Sequence[str], name_column: str) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{name_column}` string, original_position int")


def make_coefficient_matrix_frame(spark: SparkSession, coef: np.ndarray, output_names: Sequence[str], feature_names: Sequence[str]) -> DataFrame:
    coef = np.asarray(coef, dtype=float)
    if coef.shape != (len(output_names), len(feature_names)):
        raise ValueError("coefficients must be outputs x features")
    schema = ", ".join(["output_name string", *(f"`{n.replace('`', '``')}` double" for n in feature_names)])
    return spark.createDataFrame([(o, *map(float, row)) for o, row in zip(output_names, coef, strict=True)], schema)


def make_standardization_frame(spark: SparkSession, names: Sequence[str], means: np.ndarray, scales: np.ndarray, *, name_column: str) -> DataFrame:
    if name_column not in ("feature_name", "output_name"):
        raise ValueError("name_column must be feature_name or output_name")
    if not len(names) == len(means) == len(scales):
        raise ValueError("names, means and scales must have one length")
    rows = [(n, i, float(m), float(s)) for i, (n, m, s) in enumerate(zip(names, means, scales, strict=True))]
    return spark.createDataFrame(rows, f"{name_column} string, original_position int, mean double, scale double")


def build_postfit_artifacts(spark: SparkSession, result: FinalOLSFitResult, *, dataset_tag: str, all_input_features: list[str], selected_features: list[str] | None = None, evaluation_summary: dict[str, Any] | None = None, upstream_provenance: dict[str, Any] | None = None, metrics: dict[str, Any] | None = None, evaluation: dict[str, Any] | None = None, artifact_format: str = "parquet") -> dict[str, Any]:
    """The eight tables and the manifest of a fit; the design spec is kept whole, so raw records can be predicted."""
    if artifact_format not in ("parquet", "csv"):
        raise ValueError("artifact_format must be parquet or csv")
    if not isinstance(dataset_tag, str) or not dataset_tag.strip():
        raise ValueError("dataset_tag must be a non-empty string")
    retained, outputs = check_names(list(result.feature_names), "retained_features"), check_names(list(result.output_names), "output_names")
    chosen = check_names(retained if selected_features is None else list(selected_features), "selected_features")
    every = check_names(list(all_input_features), "all_input_features")
    for small, large, what in ((chosen, every, "selected_features"), (retained, chosen, "retained_features")):
        if not set(small) <= set(large):
            raise ValueError(f"{what} must be a subset of the list before it")
    summary = evaluation_summary or {}
    kinds = {bool: "boolean", int: "long", float: "double"}
    told = {k: v if type(v) in kinds or v is None else str(v) for k, v in summary.items()}
    schema = ", ".join(f"`{k}` {kinds.get(type(v), 'string')}" for k, v in told.items())
    tables = {
        "all_input_metadata": make_metadata_frame(spark, every, "input_name"), "selected_input_metadata": make_metadata_frame(spark, chosen, "input_name"), "output_metadata": make_metadata_frame(spark, outputs, "output_name"),
        "coef_matrix_standardized": make_coefficient_matrix_frame(spark, result.coef_standardized, outputs, retained), "coef_matrix_raw_scale": make_coefficient_matrix_frame(spark, result.coef_raw_scale, outputs, retained),
        "x_standardization": make_standardization_frame(spark, retained, result.x_means, result.x_scales, name_column="feature_name"), "y_standardization": make_standardization_frame(spark, outputs, result.y_means, result.y_scales, name_column="output_name"),
        "nrmse_summary": spark.createDataFrame([tuple(told.values())] if told else [], schema or "point_estimate double"),
    }
    files = {n: f"postfit_diagnostics/{n}.{artifact_format}" for n in canonical_postfit_artifact_names()}
    manifest = PipelineManifest(dataset_tag, len(every), len(chosen), len(retained), len(outputs), every, chosen, retained, outputs, files, dict(metrics or {}), dict(evaluation or {}), dict(upstream_provenance or {})).to_dict()
    if result.design_spec is not None and result.design_spec.categorical_inputs:
        spec = result.design_spec
        manifest["categorical_inputs"] = [{"name": d.name, "levels": d.levels} for d in spec.categorical_inputs]
        manifest["categorical_feature_columns"] = list(result.categorical_feature_columns)
        manifest["design"] = {"drop_first": spec.drop_first, "interaction_pairs": [list(p) for p in spec.interaction_pairs]}
    return {**tables, "manifest": manifest}
