"""Writing, reading and predicting from a bundle: eight tables and a manifest, which is written last."""

from __future__ import annotations

import json
from pathlib import PurePosixPath
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.functions.columns import c
from lumenfit.operators import linear, validate
from lumenfit.sources.artifacts import MANIFEST_KEYS, POSITION_MAPS, build_position_map, canonical_postfit_artifact_names

MANIFEST = "manifest.json"


def resolve_artifact_format(name: str) -> str:
    if name not in ("auto", "parquet", "csv"):
        raise ValueError("artifact_format must be auto, parquet or csv")
    return "parquet" if name == "auto" else name


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, through Hadoop's file systems; it appears whole, by a rename."""
    fs, p = _fs(spark, path)
    _, part = _fs(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def artifact_path(root: str, relative: Any) -> str:
    """The place of an artifact; it must be a relative parquet or csv path inside the bundle."""
    if not isinstance(relative, str) or not relative or relative.startswith("/") or ":" in relative or "\\" in relative:
        raise ValueError(f"artifact path {relative!r} must be relative")
    path = PurePosixPath(relative)
    if ".." in path.parts:
        raise ValueError(f"artifact path {relative!r} leaves the bundle")
    if path.suffix not in (".parquet", ".csv"):
        raise ValueError(f"artifact path {relative!r} must end in .parquet or .csv")
    return f"{root.rstrip('/')}/{path}"


def check_manifest(m: dict[str, Any]) -> None:
    if lost := [k for k in MANIFEST_KEYS if k not in m]:
        raise ValueError(f"manifest lacks {lost}")
    lists = ("all_input_features", "selected_features", "retained_features", "output_names")
    counts = ("n_all_input_features", "n_selected_features", "n_retained_features", "n_outputs")
    for names, count, places in zip(lists, counts, POSITION_MAPS, strict=True):
        v = m[names]
        if not isinstance(v, list) or not v or len(set(v)) != len(v) or not all(isinstance(n, str) and n for n in v):
            raise ValueError(f"{names} must be a list of unique non-empty strings")
        if m[count] != len(v):
            raise ValueError(f"{count} doesn't match {names}")
        if m[places] != build_position_map(v):
            raise ValueError(f"{places} doesn't match {names}")
    if not set(m["retained_features"]) <= set(m["selected_features"]) <= set(m["all_input_features"]):
        raise ValueError("retained, selected and all features must be nested")
    for k in ("files", "metrics", "evaluation", "upstream_provenance"):
        if not isinstance(m[k], dict):
            raise ValueError(f"{k} must be an object")
    if set(m["files"]) != set(canonical_postfit_artifact_names()):
        raise ValueError("files must name exactly the canonical artifacts")


def write_postfit_bundle(artifacts: dict[str, Any], root: str) -> dict[str, str]:
    """Checks all, then writes the tables, then the manifest; returns the paths."""
    manifest = artifacts["manifest"]
    check_manifest(manifest)
    paths = {n: artifact_path(root, manifest["files"][n]) for n in canonical_postfit_artifact_names()}
    if len(set(paths.values())) != len(paths):
        raise ValueError("artifact paths must differ")
    if lost := [n for n in paths if n not in artifacts]:
        raise ValueError(f"missing artifacts {lost}")
    text = json.dumps(manifest, indent=2)
    spark = artifacts["output_metadata"].sparkSession
    for name, path in paths.items():
        writer = artifacts[name].coalesce(1).write.mode("overwrite")
        writer.parquet(path) if path.endswith(".parquet") else writer.option("header", True).csv(path)
    write_text(spark, f"{root.rstrip('/')}/{MANIFEST}", text + "\n")
    return paths | {"manifest": f"{root.rstrip('/')}/{MANIFEST}"}


def load_manifest(spark: SparkSession, root: str) -> dict[str, Any]:
    path = f"{root.rstrip('/')}/{MANIFEST}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    m = json.loads(read_text(spark, path))
    if not isinstance(m, dict) or not isinstance(m.get("files"), dict):
        raise ValueError("the manifest must be an object with a files object")
    return m


#: Columns of the tables that aren't numbers, and of those that are whole ones; all others are doubles.
TEXT = {"input_name", "output_name", "feature_name"}
WHOLE = {"original_position"}


def _csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A table by its header and the fixed kinds of its columns; names like 001 stay text."""
    lines = spark.read.option("header", True).option("multiLine", True).csv(path)
    if key != "nrmse_summary":
        return lines.select(*(c(n) if n in TEXT else c(n).cast("int" if n in WHOLE else "double").alias(n) for n in lines.columns))
    # the summary's columns vary: numbers where all values are
    told = {n: c(n).try_cast("double") for n in lines.columns}
    if not told:
        return lines
    odd = lines.agg(*(F.count_if(v.isNull() & c(n).isNotNull()).alias(f"n{i}") for i, (n, v) in enumerate(told.items()))).first()
    return lines.select(*(c(n) if bad else v.alias(n) for (n, v), bad in zip(told.items(), odd, strict=True)))


def _read(spark: SparkSession, path: str, key: str) -> DataFrame:
    """An artifact; only nrmse_summary may have no columns."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    table = spark.read.parquet(path) if path.endswith(".parquet") else _csv(spark, path, key)
    if not table.columns and key != "nrmse_summary":
        raise ValueError(f"bundle artifact {key!r} is empty")
    return table


def load_postfit_bundle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    files = load_manifest(spark, root)["files"]
    if lost := [n for n in canonical_postfit_artifact_names() if n not in files]:
        raise ValueError(f"the manifest names no {lost}")
    return {n: _read(spark, artifact_path(root, files[n]), n) for n in canonical_postfit_artifact_names()}


def predict_from_postfit_bundle(root: str, X: DataFrame, *, keys: list[str]) -> DataFrame:
    """B (x - mean x) + mean y from three of the tables, whose names and order must be those of the manifest."""
    spark = X.sparkSession
    m = load_manifest(spark, root)
    check_manifest(m)
    xs, ys = m["retained_features"], m["output_names"]
    if lost := [n for n in xs if n not in X.columns]:
        raise ValueError(f"missing features {lost}")
    coef, sx, sy = (_read(spark, artifact_path(root, m["files"][n]), n) for n in ("coef_matrix_raw_scale", "x_standardization", "y_standardization"))
    if coef.columns != ["output_name", *xs]:
        raise ValueError("coefficient columns don't match the manifest")
    by = {r[0]: [float(v) for v in r[1:]] for r in coef.collect()}  # outputs x features: the model itself
    means = []
    for table, name, want in ((sx, "feature_name", xs), (sy, "output_name", ys)):
        rows = table.orderBy("original_position").collect()
        if [r[name] for r in rows] != want:
            raise ValueError(f"{name} order doesn't match the manifest")
        means.append(np.array([r["mean"] for r in rows], dtype=float))
    if set(by) != set(ys):
        raise ValueError("coefficient outputs don't match the manifest")
    B = np.array([by[o] for o in ys])
    if not all(np.isfinite(v).all() for v in (B, *means)):
        raise ValueError("the bundle has non-finite values")
    return linear.project(validate.numeric(X, xs, "X"), keys, xs, ys, B, means[1] - B @ means[0])
