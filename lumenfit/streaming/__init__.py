"""Streams of records: predictions, and errors by windows of event time.

Fitting is a batch aggregation and has no streaming form; feature expansion is
a projection, and ``apply_feature_expansion(..., warn=False)`` takes streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfit.functions.columns import c
from lumenfit.operators.linear import FinalOLSFitResult, linear_columns


def score_stream(result: FinalOLSFitResult, stream: DataFrame, *, keep: Sequence[str]) -> DataFrame:
    """The kept columns and a prediction ``pred_<output>`` for each output; null where a feature is missing."""
    if lost := [n for n in [*keep, *result.feature_names] if n not in stream.columns]:
        raise ValueError(f"missing columns {lost}")
    values = linear_columns(result.feature_names, result.coef_raw_scale, result.intercept_raw_scale)
    return stream.select(*map(c, keep), *(v.alias(f"pred_{n}") for v, n in zip(values, result.output_names, strict=True)))


def windowed_rmse(result: FinalOLSFitResult, stream: DataFrame, *, time: str, window: str, late: str) -> DataFrame:
    """window, n and ``rmse_<output>`` of a stream that has features, outputs and an event time.

    Records up to ``late`` behind the newest count in their window; rows with a
    missing feature or output are left out of that output's error.
    """
    scored = score_stream(result, stream, keep=[time, *result.output_names]).withWatermark(time, late)
    errors = (F.sqrt(F.avg(F.pow(c(n) - c(f"pred_{n}"), 2))).alias(f"rmse_{n}") for n in result.output_names)
    return scored.groupBy(F.window(c(time), window).alias("window")).agg(F.count(F.lit(1)).alias("n"), *errors)
