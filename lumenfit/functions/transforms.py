"""Scalar transforms: a whitelisted expression in ``x`` becomes a Catalyst column."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.functions.columns import c, finite

CALLS = {n: getattr(F, n) for n in ("log", "exp", "sqrt", "abs", "sin", "cos", "tan", "sinh", "cosh", "tanh", "asin", "acos", "atan", "log10", "log2", "log1p", "expm1", "floor", "ceil", "cbrt", "sign")}
CALLS |= {"ln": F.log, "Abs": F.abs}
CONSTANTS = {"pi": 3.141592653589793, "E": 2.718281828459045}


def expression(text: str, x: Column) -> Column:
    """``text`` over ``x``; anything but arithmetic, numbers and known functions is a ValueError.

    Terms are evaluated as written, without algebraic simplification.
    """

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id="x"):
                return x
            case ast.Name(id=name) if name in CONSTANTS:
                return F.lit(CONSTANTS[name])
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -build(a)
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return build(a)
            case ast.BinOp(left=a, op=ast.Pow(), right=ast.Constant(value=2)):
                return build(a) * build(a)
            case ast.BinOp(left=a, op=op, right=b):
                left, right = build(a), build(b)
                match op:
                    case ast.Add():
                        return left + right
                    case ast.Sub():
                        return left - right
                    case ast.Mult():
                        return left * right
                    case ast.Div():
                        return F.try_divide(left, right)
                    case ast.Pow():
                        return F.pow(left, right)
            case ast.Call(func=ast.Name(id=name), args=[a], keywords=[]) if name in CALLS:
                return CALLS[name](build(a)).cast("double")
        raise ValueError(f"not allowed in a transform: {ast.dump(node)[:80]}")

    try:
        tree = ast.parse(text.replace("^", "**"), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"invalid expression {text!r}") from e
    return build(tree)


@dataclass(frozen=True)
class TransformDef:
    """A scalar transform; results outside the real numbers are null."""

    expr: str
    label: str
    name: str = ""

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_]+", self.label or ""):
            raise ValueError("label must be made of letters, digits and underscores")
        expression(self.expr, F.lit(1.0)) if _active() else ast.parse(self.expr.replace("^", "**"), mode="eval")

    def column_name(self, base: str) -> str:
        return f"{base}_{self.label}"

    def apply(self, value: Column) -> Column:
        return finite(expression(self.expr, value.cast("double")))

    def valid_fraction(self, df: DataFrame, column: str) -> float:
        """Share of rows with a finite result; 0.0 of no rows."""
        return df.agg(F.coalesce(F.avg(self.apply(c(column)).isNotNull().cast("double")), F.lit(0.0))).first()[0]

    @classmethod
    def from_config(cls, config: Mapping[str, str]) -> TransformDef:
        missing = {"expr", "label"} - set(config)
        if missing:
            raise ValueError(f"transform config lacks {sorted(missing)}")
        return cls(config["expr"], config["label"], config.get("name", ""))

    def to_config(self) -> dict[str, str]:
        return {"expr": self.expr, "label": self.label, "name": self.name}


def _active() -> bool:
    from pyspark import SparkContext

    return SparkContext._active_spark_context is not None


QUADRATIC = TransformDef("x**2", "sq", "quadratic")
LOGARITHMIC = TransformDef("log(x + 1)", "log1p", "logarithmic")
INVERSE = TransformDef("1 / x", "inv", "inverse")
SQRT = TransformDef("sqrt(x)", "sqrt", "square root")
EXPONENTIAL = TransformDef("exp(x)", "exp", "exponential")
DEFAULT_TRANSFORM_LIBRARY = [QUADRATIC, LOGARITHMIC, INVERSE, SQRT]


def nan_report(df: DataFrame, bases: list[str], transforms: list[TransformDef]) -> dict[str, list[str]]:
    """label -> bases for which some row has no finite result; one aggregation."""
    pairs = [(t, b) for t in transforms for b in bases]
    if not pairs:
        return {}
    row = df.agg(*(F.count_if(t.apply(c(b)).isNull()).alias(f"n{i}") for i, (t, b) in enumerate(pairs))).first()
    out: dict[str, list[str]] = {}
    for n, (t, b) in zip(row, pairs, strict=True):
        if n:
            out.setdefault(t.label, []).append(b)
    return out


def warn_nan_transforms(report: Mapping[str, list[str]]) -> None:
    """A UserWarning for each label, naming five features at most."""
    for label in sorted(report):
        names = report[label]
        if names:
            more = f" and {len(names) - 5} more" if len(names) > 5 else ""
            warnings.warn(f"transform '{label}' has no finite value for some rows of: {', '.join(names[:5])}{more}", UserWarning, stacklevel=2)
