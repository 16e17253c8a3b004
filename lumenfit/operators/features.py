"""Feature expansion, categorical design matrices and the structure of names."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.functions.columns import c, unique
from lumenfit.functions.transforms import DEFAULT_TRANSFORM_LIBRARY, TransformDef, nan_report, warn_nan_transforms

#: Suffixes that mark a transformed input.
KNOWN_TRANSFORMATIONS = {"quadratic", "inverse", "log", "log1p", "square", "cubic", "cube", "reciprocal", "abs", "logarithmic", "sq", "inv", "sqrt"}


#: Levels of a categorical input at most.
MOST_LEVELS = 10_000

# ---- expansion


@dataclass(frozen=True)
class FeatureExpansionSpec:
    base_features: list[str]
    categorical_flags: list[str] = field(default_factory=list)
    transforms: dict[str, list[TransformDef]] = field(default_factory=dict)
    interactions: list[tuple[str, str]] = field(default_factory=list)


@dataclass(frozen=True)
class FeatureExpansionResult:
    expanded_frame: DataFrame
    ordered_columns: list[str]


def default_feature_expansion_spec(base_features: Iterable[str], *, categorical_flags: Iterable[str] = (), transforms: Iterable[TransformDef] | None = None, transform_features: Iterable[str] | None = None, interactions: Iterable[tuple[str, str]] = ()) -> FeatureExpansionSpec:
    """Each transform (one for each label) of each named base; order is kept and repeats are dropped."""
    bases = unique(base_features)
    library = list({t.label: t for t in reversed(list(DEFAULT_TRANSFORM_LIBRARY if transforms is None else transforms))}.values())[::-1]
    chosen = bases if transform_features is None else unique(transform_features)
    if unknown := [n for n in chosen if n not in bases]:
        raise ValueError(f"transforms of unknown base features {unknown}")
    return FeatureExpansionSpec(bases, unique(categorical_flags), {n: library for n in chosen}, list(dict.fromkeys(map(tuple, interactions))))


def ordered_expanded_feature_names(spec: FeatureExpansionSpec) -> list[str]:
    made = [t.column_name(b) for b in spec.base_features for t in spec.transforms.get(b, [])]
    return unique([*spec.base_features, *spec.categorical_flags, *made, *(f"{a}*{b}" for a, b in spec.interactions)])


def apply_feature_expansion(df: DataFrame, spec: FeatureExpansionSpec, *, keys: list[str] = (), warn: bool = True) -> FeatureExpansionResult:
    """One projection: keys, then all columns of the spec; interactions multiply the raw columns."""
    needed = unique([*spec.base_features, *spec.categorical_flags, *spec.transforms, *(n for p in spec.interactions for n in p)])
    if lost := [n for n in needed if n not in df.columns]:
        raise KeyError(f"missing source columns {lost}")
    columns: dict[str, Column] = {n: c(n) for n in [*spec.base_features, *spec.categorical_flags]}
    for b in spec.base_features:
        for t in spec.transforms.get(b, []):
            columns.setdefault(t.column_name(b), t.apply(c(b)))
    for a, b in spec.interactions:
        columns.setdefault(f"{a}*{b}", c(a).cast("double") * c(b).cast("double"))
    if warn:
        report: dict[str, list[str]] = {}
        for t in {t.label: t for ts in spec.transforms.values() for t in ts}.values():
            report |= nan_report(df, [b for b in spec.base_features if t in spec.transforms.get(b, [])], [t])
        warn_nan_transforms(report)
    names = ordered_expanded_feature_names(spec)
    return FeatureExpansionResult(df.select(*map(c, keys), *(columns[n].alias(n) for n in names)), names)


# ---- categorical design


@dataclass(frozen=True)
class CategoricalInputDecl:
    name: str
    levels: list[str] | None = None


@dataclass(frozen=True)
class DesignMatrixSpec:
    categorical_inputs: list[CategoricalInputDecl] = field(default_factory=list)
    interaction_pairs: list[tuple[str, str]] = field(default_factory=list)
    drop_first: bool = True

    def __post_init__(self) -> None:
        names = [d.name for d in self.categorical_inputs]
        if len(set(names)) != len(names):
            raise ValueError("categorical inputs must be declared once")
        for cat, scalar in self.interaction_pairs:
            if cat not in names:
                raise ValueError(f"interaction with undeclared categorical input {cat!r}")
            if scalar in names:
                raise ValueError(f"{scalar!r} is categorical and can't be the scalar of an interaction")


@dataclass(frozen=True)
class DesignMatrixResult:
    matrix: DataFrame
    ordered_columns: tuple[str, ...]
    categorical_columns: tuple[str, ...]
    interaction_columns: tuple[str, ...]


def resolve_spec_levels(df: DataFrame, spec: DesignMatrixSpec) -> DesignMatrixSpec:
    """Levels that aren't declared become the table's distinct values, sorted."""
    done = []
    for d in spec.categorical_inputs:
        if d.levels is None:
            found = df.select(c(d.name).cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(MOST_LEVELS + 1).collect()
            if len(found) > MOST_LEVELS:
                raise ValueError(f"{d.name!r} has more than {MOST_LEVELS} levels; each would be a column")
            d = CategoricalInputDecl(d.name, sorted(r.v for r in found))
        done.append(d)
    return DesignMatrixSpec(done, list(spec.interaction_pairs), spec.drop_first)


def _kept_levels(d: CategoricalInputDecl, drop_first: bool) -> list[str]:
    return d.levels[1:] if drop_first and len(d.levels) > 1 else list(d.levels)


def build_design_matrix(df: DataFrame, spec: DesignMatrixSpec, *, keys: list[str] = ()) -> DesignMatrixResult:
    """Scalars, indicators ``name__level`` and products ``name__level_x_scalar``, in one projection.

    Null and unknown levels are errors (one aggregation over all inputs).  One
    level alone keeps its constant column.
    """
    cats = [d.name for d in spec.categorical_inputs]
    scalars = [n for n in df.columns if n not in cats and n not in keys]
    if not cats:
        return DesignMatrixResult(df, tuple(scalars), (), ())
    if lost := [n for n in [*cats, *(s for _, s in spec.interaction_pairs)] if n not in df.columns]:
        raise KeyError(f"missing columns {lost}")
    spec = resolve_spec_levels(df, spec)
    for d in spec.categorical_inputs:
        if not d.levels or len(set(d.levels)) != len(d.levels):
            raise ValueError(f"levels of {d.name!r} must be present and unique")
    odd = df.agg(*(F.count_if(~F.coalesce(c(d.name).cast("string").isin(d.levels), F.lit(False))).alias(f"n{i}") for i, d in enumerate(spec.categorical_inputs))).first()
    if bad := [d.name for d, n in zip(spec.categorical_inputs, odd, strict=True) if n]:
        raise ValueError(f"null or unknown levels in {bad}")
    flags = {d.name: {v: (c(d.name).cast("string") == v).cast("byte") for v in _kept_levels(d, spec.drop_first)} for d in spec.categorical_inputs}
    marks = {f"{n}__{v}": col for n, by in flags.items() for v, col in by.items()}
    products = {f"{cat}__{v}_x_{s}": col.cast("double") * c(s).cast("double") for cat, s in spec.interaction_pairs for v, col in flags[cat].items()}
    names = [*scalars, *marks, *products]
    if len(set(names)) != len(names):
        raise ValueError("the design matrix would have repeated columns")
    matrix = df.select(*map(c, keys), *map(c, scalars), *(v.alias(n) for n, v in (marks | products).items()))
    return DesignMatrixResult(matrix, tuple(names), tuple(marks), tuple(products))


# ---- names


def _bare(name: Column) -> Column:
    inner = F.trim(name)
    return F.when(inner.startswith("[") & inner.endswith("]") & (F.length(inner) > 1), F.trim(F.substring(inner, F.lit(2), F.length(inner) - 2))).otherwise(inner)


def name_structure(names: DataFrame, column: str = "feature_name", known: Iterable[str] | None = None) -> DataFrame:
    """input_type, term_1, term_2, transformation of each name; a star is looked for before a suffix."""
    raw, bare = c(column), _bare(c(column))
    pair = F.split(bare, r"\*", 2)
    # longer suffixes first, so that sqrt isn't read as a shorter one
    suffix = F.regexp_extract(bare, f"_({'|'.join(sorted(known or KNOWN_TRANSFORMATIONS, key=lambda s: (-len(s), s)))})$", 1)
    second, bent = F.contains(bare, F.lit("*")), suffix != ""
    base = F.trim(F.substring(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1))
    return names.select(
        raw.alias("feature_name"),
        F.when(second, "second_order").when(bent, "nonlinear_transformation").otherwise("first_order").alias("input_type"),
        F.when(second, F.trim(F.get(pair, F.lit(0)))).when(bent, base).otherwise(bare).alias("term_1"),
        F.when(second, F.trim(F.get(pair, F.lit(1)))).alias("term_2"),
        F.when(~second & bent, suffix).alias("transformation"),
    )


def parse_selected_input_structure(spark: SparkSession, feature_names: Iterable[str], known_transformations: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structure of the names, counts by type, counts by transformation; no names give empty tables."""
    rows = [(i, str(n)) for i, n in enumerate(feature_names)]
    names = spark.createDataFrame(rows, "original_position int, feature_name string").orderBy("original_position")
    table = name_structure(names, known=known_transformations)
    types = table.groupBy("input_type").count().orderBy(F.desc("count"), "input_type")
    bent = table.filter("transformation IS NOT NULL").groupBy("transformation").count().orderBy(F.desc("count"), "transformation")
    return table, types, bent


def canonical_module_from_factor_name(name: Column | str) -> Column | str:
    """What stands before the first dot, or Unscoped; of a string or a column."""
    if isinstance(name, str):
        return name.split(".", 1)[0].strip() or "Unscoped" if "." in name else "Unscoped"
    head = F.trim(F.substring_index(name, ".", 1))
    return F.when(F.contains(name, F.lit(".")) & (head != ""), head).otherwise("Unscoped")
