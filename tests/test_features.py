"""Transforms, expansion, design matrices, names, sampling, provenance."""

from __future__ import annotations

import warnings

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lumenfit.functions import transforms as t
from lumenfit.operators import features, split
from lumenfit.sources import artifacts, release


def test_expansion(spark):
    d = spark.createDataFrame([(0, 2.0, 4.0, 0, 1), (1, 3.0, 5.0, 1, 0)], "id long, x1 double, x2 double, cat_a int, cat_b int")
    spec = features.FeatureExpansionSpec(["x1", "x2"], ["cat_a"], {"x1": [t.QUADRATIC], "x2": [t.INVERSE]}, [("x1", "cat_a"), ("x1", "x2")])
    r = features.apply_feature_expansion(d, spec, keys=["id"])
    assert r.ordered_columns == ["x1", "x2", "cat_a", "x1_sq", "x2_inv", "x1*cat_a", "x1*x2"]
    assert [tuple(x[4:]) for x in r.expanded_frame.orderBy("id").collect()] == [(4.0, 0.25, 0.0, 8.0), (9.0, 0.2, 3.0, 15.0)]
    with pytest.raises(KeyError):
        features.apply_feature_expansion(d, features.FeatureExpansionSpec(["nope"]))
    with pytest.raises(ValueError):
        features.default_feature_expansion_spec(["a"], transform_features=["b"])


def test_inverse_of_zero_warns(spark):
    d = spark.createDataFrame([(0.0,)], "x1 double")
    with pytest.warns(UserWarning, match="inv"):
        r = features.apply_feature_expansion(d, features.FeatureExpansionSpec(["x1"], [], {"x1": [t.INVERSE]}))
    assert r.expanded_frame.first()["x1_inv"] is None


def test_transforms(spark):
    d = spark.createDataFrame([(-1.0,), (0.0,), (4.0,), (1000.0,)], "x double")
    got = lambda tr: [r[0] for r in d.select(tr.apply(d.x)).collect()]
    assert got(t.SQRT)[:3] == [None, 0.0, 2.0] and got(t.EXPONENTIAL)[3] is None and got(t.LOGARITHMIC)[0] is None
    assert t.SQRT.valid_fraction(d, "x") == 0.75 and t.SQRT.valid_fraction(d.limit(0), "x") == 0.0
    assert t.TransformDef.from_config(t.SQRT.to_config()) == t.SQRT
    for bad in ("__import__('os')", "y + 1", "x if x else 1", "open(x)", "x.real", "'a'", "True"):
        with pytest.raises(ValueError):
            t.expression(bad, d.x)
    with pytest.raises(ValueError):
        t.TransformDef("x", "no good")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        t.warn_nan_transforms({})


def test_design_matrix(spark):
    d = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "v double, g string")
    spec = features.DesignMatrixSpec([features.CategoricalInputDecl("g")], [("g", "v")], drop_first=False)
    r = features.build_design_matrix(d, spec)
    assert r.ordered_columns == ("v", "g__a", "g__b", "g__a_x_v", "g__b_x_v")
    assert sorted(map(tuple, r.matrix.collect())) == [(1.0, 1, 0, 1.0, 0.0), (2.0, 0, 1, 0.0, 2.0)]
    assert features.build_design_matrix(d, features.DesignMatrixSpec()).matrix is d
    with pytest.raises(ValueError):
        features.build_design_matrix(spark.createDataFrame([(1.0, None)], "v double, g string"), features.DesignMatrixSpec([features.CategoricalInputDecl("g", ["a"])]))
    with pytest.raises(ValueError):
        features.DesignMatrixSpec([], [("g", "v")])


def test_names(spark):
    table, types, bent = features.parse_selected_input_structure(spark, ["a.b", "[a * b_sq]", "c_log1p", "d_exp"])
    assert [r.input_type for r in table.collect()] == ["first_order", "second_order", "nonlinear_transformation", "first_order"]
    assert bent.collect()[0].transformation == "log1p" and types.count() == 3
    assert features.parse_selected_input_structure(spark, [])[1].count() == 0
    assert [features.canonical_module_from_factor_name(n) for n in ("Mod.f", " .x", "plain")] == ["Mod", "Unscoped", "Unscoped"]


def test_subset_and_split(spark):
    d = spark.createDataFrame([(i, i % 2, (i // 2) % 2, float(i)) for i in range(800)], "id long, a int, b int, x double")
    one, two = (sorted(r.id for r in split.stratified_subset_by_combination(x, columns=["a", "b"], keys=["id"], n_per_combination=25).collect()) for x in (d, d.repartition(7)))
    assert one == two and len(one) == 100
    with pytest.raises(ValueError):
        split.stratified_subset_by_combination(d, columns=["a", "b"], keys=["id"], n_per_combination=201)
    assert split.stratified_subset_by_combination(d, columns=["a"], keys=["id"], n_per_combination=500, require_all_combinations=False).count() == 0
    x, y = d.drop("x").filter("id < 20"), d.select("id", "x").filter("id < 20")
    tr, ho, _, yh = split.stratified_holdout_split(x, y, keys=["id"], holdout_fraction=0.2, stratify_columns=["a", "b"])
    assert (tr.count(), ho.count(), yh.count()) == (16, 4, 4) and ho.select("a", "b").distinct().count() == 4
    folds = [r["count"] for r in split.fold_ids(d.limit(23), ["id"], 5).groupBy("fold").count().collect()]
    assert sorted(folds) == [4, 4, 5, 5, 5]


@given(st.dictionaries(st.tuples(st.text(max_size=3)), st.integers(1, 500), min_size=1, max_size=8), st.floats(0.01, 0.9))
def test_quotas(sizes, share):
    got = split.quotas(sizes, share)
    assert sum(got.values()) == int(sum(sizes.values()) * share + 0.5) or abs(sum(got.values()) - sum(sizes.values()) * share) <= 1
    assert all(abs(got[k] - sizes[k] * share) <= 1 for k in sizes)


def test_provenance(spark, tmp_path):
    stamp = artifacts.freeze_config({"a": 1})
    artifacts.require_frozen_stamp({"a": 1}, stamp)
    with pytest.raises(artifacts.ConfigDriftError):
        artifacts.require_frozen_stamp({"a": 2}, stamp)
    with pytest.raises(artifacts.FrozenConfigRequiredError):
        artifacts.require_frozen_stamp({}, None)
    assert len(artifacts.canonical_manifest_top_level_keys()) == 17 and len(artifacts.canonical_bundle_loader_keys()) == 8
    f = tmp_path / "a.txt"
    f.write_text("one")
    m = release.ReleaseManifest.from_json(release.build_manifest([f], "env", tmp_path).to_json())
    assert release.verify_manifest(m, tmp_path).ok
    f.write_text("two")
    assert release.verify_manifest(m, tmp_path).tampered == ["a.txt"]
    out = tmp_path / "m.json"
    assert release.main(["build", str(out), str(tmp_path), str(f)]) == 0 and release.main(["verify", str(out), str(tmp_path)]) == 0
    f.unlink()
    assert release.main(["verify", str(out), str(tmp_path)]) == 1 and release.main(["verify", str(tmp_path / "no"), str(tmp_path)]) == 2
    with pytest.raises(FileNotFoundError):
        release.build_manifest([f], "", tmp_path)
