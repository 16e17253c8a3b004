"""Spark-native reduced-form modeling over keyed DataFrames.

The public names of all modules but ``plans.queries`` can be imported from here.
"""

from lumenfit.functions.transforms import DEFAULT_TRANSFORM_LIBRARY, EXPONENTIAL, INVERSE, LOGARITHMIC, QUADRATIC, SQRT, TransformDef, warn_nan_transforms
from lumenfit.operators.baselines import BaselineProtocol, ElasticNetBaseline, GBTBaseline, OracleOLSBaseline, PerStratumFirstOrderBaseline, PLSBaseline, RidgeBaseline, compare_baselines
from lumenfit.operators.bootstrap import bootstrap_macro_nrmse_ci, bootstrap_paired_difference_ci, stratified_bootstrap_macro_nrmse_ci
from lumenfit.operators.features import (
    KNOWN_TRANSFORMATIONS,
    CategoricalInputDecl,
    DesignMatrixResult,
    DesignMatrixSpec,
    FeatureExpansionResult,
    FeatureExpansionSpec,
    apply_feature_expansion,
    build_design_matrix,
    canonical_module_from_factor_name,
    default_feature_expansion_spec,
    ordered_expanded_feature_names,
    parse_selected_input_structure,
    resolve_spec_levels,
)
from lumenfit.operators.linear import (
    FinalOLSFitResult,
    ScreeningImportanceResult,
    ScreeningSelectionResult,
    StandardizationBundle,
    SupportSelectionResult,
    compute_enriched_coef_magnitudes,
    fit_final_ols,
    fit_final_ols_with_design,
    fit_multitask_elastic_net_screen,
    fit_standardizers,
    predict_final_ols,
    predict_from_raw_records,
    screening_selection_table,
    select_support_via_refit,
    select_threshold_on_internal_validation,
)
from lumenfit.operators.metrics import (
    build_output_eligibility_ledger,
    excluded_output_error_summary,
    macro_nrmse_from_ledger,
    macro_nrmse_with_ref,
    make_null_mean_prediction,
    per_output_nrmse_frame,
    stratified_nrmse_summary,
)
from lumenfit.operators.split import SealedSplitResult, SealedTestAccessError, combination_labels, make_sealed_split, stratified_holdout_split, stratified_subset_by_combination
from lumenfit.operators.validate import align_xy, ensure_id_columns
from lumenfit.plans.workflow import CanonicalWorkflowRun, make_holdout_nrmse_summary, run_canonical_workflow
from lumenfit.sources.artifacts import (
    ConfigDriftError,
    FrozenConfigRequiredError,
    FrozenConfigStamp,
    PipelineManifest,
    PostfitArtifactSpec,
    build_position_map,
    build_postfit_artifacts,
    canonical_bundle_loader_keys,
    canonical_manifest_position_map_keys,
    canonical_manifest_top_level_keys,
    canonical_postfit_artifact_names,
    freeze_config,
    make_coefficient_matrix_frame,
    make_metadata_frame,
    make_standardization_frame,
    postfit_artifact_table,
    require_frozen_stamp,
)
from lumenfit.sources.bundle import load_postfit_bundle, predict_from_postfit_bundle, write_postfit_bundle
from lumenfit.sources.release import ArtifactEntry, DriftReport, ReleaseManifest, build_manifest, verify_manifest

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("functions", "operators", "plans", "sources", "streaming", "llm")]
