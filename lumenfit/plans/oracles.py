"""DuckDB SQL for the queries, with the same column names."""

from __future__ import annotations

MODEL = """m AS (
  SELECT o_orderkey, o_orderpriority, o_orderstatus, sum(l_quantity) AS qty, avg(l_discount) AS disc, sum(l_extendedprice) AS price, sum(l_extendedprice * (1 - l_discount)) AS net
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def quota(name: str, source: str, share: str) -> str:
    """Rows of each stratum s (n rows) for a share: largest remainders."""
    return f"""{name}_e AS (SELECT s, n, n * ({share}) AS e FROM {source}),
{name} AS (SELECT s, floor(e)::BIGINT + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, s) <= (SELECT floor(sum(n) * ({share}) + 0.5::DOUBLE) - sum(floor(e)) FROM {name}_e) THEN 1 ELSE 0 END AS k FROM {name}_e)"""


PARTS = f"""{MODEL},
sizes AS (SELECT o_orderpriority AS s, count(*) AS n FROM m GROUP BY 1),
{quota("qt", "sizes", "0.15::DOUBLE")},
rest AS (SELECT s, n - k AS n FROM sizes JOIN qt USING (s)),
{quota("qv", "rest", "0.15::DOUBLE / (1 - 0.15::DOUBLE)")},
p AS (
  SELECT m.*, CASE WHEN place <= qt.k THEN 'test' WHEN place <= qt.k + qv.k THEN 'val' ELSE 'train' END AS partition
  FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS place FROM m) AS m
  JOIN qt ON qt.s = o_orderpriority JOIN qv ON qv.s = o_orderpriority)"""

# the outputs of the metric queries: truth, guess and range by output
CELLS = """cells AS (
  SELECT o_orderkey, o_orderpriority, o_orderstatus, 'price' AS output_name, 0 AS pos, price AS y, qty * 1530.0::DOUBLE AS p, qty * 1500.0::DOUBLE AS p2 FROM m
  UNION ALL SELECT o_orderkey, o_orderpriority, o_orderstatus, 'net', 1, net, qty * 1460.0::DOUBLE, qty * 1500.0::DOUBLE FROM m
  UNION ALL SELECT o_orderkey, o_orderpriority, o_orderstatus, 'flat', 2, 1.0, 1.5, 1.5 FROM m),
ref AS (SELECT output_name, pos, min(y) AS lo, max(y) AS hi, max(y) - min(y) AS r, var_pop(y) AS v FROM cells GROUP BY ALL),
errs AS (SELECT output_name, pos, sqrt(avg((y - p) * (y - p))) AS rmse, count(*) AS n FROM cells GROUP BY ALL),
per AS (SELECT output_name, pos, rmse, r, r >= 1e-6 AS used, CASE WHEN r >= 1e-6 THEN rmse / r END AS nrmse FROM errs JOIN ref USING (output_name, pos))"""


def ols2(source: str, where: str = "") -> str:
    """Closed form of two-feature least squares of each output."""
    one = lambda y, i: f"SELECT '{y}' AS output_name, {i} AS pos, avg(qty) AS mq, avg(disc) AS md, avg({y}) AS my, var_pop(qty) AS a, covar_pop(qty, disc) AS b, var_pop(disc) AS d, covar_pop(qty, {y}) AS u, covar_pop(disc, {y}) AS w, stddev_pop({y}) AS sy, min({y}) AS lo, max({y}) AS hi FROM {source} {where}"
    return f"""cov AS ({one("price", 0)} UNION ALL {one("net", 1)}),
fit AS (SELECT *, (d * u - b * w) / (a * d - b * b) AS b1, (a * w - b * u) / (a * d - b * b) AS b2 FROM cov)"""


#: The row (0-based) that replicate rep draws; 1000 replicates of as many rows as there are.
DRAWN = "('0x' || substr(md5('123|' || rep || '|' || draw), 1, 8))::BIGINT % size"


def replicates(columns: str, stratum: str | None = None) -> str:
    """e2, b2 (macro nRMSE of both guesses) of each replicate; rows are counted in the order of their digest."""
    by = f"PARTITION BY {stratum}" if stratum else ""
    s = stratum or "'all'"
    return f"""idx AS (SELECT o_orderkey, {s} AS s, row_number() OVER ({by} ORDER BY md5('0|' || o_orderkey), o_orderkey) - 1 AS row FROM m),
str AS (SELECT s, size, coalesce(sum(size) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM (SELECT s, count(*) AS size FROM idx GROUP BY s)),
dr AS (SELECT rep, s, {DRAWN} AS row FROM (SELECT rep, s, size, unnest(range(first, first + size)) AS draw FROM str, range(1000) AS t(rep))),
sq AS (SELECT o_orderkey, output_name, (y - p) * (y - p) AS e2, (y - p2) * (y - p2) AS b2, r FROM cells JOIN ref USING (output_name, pos) WHERE r >= 1e-6),
byo AS (SELECT rep, output_name, max(r) AS r, avg(e2) AS e2, avg(b2) AS b2 FROM sq JOIN idx USING (o_orderkey) JOIN dr USING (s, row) GROUP BY ALL),
rv AS (SELECT rep, avg(sqrt(e2) / r) AS e2, avg(sqrt(b2) / r) AS b2 FROM byo GROUP BY rep),
pt AS (SELECT avg(a / r) AS e2, avg(b / r) AS b2 FROM (SELECT sqrt(avg(e2)) AS a, sqrt(avg(b2)) AS b, max(r) AS r FROM sq GROUP BY output_name))
SELECT {columns}"""


def interval(value: str, point: str) -> str:
    return f"""round((SELECT {point} FROM pt), 8) AS point_estimate, round(quantile_cont({value}, 0.025), 8) AS ci_lower, round(quantile_cont({value}, 0.975), 8) AS ci_upper,
  round(avg({value}), 8) AS bootstrap_mean, round(stddev_samp({value}), 8) AS bootstrap_std FROM rv"""


FIN = "isfinite({0})"
NAMES = """names AS (SELECT DISTINCT unnest([p_type, p_type || '_sqrt', p_type || '_log1p', p_type || '_exp', '[' || p_type || ' * ' || p_brand || ']']) AS feature_name FROM part),
bare AS (SELECT feature_name, CASE WHEN feature_name LIKE '[%]' THEN trim(substr(feature_name, 2, length(feature_name) - 2)) ELSE trim(feature_name) END AS b FROM names),
told AS (SELECT feature_name, b, contains(b, '*') AS star, regexp_extract(b, '_(logarithmic|reciprocal|quadratic|inverse|square|cubic|log1p|cube|sqrt|abs|inv|log|sq)$', 1) AS suffix FROM bare),
st AS (SELECT feature_name, CASE WHEN star THEN 'second_order' WHEN suffix <> '' THEN 'nonlinear_transformation' ELSE 'first_order' END AS input_type,
  CASE WHEN star THEN trim(split_part(b, '*', 1)) WHEN suffix <> '' THEN trim(substr(b, 1, length(b) - length(suffix) - 1)) ELSE b END AS term_1,
  CASE WHEN star THEN trim(split_part(b, '*', 2)) END AS term_2, CASE WHEN NOT star AND suffix <> '' THEN suffix END AS transformation FROM told)"""

SUMMARY = """count(*) FILTER (used) AS n_outputs_used, count(*) AS n_outputs_total, round(avg(nrmse), 6) AS macro_nrmse, round(quantile_cont(nrmse, 0.5), 6) AS median_nrmse,
  round(quantile_cont(nrmse, 0.95), 6) AS tail_95, round(quantile_cont(nrmse, 0.99), 6) AS tail_99, arg_max(output_name, nrmse) AS worst_output, round(max(nrmse), 6) AS worst_nrmse, max(n) AS n_rows"""


def stratum_rows(key: str) -> str:
    value, label = (f"{key}", f"'included_outputs_all_rows|{key}=' || {key}") if key else ("''", "'included_outputs_all_rows'")
    return f"""SELECT '{key}' AS stratum_key, {value} AS stratum_value, {label} AS metric_population, {SUMMARY} FROM (
  SELECT {(key + ",") if key else ""} output_name, pos, sqrt(avg((y - p) * (y - p))) AS rmse, count(*) AS n, any_value(r) AS r, any_value(r) >= 1e-6 AS used, CASE WHEN any_value(r) >= 1e-6 THEN sqrt(avg((y - p) * (y - p))) / any_value(r) END AS nrmse
  FROM cells JOIN ref USING (output_name, pos) GROUP BY ALL) AS x {("GROUP BY " + key) if key else ""}"""


ORACLES = {
    "repeated_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "missing_keys": "SELECT DISTINCT o_orderkey, 'x' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'y' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "align_xy": f"WITH {MODEL} SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, round(price, 4) AS price FROM orders JOIN m USING (o_orderkey)",
    "numeric_check": f"WITH {MODEL} SELECT count(*) AS n_rows, count(*) FILTER (qty IS NULL OR disc IS NULL OR price IS NULL OR net IS NULL OR NOT (isfinite(qty) AND isfinite(disc) AND isfinite(price) AND isfinite(net))) AS n_bad FROM m",
    "combination_labels": "SELECT 'o_orderpriority=' || o_orderpriority || '|o_orderstatus=' || o_orderstatus AS combination, count(*) AS n FROM orders GROUP BY 1",
    "stratified_subset": "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('123|' || o_orderkey), o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS size FROM orders) WHERE place <= 20 AND size >= 20",
    "sealed_split": f"WITH {PARTS} SELECT o_orderkey, o_orderpriority, partition FROM p",
    "sealed_split_balance": f"WITH {PARTS} SELECT o_orderpriority AS stratum, count(*) FILTER (partition = 'train') AS train, count(*) FILTER (partition = 'val') AS val, count(*) FILTER (partition = 'test') AS test FROM p GROUP BY 1",
    "holdout_split": f"""WITH {MODEL}, sizes AS (SELECT o_orderstatus AS s, count(*) AS n FROM m GROUP BY 1), {quota("q", "sizes", "0.05::DOUBLE")}
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('123|' || o_orderkey), o_orderkey) AS place FROM m) JOIN q ON s = o_orderstatus WHERE place <= k""",
    "fold_ids": "SELECT o_orderkey, ((row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) - 1) * 5 // count(*) OVER ())::INT AS fold FROM orders",
    "feature_expansion": """SELECT p_partkey, round(s, 6) AS size, round(p, 6) AS price, round(s * s, 6) AS size_sq, round(CASE WHEN s > -1 THEN ln(s + 1) END, 6) AS size_log1p, round(CASE WHEN s <> 0 THEN 1 / s END, 6) AS size_inv, round(CASE WHEN s >= 0 THEN sqrt(s) END, 6) AS size_sqrt,
  round(p * p, 6) AS price_sq, round(CASE WHEN p > -1 THEN ln(p + 1) END, 6) AS price_log1p, round(CASE WHEN p <> 0 THEN 1 / p END, 6) AS price_inv, round(CASE WHEN p >= 0 THEN sqrt(p) END, 6) AS price_sqrt, round(s * p, 6) AS size_x_price FROM (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS p FROM part)""",
    "transform_validity": "SELECT 1.0::DOUBLE AS sq, round(avg((c_acctbal > -1)::INT), 6) AS log1p, round(avg((c_acctbal <> 0)::INT), 6) AS inv, round(avg((c_acctbal >= 0)::INT), 6) AS sqrt FROM customer",
    "custom_transform": "SELECT p_partkey, round(pow(p_size - 1, 3) / (1 + abs(p_size)), 6) AS own FROM part",
    "design_matrix": "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, (o_orderstatus = 'O')::INT AS o_orderstatus__O, (o_orderstatus = 'P')::INT AS o_orderstatus__P, round((o_orderstatus = 'O')::INT * o_totalprice, 4) AS o_orderstatus__O_x_o_totalprice, round((o_orderstatus = 'P')::INT * o_totalprice, 4) AS o_orderstatus__P_x_o_totalprice FROM orders",
    "resolve_levels": "SELECT 'o_orderpriority' AS name, (row_number() OVER (ORDER BY v) - 1)::INT AS position, v AS level FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) UNION ALL SELECT 'o_orderstatus', (row_number() OVER (ORDER BY v) - 1)::INT, v FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)",
    "name_structure": f"WITH {NAMES} SELECT * FROM st",
    "name_type_counts": f"WITH {NAMES} SELECT input_type, count(*) AS n FROM st GROUP BY 1",
    "module_prefix": "SELECT page_id, CASE WHEN contains(url, '.') AND trim(split_part(url, '.', 1)) <> '' THEN trim(split_part(url, '.', 1)) ELSE 'Unscoped' END AS module FROM pages",
    "standardizers": f"WITH {MODEL} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {i}::INT AS original_position, round(avg({n}), 4) AS mean, round(stddev_pop({n}), 4) AS scale FROM m" for i, n in enumerate(("qty", "disc", "price", "net"))),
    "standardized_rows": f"WITH {MODEL}, t AS (SELECT " + ", ".join(f"avg({n}) AS a_{n}, stddev_pop({n}) AS s_{n}" for n in ("qty", "disc", "price", "net")) + " FROM m) SELECT o_orderkey, " + ", ".join(f"round(({n} - a_{n}) / s_{n}, 6) AS {n}" for n in ("qty", "disc", "price", "net")) + " FROM m, t",
    "final_ols": f"WITH {MODEL}, {ols2('m')} SELECT output_name, round(b1, 4) AS qty, round(b2, 4) AS disc, round(my - b1 * mq - b2 * md, 4) AS intercept FROM fit",
    "coefficient_frame": f"WITH {MODEL}, {ols2('m')} SELECT output_name, round(b1, 4) AS qty, round(b2, 4) AS disc FROM fit",
    "final_ols_standardized": f"WITH {MODEL}, {ols2('m')} SELECT output_name, round(b1 * sqrt(a) / sy, 4) AS qty, round(b2 * sqrt(d) / sy, 4) AS disc FROM fit",
    "predict_ols": f"WITH {MODEL}, {ols2('m')}, f AS (SELECT output_name, b1, b2, my - b1 * mq - b2 * md AS b0 FROM fit) SELECT o_orderkey, round(x.b0 + x.b1 * qty + x.b2 * disc, 2) AS price, round(y.b0 + y.b1 * qty + y.b2 * disc, 2) AS net FROM m, f AS x, f AS y WHERE x.output_name = 'price' AND y.output_name = 'net'",
    "per_stratum_fit": f"WITH {MODEL}, f AS (SELECT o_orderpriority, covar_pop(qty, price) * count(*) / (var_pop(qty) * count(*) + 1e-6) AS b, avg(qty) AS mq, avg(price) AS mp FROM m GROUP BY 1) SELECT o_orderkey, round(mp + b * (qty - mq), 2) AS price FROM m JOIN f USING (o_orderpriority)",
    "ridge_fit": f"WITH {MODEL}, {ols2('m')}, n AS (SELECT count(*) AS n FROM m) SELECT output_name, round(u * n / (a * n + 100), 4) AS qty, round(my - mq * u * n / (a * n + 100), 4) AS intercept FROM fit, n",
    "coef_importance": f"WITH {MODEL}, {ols2('m')} SELECT 'qty' AS feature_name, round(avg(abs(b1 * sqrt(a) / sy)), 6) AS magnitude FROM fit UNION ALL SELECT 'disc', round(avg(abs(b2 * sqrt(d) / sy)), 6) FROM fit",
    "null_mean_prediction": f"WITH {PARTS}, t AS (SELECT avg(price) AS a, avg(net) AS b FROM p WHERE partition = 'train') SELECT o_orderkey, round(a, 4) AS price, round(b, 4) AS net FROM p, t WHERE partition = 'test'",
    "per_output_nrmse": f"WITH {MODEL}, {CELLS} SELECT output_name, round(rmse, 5) AS rmse, round(r, 5) AS ref_range, round(nrmse, 5) AS nrmse, used AS included_in_macro FROM per",
    "macro_nrmse": f"WITH {MODEL}, {CELLS} SELECT round(avg(nrmse), 6) AS macro_nrmse, count(*) FILTER (used) AS k_used, count(*) AS k_total FROM per",
    "eligibility_ledger": f"WITH {MODEL}, {CELLS} SELECT output_name AS output_id, round(lo, 2) AS ref_min, round(hi, 2) AS ref_max, round(r, 2) AS ref_range, round(v, 2) AS ref_variance, r >= 1e-6 AND v > 0 AS passes, concat_ws(';', CASE WHEN NOT r >= 1e-6 THEN 'range_below_threshold' END, CASE WHEN NOT v > 0 THEN 'zero_variance' END) AS exclusion_reason FROM ref",
    "macro_from_ledger": f"WITH {MODEL}, {CELLS} SELECT round(avg(rmse / r), 6) AS macro_nrmse, count(*) AS k_used FROM per WHERE used",
    "stratified_nrmse": f"WITH {MODEL}, {CELLS} {stratum_rows('')} UNION ALL BY NAME {stratum_rows('o_orderpriority')} UNION ALL BY NAME {stratum_rows('o_orderstatus')}",
    "excluded_outputs": f"WITH {MODEL}, {CELLS} SELECT output_name, round(rmse, 4) AS rmse, used AS included, round(CASE WHEN output_name = 'flat' THEN rmse / 2 END, 4) AS scaled_rmse FROM per",
    "excluded_output_totals": f"WITH {MODEL}, {CELLS} SELECT count(*) AS n_excluded, round(avg(rmse), 6) AS mean_rmse_excluded, round(quantile_cont(rmse, 0.5), 6) AS median_rmse_excluded FROM per WHERE NOT used",
    "holdout_nrmse": f"""WITH {PARTS}, {ols2("p", "WHERE partition = 'train'")}, t AS (SELECT o_orderkey, 'price' AS output_name, qty, disc, price AS y FROM p WHERE partition = 'test' UNION ALL SELECT o_orderkey, 'net', qty, disc, net FROM p WHERE partition = 'test'),
e AS (SELECT output_name, sqrt(avg(pow(y - (my + b1 * (qty - mq) + b2 * (disc - md)), 2))) AS rmse, any_value(hi - lo) AS r FROM t JOIN fit USING (output_name) GROUP BY 1)
SELECT output_name, round(rmse, 5) AS rmse, round(r, 5) AS ref_range, round(rmse / r, 5) AS nrmse, r >= 1e-6 AS included_in_macro FROM e""",
    "bootstrap_replicates": f"WITH {MODEL}, {CELLS}, {replicates('rep, round(e2, 8) AS macro_nrmse FROM rv')}",
    "bootstrap_ci": f"WITH {MODEL}, {CELLS}, {replicates(interval('e2', 'e2'))}",
    "stratified_bootstrap": f"WITH {MODEL}, {CELLS}, {replicates(interval('e2', 'e2'), 'o_orderpriority')}",
    "paired_bootstrap": f"WITH {MODEL}, {CELLS}, {replicates(interval('e2 - b2', 'e2 - b2'))}",
    # errors after refits on both features, on one of them, or none
    "support_thresholds": f"""WITH {PARTS}, {ols2("p", "WHERE partition = 'train'")},
imp AS (SELECT avg(abs(b1 * sqrt(a) / sy)) AS iq, avg(abs(b2 * sqrt(d) / sy)) AS id FROM fit),
v AS (SELECT 'price' AS output_name, qty, disc, price AS y FROM p WHERE partition = 'val' UNION ALL SELECT 'net', qty, disc, net FROM p WHERE partition = 'val'),
sc AS (SELECT sqrt(avg(pow(y - (my + b1 * (qty - mq) + b2 * (disc - md)), 2))) AS two, sqrt(avg(pow(y - (my + u / a * (qty - mq)), 2))) AS q, sqrt(avg(pow(y - (my + w / d * (disc - md)), 2))) AS e FROM v JOIN fit USING (output_name))
SELECT t AS threshold, (iq > t)::INT + (id > t)::INT AS n_selected, round(CASE WHEN iq > t AND id > t THEN two WHEN iq > t THEN q WHEN id > t THEN e ELSE 'inf'::DOUBLE END, 4) AS val_score
FROM (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE)) AS th(t), imp, sc""",
    # one component: the leading direction of the 2 x 2 correlations' products
    "pls_fit": f"""WITH {MODEL}, {ols2('m')}, k AS (SELECT *, u / (sqrt(a) * sy) AS c1, w / (sqrt(d) * sy) AS c2, b / sqrt(a * d) AS rho FROM fit),
mm AS (SELECT sum(c1 * c1) AS m11, sum(c1 * c2) AS m12, sum(c2 * c2) AS m22 FROM k),
dir AS (SELECT m12 AS v1, (m11 + m22 + sqrt(pow(m11 - m22, 2) + 4 * m12 * m12)) / 2 - m11 AS v2 FROM mm),
un AS (SELECT v1 / sqrt(v1 * v1 + v2 * v2) AS w1, v2 / sqrt(v1 * v1 + v2 * v2) AS w2 FROM dir),
g AS (SELECT *, (w1 * c1 + w2 * c2) / (1 + 2 * rho * w1 * w2) * sy AS s FROM k, un)
SELECT output_name, round(w1 * s / sqrt(a), 4) AS qty, round(w2 * s / sqrt(d), 4) AS disc, round(my - w1 * s / sqrt(a) * mq - w2 * s / sqrt(d) * md, 4) AS intercept FROM g""",
    # the screen keeps both features
    "canonical_workflow": f"""WITH {PARTS}, {ols2("p", "WHERE partition = 'train'")},
idx AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('0|' || o_orderkey), o_orderkey) - 1 AS row FROM p WHERE partition = 'test'),
t AS (SELECT o_orderkey, 'price' AS output_name, qty, disc, price AS y FROM p WHERE partition = 'test' UNION ALL SELECT o_orderkey, 'net', qty, disc, net FROM p WHERE partition = 'test'),
sq AS (SELECT row, output_name, pow(y - (my + b1 * (qty - mq) + b2 * (disc - md)), 2) AS e2, hi - lo AS r FROM t JOIN fit USING (output_name) JOIN idx USING (o_orderkey)),
n AS (SELECT count(*) AS size FROM idx),
dr AS (SELECT rep, {DRAWN} AS row FROM (SELECT rep, size, unnest(range(size)) AS draw FROM n, range(1000) AS x(rep))),
byo AS (SELECT rep, output_name, max(r) AS r, avg(e2) AS e2 FROM sq JOIN dr USING (row) GROUP BY ALL),
rv AS (SELECT avg(sqrt(e2) / r) AS v FROM byo GROUP BY rep),
pt AS (SELECT avg(rm / r) AS v FROM (SELECT sqrt(avg(e2)) AS rm, max(r) AS r FROM sq GROUP BY output_name))
SELECT round((SELECT v FROM pt), 6) AS point_estimate, round(quantile_cont(v, 0.025), 6) AS ci_lower, round(quantile_cont(v, 0.975), 6) AS ci_upper, 2::BIGINT AS k_used, (SELECT size FROM n) AS holdout_rows, 2::BIGINT AS n_features FROM rv""",
    "standardization_frame": f"WITH {MODEL} SELECT 'price' AS output_name, 0 AS original_position, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS scale FROM m UNION ALL SELECT 'net', 1, round(avg(net), 4), round(stddev_pop(net), 4) FROM m",
    "artifact_table": "SELECT * FROM (VALUES ('all_input_metadata', 0, 'metadata'), ('selected_input_metadata', 1, 'metadata'), ('output_metadata', 2, 'metadata'), ('coef_matrix_standardized', 3, 'coefficients'), ('coef_matrix_raw_scale', 4, 'coefficients'), ('x_standardization', 5, 'standardization'), ('y_standardization', 6, 'standardization'), ('nrmse_summary', 7, 'evaluation')) AS t(artifact_name, artifact_position, category)",
}
