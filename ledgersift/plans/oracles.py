"""DuckDB SQL of the registered queries, written apart from the plans: other joins, other windows, no shared expressions."""

from __future__ import annotations

from ledgersift.operators.briefs import COLUMNS, ONWARD, OTHER, SENDERS, STANDOUTS
from ledgersift.operators.evaluation import POISSON
from ledgersift.operators.scoring import FEATURES, NULLABLE
from ledgersift.plans.study import COSTS, DAYS, FIXED_MODEL, HISTORIES, HOURS, PARAMS, RATIOS, SPLIT, TRADE_HOURS, TRADE_WINDOWS, VOLUMES, WINDOWS
from ledgersift.config import COST_PARAMETERS, ratio_windows, replace_cost

ORACLES: dict[str, str] = {}


def _ts(value) -> str:
    return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) for x in r) + ")" for r in rows)


def _windows(name: str, windows, hours: int) -> str:
    rows = [(f"'{w.name}'", _ts(w.feature_start), _ts(w.feature_end), _ts(w.label_start), _ts(w.label_end), _ts(ratio_windows(w, hours)[1])) for w in windows]
    return f"{name}(w, fs, fe, ls, le, ie) AS (VALUES {_values(rows)})"


_KIND = "CASE event_type WHEN 'click' THEN 'Euro' WHEN 'view' THEN 'US Dollar' WHEN 'purchase' THEN 'UK Pound' WHEN 'signup' THEN 'Yen' ELSE 'Swiss Franc' END"
_PAID = "CASE event_id % 3 WHEN 1 THEN 'Euro' WHEN 2 THEN 'US Dollar' ELSE 'Swiss Franc' END"

RAW = f"""raw AS (
  SELECT event_id AS row_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts, user_id AS account_from,
    (user_id * 7 + CAST(json_extract(props, '$.k') AS BIGINT) * 13 + 1) % (4 * (SELECT max(user_id) + 1 FROM events)) AS account_to,
    value AS amount_received, {_KIND} AS receiving_currency, value * 1.01 AS amount_paid, {_PAID} AS payment_currency,
    CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END AS is_laundering
  FROM events),
rates(c, r) AS (VALUES {_values((f"'{c}'", f"CAST({r!r} AS DOUBLE)") for c, r in PARAMS.fx_to_base.items())}),
priced AS (SELECT raw.*, amount_received * a.r AS base_received, amount_paid * b.r AS base_paid FROM raw LEFT JOIN rates a ON a.c = receiving_currency LEFT JOIN rates b ON b.c = payment_currency),
txns AS (SELECT * FROM priced WHERE account_from <> account_to AND ts >= {_ts(SPLIT.data_start)} AND ts < {_ts(SPLIT.data_end)})"""
BASE = f"{RAW},\n{_windows('win', WINDOWS, HOURS)}"
POP = "pop AS (SELECT DISTINCT w, account_to AS account FROM txns JOIN win ON ts >= fs AND ts < fe)"
LAB = """got AS (SELECT w, account_to AS account, max(is_laundering) AS m, sum(base_received) AS e FROM txns JOIN win ON ts >= ls AND ts < le GROUP BY ALL),
lab AS (SELECT pop.w, pop.account, coalesce(m, 0) AS is_mule, coalesce(e, 0.0) AS exposure FROM pop LEFT JOIN got USING (w, account))"""
LEGS = """legs AS (
  SELECT w, account_to AS account, account_from AS other, 'in' AS side, ts, base_received AS amount, ts < ie AS early FROM txns JOIN win ON ts >= fs AND ts < fe
  UNION ALL SELECT w, account_from, account_to, 'out', ts, base_paid, ts < ie FROM txns JOIN win ON ts >= fs AND ts < fe)"""
FEAT = f"""{LEGS},
agg AS (SELECT w, account,
    count(*) FILTER (side = 'in') AS in_degree, count(DISTINCT other) FILTER (side = 'in') AS unique_counterparties_in, coalesce(sum(amount) FILTER (side = 'in'), 0) AS total_inflow, coalesce(max(amount) FILTER (side = 'in'), 0) AS max_inflow,
    count(*) FILTER (side = 'out') AS out_degree, count(DISTINCT other) FILTER (side = 'out') AS unique_counterparties_out, coalesce(sum(amount) FILTER (side = 'out'), 0) AS total_outflow, coalesce(max(amount) FILTER (side = 'out'), 0) AS max_outflow,
    coalesce(sum(amount) FILTER (side = 'in' AND early), 0) AS early_in FROM legs GROUP BY ALL),
conc AS (SELECT w, account, max(s) FILTER (side = 'in') AS top_in, max(s) FILTER (side = 'out') AS top_out FROM (SELECT w, account, other, side, sum(amount) AS s FROM legs GROUP BY ALL) GROUP BY ALL),
edge AS (SELECT DISTINCT w, account_from AS src, account_to AS dst FROM txns JOIN win ON ts >= fs AND ts < fe),
rec AS (SELECT a.w, a.src AS account, avg(CASE WHEN b.src IS NULL THEN 0.0 ELSE 1.0 END) AS reciprocity FROM edge a LEFT JOIN edge b ON a.w = b.w AND a.src = b.dst AND a.dst = b.src GROUP BY ALL),
act AS (SELECT w, account, count(*) AS active_days, CAST(max(n) AS DOUBLE) / sum(n) AS burstiness FROM (SELECT w, account, date_trunc('day', ts) AS d, count(*) AS n FROM legs GROUP BY ALL) GROUP BY ALL),
hrs AS (SELECT i.w, i.account, quantile_cont((epoch_us(o.ts) - epoch_us(i.ts)) / 3600000000.0, 0.5) AS median_hours_to_outflow
  FROM (SELECT * FROM legs WHERE side = 'in' AND early) i ASOF JOIN (SELECT * FROM legs WHERE side = 'out') o ON i.w = o.w AND i.account = o.account AND i.ts < o.ts GROUP BY ALL),
feat AS (SELECT pop.w, pop.account, CAST(in_degree AS DOUBLE) AS in_degree, CAST(unique_counterparties_in AS DOUBLE) AS unique_counterparties_in, CAST(total_inflow AS DOUBLE) AS total_inflow, CAST(max_inflow AS DOUBLE) AS max_inflow,
    CASE WHEN total_inflow > 0 THEN top_in / total_inflow ELSE 0.0 END AS inflow_concentration, CAST(out_degree AS DOUBLE) AS out_degree, CAST(unique_counterparties_out AS DOUBLE) AS unique_counterparties_out, CAST(total_outflow AS DOUBLE) AS total_outflow, CAST(max_outflow AS DOUBLE) AS max_outflow,
    CASE WHEN total_outflow > 0 THEN top_out / total_outflow ELSE 0.0 END AS outflow_concentration, coalesce(reciprocity, 0.0) AS reciprocity, CAST(active_days AS DOUBLE) AS active_days, burstiness,
    CASE WHEN early_in >= {PARAMS.features.min_flow_eur} THEN total_outflow / early_in END AS pass_through_ratio, median_hours_to_outflow,
    coalesce((in_degree - out_degree) / nullif(CAST(in_degree + out_degree AS DOUBLE), 0), 0.0) AS degree_asymmetry,
    coalesce((unique_counterparties_in - unique_counterparties_out) / nullif(CAST(unique_counterparties_in + unique_counterparties_out AS DOUBLE), 0), 0.0) AS counterparty_asymmetry,
    unique_counterparties_in / nullif(CAST(in_degree AS DOUBLE), 0) AS sender_diversity,
    (total_outflow / nullif(CAST(out_degree AS DOUBLE), 0)) / nullif(total_inflow / nullif(CAST(in_degree AS DOUBLE), 0), 0) AS mean_amount_ratio
  FROM pop JOIN agg USING (w, account) JOIN conc USING (w, account) JOIN act USING (w, account) LEFT JOIN rec USING (w, account) LEFT JOIN hrs USING (w, account))"""
FULL = f"{BASE},\n{POP},\n{LAB},\n{FEAT}"
SCORED = f"""{FULL},
sc AS (SELECT w, account, least(cume_dist() OVER (PARTITION BY w ORDER BY in_degree ASC NULLS FIRST), cume_dist() OVER (PARTITION BY w ORDER BY pass_through_ratio ASC NULLS FIRST)) AS score FROM feat),
sl AS (SELECT sc.w, sc.account, sc.score, lab.is_mule, lab.exposure FROM sc JOIN lab USING (w, account))"""
QUEUE = f"""{SCORED},
days AS (SELECT DISTINCT w, account_to AS account, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM txns JOIN win ON ts >= ls AND ts < le SEMI JOIN pop ON pop.w = win.w AND pop.account = account_to),
q0 AS (SELECT days.w, account, day, score, is_mule, exposure FROM days JOIN sl USING (w, account) WHERE w <> 'train'),
dd AS (SELECT DISTINCT w, day FROM q0),
carried AS (SELECT q0.w, account, day + INTERVAL 1 DAY * o AS day, min(score) AS score, min(is_mule) AS is_mule, min(exposure) AS exposure FROM q0 CROSS JOIN range(0, 3) t(o) SEMI JOIN dd ON dd.w = q0.w AND dd.day = q0.day + INTERVAL 1 DAY * o GROUP BY ALL)"""


def _picks(source: str, ks) -> str:
    """Selection day by day for several volumes: one CTE per day."""
    parts = [f"kk(k) AS (VALUES {_values((k,) for k in sorted(set(ks)))})", f"ord AS (SELECT s.*, dense_rank() OVER (PARTITION BY pol, w ORDER BY day) AS d FROM ({source}) s)"]
    for d in range(1, DAYS + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM p{e} WHERE p{e}.pol = ord.pol AND p{e}.w = ord.w AND p{e}.account = ord.account AND p{e}.k = kk.k)" for e in range(1, d))
        parts.append(f"p{d} AS (SELECT * FROM (SELECT ord.*, kk.k, row_number() OVER (PARTITION BY pol, w, kk.k ORDER BY score DESC, account) AS rn FROM ord CROSS JOIN kk WHERE d = {d} {seen}) WHERE rn <= k)")
    parts.append("picked AS (" + " UNION ALL ".join(f"SELECT * FROM p{d}" for d in range(1, DAYS + 1)) + ")")
    parts.append("grp AS (SELECT pol, w, count(DISTINCT day) AS n_days, count(DISTINCT account) FILTER (is_mule = 1) AS mules, count(*) AS queue_rows FROM ord GROUP BY ALL)")
    parts.append("big AS (SELECT pol, w, max(n) AS largest_day FROM (SELECT pol, w, day, count(*) AS n FROM ord GROUP BY ALL) GROUP BY ALL)")
    parts.append("""cov AS (SELECT grp.pol, grp.w, kk.k, n_days, count(p.account) AS alerts, count(*) FILTER (p.is_mule = 1) AS caught, count(p.account) - count(*) FILTER (p.is_mule = 1) AS false_positives,
    mules - count(*) FILTER (p.is_mule = 1) AS missed, coalesce(sum(p.exposure) FILTER (p.is_mule = 1), 0.0) AS exposure_recovered, min(p.score) AS threshold, queue_rows, largest_day
  FROM grp JOIN big USING (pol, w) CROSS JOIN kk LEFT JOIN picked p ON p.pol = grp.pol AND p.w = grp.w AND p.k = kk.k GROUP BY grp.pol, grp.w, kk.k, n_days, mules, queue_rows, largest_day)""")
    return ",\n".join(parts)


def _priced(source: str, miss: str, inv: str, freeze: str, extra: str = "") -> str:
    return f"""pr AS (SELECT *, ev_recovered - ev_missed AS net, (ev_recovered - ev_missed) / n_days AS net_per_day, CASE WHEN alerts > 0 THEN CAST(caught AS DOUBLE) / alerts ELSE 0.0 END AS precision_at_k,
    CASE WHEN caught + missed > 0 THEN CAST(caught AS DOUBLE) / (caught + missed) ELSE 0.0 END AS recall
  FROM (SELECT c.*{extra}, CAST(alerts * {inv} AS DOUBLE) AS investigation_cost, CAST(false_positives * {freeze} AS DOUBLE) AS freeze_cost, exposure_recovered - alerts * {inv} - false_positives * {freeze} AS ev_recovered, CAST(missed * {miss} AS DOUBLE) AS ev_missed FROM {source}))"""


C = COSTS
_MISS, _INV, _FREEZE, _K = float(C.cost_missed_mule_eur), float(C.cost_investigation_eur), float(C.cost_false_freeze_eur), C.analyst_capacity_per_day
SAME = "SELECT 'same_day' AS pol, * FROM q0"
_COV = 'w AS "window", \'rules\' AS scorer, CAST(k AS BIGINT) AS k, n_days, alerts, caught, false_positives, missed, round(exposure_recovered, 6) AS exposure_recovered, round(threshold, 6) AS threshold, CAST(queue_rows AS BIGINT) AS queue_rows, CAST(largest_day AS BIGINT) AS largest_day'
_PR = "round(investigation_cost, 6) AS investigation_cost, round(freeze_cost, 6) AS freeze_cost, round(ev_recovered, 6) AS ev_recovered, round(ev_missed, 6) AS ev_missed, round(net, 6) AS net, round(net_per_day, 6) AS net_per_day, round(precision_at_k, 6) AS precision_at_k, round(recall, 6) AS recall"


def _sql(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {ctes}\n{select}"


W_ = 'w AS "window"'
_sql("fx_normalise", RAW, "SELECT row_id, round(base_received, 6) AS base_received, round(base_paid, 6) AS base_paid FROM priced")
_audit = "count(*) AS rows, count(*) FILTER (account_from = account_to) AS self_transfers, count(*) FILTER (is_laundering = 1) AS laundering_rows"
_sql("self_transfer_audit", RAW, f"SELECT {_audit}, count(*) FILTER (account_from = account_to AND is_laundering = 1) AS laundering_dropped FROM raw")
_sql("contract_counts", RAW, f"SELECT {_audit}, (SELECT count(*) FROM (SELECT account_from FROM raw UNION SELECT account_to FROM raw)) AS accounts FROM raw")
_sql("account_codebook", RAW, "SELECT '1|' || a AS account_key, row_number() OVER (ORDER BY side, r) - 1 AS account FROM (SELECT a, min(side) AS side, min(r) FILTER (side = m) AS r FROM (SELECT *, min(side) OVER (PARTITION BY a) AS m FROM (SELECT account_from AS a, 0 AS side, row_id AS r FROM raw UNION ALL SELECT account_to, 1, row_id FROM raw)) GROUP BY a)")
_sql("ledger_span", RAW, "SELECT min(ts) AS first_ts, max(ts) AS last_ts, round((epoch(max(ts)) - epoch(min(ts))) / 86400.0, 6) AS span_days FROM raw WHERE account_from <> account_to")
_sql("leakage_cut", RAW, f"SELECT count(*) AS rows, max(ts) AS last_ts FROM txns WHERE ts < {_ts(WINDOWS[1].feature_end)}")
_sql("account_flows", RAW, "SELECT coalesce(i.a, o.a) AS account, round(coalesce(i.s, 0.0), 6) AS inflow, round(coalesce(o.s, 0.0), 6) AS outflow FROM (SELECT account_to AS a, sum(base_received) AS s FROM txns GROUP BY 1) i FULL JOIN (SELECT account_from AS a, sum(base_paid) AS s FROM txns GROUP BY 1) o ON i.a = o.a")
_sql("daily_volume", RAW, "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS payments, CAST(sum(is_laundering) AS BIGINT) AS laundering, round(avg(is_laundering), 6) AS share FROM raw WHERE account_from <> account_to GROUP BY 1")
_sql("population_by_window", f"{BASE}, {POP}", f"SELECT {W_}, account FROM pop")
_sql("labels_by_window", f"{BASE}, {POP}, {LAB}", f"SELECT {W_}, account, CAST(is_mule AS BIGINT) AS is_mule, round(exposure, 6) AS exposure FROM lab")
_sql("unscoreable_by_window", f"{BASE}, {POP}, {LAB}", f"SELECT {W_}, account FROM got ANTI JOIN pop USING (w, account) WHERE m = 1")
_sql("window_summary", f"{BASE}, {POP}, {LAB}, uns AS (SELECT w, count(*) AS n FROM got ANTI JOIN pop USING (w, account) WHERE m = 1 GROUP BY 1)",
     f"SELECT {W_}, count(*) AS population, CAST(sum(is_mule) AS BIGINT) AS mules, round(avg(is_mule), 6) AS base_rate, coalesce(any_value(n), 0) AS unscoreable_mules, CAST(sum(is_mule) + coalesce(any_value(n), 0) AS BIGINT) AS mules_in_window, round(sum(is_mule) / nullif(CAST(sum(is_mule) + coalesce(any_value(n), 0) AS DOUBLE), 0), 6) AS reachability_ceiling FROM lab LEFT JOIN uns USING (w) GROUP BY w")
_sql("daily_candidates", f"{BASE}, {POP}", f"SELECT DISTINCT win.{W_}, account_to AS account, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM txns JOIN win ON ts >= ls AND ts < le SEMI JOIN pop ON pop.w = win.w AND pop.account = account_to")
_cols = lambda names: ", ".join(f"round({c}, 6) AS {c}" for c in names)
for _name, _list in {
    "directional_in": ("in_degree", "unique_counterparties_in", "total_inflow", "max_inflow", "inflow_concentration"), "directional_out": ("out_degree", "unique_counterparties_out", "total_outflow", "max_outflow", "outflow_concentration"),
    "activity": ("active_days", "burstiness"), "pass_through_ratio": ("pass_through_ratio",), "median_hours_to_outflow": ("median_hours_to_outflow",), "reciprocity": ("reciprocity",),
    "asymmetries": ("degree_asymmetry", "counterparty_asymmetry", "sender_diversity", "mean_amount_ratio"), "feature_matrix": tuple(c for c in FEATURES if c != "pagerank"),
}.items():
    _sql(_name, FULL, f"SELECT {W_}, account, {_cols(_list)} FROM feat")
_FIFO = f"""{BASE}, {LEGS},
flow AS (SELECT w, account, ts, side, CAST(sum(CAST(amount AS DECIMAL(28, 6))) AS DECIMAL(38, 6)) AS m FROM legs WHERE side = 'out' OR early GROUP BY ALL),
cum AS (SELECT *, sum(m) OVER (PARTITION BY w, account, side ORDER BY ts) AS hi FROM flow WHERE m > 0),
pairs AS (SELECT i.w, i.account, (epoch_us(o.ts) - epoch_us(i.ts)) / 3600000000.0 AS h, least(i.hi, o.hi) - greatest(i.hi - i.m, o.hi - o.m) AS wt
  FROM cum i JOIN cum o ON i.w = o.w AND i.account = o.account AND i.side = 'in' AND o.side = 'out' AND i.hi - i.m < o.hi AND o.hi - o.m < i.hi AND o.ts > i.ts)"""
_sql("fifo_pairs", _FIFO, f"SELECT {W_}, account, round(h, 6) AS latency_hours, round(CAST(sum(wt) AS DOUBLE), 6) AS weight FROM pairs GROUP BY 1, 2, 3")
_sql("fifo_latency", f"{_FIFO}, run AS (SELECT w, account, h, sum(wt) OVER (PARTITION BY w, account ORDER BY h) AS c, sum(wt) OVER (PARTITION BY w, account) AS t FROM pairs)", f"SELECT {W_}, account, round(min(h) FILTER (c * 2 >= t), 6) AS fifo_latency FROM run GROUP BY 1, 2")
_sql("null_rates", FULL, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {W_}, '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM feat GROUP BY 1" for c in FEATURES if c != "pagerank") + ") WHERE null_rate > 0")
_logged = [c for c in PARAMS.logistic.log1p_features if c != "pagerank"]
_sql("log1p_features", FULL, f"SELECT {W_}, account, " + ", ".join(f"round(ln(1 + {c}), 6) AS {c}" for c in _logged) + " FROM feat")
_cut = lambda p: f"{FULL}, cut AS (SELECT w, quantile_cont(in_degree, {p}) AS a, quantile_cont(pass_through_ratio, {p}) AS b FROM feat GROUP BY 1)"
_sql("rules_flag", _cut(PARAMS.rules.in_degree_percentile), f"SELECT {W_}, account, in_degree > a AND coalesce(pass_through_ratio > {PARAMS.rules.pass_through_ratio_min}, false) AS rules_flag FROM feat JOIN cut USING (w)")
_matched = "in_degree > a AND coalesce(pass_through_ratio > b, false)"
_sql("matched_rules_flag", _cut(0.9), f"SELECT {W_}, account, {_matched} AS matched_rules_flag FROM feat JOIN cut USING (w)")
_sql("flag_summary", _cut(0.9) + f", f AS (SELECT w, {_matched} AS flag, is_mule FROM feat JOIN cut USING (w) JOIN lab USING (w, account))",
     f"SELECT {W_}, count(*) FILTER (flag) AS flagged, round(avg(CAST(flag AS INT)), 6) AS share, count(*) FILTER (flag AND is_mule = 1) AS mules_caught, count(*) FILTER (is_mule = 1) AS mules, round(coalesce(count(*) FILTER (flag AND is_mule = 1) / nullif(CAST(count(*) FILTER (flag) AS DOUBLE), 0), 0.0), 6) AS precision FROM f GROUP BY 1")
_r = PARAMS.rules
_sql("rules_diagnostics", f"{FULL}, cut AS (SELECT w, quantile_cont(in_degree, {_r.in_degree_percentile}) AS c, quantile_cont(pass_through_ratio, 0.99) AS p FROM feat GROUP BY 1)",
     f"SELECT {W_}, round(any_value(c), 6) AS in_degree_cut, round(any_value(p), 6) AS ratio_p99, count(*) FILTER (in_degree > c) AS busy, count(*) FILTER (pass_through_ratio > {_r.pass_through_ratio_min}) AS passing, count(*) FILTER (in_degree > c AND pass_through_ratio > {_r.pass_through_ratio_min}) AS both, count(*) FILTER (pass_through_ratio IS NULL) AS undefined_ratio FROM feat JOIN cut USING (w) GROUP BY w")
_sql("rules_score", SCORED, f"SELECT {W_}, account, round(score, 9) AS rules FROM sl")
_pct = lambda c: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY w, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY w, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY w) END"
_sql("population_percentiles", FULL, f"SELECT {W_}, account, " + ", ".join(f"round({_pct(c)}, 9) AS pct_{c}" for c in COLUMNS) + " FROM feat")
_qcols = "account, day, round(score, 6) AS score, CAST(is_mule AS BIGINT) AS is_mule, round(exposure, 6) AS exposure"
_sql("candidate_queue", QUEUE, f"SELECT {W_}, 'rules' AS scorer, {_qcols} FROM q0")
_sql("overflow_queue", QUEUE, f"SELECT {W_}, 'rules' AS scorer, {_qcols} FROM carried")
_sql("select_alerts", f"{QUEUE},\n{_picks(SAME, [_K])}", f"SELECT CAST(k AS BIGINT) AS k, {W_}, 'rules' AS scorer, {_qcols} FROM picked")
_at = f"{QUEUE},\n{_picks(SAME, [_K])}"
_sql("operating_point", f"{_at},\n{_priced('cov c', _MISS, _INV, _FREEZE)}", f"SELECT {_COV}, {_PR} FROM pr")
_sql("operating_context", f"{_at}, br AS (SELECT w, avg(is_mule) AS b FROM (SELECT DISTINCT w, account, is_mule FROM q0) GROUP BY 1), uns AS (SELECT w, count(*) AS u FROM got ANTI JOIN pop USING (w, account) WHERE m = 1 GROUP BY 1)",
     f"SELECT {W_}, 'rules' AS scorer, alerts, caught, round(alerts * b, 6) AS expected_random_catches, round(coalesce(caught / nullif(CAST(caught + missed + coalesce(u, 0) AS DOUBLE), 0), 0.0), 6) AS recall_of_window FROM cov JOIN br USING (w) LEFT JOIN uns USING (w)")
_curve = f"{QUEUE},\n{_picks(SAME, VOLUMES)}"
_sql("coverage_curve", _curve, f"SELECT {_COV} FROM cov")
_pcurve = f"{_curve},\n{_priced('cov c', _MISS, _INV, _FREEZE)}"
_sql("volume_curve", _pcurve, f"SELECT {_COV}, {_PR} FROM pr")
_sql("volume_optimum", _pcurve, f"SELECT {W_}, 'rules' AS scorer, CAST(k AS BIGINT) AS optimal_k, round(net, 6) AS net_at_optimum FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY net DESC, k) AS r FROM pr) WHERE r = 1")
_moves = [(p, m, float(getattr(C, p)) * m, replace_cost(C, p, float(getattr(C, p)) * m)) for p in COST_PARAMETERS for m in PARAMS.multipliers]
_grid = "grid(parameter, multiplier, value, gk, gm, gi, gf) AS (VALUES " + _values((f"'{p}'", f"CAST({m} AS DOUBLE)", f"CAST({v} AS DOUBLE)", c.analyst_capacity_per_day, f"CAST({c.cost_missed_mule_eur} AS DOUBLE)", f"CAST({c.cost_investigation_eur} AS DOUBLE)", f"CAST({c.cost_false_freeze_eur} AS DOUBLE)") for p, m, v, c in _moves) + ")"
_sql("sensitivity", f"{QUEUE},\n{_picks(SAME, [c.analyst_capacity_per_day for *_, c in _moves])},\n{_grid},\n{_priced('cov c JOIN grid ON gk = c.k', 'gm', 'gi', 'gf', ', parameter, multiplier, value')}", f"SELECT {_COV}, parameter, multiplier, value, {_PR} FROM pr")
_wrong = _INV + _FREEZE
_even = f"{QUEUE},\n{_picks(SAME, [*VOLUMES, _K])},\nrat(ratio) AS (VALUES {_values((f'CAST({r} AS DOUBLE)',) for r in RATIOS)}),\n{_priced('cov c CROSS JOIN rat', f'(ratio * {_wrong})', _INV, _FREEZE, ', ratio')},\nbest AS (SELECT *, row_number() OVER (PARTITION BY w, ratio ORDER BY net DESC, k) AS r FROM pr WHERE k IN ({', '.join(map(str, VOLUMES))}))"
_sql("break_even_curve", _even, f"SELECT best.{W_}, 'rules' AS scorer, round(best.ratio, 6) AS ratio, CAST(best.k AS BIGINT) AS optimal_k, round(best.net, 6) AS net_at_optimum, round(b.net, 6) AS net_at_budget, round(best.ratio * {_wrong}, 6) AS cost_missed_mule_eur, best.k > {_K} AS budget_binds, best.k = {max(VOLUMES)} AS optimal_at_grid_edge FROM best JOIN pr b ON b.w = best.w AND b.ratio = best.ratio AND b.k = {_K} WHERE r = 1")
_sql("crossing_ratio", _even, f"SELECT {W_}, 'rules' AS scorer, round(min(ratio) FILTER (k > {_K}), 6) AS crossing_ratio FROM best WHERE r = 1 GROUP BY w")
_BOTH = "SELECT 'same_day' AS pol, * FROM q0 UNION ALL SELECT 'rollover_max_3d', * FROM carried"
_over = f"{QUEUE},\n{_picks(_BOTH, [_K])},\n{_priced('cov c', _MISS, _INV, _FREEZE)},\ncar AS (SELECT pol, w, count(*) AS n FROM picked ANTI JOIN q0 ON q0.w = picked.w AND q0.account = picked.account AND q0.day = picked.day GROUP BY ALL)"
_sql("overflow_comparison", _over, f"SELECT pol AS policy, {_COV}, {_PR}, coalesce(n, 0) AS carried_alerts FROM pr LEFT JOIN car USING (pol, w)")
_sql("overflow_verdict", f"{_over}, dl AS (SELECT a.caught - b.caught AS d FROM pr a JOIN pr b ON a.w = b.w AND a.pol <> 'same_day' AND b.pol = 'same_day')",
     "SELECT count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS worsened, count(*) FILTER (d = 0) AS unchanged, CAST(coalesce(max(d) FILTER (d > 0), 0) AS BIGINT) AS largest_gain, CAST(coalesce(max(-d) FILTER (d < 0), 0) AS BIGINT) AS largest_loss FROM dl")
_need = lambda x: f"round({_wrong} / ({x} + {_MISS + _FREEZE}), 6)"
_sql("exposure_concentration", f"{QUEUE}, once AS (SELECT DISTINCT w, account, is_mule, exposure FROM q0), mu AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY exposure DESC, account) AS r FROM once WHERE is_mule = 1), st AS (SELECT w, sum(exposure) AS total, quantile_cont(exposure, 0.5) AS med, avg(exposure) AS mean, count(*) AS n, sum(exposure) FILTER (r = 1) AS one, sum(exposure) FILTER (r <= 5) AS five FROM mu GROUP BY w), br AS (SELECT w, avg(is_mule) AS b FROM once GROUP BY w)",
     f"SELECT {W_}, 'rules' AS scorer, round(total, 6) AS total, round(med, 6) AS median, round(mean, 6) AS mean, coalesce(n, 0) AS count, round(one / total, 6) AS top_1_share, round(five / total, 6) AS top_5_share, {_need('0.0')} AS break_even_none, {_need('med')} AS break_even_median, {_need('mean')} AS break_even_mean, round(b, 6) AS base_rate, b > {_wrong} / (mean + {_MISS + _FREEZE}) AS random_alerts_pay_at_mean FROM br LEFT JOIN st USING (w)")
_sql("reachability_funnel", f"{_at}, uns AS (SELECT w, count(*) AS u FROM got ANTI JOIN pop USING (w, account) WHERE m = 1 GROUP BY 1), st AS (SELECT grp.w, mules AS reachable, mules + coalesce(u, 0) AS total, alerts, caught FROM grp JOIN cov USING (w) LEFT JOIN uns USING (w))",
     f"SELECT {W_}, CAST(n AS BIGINT) AS stage_no, ['mules active in the label window', 'reachable by the feature window', 'alerts the budget allows', 'caught'][n + 1] AS stage, [total, reachable, alerts, caught][n + 1] AS count, round([total, reachable, alerts, caught][n + 1] / nullif(CAST(total AS DOUBLE), 0), 6) AS share FROM st CROSS JOIN range(0, 4) t(n)")
_GRAPH = """edge AS (SELECT DISTINCT w, account_from AS src, account_to AS dst FROM txns JOIN win ON ts >= fs AND ts < fe),
node AS (SELECT w, src AS n FROM edge UNION SELECT w, dst FROM edge),
und AS (SELECT w, src AS a, dst AS b FROM edge UNION SELECT w, dst, src FROM edge),
deg AS (SELECT node.w, node.n, count(und.a) AS degree FROM node LEFT JOIN und ON und.w = node.w AND und.a = node.n GROUP BY ALL),
tri AS (SELECT node.w, node.n, count(z.a) // 2 AS triangles FROM node LEFT JOIN und x ON x.w = node.w AND x.a = node.n LEFT JOIN und y ON y.w = x.w AND y.a = x.b LEFT JOIN und z ON z.w = y.w AND z.a = y.b AND z.b = node.n GROUP BY ALL)"""
_GS = f"""directed_edges, CAST(ends // 2 AS BIGINT) AS undirected_edges, round(ends / CAST(nodes AS DOUBLE), 6) AS mean_degree, max_degree, CAST(corners // 3 AS BIGINT) AS triangles, accounts_in_a_triangle, round(1 - accounts_in_a_triangle / CAST(nodes AS DOUBLE), 6) AS zero_triangle_share
  FROM (SELECT w, count(*) AS nodes, sum(degree) AS ends, max(degree) AS max_degree, sum(triangles) AS corners, count(*) FILTER (triangles > 0) AS accounts_in_a_triangle FROM deg JOIN tri USING (w, n) GROUP BY w) JOIN (SELECT w, count(*) AS directed_edges FROM edge GROUP BY w) USING (w)"""
_sql("graph_edges", f"{BASE}, {_GRAPH}", f"SELECT {W_}, src, dst FROM edge")
_sql("graph_degrees", f"{BASE}, {_GRAPH}", f"SELECT {W_}, n AS node, degree FROM deg")
_sql("triangles", f"{BASE}, {_GRAPH}", f"SELECT {W_}, n AS node, CAST(triangles AS BIGINT) AS triangles FROM tri")
_sql("graph_stats", f"{BASE}, {_GRAPH}", f"SELECT {W_}, nodes, {_GS}")
_TEST = f"{RAW}, {_windows('win', WINDOWS[-1:], HOURS)}, {POP}, {_GRAPH}"
_d = PARAMS.features.pagerank_damping
#: Power iteration as a recursive query, all windows at once; the step at which a window stops is found afterwards.
_PR = f"""outs AS (SELECT w, src, count(*) AS o FROM edge GROUP BY ALL),
nn AS (SELECT w, count(*) AS c FROM node GROUP BY 1),
pr(i, w, n, r) AS (
  SELECT 0, w, n, CAST(1.0 AS DOUBLE) / c FROM node JOIN nn USING (w)
  UNION ALL
  SELECT l.i + 1, node.w, node.n, {_d} * coalesce(g.s, 0) + {_d} * coalesce(l.lost, 0) / c + {1 - _d} / c
  FROM node JOIN nn USING (w) JOIN (SELECT pr.w, max(i) AS i, sum(r) FILTER (outs.src IS NULL) AS lost FROM pr LEFT JOIN outs ON outs.w = pr.w AND outs.src = pr.n GROUP BY pr.w) l ON l.w = node.w
  LEFT JOIN (SELECT edge.w, dst, sum(r / o) AS s FROM edge JOIN pr ON pr.w = edge.w AND pr.n = edge.src JOIN outs ON outs.w = edge.w AND outs.src = edge.src GROUP BY ALL) g ON g.w = node.w AND g.dst = node.n
  WHERE l.i < {PARAMS.features.pagerank_max_iter}),
moves AS (SELECT b.w, b.i, sum(abs(b.r - a.r)) AS m FROM pr a JOIN pr b ON a.w = b.w AND a.n = b.n AND b.i = a.i + 1 GROUP BY ALL),
stops AS (SELECT w, coalesce(min(i) FILTER (m < {PARAMS.features.pagerank_tol}), max(i)) AS i FROM moves GROUP BY 1),
ranked AS (SELECT pr.w, pr.n, r FROM pr JOIN stops USING (w, i))"""
_sql("pagerank", f"{BASE}, {_GRAPH}, {_PR}", f"SELECT {W_}, n AS node, round(r, 9) AS pagerank FROM ranked")
_all = ", ".join("round(coalesce(r, 0.0), 6) AS pagerank" if c == "pagerank" else f"round({c}, 6) AS {c}" for c in FEATURES)
# FEAT has its own edges, so the graph's are taken from there
_sql("full_feature_matrix", f"{FULL}, {_GRAPH.partition(chr(10))[2]}, {_PR}",
     f"SELECT feat.{W_}, account, {_all}, CAST(is_mule AS BIGINT) AS is_mule, round(exposure, 6) AS exposure FROM feat JOIN lab USING (w, account) LEFT JOIN ranked ON ranked.w = feat.w AND ranked.n = feat.account")
_plain = [c for c in FEATURES if c != "pagerank"]
_sql("null_guard", FULL, " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NULL) = 0 OR {c in NULLABLE} AS passes FROM feat" for c in _plain))
_sql("class_weight", f"{BASE}, {POP}, {LAB}", "SELECT count(*) AS accounts, round(CAST(count(*) FILTER (is_mule = 0) AS DOUBLE) / count(*) FILTER (is_mule = 1), 6) AS weight FROM lab WHERE w = 'train'")
_sql("volume_grid", f"{QUEUE}, top AS (SELECT max(n) AS c FROM (SELECT w, day, count(*) AS n FROM q0 GROUP BY ALL))",
     f"SELECT DISTINCT CAST(round(pow(CAST(c AS DOUBLE), i / 59.0)) AS BIGINT) AS k FROM top CROSS JOIN range(0, 60) t(i) UNION SELECT {_K}")


def _linear(model) -> str:
    terms = []
    for column, (median, mean, deviation, weight) in model.terms.items():
        value = f"ln(1 + {column})" if column in model.log1p_features else column
        terms.append(f"(coalesce({value}, CAST({median!r} AS DOUBLE)) - CAST({mean!r} AS DOUBLE)) / CAST({deviation!r} AS DOUBLE) * CAST({weight!r} AS DOUBLE)")
    return f"CAST({model.intercept!r} AS DOUBLE) + " + " + ".join(terms)


_sql("logistic_fixed_scores", FULL, f"SELECT {W_}, account, round(1 / (1 + exp(-({_linear(FIXED_MODEL)}))), 8) AS logistic FROM feat")


def _turn(inner: str, shift: int, factor: int) -> str:
    """A step of the hash: x becomes (x ^ x >> shift) factor modulo 2^64."""
    return f"SELECT * REPLACE (CAST(CAST(xor(x, x >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS x) FROM ({inner})"


_A, _B2, _C2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_weights = f"SELECT w, account, draw, CAST((CAST(account AS UHUGEINT) * {_A}::UHUGEINT + CAST(draw AS UHUGEINT) + {PARAMS.seed * 2**32}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM (SELECT w, account FROM sl WHERE w <> 'train') CROSS JOIN range(0, {PARAMS.bootstrap_resamples}) t(draw)"
for _shift, _factor in ((30, _B2), (27, _C2), (31, _A), (29, _B2)):
    _weights = _turn(_weights, _shift, _factor)
_many = " + ".join(f"CASE WHEN (x >> 11) / 9007199254740992.0 >= CAST({p!r} AS DOUBLE) THEN 1 ELSE 0 END" for p in POISSON)
_boot = f"""{SCORED}, st AS (SELECT w, account, 'rules' AS scorer, score AS s, is_mule AS y FROM sl WHERE w <> 'train' UNION ALL SELECT w, account, 'exposure_rank', round(exposure, 2), is_mule FROM sl WHERE w <> 'train'),
wt AS (SELECT w, account, draw, {_many} AS m FROM ({_weights})),
th AS (SELECT w, scorer, draw, s, sum(m * y) AS h, sum(sum(m * y)) OVER o AS c, sum(sum(m)) OVER o AS a, sum(sum(m * y)) OVER (PARTITION BY w, scorer, draw) AS p
  FROM st JOIN wt USING (w, account) GROUP BY w, scorer, draw, s WINDOW o AS (PARTITION BY w, scorer, draw ORDER BY s DESC)),
dr AS (SELECT w, scorer, draw, sum(CASE WHEN a > 0 THEN CAST(h AS DOUBLE) * CAST(c AS DOUBLE) / CAST(a AS DOUBLE) ELSE 0 END) / nullif(CAST(max(p) AS DOUBLE), 0) AS ap FROM th GROUP BY ALL),
pt AS (SELECT w, scorer, sum(h * CAST(c AS DOUBLE) / a) / nullif(max(p), 0) AS ap FROM (SELECT w, scorer, s, sum(y) AS h, sum(sum(y)) OVER q AS c, sum(count(*)) OVER q AS a, sum(sum(y)) OVER (PARTITION BY w, scorer) AS p
  FROM st GROUP BY w, scorer, s WINDOW q AS (PARTITION BY w, scorer ORDER BY s DESC)) GROUP BY w, scorer)"""
_sql("bootstrap_draws", _boot, f"SELECT {W_}, scorer, draw, round(ap, 6) AS average_precision FROM dr")
_sql("bootstrap_intervals", _boot, f"SELECT {W_}, scorer, round(any_value(pt.ap), 6) AS average_precision, round(quantile_cont(dr.ap, 0.025), 6) AS low, round(quantile_cont(dr.ap, 0.975), 6) AS high FROM dr JOIN pt USING (w, scorer) GROUP BY w, scorer")
_sql("paired_differences", f"{_boot}, gp AS (SELECT a.w, quantile_cont(a.ap - b.ap, 0.025) AS low, quantile_cont(a.ap - b.ap, 0.975) AS high FROM dr a JOIN dr b ON a.w = b.w AND a.draw = b.draw AND a.scorer = 'exposure_rank' AND b.scorer = 'rules' GROUP BY 1)",
     f"SELECT gp.{W_}, 'exposure_rank' AS scorer, 'rules' AS against, round(a.ap - b.ap, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, low <= 0 AND high >= 0 AS crosses_zero FROM gp JOIN pt a ON a.w = gp.w AND a.scorer = 'exposure_rank' JOIN pt b ON b.w = gp.w AND b.scorer = 'rules'")
_comp = f"{_TEST}, reach(n, m) AS (SELECT n, n FROM node UNION SELECT reach.n, und.b FROM reach JOIN und ON und.a = reach.m), comp AS (SELECT n, min(m) AS c FROM reach GROUP BY 1), ctab AS (SELECT c, count(*) AS size, (SELECT count(*) FROM und JOIN comp k ON k.n = und.a WHERE und.a < und.b AND k.c = comp.c) AS edges FROM comp GROUP BY c)"
_sql("components", _comp, "SELECT n AS node, c AS component FROM comp")
_sql("component_profile", f"{_comp}, mx AS (SELECT max(size) AS m FROM ctab)", "SELECT CAST(sum(size) AS BIGINT) AS nodes, CAST(sum(edges) AS BIGINT) AS edges, count(*) AS components, max(size) AS largest_component, round(max(size) / CAST(sum(size) AS DOUBLE), 6) AS largest_share, round(quantile_cont(size, 0.5), 6) AS median_component, count(*) FILTER (size = 1) AS singletons, count(*) FILTER (edges >= size) AS components_with_a_cycle, round(count(*) FILTER (edges >= size AND size < m) / CAST(greatest(count(*) FILTER (size < m), 1) AS DOUBLE), 6) AS cycle_share_outside_largest FROM ctab, mx")
_bands = "bands(band_no, band, lo, hi) AS (VALUES (0, 'not in the graph', 0, 0), (1, '1, isolated', 1, 1), (2, '2 to 3, an edge or a path', 2, 3), (3, '4 to 50, could be a motif', 4, 50), (4, 'over 50', 51, 1000000000))"
_sql("component_bands", f"{_comp}, {_bands}, sz AS (SELECT account, coalesce(size, 0) AS s FROM pop LEFT JOIN comp ON comp.n = account LEFT JOIN ctab USING (c))", "SELECT 'population' AS set, CAST(band_no AS BIGINT) AS band_no, band, count(s) AS accounts, round(count(s) / CAST((SELECT count(*) FROM sz) AS DOUBLE), 6) AS share FROM bands LEFT JOIN sz ON s BETWEEN lo AND hi GROUP BY 2, 3")
_sql("history_scan_query", f"{RAW}, {_windows('win', HISTORIES, HOURS)}, {POP}, {LAB}, {_GRAPH}, uns AS (SELECT w, count(*) AS u FROM got ANTI JOIN pop USING (w, account) WHERE m = 1 GROUP BY 1), sm AS (SELECT w, count(*) AS population, sum(is_mule) AS mules, coalesce(any_value(u), 0) AS unscoreable_mules FROM lab LEFT JOIN uns USING (w) GROUP BY w)",
     f"SELECT * FROM (SELECT {W_}, population, CAST(mules AS BIGINT) AS mules, round(mules / CAST(population AS DOUBLE), 6) AS base_rate, unscoreable_mules, CAST(mules + unscoreable_mules AS BIGINT) AS mules_in_window, round(mules / CAST(mules + unscoreable_mules AS DOUBLE), 6) AS reachability_ceiling FROM sm) JOIN (SELECT {W_}, nodes, {_GS}) USING (\"window\")")
_st = f"{SCORED}, st AS (SELECT w, 'rules' AS scorer, score AS s, is_mule AS y FROM sl UNION ALL SELECT w, 'exposure_rank', round(exposure, 2), is_mule FROM sl), th AS (SELECT w, scorer, s, sum(y) AS h, sum(sum(y)) OVER o AS c, sum(count(*)) OVER o AS a, sum(sum(y)) OVER (PARTITION BY w, scorer) AS p FROM st GROUP BY w, scorer, s WINDOW o AS (PARTITION BY w, scorer ORDER BY s DESC))"
_ap = "sum(h * CAST(c AS DOUBLE) / a) / nullif(max(p), 0)"
_sql("average_precision", _st, f"SELECT {W_}, scorer, round({_ap}, 6) AS average_precision FROM th GROUP BY w, scorer")
_sql("pr_curve", _st, f"SELECT {W_}, scorer, round(s, 6) AS threshold, round(c / CAST(a AS DOUBLE), 6) AS precision, round(c / nullif(CAST(p AS DOUBLE), 0), 6) AS recall FROM th WHERE scorer = 'rules' UNION ALL SELECT DISTINCT {W_}, scorer, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM th WHERE scorer = 'rules'")
_sql("pr_table", _st, f"SELECT {W_}, scorer, round(ap, 6) AS average_precision, round(b, 6) AS base_rate, round(ap / nullif(b, 0), 6) AS lift FROM (SELECT w, scorer, {_ap} AS ap FROM th GROUP BY w, scorer) JOIN (SELECT w, scorer, avg(y) AS b FROM st GROUP BY w, scorer) USING (w, scorer)")
_B, _E = PARAMS.monitoring.bins, PARAMS.monitoring.epsilon


def _drift(source: str) -> str:
    return f"""lv AS ({source}),
qe AS (SELECT feature, quantile_cont(v, [{", ".join(f"{i} / {_B}.0" for i in range(1, _B))}]) AS e FROM lv WHERE side = 'train' GROUP BY 1),
bn AS (SELECT lv.feature, side, len(list_filter(e, lambda x: x <= v)) AS b FROM lv JOIN qe USING (feature) WHERE v IS NOT NULL),
ct AS (SELECT feature, side, b, count(*) AS n FROM bn GROUP BY ALL),
pp AS (SELECT f.feature, f.side, g.b, coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY f.feature, f.side) AS DOUBLE) AS p FROM (SELECT DISTINCT feature, side FROM bn) f CROSS JOIN range(0, {_B}) g(b) LEFT JOIN ct ON ct.feature = f.feature AND ct.side = f.side AND ct.b = g.b),
ps AS (SELECT *, (CASE WHEN p > 0 THEN p ELSE {_E} END) / sum(CASE WHEN p > 0 THEN p ELSE {_E} END) OVER (PARTITION BY feature, side) AS s FROM pp),
ds AS (SELECT feature, sum((c.s - r.s) * ln(c.s / r.s)) AS psi, count(*) FILTER (c.p = 0 OR r.p = 0) AS empty FROM ps r JOIN ps c USING (feature, b) WHERE r.side = 'train' AND c.side = 'test' GROUP BY feature),
nu AS (SELECT feature, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) FILTER (side = 'train') AS rn, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) FILTER (side = 'test') AS cn FROM lv GROUP BY 1)"""


_read = "CASE WHEN psi IS NULL THEN 'undefined, a window has no values' WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate shift' ELSE 'significant shift' END"
_dsel = f"SELECT feature, round(psi, 5) AS psi, {_read} AS reading, empty AS empty_bins, CAST(len(list_distinct(e)) + 2 AS BIGINT) AS distinct_reference_edges, empty > 0 AS epsilon_dependent, round(rn, 5) AS reference_null_share, round(cn, 5) AS comparison_null_share FROM nu LEFT JOIN ds USING (feature) LEFT JOIN qe USING (feature)"
_flv = " UNION ALL ".join(f"SELECT '{c}' AS feature, w AS side, round({c}, 6) AS v FROM feat WHERE w IN ('train', 'test')" for c in FEATURES if c != "pagerank")
_slv = "SELECT 'rules' AS feature, w AS side, round(score, 9) AS v FROM sl WHERE w IN ('train', 'test')"
_sql("psi_features", f"{FULL}, {_drift(_flv)}", _dsel)
_sql("psi_scores", f"{SCORED}, {_drift(_slv)}", _dsel)
_sql("ks_scores", f"{SCORED}, lv AS ({_slv}), vs AS (SELECT DISTINCT v FROM lv)", "SELECT 'rules' AS feature, round(max(abs((SELECT avg(CASE WHEN lv.v <= vs.v THEN 1.0 ELSE 0.0 END) FROM lv WHERE side = 'train') - (SELECT avg(CASE WHEN lv.v <= vs.v THEN 1.0 ELSE 0.0 END) FROM lv WHERE side = 'test'))), 6) AS ks FROM vs")
_T = PARAMS.brief.standout_percentile
_hits = " + ".join(f"CASE WHEN p_{c} >= {_T} THEN 1 ELSE 0 END" for c in COLUMNS)
_max = "greatest(" + ", ".join(f"coalesce(p_{c}, -1)" for c in COLUMNS) + ")"
_top = "CASE " + " ".join(f"WHEN p_{c} = {_max} THEN '{c}'" for c in COLUMNS) + " END"
_step = f"CASE WHEN {_max} >= {_T} AND {_top} = 'pass_through_ratio' THEN '{ONWARD}' WHEN {_max} >= {_T} AND {_top} IN ('in_degree', 'unique_counterparties_in', 'sender_diversity') THEN '{SENDERS}' ELSE '{OTHER.replace(chr(39), chr(39) * 2)}' END"
_sql("briefs_table", f"{_at}, pc AS (SELECT w, account, " + ", ".join(f"{_pct(c)} AS p_{c}" for c in COLUMNS) + " FROM feat), al AS (SELECT w, account, max(score) AS score, max(is_mule) AS m, max(exposure) AS e FROM picked WHERE w = 'test' GROUP BY ALL)",
     f"SELECT {W_}, account, row_number() OVER (ORDER BY score DESC, account) AS rank, count(*) OVER () AS alerts, round(score, 6) AS score, round(e, 6) AS exposure, CAST(m AS BIGINT) AS is_mule, CAST(least(3, {_hits}) AS BIGINT) AS n_standouts, {_step} AS next_step FROM al JOIN pc USING (w, account)")
_shown = {"count": "format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT))", "share": "printf('%.0f', round({0} * 100)) || '%'", "places": "printf('%.2f', round({0}, 2))"}


def _said(threshold: float) -> str:
    parts = []
    for column, text, kind in STANDOUTS:
        before, _, after = text.partition("{}")
        words = f"'{text}'" if kind is None else f"'{before}' || {_shown[kind].format(column)} || '{after}'"
        parts.append(f"CASE WHEN p_{column} >= {threshold} THEN {words} END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)[1:3], '; ')"


def _next(threshold: float) -> str:
    other = OTHER.replace(chr(39), chr(39) * 2)
    return f"CASE WHEN {_max} >= {threshold} AND {_top} = 'pass_through_ratio' THEN '{ONWARD}' WHEN {_max} >= {threshold} AND {_top} IN ('in_degree', 'unique_counterparties_in', 'sender_diversity') THEN '{SENDERS}' ELSE '{other}' END"


_briefed = f"{_at}, pc AS (SELECT *, " + ", ".join(f"{_pct(c)} AS p_{c}" for c in COLUMNS) + " FROM feat), al AS (SELECT w, account, max(score) AS score, max(is_mule) AS m, max(exposure) AS e FROM picked WHERE w = 'test' GROUP BY ALL)"
_sql("brief_phrases", _briefed, f"SELECT {W_}, account, {_said(0.6)} AS standouts, {_next(0.6)} AS next_step FROM al JOIN pc USING (w, account)")
_sql("brief_texts", _briefed,
     f"SELECT {W_}, account, row_number() OVER (ORDER BY score DESC, account) AS rank, count(*) OVER () AS alerts, round(score, 6) AS score, round(e, 6) AS exposure, CAST(m AS BIGINT) AS is_mule, "
     f"{_said(_T)} AS standouts, {_next(_T)} AS next_step FROM al JOIN pc USING (w, account) ORDER BY e DESC, rank LIMIT {PARAMS.brief.sample}")
_trade = f"""rates(c, r) AS (VALUES ('Euro', 1.0), ('US Dollar', CAST({PARAMS.fx_to_base['US Dollar']} AS DOUBLE))),
tr AS (SELECT l_shipdate + l_linenumber * INTERVAL 1 HOUR AS ts, o_custkey AS f, l_suppkey * 15 AS t, l_extendedprice * (1 - l_discount) AS r, l_extendedprice * (1 + l_tax) * {PARAMS.fx_to_base['US Dollar']} AS p, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount >= 0.1 THEN 1 ELSE 0 END AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey * 15)"""
_sql("trade_account_flows", _trade, "SELECT coalesce(i.a, o.a) AS account, round(coalesce(i.s, 0.0), 5) AS inflow, round(coalesce(o.s, 0.0), 5) AS outflow FROM (SELECT t AS a, sum(r) AS s FROM tr GROUP BY 1) i FULL JOIN (SELECT f AS a, sum(p) AS s FROM tr GROUP BY 1) o ON i.a = o.a")
_sql("trade_daily_volume", _trade, "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS payments, CAST(sum(y) AS BIGINT) AS laundering, round(avg(y), 6) AS share FROM tr GROUP BY 1")
_trade_base = f"{_trade}, txns AS (SELECT ts, f AS account_from, t AS account_to, r AS base_received, p AS base_paid, y AS is_laundering FROM tr), {_windows('win', TRADE_WINDOWS, TRADE_HOURS)}"
_sql("trade_feature_matrix", f"{_trade_base}, {POP}, {FEAT}", f"SELECT {W_}, account, " + ", ".join(f"round({c}, 5) AS {c}" for c in FEATURES if c != "pagerank") + " FROM feat")
_sql("trade_graph_stats", f"{_trade_base}, {_GRAPH}", f"SELECT {W_}, nodes, {_GS}")
