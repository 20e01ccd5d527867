"""The metrics files' contents. Their keys are fixed values: readers of the files depend on them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from ledgersift.config import POLICY_HORIZON, SCORERS, Costs, Params, Window
from ledgersift.functions.scalars import READINGS
from ledgersift.operators.graph import BANDS

#: The scorer and window that the single tables of `economics` are about.
SCORER, WINDOW = SCORERS[-1], "test"
POINT = ("k", "alerts", "caught", "missed", "exposure_recovered", "ev_recovered", "ev_missed", "net_per_day", "precision_at_k", "recall", "threshold")
BREAK_EVEN = ("ratio", "cost_missed_mule_eur", "optimal_k", "net_at_optimum", "net_at_budget", "budget_binds", "optimal_at_grid_edge")
EXPOSURE = ("total", "median", "mean", "count", "top_1_share", "top_5_share")
DRIFT = ("psi", "reading", "empty_bins", "distinct_reference_edges", "epsilon_dependent", "reference_null_share", "comparison_null_share")
SCORE_DRIFT = ("psi", "reading", "empty_bins", "distinct_reference_edges", "epsilon_dependent", "ks")
FLAG = ("flagged", "share", "mules_caught", "mules", "precision")
GRAPH = {
    "nodes": "nodes", "directed_edges": "directed_edges", "undirected_edges": "undirected_edges", "mean_degree": "mean_degree", "max_degree": "max_degree",
    "triangles": "triangles", "accounts_in_triangle": "accounts_in_a_triangle", "zero_triangle_share": "zero_triangle_share",
}
DECAY_NOTE = "Not measurable: the usable span holds one label window after another, so there are no weeks to compare."


def picked(row: dict[str, Any], names: Iterable[str]) -> dict[str, Any]:
    return {n: row[n] for n in names}


def in_order(rows: Sequence[dict], key: str = "scorer", order: Sequence[str] = SCORERS) -> list[dict]:
    return sorted(rows, key=lambda r: order.index(r[key]))


def of(rows: Sequence[dict], window: str = WINDOW, scorer: str = SCORER) -> list[dict]:
    return [r for r in rows if r["window"] == window and r["scorer"] == scorer]


def data(counts: dict[str, Any], span: dict, daily: Sequence[dict], summary: Sequence[dict], windows: Sequence[Window], params: Params) -> dict[str, Any]:
    by = {r["window"]: r for r in summary}
    bounds = ("feature_start", "feature_end", "label_start", "label_end")
    names = ("population", "mules", "base_rate", "unscoreable_mules", "mules_in_window", "reachability_ceiling")
    return counts | {
        "observed_start": str(span["first_ts"]), "observed_end": str(span["last_ts"]), "usable_start": str(params.split.data_start), "usable_end": str(params.split.data_end),
        "daily": {d["day"]: {"transactions": d["payments"], "laundering": d["laundering"], "laundering_share": d["share"]} for d in daily},
        "windows": {w.name: {b: str(getattr(w, b)) for b in bounds} | picked(by[w.name], names) for w in windows if w.name in by},
    }


def models(facts: dict[str, Any], ranking: Sequence[dict], intervals: Sequence[dict], differences: Sequence[dict], flags: dict[str, Sequence[dict]], nulls: Sequence[dict], params: Params) -> dict[str, Any]:
    per: dict[str, dict[str, Any]] = {}
    for name in dict.fromkeys(r["window"] for r in ranking):
        per[name] = {"base_rate": next(r["base_rate"] for r in ranking if r["window"] == name)}
        per[name] |= {f"flag_{kind}": picked(next(r for r in rows if r["window"] == name), FLAG) for kind, rows in flags.items()}
        if own := in_order([r for r in intervals if r["window"] == name]):
            per[name]["pr_auc"] = [{"scorer": r["scorer"], "pr_auc": r["average_precision"], "low": r["low"], "high": r["high"]} for r in own]
            pairs = [r for r in differences if r["window"] == name]
            per[name]["paired"] = [{"comparison": f"{r['scorer']} - {r['against']}"} | picked(r, ("difference", "low", "high", "crosses_zero")) for r in pairs]
    rates: dict[str, dict] = {name: {} for name in per}
    for r in nulls:
        rates[r["window"]][r["feature"]] = r["null_rate"]
    return facts | {"bootstrap_resamples": params.bootstrap_resamples, "trees_allowed": params.model.n_estimators, "null_rates": rates, "windows": per}


def economics(points: Sequence[dict], even: Sequence[dict], exposure: Sequence[dict], overflow: Sequence[dict], verdict: dict, moved: Sequence[dict], optimum: Sequence[dict], ceiling: int, costs: Costs) -> dict[str, Any]:
    one = of(exposure)[0]
    more = ("window", "scorer", "policy", "alerts", "caught", "exposure_recovered", "net_per_day", "precision_at_k", "recall", "threshold", "queue_rows", "largest_day", "carried_alerts")
    best = of(optimum)
    return {
        "base_rate": one["base_rate"], "exposure": picked(one, EXPOSURE),
        "break_even_precision": {"nothing_recovered": one["break_even_none"], "median_exposure": one["break_even_median"], "mean_exposure": one["break_even_mean"]},
        "operating_point": {f"{r['window']}/{r['scorer']}": picked(r, POINT) for r in points},
        "break_even_curve": [picked(r, BREAK_EVEN) for r in sorted(of(even), key=lambda r: r["ratio"])],
        "sensitivity": [picked(r, ("parameter", "multiplier", "value", *POINT)) for r in of(moved)],
        "overflow_comparison": [picked(r, more) for r in overflow], "overflow_verdict": verdict,
        "queue_overflow_policy": costs.queue_overflow_policy, "queue_policy_horizon_days": dict(sorted(POLICY_HORIZON.items())),
        "optimal_volume": best[0]["optimal_k"] if best else None, "daily_queue_ceiling": ceiling,
    }


def monitoring(features: dict[str, Sequence[dict]], scores: dict[str, Sequence[dict]], params: Params) -> dict[str, Any]:
    spec = params.monitoring
    return {
        "reference_window": spec.reference_window, "bins": spec.bins, "epsilon": spec.epsilon, "readings": {label: bound for bound, label in READINGS},
        "feature_drift": {w: [{"feature": r["feature"]} | picked(r, DRIFT) for r in rows] for w, rows in features.items()},
        "score_drift": {w: {r["feature"]: picked(r, SCORE_DRIFT) for r in in_order(rows, "feature")} for w, rows in scores.items()},
        "decay_by_week": None, "decay_note": DECAY_NOTE,
    }


def window_scan(rows: Sequence[dict], histories: Sequence[Window], published: Window, params: Params) -> dict[str, Any]:
    by = {w.name: w for w in histories}
    out = []
    for r in rows:
        w = by[r["window"]]
        out.append({
            "history_days": (w.label_start - w.feature_start).days, "feature_start": f"{w.feature_start:%Y-%m-%d}", "population": r["population"], "base_rate": r["base_rate"],
            "reachable_mules": r["mules"], "unscoreable_mules": r["unscoreable_mules"], "mules_in_label_window": r["mules_in_window"], "reachability": r["reachability_ceiling"],
            "graph": {key: r[column] for key, column in GRAPH.items()},
        })
    return {
        "label_window": [str(published.label_start), str(published.label_end)], "published_history_days": params.split.feature_window_days,
        "rows": sorted(out, key=lambda r: r["history_days"]),
    }


def components(window: str, profile: dict, bands: Sequence[dict]) -> dict[str, Any]:
    low, high = next((low, high) for _, low, high in BANDS if low == 4)
    return {"window": window, "graph": profile, "bands": [picked(b, ("set", "band", "accounts", "share")) for b in bands], "min_archetype_nodes": low, "max_archetype_nodes": high}


def sweep(rows: Sequence[dict], requested: Sequence[int], feasible: Sequence[int], window: Window, params: Params) -> dict[str, Any]:
    names = ("hours", "inflow_hours", "scorer", "caught", "alerts", "precision_at_k", "threshold", "net_per_day", "trees_kept")
    hours = (window.feature_end - window.feature_start).total_seconds() // 3600
    return {
        "requested_hours": list(requested), "feasible_hours": list(feasible), "infeasible_hours": [h for h in requested if h not in feasible],
        "configured_hours": params.pass_through_window_hours, "feature_window_hours": int(hours),
        "rows": [picked(r, names) for r in sorted(rows, key=lambda r: (r["hours"], SCORERS.index(r["scorer"])))],
    }


def brief(sampled: Sequence[dict], alerts: int, params: Params) -> dict[str, Any]:
    return {
        "scorer": params.brief.scorer, "alerts": alerts, "sample": len(sampled), "mules_in_sample": sum(b["is_mule"] for b in sampled),
        "standout_percentile": params.brief.standout_percentile,
    }
