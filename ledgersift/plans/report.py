"""The report: metrics files in, markdown out. Computes nothing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from ledgersift.config import SCORERS, SPLITS, Costs


def percent(value: float | None, places: int = 2) -> str:
    return "n/a" if value is None else f"{value:.{places}%}"


def money(value: float | None) -> str:
    return "n/a" if value is None else f"{value:,.0f} EUR"


def table(head: Sequence[str], rows: Iterable[Sequence[Any]]) -> str:
    lines = [head, ["---"] * len(head), *rows]
    return "\n".join("| " + " | ".join(str(c) for c in row) + " |" for row in lines)


def _sorted(rows: Iterable[dict], *keys: str) -> list[dict]:
    order = {n: i for i, n in enumerate((*SPLITS, *SCORERS))}
    return sorted(rows, key=lambda r: tuple(order.get(r[k], r[k]) if isinstance(r[k], str) else r[k] for k in keys))


def windows_section(data: dict) -> str:
    rows = [
        (w, f"{v['population']:,}", v["mules"], percent(v["base_rate"], 4), v["unscoreable_mules"], percent(v["reachability_ceiling"], 1))
        for w in SPLITS
        if (v := data["windows"].get(w))
    ]
    return table(("window", "population", "mules", "base rate", "without history", "reachable"), rows)


def ranking_section(models: dict) -> str:
    bounds = {(w, r["scorer"]): r for w, own in models["windows"].items() for r in own.get("pr_auc", ())}
    rows = []
    for r in _sorted(models["ranking"], "window", "scorer"):
        b = bounds.get((r["window"], r["scorer"]))
        lift = f"{r['lift']:.1f}" if r["lift"] is not None else "n/a"
        rows.append((r["window"], r["scorer"], _six(r["average_precision"]), f"{_six(b['low'])} to {_six(b['high'])}" if b else "not resampled", lift))
    return table(("window", "scorer", "average precision", "95 % interval", "lift"), rows)


def _six(value: float | None) -> str:
    return "n/a" if value is None else f"{value:.6f}"


def operating_section(economics: dict) -> str:
    points = [dict(zip(("window", "scorer"), name.split("/"), strict=True)) | r for name, r in economics["operating_point"].items()]
    rows = [
        (r["window"], r["scorer"], r["alerts"], r["caught"], r["missed"], percent(r["precision_at_k"]), percent(r["recall"]), money(r["net_per_day"]))
        for r in _sorted(points, "window", "scorer")
    ]
    return table(("window", "scorer", "alerts", "caught", "missed", "precision", "recall", "net a day"), rows)


def overflow_table(rows: Sequence[dict]) -> str:
    shown = [
        (r["window"], r["scorer"], r["policy"], f"{r['queue_rows']:,}", r["carried_alerts"], r["caught"], money(r["net_per_day"]))
        for r in _sorted(rows, "window", "scorer", "policy")
    ]
    return table(("window", "scorer", "policy", "queue rows", "carried", "caught", "net a day"), shown)


def moved_table(rows: Sequence[dict]) -> str:
    """Costs moved one at a time."""
    shown = [(r["parameter"], f"{r['multiplier']:g}", f"{r['value']:g}", r["alerts"], r["caught"], percent(r["precision_at_k"]), money(r["net_per_day"])) for r in rows]
    return table(("setting", "times", "value", "alerts", "caught", "precision", "net a day"), shown)


def overflow_section(economics: dict) -> str:
    v = economics["overflow_verdict"]
    said = (
        f"Against {economics['queue_overflow_policy']}, carrying the backlog catches more in {v['improved']}, fewer in {v['worsened']} and as many in {v['unchanged']} of the cases "
        f"(at most {v['largest_gain']} more, {v['largest_loss']} fewer)."
    )
    return overflow_table(economics["overflow_comparison"]) + "\n\n" + said


def break_even_section(economics: dict) -> str:
    head = ("window", "scorer", "precision needed, nothing recovered", "median exposure", "mean exposure", "base rate", "a random alert at mean exposure")
    rows = []
    for r in _sorted(economics["by_scorer"]["exposure"], "window", "scorer"):
        needs = [percent(r[c], 4) for c in ("break_even_none", "break_even_median", "break_even_mean", "base_rate")]
        rows.append((r["window"], r["scorer"], *needs, "covers its cost" if r["random_alerts_pay_at_mean"] else "loses money"))
    most, budget = economics["optimal_volume"], economics["operating_point"]
    bound = "" if most is None else f"\n\nWithout a budget the best daily volume is {most:,}, of a queue of up to {economics['daily_queue_ceiling']:,} a day ({len(budget)} operating points above)."
    return table(head, rows) + bound


def _drift_rows(rows: Iterable[dict]) -> list[tuple]:
    out = []
    for r in rows:
        known = r["psi"] is not None
        flag = ("flag" if r["epsilon_dependent"] else "magnitude") if known else "n/a"
        out.append((r["feature"], f"{r['psi']:.4f}" if known else "n/a", r["reading"], r["empty_bins"] if known else "n/a", flag, *([f"{r['ks']:.4f}"] if r.get("ks") is not None else [])))
    return out


def drift_section(monitoring: dict) -> str:
    parts, reference = [], monitoring["reference_window"]
    head = ("name", "PSI", "reading", "empty bins", "read as")
    for later, rows in monitoring["feature_drift"].items():
        parts.append(f"### {reference} to {later}, features\n\n" + table(head, _drift_rows(rows)))
        scores = [{"feature": name} | r for name, r in monitoring["score_drift"][later].items()]
        parts.append(f"### {reference} to {later}, scores\n\n" + table((*head, "KS"), _drift_rows(scores)))
    return "\n\n".join([*parts, monitoring["decay_note"]])


def build(data: dict, models: dict, economics: dict, monitoring: dict, costs: Costs) -> str:
    """The whole report."""
    head = f"{data['rows_read']:,} rows read, {data['accounts']:,} accounts, {data['self_transfers_dropped']:,} self-transfers, {data['usable_rows']:,} usable rows."
    sections = (
        ("Data", head + "\n\n" + windows_section(data)), ("Ranking", ranking_section(models)), ("Operating point", operating_section(economics)), ("Queue overflow", overflow_section(economics)),
        ("Break-even", break_even_section(economics)), ("Drift", drift_section(monitoring)),
    )
    body = "\n\n".join(f"## {title}\n\n{text}" for title, text in sections)
    return f"# Receiving-account risk\n\n{body}\n\nAssumptions: {costs.as_footer()}.\n"
