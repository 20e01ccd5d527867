"""Figures of a run: each is a table (CSV) and a drawing of it (SVG, no plotting library needed), with the cost assumptions below.

Six figures: daily volume, precision-recall for the two later windows, the reachability funnel, break-even precision, the alert budget.
"""

from __future__ import annotations

import csv
import math
from collections.abc import Sequence
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.config import Costs

WIDTH, HEIGHT, LEFT, TOP, BOTTOM = 760, 300, 90, 40, 50
INK = ("#1f4e79", "#b3541e", "#3d7a4a", "#6b6b6b")


def write_table(path: Path, rows: Sequence[dict]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, fieldnames=list(rows[0]) if rows else ["empty"])
        writer.writeheader()
        writer.writerows(rows)


def _scale(values: Sequence[float], log: bool) -> tuple:
    put = (lambda v: math.log10(max(v, 1e-9))) if log else (lambda v: v)
    low, high = min(map(put, values), default=0.0), max(map(put, values), default=1.0)
    return put, low if log else min(low, 0.0), high if high > low else low + 1.0


class Drawing:
    """Panels of lines or bars, one below another, each with its own scale."""

    def __init__(self, title: str, footer: str):
        self.title, self.footer, self.parts, self.panels = title, footer, [], 0

    def _text(self, x: float, y: float, text: str, anchor: str = "start", size: int = 11) -> None:
        self.parts.append(f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" text-anchor="{anchor}" font-family="sans-serif">{escape(text)}</text>')

    def lines(self, label: str, series: dict[str, Sequence[tuple[float, float]]], *, log_x: bool = False, marks: Sequence[float] = (), floors: Sequence[float] = ()) -> None:
        top = TOP + self.panels * HEIGHT
        points = [p for s in series.values() for p in s]
        px, x0, x1 = _scale([x for x, _ in points] + list(marks), log_x)
        py, y0, y1 = _scale([y for _, y in points] + list(floors), False)
        span, tall = WIDTH - LEFT - 30, HEIGHT - BOTTOM - 20
        at = lambda x, y: (LEFT + span * (px(x) - x0) / (x1 - x0), top + 10 + tall * (1 - (py(y) - y0) / (y1 - y0)))
        for i, (name, s) in enumerate(series.items()):
            path = " ".join(f"{x:.1f},{y:.1f}" for x, y in (at(*p) for p in s))
            self.parts.append(f'<polyline fill="none" stroke="{INK[i % len(INK)]}" stroke-width="2" points="{path}"/>')
            self._text(WIDTH - 30, top + 20 + 14 * i, name, "end")
        for m in marks:
            x = at(m, y0)[0]
            self.parts.append(f'<line x1="{x:.1f}" x2="{x:.1f}" y1="{top + 10}" y2="{top + 10 + tall}" stroke="{INK[3]}" stroke-dasharray="4"/>')
        for f in floors:
            y = at(10**x0 if log_x else x0, f)[1]
            self.parts.append(f'<line x1="{LEFT}" x2="{LEFT + span}" y1="{y:.1f}" y2="{y:.1f}" stroke="{INK[3]}" stroke-dasharray="4"/>')
        self._text(LEFT - 6, top + 16, f"{y1:.4g}", "end")
        self._text(LEFT - 6, top + 10 + tall, f"{y0:.4g}", "end")
        self._text(LEFT, top + HEIGHT - BOTTOM + 8, label)
        self.panels += 1

    def bars(self, label: str, values: Sequence[tuple[str, float, str]], *, log: bool = False) -> None:
        top = TOP + self.panels * HEIGHT
        put, low, high = _scale([v for _, v, _ in values], log)
        low = low - 0.5 if log else low
        tall = (HEIGHT - BOTTOM) / max(1, len(values))
        for i, (name, value, shown) in enumerate(values):
            y, long = top + 10 + i * tall, (WIDTH - LEFT - 330) * (put(value) - low) / (high - low)
            self.parts.append(f'<rect x="{LEFT + 150}" y="{y:.1f}" width="{max(long, 0):.1f}" height="{tall * 0.6:.1f}" fill="{INK[0]}"/>')
            self._text(LEFT + 144, y + tall * 0.4, name, "end", 10)
            self._text(LEFT + 156 + max(long, 0), y + tall * 0.4, shown, size=10)
        self._text(LEFT, top + HEIGHT - BOTTOM + 24, label)
        self.panels += 1

    def save(self, path: Path) -> None:
        height = TOP + self.panels * HEIGHT + 30
        path.parent.mkdir(parents=True, exist_ok=True)
        self._text(LEFT, 22, self.title, size=14)
        self._text(LEFT, height - 12, self.footer, size=9)
        path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height}">' + "".join(self.parts) + "</svg>\n", encoding="utf-8")


def funnel_stages(queue: DataFrame, missing: DataFrame, alerts: DataFrame) -> DataFrame:
    """``window, stage_no, stage, count, share``: mules in the window, reachable ones, alerts of the budget, mules caught; shares of the first."""
    reach = queue.filter("is_mule = 1").groupBy("window").agg(F.countDistinct("account").alias("reachable"))
    lost = missing.groupBy("window").agg(F.count("*").alias("lost"))
    done = alerts.groupBy("window").agg(F.count("*").alias("alerts"), F.count_if(F.col("is_mule") == 1).alias("caught"))
    wide = done.join(reach, "window", "left").join(lost, "window", "left").fillna(0, ["reachable", "lost"]).withColumn("all", F.col("reachable") + F.col("lost"))
    steps = (("mules active in the label window", "all"), ("reachable by the feature window", "reachable"), ("alerts the budget allows", "alerts"), ("caught", "caught"))
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), F.col(c).alias("count")) for i, (s, c) in enumerate(steps)]))
    return wide.select("window", "all", rows).select("window", "stage_no", "stage", "count", F.try_divide(F.col("count").cast("double"), F.col("all")).alias("share"))


def draw_all(folder: Path, costs: Costs, *, daily: Sequence[dict], cutoff: str, curves: Sequence[dict], base_rates: dict[str, float], funnel: Sequence[dict], exposure: dict, budget: Sequence[dict]) -> list[str]:
    """Write every figure; returns their names."""
    footer, made = f"Assumptions: {costs.as_footer()}", []

    def keep(name: str, drawing: Drawing, rows: Sequence[dict]) -> None:
        write_table(folder / f"{name}.csv", rows)
        drawing.save(folder / f"{name}.svg")
        made.append(name)

    volume = Drawing("Payments a day, and the laundering share", footer)
    numbered = [(i, d) for i, d in enumerate(daily)]
    cut = [i for i, d in numbered if d["day"] >= cutoff][:1]
    volume.lines("payments a day (the line marks the end of the usable span)", {"payments": [(i, d["payments"]) for i, d in numbered]}, marks=cut)
    volume.lines("laundering share of the day", {"share": [(i, d["share"] or 0.0) for i, d in numbered]}, marks=cut)
    keep("daily_volume", volume, daily)
    for window in sorted({c["window"] for c in curves}):
        own = [c for c in curves if c["window"] == window]
        chart = Drawing(f"Precision and recall, {window} window", footer)
        chart.lines("recall (the line marks the base rate)", {s: sorted((c["recall"] or 0.0, c["precision"]) for c in own if c["scorer"] == s) for s in sorted({c["scorer"] for c in own})}, floors=[base_rates[window]])
        keep(f"pr_curve_{window}", chart, own)
    reach = Drawing("What can be reached before any model runs", footer)
    reach.bars("share of the mules active in the label window", [(f["stage"][:26], f["share"] or 0.0, f"{f['count']:,} ({f['share'] or 0:.1%})") for f in funnel])
    keep("reachability_funnel", reach, funnel)
    needs = [{"basis": b, "precision": exposure[k]} for b, k in (("nothing recovered", "break_even_none"), ("median exposure", "break_even_median"), ("mean exposure", "break_even_mean"), ("base rate of the queue", "base_rate")) if exposure.get(k)]
    even = Drawing("Precision at which an alert pays for itself", footer)
    even.bars("precision, logarithmic", [(n["basis"], n["precision"], f"{n['precision']:.4%}") for n in needs], log=True)
    keep("break_even", even, needs)
    chart = Drawing("What a daily alert budget buys", footer)
    for label, column in (("precision at k", "precision_at_k"), ("net, EUR a day", "net_per_day")):
        chart.lines(f"{label}, by alerts a day (logarithmic; the line marks the budget)", {s: sorted((b["k"], b[column] or 0.0) for b in budget if b["scorer"] == s and b["k"] > 0) for s in sorted({b["scorer"] for b in budget})}, log_x=True, marks=[max(1, costs.analyst_capacity_per_day)])
    keep("alert_budget", chart, budget)
    return made
