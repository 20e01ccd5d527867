"""The ledger file, every stage on it, the stream, and the driver contract."""

from __future__ import annotations

import random
import subprocess
import sys
from dataclasses import replace
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgersift.config import SchemaError, load_params, read_metrics
from ledgersift.operators import worklist
from ledgersift.plans import stages
from ledgersift.sources import ledger
from ledgersift.streaming.worklist import CANDIDATE, StreamingWorklist

LINES = [
    "2022/09/01 00:20,010,AAA,020,BBB,100.00,Euro,100.00,Euro,ACH,0",
    "2022/09/01 00:21,020,BBB,030,AAA,50.00,US Dollar,45.00,Euro,Wire,1",
    "2022/09/01 00:22,010,AAA,010,AAA,7.00,Euro,7.00,Euro,ACH,1",
    "2022/09/02 00:22,030,AAA,010,AAA,7.00,Euro,7.00,Euro,ACH,0",
]


def _file(path, lines, header=ledger.HEADER):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_csv(spark, tmp_path):
    loaded = ledger.load_csv(spark, _file(tmp_path / "a.csv", LINES))
    assert (loaded.rows, loaded.n_accounts, loaded.self_transfers, loaded.laundering_rows, loaded.laundering_dropped) == (4, 3, 1, 1, 1)
    book = {r.account_key: r.account for r in loaded.accounts.collect()}
    assert book == {"010|AAA": 0, "020|BBB": 1, "030|AAA": 2}  # one codebook, senders first, the bank is part of the key
    first = loaded.transactions.orderBy("row_id").first()
    assert (first.account_from, first.account_to, first.ts) == (0, 1, datetime(2022, 9, 1, 0, 20))
    kept = ledger.load_csv(spark, _file(tmp_path / "b.csv", LINES), drop_self_transfers=False)
    assert (kept.transactions.count(), kept.self_transfers, kept.laundering_dropped) == (4, 1, 0)
    spec = load_params().data
    with pytest.raises(SchemaError, match="rows: 4.*accounts: 3"):
        ledger.validate_contract(loaded, spec)
    ledger.validate_contract(loaded, replace(spec, expected_rows=4, expected_accounts=3, expected_self_transfers=1, expected_laundering_rows=2))


def test_csv_header(spark, tmp_path):
    with pytest.raises(SchemaError, match="header"):
        ledger.load_csv(spark, _file(tmp_path / "c.csv", LINES, ledger.HEADER.replace("To Bank", "Bank")))
    with pytest.raises(SchemaError, match="cannot be read"):
        ledger.load_csv(spark, str(tmp_path / "none.csv"))


def _ledger_lines(n=4000, accounts=60):
    rng = random.Random(3)
    out = []
    for _ in range(n):
        t = datetime(2022, 9, 1) + timedelta(minutes=rng.randrange(10 * 1440))
        a, b = rng.sample(range(accounts), 2)
        m = rng.choice([20, 150, 400, 1000]) + rng.random()
        out.append(f"{t:%Y/%m/%d %H:%M},0{a % 4},A{a},0{b % 4},A{b},{m:.2f},Euro,{m * 1.01:.2f},US Dollar,ACH,{int(b < 12 and rng.random() < 0.3)}")
    return out


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    params = load_params()
    params = replace(params, costs=replace(params.costs, analyst_capacity_per_day=5), bootstrap_resamples=20, experiments=replace(params.experiments, pass_through_sweep_hours=(24, 120)))
    run = stages.Run(spark, params, root)
    stages.ingest(run, _file(root / "l.csv", _ledger_lines()), check_contract=False)
    stages.features(run)
    stages.models(run, rounds=3)
    return run


WINDOW_KEYS = {"feature_start", "feature_end", "label_start", "label_end", "population", "mules", "base_rate", "unscoreable_mules", "mules_in_window", "reachability_ceiling"}
POINT_KEYS = {"alerts", "caught", "ev_missed", "ev_recovered", "exposure_recovered", "k", "missed", "net_per_day", "precision_at_k", "recall", "threshold"}
DRIFT_KEYS = {"psi", "reading", "empty_bins", "distinct_reference_edges", "epsilon_dependent"}


def test_data_metrics(run):
    data = read_metrics(run.reports / "metrics_data.json")
    assert set(data) == {
        "rows_read", "accounts", "self_transfers_dropped", "laundering_in_self_transfers", "observed_start", "observed_end", "usable_rows", "usable_start", "usable_end", "daily", "windows",
    }
    assert data["rows_read"] == 4000 and set(data["windows"]) == {"train", "val", "test"} and len(data["daily"]) == 10
    assert all(set(w) == WINDOW_KEYS for w in data["windows"].values()) and data["windows"]["test"]["label_end"] == "2022-09-11 00:00:00" == data["usable_end"]
    assert all(set(d) == {"transactions", "laundering", "laundering_share"} for d in data["daily"].values())


def test_stages(run):
    got = stages.economics(run)
    assert set(got) - {"by_scorer"} == {
        "base_rate", "break_even_curve", "break_even_precision", "daily_queue_ceiling", "exposure", "operating_point", "optimal_volume", "overflow_comparison", "overflow_verdict",
        "queue_overflow_policy", "queue_policy_horizon_days", "sensitivity",
    }
    assert len(got["operating_point"]) == 6 and all(r["alerts"] <= 10 and set(r) == POINT_KEYS for r in got["operating_point"].values())
    assert set(got["exposure"]) == {"count", "mean", "median", "top_1_share", "top_5_share", "total"} and set(got["break_even_precision"]) == {"mean_exposure", "median_exposure", "nothing_recovered"}
    assert len(got["break_even_curve"]) == 19 and set(got["break_even_curve"][0]) == {"budget_binds", "cost_missed_mule_eur", "net_at_budget", "net_at_optimum", "optimal_at_grid_edge", "optimal_k", "ratio"}
    assert all(set(r) == POINT_KEYS | {"parameter", "multiplier", "value"} for r in got["sensitivity"]) and got["queue_policy_horizon_days"] == {"rollover_max_3d": 3, "same_day": 1}
    curve = {r["ratio"]: r["optimal_k"] for r in got["break_even_curve"]}
    assert all(k <= max(got["daily_queue_ceiling"], 5) for k in curve.values()) and 0 < got["optimal_volume"] <= max(got["daily_queue_ceiling"], 5)
    same = {(r["window"], r["scorer"]): r["caught"] for r in got["overflow_comparison"] if r["policy"] == "same_day"}
    assert all(same[tuple(name.split("/"))] == r["caught"] for name, r in got["operating_point"].items())
    watched = stages.monitoring(run)
    assert set(watched) == {"reference_window", "bins", "epsilon", "readings", "feature_drift", "score_drift", "decay_by_week", "decay_note"} and watched["readings"] == {"stable": 0.1, "moderate shift": 0.25}
    assert len(watched["feature_drift"]["test"]) == 20 and set(watched["feature_drift"]["val"][0]) == DRIFT_KEYS | {"feature", "reference_null_share", "comparison_null_share"}
    assert set(watched["score_drift"]["val"]) == {"rules", "logistic", "xgboost"} and all(set(r) == DRIFT_KEYS | {"ks"} for r in watched["score_drift"]["test"].values())
    text = stages.write_report(run)
    point = got["operating_point"]["test/rules"]
    assert f"| test | rules | {point['alerts']} | {point['caught']} |" in text and "4,000 rows read" in text
    drawn = stages.figures(run)
    assert drawn == ["daily_volume", "pr_curve_test", "pr_curve_val", "reachability_funnel", "break_even", "alert_budget"]
    funnel = (run.reports / "figures" / "reachability_funnel.csv").read_text().splitlines()
    assert funnel[0] == "window,stage_no,stage,count,share" and funnel[4].split(",")[3] == str(got["operating_point"]["test/xgboost"]["caught"])
    assert (run.reports / "figures" / "alert_budget.svg").read_text().startswith("<svg")


def test_experiments(run):
    scan = stages.window_scan(run)
    assert set(scan) == {"label_window", "published_history_days", "rows"} and scan["label_window"] == ["2022-09-09 00:00:00", "2022-09-11 00:00:00"]
    assert [r["history_days"] for r in scan["rows"]] == [4, 6, 8] and len({r["mules_in_label_window"] for r in scan["rows"]}) == 1
    assert set(scan["rows"][0]["graph"]) == {"accounts_in_triangle", "directed_edges", "max_degree", "mean_degree", "nodes", "triangles", "undirected_edges", "zero_triangle_share"}
    parts = stages.component_stage(run)
    assert set(parts) == {"window", "graph", "bands", "min_archetype_nodes", "max_archetype_nodes"} and (parts["min_archetype_nodes"], parts["max_archetype_nodes"]) == (4, 50)
    assert parts["graph"]["components"] >= 1 and [b["set"] for b in parts["bands"]] == [s for s in ("alerted by xgboost", "reachable mules", "whole scoring population") for _ in range(5)]
    sweep = stages.sweep(run, rounds=3)
    assert set(sweep) == {"requested_hours", "feasible_hours", "infeasible_hours", "configured_hours", "feature_window_hours", "rows"}
    assert {r["hours"] for r in sweep["rows"]} == {24} == set(sweep["feasible_hours"]) and sweep["infeasible_hours"] == [120] and sweep["feature_window_hours"] == 96
    made = stages.brief(run)
    assert 0 < len(made) <= 5 and (run.reports / "briefs" / f"account_{made[0]['account']}.md").is_file()
    told = read_metrics(run.reports / "metrics_brief.json")
    assert set(told) == {"scorer", "alerts", "sample", "mules_in_sample", "standout_percentile"} and told["sample"] == len(made)


def test_a_sweep_without_the_configured_hours_is_refused(run):
    other = replace(run.params, experiments=replace(run.params.experiments, pass_through_sweep_hours=(48, 120)))
    with pytest.raises(SchemaError, match="24 h are not among"):
        stages.sweep(stages.Run(run.spark, other, run.reports.parent), rounds=1)


def test_models_rank(run):
    models = read_metrics(run.reports / "metrics_models.json")
    assert set(models) - {"ranking", "rules_diagnostics"} == {
        "bootstrap_resamples", "importance", "null_rates", "scale_pos_weight", "train_clean", "train_mules", "trees_allowed", "trees_kept", "windows",
    }
    assert models["bootstrap_resamples"] == 20 and models["trees_allowed"] == 400 and models["scale_pos_weight"] == pytest.approx(models["train_clean"] / models["train_mules"])
    assert set(models["windows"]["train"]) == {"base_rate", "flag_configured", "flag_matched"}
    test = models["windows"]["test"]
    assert set(test["flag_matched"]) == {"flagged", "mules", "mules_caught", "precision", "share"} and [r["scorer"] for r in test["pr_auc"]] == ["rules", "logistic", "xgboost"]
    assert {r["comparison"] for r in test["paired"]} == {"xgboost - rules", "xgboost - logistic", "logistic - rules"} and set(test["paired"][0]) == {"comparison", "crosses_zero", "difference", "high", "low"}
    assert all(r["low"] <= r["pr_auc"] + 0.3 for r in test["pr_auc"])
    by = {(r["window"], r["scorer"]): r["average_precision"] for r in models["ranking"]}
    assert by["train", "logistic"] > by["train", "rules"] * 0.8 and 1 <= models["trees_kept"] <= 3 and len(models["importance"]) == 20


def test_usage(capsys):
    assert stages.main(["nothing"]) == 2 and "usage" in capsys.readouterr().out


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(a, datetime(2024, 1, d), rng.randint(0, 9) / 10, 0, 1.0) for d in (1, 2, 3) for a in rng.sample(range(30), 15)]
    folder = tmp_path / "in"
    for d in (1, 2, 3):
        spark.createDataFrame([r for r in rows if r[1].day == d], CANDIDATE).coalesce(1).write.mode("append").parquet(str(folder))
    stream = StreamingWorklist(spark, 4)
    query = stream.start(str(folder))
    assert query.awaitTermination(120)
    got = sorted((r.day, r.account) for r in stream.close().collect())
    batch = worklist.select_alerts(spark.createDataFrame(rows, CANDIDATE).withColumn("window", F.lit("t")), [4], ["window"], 3)
    assert got == sorted((r.day, r.account) for r in batch.collect())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) >= 55


def test_rows_of_several_files_keep_the_files_order(spark, tmp_path):
    """A small first file and a larger second one, which Spark reads first."""
    many = [LINES[0].replace("AAA", f"A{i}") for i in range(3000)]
    folder = tmp_path / "parts"
    folder.mkdir()
    _file(folder / "1.csv", LINES[:2])
    _file(folder / "2.csv", many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60k")
    try:
        loaded = ledger.load_csv(spark, str(folder))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    book = {r.account_key: r.account for r in loaded.accounts.collect()}
    assert book["010|AAA"] == 0 and book["020|BBB"] == 1 and [book[f"010|A{i}"] for i in range(3000)] == list(range(2, 3002))


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from ledgersift import scratch

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        sparkContext, conf = Context(), spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_folder(Session())


@pytest.mark.parametrize("library", ["xxhash", "zstandard"])
def test_entry_without_a_library_of_the_corpus_operators(library):
    code = f"import sys; sys.modules[{library!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) >= 55 and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
