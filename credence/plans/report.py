"""Payloads and Markdown for write-ups, derived from stored suite artifacts; every number comes from the data."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .decisions import METHOD, promotion_gates, promotion_rows, suite_tables
from .experiments import as_records, read_json, records_frame, write_json


def markdown_table(rows: list[dict], columns: list[tuple[str, str]]) -> str:
    def show(v) -> str:
        return "-" if v is None else ("yes" if v else "no") if isinstance(v, bool) else f"{v:.4f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(t for _, t in columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    lines += ["| " + " | ".join(show(r.get(k)) for k, _ in columns) + " |" for r in rows] or ["| " + " | ".join(["(none)", *["-"] * (len(columns) - 1)]) + " |"]
    return "\n".join(lines)


def humanize(name: str) -> str:
    return name.removeprefix("sklearn_").replace("_", " ").capitalize()


def fast_mode_summary(spark: SparkSession, payload: dict, labels: list[str]) -> dict:
    records = records_frame(spark, as_records(payload))
    rows = promotion_rows(suite_tables(records), labels)
    gates = {r["ablation_label"]: r.asDict() for r in promotion_gates(rows, records, labels).collect()}
    got = [r.asDict() for r in rows.orderBy("ablation_label", "dataset_name").collect()]
    sets = sorted({r["dataset_name"] for r in suite_tables(records)["structural_leaderboard"].where(F.col("model_name") == METHOD).collect()})
    return {"known_graph_datasets": sets, "candidates": {x: {"dataset_rows": [r for r in got if r["ablation_label"] == x], "promotion_gate": gates[x]} for x in labels}, "promotion_winners": [x for x in labels if gates[x]["promotable"]]}


def _ratio(a, b):
    return a / b if a is not None and b else None


def positioning(spark: SparkSession, folder: str = "artifacts/benchmarks") -> dict:
    decision = read_json(files.join(folder, "evidence_summary.json"))["decision"]
    fast = fast_mode_summary(spark, read_json(files.join(folder, "known_graph_fast_probe.json")), ["known_graph_fast"])
    c, s, p = decision["criteria"], decision["comparisons"]["structural"], decision["comparisons"]["predictive"]
    runtime = [{"dataset_name": r["dataset_name"], "method_total_seconds": r["method_total_seconds"], "greedy_hc_total_seconds": r["greedy_hc_total_seconds"], "runtime_ratio_vs_greedy": _ratio(r["method_total_seconds"], r["greedy_hc_total_seconds"]), "runtime_win": None if r["method_total_seconds"] is None or r["greedy_hc_total_seconds"] is None else r["method_total_seconds"] < r["greedy_hc_total_seconds"]} for r in s]
    trade = fast["candidates"]["known_graph_fast"]
    gains = sum((r["shd_delta_vs_default"] or 0) < 0 for r in trade["dataset_rows"])
    score = lambda k: f"{c.get(f'{k}_wins', 0)}/{c.get(f'{k}_datasets', 0)}"
    verdicts = {
        "quality_first_default": {"supported": bool(c.get("structural_pass") and c.get("predictive_pass")), "message": f"structure better on {score('structural')} sets, prediction competitive on {score('predictive')}"},
        "runtime_limitation": {"supported": not c.get("runtime_pass"), "message": f"faster than greedy search on {score('runtime')} sets"},
        "fast_profile_tradeoff": {"supported": not trade["promotion_gate"]["promotable"], "message": f"the fast profile improves SHD on {gains} of {len(trade['dataset_rows'])} sets" + (" and may be promoted" if trade["promotion_gate"]["promotable"] else " and is not promoted")},
    }
    payload = {
        "artifact_dir": folder, "headline_verdicts": verdicts, "explicit_bn_structural_comparison": s, "strong_predictive_baseline_comparison": p, "runtime_vs_greedy_hc_comparison": runtime, "known_graph_fast_tradeoff": trade["dataset_rows"],
        "recommended_paper_claim_text": f"The searched network has a lower SHD than the best explicit baseline on {score('structural')} sets and stays within 0.03 ROC-AUC of the best strong baseline on {score('predictive')}.",
        "recommended_limitation_text": f"It is faster than greedy search on {score('runtime')} sets.",
    }
    write_json(payload, files.join(folder, "paper_positioning.json"))
    files.write_text(spark, files.join(folder, "paper_positioning.md"), positioning_markdown(payload))
    return payload


def positioning_markdown(p: dict) -> str:
    parts = ["# Positioning", "", "## Verdicts", *[f"- `{k}`: {v['message']}" for k, v in p["headline_verdicts"].items()], ""]
    for title, key, cols in (
        ("Structure against explicit networks", "explicit_bn_structural_comparison", ("dataset_name", "method_shd", "best_explicit_model", "best_explicit_shd", "shd_delta")),
        ("Prediction against strong baselines", "strong_predictive_baseline_comparison", ("dataset_name", "method_roc_auc", "best_strong_model", "best_strong_roc_auc", "roc_auc_gap", "competitive")),
        ("Run time against greedy search", "runtime_vs_greedy_hc_comparison", ("dataset_name", "method_total_seconds", "greedy_hc_total_seconds", "runtime_ratio_vs_greedy", "runtime_win")),
        ("Fast profile against the default", "known_graph_fast_tradeoff", ("dataset_name", "default_total_seconds", "candidate_total_seconds", "greedy_hc_total_seconds", "default_shd", "candidate_shd", "shd_delta_vs_default")),
    ):
        parts += [f"## {title}", markdown_table(p[key], [(c, c.replace("_", " ")) for c in cols]), ""]
    return "\n".join([*parts, "## Claim", p["recommended_paper_claim_text"], "", "## Limitation", p["recommended_limitation_text"], ""])


def results(spark: SparkSession, folder: str = "artifacts/benchmarks") -> dict:
    decision, full = read_json(files.join(folder, "evidence_summary.json"))["decision"], read_json(files.join(folder, "paper_minimum_full.json"))
    probe = next((x for f in ("fast_mode_design_probe.json", "known_graph_fast_probe.json") if files.exists(spark, x := files.join(folder, f))), files.join(folder, "known_graph_fast_probe.json"))
    fast = fast_mode_summary(spark, read_json(probe), ["known_graph_fast"])
    by_fast = {r["dataset_name"]: r for r in fast["candidates"]["known_graph_fast"]["dataset_rows"]}
    index = lambda t: {(r["dataset_name"], r["model_name"]): r for r in full["tables"][t]}
    st, pr, cx = index("structural_leaderboard"), index("predictive_leaderboard"), index("search_complexity")
    structural = []
    for r in decision["comparisons"]["structural"]:
        m = st[r["dataset_name"], METHOD]
        structural.append({"dataset_name": r["dataset_name"], "method_shd": m["avg_shd"], "method_precision": m.get("avg_precision"), "method_recall": m.get("avg_recall"), "method_f1": m.get("avg_f1"), "candidate_parent_recall": m.get("avg_candidate_parent_recall"), "best_explicit_model": r["best_explicit_model"], "best_explicit_shd": r["best_explicit_shd"], "shd_margin": r["best_explicit_shd"] - m["avg_shd"]})
    predictive = []
    for r in decision["comparisons"]["predictive"]:
        m, b = pr[r["dataset_name"], METHOD], pr[r["dataset_name"], r["best_strong_model"]]
        predictive.append({"dataset_name": r["dataset_name"], "method_roc_auc": m["avg_roc_auc"], "method_log_loss": m["avg_log_loss"], "method_ece": m.get("avg_ece"), "best_strong_model": r["best_strong_model"], "best_strong_roc_auc": b["avg_roc_auc"], "best_strong_log_loss": b["avg_log_loss"], "roc_auc_gap": r["roc_auc_gap"]})
    runtime = []
    for r in decision["comparisons"]["structural"]:
        n = r["dataset_name"]
        d, g = cx[n, METHOD]["avg_total_seconds"], (cx.get((n, "greedy_hc_bn")) or {}).get("avg_total_seconds")
        f = by_fast.get(n, {}).get("candidate_total_seconds")
        runtime.append({"dataset_name": n, "default_total_seconds": d, "known_graph_fast_total_seconds": f, "greedy_hc_total_seconds": g, "default_vs_greedy_ratio": _ratio(d, g), "fast_vs_greedy_ratio": _ratio(f, g), "fast_reduction_vs_default_pct": None if f is None or not d else 100 * (1 - f / d)})
    wins, near = sum(r["shd_margin"] > 0 for r in structural), sum(abs(r["shd_margin"]) <= 0.5 for r in structural)
    competitive = sum(bool(r["competitive"]) for r in decision["comparisons"]["predictive"])
    faster = sum(r["greedy_hc_total_seconds"] is not None and r["default_total_seconds"] < r["greedy_hc_total_seconds"] for r in runtime)
    top = max(structural, key=lambda r: r["shd_margin"], default=None)
    narrative = [f"Over {len(structural)} known-graph sets the method has the lower SHD on {wins} and is within 0.5 on {near}." + (f" Its largest margin is on {humanize(top['dataset_name'])}: {top['method_shd']:.2f} against {top['best_explicit_shd']:.2f}." if top else "")]
    narrative.append(f"It is competitive on {competitive} of {len(predictive)} real sets" + "".join(f"; {humanize(r['dataset_name'])}: ROC-AUC {r['method_roc_auc']:.4f}, log loss {r['method_log_loss']:.4f}" for r in predictive) + ".")
    limits = [f"It is faster than greedy search on {faster} of {len(runtime)} sets.", f"Promoted fast profiles: {', '.join(fast['promotion_winners']) or 'none'}."]
    payload = {"artifact_dir": folder, "source_artifacts": {"evidence_summary": files.join(folder, "evidence_summary.json"), "paper_minimum_full": files.join(folder, "paper_minimum_full.json"), "fast_probe": str(probe)}, "headline_metrics": {"structural_win_count": wins, "structural_dataset_count": len(structural), "structural_near_tie_count": near, "predictive_competitive_count": competitive, "predictive_dataset_count": len(predictive), "runtime_win_count_vs_greedy": faster, "runtime_dataset_count": len(runtime), "known_graph_fast_promotion_winners": fast["promotion_winners"]}, "structural_table": structural, "predictive_table": predictive, "runtime_table": runtime, "results_narrative": narrative, "limitations_narrative": limits}
    write_json(payload, files.join(folder, "paper_results.json"))
    files.write_text(spark, files.join(folder, "paper_results.md"), results_markdown(payload))
    return payload


def results_markdown(p: dict) -> str:
    parts = ["# Results", ""]
    for title, key in (("Structure", "structural_table"), ("Prediction", "predictive_table"), ("Run time", "runtime_table")):
        cols = list(p[key][0]) if p[key] else ["dataset_name"]
        parts += [f"## {title}", markdown_table(p[key], [(c, c.replace("_", " ")) for c in cols]), ""]
    return "\n".join([*parts, "## Narrative", *p["results_narrative"], "", "## Limitations", *p["limitations_narrative"], ""])
