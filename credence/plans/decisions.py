"""Leaderboards and decisions as DataFrame aggregations over run records.

A record table has one row a run: model_name, dataset_name, dataset_regime, split_id, ablation_label, status, notes, and
the maps predictive, structural, diagnostics and runtimes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of models, sets and stages that records and rules go by, and the keys of the payloads below.
METHOD = "neural_screened_bn"
GREEDY = "greedy_hc_bn"
EXPLICIT = [GREEDY, "naive_bayes", "tan", "kdb", "aode"]
STRONG = ["xgboost", "lightgbm", "catboost", "tabpfn"]
EXPERT = ["alarm", "child", "insurance"]
STAGE_PRIORITY = ["paper_minimum_full", "structural_default", "sanity_default"]
PROBED = ["known_graph_fast", "mi_filter_fast", "single_pass_neural_fast", "hybrid_mi_neural_fast"]

RECORD = "model_name string, dataset_name string, dataset_regime string, split_id string, seed int, ablation_label string, family string, status string, notes array<string>, predictive map<string,double>, structural map<string,double>, diagnostics map<string,double>, runtimes map<string,double>"


def metric(name: str):
    """A metric of a record: from the predictive values, else the structural ones, else the diagnostics."""
    return F.coalesce(F.try_element_at("predictive", F.lit(name)), F.try_element_at("structural", F.lit(name)), F.try_element_at("diagnostics", F.lit(name)))


def leaderboard(records: DataFrame, metrics: list[str], runtimes: list[str] = (), keys: tuple[str, ...] = ("dataset_name", "model_name")) -> DataFrame:
    """Means by group; null where no run of the group has the metric."""
    cols = [F.avg(metric(m)).alias(f"avg_{m}") for m in metrics] + [F.avg(F.try_element_at("runtimes", F.lit(r))).alias(f"avg_{r}") for r in runtimes]
    return records.groupBy(*keys).agg(*cols, F.count(F.lit(1)).alias("num_runs"))


def suite_tables(records: DataFrame) -> dict[str, DataFrame]:
    ok = records.where(F.col("status") == "ok")
    default = ok.where(F.col("ablation_label") == "default")
    varied = ok.where((F.col("ablation_label") != "default") & (F.col("model_name") == METHOD))
    return {
        "predictive_leaderboard": leaderboard(default, ["roc_auc", "log_loss", "brier", "ece"]),
        "structural_leaderboard": leaderboard(default.where(F.map_contains_key("structural", "shd")), ["shd", "precision", "recall", "f1", "candidate_parent_recall"]),
        "search_complexity": leaderboard(default, ["candidate_pool_reduction", "predicted_edge_count"], ["total_seconds", "search_seconds"]),
        "ablation_summary": leaderboard(varied, ["roc_auc", "log_loss", "shd", "candidate_pool_reduction"], ["total_seconds", "screener_seconds", "search_seconds"], ("dataset_name", "ablation_label")),
        "skipped_items": records.where(F.col("status") != "ok").select("dataset_name", "model_name", "split_id", "status", "notes"),
    }


def structural_comparison(structural: DataFrame, complexity: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row a known-graph dataset (dataset_name): the method against the best explicit network, and run times. Ties go to
    the model first in name order."""
    rows = structural.join(datasets, "dataset_name", "left_semi")
    mine = rows.where(F.col("model_name") == METHOD).select("dataset_name", F.col("avg_shd").alias("method_shd"))
    best = rows.where(F.col("model_name").isin(EXPLICIT)).groupBy("dataset_name").agg(F.min(F.struct("avg_shd", "model_name")).alias("b")).select("dataset_name", F.col("b.model_name").alias("best_explicit_model"), F.col("b.avg_shd").alias("best_explicit_shd"))
    secs = lambda model, name: complexity.where(F.col("model_name") == model).select("dataset_name", F.col("avg_total_seconds").alias(name))
    out = mine.join(best, "dataset_name").join(secs(METHOD, "method_total_seconds"), "dataset_name", "left").join(secs(GREEDY, "greedy_hc_total_seconds"), "dataset_name", "left")
    return out.withColumn("shd_delta", F.col("best_explicit_shd") - F.col("method_shd"))


def predictive_comparison(predictive: DataFrame, datasets: DataFrame) -> DataFrame:
    rows = predictive.join(datasets, "dataset_name", "left_semi")
    mine = rows.where(F.col("model_name") == METHOD).select("dataset_name", F.col("avg_roc_auc").alias("method_roc_auc"))
    best = rows.where(F.col("model_name").isin(STRONG)).groupBy("dataset_name").agg(F.min(F.struct((-F.col("avg_roc_auc")).alias("neg"), "model_name")).alias("b")).select("dataset_name", F.col("b.model_name").alias("best_strong_model"), (-F.col("b.neg")).alias("best_strong_roc_auc"))
    out = mine.join(best, "dataset_name").withColumn("roc_auc_gap", F.col("best_strong_roc_auc") - F.col("method_roc_auc"))
    return out.withColumn("competitive", F.col("roc_auc_gap") <= 0.03)


def criteria(structural: DataFrame, predictive: DataFrame) -> DataFrame:
    """One row: counts of comparable sets and wins, and whether each rule is met on at least half of its sets."""
    timed = F.col("method_total_seconds").isNotNull() & F.col("greedy_hc_total_seconds").isNotNull()
    s = structural.agg(F.count(F.lit(1)).alias("structural_datasets"), F.count_if(F.col("shd_delta") > 0).alias("structural_wins"), F.count_if(timed).alias("runtime_datasets"), F.count_if(timed & (F.col("method_total_seconds") < F.col("greedy_hc_total_seconds"))).alias("runtime_wins"))
    p = predictive.agg(F.count(F.lit(1)).alias("predictive_datasets"), F.count_if("competitive").alias("predictive_wins"))
    half = lambda k: ((F.col(f"{k}_datasets") > 0) & (F.col(f"{k}_wins") >= F.ceil(F.col(f"{k}_datasets") / 2))).alias(f"{k}_pass")
    return s.crossJoin(p).select("*", half("structural"), half("runtime"), half("predictive"))  # two rows of one


RULES = {
    "structural": "SHD below the best explicit network on at least half of the comparable known-graph sets.",
    "runtime": "Total time below greedy hill climbing on at least half of the known-graph sets with both times.",
    "predictive": "ROC-AUC within 0.03 of the best strong baseline on at least half of the comparable real sets.",
    "health": "The full stage is complete, the foundation model ran on a known-graph and on a real set, and the expert sets have no skipped run.",
}


def evidence_decision(stages: dict[str, DataFrame]) -> dict:
    """stages: records of each completed stage."""
    basis = next((s for s in STAGE_PRIORITY if s in stages), None)
    if basis is None:
        return {"verdict": "incomplete", "basis_stage": None, "rule": RULES, "criteria": {}, "comparisons": {"structural": [], "predictive": []}, "reason": "No stage has been completed."}
    every = None
    for df in stages.values():
        every = df if every is None else every.unionByName(df)
    ok = every.where((F.col("status") == "ok") & (F.col("ablation_label") == "default"))
    regime = lambda r: ok.where(F.col("dataset_regime") == r).select("dataset_name").distinct()
    t = suite_tables(stages[basis])
    s = structural_comparison(t["structural_leaderboard"], t["search_complexity"], regime("known_graph")).orderBy("dataset_name")
    p = predictive_comparison(t["predictive_leaderboard"], regime("real")).orderBy("dataset_name")
    c = criteria(s, p).first().asDict()
    is_fm = (F.col("status") == "ok") & (F.col("ablation_label") == "default") & (F.col("model_name") == "tabpfn")
    health = every.agg(F.bool_or(is_fm & (F.col("dataset_regime") == "known_graph")).alias("tabpfn_known_graph_ok"), F.bool_or(is_fm & (F.col("dataset_regime") == "real")).alias("tabpfn_real_ok"), (~F.bool_or((F.col("status") != "ok") & F.col("dataset_name").isin(EXPERT))).alias("expert_skip_free")).first().asDict()
    c |= {k: bool(v) if v is not None else k == "expert_skip_free" for k, v in health.items()}
    c["full_stage_complete"] = "paper_minimum_full" in stages
    if not c["full_stage_complete"]:
        verdict, reason = "incomplete", "The full stage has not been completed."
    elif all(c[k] for k in ("structural_pass", "runtime_pass", "predictive_pass", "tabpfn_known_graph_ok", "tabpfn_real_ok", "expert_skip_free")):
        verdict, reason = "go", "All rules are met."
    else:
        verdict, reason = "no_go", "At least one rule is not met."
    return {"verdict": verdict, "basis_stage": basis, "rule": RULES, "criteria": c, "comparisons": {"structural": [r.asDict() for r in s.collect()], "predictive": [r.asDict() for r in p.collect()]}, "reason": reason}


def promotion_rows(tables: dict[str, DataFrame], labels: list[str] = PROBED) -> DataFrame:
    """ablation_label, dataset_name and the three comparisons with the default and with greedy search."""
    pick = lambda t, model, col, name: t.where(F.col("model_name") == model).select("dataset_name", F.col(col).alias(name))
    s, c = tables["structural_leaderboard"], tables["search_complexity"]
    rows = tables["ablation_summary"].where(F.col("ablation_label").isin(labels)).select("dataset_name", "ablation_label", F.col("avg_total_seconds").alias("candidate_total_seconds"), F.col("avg_shd").alias("candidate_shd"))
    rows = rows.join(pick(s, METHOD, "avg_shd", "default_shd").where(F.col("default_shd").isNotNull()), "dataset_name")
    rows = rows.join(pick(c, METHOD, "avg_total_seconds", "default_total_seconds"), "dataset_name", "left").join(pick(c, GREEDY, "avg_total_seconds", "greedy_hc_total_seconds"), "dataset_name", "left")
    no = F.lit(False)
    return rows.select(
        "*",
        (F.col("candidate_total_seconds") - F.col("default_total_seconds")).alias("runtime_delta_vs_default"),
        (F.col("candidate_shd") - F.col("default_shd")).alias("shd_delta_vs_default"),
        F.coalesce(F.col("candidate_total_seconds") < F.col("default_total_seconds"), no).alias("faster_than_default"),
        F.coalesce(F.col("candidate_total_seconds") < F.col("greedy_hc_total_seconds"), no).alias("faster_than_greedy_hc"),
        F.coalesce(F.col("candidate_shd") <= F.col("default_shd") + 2.0, no).alias("within_default_plus_two_shd"),
    )


def promotion_gates(rows: DataFrame, records: DataFrame, labels: list[str] = PROBED) -> DataFrame:
    """One row a label: faster than the default everywhere, than greedy search on 3 sets or more, SHD near the default's on
    4 or more, nothing skipped."""
    spark = rows.sparkSession
    all_ = spark.createDataFrame([(x,) for x in labels], "ablation_label string")
    g = rows.groupBy("ablation_label").agg(F.bool_and("faster_than_default").alias("all_faster"), F.count_if("faster_than_greedy_hc").alias("runtime_vs_greedy_win_count"), F.count_if("within_default_plus_two_shd").alias("shd_within_default_plus_two_count"))
    skip = records.where((F.col("model_name") == METHOD) & (F.col("dataset_regime") == "known_graph") & (F.col("status") != "ok")).groupBy("ablation_label").agg(F.count(F.lit(1)).alias("skipped_runs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = all_.join(g, "ablation_label", "left").join(skip, "ablation_label", "left").select("ablation_label", F.coalesce("all_faster", F.lit(False)).alias("runtime_faster_than_default_all"), zero("runtime_vs_greedy_win_count"), zero("shd_within_default_plus_two_count"), zero("skipped_runs"))
    ok = F.col("runtime_faster_than_default_all") & (F.col("runtime_vs_greedy_win_count") >= 3) & (F.col("shd_within_default_plus_two_count") >= 4) & (F.col("skipped_runs") == 0)
    return out.withColumn("promotable", ok)
