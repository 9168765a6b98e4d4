import json

import pytest

from credence.cli import main, parser
from credence.config import PipelineConfig, ScreenerConfig, SearchConfig
from credence.operators.counts import CountStore
from credence.plans import experiments as ex
from credence.plans.pipeline import BayesNetClassifier
from credence.plans.report import markdown_table, positioning, results
from credence.sources.datasets import Dataset, GraphFolderAdapter, InMemoryAdapter, MissingDataset, SyntheticAdapter, holdout, read_csv, registry, suites
from credence.sources.generators import materialize_expert_networks, mixed_dataset

QUICK = PipelineConfig("label", screener=ScreenerConfig(epochs=1, bootstraps=1), search=SearchConfig(max_iters=2))


def test_csv_types_and_nulls(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b,c,d\n1,x,NA,true\n2,,2.5,false\n")
    df = read_csv(spark, str(tmp_path / "f.csv"))
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double"), ("d", "boolean")]
    assert [tuple(r) for r in df.collect()] == [(1, "x", None, True), (2, None, 2.5, False)]


def test_graph_folder(spark, tmp_path):
    (tmp_path / "frame.csv").write_text("x0,x1,label\n0,1,yes\n1,0,no\n")
    (tmp_path / "edges.csv").write_text("source,target\nx0,label\nx1,ghost\n")
    a = GraphFolderAdapter(str(tmp_path), "g")
    d = a.load(spark)
    assert a.available() and d.target == "label" and d.regime == "known_graph" and "ghost" in d.truth.nodes
    (tmp_path / "metadata.json").write_text(json.dumps({"target_column": "x1"}))
    assert a.load(spark).target == "x1"
    with pytest.raises(MissingDataset):
        GraphFolderAdapter(str(tmp_path / "none"), "g").load(spark)


def test_splits_are_exact_disjoint_and_repeatable(spark):
    df = spark.range(200).selectExpr("id", "case when id % 4 = 0 then 'a' else 'b' end as y")
    one, two = (holdout(df, 3, 0.2, 0.2, "y").collect() for _ in range(2))
    assert sorted(one) == sorted(two) and len(one) == 200
    count = lambda s, y: sum(r["split"] == s and r["y"] == y for r in one)
    assert (count("test", "a"), count("valid", "a"), count("test", "b"), count("valid", "b")) == (10, 8, 30, 24)


def test_generators(spark, tmp_path):
    df, g = mixed_dataset(spark, 120, 5, 3)
    assert df.count() == 120 and g.acyclic() and set(r[0] for r in df.select("label").distinct().collect()) <= {"yes", "no"}
    (tmp_path / "e" / "child").mkdir(parents=True)
    (tmp_path / "e" / "child" / "edges.csv").write_text("source,target\nA,LowerBodyO2\nB,A\n")
    out = materialize_expert_networks(spark, str(tmp_path / "o"), ["child", "alarm"], edges_from=str(tmp_path / "e"))
    assert out["child"]["rows"] == 2500 and out["alarm"]["status"] == "skipped"
    assert materialize_expert_networks(spark, str(tmp_path / "o"), ["child"], overwrite=False, edges_from=str(tmp_path / "e"))["child"]["status"] == "exists"
    assert GraphFolderAdapter(str(tmp_path / "o" / "child"), "child").load(spark).frame.count() == 2500


def test_estimator_predicts_without_target_and_repeats(spark):
    df, g = mixed_dataset(spark, 140, 5, 5)
    models = [BayesNetClassifier(QUICK, g, "known_graph").fit(df) for _ in range(2)]
    assert models[0].report.edges == models[1].report.edges and models[0].report.pools == models[1].report.pools
    out = models[0].transform(df.drop("label"))
    assert out.count() == 140 and "label" not in out.columns
    r = out.first()
    assert sum(r["probabilities"]) == pytest.approx(1) and r["predicted"] in ("yes", "no")
    assert "shd" in models[0].report.structural and models[0].report.search.graph.acyclic()


def test_suite_tables_skips_and_reports(spark, tmp_path):
    adapters = registry(str(tmp_path)) | {"synthetic_tiny": SyntheticAdapter("synthetic_tiny", 120, 4, repeats=1)}
    p = ex.run_suite(spark, "smoke", QUICK, datasets=["synthetic_tiny", "alarm"], baselines=["neural_screened_bn", "naive_bayes", "aode", "xgboost"], labels=["default", "mi_filter_fast"], adapters=adapters, output=str(tmp_path / "s.json"))
    status = {(r["dataset_name"], r["model_name"], r["ablation_label"]): r["status"] for r in p["records"]}
    assert status["synthetic_tiny", "neural_screened_bn", "default"] == "ok", p["records"]
    assert status["synthetic_tiny", "neural_screened_bn", "mi_filter_fast"] == "ok"
    assert status["synthetic_tiny", "aode", "default"] == "ok" and status["alarm", "naive_bayes", "default"] == "skipped"
    assert {r["model_name"] for r in p["tables"]["predictive_leaderboard"]} >= {"neural_screened_bn", "naive_bayes", "aode"}
    assert json.loads((tmp_path / "s.json").read_text())["suite_name"] == "smoke"
    for name in ("paper_minimum_full", "known_graph_fast_probe"):
        ex.write_json(p, str(tmp_path / f"{name}.json"))
    summary = ex.summarize_evidence(spark, {"paper_minimum_full": p}, ["paper_minimum_full", "sanity_default"], str(tmp_path))
    assert summary["decision"]["verdict"] == "no_go" and summary["completed_stages"] == ["paper_minimum_full"]
    ex.write_json(summary, str(tmp_path / "evidence_summary.json"))
    assert positioning(spark, str(tmp_path))["headline_verdicts"] and results(spark, str(tmp_path))["structural_table"]
    assert "## Structure" in (tmp_path / "paper_results.md").read_text()


def test_in_memory_adapter_stratifies_real_sets(spark):
    df = spark.range(100).selectExpr("id % 7 as x", "case when id < 20 then 'p' else 'q' end as y")
    (s,) = InMemoryAdapter(Dataset("m", df, "y")).splits(spark, 7)
    assert s.test.where("y = 'p'").count() == 4 and s.train.count() + s.valid.count() + s.test.count() == 100


def test_registries_and_cli(capsys):
    assert len(registry()) == 9 and set(suites()) == {"smoke", "paper_minimum"} and len(ex.runners()) == 10 and len(ex.stages()) == 5
    assert main(["baselines"])["tabm"]["available"] is False
    assert parser().parse_args(["run-suite", "smoke", "--seeds", "7", "8"]).seeds == [7, 8]
    with pytest.raises(ValueError):
        ex.resolve_device("cuda")
    with ex.temporary_env(CREDENCE_TEST="1"):
        import os

        assert os.environ["CREDENCE_TEST"] == "1"
    assert markdown_table([{"a": True, "b": None, "c": 0.5}], [("a", "A"), ("b", "B"), ("c", "C")]).endswith("| yes | - | 0.5000 |")
    assert "(none)" in markdown_table([], [("a", "A")])


def test_checkpoint_discovery(tmp_path):
    import os

    for i, n in enumerate(("old.ckpt", "new.ckpt")):
        (tmp_path / n).write_text("")
        os.utime(tmp_path / n, (i, i))
    assert ex.find_checkpoint({"TABPFN_MODEL_CACHE_DIR": str(tmp_path)}).endswith("new.ckpt")


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    from credence.streaming.counts import count_stream, totals

    rows = [(i % 2, i % 3) for i in range(50)]
    spark.createDataFrame(rows, "a int, b int").repartition(3).write.parquet(str(tmp_path / "in"))
    families, cards = [("a", ()), ("b", ("a",))], {"a": 2, "b": 3}
    s = spark.readStream.schema("a int, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    count_stream(s, families, cards, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    store = CountStore(spark.createDataFrame(rows, "a int, b int"))
    got = {(r["f"], r["q"], r["v"]): r["n"] for r in totals(spark, str(tmp_path / "out")).collect()}
    for i, f in enumerate(families):
        for q, row in enumerate(store.get(*f)):
            for v, n in enumerate(row):
                assert got.get((i, q, v), 0) == n
