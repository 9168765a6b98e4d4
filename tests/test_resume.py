"""A suite that was broken off goes on without repeating what it finished."""

import threading

import pytest

from credence.config import PipelineConfig, SearchConfig
from credence.plans import experiments as ex
from credence.plans.record_log import RecordLog
from credence.sources.datasets import SyntheticAdapter

CONFIG = PipelineConfig("label", use_screener=False, search=SearchConfig(max_iters=1))
MODELS = ["neural_screened_bn", "naive_bayes", "tan", "kdb"]


class Counting(ex.Runner):
    """Notes its runs; ends the program at the run of a number, or fails there."""

    def __init__(self, name, seen, stop=None, error=KeyboardInterrupt):
        super().__init__(name, "stub")
        self.seen, self.stop, self.error = seen, stop, error

    def run(self, split, config, ablation):
        if len(self.seen) == self.stop:
            raise self.error("broken off")
        self.seen.append((split.id, self.name, ablation.label, threading.get_ident()))
        return self.record(split, ablation.label, predictive={"roc_auc": 0.5}, runtimes={"total_seconds": 1.0}, edges=[("a", "b")])


def run(spark, folder, stop=None, error=KeyboardInterrupt, config=CONFIG, **more):
    seen = []
    adapters = {"tiny": SyntheticAdapter("tiny", 60, 4, repeats=2)}
    models = {m: Counting(m, seen, stop, error) for m in MODELS}
    try:
        p = ex.run_suite(spark, "smoke", config, datasets=["tiny"], baselines=MODELS, seeds=[7], labels=["default", "mi_filter_fast"], adapters=adapters, models=models, resume=str(folder) if folder else None, **more)
    except KeyboardInterrupt:
        p = None
    return seen, p


def key(records):
    return [(r["split_id"], r["model_name"], r["ablation_label"], r["status"], [tuple(e) for e in r["edges"]]) for r in records]


def test_killed_suite_continues(spark, tmp_path):
    whole, want = run(spark, None)
    assert len(whole) == 10
    for stop in (4, 1):  # 4 runs, then 1 more, then the rest
        seen, p = run(spark, tmp_path, stop)
        assert p is None and len(seen) == stop
    seen, p = run(spark, tmp_path)
    assert len(seen) == 5 and key(p["records"]) == key(want["records"]) and p["tables"] == want["tables"]
    assert run(spark, tmp_path)[0] == []
    assert len(run(spark, tmp_path, config=PipelineConfig("label", n_bins=7))[0]) == 10  # other settings, other runs


def test_failed_runs_and_half_records_are_run_again(spark, tmp_path):
    seen, p = run(spark, tmp_path, 3, ValueError)
    assert len(seen) == 3 and [r["status"] for r in p["records"]].count("failed") == 7
    seen, p = run(spark, tmp_path)
    assert len(seen) == 7 and all(r["status"] == "ok" for r in p["records"])
    one = sorted(tmp_path.glob("*.json"))[0]
    one.write_text(one.read_text()[:20])
    assert len(run(spark, tmp_path)[0]) == 1


@pytest.mark.parametrize("parallel", [2, 3])
def test_parallel_runs_keep_their_order(spark, parallel):
    seen, p = run(spark, None, parallel=parallel)
    assert key(p["records"]) == key(run(spark, None)[1]["records"])
    assert sorted(s[:3] for s in seen) == sorted((r["split_id"], r["model_name"], r["ablation_label"]) for r in p["records"])
    assert threading.get_ident() not in {s[3] for s in seen}


def test_real_runs_in_pools_are_the_same(spark):
    adapters = {"tiny": SyntheticAdapter("tiny", 80, 4, repeats=1)}
    both = [ex.run_suite(spark, "smoke", CONFIG, datasets=["tiny"], baselines=["naive_bayes", "tan"], seeds=[7], adapters=adapters, parallel=k)["records"] for k in (1, 2)]
    assert [(r["status"], r["predictive"], r["edges"]) for r in both[0]] == [(r["status"], r["predictive"], r["edges"]) for r in both[1]]
    assert {r["status"] for r in both[0]} == {"ok"}


def test_records_on_a_file_system_of_spark(spark, tmp_path):
    log = RecordLog(spark, tmp_path.as_uri())
    assert log.find({"k": 1}) is None
    log.add({"k": 1}, {"status": "ok", "notes": ["é\n"]})
    assert log.find({"k": 1}) == {"status": "ok", "notes": ["é\n"]} and log.find({"k": 2}) is None
