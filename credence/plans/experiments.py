"""Runners, suites and staged evidence: plans of runs over datasets, seeds, splits, models and ablations."""

from __future__ import annotations

import importlib.util
import json
import os
import subprocess
import sys
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import partial
from pathlib import Path
from queue import Queue

import pandas as pd
from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..config import Ablation, PipelineConfig, ablations
from ..operators.classifiers import Aode, kdb_graph, naive_bayes_graph, tan_graph
from ..operators.counts import CountStore
from ..operators.graph import Dag
from ..operators.metrics import predictive
from ..operators.network import BayesNet
from ..operators.screening import full_pools
from ..operators.search import HillClimb
from ..sources import files
from ..sources.datasets import BASELINES, MissingDataset, Split, registry, suites
from .decisions import METHOD, RECORD, evidence_decision, suite_tables
from .encoding import TableEncoder, TableEncoderModel, align_dummies
from .pipeline import BayesNetClassifier, structure_metrics
from .record_log import RecordLog


@dataclass
class RunRecord:
    model_name: str
    dataset_name: str
    dataset_regime: str
    split_id: str
    seed: int
    ablation_label: str
    family: str
    status: str = "ok"
    notes: list[str] = field(default_factory=list)
    predictive: dict[str, float] = field(default_factory=dict)
    structural: dict[str, float] | None = None
    diagnostics: dict[str, float] = field(default_factory=dict)
    runtimes: dict[str, float] = field(default_factory=dict)
    edges: list[tuple[str, str]] = field(default_factory=list)
    pools: dict[str, list[str]] = field(default_factory=dict)
    search: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)

    def row(self) -> tuple:
        return (self.model_name, self.dataset_name, self.dataset_regime, self.split_id, self.seed, self.ablation_label, self.family, self.status, self.notes, self.predictive, self.structural, self.diagnostics, self.runtimes)


def records_frame(spark: SparkSession, records: list[RunRecord]) -> DataFrame:
    return spark.createDataFrame([r.row() for r in records], RECORD)


# --- availability ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Availability:
    available: bool
    detail: str


NEVER = ("tabm", "ft_transformer", "tabicl")


def find_checkpoint(env: dict[str, str] | None = None) -> str | None:
    """The newest checkpoint of the foundation model in the folders that the environment names, or the usual cache."""
    env = os.environ if env is None else env
    named = env.get("TABPFN_CHECKPOINT")
    if named and Path(named).exists():
        return named
    folders = [env[k] for k in ("TABPFN_MODEL_CACHE_DIR", "XDG_CACHE_HOME") if env.get(k)] + [str(Path.home() / ".cache" / "tabpfn")]
    found = [p for f in folders if Path(f).is_dir() for p in Path(f).rglob("*.ckpt")]
    return str(max(found, key=lambda p: p.stat().st_mtime)) if found else None


def availability() -> dict[str, Availability]:
    out = {}
    for name in ("xgboost", "lightgbm", "catboost"):
        there = importlib.util.find_spec(name) is not None
        out[name] = Availability(there, "importable" if there else "not installed; Spark's own trees stand in on request")
    if importlib.util.find_spec("tabpfn") is None:
        out["tabpfn"] = Availability(False, "not installed")
    else:
        at = find_checkpoint()
        out["tabpfn"] = Availability(at is not None, f"checkpoint {at}" if at else "no checkpoint found")
    return out | {n: Availability(False, "not supported") for n in NEVER}


def resolve_device(name: str = "auto") -> str:
    """Everything runs on the cluster's CPUs."""
    if name not in ("auto", "cpu"):
        raise ValueError(f"device {name!r} is not supported: use auto or cpu")
    return "cpu"


@contextmanager
def temporary_env(**values: str | None):
    old = {k: os.environ.get(k) for k in values}
    try:
        for k, v in values.items():
            os.environ.pop(k, None) if v is None else os.environ.__setitem__(k, v)
        yield
    finally:
        for k, v in old.items():
            os.environ.pop(k, None) if v is None else os.environ.__setitem__(k, v)


# --- runners ---------------------------------------------------------------------------------------------------------------


class Runner:
    """One model. Subclass and give ``run``."""

    def __init__(self, name: str, family: str):
        self.name, self.family = name, family

    def run(self, split: Split, config: PipelineConfig, ablation: Ablation) -> RunRecord:
        raise NotImplementedError

    def record(self, split: Split, label: str = "default", **values) -> RunRecord:
        return RunRecord(self.name, split.dataset.name, split.dataset.regime, split.id, split.seed, label, self.family, **values)

    def skipped(self, split: Split, label: str, why: str) -> RunRecord:
        return self.record(split, label, status="skipped", notes=[why])


class MethodRunner(Runner):
    def __init__(self):
        super().__init__(METHOD, "proposed")

    def run(self, split, config, ablation):
        began = time.perf_counter()
        c = ablation.apply(replace(config, target=split.dataset.target, seed=split.seed), split.dataset.regime, len(split.train.columns))
        model = BayesNetClassifier(c, split.dataset.truth, split.dataset.regime, split.valid).fit(split.train)
        m = model.evaluate(split.test)
        r = model.report
        runtimes = r.runtimes | {"total_seconds": time.perf_counter() - began}
        search = {"start": r.search.start, "steps": len(r.search.operations), "pruned": r.search.pruned, "selected_by": r.search.selected_by, "starts": r.search.starts}
        return self.record(split, ablation.label, predictive=m, structural=r.structural if split.dataset.truth else None, diagnostics=r.structural, runtimes=runtimes, edges=r.edges, pools=r.pools, search=search)


class _CodedRunner(Runner):
    def coded(self, split: Split, config: PipelineConfig):
        encoder = TableEncoder(split.dataset.target, config.n_bins, config.min_samples_per_bin).fit(split.train)
        store = CountStore(encoder.transform(split.train), config.search.local_rows)
        test = TableEncoderModel(encoder.target, encoder.profiles, encoder.types, "uniform").transform(split.test)
        return store, test

    def finish(self, split, store, test, scored, graph: Dag | None, pools, began, searched) -> RunRecord:
        target = split.dataset.target
        m = predictive(scored, store.cards[target], target)
        s = structure_metrics(graph, split.dataset.truth, pools) if graph is not None else {}
        store.collapsed.unpersist()
        now = time.perf_counter()
        return self.record(split, predictive=m, structural=s if split.dataset.truth is not None and graph is not None else None, diagnostics=s, runtimes={"search_seconds": searched - began, "total_seconds": now - began}, edges=graph.edges() if graph else [], pools=pools)


class GreedyRunner(_CodedRunner):
    """Full pools, no scores, no validation: each child looks at its first few columns only, in column order."""

    def __init__(self):
        super().__init__("greedy_hc_bn", "classical_search")

    def run(self, split, config, ablation):
        began = time.perf_counter()
        store, test = self.coded(split, config)
        pools = full_pools(store.columns)
        result = HillClimb(store, split.dataset.target, replace(config.search, warm_start="empty"), pools).fit()
        searched = time.perf_counter()
        net = BayesNet.fit(store, result.graph, split.dataset.target, config.search.laplace)
        return self.finish(split, store, test, net.posterior(test), result.graph, pools, began, searched)


class FixedShapeRunner(_CodedRunner):
    def __init__(self, name: str):
        super().__init__(name, "fixed_structure")

    def run(self, split, config, ablation):
        began = time.perf_counter()
        store, test = self.coded(split, config)
        target = split.dataset.target
        if self.name == "aode":
            model = Aode(store, target, config.search.laplace)
            return self.finish(split, store, test, model.posterior(test.na.fill(0)), None, {}, began, time.perf_counter())
        graph = {"naive_bayes": lambda: naive_bayes_graph(store.columns, target), "tan": lambda: tan_graph(store, target), "kdb": lambda: kdb_graph(store, target, min(2, config.search.max_parents))}[self.name]()
        searched = time.perf_counter()
        net = BayesNet.fit(store, graph, target, config.search.laplace)
        return self.finish(split, store, test, net.posterior(test), graph, {c: list(graph.parents(c)) for c in graph.nodes}, began, searched)


class TreeRunner(Runner):
    """Tree ensembles. With the named library on the cluster the run uses it, on at most ``MOST_ROWS`` training rows that are
    brought to one place, as the library works there. Without it the run is skipped, or Spark's gradient-boosted trees (two
    classes) or random forest (more) stand in, if ``stand_in`` is set; the record's notes say so."""

    MOST_ROWS = 2_000_000

    def __init__(self, name: str, stand_in: bool = False):
        super().__init__(name, "tree_ensemble")
        self.stand_in = stand_in

    def model(self, classes: int, seed: int):
        """The library's own estimator, with its usual settings."""
        if self.name == "xgboost":
            from xgboost import XGBClassifier

            return XGBClassifier(random_state=seed)
        if self.name == "lightgbm":
            from lightgbm import LGBMClassifier

            return LGBMClassifier(random_state=seed, verbose=-1)
        from catboost import CatBoostClassifier

        return CatBoostClassifier(random_state=seed, verbose=False, allow_writing_files=False, loss_function="Logloss" if classes == 2 else "MultiClass")

    def run(self, split, config, ablation):
        there = availability()[self.name]
        if not there.available and not self.stand_in:
            return self.skipped(split, "default", there.detail)
        began = time.perf_counter()
        train, test, labels = align_dummies(split.train, split.test, split.dataset.target)
        run = self.with_library if there.available else self.with_spark
        scored, note = run(train, test, labels, split.seed)
        return self.record(split, predictive=predictive(scored, len(labels), "label_code"), notes=[note], runtimes={"total_seconds": time.perf_counter() - began})

    def with_library(self, train: DataFrame, test: DataFrame, labels: list[str], seed: int):
        names = [c for c in train.columns if c != "label_code"]
        got = train.limit(self.MOST_ROWS + 1).toPandas()
        if len(got) > self.MOST_ROWS:
            raise ValueError(f"{self.name} trains on one machine: more than {self.MOST_ROWS} rows are not brought there")
        held = train.sparkSession.sparkContext.broadcast(self.model(len(labels), seed).fit(got[names].to_numpy(), got["label_code"].to_numpy()))

        def score(frames):
            for pdf in frames:
                yield pd.DataFrame({"label_code": pdf["label_code"], "probabilities": list(held.value.predict_proba(pdf[names].to_numpy()).astype(float))})

        return test.mapInPandas(score, "label_code int, probabilities array<double>"), self.name

    def with_spark(self, train: DataFrame, test: DataFrame, labels: list[str], seed: int):
        from pyspark.ml import classification
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        va = VectorAssembler(inputCols=[c for c in train.columns if c != "label_code"], outputCol="features", handleInvalid="keep")
        cls = classification.GBTClassifier if len(labels) == 2 else classification.RandomForestClassifier
        model = cls(labelCol="label_code", featuresCol="features", seed=seed).fit(va.transform(train))
        return model.transform(va.transform(test)).select("label_code", vector_to_array("probability").alias("probabilities")), "Spark stand-in"


class FoundationRunner(TreeRunner):
    """The tabular foundation model, where its library and a checkpoint are there; it reads ``MOST_ROWS`` training rows at most
    and refuses more. What goes wrong inside it leaves a skipped record."""

    MOST_ROWS = 10_000

    def __init__(self):
        Runner.__init__(self, "tabpfn", "foundation_model")
        self.stand_in = False

    def model(self, classes: int, seed: int):
        from tabpfn import TabPFNClassifier

        return TabPFNClassifier(device=resolve_device(), random_state=seed)

    def run(self, split, config, ablation):
        try:
            return super().run(split, config, ablation)
        except (ArithmeticError, LookupError, ValueError, RuntimeError, OSError, PySparkException, Py4JError) as e:
            return self.skipped(split, "default", f"{type(e).__name__}: {str(e)[:300]}")


def runners() -> dict[str, Runner]:
    out: list[Runner] = [MethodRunner(), GreedyRunner(), *map(FixedShapeRunner, ("naive_bayes", "tan", "kdb", "aode")), *map(TreeRunner, ("xgboost", "lightgbm", "catboost")), FoundationRunner()]
    return {r.name: r for r in out}


# --- suites ----------------------------------------------------------------------------------------------------------------


def _attempt(runner: Runner, split: Split, config: PipelineConfig, ablation: Ablation, log) -> RunRecord:
    try:
        return runner.run(split, config, ablation)
    except (ArithmeticError, LookupError, ValueError, RuntimeError, PySparkException, Py4JError) as e:  # of the run; mistakes of the program end the suite
        log(f"{split.dataset.name} {split.id} {runner.name} {ablation.label} failed: {type(e).__name__}")
        return replace(runner.skipped(split, ablation.label, f"{type(e).__name__}: {str(e)[:300]}"), status="failed")


def in_pools(spark: SparkSession, jobs: list[Callable[[], RunRecord]], parallel: int) -> list[RunRecord]:
    """What the jobs return, in their order; at most ``parallel`` run at a time, each in a scheduler pool of its own, which a
    session with ``spark.scheduler.mode`` FAIR gives equal shares. The first error ends the rest that has not begun."""
    if parallel <= 1:
        return [job() for job in jobs]
    free: Queue[int] = Queue()
    for k in range(parallel):
        free.put(k)

    def pooled(job: Callable[[], RunRecord]) -> RunRecord:
        k, context = free.get(), spark.sparkContext
        try:
            context.setLocalProperty("spark.scheduler.pool", f"credence-{k}")
            return job()
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
            free.put(k)

    with ThreadPoolExecutor(parallel) as threads:
        running = [threads.submit(inheritable_thread_target(spark)(pooled), job) for job in jobs]
        try:
            return [r.result() for r in running]
        finally:
            for r in running:
                r.cancel()


def run_suite(spark: SparkSession, name: str, config: PipelineConfig, *, base: str = ".", datasets=None, baselines=None, seeds=None, labels=None, output: str | None = None, adapters=None, models=None, log=lambda message: None, resume: str | None = None, parallel: int = 1) -> dict:
    """Every dataset, seed, split and model; ablations for the method only. A dataset that is not there, and a run that
    fails, leave a skipped record. With ``resume``, a folder, finished runs are kept there and not repeated by a later call with
    the same settings, while failed ones are; ``parallel`` runs go on at a time."""
    suite = suites()[name]
    adapters, models, known = adapters or registry(base), models or runners(), ablations()
    kept = RecordLog(spark, resume) if resume else None
    jobs: list[Callable[[], RunRecord]] = []

    def run(split: Split, m: str, label: str) -> RunRecord:
        key = {"dataset": split.dataset.name, "split": split.id, "seed": split.seed, "model": m, "label": label, "config": asdict(config)}
        got = kept.find(key) if kept else None
        if got is not None:
            log(f"{split.dataset.name} {split.id} {m} {label}: kept")
            return as_records({"records": [got]})[0]
        log(f"{split.dataset.name} {split.id} {m} {label}")
        record = _attempt(models[m], split, config, known[label], log)
        if kept:
            kept.add(key, record.to_dict())
        return record

    for dataset in datasets or suite.datasets:
        for seed in seeds or suite.seeds:
            try:
                splits = list(adapters[dataset].splits(spark, seed))
            except MissingDataset as e:
                regime = "known_graph" if dataset in ("alarm", "child", "insurance") else "real"
                missing = [RunRecord(m, dataset, regime, f"{dataset}-{seed}", seed, "default", models[m].family, "skipped", [f"missing: {e}"]) for m in baselines or suite.baselines]
                jobs += [partial(lambda r: r, r) for r in missing]
                continue
            for split in splits:
                for m in baselines or suite.baselines:
                    jobs += [partial(run, split, m, label) for label in ((labels or suite.ablations) if m == METHOD else ("default",))]
    records = in_pools(spark, jobs, parallel)
    tables = suite_tables(records_frame(spark, records))
    payload = {
        "suite_name": name,
        "records": [r.to_dict() for r in records],
        "tables": {k: sorted((r.asDict() for r in t.collect()), key=lambda r: tuple(map(str, r.values()))) for k, t in tables.items()},
        "run_metadata": run_metadata(),
    }
    if output:
        write_json(payload, output)
    return payload


def run_metadata() -> dict:
    return {"git_sha": git_sha(), "python": sys.version.split()[0], "device": resolve_device(), "availability": {k: asdict(v) for k, v in availability().items()}}


def git_sha() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, cwd=Path(__file__).parent).stdout.strip() or None
    except OSError:
        return None


def write_json(payload: dict, path: str | Path) -> None:
    files.write_text(None, path, json.dumps(payload, indent=2, default=str))


def read_json(path: str | Path) -> dict:
    if not files.exists(None, path):
        raise FileNotFoundError(f"no artifact at {path}")
    return json.loads(files.read_text(None, path))


@dataclass(frozen=True)
class Stage:
    name: str
    suite: str
    datasets: tuple[str, ...] | None = None
    baselines: tuple[str, ...] | None = None
    seeds: tuple[int, ...] | None = None
    labels: tuple[str, ...] | None = None

    @property
    def filename(self) -> str:
        return f"{self.name}.json"


_GRAPHS = ("synthetic_small", "synthetic_medium", "alarm", "child", "insurance")
DEFAULT_STAGES = ("sanity_default", "structural_default", "paper_minimum_full")


def stages() -> dict[str, Stage]:
    #: The plan of each stage.
    probes = ("known_graph_fast", "mi_filter_fast", "single_pass_neural_fast", "hybrid_mi_neural_fast")
    every = [
        Stage("sanity_default", "paper_minimum", ("alarm", "child", "insurance", "sklearn_breast_cancer"), BASELINES, (7,), ("default",)),
        Stage("structural_default", "paper_minimum", _GRAPHS, BASELINES, (7,), ("default",)),
        Stage("paper_minimum_full", "paper_minimum"),
        Stage("known_graph_fast_probe", "paper_minimum", (*_GRAPHS, "sklearn_breast_cancer", "sklearn_wine"), BASELINES, (7, 8), ("default", "known_graph_fast")),
        Stage("fast_mode_design_probe", "paper_minimum", _GRAPHS, (METHOD, "greedy_hc_bn"), (7, 8), ("default", *probes)),
    ]
    return {s.name: s for s in every}


def as_records(payload: dict) -> list[RunRecord]:
    names = RunRecord.__dataclass_fields__
    return [RunRecord(**{k: v for k, v in r.items() if k in names}) for r in payload["records"]]


def summarize_evidence(spark: SparkSession, payloads: dict[str, dict], names=None, folder: str = "artifacts/benchmarks") -> dict:
    specs = stages()
    names = list(names or specs)
    overview = []
    for n in names:
        s, p = specs[n], payloads.get(n)
        rs = p["records"] if p else []
        ok = sum(r["status"] == "ok" for r in rs)
        overview.append({"stage_name": n, "suite_name": s.suite, "artifact_path": files.join(folder, s.filename), "completed": p is not None, "datasets": list(s.datasets or ()), "baselines": list(s.baselines or ()), "seeds": list(s.seeds or ()), "ablations": list(s.labels or ()), "num_records": len(rs), "num_ok": ok, "num_skipped": len(rs) - ok})
    frames = {n: records_frame(spark, as_records(p)) for n, p in payloads.items()}
    return {"artifact_dir": folder, "requested_stages": names, "completed_stages": [n for n in names if n in payloads], "stage_overview": overview, "stage_tables": {n: p["tables"] for n, p in payloads.items()}, "run_metadata": run_metadata(), "decision": evidence_decision(frames)}


def run_evidence(spark: SparkSession, config: PipelineConfig, *, folder: str = "artifacts/benchmarks", base: str = ".", names=None, log=lambda message: None, adapters=None, resume: str | None = None, parallel: int = 1) -> dict:
    payloads: dict[str, dict] = {}
    names = list(names or DEFAULT_STAGES)
    for n in names:
        s = stages()[n]
        payloads[n] = run_suite(spark, s.suite, config, base=base, datasets=s.datasets, baselines=s.baselines, seeds=s.seeds, labels=s.labels, output=files.join(folder, s.filename), log=log, adapters=adapters, resume=resume, parallel=parallel)
        summary = summarize_evidence(spark, payloads, names, folder)
        write_json(summary, files.join(folder, "evidence_summary.json"))
    return summary
