"""Command line: smoke, train, run-suite, run-evidence, summarize-paper, materialize-expert-bn, baselines."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, replace

from .config import PipelineConfig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="credence", description="Discrete Bayesian-network analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options) -> None:
        c = sub.add_parser(name)
        for names, kw in options:
            c.add_argument(*names, **kw)

    opt = lambda *names, **kw: (names, kw)
    device, quiet = opt("--screener-device", default="auto"), opt("--no-progress", action="store_true")
    many = lambda name, **kw: opt(name, nargs="*", **kw)
    again = (opt("--resume", metavar="FOLDER"), opt("--parallel", type=int, default=1))
    command("smoke", opt("--samples", type=int, default=400), opt("--features", type=int, default=6), device, opt("--progress", action="store_true"))
    command("train", opt("csv_path"), opt("--target", required=True), device, opt("--progress", action="store_true"))
    command("run-suite", opt("suite_name"), opt("--output"), opt("--base-dir", default="."), many("--datasets"), many("--baselines"), many("--seeds", type=int), many("--ablations"), device, opt("--tabpfn-device", default="auto"), quiet, *again)
    command("run-evidence", opt("--artifact-dir", default="artifacts/benchmarks"), opt("--base-dir", default="."), many("--stages"), device, opt("--tabpfn-device", default="auto"), quiet, *again)
    command("summarize-paper", opt("--artifact-dir", default="artifacts/benchmarks"))
    command("materialize-expert-bn", opt("--root", default="datasets/expert_bn"), many("--datasets"), opt("--no-overwrite", action="store_true"))
    command("baselines")
    return p


def main(argv: list[str] | None = None, spark=None) -> dict:
    from .plans import experiments as ex

    a = parser().parse_args(argv)
    if a.command == "baselines":
        out = {k: asdict(v) for k, v in ex.availability().items()}
        print(json.dumps(out, indent=2))
        return out
    for d in (getattr(a, "screener_device", "auto"), getattr(a, "tabpfn_device", "auto")):
        ex.resolve_device(d)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("credence").getOrCreate()
    loud = getattr(a, "progress", False) or not getattr(a, "no_progress", True)
    log = (lambda m: print(f"[credence] {m}", file=sys.stderr, flush=True)) if loud else (lambda m: None)
    config = PipelineConfig("label")
    if a.command in ("smoke", "train"):
        from .plans.pipeline import BayesNetClassifier
        from .sources.datasets import read_csv
        from .sources.generators import mixed_dataset

        if a.command == "smoke":
            frame, truth = mixed_dataset(spark, a.samples, a.features)
        else:
            frame, truth, config = read_csv(spark, a.csv_path), None, replace(config, target=a.target)
        model = BayesNetClassifier(config, truth, "known_graph" if truth else "real", log=log).fit(frame)
        r = model.report
        out = {"predictive": r.predictive, "structural": r.structural, "runtimes": r.runtimes, "edges": r.edges, "candidate_pools": r.pools, "operations": r.search.operations}
    elif a.command == "run-suite":
        out = ex.run_suite(spark, a.suite_name, config, base=a.base_dir, datasets=a.datasets, baselines=a.baselines, seeds=a.seeds, labels=a.ablations, output=a.output, log=log, resume=a.resume, parallel=a.parallel)
    elif a.command == "run-evidence":
        out = ex.run_evidence(spark, config, folder=a.artifact_dir, base=a.base_dir, names=a.stages, log=log, resume=a.resume, parallel=a.parallel)
    elif a.command == "summarize-paper":
        from .plans.report import positioning, results

        out = {"positioning": positioning(spark, a.artifact_dir), "results": results(spark, a.artifact_dir)}
    else:
        from .sources.generators import materialize_expert_networks

        out = materialize_expert_networks(spark, a.root, a.datasets, not a.no_overwrite)
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
