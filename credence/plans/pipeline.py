"""The estimator: encode, screen, search, fit, score."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml.base import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators.counts import CountStore
from ..operators.graph import Dag
from ..operators.metrics import edge_prf, parent_recall, pool_reduction, predictive, shd
from ..operators.network import BayesNet
from ..operators.screening import Screening, full_pools, screen, search_support
from ..operators.search import HillClimb, SearchResult
from .encoding import TableEncoder, TableEncoderModel


@dataclass
class FitReport:
    predictive: dict[str, float]
    structural: dict[str, float]
    runtimes: dict[str, float]
    edges: list[tuple[str, str]]
    pools: dict[str, list[str]]
    search: SearchResult
    screening: Screening | None
    diagnostics: dict = field(default_factory=dict)


def structure_metrics(graph: Dag, truth: Dag | None, pools: dict[str, list[str]]) -> dict[str, float]:
    out = {"candidate_pool_reduction": pool_reduction(pools), "predicted_edge_count": float(len(graph))}
    if truth is not None:
        precision, recall, f1 = edge_prf(graph.edges(), truth.edges())
        out |= {"shd": float(shd(graph.edges(), truth.edges())), "precision": precision, "recall": recall, "f1": f1, "candidate_parent_recall": parent_recall(pools, truth.edges())}
    return out


class BayesNetClassifier(Estimator):
    def __init__(self, config: PipelineConfig, truth: Dag | None = None, regime: str = "unknown", validation: DataFrame | None = None, log=lambda message: None):
        super().__init__()
        self.config, self.truth, self.regime, self.validation, self.log = config, truth, regime, validation, log

    def _fit(self, df: DataFrame) -> BayesNetModel:
        c, began = self.config, time.perf_counter()
        encoder = TableEncoder(c.target, c.n_bins, c.min_samples_per_bin, unseen=c.unseen).fit(df)
        store = CountStore(encoder.transform(df), c.search.local_rows)
        valid = None
        if self.validation is not None:
            lenient = TableEncoderModel(c.target, encoder.profiles, encoder.types, "uniform")
            valid = lenient.transform(self.validation).persist()
        t0 = time.perf_counter()
        screening = screen(encoder, df, store, c.screener, self.log) if c.use_screener else None
        t1 = time.perf_counter()
        pools = screening.pools if screening else full_pools(store.columns)
        support = search_support(screening) if screening else {}
        result = HillClimb(store, c.target, c.search, pools, support, self.regime, self.log).fit(valid)
        t2 = time.perf_counter()
        net = BayesNet.fit(store, result.graph, c.target, c.search.laplace)
        train = predictive(net.posterior(store.collapsed), store.cards[c.target], c.target, w="w")
        runtimes = {"screener_seconds": t1 - t0, "search_seconds": t2 - t1, "total_seconds": time.perf_counter() - began}
        report = FitReport(train, structure_metrics(result.graph, self.truth, pools), runtimes, result.graph.edges(), pools, result, screening)
        store.collapsed.unpersist()
        return BayesNetModel(encoder, net, report)


class BayesNetModel(Model):
    def __init__(self, encoder: TableEncoderModel, net: BayesNet, report: FitReport):
        super().__init__()
        self.encoder, self.net, self.report = encoder, net, report
        self.classes = encoder.profile(encoder.target).categories

    def _transform(self, df: DataFrame) -> DataFrame:
        """All columns of df, ``probabilities`` (in the order of ``classes``) and ``predicted``; the target may be missing."""
        coded = self.encoder.with_codes(df, "_c_")
        out = self.net.posterior(coded, "_c_")
        words = self.encoder.profile(self.encoder.target).dictionary
        if words is None:
            label = F.element_at(F.lit(self.classes), F.col("prediction") + 1)
        else:
            out, label = words.decode(out, "prediction", "_predicted"), F.col("_predicted")
        return out.select(*[F.col(f"`{c}`") for c in df.columns], "probabilities", label.alias("predicted"))

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        scored = self.net.posterior(TableEncoderModel(self.encoder.target, self.encoder.profiles, self.encoder.types, "uniform").transform(df))
        target = self.encoder.profile(self.encoder.target)
        return predictive(scored.where(F.col(f"`{target.name}`").isNotNull()), target.size, target.name)
