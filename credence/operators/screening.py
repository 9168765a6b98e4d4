"""Candidate parents: information filter, pools from edge scores and bundles, support for the search.

Edge tables are (target, source, score, stability): target is the child, source the candidate parent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counts import CountStore
from .information import mi_matrix, prefilter

EDGES = "target string, source string, score double, stability double"
BUNDLES = "target string, s1 string, s2 string, score double, stability double"


@dataclass
class Screening:
    edges: dict[tuple[str, str], tuple[float, float]]  # (target, source) -> score, stability
    candidates: dict[tuple[str, str], float]
    pools: dict[str, list[str]]
    bundles: dict[str, list[tuple[str, str, float, float]]] = field(default_factory=dict)


def over_rounds(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Median score and share of rounds above 0; rounds: keys, score, one row for each round in which it was scored."""
    return rounds.groupBy(*keys).agg(F.percentile("score", 0.5).alias("score"), F.avg((F.col("score") > 0).cast("double")).alias("stability"))


def top_bundles(rounds: DataFrame, columns: list[str], min_stability: float, limit: int) -> DataFrame:
    """rounds: target, s1, s2, score -> the best bundles of each target, ties in column order."""
    place = lambda c: F.array_position(F.lit(columns), F.col(c))
    b = over_rounds(rounds, ["target", "s1", "s2"]).where((F.col("stability") >= min_stability) & (F.col("score") > 0))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), place("s1"), place("s2")))
    return b.withColumn("rank", rank).where(F.col("rank") <= limit)


def candidate_pools(edges: DataFrame, bundles: DataFrame | None, columns: list[str], config) -> DataFrame:
    """target, source, score, rank: the pool of each target in order.

    An edge enters with its score if it is stable and positive; each bundle adds half its score to both sources and may
    force them in. The pool is the first ``pool_size``, all within ``pool_score_ratio`` of the last of these, and the forced
    ones, cut at the soft cap in order of score, so that a forced one can still fall out."""
    base = edges.where((F.col("stability") >= config.min_edge_stability) & (F.col("score") > 0) & (F.col("target") != F.col("source"))).select("target", "source", "score", F.lit(0).alias("forced"))
    if bundles is not None:
        for s in ("s1", "s2"):
            base = base.union(bundles.select("target", F.col(s).alias("source"), (0.5 * F.col("score")).alias("score"), F.lit(int(config.force_bundle_sources)).alias("forced")))
    g = base.groupBy("target", "source").agg(F.sum("score").alias("score"), F.max("forced").alias("forced"), F.min("forced").alias("plain"))
    place = F.array_position(F.lit(columns), F.col("source"))
    # ties: scored edges first, in column order; then sources that only bundles brought, which came later
    w = Window.partitionBy("target").orderBy(F.desc("score"), "plain", place)
    size = max(config.pool_size, 1)
    r = g.withColumn("rn", F.row_number().over(w))
    last = F.max(F.when(F.col("rn") <= size, F.struct("rn", "score"))).over(Window.partitionBy("target"))["score"]
    r = r.withColumn("last", last).where((F.col("rn") <= size) | (F.col("score") >= F.col("last") * config.pool_score_ratio) | (F.col("forced") == 1))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("rn"))
    return r.withColumn("rank", rank).where(F.col("rank") <= config.pool_soft_cap).select("target", "source", "score", "rank")


def candidate_scores(edges: DataFrame, bundles: DataFrame | None, config) -> DataFrame:
    """target, source, score: scores with the bundles' shares, of all candidates whether or not they make the pool."""
    base = edges.where((F.col("stability") >= config.min_edge_stability) & (F.col("score") > 0) & (F.col("target") != F.col("source"))).select("target", "source", "score")
    if bundles is not None:
        for s in ("s1", "s2"):
            base = base.union(bundles.select("target", F.col(s), 0.5 * F.col("score")))
    return base.groupBy("target", "source").agg(F.sum("score").alias("score"))


def support(pool_scores: DataFrame, edges: DataFrame) -> DataFrame:
    """target, source, support: 0.7 of the score relative to the best of the pool, and 0.3 of the stability."""
    best = F.max("score").over(Window.partitionBy("target"))
    rel = F.when(best > 0, F.col("score") / best).otherwise(0.0)
    return pool_scores.withColumn("rel", rel).join(edges.select("target", "source", "stability"), ["target", "source"], "left").select("target", "source", (0.7 * F.col("rel") + 0.3 * F.coalesce("stability", F.lit(0.0))).alias("support"))


def full_pools(columns: list[str]) -> dict[str, list[str]]:
    """Every other column, without a screener."""
    return {t: [s for s in columns if s != t] for t in columns}


def mi_edges(store: CountStore) -> DataFrame:
    """All pairs by mutual information; stability is 1 where it is positive."""
    m = mi_matrix(store.collapsed, store.columns)
    return m.select("target", "source", F.col("mi").alias("score"), (F.col("mi") > 0).cast("double").alias("stability"))


def assemble(edges: DataFrame, bundles: DataFrame | None, columns: list[str], config) -> Screening:
    """Bring the results (at most columns squared rows each) to the driver."""
    pools: dict[str, list[str]] = {c: [] for c in columns}
    for r in sorted(candidate_pools(edges, bundles, columns, config).collect(), key=lambda r: (r["target"], r["rank"])):
        pools[r["target"]].append(r["source"])
    by: dict[str, list] = {}
    for r in sorted(bundles.collect(), key=lambda r: (r["target"], r["rank"])) if bundles is not None else []:
        by.setdefault(r["target"], []).append((r["s1"], r["s2"], r["score"], r["stability"]))
    return Screening(
        {(r["target"], r["source"]): (r["score"], r["stability"]) for r in edges.collect()},
        {(r["target"], r["source"]): r["score"] for r in candidate_scores(edges, bundles, config).collect()},
        pools,
        by,
    )


def search_support(s: Screening) -> dict[tuple[str, str], float]:
    """As ``support``, on the driver."""
    out = {}
    for target, pool in s.pools.items():
        best = max((s.candidates.get((target, p), 0.0) for p in pool), default=0.0)
        for p in pool:
            rel = s.candidates.get((target, p), 0.0) / best if best > 0 else 0.0
            out[target, p] = 0.7 * rel + 0.3 * s.edges.get((target, p), (0.0, 0.0))[1]
    return out


def screen(encoder, table: DataFrame, store: CountStore, config, log=lambda message: None) -> Screening:
    """Run the strategy that the configuration names; ``log`` is told of each step."""
    columns = store.columns
    log(f"screener: {config.strategy} over {len(columns)} columns")
    if config.strategy == "mi_filter":
        return assemble(mi_edges(store).persist(), None, columns, config)
    from .neural import neural_edges

    allowed = None
    if config.strategy == "hybrid_mi_neural":
        allowed = {c: [] for c in columns}
        for r in sorted(prefilter(mi_matrix(store.collapsed, columns), columns, config.mi_prefilter_size).collect(), key=lambda r: r["rank"]):
            allowed[r["target"]].append(r["source"])
        log(f"screener: {sum(map(len, allowed.values()))} sources left by mutual information")
    log(f"screener: {max(config.bootstraps, 1)} rounds of {config.epochs} epochs")
    edge_rounds, bundle_rounds = neural_edges(encoder, table, config, allowed)
    edges = over_rounds(edge_rounds, ["target", "source"]).persist()
    bundles = top_bundles(bundle_rounds, columns, config.min_bundle_stability, config.interaction_top_pairs) if config.use_bundles and config.interaction_top_pairs > 0 else None
    out = assemble(edges, bundles, columns, config)
    log(f"screener: {sum(map(len, out.pools.values()))} candidate parents")
    return out
