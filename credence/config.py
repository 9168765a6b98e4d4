"""All settings, with their defaults, and the named variations of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


#: The defaults of all settings, which results depend on, and the named variations below.


@dataclass(frozen=True)
class ScreenerConfig:
    hidden: int = 64
    layers: int = 2
    dropout: float = 0.1
    learning_rate: float = 1e-3
    batch: int = 128
    epochs: int = 25
    bootstraps: int = 3
    validation_fraction: float = 0.2
    pool_size: int = 7
    pool_soft_cap: int = 10
    pool_score_ratio: float = 0.8
    force_bundle_sources: bool = True
    pairwise_top_m: int = 6
    interaction_top_pairs: int = 5
    mask_chunk: int = 16
    min_edge_stability: float = 0.5
    min_bundle_stability: float = 0.34
    seed: int = 7
    use_bundles: bool = True
    strategy: str = "neural"  # or mi_filter, hybrid_mi_neural
    mi_prefilter_size: int = 5
    max_rows: int = 200_000  # distinct rows up to which a round of the neural screener is one task, unless copies make its steps large; the model is the same beyond


@dataclass(frozen=True)
class SearchConfig:
    max_parents: int = 3
    max_additions_per_child: int = 3
    max_iters: int = 50
    score: str = "bic"  # or bdeu
    equivalent_sample_size: float = 10.0
    generative_weight: float = 1.0
    discriminative_weight: float = 1.0
    laplace: float = 1.0
    warm_start: str = "multi_start"  # or naive_bayes, screener_sparse, empty
    starts: tuple[str, ...] = ("naive_bayes", "screener_sparse")
    normalize_by_samples: bool = True
    edge_prior_weight: float = 0.5
    hub_penalty_weight: float = 0.1
    improve_tol: float = 1e-6
    checkpoint_interval: int = 5
    patience: int = 3
    min_delta: float = 0.01
    prune_passes: int = 2
    prune_passes_real: int = 1
    prune_log_loss_tol: float = 0.002
    prune_log_loss_tol_real: float = 0.001
    prune_auc_tol: float = 0.001
    prune_auc_tol_real: float = 0.0005
    prune_max_fraction: float = 0.30
    prune_max_fraction_real: float = 0.35
    prune_min_edges: int = 20
    prune_min_edges_real: int = 8
    prune_support_protect: float = 0.75
    prune_target_support_protect: float = 0.60
    local_rows: int = 200_000  # distinct rows up to which statistics are kept on the driver


@dataclass(frozen=True)
class PipelineConfig:
    target: str
    n_bins: int = 5
    min_samples_per_bin: int = 20
    seed: int = 7
    use_screener: bool = True
    unseen: str = "error"  # or uniform
    screener: ScreenerConfig = field(default_factory=ScreenerConfig)
    search: SearchConfig = field(default_factory=SearchConfig)


@dataclass(frozen=True)
class Ablation:
    """A named variation. ``screener`` and ``search`` hold changed fields; ``fast`` ones act on known graphs only."""

    label: str = "default"
    screener: dict = field(default_factory=dict)
    search: dict = field(default_factory=dict)
    use_screener: bool = True
    fast: bool = False
    short_search: bool = False  # limit the iterations by the number of columns

    def apply(self, config: PipelineConfig, regime: str = "unknown", columns: int | None = None) -> PipelineConfig:
        out = replace(config, screener=replace(config.screener, seed=config.seed), use_screener=config.use_screener and self.use_screener)
        if self.fast and regime != "known_graph":
            return out
        search = dict(self.search)
        if self.short_search:
            search["max_iters"] = 12 if (columns or 0) <= 20 else 20
        return replace(out, screener=replace(out.screener, **self.screener), search=replace(out.search, **search))


_ONE_PASS = {"bootstraps": 1, "min_edge_stability": 0.0, "min_bundle_stability": 0.0}
_SMALL = {"epochs": 15, "pool_size": 3, "pool_soft_cap": 3}
_FROM_NB = {"warm_start": "naive_bayes", "starts": ("naive_bayes",)}
_NO_BUNDLES = {"use_bundles": False, "interaction_top_pairs": 0}
_NO_PRUNING = {"prune_passes": 0, "prune_passes_real": 0}


def ablations() -> dict[str, Ablation]:
    every = [
        Ablation(),
        Ablation("known_graph_fast", {**_SMALL, "bootstraps": 1, "use_bundles": True}, {**_FROM_NB, "prune_passes": 0}, fast=True, short_search=True),
        Ablation("mi_filter_fast", {**_SMALL, "strategy": "mi_filter"}, fast=True),
        Ablation("single_pass_neural_fast", {**_SMALL, **_ONE_PASS, **_NO_BUNDLES, "strategy": "neural"}, _FROM_NB, fast=True, short_search=True),
        Ablation("hybrid_mi_neural_fast", {**_SMALL, **_ONE_PASS, "strategy": "hybrid_mi_neural", "mi_prefilter_size": 5}, fast=True),
        Ablation("no_screener", use_screener=False),
        Ablation("no_bundles", _NO_BUNDLES),
        Ablation("no_bootstrap", _ONE_PASS),
        Ablation("generative_only", search={"generative_weight": 1.0, "discriminative_weight": 0.0}),
        Ablation("discriminative_only", search={"generative_weight": 0.0, "discriminative_weight": 1.0}),
        Ablation("small_pool", {"pool_size": 3}),
        Ablation("wide_parents", search={"max_parents": 5}),
        Ablation("warm_start_nb", search={"warm_start": "naive_bayes"}),
        Ablation("warm_start_sparse", search={"warm_start": "screener_sparse"}),
        Ablation("no_edge_prior", search={"edge_prior_weight": 0.0}),
        Ablation("no_pruning", search=_NO_PRUNING),
        Ablation("stabilized_pruning_off", search=_NO_PRUNING),
    ]
    return {a.label: a for a in every}
