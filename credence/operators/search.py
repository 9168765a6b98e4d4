"""Hill climbing over graphs, validation checkpoints, pruning and several starts.

The loop runs on the driver over small graphs; what costs is counting, and all families that an iteration's proposals need
are counted together. Validation scores are one projection and a few aggregates over the validation rows.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import log_sum_exp
from .counts import CountStore, collapse
from .gather import class_terms
from .graph import Dag
from .metrics import CLIP, auc_by_group, clipped, predictive, predictive_local
from .network import LITERAL_CELLS, BayesNet
from .scores import GraphScorer

TIE = 1e-12


@dataclass
class SearchResult:
    graph: Dag
    last_graph: Dag
    score: dict[str, float]
    history: list[float]
    operations: list[str]
    start: str
    selected_iteration: int
    selected_by: str
    validation: dict | None
    validation_history: list[dict]
    pruned: list[str]
    edges_before_pruning: int
    seconds: float
    starts: list[dict] = field(default_factory=list)


def better(new: dict, old: dict | None) -> bool:
    """Lower log loss, then higher AUC, then higher objective, then fewer edges; a key that is missing does not count."""
    if old is None:
        return True
    for key, sign in (("log_loss", -1), ("roc_auc", 1), ("objective", 1)):
        if new.get(key) is None or old.get(key) is None:
            continue
        d = sign * (new[key] - old[key])
        if d > TIE:
            return True
        if d < -TIE:
            return False
    return new["edges"] < old["edges"]


class HillClimb:
    def __init__(self, store: CountStore, target: str, config, pools: dict[str, list[str]], support: dict[tuple[str, str], float] | None = None, regime: str = "unknown", log=lambda message: None):
        self.store, self.target, self.config, self.pools, self.regime, self.log = store, target, config, pools, regime, log
        self.support = support or {}
        self.checked: tuple[dict[str, np.ndarray], np.ndarray] | None = None  # validation rows on the driver, if few
        self.scorer = GraphScorer(store, target, config, self.support)

    # --- proposals ---

    def rank(self, child: str, parent: str) -> float:
        return self.support.get((child, parent), 0.0)

    def additions(self, g: Dag, child: str) -> list[str]:
        """Parents that may be added to the child, best first; the cut comes before any look at cycles."""
        have = g.parents(child)
        pool = [p for p in self.pools.get(child, []) if p != child and p not in have]
        return sorted(pool, key=lambda p: -self.rank(child, p))[: self.config.max_additions_per_child]

    def proposals(self, g: Dag) -> list[tuple[str, Dag]]:
        """Additions by support, then deletions in edge order, then reversals by support."""
        limit, g = self.config.max_parents, g.closed()
        adds = [(self.rank(c, p), p, c) for c in g.nodes if g.in_degree(c) < limit for p in self.additions(g, c)]
        out = [(f"add {p}->{c}", g.plus(p, c)) for _, p, c in sorted(adds, key=lambda x: -x[0]) if not g.reaches(c, p)]
        out += [(f"delete {p}->{c}", g.minus(p, c)) for p, c in g.edges()]
        turns = [(self.rank(p, c), p, c) for p, c in g.edges() if g.in_degree(p) < limit and c in self.additions(g, p)]
        for _, p, c in sorted(turns, key=lambda x: -x[0]):
            without = g.minus(p, c)
            if not without.reaches(p, c):
                out.append((f"reverse {p}->{c}", without.plus(c, p)))
        return out

    def initial(self, start: str) -> Dag:
        g = Dag(self.store.columns)
        if start == "naive_bayes":
            for c in g.nodes:
                if c != self.target and self.target in self.pools.get(c, []) and self.config.max_parents > 0:
                    g = g.plus(self.target, c)
        elif start == "screener_sparse":
            seeds = []
            for c in g.nodes:
                best = sorted((p for p in self.pools.get(c, []) if p != c), key=lambda p, c=c: -self.rank(c, p))
                if best and self.rank(c, best[0]) > 0:
                    seeds.append((self.rank(c, best[0]), best[0], c))
            for _, p, c in sorted(seeds, key=lambda x: -x[0]):
                if not g.in_degree(c) and not g.reaches(c, p):
                    g = g.plus(p, c)
        return g

    # --- validation ---

    def validate(self, g: Dag, net: BayesNet, rows: DataFrame, score: dict, iteration: int, reason: str) -> dict:
        if self.checked is not None and net.is_small:
            codes, w = self.checked
            known = codes[self.target] >= 0
            m = predictive_local(codes[self.target][known], net.posterior_local(codes)[known], w[known])
        else:
            m = predictive(net.posterior(rows), self.store.cards[self.target], self.target, w="w")
        return {"iteration": iteration, "reason": reason, "log_loss": m["log_loss"], "roc_auc": m["roc_auc"], "edges": len(g), "objective": score["total"]}

    def fit_net(self, g: Dag) -> BayesNet:
        return BayesNet.fit(self.store, g, self.target, self.config.laplace)

    # --- one start ---

    def climb(self, start: str, validation: DataFrame | None) -> SearchResult:
        c, began = self.config, time.perf_counter()
        g = self.initial(start)
        score = self.scorer.score(g)
        history, operations, checks = [score["total"]], [], []
        chosen, at, by, best = g, 0, "last_iteration", None
        stale = small = 0
        if validation is not None:
            best = self.validate(g, self.fit_net(g), validation, score, 0, "initial")
            checks.append(best)
            by = "validation_log_loss"
        for number in range(1, c.max_iters + 1):
            moves = self.proposals(g)
            self.scorer.prepare([x for _, x in moves])
            top = None
            for op, x in moves:
                s = self.scorer.score(x)
                gain = s["total"] - score["total"]
                if gain > c.improve_tol and (top is None or gain > top[0]):
                    top = (gain, op, x, s)
            if top is None:
                break
            gain, op, g, score = top
            history.append(score["total"])
            operations.append(op)
            self.log(f"iteration {number}: {op}, score {score['total']:.4f}, {len(g)} edges")
            per_sample = gain if c.normalize_by_samples else gain / max(self.store.rows, 1.0)
            small = small + 1 if per_sample < c.min_delta else 0
            if validation is not None and len(operations) % c.checkpoint_interval == 0:
                check = self.validate(g, self.fit_net(g), validation, score, len(operations), "interval")
                checks.append(check)
                if better(check, best):
                    best, chosen, at, stale = check, g, len(operations), 0
                else:
                    stale += 1
                if small >= c.patience and stale >= c.patience:
                    break
        if validation is None:
            chosen, at = g, len(operations)
        elif checks[-1]["iteration"] != len(operations):
            check = self.validate(g, self.fit_net(g), validation, score, len(operations), "final")
            checks.append(check)
            if better(check, best):
                best, chosen, at = check, g, len(operations)
        before, pruned = len(chosen), []
        if validation is not None and self.prune_limits(before)["passes"] > 0 and before:
            chosen, check, pruned, more = self.prune(chosen, validation, at)
            checks += more
            if pruned:
                best, by = check, "validation_log_loss_pruned"
        final = self.scorer.score(chosen)
        seconds = time.perf_counter() - began
        summary = {"start": start, "selected_iteration": at, "selected_by": by, "edges": len(chosen), "objective": final["total"], "seconds": seconds, "log_loss": best and best["log_loss"], "roc_auc": best and best["roc_auc"]}
        return SearchResult(chosen, g, final, history, operations, start, at, by, best, checks, pruned, before, seconds, [summary])

    # --- pruning ---

    def prune_limits(self, edges: int) -> dict:
        c = self.config
        known = self.regime == "known_graph"
        fraction = min(1.0, max(0.0, c.prune_max_fraction if known else c.prune_max_fraction_real))
        return {
            "profile": "known_graph" if known else "real",
            "passes": max(0, c.prune_passes if known else c.prune_passes_real),
            "log_loss_tol": c.prune_log_loss_tol if known else c.prune_log_loss_tol_real,
            "auc_tol": c.prune_auc_tol if known else c.prune_auc_tol_real,
            "min_edges": max(c.prune_min_edges if known else c.prune_min_edges_real, math.ceil((1 - fraction) * edges)),
            "most": math.ceil(fraction * edges),
        }

    def prune_order(self, g: Dag) -> list[tuple[str, str]]:
        """Weakest edges first; well supported ones that help their child are left out."""
        ranked = []
        for p, c in g.edges():
            s, gain = self.scorer.edge_support(p, c), self.scorer.contribution(g, p, c)
            if not (s >= self.config.prune_support_protect and gain > 0):
                ranked.append((s, gain, -g.out_degree(p), p, c))
        return [x[3:] for x in sorted(ranked)]

    def accepts(self, new: dict, old: dict, limits: dict, strict: bool) -> bool:
        if new["log_loss"] < old["log_loss"] - TIE:
            return True
        return not strict and new["log_loss"] <= old["log_loss"] + limits["log_loss_tol"] and new["roc_auc"] >= old["roc_auc"] - limits["auc_tol"] and new["objective"] > old["objective"] + 1e-4

    def strict_edge(self, p: str, c: str) -> bool:
        return self.target in (p, c) and self.scorer.edge_support(p, c) >= self.config.prune_target_support_protect

    def without_each(self, g: Dag, net: BayesNet, rows: DataFrame, edges: list[tuple[str, str]]):
        """The networks of g without each edge, their log losses, and a function that gives their areas under the curve.

        An edge changes one family's term in the scores, so all losses are sums over one pass of the rows; the areas of all
        edges that may need one are another pass. Neither depends on the number of edges."""
        graphs = {e: g.minus(*e) for e in edges}
        self.scorer.prepare(list(graphs.values()))
        self.store.ensure([(c, graphs[p, c].parents(c)) for p, c in edges])
        nets = {e: net.with_graph(self.store, x) for e, x in graphs.items()}
        old = {(p, c): (c, g.parents(c)) for p, c in edges}
        new = {(p, c): (c, graphs[p, c].parents(c)) for p, c in edges}
        relevant = lambda f: f[0] == self.target or self.target in f[1]
        if self.checked is not None and net.is_small and all(n.is_small for n in nets.values()):
            codes, w = self.checked
            known = codes[self.target] >= 0
            y, w = codes[self.target][known], w[known]
            base = sum(net.term_local(f, codes) for f in net.relevant())[known]
            losses = {}
            for e in edges:
                s = base
                if relevant(old[e]):
                    s = s - net.term_local(old[e], codes)[known]
                if relevant(new[e]):
                    s = s + nets[e].term_local(new[e], codes)[known]
                top = s.max(1, keepdims=True)
                own = np.exp(s[np.arange(len(y)), y] - top[:, 0]) / np.exp(s - top).sum(1)
                losses[e] = float((w * -np.log(np.clip(own, CLIP, 1 - CLIP))).sum() / w.sum()) if len(y) else math.nan
            return nets, losses, lambda some: {e: predictive_local(y, nets[e].posterior_local(codes)[known], w)["roc_auc"] for e in some}
        cards, classes = self.store.cards, self.store.cards[self.target]
        single = {}
        for e in edges:
            for f, own in ((old[e], net), (new[e], nets[e])):
                if relevant(f):
                    single[f] = dict(own.factors())[f]
        known = rows.where(F.col(f"`{self.target}`").isNotNull())
        scored, terms = class_terms(known, [net.factors(), *([(f, t)] for f, t in single.items())], cards, self.target, self.config.laplace, literal=LITERAL_CELLS)
        term = dict(zip(single, terms[1:]))
        scores = {}
        for e in edges:
            s = terms[0]
            if relevant(old[e]):
                s = [a - b for a, b in zip(s, term[old[e]])]
            if relevant(new[e]):
                s = [a + b for a, b in zip(s, term[new[e]])]
            scores[e] = F.array(*s)
        target = F.col(f"`{self.target}`")
        loss = lambda s: F.sum(F.col("w") * -F.log(clipped(F.exp(F.element_at(s, target + 1) - log_sum_exp(s))))) / F.sum("w")
        sums = scored.agg(*[loss(scores[e]).alias(str(i)) for i, e in enumerate(edges)]).first()

        def areas(some: list[tuple[str, str]]) -> dict:
            # whole sums, term by term as in a posterior: scores that tie there tie here
            own, whole = class_terms(known, [nets[e].factors() for e in some], cards, self.target, self.config.laplace, literal=LITERAL_CELLS)
            own = own.select(target.alias("y"), "w", *[F.array(*t).alias(f"_s{i}") for i, t in enumerate(whole)])
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.col(f"_s{i}").alias("s")) for i in range(len(some))]))
            up = own.select("y", "w", each.alias("x")).select("y", "w", F.col("x.v").alias("v"), F.transform("x.s", lambda a: F.exp(a - F.array_max("x.s"))).alias("up"))
            shares = up.select("y", "w", "v", F.transform("up", lambda a: a / F.aggregate("up", F.lit(0.0), lambda u, v: u + v)).alias("probabilities"))
            got = auc_by_group(shares, classes, "v", w="w")
            return {e: got.get(i, 0.5) for i, e in enumerate(some)}

        return nets, {e: float(sums[i]) if sums[i] is not None else math.nan for i, e in enumerate(edges)}, areas

    def prune(self, g: Dag, validation: DataFrame, iteration: int):
        limits, net = self.prune_limits(len(g)), self.fit_net(g)
        current = self.validate(g, net, validation, self.scorer.score(g), iteration, "selected")
        removed, checks = [], []
        full = lambda: len(g) <= limits["min_edges"] or len(removed) >= limits["most"]
        for number in range(1, limits["passes"] + 1):
            in_pass = 0
            while not full():
                order = self.prune_order(g)
                nets, losses, areas = self.without_each(g, net, validation, order) if order else ({}, {}, None)
                area: dict = {}
                for p, c in order:
                    x = g.minus(p, c)
                    check = {"iteration": iteration, "reason": f"prune_{limits['profile']}_pass_{number}", "log_loss": losses[p, c], "roc_auc": None, "edges": len(x), "objective": self.scorer.score(x)["total"]}
                    lower = check["log_loss"] < current["log_loss"] - TIE
                    if not lower and (self.strict_edge(p, c) or check["log_loss"] > current["log_loss"] + limits["log_loss_tol"]):
                        continue
                    if (p, c) not in area:  # of all that are left and close enough, at once
                        near = [e for e in order[order.index((p, c)) :] if losses[e] <= current["log_loss"] + limits["log_loss_tol"]]
                        area = areas(near)
                    check["roc_auc"] = area[p, c]
                    if self.accepts(check, current, limits, self.strict_edge(p, c)):
                        g, net, current = x, nets[p, c], check
                        removed.append(f"delete {p}->{c}")
                        checks.append(check)
                        in_pass += 1
                        break
                else:
                    break
            if not in_pass:
                break
        return g, current, removed, checks

    # --- all starts ---

    def fit(self, validation: DataFrame | None = None) -> SearchResult:
        c = self.config
        starts = list(dict.fromkeys(c.starts)) if c.warm_start == "multi_start" else [c.warm_start]
        if not starts:
            raise ValueError("no start is named")
        if validation is not None and "w" not in validation.columns:
            validation = collapse(validation.select(*self.store.columns)).persist()  # equal rows are scored once
            got = validation.limit(c.local_rows + 1).toPandas()
            if 0 < len(got) <= c.local_rows:
                got = got.fillna(-1)
                self.checked = {x: got[x].to_numpy(np.int64) for x in self.store.columns}, got["w"].to_numpy(float)
        results = [self.climb(s, validation) for s in starts]
        best = results[0]
        for r in results[1:]:
            if better(r.starts[0], best.starts[0]):
                best = r
        best.starts = [r.starts[0] for r in results]
        best.seconds = sum(r.seconds for r in results)
        return best
