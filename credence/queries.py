"""Named queries over the star-schema tables, each with the SQL that gives the same rows.

The main view codes six columns of ``lineitem``: flag (the target, 3 values), status (2), lnum (7), qty (5), disc (4) and
tax (3). Numbers are rounded alike on both sides. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PipelineConfig, ScreenerConfig, SearchConfig
from .functions.columns import digitize
from .operators import information, metrics, screening
from .operators.classifiers import Aode, kdb_graph, naive_bayes_graph, tan_graph
from .operators.counts import CountStore, collapse, complete_counts
from .operators.graph import Dag, markov_blanket, reachability
from .operators.network import BayesNet
from .operators.scores import GraphScorer, cpd, family_bdeu, family_bic
from .operators.search import HillClimb
from .plans import decisions
from .plans.encoding import ColumnProfile, TableEncoder, TableEncoderModel, align_dummies, entropy_bins
from .plans.pipeline import BayesNetClassifier
from .sources.datasets import holdout
from .sources.generators import forward_sample, mixed_dataset, random_tables

COLUMNS = ["flag", "status", "lnum", "qty", "disc", "tax"]
CARDS = {"flag": 3, "status": 2, "lnum": 7, "qty": 5, "disc": 4, "tax": 3}
QTY, DISC, TAX = [10.5, 20.5, 30.5, 40.5], [0.025, 0.055, 0.085], [0.025, 0.055]
TARGET = "flag"
#: A fixed graph over the view, for queries that score one.
GRAPH = [("flag", "status"), ("flag", "qty"), ("status", "qty"), ("disc", "flag"), ("tax", "disc")]
SUPPORT = {("status", "flag"): 0.9, ("qty", "flag"): 0.6, ("qty", "status"): 0.3, ("flag", "disc"): 0.8, ("disc", "tax"): 0.1}  # (child, parent)

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        _Q[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- views -----------------------------------------------------------------------------------------------------------------


def _case(x: str, cuts: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {t} THEN {i}" for i, t in enumerate(cuts)) + f" ELSE {len(cuts)} END"


LI = f"""li AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag,
 CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS status, CAST(l_linenumber - 1 AS INT) AS lnum,
 {_case('l_quantity', QTY)} AS qty, {_case('l_discount', DISC)} AS disc, {_case('l_tax', TAX)} AS tax FROM lineitem)"""


def li_model(target: str = TARGET) -> TableEncoderModel:
    p = [
        ColumnProfile("l_returnflag", "categorical", ["A", "N", "R"]),
        ColumnProfile("l_linestatus", "categorical", ["F", "O"]),
        ColumnProfile("l_linenumber", "continuous", thresholds=[1.5, 2.5, 3.5, 4.5, 5.5, 6.5]),
        ColumnProfile("l_quantity", "continuous", thresholds=QTY),
        ColumnProfile("l_discount", "continuous", thresholds=DISC),
        ColumnProfile("l_tax", "continuous", thresholds=TAX),
    ]
    return TableEncoderModel("l_returnflag", p, {"l_returnflag": "string", "l_linestatus": "string"})


def li(spark: SparkSession, sf: str) -> DataFrame:
    return li_model().transform(table(spark, sf, "lineitem")).toDF(*COLUMNS)


def li_store(spark: SparkSession, sf: str) -> CountStore:
    return CountStore(li(spark, sf), cards=CARDS)


def _index(parents: tuple[str, ...], override: str | None = None) -> str:
    out = "0"
    for p in parents:
        out = f"({out}) * {CARDS[p]} + {override if override and p == TARGET else p}"
    return out


FAMILIES = [("flag", ()), ("status", ("flag",)), ("qty", ("flag", "status")), ("flag", ("disc",)), ("disc", ("tax",)), ("lnum", ()), ("tax", ()), ("lnum", ("disc", "flag", "tax"))]


def _grid(families) -> str:
    """Complete counts of families as a CTE ``cells`` (f, q, v, n)."""
    parts = []
    for i, (node, parents) in enumerate(families):
        nq = 1
        for p in parents:
            nq *= CARDS[p]
        parts.append(f"SELECT {i} AS f, g.q AS q, g.v AS v, coalesce(c.n, 0) AS n FROM (SELECT a.i AS q, b.i AS v FROM generate_series(0, {nq - 1}) a(i) CROSS JOIN generate_series(0, {CARDS[node] - 1}) b(i)) g LEFT JOIN (SELECT {_index(parents)} AS q, {node} AS v, count(*) AS n FROM li GROUP BY 1, 2) c ON g.q = c.q AND g.v = c.v")
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


def _counts(n: int) -> list:
    from itertools import combinations

    return [(c[-1], c[:-1]) for c in combinations(COLUMNS, n)]


def _counts_query(n: int):
    def run(spark, sf):
        return complete_counts(collapse(li(spark, sf)), _counts(n), CARDS).select(F.col("f").cast("bigint").alias("f"), "q", F.col("v").cast("bigint").alias("v"), "n")

    run.__name__ = f"q_counts_{n}way"
    query(f"WITH {LI}, {_grid(_counts(n))} SELECT CAST(f AS BIGINT) AS f, CAST(q AS BIGINT) AS q, CAST(v AS BIGINT) AS v, CAST(n AS BIGINT) AS n FROM cells")(run)


for _n in (1, 2, 3):
    _counts_query(_n)


# --- encoding --------------------------------------------------------------------------------------------------------------


@query(
    "SELECT 'value' AS name, round(median(value), 6) AS median, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std FROM events UNION ALL "
    "SELECT 'hour', round(median(hour(ts)), 6), round(avg(hour(ts)), 5), round(stddev_pop(hour(ts)), 5) FROM events"
)
def q_column_profile(spark, sf):
    df = table(spark, sf, "events").select("event_type", "value", F.hour("ts").alias("hour"))
    m = TableEncoder("event_type").fit(df)
    rows = [(p.name, p.median, p.mean, p.std) for p in m.profiles if p.kind == "continuous"]
    d = spark.createDataFrame(rows, "name string, median double, mean double, std double")
    return d.select("name", F.round("median", 6).alias("median"), F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 4) AS z FROM orders")
def q_impute_standardize(spark, sf):
    df = table(spark, sf, "orders")
    p = TableEncoder("o_orderpriority").fit(df.select("o_orderpriority", "o_totalprice")).profile("o_totalprice")
    return df.select("o_orderkey", F.round((F.coalesce("o_totalprice", F.lit(p.mean)) - p.mean) / p.std, 4).alias("z"))


@query("SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS lang_code, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS source_code FROM documents")
def q_category_codes(spark, sf):
    df = table(spark, sf, "documents")
    m = TableEncoder("lang").fit(df.select("lang", "source"))
    return m.with_codes(df.select("doc_id", "lang", "source")).select("doc_id", F.col("code_lang").alias("lang_code"), F.col("code_source").alias("source_code"))


@query("SELECT c.c_custkey, s.c_mktsegment AS category, CAST(c.c_mktsegment = s.c_mktsegment AS INT) AS hot FROM customer c CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s")
def q_onehot_long(spark, sf):
    df = table(spark, sf, "customer")
    m = TableEncoder("c_mktsegment").fit(df.select("c_mktsegment"))
    cats = m.profiles[0].categories
    hot = m.with_codes(df.select("c_custkey", "c_mktsegment"))
    pair = F.explode(F.transform(F.lit(cats), lambda c, i: F.struct(c.alias("category"), (i == F.col("code_c_mktsegment")).cast("int").alias("hot"))))
    return hot.select("c_custkey", pair.alias("x")).select("c_custkey", "x.category", "x.hot")


@query(
    "WITH s AS (SELECT DISTINCT c_mktsegment AS v FROM customer), c AS (SELECT c_mktsegment AS v, c_nationkey < 12 AS part FROM customer) "
    "SELECT 'c_mktsegment_' || s.v AS feature, CAST(count(CASE WHEN c.part THEN 1 END) AS BIGINT) AS train, CAST(count(CASE WHEN NOT c.part THEN 1 END) AS BIGINT) AS test FROM s LEFT JOIN c ON s.v = c.v GROUP BY s.v "
    "UNION ALL SELECT 'c_mktsegment_nan', 0, 0"
)
def q_dummy_align(spark, sf):
    df = table(spark, sf, "customer")
    pick = lambda w: df.where(w).select("c_mktsegment", F.col("c_nationkey").alias("y"))
    train, test, _ = align_dummies(pick("c_nationkey < 12"), pick("c_nationkey >= 12"), "y")
    names = [c for c in train.columns if c != "label_code"]
    total = lambda d, n: d.agg(*[F.sum(F.col(f"`{c}`")).cast("bigint").alias(c) for c in names]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias(n)) for c in names])).alias("x")).select("x.*")
    return total(train, "train").join(total(test, "test"), "feature")


@query("SELECT round((x + nx) / 2, 6) AS threshold FROM (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT DISTINCT l_discount AS x FROM lineitem)) WHERE nx IS NOT NULL")
def q_midpoint_thresholds(spark, sf):
    df = table(spark, sf, "lineitem").select("l_discount", "l_returnflag")
    t = TableEncoder("l_returnflag", n_bins=64).fit(df).profile("l_discount").thresholds
    return spark.createDataFrame([(float(x),) for x in t], "threshold double").select(F.round("threshold", 6).alias("threshold"))


_ENTROPY = lambda a, b, c: f"(-(CASE WHEN {a} > 0 THEN {a} * log2({a} / n_) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * log2({b} / n_) ELSE 0 END + CASE WHEN {c} > 0 THEN {c} * log2({c} / n_) ELSE 0 END))"


@query(
    f"""WITH h AS (SELECT l_quantity AS x, sum(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END) AS b, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS c FROM lineitem GROUP BY 1),
 w AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, CAST(sum(a) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS la, CAST(sum(b) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS lb, CAST(sum(c) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS lc, CAST(sum(a) OVER () AS DOUBLE) AS ta, CAST(sum(b) OVER () AS DOUBLE) AS tb, CAST(sum(c) OVER () AS DOUBLE) AS tc FROM h),
 s AS (SELECT x, nx, la, lb, lc, ta - la AS ra, tb - lb AS rb, tc - lc AS rc FROM w WHERE nx IS NOT NULL),
 g AS (SELECT (x + nx) / 2 AS threshold, {_ENTROPY('la', 'lb', 'lc').replace('n_', '(la + lb + lc)')} + {_ENTROPY('ra', 'rb', 'rc').replace('n_', '(ra + rb + rc)')} AS cost FROM s WHERE la + lb + lc >= 20 AND ra + rb + rc >= 20)
 SELECT round(threshold, 6) AS threshold FROM g ORDER BY cost, threshold LIMIT 1"""
)
def q_entropy_split_first(spark, sf):
    h = table(spark, sf, "lineitem").groupBy("l_quantity").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0).orderBy("l_quantity").toPandas()
    cuts = entropy_bins(h["l_quantity"].to_numpy(), h[["A", "N", "R"]].to_numpy(float), 2, 20)
    return spark.createDataFrame([(float(x),) for x in cuts], "threshold double").select(F.round("threshold", 6).alias("threshold"))


_EV_CUTS = [1.0, 5.0, 10.0, 20.0]


@query(f"SELECT event_type, CAST({_case('value', _EV_CUTS)} AS INT) AS code, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1, 2")
def q_digitize_codes(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value", digitize(F.col("value"), _EV_CUTS).alias("code"))
    return e.groupBy("event_type", "code").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


# --- counts and information ------------------------------------------------------------------------------------------------


@query(f"WITH {LI} SELECT flag, status, lnum, qty, disc, tax, count(*) AS w FROM li GROUP BY 1, 2, 3, 4, 5, 6")
def q_collapsed_rows(spark, sf):
    return collapse(li(spark, sf))


def _pairs_sql(given: str = "0", columns=COLUMNS) -> str:
    """CTEs p (a, b, z, x, y, n) and m (a, b, mi) over pairs of columns."""
    from itertools import combinations

    parts = [f"SELECT '{a}' AS a, '{b}' AS b, {given} AS z, {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS n FROM li GROUP BY 1, 2, 3, 4, 5" for a, b in combinations(columns, 2)]
    return (
        "p AS (" + " UNION ALL ".join(parts) + "), "
        "w AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a, b, z, x) AS nx, sum(n) OVER (PARTITION BY a, b, z, y) AS ny, sum(n) OVER (PARTITION BY a, b, z) AS nz, sum(n) OVER (PARTITION BY a, b) AS t FROM p), "
        "m AS (SELECT a, b, greatest(0.0, sum(n / t * ln(n * nz / (nx * ny)))) AS mi FROM w GROUP BY a, b), "
        "mm AS (SELECT a AS target, b AS source, mi FROM m UNION ALL SELECT b, a, mi FROM m)"
    )


_PLACE_F = lambda c: f"CASE {c} " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(COLUMNS)) + " END"
_PLACE = "CASE source " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(COLUMNS)) + " END"


@query(f"WITH {LI}, {_pairs_sql()} SELECT target, source, round(mi, 8) AS mi FROM mm")
def q_mi_matrix(spark, sf):
    return information.mi_matrix(collapse(li(spark, sf)), COLUMNS).select("target", "source", F.round("mi", 8).alias("mi"))


_FEATURES = COLUMNS[1:]


@query(f"WITH {LI}, {_pairs_sql(TARGET, _FEATURES)} SELECT target, source, round(mi, 8) AS cmi FROM mm")
def q_cmi_matrix(spark, sf):
    return information.mi_matrix(collapse(li(spark, sf)), _FEATURES, TARGET).select("target", "source", F.round("mi", 8).alias("cmi"))


@query(f"WITH {LI}, {_pairs_sql()}, r AS (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY mi DESC, {_PLACE}) AS rank FROM mm) SELECT target, source, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def q_mi_prefilter(spark, sf):
    return information.prefilter(information.mi_matrix(collapse(li(spark, sf)), COLUMNS), COLUMNS, 3)


_POOL = ScreenerConfig(pool_size=2, pool_soft_cap=3)
_POOL_SQL = f"""r AS (SELECT target, source, mi, row_number() OVER (PARTITION BY target ORDER BY mi DESC, {_PLACE}) AS rn FROM mm WHERE mi > 0),
 l AS (SELECT target, max(CASE WHEN rn <= 2 THEN rn END) AS k FROM r GROUP BY target),
 t AS (SELECT r.target, r.mi AS last FROM r JOIN l ON r.target = l.target AND r.rn = l.k),
 pool AS (SELECT r.target, r.source, r.mi, row_number() OVER (PARTITION BY r.target ORDER BY r.rn) AS rank FROM r JOIN t ON r.target = t.target WHERE r.rn <= 2 OR r.mi >= t.last * 0.8)"""


@query(f"WITH {LI}, {_pairs_sql()}, {_POOL_SQL} SELECT target, source, round(mi, 8) AS score, CAST(rank AS INT) AS rank FROM pool WHERE rank <= 3")
def q_mi_candidate_pools(spark, sf):
    e = screening.mi_edges(li_store(spark, sf))
    return screening.candidate_pools(e, None, COLUMNS, _POOL).select("target", "source", F.round("score", 8).alias("score"), "rank")


@query(f"WITH {LI}, {_pairs_sql()}, {_POOL_SQL} SELECT target, source, round(0.7 * mi / max(mi) OVER (PARTITION BY target) + 0.3, 6) AS support FROM pool WHERE rank <= 3")
def q_support_matrix(spark, sf):
    e = screening.mi_edges(li_store(spark, sf))
    return screening.support(screening.candidate_pools(e, None, COLUMNS, _POOL), e).select("target", "source", F.round("support", 6).alias("support"))


_SHIFT = 0.0002
_ROUND_COLUMNS = ["flag", "status", "qty", "disc", "tax"]


def _round_sql() -> str:
    from itertools import combinations

    parts = [f"SELECT '{a}' AS a, '{b}' AS b, lnum AS boot, {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS n FROM li GROUP BY 1, 2, 3, 4, 5" for a, b in combinations(_ROUND_COLUMNS, 2)]
    return (
        "p AS (" + " UNION ALL ".join(parts) + "), w AS (SELECT a, b, boot, n, sum(n) OVER (PARTITION BY a, b, boot, x) AS nx, sum(n) OVER (PARTITION BY a, b, boot, y) AS ny, sum(n) OVER (PARTITION BY a, b, boot) AS t FROM p), "
        f"rounds AS (SELECT a AS target, b AS source, boot, sum(n / t * ln(n * t / (nx * ny))) - {_SHIFT} AS score FROM w GROUP BY a, b, boot)"
    )


@query(f"WITH {LI}, {_round_sql()} SELECT target, source, round(quantile_cont(score, 0.5), 8) AS score, round(avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END), 6) AS stability FROM rounds GROUP BY 1, 2")
def q_bootstrap_median_stability(spark, sf):
    names = F.lit(_ROUND_COLUMNS)
    c = information.pair_counts(collapse(li(spark, sf)), _ROUND_COLUMNS, "lnum").withColumnRenamed("z", "boot")
    from pyspark.sql import Window

    over = lambda *k: F.sum("n").over(Window.partitionBy("i", "j", "boot", *k))
    w = c.select("*", over("x").alias("nx"), over("y").alias("ny"), over().alias("t"))
    r = w.groupBy("i", "j", "boot").agg((F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))) - _SHIFT).alias("score"))
    r = r.select(F.element_at(names, F.col("i") + 1).alias("target"), F.element_at(names, F.col("j") + 1).alias("source"), "score")
    return screening.over_rounds(r, ["target", "source"]).select("target", "source", F.round("score", 8).alias("score"), F.round("stability", 6).alias("stability"))


#: (target, s1, s2, score) of scored pairs, some in more rounds than others.
BUNDLE_ROUNDS = [("flag", "status", "qty", s) for s in (0.4, 0.0, 0.2)] + [("flag", "status", "disc", s) for s in (0.3, 0.1)] + [("flag", "qty", "disc", s) for s in (0.0, 0.0, 0.9)] + [("flag", "qty", "tax", 0.15)] + [("tax", "disc", "qty", s) for s in (0.5, 0.6, 0.7)] + [("tax", "flag", "qty", s) for s in (0.6, 0.6, 0.1)]


def _values(rows, names: str) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({names})"


@query(
    f"WITH r AS (SELECT target, s1, s2, quantile_cont(CAST(score AS DOUBLE), 0.5) AS score, avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) AS stability FROM {_values(BUNDLE_ROUNDS, 'target, s1, s2, score')} GROUP BY 1, 2, 3), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, " + _PLACE_F("s1") + ", " + _PLACE_F("s2") + ") AS rank FROM r WHERE stability >= 0.34 AND score > 0) SELECT target, s1, s2, round(score, 6) AS score, round(stability, 6) AS stability, CAST(rank AS INT) AS rank FROM k WHERE rank <= 2"
)
def q_bundle_topk(spark, sf):
    r = spark.createDataFrame(BUNDLE_ROUNDS, "target string, s1 string, s2 string, score double")
    return screening.top_bundles(r, COLUMNS, 0.34, 2).select("target", "s1", "s2", F.round("score", 6).alias("score"), F.round("stability", 6).alias("stability"), "rank")


# --- scores ----------------------------------------------------------------------------------------------------------------

_BIC_SQL = "b AS (SELECT f, sum(CASE WHEN n > 0 THEN n * ln(n / r) ELSE 0 END) - 0.5 * (max(q) + 1) * max(v) * ln(sum(n)) AS bic FROM (SELECT f, q, v, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY f, q) AS DOUBLE) AS r FROM cells) x GROUP BY f)"


@query(f"WITH {LI}, {_grid(FAMILIES)}, {_BIC_SQL} SELECT CAST(f AS INT) AS f, round(bic, 3) AS bic FROM b")
def q_family_bic(spark, sf):
    return family_bic(complete_counts(collapse(li(spark, sf)), FAMILIES, CARDS)).select("f", F.round("bic", 3).alias("bic"))


@query(
    f"WITH {LI}, {_grid(FAMILIES)}, s AS (SELECT f, max(q) + 1 AS nq, max(v) + 1 AS nr FROM cells GROUP BY f), "
    "c AS (SELECT cells.f, cells.q, sum(cells.n) AS r, max(10.0 / s.nq) AS ar, sum(lgamma(10.0 / (s.nq * s.nr) + cells.n) - lgamma(10.0 / (s.nq * s.nr))) AS t FROM cells JOIN s ON cells.f = s.f WHERE cells.n > 0 GROUP BY cells.f, cells.q) "
    "SELECT CAST(f AS INT) AS f, round(sum(t + lgamma(ar) - lgamma(ar + r)), 3) AS bdeu FROM c GROUP BY f"
)
def q_family_bdeu(spark, sf):
    return family_bdeu(complete_counts(collapse(li(spark, sf)), FAMILIES, CARDS), 10.0).select("f", F.round("bdeu", 3).alias("bdeu"))


@query(f"WITH {LI}, {_grid(FAMILIES)} SELECT CAST(f AS INT) AS f, CAST(q AS BIGINT) AS q, CAST(v AS INT) AS v, CAST(n AS BIGINT) AS n, round((n + 1.0) / (sum(n) OVER (PARTITION BY f, q) + count(*) OVER (PARTITION BY f, q)), 8) AS p FROM cells")
def q_cpd_laplace(spark, sf):
    return cpd(complete_counts(collapse(li(spark, sf)), FAMILIES, CARDS)).select("f", "q", "v", "n", F.round("p", 8).alias("p"))


def _graph() -> Dag:
    return Dag(COLUMNS, GRAPH)


def _scorer(spark, sf) -> GraphScorer:
    return GraphScorer(li_store(spark, sf), TARGET, SearchConfig(), SUPPORT)


_EDGE_FAMILIES = [f for p, c in GRAPH for f in ((c, _graph().parents(c)), (c, tuple(x for x in _graph().parents(c) if x != p)))]


@query(
    f"WITH {LI}, {_grid(_EDGE_FAMILIES)}, {_BIC_SQL} SELECT source, target, round(x.bic - y.bic, 3) AS contribution FROM {_values([(p, c, 2 * i) for i, (p, c) in enumerate(GRAPH)], 'source, target, k')} JOIN b x ON x.f = k JOIN b y ON y.f = k + 1"
)
def q_edge_contribution(spark, sf):
    s = _scorer(spark, sf)
    return spark.createDataFrame([(p, c, float(s.contribution(_graph(), p, c))) for p, c in GRAPH], "source string, target string, contribution double").select("source", "target", F.round("contribution", 3).alias("contribution"))


_EDGE_VALUES = _values([(p, c, SUPPORT[c, p]) for p, c in GRAPH], "source, target, support")


@query(f"SELECT round(avg(2 * CAST(support AS DOUBLE) - 1), 6) AS prior FROM {_EDGE_VALUES}")
def q_graph_prior(spark, sf):
    e = spark.createDataFrame([(p, c, SUPPORT[c, p]) for p, c in GRAPH], "source string, target string, support double")
    return e.agg(F.round(F.avg(2 * F.col("support") - 1), 6).alias("prior"))


_HUB = [("a", x) for x in "bcdef"] + [("b", "c"), ("b", "d"), ("b", "e")]


@query(f"SELECT round(sum(greatest(d - 2, 0)) / 6.0 / 6.0, 6) AS hub FROM (SELECT source, count(*) AS d FROM {_values(_HUB, 'source, target')} GROUP BY source) x")
def q_hub_penalty(spark, sf):
    return spark.createDataFrame([(GraphScorer.hub_penalty(Dag("abcdef", _HUB)),)], "hub double").select(F.round("hub", 6).alias("hub"))


#: Families that the class depends on in the fixed graph: the target's own and those of its children.
_BLANKET = [(TARGET, _graph().parents(TARGET))] + [(c, _graph().parents(c)) for c in sorted(_graph().children(TARGET))]


def _posterior_sql(families, row: str, name: str = "post") -> str:
    """CTEs for the class scores (row columns, w, y, s) of distinct rows under a network's relevant families."""
    tables = f"{_grid(families)}, t AS (SELECT f, q, v, ln((n + 1.0) / (sum(n) OVER (PARTITION BY f, q) + count(*) OVER (PARTITION BY f, q)) + 1e-12) AS l FROM cells)"
    joins, terms = "", []
    for i, (node, parents) in enumerate(families):
        value = "y.y" if node == TARGET else f"d.{node}"
        index = "0"
        for p in parents:
            index = f"({index}) * {CARDS[p]} + {'y.y' if p == TARGET else 'd.' + p}"
        joins += f" JOIN t t{i} ON t{i}.f = {i} AND t{i}.q = {index} AND t{i}.v = {value}"
        terms.append(f"t{i}.l")
    return f"{tables}, d AS (SELECT {row}, count(*) AS w FROM li GROUP BY {row}), s AS (SELECT d.*, y.y AS y, {' + '.join(terms)} AS s FROM d CROSS JOIN (SELECT i AS y FROM generate_series(0, {CARDS[TARGET] - 1}) g(i)) y{joins}), m AS (SELECT *, max(s) OVER (PARTITION BY {row}) AS top FROM s), {name} AS (SELECT *, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY {row}) AS p FROM m)"


_ROW = ", ".join(COLUMNS)


@query(f"WITH {LI}, {_posterior_sql(_BLANKET, _ROW)} SELECT round(sum(w * ln(p)), 3) AS loglik FROM post WHERE y = flag")
def q_mb_loglik(spark, sf):
    s = _scorer(spark, sf)
    return spark.createDataFrame([(s.blanket_log_likelihood(s.blanket_key(_graph())),)], "loglik double").select(F.round("loglik", 3).alias("loglik"))


_ALL_FAMILIES = _graph().families()


@query(
    f"WITH {LI}, g AS (WITH {_grid(_ALL_FAMILIES)}, {_BIC_SQL} SELECT sum(bic) AS gen FROM b), l AS (WITH {_posterior_sql(_BLANKET, _ROW)} SELECT sum(w * ln(p)) AS disc, sum(w) AS n FROM post WHERE y = flag) "
    f"SELECT round(gen / n, 6) AS generative, round(disc / n, 6) AS discriminative, round(pr, 6) AS prior, round(gen / n + disc / n + 0.5 * pr - 0.1 * hub, 6) AS total FROM g, l, (SELECT avg(2 * CAST(support AS DOUBLE) - 1) AS pr FROM {_EDGE_VALUES}) x, "
    f"(SELECT sum(greatest(d - 2, 0)) / 6.0 / 6.0 AS hub FROM (SELECT source, count(*) AS d FROM {_EDGE_VALUES} GROUP BY source) z) h"
)
def q_graph_score(spark, sf):
    r = _scorer(spark, sf).score(_graph())
    d = spark.createDataFrame([(r["generative"], r["discriminative"], r["prior"], r["total"])], "generative double, discriminative double, prior double, total double")
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


# --- networks and classifiers ------------------------------------------------------------------------------------------------

_NB = [(TARGET, ()), *((c, (TARGET,)) for c in _FEATURES)]
_FROW = ", ".join(_FEATURES)
_WIDE = "round(max(CASE WHEN y = 0 THEN p END), 6) AS p0, round(max(CASE WHEN y = 1 THEN p END), 6) AS p1, round(max(CASE WHEN y = 2 THEN p END), 6) AS p2"


def _wide(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(F.element_at("probabilities", k + 1), 6).alias(f"p{k}") for k in range(3)])


@query(f"WITH {LI}, {_posterior_sql(_NB, _FROW)} SELECT {_FROW}, {_WIDE} FROM post GROUP BY {_FROW}")
def q_nb_posterior(spark, sf):
    store = li_store(spark, sf)
    net = BayesNet.fit(store, naive_bayes_graph(COLUMNS, TARGET), TARGET)
    return _wide(net.posterior(collapse(store.collapsed, _FEATURES).withColumn(TARGET, F.lit(0))), _FEATURES)


@query(f"WITH {LI}, {_posterior_sql(_NB, _FROW)} SELECT CAST(y AS INT) AS y, round(sum(w * p), 3) AS total FROM post GROUP BY y")
def q_nb_row_totals(spark, sf):
    df = li(spark, sf)
    net = BayesNet.fit(CountStore(df, cards=CARDS), naive_bayes_graph(COLUMNS, TARGET), TARGET)
    return net.posterior(df).select(F.posexplode("probabilities").alias("y", "p")).groupBy("y").agg(F.round(F.sum("p"), 3).alias("total"))


@query(f"WITH {LI}, {_posterior_sql(_BLANKET, _FROW)} SELECT {_FROW}, {_WIDE} FROM post GROUP BY {_FROW}")
def q_bn_posterior(spark, sf):
    store = li_store(spark, sf)
    net = BayesNet.fit(store, _graph(), TARGET)
    return _wide(net.posterior(collapse(store.collapsed, _FEATURES).withColumn(TARGET, F.lit(0))), _FEATURES)


@query(f"WITH {LI}, {_posterior_sql(_BLANKET, _FROW)}, r AS (SELECT y, w, row_number() OVER (PARTITION BY {_FROW} ORDER BY round(p, 9) DESC, y) AS k FROM post) SELECT CASE y WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS predicted, CAST(sum(w) AS BIGINT) AS n FROM r WHERE k = 1 GROUP BY 1")
def q_bn_predict(spark, sf):
    df = li(spark, sf)
    net = BayesNet.fit(CountStore(df, cards=CARDS), _graph(), TARGET)
    best = F.array_position(F.transform("probabilities", lambda p: F.round(p, 9)), F.array_max(F.transform("probabilities", lambda p: F.round(p, 9))))
    return net.posterior(df).groupBy(F.element_at(F.lit(["A", "N", "R"]), best.cast("int")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {LI}, i AS (WITH {_pairs_sql()} SELECT source AS f, row_number() OVER (ORDER BY mi DESC, {_PLACE_F('source')}) AS k FROM mm WHERE target = 'flag'), "
    f"c AS (WITH {_pairs_sql(TARGET, _FEATURES)} SELECT target, source, mi FROM mm), "
    "r AS (SELECT c.source, c.target, row_number() OVER (PARTITION BY c.target ORDER BY c.mi DESC, b.k) AS n FROM c JOIN i a ON a.f = c.target JOIN i b ON b.f = c.source WHERE b.k < a.k) "
    "SELECT source, target FROM r WHERE n <= 2 UNION ALL SELECT 'flag', f FROM i"
)
def q_kdb_edges(spark, sf):
    return spark.createDataFrame(kdb_graph(li_store(spark, sf), TARGET, 2).edges(), "source string, target string")


@query(
    f"WITH RECURSIVE {LI}, c AS (WITH {_pairs_sql(TARGET, _FEATURES)} SELECT a, b, mi FROM m), e AS (SELECT a AS u, b AS v, mi FROM c UNION ALL SELECT b, a, mi FROM c), "
    "walk AS (SELECT a AS a, b AS b, mi AS lim, a AS pos FROM c UNION SELECT walk.a, walk.b, walk.lim, e.v FROM walk JOIN e ON e.u = walk.pos AND e.mi > walk.lim), "
    "joined AS (SELECT DISTINCT a, b FROM walk WHERE pos = b), tree AS (SELECT c.a, c.b FROM c LEFT JOIN joined j ON j.a = c.a AND j.b = c.b WHERE j.a IS NULL), "
    "te AS (SELECT a AS u, b AS v FROM tree UNION ALL SELECT b, a FROM tree), "
    f"dist AS (SELECT '{_FEATURES[0]}' AS node, '' AS parent, 0 AS d UNION SELECT te.v, te.u, dist.d + 1 FROM dist JOIN te ON te.u = dist.node AND te.v <> dist.parent WHERE dist.d < 6) "
    "SELECT parent AS source, node AS target FROM dist WHERE d > 0 UNION ALL " + " UNION ALL ".join(f"SELECT 'flag', '{f}'" for f in _FEATURES)
)
def q_tan_edges(spark, sf):
    return spark.createDataFrame(tan_graph(li_store(spark, sf), TARGET).edges(), "source string, target string")


def _aode_counts_sql() -> str:
    fs = ["status", "disc", "tax"]
    row = ", ".join(fs)
    ctes = [f"d AS (SELECT DISTINCT {row} FROM li)", "y AS (SELECT i AS y FROM generate_series(0, 2) g(i))", "tot AS (SELECT count(*) AS t FROM li)"]
    ctes += [f"j_{p} AS (SELECT flag, {p}, count(*) AS n FROM li GROUP BY 1, 2)" for p in fs]
    ctes += [f"k_{p}_{c} AS (SELECT flag, {p}, {c}, count(*) AS n FROM li GROUP BY 1, 2, 3)" for p in fs for c in fs if c != p]
    parts = []
    for p in fs:
        joins = f" LEFT JOIN j_{p} j ON j.flag = y.y AND j.{p} = d.{p}"
        s = f"ln((coalesce(j.n, 0) + 1.0) / (tot.t + {CARDS['flag'] * CARDS[p]}.0) + 1e-12)"
        for c in fs:
            if c != p:
                joins += f" LEFT JOIN k_{p}_{c} k{c} ON k{c}.flag = y.y AND k{c}.{p} = d.{p} AND k{c}.{c} = d.{c}"
                s += f" + ln((coalesce(k{c}.n, 0) + 1.0) / (coalesce(j.n, 0) + {CARDS[c]}.0) + 1e-12)"
        parts.append(f"SELECT {', '.join('d.' + f + ' AS ' + f for f in fs)}, '{p}' AS sp, y.y AS y, {s} AS s FROM d CROSS JOIN y CROSS JOIN tot{joins}")
    ctes += [f"s AS ({' UNION ALL '.join(parts)})", f"e AS (SELECT {row}, y, exp(s - max(s) OVER (PARTITION BY {row}, sp)) AS e FROM s)", f"t AS (SELECT {row}, y, sum(e) AS e FROM e GROUP BY {row}, y)", f"post AS (SELECT {row}, y, e / sum(e) OVER (PARTITION BY {row}) AS p FROM t)"]
    return ", ".join(ctes)


@query(f"WITH {LI}, {_aode_counts_sql()} SELECT status, disc, tax, {_WIDE} FROM post GROUP BY status, disc, tax")
def q_aode_posterior(spark, sf):
    cols = ["flag", "status", "disc", "tax"]
    df = li(spark, sf).select(*cols)
    store = CountStore(df, cards={c: CARDS[c] for c in cols})
    return _wide(Aode(store, TARGET).posterior(collapse(df, cols[1:])), cols[1:])


# --- graph questions -------------------------------------------------------------------------------------------------------

_G = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("f", "e"), ("e", "g")]
_GV = _values(_G, "source, target")


@query(f"WITH RECURSIVE e AS (SELECT source, target FROM {_GV}), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source) SELECT source, target FROM r")
def q_reachability(spark, sf):
    return reachability(spark.createDataFrame(_G, "source string, target string"), 6)


_CYCLIC = [*_G, ("g", "a")]


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS graph, NOT EXISTS (WITH RECURSIVE e AS (SELECT source, target FROM {_values(g, 'source, target')}), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source) SELECT 1 FROM r WHERE source = target) AS acyclic"
        for n, g in (("dag", _G), ("ring", _CYCLIC))
    )
)
def q_acyclic_check(spark, sf):
    names = sorted({n for e in _CYCLIC for n in e})
    return spark.createDataFrame([("dag", Dag(names, _G).acyclic()), ("ring", Dag(names, _CYCLIC).acyclic())], "graph string, acyclic boolean")


@query(
    f"WITH e AS (SELECT source, target FROM {_GV}), m AS (SELECT source AS member, 1 AS r FROM e WHERE target = 'c' UNION ALL SELECT target, 2 FROM e WHERE source = 'c' UNION ALL SELECT x.source, 3 FROM e x JOIN e y ON x.target = y.target WHERE y.source = 'c' AND x.source <> 'c') "
    "SELECT member, CASE min(r) WHEN 1 THEN 'parent' WHEN 2 THEN 'child' ELSE 'spouse' END AS role FROM m GROUP BY member"
)
def q_markov_blanket(spark, sf):
    return markov_blanket(spark.createDataFrame(_G, "source string, target string"), "c")


_NODES = sorted({n for e in _G for n in e})


def _climb(spark) -> HillClimb:
    class Fixed:
        columns, cards, rows = _NODES, dict.fromkeys(_NODES, 2), 1.0

    return HillClimb(Fixed(), "a", SearchConfig(max_additions_per_child=99), {c: [p for p in _NODES if p != c] for c in _NODES})


_REACH = f"WITH RECURSIVE e AS (SELECT source, target FROM {_GV}), n AS (SELECT DISTINCT source AS x FROM e UNION SELECT DISTINCT target FROM e), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source), deg AS (SELECT n.x, count(e.source) AS d FROM n LEFT JOIN e ON e.target = n.x GROUP BY n.x)"


@query(f"{_REACH} SELECT p.x AS source, c.x AS target FROM n p CROSS JOIN n c JOIN deg ON deg.x = c.x LEFT JOIN e ON e.source = p.x AND e.target = c.x LEFT JOIN r ON r.source = c.x AND r.target = p.x WHERE p.x <> c.x AND deg.d < 3 AND e.source IS NULL AND r.source IS NULL")
def q_legal_additions(spark, sf):
    ops = [op.split()[1].split("->") for op, _ in _climb(spark).proposals(Dag(_NODES, _G)) if op.startswith("add")]
    return spark.createDataFrame([tuple(x) for x in ops], "source string, target string")


@query(
    f"WITH RECURSIVE e AS (SELECT source, target FROM {_GV}), deg AS (SELECT target AS x, count(*) AS d FROM e GROUP BY 1), r AS (SELECT a.source AS es, a.target AS et, b.target AS at FROM e a JOIN e b ON b.source = a.source AND b.target <> a.target UNION SELECT r.es, r.et, e.target FROM r JOIN e ON e.source = r.at WHERE NOT (e.source = r.es AND e.target = r.et)) "
    "SELECT e.source, e.target FROM e LEFT JOIN deg ON deg.x = e.source WHERE coalesce(deg.d, 0) < 3 AND NOT EXISTS (SELECT 1 FROM r WHERE r.es = e.source AND r.et = e.target AND r.at = e.target)"
)
def q_legal_reversals(spark, sf):
    ops = [op.split()[1].split("->") for op, _ in _climb(spark).proposals(Dag(_NODES, _G)) if op.startswith("reverse")]
    return spark.createDataFrame([tuple(x) for x in ops], "source string, target string")


# --- metrics ---------------------------------------------------------------------------------------------------------------

_TRUTH = [("a", "b"), ("c", "b"), ("a", "d"), ("d", "c"), ("e", "f"), ("e", "g"), ("g", "h")]
_J = f"p AS (SELECT source, target FROM {_GV}), t AS (SELECT source, target FROM {_values(_TRUTH, 'source, target')})"


@query(f"WITH {_J}, d AS (SELECT * FROM (SELECT * FROM p EXCEPT SELECT * FROM t) x UNION ALL SELECT * FROM (SELECT * FROM t EXCEPT SELECT * FROM p) y) SELECT CAST(count(*) // 2 AS BIGINT) AS shd, CAST(count(DISTINCT least(source, target) || '|' || greatest(source, target)) AS BIGINT) AS shd_textbook FROM d")
def q_shd(spark, sf):
    e = lambda g: spark.createDataFrame(g, "source string, target string")
    return metrics.shd_frame(e(_G), e(_TRUTH)).select("shd", "shd_textbook")


@query(f"WITH {_J}, h AS (SELECT count(*) AS h FROM (SELECT * FROM p INTERSECT SELECT * FROM t) x), n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt) SELECT round(h * 1.0 / np, 6) AS precision, round(h * 1.0 / nt, 6) AS recall, round(2.0 * h / (np + nt), 6) AS f1 FROM h, n")
def q_edge_prf(spark, sf):
    e = lambda g: spark.createDataFrame(g, "source string, target string")
    return metrics.shd_frame(e(_G), e(_TRUTH)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_POOLS_SQL = f"WITH {LI}, {_pairs_sql()}, {_POOL_SQL}, k AS (SELECT source, target FROM pool WHERE rank <= 3)"


def _pools(spark, sf) -> DataFrame:
    return screening.candidate_pools(screening.mi_edges(li_store(spark, sf)), None, COLUMNS, _POOL)


@query(f"{_POOLS_SQL} SELECT round(1 - count(*) / 30.0, 6) AS reduction FROM k")
def q_pool_reduction(spark, sf):
    pools = {c: [] for c in COLUMNS}
    for r in _pools(spark, sf).collect():
        pools[r["target"]].append(r["source"])
    return spark.createDataFrame([(metrics.pool_reduction(pools),)], "reduction double").select(F.round("reduction", 6).alias("reduction"))


@query(f"{_POOLS_SQL} SELECT round(count(k.source) * 1.0 / count(*), 6) AS recall FROM {_EDGE_VALUES} LEFT JOIN k ON k.source = v.source AND k.target = v.target")
def q_parent_recall(spark, sf):
    pools = {c: [] for c in COLUMNS}
    for r in _pools(spark, sf).collect():
        pools[r["target"]].append(r["source"])
    return spark.createDataFrame([(metrics.parent_recall(pools, GRAPH),)], "recall double").select(F.round("recall", 6).alias("recall"))


_SCORED = f"WITH {LI}, {_posterior_sql(_BLANKET, _ROW)}"


def _scored(spark, sf) -> DataFrame:
    df = li(spark, sf)
    return BayesNet.fit(CountStore(df, cards=CARDS), _graph(), TARGET).posterior(df).select(F.col(TARGET).alias("y"), "probabilities")


@query(f"{_SCORED} SELECT round(sum(-w * ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16))) / sum(w), 6) AS log_loss FROM post WHERE y = flag")
def q_log_loss(spark, sf):
    return metrics.log_loss(_scored(spark, sf)).select(F.round("log_loss", 6).alias("log_loss"))


@query(f"{_SCORED} SELECT round(sum(w * (p - CASE WHEN y = flag THEN 1 ELSE 0 END) * (p - CASE WHEN y = flag THEN 1 ELSE 0 END)) / (SELECT count(*) FROM li), 6) AS brier FROM post")
def q_brier_multi(spark, sf):
    return metrics.brier(_scored(spark, sf), 3).select(F.round("brier", 6).alias("brier"))


_AUC = "g AS (SELECT y AS k, round(p, 12) AS s, sum(w) AS n, sum(CASE WHEN y = flag THEN w ELSE 0 END) AS pos FROM post GROUP BY 1, 2), r AS (SELECT k, n, pos, coalesce(sum(n) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM g), a AS (SELECT k, (sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(n - pos)) AS auc FROM r GROUP BY k)"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("probabilities", F.transform("probabilities", lambda p: F.round(p, 12)))


@query(f"{_SCORED}, {_AUC} SELECT round(avg(auc), 6) AS roc_auc FROM a")
def q_auc_ovr_macro(spark, sf):
    return metrics.auc(_rounded(_scored(spark, sf)), 3).select(F.round("roc_auc", 6).alias("roc_auc"))


_CONF = "c AS (SELECT w, y, flag, p, row_number() OVER (PARTITION BY " + _ROW + " ORDER BY p DESC, y) AS k FROM post)"


@query(f"{_SCORED}, {_CONF}, b AS (SELECT {_case('p', metrics.ece_edges()[1:-1])} AS b, sum(w) AS n, sum(w * p) / sum(w) AS conf, sum(CASE WHEN y = flag THEN w ELSE 0 END) * 1.0 / sum(w) AS acc FROM c WHERE k = 1 GROUP BY 1) SELECT round(sum(n * abs(conf - acc)) / sum(n), 5) AS ece FROM b")
def q_ece(spark, sf):
    return metrics.ece(_scored(spark, sf)).select(F.round("ece", 5).alias("ece"))


#: A two-class view: documents with labels; the score is naive Bayes with one feature, the language.
_DL = "dl AS (SELECT l.quality AS y, d.lang AS x FROM documents d JOIN labels l ON d.doc_id = l.doc_id), n AS (SELECT x, sum(y) + 1.0 AS a, count(*) + 2.0 AS b FROM dl GROUP BY x), s AS (SELECT dl.y, n.a / n.b AS p FROM dl JOIN n ON dl.x = n.x)"


def _dl(spark, sf) -> DataFrame:
    dl = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    n = dl.groupBy("lang").agg(((F.sum("y") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("p"))
    return dl.join(n, "lang").select("y", F.array(1 - F.col("p"), F.col("p")).alias("probabilities"))


@query(f"WITH {_DL} SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM s")
def q_brier_bin(spark, sf):
    return metrics.brier(_dl(spark, sf), 2).select(F.round("brier", 6).alias("brier"))


@query(f"WITH {_DL}, g AS (SELECT p, count(*) AS n, sum(y) AS pos FROM s GROUP BY p), r AS (SELECT n, pos, coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM g) SELECT round((sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(n - pos)), 6) AS roc_auc FROM r")
def q_auc_binary(spark, sf):
    return metrics.auc(_dl(spark, sf), 2).select(F.round("roc_auc", 6).alias("roc_auc"))


# --- splits ----------------------------------------------------------------------------------------------------------------


@query(
    "WITH c AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT k, n, CAST(ceil(n * 0.2) AS BIGINT) AS nt FROM c), v AS (SELECT k, n, nt, CAST(ceil((n - nt) * 0.2) AS BIGINT) AS nv FROM t) "
    "SELECT k, 'test' AS split, nt AS n FROM v UNION ALL SELECT k, 'valid', nv FROM v UNION ALL SELECT k, 'train', n - nt - nv FROM v"
)
def q_stratified_split_sizes(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return holdout(df, 7, 0.2, 0.2, "o_orderpriority").groupBy(F.col("o_orderpriority").alias("k"), "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH t AS (SELECT n, CAST(ceil(n * 0.25) AS BIGINT) AS nt FROM (SELECT count(*) AS n FROM events) c), v AS (SELECT n, nt, CAST(ceil((n - nt) * 0.2) AS BIGINT) AS nv FROM t) "
    "SELECT 'test' AS split, nt AS n FROM v UNION ALL SELECT 'valid', nv FROM v UNION ALL SELECT 'train', n - nt - nv FROM v"
)
def q_holdout_split_sizes(spark, sf):
    return holdout(table(spark, sf, "events").select("event_id", "event_type"), 7, 0.25, 0.2).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- evidence --------------------------------------------------------------------------------------------------------------

_M, _GR = decisions.METHOD, decisions.GREEDY


def _records() -> list[tuple]:
    """Made-up runs: model, dataset, regime, split, ablation, status, auc, shd, seconds."""
    out = []
    for d, (s, g, nb, sec, fast) in {"alarm": (26.0, 27.5, 30.0, 3.0, 1.0), "child": (11.5, 12.0, 11.0, 2.0, 0.4), "insurance": (20.0, 26.0, 27.0, 2.5, 0.5), "syn": (3.0, 3.0, 5.0, 0.5, 0.6)}.items():
        for k in (0, 1):
            out += [(_M, d, "known_graph", f"{d}-{k}", "default", "ok", 0.9, s + k, sec + k), (_GR, d, "known_graph", f"{d}-{k}", "default", "ok", 0.85, g + k, 1.0 + k), ("naive_bayes", d, "known_graph", f"{d}-{k}", "default", "ok", 0.8, nb + k, 0.1)]
            out += [(_M, d, "known_graph", f"{d}-{k}", "known_graph_fast", "ok", 0.88, s + k + (0.5 if d != "alarm" else 4), fast + k)]
        out += [(_M, d, "known_graph", f"{d}-0", "mi_filter_fast", "failed" if d == "syn" else "ok", 0.87, s, 0.3)]
    for d, (m, x, c) in {"bc": (0.97, 0.98, 0.99), "wine": (0.95, 0.99, 0.985)}.items():
        out += [(_M, d, "real", f"{d}-0", "default", "ok", m, None, 1.5), ("xgboost", d, "real", f"{d}-0", "default", "ok", x, None, 0.2), ("catboost", d, "real", f"{d}-0", "default", "ok", c, None, 0.7), ("tabpfn", d, "real", f"{d}-0", "default", "skipped", None, None, None)]
    return out


_R = f"rec AS (SELECT model_name, dataset_name, dataset_regime, split_id, ablation_label, status, CAST(auc AS DOUBLE) AS auc, CAST(shd AS DOUBLE) AS shd, CAST(sec AS DOUBLE) AS sec FROM {_values(_records(), 'model_name, dataset_name, dataset_regime, split_id, ablation_label, status, auc, shd, sec')})"


def records(spark: SparkSession) -> DataFrame:
    some = lambda k, v: {k: v} if v is not None else {}
    rows = [(m, d, r, s, 7, a, "x", st, [], some("roc_auc", auc), some("shd", shd) or None, {}, some("total_seconds", sec)) for m, d, r, s, a, st, auc, shd, sec in _records()]
    return spark.createDataFrame(rows, decisions.RECORD)


@query(f"WITH {_R} SELECT dataset_name, model_name, round(avg(auc), 6) AS avg_roc_auc, round(avg(shd), 6) AS avg_shd, round(avg(sec), 6) AS avg_total_seconds, count(*) AS num_runs FROM rec WHERE status = 'ok' AND ablation_label = 'default' GROUP BY 1, 2")
def q_leaderboard(spark, sf):
    ok = records(spark).where("status = 'ok' AND ablation_label = 'default'")
    b = decisions.leaderboard(ok, ["roc_auc", "shd"], ["total_seconds"])
    return b.select("dataset_name", "model_name", *[F.round(c, 6).alias(c) for c in ("avg_roc_auc", "avg_shd", "avg_total_seconds")], "num_runs")


@query(f"WITH {_R} SELECT dataset_name, ablation_label, round(avg(auc), 6) AS avg_roc_auc, round(avg(shd), 6) AS avg_shd, round(avg(sec), 6) AS avg_total_seconds, count(*) AS num_runs FROM rec WHERE status = 'ok' AND ablation_label <> 'default' AND model_name = '{_M}' GROUP BY 1, 2")
def q_ablation_summary(spark, sf):
    t = decisions.suite_tables(records(spark))["ablation_summary"]
    return t.select("dataset_name", "ablation_label", *[F.round(c, 6).alias(c) for c in ("avg_roc_auc", "avg_shd", "avg_total_seconds")], "num_runs")


_LB = f"lb AS (SELECT dataset_name, model_name, avg(auc) AS auc, avg(shd) AS shd, avg(sec) AS sec FROM rec WHERE status = 'ok' AND ablation_label = 'default' GROUP BY 1, 2), known AS (SELECT DISTINCT dataset_name FROM rec WHERE status = 'ok' AND ablation_label = 'default' AND dataset_regime = 'known_graph'), real_ AS (SELECT DISTINCT dataset_name FROM rec WHERE status = 'ok' AND ablation_label = 'default' AND dataset_regime = 'real')"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(
    f"WITH {_R}, {_LB}, b AS (SELECT lb.dataset_name, min(shd) AS best FROM lb JOIN known USING (dataset_name) WHERE model_name IN {_IN(decisions.EXPLICIT)} GROUP BY 1), s AS (SELECT b.dataset_name, m.shd AS mine, b.best, m.sec AS ms, g.sec AS gs FROM b JOIN lb m ON m.dataset_name = b.dataset_name AND m.model_name = '{_M}' LEFT JOIN lb g ON g.dataset_name = b.dataset_name AND g.model_name = '{_GR}'), "
    f"x AS (SELECT lb.dataset_name, max(auc) AS best FROM lb JOIN real_ USING (dataset_name) WHERE model_name IN {_IN(decisions.STRONG)} GROUP BY 1), p AS (SELECT x.best - m.auc AS gap FROM x JOIN lb m ON m.dataset_name = x.dataset_name AND m.model_name = '{_M}'), "
    "a AS (SELECT count(*) AS structural_datasets, count(CASE WHEN best > mine THEN 1 END) AS structural_wins, count(CASE WHEN ms IS NOT NULL AND gs IS NOT NULL THEN 1 END) AS runtime_datasets, count(CASE WHEN ms < gs THEN 1 END) AS runtime_wins FROM s), c AS (SELECT count(*) AS predictive_datasets, count(CASE WHEN gap <= 0.03 THEN 1 END) AS predictive_wins FROM p) "
    "SELECT *, structural_datasets > 0 AND structural_wins >= ceil(structural_datasets / 2.0) AS structural_pass, runtime_datasets > 0 AND runtime_wins >= ceil(runtime_datasets / 2.0) AS runtime_pass, predictive_datasets > 0 AND predictive_wins >= ceil(predictive_datasets / 2.0) AS predictive_pass FROM a, c"
)
def q_evidence_decision(spark, sf):
    r = records(spark)
    t = decisions.suite_tables(r)
    sets = lambda g: r.where((F.col("status") == "ok") & (F.col("ablation_label") == "default") & (F.col("dataset_regime") == g)).select("dataset_name").distinct()
    return decisions.criteria(decisions.structural_comparison(t["structural_leaderboard"], t["search_complexity"], sets("known_graph")), decisions.predictive_comparison(t["predictive_leaderboard"], sets("real")))


@query(
    f"WITH {_R}, {_LB}, ab AS (SELECT dataset_name, ablation_label, avg(shd) AS shd, avg(sec) AS sec FROM rec WHERE status = 'ok' AND ablation_label <> 'default' AND model_name = '{_M}' GROUP BY 1, 2), l AS (SELECT ablation_label FROM {_values([(x,) for x in decisions.PROBED], 'ablation_label')}), "
    f"j AS (SELECT ab.ablation_label, ab.shd, ab.sec, m.shd AS dshd, m.sec AS dsec, g.sec AS gsec FROM ab JOIN lb m ON m.dataset_name = ab.dataset_name AND m.model_name = '{_M}' AND m.shd IS NOT NULL LEFT JOIN lb g ON g.dataset_name = ab.dataset_name AND g.model_name = '{_GR}'), "
    "k AS (SELECT ablation_label, min(CASE WHEN sec < dsec THEN 1 ELSE 0 END) = 1 AS f, count(CASE WHEN sec < gsec THEN 1 END) AS r, count(CASE WHEN shd <= dshd + 2 THEN 1 END) AS s FROM j GROUP BY 1), "
    f"z AS (SELECT ablation_label, count(*) AS n FROM rec WHERE model_name = '{_M}' AND dataset_regime = 'known_graph' AND status <> 'ok' GROUP BY 1) "
    "SELECT l.ablation_label, coalesce(k.f, false) AS runtime_faster_than_default_all, coalesce(k.r, 0) AS runtime_vs_greedy_win_count, coalesce(k.s, 0) AS shd_within_default_plus_two_count, coalesce(z.n, 0) AS skipped_runs, coalesce(k.f, false) AND coalesce(k.r, 0) >= 3 AND coalesce(k.s, 0) >= 4 AND coalesce(z.n, 0) = 0 AS promotable FROM l LEFT JOIN k USING (ablation_label) LEFT JOIN z USING (ablation_label)"
)
def q_promotion_gate(spark, sf):
    r = records(spark)
    return decisions.promotion_gates(decisions.promotion_rows(decisions.suite_tables(r)), r)


@query(
    f"WITH {LI}, {_grid(_EDGE_FAMILIES)}, {_BIC_SQL}, e AS (SELECT source, target, CAST(support AS DOUBLE) AS support, k FROM {_values([(p, c, SUPPORT[c, p], 2 * i) for i, (p, c) in enumerate(GRAPH)], 'source, target, support, k')}), o AS (SELECT source, count(*) AS d FROM e GROUP BY 1), "
    "c AS (SELECT e.source, e.target, e.support, x.bic - y.bic AS gain, o.d FROM e JOIN o ON o.source = e.source JOIN b x ON x.f = k JOIN b y ON y.f = k + 1) "
    "SELECT source, target, CAST(row_number() OVER (ORDER BY support, gain, -d, source, target) AS INT) AS rank FROM c WHERE NOT (support >= 0.75 AND gain > 0)"
)
def q_prune_ranking(spark, sf):
    h = HillClimb(li_store(spark, sf), TARGET, SearchConfig(), {}, SUPPORT)
    return spark.createDataFrame([(p, c, i + 1) for i, (p, c) in enumerate(h.prune_order(_graph()))], "source string, target string, rank int")


# --- searches, generators and the estimator ----------------------------------------------------------------------------------


@query()
def q_hill_climb_edges(spark, sf):
    store = li_store(spark, sf)
    s = screening.screen(None, None, store, ScreenerConfig(strategy="mi_filter"))
    r = HillClimb(store, TARGET, SearchConfig(), s.pools, screening.search_support(s)).fit()
    return spark.createDataFrame(r.graph.edges(), "source string, target string")


@query()
def q_mlp_edge_scores(spark, sf):
    from .operators.neural import neural_edges

    orders, cores = table(spark, sf, "orders"), spark.sparkContext.defaultParallelism
    if orders.rdd.getNumPartitions() < cores:  # a small file is one task or a few, in each of many passes
        orders = orders.repartition(cores)
    df = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderpriority", "o_orderstatus", "c_mktsegment", "o_totalprice").persist()
    config = ScreenerConfig(epochs=3, bootstraps=2)
    edges, _ = neural_edges(TableEncoder("o_orderpriority").fit(df), df, config)
    df.unpersist()
    return screening.over_rounds(edges, ["target", "source"])


def _pipeline_table(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax")


@query()
def q_pipeline_predictions(spark, sf):
    """Fit on all rows with the information filter, then score all rows."""
    df = _pipeline_table(spark, sf)
    config = PipelineConfig("l_returnflag", screener=ScreenerConfig(strategy="mi_filter"), search=SearchConfig(max_iters=10))
    return BayesNetClassifier(config).fit(df).transform(df)


@query()
def q_synthetic_dag_sample(spark, sf):
    return mixed_dataset(spark, 500, 6, 7)[0]


@query()
def q_forward_sample(spark, sf):
    g = Dag(_NODES, _G)
    cards = dict.fromkeys(_NODES, 3)
    return forward_sample(spark, g, random_tables(g, cards, 1), cards, 2_500, 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession) -> DataFrame:
    return q_pipeline_predictions(spark, "/root/testdata/sf0.001")
