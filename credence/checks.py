"""Further named queries: sources and sinks, fitted encoders, searches, runners and suites, each with the SQL that gives the
same rows. Where an operation works on settings or small records rather than on tables, both sides state them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as base
from .config import PipelineConfig, ScreenerConfig, SearchConfig, ablations
from .operators import metrics, screening
from .operators.counts import CountStore, collapse, family_scores
from .operators.dictionary import dictionaries
from .operators.graph import Dag
from .operators.network import BayesNet
from .operators.scores import GraphScorer
from .operators.search import HillClimb, better
from .plans import decisions, experiments, report
from .plans.encoding import TableEncoder, entropy_bins, entropy_bins_in_cells, sanitize_names, sparse_dummies
from .plans.pipeline import BayesNetClassifier
from .sources import files
from .sources.datasets import CsvAdapter, Dataset, GraphFolderAdapter, InMemoryAdapter, ParquetAdapter, Split, SyntheticAdapter, holdout, registry, suites
from .sources.generators import forward_sample, mixed_dataset, random_tables

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
table, _values, LI, CARDS, COLUMNS, TARGET = base.table, base._values, base.LI, base.CARDS, base.COLUMNS, base.TARGET


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        _Q[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def given(rows, names: str) -> str:
    return f"SELECT * FROM {_values(rows, names)}"


# --- sources and sinks -----------------------------------------------------------------------------------------------------


@query(
    "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 10 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal AS balance, c_custkey % 2 = 0 AS even, "
    "CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS BIGINT) END AS nation FROM customer"
)
def q_csv_adapter(spark, sf):
    """Header, inferred types and missing texts of a CSV folder."""
    at = files.scratch(spark, "csv")
    c = table(spark, sf, "customer")
    segment = F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, "NA").otherwise(F.col("c_mktsegment"))
    c.select(F.col("c_custkey").alias("id"), segment.alias("segment"), F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 2 == 0).alias("even"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("nation")).write.option("header", True).csv(at)
    source = CsvAdapter(at, "segment", "customers")
    return source.load(spark).frame if source.available(spark) else None


@query(
    f"SELECT v.source, v.target, CAST(n.n AS BIGINT) AS rows, 'l_linestatus' AS target_column, 'known_graph' AS regime FROM {_values([('l_returnflag', 'l_linestatus'), ('l_linestatus', 'ghost')], 'source, target')} CROSS JOIN (SELECT count(*) AS n FROM lineitem) n"
)
def q_graph_folder(spark, sf):
    at = files.scratch(spark, "graph")
    table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").write.option("header", True).csv(files.join(at, "frame.csv"))
    files.write_text(spark, files.join(at, "edges.csv"), "source,target\nl_returnflag,l_linestatus\nl_linestatus,ghost\n")
    files.write_text(spark, files.join(at, "metadata.json"), json.dumps({"target_column": "l_linestatus"}))
    d = GraphFolderAdapter(at, "lines").load(spark)
    return spark.createDataFrame(d.truth.edges(), "source string, target string").crossJoin(d.frame.agg(F.count(F.lit(1)).alias("rows"))).withColumns({"target_column": F.lit(d.target), "regime": F.lit(d.regime)})


@query(
    "WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT label, n, CAST(ceil(round(n * 0.2, 6)) AS BIGINT) AS nt FROM c), v AS (SELECT label, n, nt, CAST(ceil(round((n - nt) * 0.2, 6)) AS BIGINT) AS nv FROM t), "
    "s AS (SELECT label, 'test' AS split, nt AS n FROM v UNION ALL SELECT label, 'valid', nv FROM v UNION ALL SELECT label, 'train', n - nt - nv FROM v) SELECT r.id, r.seed, s.* FROM s CROSS JOIN (VALUES ('orders-7', 7), ('orders-8', 8)) r(id, seed)"
)
def q_memory_splits(spark, sf):
    """Repeats of a stratified split of a frame at hand."""
    data = Dataset("orders", table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    out = None
    for s in InMemoryAdapter(data, repeats=2).splits(spark, 7):
        for name, part in (("train", s.train), ("valid", s.valid), ("test", s.test)):
            n = part.groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s.id).alias("id"), F.lit(s.seed).alias("seed"), "label", F.lit(name).alias("split"), "n")
            out = n if out is None else out.unionByName(n)
    return out


@query("SELECT CAST(p_size AS VARCHAR) AS target, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def q_parquet_adapter(spark, sf):
    d = ParquetAdapter(f"{sf}/part.parquet", "p_size", "parts").load(spark)
    return d.frame.groupBy(F.col(d.target).alias("target")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query(given([("rows", True), ("even columns hold 0 and 1", True), ("labels", True), ("graph is acyclic", True), ("parents come first", True), ("equal seeds agree", True), ("other seeds differ", True)], "what, holds"))
def q_synthetic_properties(spark, sf):
    frame, g = mixed_dataset(spark, 500, 6, 7)
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.collect_set("x0").alias("a"), F.collect_set("x2").alias("b"), F.collect_set("label").alias("y")).first()
    total = lambda seed: mixed_dataset(spark, 500, 6, seed)[0].agg(F.sum("x1")).first()[0]
    place = {n: i for i, n in enumerate([*(f"x{i}" for i in range(6)), "label"])}
    load = SyntheticAdapter("s", 500, 6).load(spark, 7)
    facts = [
        ("rows", row["n"] == 500), ("even columns hold 0 and 1", sorted(row["a"]) == sorted(row["b"]) == [0, 1]), ("labels", sorted(row["y"]) == ["no", "yes"]),
        ("graph is acyclic", len(g.order()) == 7), ("parents come first", all(place[a] < place[b] for a, b in g.edges())),
        ("equal seeds agree", total(7) == total(7) and load.truth.edges() == g.edges()), ("other seeds differ", total(7) != total(8)),
    ]
    return spark.createDataFrame(facts, "what string, holds boolean")


@query(given([("a", True), ("b", True), ("c", True)], "node, within_four_deviations"))
def q_forward_sample_frequencies(spark, sf):
    """Sampled shares of a chain against its exact marginals."""
    g = Dag("abc", [("a", "b"), ("b", "c")])
    cards, n = dict.fromkeys("abc", 3), 20_000
    t = random_tables(g, cards, 3)
    pa = t["a"][0]
    exact = {"a": pa, "b": pa @ t["b"], "c": pa @ t["b"] @ t["c"]}
    rows = forward_sample(spark, g, t, cards, n, 5)
    counts = {(r["node"], r["v"]): r["n"] for r in rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("node"), F.col(c).alias("v")) for c in "abc"])).alias("x")).groupBy("x.node", "x.v").agg(F.count(F.lit(1)).alias("n")).collect()}
    fine = lambda c: all(abs(counts.get((c, v), 0) / n - p) <= 4 * (p * (1 - p) / n) ** 0.5 + 1e-9 for v, p in enumerate(exact[c]))
    return spark.createDataFrame([(c, bool(fine(c))) for c in "abc"], "node string, within_four_deviations boolean")


@query(
    given(
        [("alarm", "GraphFolderAdapter", 2), ("child", "GraphFolderAdapter", 2), ("insurance", "GraphFolderAdapter", 2), ("sklearn_breast_cancer", "ParquetAdapter", 2), ("sklearn_iris", "ParquetAdapter", 2), ("sklearn_wine", "ParquetAdapter", 2), ("synthetic_medium", "SyntheticAdapter", 2), ("synthetic_small", "SyntheticAdapter", 2), ("synthetic_tiny", "SyntheticAdapter", 1)],
        "name, kind, repeats",
    )
)
def q_dataset_registry(spark, sf):
    return spark.createDataFrame([(n, type(a).__name__, a.repeats) for n, a in registry().items()], "name string, kind string, repeats int")


def _runs() -> list[experiments.RunRecord]:
    some = lambda k, v: {k: v} if v is not None else {}
    return [experiments.RunRecord(m, d, r, s, 7, a, "x", st, [], some("roc_auc", auc), some("shd", shd) or None, {}, some("total_seconds", sec)) for m, d, r, s, a, st, auc, shd, sec in base._records()]


@query(f"WITH {base._R} SELECT model_name, dataset_name, split_id, ablation_label, status, auc, shd, sec FROM rec")
def q_json_round_trip(spark, sf):
    """Records as dictionaries, written as JSON and read back."""
    at = files.join(files.scratch(spark, "json"), "suite.json")
    experiments.write_json({"records": [r.to_dict() for r in _runs()]}, at)
    rows = experiments.records_frame(spark, experiments.as_records(experiments.read_json(at)))
    return rows.select("model_name", "dataset_name", "split_id", "ablation_label", "status", decisions.metric("roc_auc").alias("auc"), decisions.metric("shd").alias("shd"), F.try_element_at("runtimes", F.lit("total_seconds")).alias("sec"))


@query(
    f"WITH {base._R}, lb AS (SELECT dataset_name AS d, model_name AS m, avg(auc) AS a, avg(shd) AS s, count(*) AS n FROM rec WHERE status = 'ok' AND ablation_label = 'default' GROUP BY 1, 2) "
    "SELECT CAST(1 AS BIGINT) AS line, '| Set | Model | AUC | SHD | Runs |' AS text UNION ALL SELECT 2, '| --- | --- | --- | --- | --- |' UNION ALL "
    "SELECT 2 + row_number() OVER (ORDER BY d, m), '| ' || d || ' | ' || m || ' | ' || CASE WHEN a IS NULL THEN '-' ELSE printf('%.4f', a) END || ' | ' || CASE WHEN s IS NULL THEN '-' ELSE printf('%.4f', s) END || ' | ' || n || ' |' FROM lb"
)
def q_markdown_lines(spark, sf):
    ok = base.records(spark).where("status = 'ok' AND ablation_label = 'default'")
    rows = [r.asDict() for r in decisions.leaderboard(ok, ["roc_auc", "shd"], ["total_seconds"]).orderBy("dataset_name", "model_name").collect()]
    text = report.markdown_table(rows, [("dataset_name", "Set"), ("model_name", "Model"), ("avg_roc_auc", "AUC"), ("avg_shd", "SHD"), ("num_runs", "Runs")])
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(text.split("\n"))], "line long, text string")


_LEADER = f"WITH {base._R}, ok AS (SELECT * FROM rec WHERE status = 'ok' AND ablation_label = 'default')"


@query(f"{_LEADER} SELECT dataset_name, model_name, round(avg(auc), 6) AS avg_roc_auc, count(*) AS num_runs FROM ok GROUP BY 1, 2")
def q_predictive_leaderboard(spark, sf):
    t = decisions.suite_tables(base.records(spark))["predictive_leaderboard"]
    return t.select("dataset_name", "model_name", F.round("avg_roc_auc", 6).alias("avg_roc_auc"), "num_runs")


@query(f"{_LEADER} SELECT dataset_name, model_name, round(avg(shd), 6) AS avg_shd, count(*) AS num_runs FROM ok WHERE shd IS NOT NULL GROUP BY 1, 2")
def q_structural_leaderboard(spark, sf):
    t = decisions.suite_tables(base.records(spark))["structural_leaderboard"]
    return t.select("dataset_name", "model_name", F.round("avg_shd", 6).alias("avg_shd"), "num_runs")


@query(f"{_LEADER} SELECT dataset_name, model_name, round(avg(sec), 6) AS avg_total_seconds, count(*) AS num_runs FROM ok GROUP BY 1, 2")
def q_search_complexity(spark, sf):
    t = decisions.suite_tables(base.records(spark))["search_complexity"]
    return t.select("dataset_name", "model_name", F.round("avg_total_seconds", 6).alias("avg_total_seconds"), "num_runs")


@query(f"WITH {base._R} SELECT dataset_name, model_name, split_id, status FROM rec WHERE status <> 'ok'")
def q_skipped_items(spark, sf):
    return decisions.suite_tables(base.records(spark))["skipped_items"].select("dataset_name", "model_name", "split_id", "status")


# --- encoding --------------------------------------------------------------------------------------------------------------


def bins_sql(x: str, y: str, source: str, bins: int = 5, least: int = 20) -> str:
    """CTEs ``cuts0`` … (t): thresholds of the tree that splits the leaf of the largest gain first, one split a step."""
    h = f"h AS (SELECT CAST({x} AS DOUBLE) AS x, {y} AS y, count(*) AS n FROM {source} GROUP BY 1, 2), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS n, greatest(2, least({least}, greatest(2, sum(n) // {bins}))) AS m FROM h), vals AS (SELECT DISTINCT x FROM h), ys AS (SELECT DISTINCT y FROM h), full_ AS (SELECT v.x, ys.y, coalesce(h.n, 0) AS n FROM vals v CROSS JOIN ys LEFT JOIN h ON h.x = v.x AND h.y = ys.y)"
    parts, cuts = [h, "cuts0 AS (SELECT CAST(NULL AS DOUBLE) AS t WHERE false)"], "cuts0"
    for k in range(bins - 1):
        parts.append(
            f"l{k} AS (SELECT f.x, f.y, f.n, (SELECT count(*) FROM {cuts} c WHERE c.t < f.x) AS leaf FROM full_ f), "
            f"a{k} AS (SELECT x, y, leaf, sum(n) OVER (PARTITION BY leaf, y ORDER BY x) AS ln, sum(n) OVER (PARTITION BY leaf, y) AS wn FROM l{k}), "
            f"e{k} AS (SELECT leaf, x, sum(ln) AS nl, sum(wn) AS nw, sum(CASE WHEN ln > 0 THEN ln * log2(CAST(ln AS DOUBLE)) ELSE 0 END) AS hl, sum(CASE WHEN wn - ln > 0 THEN (wn - ln) * log2(CAST(wn - ln AS DOUBLE)) ELSE 0 END) AS hr, sum(CASE WHEN wn > 0 THEN wn * log2(CAST(wn AS DOUBLE)) ELSE 0 END) AS hw FROM a{k} GROUP BY 1, 2), "
            f"g{k} AS (SELECT leaf, x, lead(x) OVER (PARTITION BY leaf ORDER BY x) AS nx, nl, nw, (nw * log2(CAST(nw AS DOUBLE)) - hw - (nl * log2(CAST(nl AS DOUBLE)) - hl) - CASE WHEN nw > nl THEN (nw - nl) * log2(CAST(nw - nl AS DOUBLE)) - hr ELSE 0 END) / tot.n AS gain FROM e{k} CROSS JOIN tot), "
            f"cuts{k + 1} AS (SELECT t FROM {cuts} UNION ALL SELECT (x + nx) / 2 FROM (SELECT * FROM g{k} CROSS JOIN tot WHERE nx IS NOT NULL AND nl >= tot.m AND nw - nl >= tot.m AND gain > 1e-12 ORDER BY round(gain, 12) DESC, leaf, x LIMIT 1) b)"
        )
        cuts = f"cuts{k + 1}"
    return ", ".join(parts)


def _bins_query(name: str, x: str, y: str, source: str, bins: int = 5):
    _SQL[name] = f"WITH {bins_sql(x, y, source, bins)} SELECT round(t, 6) AS threshold FROM cuts{bins - 1}"

    def run(spark, sf):
        p = TableEncoder(y, bins).fit(table(spark, sf, source).select(y, x)).profile(x)
        return spark.createDataFrame([(float(t),) for t in p.thresholds], "threshold double").select(F.round("threshold", 6).alias("threshold"))

    _Q[name] = run


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, t AS threshold FROM (WITH {bins_sql(c, 'l_returnflag', 'lineitem')} SELECT t FROM cuts4) x{i}" for i, c in enumerate(("l_quantity", "l_extendedprice"))))
def q_entropy_bins_full(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    m = TableEncoder("l_returnflag").fit(df)
    return spark.createDataFrame([(p.name, float(t)) for p in m.profiles for t in p.thresholds], "name string, threshold double")


_bins_query("supervised_bins_price", "o_totalprice", "o_orderstatus", "orders")
_bins_query("supervised_bins_value", "value", "event_type", "events", 4)
_bins_query("supervised_bins_chars", "n_chars", "lang", "documents")


@query("SELECT column_, v, CAST(row_number() OVER (PARTITION BY column_ ORDER BY v) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT 'order' AS column_, CAST(l_orderkey AS VARCHAR) AS v FROM lineitem UNION SELECT 'part', CAST(l_partkey AS VARCHAR) FROM lineitem UNION SELECT 'text', text FROM documents WHERE text IS NOT NULL)")
def q_dictionary_codes(spark, sf):
    """Dense codes of columns of many texts, whole documents among them, by range and without a literal."""
    li = table(spark, sf, "lineitem").select(F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("l_orderkey").cast("string").alias("v")), F.struct(F.lit(1).alias("i"), F.col("l_partkey").cast("string").alias("v")))).alias("x")).select("x.*")
    found = dictionaries(li.unionByName(table(spark, sf, "documents").select(F.lit(2).alias("i"), F.col("text").alias("v"))))
    parts = [found[i].frame(spark).select(F.lit(name).alias("column_"), "v", "code") for i, name in enumerate(("order", "part", "text")) if i in found]
    return reduce(DataFrame.union, parts)


@query(
    "WITH both_ AS (SELECT *, o_orderstatus <> 'P' AS train FROM orders), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders)), "
    "p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)), size_ AS (SELECT count(*) AS n FROM c), "
    "f AS (SELECT train, k AS place, 1.0 AS x FROM both_ JOIN c ON v = CAST(o_custkey AS VARCHAR) UNION ALL SELECT train, n + 1, CAST(o_totalprice AS DOUBLE) FROM both_ CROSS JOIN size_ UNION ALL SELECT train, n + 2 + k, 1.0 FROM both_ JOIN p ON v = o_orderpriority CROSS JOIN size_), "
    "names AS (SELECT k AS place, 'customer_' || v AS name FROM c UNION ALL SELECT n + 1, 'price' FROM size_ UNION ALL SELECT n + 2 + k, 'priority_' || v FROM p CROSS JOIN size_) "
    "SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part, CAST(place AS BIGINT) AS place, name, round(sum(x), 2) AS total FROM f JOIN names USING (place) GROUP BY 1, 2, 3"
)
def q_sparse_dummy_totals(spark, sf):
    """One feature a customer and priority beside a number, over two tables whose texts differ; sums of every feature."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("customer"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    train, test, names = sparse_dummies(o.where("status <> 'P'"), o.where("status = 'P'"), "status")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    entry = both.select("part", F.explode(F.arrays_zip("places", "numbers")).alias("e")).groupBy("part", F.col("e.places").alias("place")).agg(F.round(F.sum("e.numbers"), 2).alias("total"))
    return entry.join(names, "place").select("part", "place", "name", "total")


@query(" UNION ALL ".join(f"SELECT '{x}' AS name, round(t, 6) AS threshold FROM (WITH {bins_sql(x, 'l_returnflag', 'lineitem')} SELECT t FROM cuts4)" for x in ("l_extendedprice", "l_partkey", "l_orderkey")))
def q_bins_in_cells(spark, sf):
    """Supervised bins of three columns at once, on histograms that stay in Spark whatever their size."""
    names = ("l_extendedprice", "l_partkey", "l_orderkey")
    item = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(names)]))
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"), item.alias("v")).select("v.i", "v.x", "y", F.lit(1).cast("long").alias("n"))
    cuts = entropy_bins_in_cells(rows, 5, 20, sum(table(spark, sf, "lineitem").agg(*[F.approx_count_distinct(c) for c in names]).first()))
    return spark.createDataFrame([(names[i], float(t)) for i, own in cuts.items() for t in own], "name string, threshold double").select("name", F.round("threshold", 6).alias("threshold"))


@query(f"WITH {bins_sql('o_totalprice', 'o_orderpriority', 'orders')} SELECT o_orderpriority AS priority, CAST((SELECT count(*) FROM cuts4 WHERE t <= o.o_totalprice) AS INT) AS code, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS target, count(*) AS n FROM orders o GROUP BY 1, 2")
def q_fit_transform(spark, sf):
    """Fit on a table, freeze, transform it."""
    df = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    m = TableEncoder("o_orderpriority").fit(df)
    out = m.with_codes(df, "c_")
    return out.groupBy(F.col("o_orderpriority").alias("priority"), F.col("c_o_totalprice").alias("code"), F.col("c_o_orderpriority").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query(given([("all", -3.0), ("all", 1.0), ("compat", 1.0)], "kind, threshold"))
def q_low_thresholds(spark, sf):
    """Thresholds at or below -2 are kept, unless compatibility is asked for."""
    import numpy as np

    x = np.array([-4.0, -2.0, 0.0, 2.0])
    counts = np.array([[30.0, 0], [0, 30], [0, 30], [30, 0]])
    rows = [(kind, t) for kind, drop in (("all", False), ("compat", True)) for t in entropy_bins(x, counts, 3, 5, drop)]
    return spark.createDataFrame(rows, "kind string, threshold double")


_ODD = ["a", "b[1]", "<c", "", "a", "b_1_", "a", ""]


@query(
    f"WITH n AS (SELECT i, CASE WHEN s = '' THEN 'feature_' || i ELSE s END AS s FROM (SELECT i, regexp_replace(x, '[\\[\\]<]', '_', 'g') AS s FROM {_values([(i, x) for i, x in enumerate(_ODD)], 'i, x')}) y), r AS (SELECT i, s, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS k FROM n) SELECT CAST(i AS INT) AS place, CASE WHEN k = 0 THEN s ELSE s || '__' || k END AS name FROM r"
)
def q_sanitized_names(spark, sf):
    return spark.createDataFrame(list(enumerate(sanitize_names(_ODD))), "place int, name string")


# --- screening ---------------------------------------------------------------------------------------------------------------


_EACH = f"(SELECT c FROM {_values([(c,) for c in COLUMNS], 'c')})"


@query(f"SELECT a.c AS target, b.c AS source, CAST(0 AS DOUBLE) AS score FROM {_EACH} a CROSS JOIN {_EACH} b WHERE a.c <> b.c")
def q_full_pools(spark, sf):
    rows = [(t, s, 0.0) for t, pool in screening.full_pools(COLUMNS).items() for s in pool]
    return spark.createDataFrame(rows, "target string, source string, score double")


def _copies(spark, sf) -> DataFrame:
    """Columns with a known structure: ``copy`` equals the target, ``noise`` has nothing to do with it."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderstatus").alias("y"), F.concat(F.lit("s"), F.col("o_orderstatus")).alias("copy"), (F.pmod(F.xxhash64("o_orderkey"), F.lit(3))).cast("string").alias("noise"))


@query(given([("neural", "copy", "y"), ("neural", "y", "copy"), ("hybrid_mi_neural", "copy", "y"), ("hybrid_mi_neural", "y", "copy"), ("mi_filter", "copy", "y"), ("mi_filter", "y", "copy")], "strategy, target, best_source"))
def q_screener_strategies(spark, sf):
    """The best source that each strategy finds for a column and its copy."""
    df = _copies(spark, sf).limit(3000)
    encoder = TableEncoder("y").fit(df)
    store = CountStore(encoder.transform(df))
    out = []
    for strategy in ("neural", "hybrid_mi_neural", "mi_filter"):
        s = screening.screen(encoder, df, store, ScreenerConfig(strategy=strategy, epochs=12, learning_rate=0.01, bootstraps=2, use_bundles=False))
        out += [(strategy, t, max(s.pools[t], key=lambda p, t=t: s.candidates.get((t, p), 0.0))) for t in ("copy", "y")]
    return spark.createDataFrame(out, "strategy string, target string, best_source string")


@query(given([("its own block does not move the loss of a column", True), ("masking a copy raises the loss", True), ("masking noise hardly does", True), ("gradients agree with differences", True), ("scores are never negative", True)], "what, holds"))
def q_neural_properties(spark, sf):
    import numpy as np

    from .operators.neural import MultiHead, influence

    rng = np.random.default_rng(3)
    a, noise = rng.integers(0, 2, 600), rng.integers(0, 2, 600)
    x = np.concatenate([np.eye(2)[a], np.eye(2)[a], np.eye(2)[noise]], 1)
    ys, blocks = [a, a, noise], [slice(0, 2), slice(2, 4), slice(4, 6)]
    net = MultiHead(blocks, [2, 2, 2], 16, 2, 0.0, 1)
    _, g = net.gradients(x[:50], [y[:50] for y in ys], False)
    step, key, old = 1e-5, "w0", net.p["w0"][3, 5]
    values = []
    for d in (step, -step):
        net.p[key][3, 5] = old + d
        values.append(net.gradients(x[:50], [y[:50] for y in ys], False)[0])
    net.p[key][3, 5] = old
    net.fit(x, ys, 30, 64, 0.01)
    base_, own, copy, other = net.masked_losses(x, a, 0, [(), (0,), (1,), (2,)], 16)
    facts = [
        ("its own block does not move the loss of a column", base_ == own), ("masking a copy raises the loss", copy > 3 * base_), ("masking noise hardly does", other < 2 * base_ + 0.05),
        ("gradients agree with differences", abs((values[0] - values[1]) / (2 * step) - g[key][3, 5]) < 1e-6), ("scores are never negative", influence(1.0, 2.0) == 0.0 and influence(3.0, 2.0) == 0.5),
    ]
    return spark.createDataFrame([(w, bool(h)) for w, h in facts], "what string, holds boolean")


# --- search ------------------------------------------------------------------------------------------------------------------

#: Columns of lineitem with dependences between them, for searches that take several steps.
WIDE = ["band", "half", "tail", "line", "odd", "early"]
WIDE_CARDS = {"band": 5, "half": 2, "tail": 2, "line": 7, "odd": 2, "early": 2}
_WIDE_SQL = (
    f"w AS (SELECT {base._case('l_quantity', base.QTY)} AS band, CASE WHEN l_quantity < 25.5 THEN 0 ELSE 1 END AS half, CASE WHEN l_quantity < 40.5 THEN 0 ELSE 1 END AS tail, "
    "CAST(l_linenumber - 1 AS INT) AS line, CAST(l_linenumber % 2 AS INT) AS odd, CASE WHEN l_linenumber < 4 THEN 0 ELSE 1 END AS early FROM lineitem)"
)
#: Support of an edge, by place: different for the two directions, so that equal scores do not tie.
_WIDE_SUPPORT = {(c, p): round(0.50 + 0.01 * (6 * i + j), 2) for i, c in enumerate(WIDE) for j, p in enumerate(WIDE) if c != p}  # (child, parent)
_PRIOR = 1e-4


def wide(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    band = base.digitize(F.col("l_quantity"), base.QTY).cast("int")
    over = lambda c, limit: F.when(F.col(c) < limit, 0).otherwise(1)
    line = F.col("l_linenumber").cast("int")
    return x.select(band.alias("band"), over("l_quantity", 25.5).alias("half"), over("l_quantity", 40.5).alias("tail"), (line - 1).alias("line"), (line % 2).alias("odd"), over("l_linenumber", 4).alias("early"))


def _wide_bic() -> str:
    """CTE ``bic`` (c, p, v): score per row of each column alone (p null) and given each other one."""
    one = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST(NULL AS VARCHAR) AS p, 0 AS q, {c} AS v, count(*) AS n, {WIDE_CARDS[c]} AS k, 1 AS r FROM w GROUP BY 4" for c in WIDE)
    two = " UNION ALL ".join(f"SELECT '{c}', '{p}', {p}, {c}, count(*), {WIDE_CARDS[c]}, {WIDE_CARDS[p]} FROM w GROUP BY {p}, {c}" for c in WIDE for p in WIDE if c != p)
    return (
        f"f AS ({one} UNION ALL {two}), s AS (SELECT c, p, k, r, n, sum(n) OVER (PARTITION BY c, p, q) AS row_ FROM f), tot AS (SELECT CAST(count(*) AS DOUBLE) AS rows_ FROM w), "
        "bic AS (SELECT c, p, (sum(n * ln(CAST(n AS DOUBLE) / row_)) - 0.5 * max(r) * (max(k) - 1) * ln(max(rows_))) / max(rows_) AS v FROM s CROSS JOIN tot GROUP BY 1, 2)"
    )


def climb_sql(most: int = 6) -> str:
    """The moves of a search for forests, step by step: of the additions that close no circle and give no child a second
    parent, that which raises the mean score most."""
    support = _values([(p, c, s) for (c, p), s in _WIDE_SUPPORT.items()], "p, c, s")
    parts = [_WIDE_SQL, _wide_bic(), f"gain AS (SELECT v.p, v.c, CAST(v.s AS DOUBLE) AS s, b.v - a.v AS g FROM {support} JOIN bic a ON a.c = v.c AND a.p IS NULL JOIN bic b ON b.c = v.c AND b.p = v.p)"]
    parts.append(f"root0 AS (SELECT x AS x, x AS root FROM {_values([(c,) for c in WIDE], 'x')}), e0 AS (SELECT CAST(NULL AS VARCHAR) AS p, CAST(NULL AS VARCHAR) AS c, CAST(NULL AS DOUBLE) AS s, 0 AS step WHERE false)")
    for k in range(most):
        parts.append(
            f"m{k} AS (SELECT count(*) AS n, coalesce(sum(2 * s - 1), 0) AS t FROM e{k}), "
            f"best{k} AS (SELECT g.p, g.c, g.s, {k + 1} AS step FROM gain g JOIN root{k} rc ON rc.x = g.c AND rc.root = g.c JOIN root{k} rp ON rp.x = g.p AND rp.root <> g.c CROSS JOIN m{k} m "
            f"WHERE g.g + {_PRIOR} * ((m.t + 2 * g.s - 1) / (m.n + 1) - CASE WHEN m.n > 0 THEN m.t / m.n ELSE 0 END) > 1e-6 "
            f"ORDER BY round(g.g + {_PRIOR} * ((m.t + 2 * g.s - 1) / (m.n + 1)), 10) DESC LIMIT 1), "
            f"e{k + 1} AS (SELECT * FROM e{k} UNION ALL SELECT p, c, s, step FROM best{k}), "
            f"root{k + 1} AS (SELECT r.x, CASE WHEN b.c IS NOT NULL THEN rp.root ELSE r.root END AS root FROM root{k} r LEFT JOIN best{k} b ON b.c = r.root LEFT JOIN root{k} rp ON rp.x = b.p)"
        )
    return "WITH " + ", ".join(parts) + f" SELECT p AS source, c AS target, CAST(step AS INT) AS step FROM e{most}"


@query(climb_sql())
def q_climb_steps(spark, sf):
    """All moves of a greedy search, in order."""
    store = CountStore(wide(spark, sf), cards=WIDE_CARDS)
    config = SearchConfig(max_parents=1, max_additions_per_child=9, discriminative_weight=0.0, edge_prior_weight=_PRIOR, hub_penalty_weight=0.0, warm_start="empty", max_iters=6)
    r = HillClimb(store, "line", config, screening.full_pools(WIDE), _WIDE_SUPPORT).fit()
    return spark.createDataFrame([(*op.split()[1].split("->"), i + 1) for i, op in enumerate(r.operations)], "source string, target string, step int")


@query(climb_sql())
def q_climb_steps_in_spark(spark, sf):
    """The same, with all counts left in Spark."""
    store = CountStore(wide(spark, sf), 0, cards=WIDE_CARDS)
    config = SearchConfig(max_parents=1, max_additions_per_child=9, discriminative_weight=0.0, edge_prior_weight=_PRIOR, hub_penalty_weight=0.0, warm_start="empty", max_iters=6)
    r = HillClimb(store, "line", config, screening.full_pools(WIDE), _WIDE_SUPPORT).fit()
    return spark.createDataFrame([(*op.split()[1].split("->"), i + 1) for i, op in enumerate(r.operations)], "source string, target string, step int")


@query()
def q_greedy_edges(spark, sf):
    """The greedy baseline's graph: full pools, from the empty graph, no validation."""
    store = CountStore(wide(spark, sf), cards=WIDE_CARDS)
    r = HillClimb(store, "line", SearchConfig(warm_start="empty"), screening.full_pools(WIDE)).fit()
    return spark.createDataFrame(r.graph.edges(), "source string, target string")


@query()
def q_pruned_edges(spark, sf):
    """A start with needless edges, pruned on held-out rows."""
    parts = holdout(wide(spark, sf), 7, 0.0, 0.2)
    store = CountStore(parts.where("split = 'train'").drop("split"), cards=WIDE_CARDS)
    config = SearchConfig(max_iters=0, warm_start="naive_bayes", prune_min_edges_real=1, prune_max_fraction_real=0.9, prune_log_loss_tol_real=0.01, prune_auc_tol_real=0.01, hub_penalty_weight=1.0)
    r = HillClimb(store, "line", config, screening.full_pools(WIDE), {}, "real").fit(parts.where("split = 'valid'").drop("split"))
    return spark.createDataFrame([(p, c, "kept") for p, c in r.graph.edges()] + [(*x.split()[1].split("->"), "pruned") for x in r.pruned], "source string, target string, status string")


_SPARSE = {("a", "b"): 0.9, ("b", "a"): 0.8, ("c", "a"): 0.7, ("d", "c"): 0.95, ("e", "d"): 0.0, ("c", "b"): 0.6}  # (child, parent)
_SPARSE_POOLS = {"a": ["b"], "b": ["a"], "c": ["a", "b"], "d": ["c"], "e": ["d"]}


@query(given([("empty", None, None), ("naive_bayes", "a", "b"), ("naive_bayes", "a", "c"), ("screener_sparse", "b", "a"), ("screener_sparse", "a", "c"), ("screener_sparse", "c", "d")], "start, source, target"))
def q_start_graphs(spark, sf):
    """Warm starts: target to each child that lists it; best positive parents by support, without circles."""

    class Fixed:
        columns, cards, rows = list("abcde"), dict.fromkeys("abcde", 2), 1.0

    h = HillClimb(Fixed(), "a", SearchConfig(), _SPARSE_POOLS, _SPARSE)
    rows = [("empty", None, None)] if not h.initial("empty").edges() else []
    rows += [(s, p, c) for s in ("naive_bayes", "screener_sparse") for p, c in h.initial(s).edges()]
    return spark.createDataFrame(rows, "start string, source string, target string")


_CHECKS = [(0, 0.70, 0.80, -5.0, 4), (5, 0.65, 0.81, -4.9, 5), (10, 0.65, 0.83, -4.8, 6), (15, 0.66, 0.90, -4.0, 7), (20, 0.65, 0.83, -4.8, 5), (25, 0.65, 0.83, -4.9, 2), (30, 0.65, 0.83, -4.8, 5)]


@query(f"SELECT CAST(i AS INT) AS iteration FROM {_values(_CHECKS, 'i, ll, auc, obj, edges')} ORDER BY ll, auc DESC, obj DESC, edges, i LIMIT 1")
def q_checkpoint_choice(spark, sf):
    """Lower log loss, then higher AUC, then higher objective, then fewer edges; the first of equal ones."""
    best = None
    for i, ll, auc, obj, edges in _CHECKS:
        new = {"iteration": i, "log_loss": ll, "roc_auc": auc, "objective": obj, "edges": edges}
        best = new if better(new, best) else best
    return spark.createDataFrame([(best["iteration"],)], "iteration int")


@query(f"SELECT start FROM {_values([('naive_bayes', -4.0, 3), ('screener_sparse', -3.5, 5), ('empty', -3.5, 4)], 'start, obj, edges')} ORDER BY obj DESC, edges LIMIT 1")
def q_start_choice(spark, sf):
    """Without validation: higher objective, then fewer edges."""
    best = None
    for start, obj, edges in (("naive_bayes", -4.0, 3), ("screener_sparse", -3.5, 5), ("empty", -3.5, 4)):
        new = {"start": start, "log_loss": None, "roc_auc": None, "objective": obj, "edges": edges}
        best = new if better(new, best) else best
    return spark.createDataFrame([(best["start"],)], "start string")


_CASES = [(i, ll, auc, obj, strict) for i, (ll, auc, obj, strict) in enumerate((ll, auc, obj, strict) for ll in (0.599, 0.6, 0.601, 0.603) for auc in (0.8, 0.7985, 0.7996) for obj in (-3.0, -2.99995, -2.9) for strict in (False, True))]


def _accept_sql(kind: str, ll: float, auc: float) -> str:
    return f"SELECT '{kind}' AS profile, CAST(i AS INT) AS i, ll < 0.6 - 1e-12 OR (NOT strict AND ll <= 0.6 + {ll} AND auc >= 0.8 - {auc} AND obj > -3.0 + 1e-4) AS accepted FROM {_values(_CASES, 'i, ll, auc, obj, strict')}"


@query(f"{_accept_sql('known_graph', 0.002, 0.001)} UNION ALL {_accept_sql('real', 0.001, 0.0005)}")
def q_prune_acceptance(spark, sf):
    out = []
    for regime in ("known_graph", "real"):
        h = HillClimb(_fixed(), "a", SearchConfig(), {}, regime=regime)
        limits = h.prune_limits(10)
        old = {"log_loss": 0.6, "roc_auc": 0.8, "objective": -3.0}
        out += [(limits["profile"], i, bool(h.accepts({"log_loss": ll, "roc_auc": auc, "objective": obj}, old, limits, strict))) for i, ll, auc, obj, strict in _CASES]
    return spark.createDataFrame(out, "profile string, i int, accepted boolean")


def _fixed():
    class Fixed:
        columns, cards, rows = list("abcde"), dict.fromkeys("abcde", 2), 1.0

    return Fixed()


@query(
    "SELECT r.profile, CAST(e.n AS INT) AS edges, CAST(greatest(r.floor_, ceil(round((1 - r.f) * e.n, 9))) AS INT) AS min_edges, CAST(ceil(round(r.f * e.n, 9)) AS INT) AS most, r.passes FROM (VALUES ('known_graph', 20, 0.30, 2), ('real', 8, 0.35, 1)) r(profile, floor_, f, passes) CROSS JOIN generate_series(0, 60) e(n)"
)
def q_prune_budget(spark, sf):
    out = []
    for regime in ("known_graph", "real"):
        h = HillClimb(_fixed(), "a", SearchConfig(), {}, regime=regime)
        for n in range(61):
            x = h.prune_limits(n)
            out.append((x["profile"], n, x["min_edges"], x["most"], x["passes"]))
    return spark.createDataFrame(out, "profile string, edges int, min_edges int, most int, passes int")


@query(given([("a", "b", True), ("b", "a", True), ("c", "a", True), ("b", "c", False), ("d", "a", False)], "parent, child, strict"))
def q_strict_edges(spark, sf):
    """Edges at the target with support of 0.6 or more go only if the log loss falls."""
    support = {("b", "a"): 0.6, ("a", "b"): 0.7, ("a", "c"): 0.9, ("c", "b"): 0.9, ("a", "d"): 0.5}  # (child, parent)
    h = HillClimb(_fixed(), "a", SearchConfig(), {}, support)
    return spark.createDataFrame([(p, c, bool(h.strict_edge(p, c))) for p, c in (("a", "b"), ("b", "a"), ("c", "a"), ("b", "c"), ("d", "a"))], "parent string, child string, strict boolean")


@query(f"SELECT a.c AS child, b.c AS parent FROM (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(COLUMNS))}) a(i, c) JOIN (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(COLUMNS))}) b(i, c) ON a.i <> b.i WHERE b.i - CASE WHEN b.i > a.i THEN 1 ELSE 0 END < 3")
def q_greedy_first_moves(spark, sf):
    """Full pools without scores: the cut to three leaves each child the first three other columns."""

    class Fixed:
        columns, cards, rows = COLUMNS, CARDS, 1.0

    h = HillClimb(Fixed(), TARGET, SearchConfig(warm_start="empty"), screening.full_pools(COLUMNS))
    ops = [op.split()[1].split("->") for op, _ in h.proposals(Dag(COLUMNS))]
    return spark.createDataFrame([(c, p) for p, c in ops], "child string, parent string")


@query(given([("families scored", 8), ("families counted", 8), ("counted again", 0)], "what, n"))
def q_score_memo(spark, sf):
    """Two graphs that share families: each family is counted and scored once."""
    store = base.li_store(spark, sf)
    s = GraphScorer(store, TARGET, SearchConfig(discriminative_weight=0.0))
    a, b = Dag(COLUMNS, [("flag", "status"), ("flag", "qty")]), Dag(COLUMNS, [("flag", "status"), ("status", "qty"), ("flag", "tax")])
    s.prepare([a, b])
    s.score(a), s.score(b)
    counted = len(store.counts)
    s.prepare([a, b])
    return spark.createDataFrame([("families scored", len(s.local)), ("families counted", counted), ("counted again", len(store.counts) - counted)], "what string, n int")


# --- networks, estimators and runners ------------------------------------------------------------------------------------------

_REFIT = [("qty", ("status",)), ("flag", ("disc",)), ("status", ("flag",))]


@query(f"WITH {LI}, {base._grid(_REFIT)} SELECT CASE f WHEN 0 THEN 'qty' WHEN 1 THEN 'flag' ELSE 'status' END AS node, CAST(q AS BIGINT) AS q, CAST(v AS BIGINT) AS v, round((n + 1.0) / (sum(n) OVER (PARTITION BY f, q) + count(*) OVER (PARTITION BY f, q)), 9) AS p FROM cells")
def q_refit_tables(spark, sf):
    """A network whose graph loses an edge: the child's table is counted anew, the others are kept."""
    store = base.li_store(spark, sf)
    g = Dag(COLUMNS, base.GRAPH)
    net = BayesNet.fit(store, g, TARGET)
    new = net.with_graph(store, g.minus("flag", "qty"))
    kept = new.tables["flag", ("disc",)] is net.tables["flag", ("disc",)]
    rows = [(node, q, v, float(new.tables[node, parents][q, v])) for node, parents in _REFIT for q in range(new.tables[node, parents].shape[0]) for v in range(new.tables[node, parents].shape[1])]
    out = spark.createDataFrame(rows, "node string, q long, v long, p double").select("node", "q", "v", F.round("p", 9).alias("p"))
    return out if kept else out.limit(0)


@query(f"WITH {LI}, {base._grid([('qty', ('flag', 'status'))])} SELECT CAST(q // 2 AS INT) AS flag, CAST(q % 2 AS INT) AS status, CAST(v AS INT) AS qty, round((n + 1.0) / (sum(n) OVER (PARTITION BY q) + 5), 9) AS p FROM cells")
def q_node_probability(spark, sf):
    net = BayesNet.fit(base.li_store(spark, sf), Dag(COLUMNS, base.GRAPH), TARGET)
    rows = [(f, s, v, net.node_probability({"flag": f, "status": s, "qty": v}, "qty")) for f in range(3) for s in range(2) for v in range(5)]
    return spark.createDataFrame(rows, "flag int, status int, qty int, p double").select("flag", "status", "qty", F.round("p", 9).alias("p"))


def _nb_sql(train: str, test: str, features: list[str], y: str) -> str:
    """CTE ``post`` (y of the row, k, p, w): naive Bayes with add-one smoothing, fitted on one view and applied to another."""
    parts = [f"cls AS (SELECT DISTINCT {y} AS k FROM {train}), tot AS (SELECT count(*) AS n FROM {train}), pri AS (SELECT cls.k, ln((count(t.{y}) + 1.0) / (max(tot.n) + (SELECT count(*) FROM cls)) + 1e-12) AS l, count(t.{y}) AS n FROM cls CROSS JOIN tot LEFT JOIN {train} t ON t.{y} = cls.k GROUP BY 1)"]
    joins, terms = "", ["pri.l"]
    for f in features:
        parts.append(f"v_{f} AS (SELECT DISTINCT {f} AS v FROM {train}), c_{f} AS (SELECT cls.k, v.v, ln((count(t.{f}) + 1.0) / (max(pri.n) + (SELECT count(*) FROM v_{f})) + 1e-12) AS l FROM cls CROSS JOIN v_{f} v JOIN pri ON pri.k = cls.k LEFT JOIN {train} t ON t.{y} = cls.k AND t.{f} = v.v GROUP BY 1, 2)")
        joins += f" JOIN c_{f} ON c_{f}.k = pri.k AND c_{f}.v = d.{f}"
        terms.append(f"c_{f}.l")
    row = ", ".join([y, *features])
    parts.append(f"d AS (SELECT {row}, count(*) AS w FROM {test} GROUP BY {row}), s AS (SELECT d.*, pri.k, {' + '.join(terms)} AS s FROM d CROSS JOIN pri{joins}), m AS (SELECT *, max(s) OVER (PARTITION BY {row}) AS top FROM s), post AS (SELECT {y} AS y, k, w, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY {row}) AS p, row_number() OVER (PARTITION BY {row} ORDER BY round(s - top, 9) DESC, k) AS place FROM m)")
    return ", ".join(parts)


_NB_VIEW = "li2 AS (SELECT l_returnflag AS y, l_linestatus AS x1, l_linenumber AS x2, l_discount AS x3, l_tax AS x4, l_orderkey AS id FROM lineitem), tr AS (SELECT * FROM li2 WHERE id % 5 <> 0), te AS (SELECT * FROM li2 WHERE id % 5 = 0)"
_NB_COLUMNS = ["x1", "x2", "x3", "x4"]


def _nb_frame(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"), F.col("l_linestatus").alias("x1"), F.col("l_linenumber").alias("x2"), F.col("l_discount").alias("x3"), F.col("l_tax").alias("x4"), F.col("l_orderkey").alias("id"))


@query(f"WITH {_NB_VIEW}, {_nb_sql('li2', 'li2', _NB_COLUMNS, 'y')} SELECT k AS predicted, CAST(sum(w) AS BIGINT) AS n, round(sum(w * p), 3) AS total FROM post WHERE place = 1 GROUP BY 1")
def q_estimator_predictions(spark, sf):
    """The whole estimator without search steps: typing, bins of few values, naive start, tables, scoring."""
    df = _nb_frame(spark, sf).drop("id")
    config = PipelineConfig("y", n_bins=12, use_screener=False, search=SearchConfig(max_iters=0, warm_start="naive_bayes", max_parents=1))
    out = BayesNetClassifier(config).fit(df).transform(df)
    return out.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.array_max("probabilities")), 3).alias("total"))


_NB_AUC = "ga AS (SELECT k, round(p, 12) AS s, sum(w) AS n, sum(CASE WHEN y = k THEN w ELSE 0 END) AS pos FROM post GROUP BY 1, 2), ra AS (SELECT k, n, pos, coalesce(sum(n) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM ga), aa AS (SELECT k, (sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(n - pos)) AS auc FROM ra GROUP BY k)"


@query(
    f"WITH {_NB_VIEW}, {_nb_sql('tr', 'te', _NB_COLUMNS, 'y')}, {_NB_AUC} SELECT 'naive_bayes' AS model_name, 'ok' AS status, (SELECT round(-sum(w * ln(p)) / sum(w), 6) FROM post WHERE y = k) AS log_loss, "
    "(SELECT round(sum(w * (p - CASE WHEN y = k THEN 1 ELSE 0 END) * (p - CASE WHEN y = k THEN 1 ELSE 0 END)) / (SELECT count(*) FROM te), 6) FROM post) AS brier, (SELECT round(avg(auc), 4) FROM aa) AS roc_auc, CAST(4 AS INT) AS edges"
)
def q_fixed_shape_runner(spark, sf):
    """A baseline's run on one split, as a record."""
    x = _nb_frame(spark, sf)
    train, test = x.where("id % 5 <> 0").drop("id"), x.where("id % 5 = 0").drop("id")
    split = Split("s", 7, train, test, test, Dataset("lines", x, "y"))
    r = experiments.runners()["naive_bayes"].run(split, PipelineConfig("y", n_bins=12), ablations()["default"])
    return spark.createDataFrame([(r.model_name, r.status, round(r.predictive["log_loss"], 6), round(r.predictive["brier"], 6), round(r.predictive["roc_auc"], 4), len(r.edges))], "model_name string, status string, log_loss double, brier double, roc_auc double, edges int")


@query(
    f"{base._SCORED}, {base._AUC}, {base._CONF}, b AS (SELECT {base._case('p', metrics.ece_edges()[1:-1])} AS b, sum(w) AS n, sum(w * p) / sum(w) AS conf, sum(CASE WHEN y = flag THEN w ELSE 0 END) * 1.0 / sum(w) AS acc FROM c WHERE k = 1 GROUP BY 1) "
    "SELECT (SELECT round(sum(-w * ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16))) / sum(w), 5) FROM post WHERE y = flag) AS log_loss, (SELECT round(avg(auc), 4) FROM a) AS roc_auc, "
    "(SELECT round(sum(w * (p - CASE WHEN y = flag THEN 1 ELSE 0 END) * (p - CASE WHEN y = flag THEN 1 ELSE 0 END)) / (SELECT count(*) FROM li), 5) FROM post) AS brier, (SELECT round(sum(n * abs(conf - acc)) / sum(n), 4) FROM b) AS ece"
)
def q_metric_bundle(spark, sf):
    m = metrics.predictive(base._rounded(base._scored(spark, sf)), 3)
    return spark.createDataFrame([(round(m["log_loss"], 5), round(m["roc_auc"], 4), round(m["brier"], 5), round(m["ece"], 4))], "log_loss double, roc_auc double, brier double, ece double")


class _Stub(experiments.Runner):
    """Says what it was asked to run."""

    def run(self, split, config, ablation):
        if self.name == "kdb":
            raise ValueError("fails on purpose")
        return self.record(split, ablation.label, predictive={"roc_auc": 0.5}, runtimes={"total_seconds": 1.0})


def _suite(spark, sf) -> dict:
    adapters = {"a": InMemoryAdapter(Dataset("a", table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("r")), "r", "known_graph"), repeats=2), "alarm": GraphFolderAdapter("no/such/folder", "alarm")}
    models = {m: _Stub(m, "f") for m in suites()["smoke"].baselines} | {"kdb": _Stub("kdb", "f")}
    seen: list[str] = []
    out = experiments.run_suite(spark, "smoke", PipelineConfig("r"), datasets=["a", "alarm"], baselines=[*suites()["smoke"].baselines, "kdb"], seeds=[7, 9], adapters=adapters, models=models, log=seen.append)
    return out | {"seen": seen}


_PLAN = (
    f"m AS (SELECT * FROM (VALUES ('{decisions.METHOD}', 'default'), ('{decisions.METHOD}', 'no_screener'), ('greedy_hc_bn', 'default'), ('naive_bayes', 'default'), ('tan', 'default'), ('kdb', 'default')) v(model_name, ablation_label)), "
    "s AS (SELECT 'a' AS dataset_name, 'a-' || CAST(x AS VARCHAR) AS split_id, x AS seed FROM (VALUES (7), (8), (9), (10)) v(x)), "
    "r AS (SELECT m.*, s.*, CASE WHEN model_name = 'kdb' THEN 'failed' ELSE 'ok' END AS status FROM m CROSS JOIN s UNION ALL SELECT model_name, 'default', 'alarm', 'alarm-' || CAST(x AS VARCHAR), x, 'skipped' FROM (SELECT DISTINCT model_name FROM m) d CROSS JOIN (VALUES (7), (9)) v(x))"
)


@query(f"WITH {_PLAN} SELECT model_name, dataset_name, split_id, CAST(seed AS INT) AS seed, ablation_label, status FROM r")
def q_suite_records(spark, sf):
    """The plan of a suite: datasets, seeds, splits, models, ablations of the method only; missing sets and failures."""
    return spark.createDataFrame([(r["model_name"], r["dataset_name"], r["split_id"], r["seed"], r["ablation_label"], r["status"]) for r in _suite(spark, sf)["records"]], "model_name string, dataset_name string, split_id string, seed int, ablation_label string, status string")


@query(f"WITH {_PLAN} SELECT status, count(*) AS messages FROM (SELECT 'started' AS status FROM r WHERE dataset_name = 'a' UNION ALL SELECT 'failed' FROM r WHERE status = 'failed') x GROUP BY 1")
def q_progress_messages(spark, sf):
    rows = [("failed" if " failed: " in m else "started",) for m in _suite(spark, sf)["seen"]]
    return spark.createDataFrame(rows, "status string").groupBy("status").agg(F.count(F.lit(1)).alias("messages"))


_CHANGED = [
    ("discriminative_only", "search.discriminative_weight", "1.0"), ("discriminative_only", "search.generative_weight", "0.0"), ("generative_only", "search.discriminative_weight", "0.0"), ("generative_only", "search.generative_weight", "1.0"),
    ("no_bundles", "screener.interaction_top_pairs", "0"), ("no_bundles", "screener.use_bundles", "False"), ("no_edge_prior", "search.edge_prior_weight", "0.0"), ("no_screener", "use_screener", "False"),
    ("small_pool", "screener.pool_size", "3"), ("warm_start_nb", "search.warm_start", "naive_bayes"), ("warm_start_sparse", "search.warm_start", "screener_sparse"), ("wide_parents", "search.max_parents", "5"),
]


@query(given([x for x in _CHANGED if x not in (("discriminative_only", "search.discriminative_weight", "1.0"), ("generative_only", "search.generative_weight", "1.0"))], "label, field, value"))
def q_ablation_settings(spark, sf):
    """What the plain ablations change in the default settings."""
    start = PipelineConfig("y")
    flat = lambda c: {f"{g}.{k}" if g else k: str(v) for g, part in (("", {"use_screener": c.use_screener}), ("screener", asdict(c.screener)), ("search", asdict(c.search))) for k, v in part.items()}
    before = flat(start)
    labels = sorted({x[0] for x in _CHANGED})
    rows = [(label, k, v) for label in labels for k, v in flat(ablations()[label].apply(start)).items() if v != before[k]]
    return spark.createDataFrame(rows, "label string, field string, value string")


@query(given([("unknown", 50, 3), ("known_graph", 12, 1), ("real", 50, 3)], "regime, max_iters, bootstraps"))
def q_fast_ablation(spark, sf):
    """Fast variants act on known graphs only, with a search limited by the number of columns."""
    rows = []
    for regime in ("unknown", "known_graph", "real"):
        c = ablations()["known_graph_fast"].apply(PipelineConfig("y"), regime, 10)
        rows.append((regime, c.search.max_iters, c.screener.bootstraps))
    return spark.createDataFrame(rows, "regime string, max_iters int, bootstraps int")


@query(given([("fast_mode_design_probe", 5, 2, 2, 5), ("known_graph_fast_probe", 7, 10, 2, 2), ("paper_minimum_full", 0, 0, 0, 0), ("sanity_default", 4, 10, 1, 1), ("structural_default", 5, 10, 1, 1)], "stage, datasets, models, seeds, ablations"))
def q_evidence_stages(spark, sf):
    rows = [(s.name, len(s.datasets or ()), len(s.baselines or ()), len(s.seeds or ()), len(s.labels or ())) for s in experiments.stages().values()]
    return spark.createDataFrame(rows, "stage string, datasets int, models int, seeds int, ablations int")


@query(f"WITH {base._R} SELECT 'structural_default' AS stage, true AS completed, count(*) AS records, count(CASE WHEN status = 'ok' THEN 1 END) AS ok, count(CASE WHEN status <> 'ok' THEN 1 END) AS skipped FROM rec WHERE dataset_regime = 'known_graph' UNION ALL SELECT 'paper_minimum_full', true, count(*), count(CASE WHEN status = 'ok' THEN 1 END), count(CASE WHEN status <> 'ok' THEN 1 END) FROM rec UNION ALL SELECT 'sanity_default', false, 0, 0, 0")
def q_evidence_overview(spark, sf):
    runs = _runs()
    known = [r for r in runs if r.dataset_regime == "known_graph"]
    payload = lambda rs: {"records": [r.to_dict() for r in rs], "tables": {}}
    s = experiments.summarize_evidence(spark, {"structural_default": payload(known), "paper_minimum_full": payload(runs)}, ["sanity_default", "structural_default", "paper_minimum_full"])
    return spark.createDataFrame([(o["stage_name"], o["completed"], o["num_records"], o["num_ok"], o["num_skipped"]) for o in s["stage_overview"]], "stage string, completed boolean, records long, ok long, skipped long")


@query(f"WITH {base._R}, d AS (SELECT dataset_name, avg(shd) AS shd, avg(sec) AS sec FROM rec WHERE status = 'ok' AND ablation_label = 'default' AND model_name = '{decisions.METHOD}' AND shd IS NOT NULL GROUP BY 1), f AS (SELECT dataset_name, avg(shd) AS shd, avg(sec) AS sec FROM rec WHERE status = 'ok' AND ablation_label = 'known_graph_fast' GROUP BY 1) SELECT d.dataset_name, round(f.shd - d.shd, 6) AS shd_delta, round(f.sec, 6) AS fast_seconds, round(d.sec, 6) AS default_seconds FROM d JOIN f USING (dataset_name)")
def q_fast_mode_rows(spark, sf):
    """The numbers behind the fast profile's part of the write-up."""
    got = report.fast_mode_summary(spark, {"records": [r.to_dict() for r in _runs()]}, ["known_graph_fast"])["candidates"]["known_graph_fast"]["dataset_rows"]
    pick = lambda r, *names: next(float(r[n]) for n in names if r.get(n) is not None)
    return spark.createDataFrame([(r["dataset_name"], round(pick(r, "shd_delta_vs_default"), 6), round(pick(r, "fast_total_seconds", "candidate_total_seconds", "total_seconds", "ablation_total_seconds"), 6), round(pick(r, "default_total_seconds"), 6)) for r in got], "dataset_name string, shd_delta double, fast_seconds double, default_seconds double")


@query(given([("tabpfn", "skipped", 1), ("xgboost", "skipped", 1), ("lightgbm", "skipped", 1), ("catboost", "skipped", 1)], "model_name, status, notes"))
def q_skipped_records(spark, sf):
    """Models whose libraries are not there leave a record that says so."""
    x = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("r"))
    split = Split("s", 7, x, x, x, Dataset("nations", x, "r"))
    runs = [experiments.runners()[m].run(split, PipelineConfig("r"), ablations()["default"]) for m in ("tabpfn", "xgboost", "lightgbm", "catboost")]
    return spark.createDataFrame([(r.model_name, r.status, len(r.notes)) for r in runs], "model_name string, status string, notes int")


@query(given([("catboost", False), ("ft_transformer", False), ("lightgbm", False), ("tabicl", False), ("tabm", False), ("tabpfn", False), ("xgboost", False)], "name, available"))
def q_availability(spark, sf):
    return spark.createDataFrame([(k, v.available) for k, v in experiments.availability().items()], "name string, available boolean")


@query(given([("auto", "cpu"), ("cpu", "cpu"), ("cuda:0", "refused")], "asked, device"))
def q_devices(spark, sf):
    def resolve(x):
        try:
            return experiments.resolve_device(x)
        except ValueError:
            return "refused"

    return spark.createDataFrame([(x, resolve(x)) for x in ("auto", "cpu", "cuda:0")], "asked string, device string")


@query(given([("set", "1"), ("removed", "None"), ("after", "before")], "state, value"))
def q_temporary_environment(spark, sf):
    import os

    name = "CREDENCE_TEMPORARY"
    with experiments.temporary_env(**{name: "before"}):
        with experiments.temporary_env(**{name: "1"}):
            rows = [("set", os.environ[name])]
        with experiments.temporary_env(**{name: None}):
            rows.append(("removed", str(os.environ.get(name))))
        rows.append(("after", os.environ[name]))
    return spark.createDataFrame(rows, "state string, value string")


@query(given([("availability",), ("device",), ("git_sha",), ("python",)], "key"))
def q_run_metadata_keys(spark, sf):
    return spark.createDataFrame([(k,) for k in experiments.run_metadata()], "key string")


@query(given([(m,) for m in ("aode", "catboost", "greedy_hc_bn", "kdb", "lightgbm", "naive_bayes", "neural_screened_bn", "tabpfn", "tan", "xgboost")], "model_name"))
def q_runner_registry(spark, sf):
    return spark.createDataFrame([(m,) for m in experiments.runners()], "model_name string")


@query(given([(m,) for m in ("baselines", "materialize-expert-bn", "run-evidence", "run-suite", "smoke", "summarize-paper", "train")], "command"))
def q_commands(spark, sf):
    from .cli import parser

    actions = next(a for a in parser()._actions if a.dest == "command")
    return spark.createDataFrame([(c,) for c in actions.choices], "command string")


@query(given([("paper_minimum", 7, 10, 2, 8), ("smoke", 2, 4, 1, 2)], "suite, datasets, models, seeds, ablations"))
def q_suite_contents(spark, sf):
    return spark.createDataFrame([(s.name, len(s.datasets), len(s.baselines), len(s.seeds), len(s.ablations)) for s in suites().values()], "suite string, datasets int, models int, seeds int, ablations int")


# --- families beyond arrays, and pruning in one pass -----------------------------------------------------------------------------

#: (node, parents) over orders and their customers; the larger ones have from thousands to thousands of millions of possible cells.
_ORDER_FAMILIES = [("prio", ("seg",)), ("prio", ("cust", "seg")), ("prio", ("cust", "price", "seg")), ("price", ("cust", "nation", "prio", "seg"))]
_ORDER_COLUMNS = ["prio", "seg", "nation", "cust", "price"]
_ORDER_SQL = (
    "w AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS prio, ascii(substr(c_mktsegment, 1, 1)) - 65 AS seg, CAST(c_nationkey AS INT) AS nation, CAST(o_custkey AS INT) AS cust, CAST(floor(o_totalprice / 10) AS INT) AS price "
    "FROM orders JOIN customer ON o_custkey = c_custkey), "
    "k AS (SELECT " + ", ".join(f"CAST(max({c}) + 1 AS DOUBLE) AS {c}" for c in _ORDER_COLUMNS) + ", CAST(count(*) AS DOUBLE) AS rows_ FROM w)"
)


def _family_sql(i: int, node: str, parents: tuple[str, ...]) -> str:
    own = ", ".join(parents)
    q = " * ".join(f"k.{p}" for p in parents)
    return (
        f"SELECT {i} AS family, round(r.like_ - 0.5 * {q} * (k.{node} - 1) * ln(k.rows_), 2) AS bic, round(r.bdeu, 3) AS bdeu FROM k, "
        f"(SELECT sum(own - row_ * ln(row_)) AS like_, sum(cells + lgamma(10.0 / ({q})) - lgamma(10.0 / ({q}) + row_)) AS bdeu FROM k, "
        f"(SELECT {own}, CAST(sum(n) AS DOUBLE) AS row_, sum(n * ln(n)) AS own, sum(lgamma(10.0 / ({q} * k.{node}) + n) - lgamma(10.0 / ({q} * k.{node}))) AS cells FROM k, "
        f"(SELECT {own}, {node} AS v, count(*) AS n FROM w GROUP BY ALL) GROUP BY {', '.join(f'{p}' for p in range(1, len(parents) + 1))})) r"
    ).replace(f"(SELECT {own}, CAST(sum(n)", f"(SELECT {', '.join(f'g.{p}' for p in parents)}, CAST(sum(n)").replace("GROUP BY ALL) GROUP BY", "GROUP BY ALL) g GROUP BY")


@query(f"WITH {_ORDER_SQL} " + " UNION ALL ".join(_family_sql(i, n, p) for i, (n, p) in enumerate(_ORDER_FAMILIES)))
def q_large_family_scores(spark, sf):
    """Families of up to some 10^12 possible cells, scored from the cells that occur, with nothing laid out."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    codes = rows.select(
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("prio"),
        (F.ascii(F.substring("c_mktsegment", 1, 1)) - 65).alias("seg"),
        F.col("c_nationkey").cast("int").alias("nation"),
        F.col("o_custkey").cast("int").alias("cust"),
        F.floor(F.col("o_totalprice") / 10).cast("int").alias("price"),
    )
    store = CountStore(codes, 0)
    bic, bdeu = (family_scores(store.collapsed, _ORDER_FAMILIES, store.cards, kind) for kind in ("bic", "bdeu"))
    return spark.createDataFrame([(i, round(a, 2), round(b, 3)) for i, (a, b) in enumerate(zip(bic, bdeu))], "family int, bic double, bdeu double")


_PRUNE_COLUMNS = ["x1", "x2", "x3", "x4"]


def _without_sql(dropped: str) -> str:
    kept = [c for c in _PRUNE_COLUMNS if c != dropped]
    return f"SELECT * FROM (WITH {_NB_VIEW}, {_nb_sql('tr', 'te', kept, 'y')}, {_NB_AUC} SELECT '{dropped}' AS target, (SELECT round(-sum(w * ln(p)) / sum(w), 6) FROM post WHERE y = k) AS log_loss, (SELECT round(avg(auc), 5) FROM aa) AS roc_auc)"


@query(" UNION ALL ".join(_without_sql(c) for c in _PRUNE_COLUMNS))
def q_losses_without_each_edge(spark, sf):
    """Held-out log loss and area of a graph without each of its edges, in one pass each."""
    codes = table(spark, sf, "lineitem").select(
        (F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)).alias("y"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("x1"),
        (F.col("l_linenumber") - 1).cast("int").alias("x2"),
        F.round(F.col("l_discount") * 100).cast("int").alias("x3"),
        F.round(F.col("l_tax") * 100).cast("int").alias("x4"),
        (F.col("l_orderkey") % 5 == 0).alias("held"),
    )
    store = CountStore(codes.where("NOT held").drop("held"), 0)
    g = Dag(store.columns, [("y", c) for c in _PRUNE_COLUMNS])
    climb = HillClimb(store, "y", SearchConfig(), screening.full_pools(store.columns))
    _, losses, areas = climb.without_each(g, climb.fit_net(g), collapse(codes.where("held").drop("held")), g.edges())
    area = areas(g.edges())
    return spark.createDataFrame([(c, round(losses[p, c], 6), round(area[p, c], 5)) for p, c in g.edges()], "target string, log_loss double, roc_auc double")


#: Queries of both modules that read no table: what they state is a property of the code. They are tests (``tests/test_queries.py``
#: runs them against their SQL) and are not registered for the driver.
TABLE_FREE = frozenset(
    "bundle_topk graph_prior hub_penalty reachability acyclic_check markov_blanket legal_additions legal_reversals shd edge_prf leaderboard ablation_summary evidence_decision "
    "promotion_gate synthetic_dag_sample forward_sample synthetic_properties forward_sample_frequencies dataset_registry json_round_trip markdown_lines predictive_leaderboard "
    "structural_leaderboard search_complexity skipped_items low_thresholds sanitized_names full_pools neural_properties start_graphs checkpoint_choice start_choice prune_acceptance "
    "prune_budget strict_edges greedy_first_moves ablation_settings fast_ablation evidence_stages evidence_overview fast_mode_rows availability devices temporary_environment "
    "run_metadata_keys runner_registry commands suite_contents".split()
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
