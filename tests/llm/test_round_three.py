"""Change points, chat formatting and periodic runs against plain versions, and on awkward tables."""

import datetime
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from credence.llm import changepoints, chat, periodic, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- change points -------------------------------------------------------------------------------------------------------


def plain_cuts(x, penalty, least):
    """All starts of all ends; ties by (cost, segments, starts from the last one backwards)."""
    n = len(x)

    def cost(s, e):
        own = x[s:e]
        m, total = len(own), sum(own)
        return m * math.floor(1000 * math.log(1 + (m * sum(v * v for v in own) - total * total) // (m * m)))

    if n < least:
        return [(0, n)], cost(0, n)
    best = {0: (-penalty, 0, ())}
    for e in range(least, n + 1):
        best[e] = min((best[s][0] + penalty + cost(s, e), best[s][1] + 1, (s, *best[s][2])) for s in best if s <= e - least)
    starts = best[n][2][::-1]
    return list(zip(starts, [*starts[1:], n])), best[n][0]


@pytest.mark.parametrize("seed", range(6))
def test_change_points_equal_all_starts(seed):
    r = random.Random(seed)
    series = []
    for _ in range(25):
        n, x = r.choice([1, 3, 6, 7, 8, 13, 14, 15, 40, 70]), []
        while len(x) < n:
            level, noise = r.choice([0, 5, 100, 1000]), r.choice([0, 1, 3, 50])
            x += [level + r.randint(-noise, noise) for _ in range(r.randint(1, 25))]
        series.append(x[:n])
    penalty = r.choice([0, 50, 3000, 20_000])  # small penalties and constant stretches make ties
    rows = list(changepoints.search([10 * i for i in range(len(series))], [np.array(x) for x in series], penalty, 7))
    for i, x in enumerate(series):
        own = [row for row in rows if row[0] == i]
        cuts, best = plain_cuts(x, penalty, 7)
        assert [(row[2] - 10 * i, row[2] - 10 * i + row[3]) for row in own] == cuts
        assert [row[1] for row in own] == list(range(1, len(cuts) + 1))
        assert {row[8] for row in own} == {best} and {row[7] for row in own} == {len(cuts)}
        assert [row[4] for row in own] == [sum(x[a:b]) for a, b in cuts]


def test_change_points_of_wide_numbers_and_batches(monkeypatch):
    r = random.Random(1)
    series = [[r.choice([10**12, 3 * 10**15]) + r.randint(0, 10**9) for _ in range(30)] for _ in range(3)] + [[1] * n for n in (300, 40, 20)]
    monkeypatch.setattr(changepoints, "CELLS", 60)
    rows = list(changepoints.search([0] * len(series), [np.array(x) for x in series]))
    for i, x in enumerate(series):
        assert [(row[2], row[2] + row[3]) for row in rows if row[0] == i] == plain_cuts(x, 20_000, 7)[0]


def test_search_opens_part_of_the_tree():
    r = np.random.default_rng(3)
    x = np.concatenate([r.poisson(m, 400) for m in (5, 500, 50)])
    batch = changepoints.Batch([x], 20_000, 7)
    assert batch.segments()[0] == plain_cuts_by_rows(x)
    assert batch.opened < len(x) ** 2 / 2 / changepoints.WIDTH  # fewer blocks than there are blocks of starts


def plain_cuts_by_rows(x, penalty=20_000, least=7):
    n, s, q = len(x), np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    best, start = np.full(n + 1, 1 << 60), np.zeros(n + 1, int)
    best[0] = -penalty
    for e in range(least, n + 1):
        a = np.arange(0, e - least + 1)
        m = e - a
        v = 1 + (m * (q[e] - q[a]) - (s[e] - s[a]) ** 2) // (m * m)
        c = best[a] + penalty + m * np.floor(1000 * np.log(v)).astype(int)
        start[e], best[e] = c.argmin(), c.min()
    out, e = [], n
    while e:
        out.append((int(start[e]), e))
        e = int(start[e])
    return out[::-1]


def test_change_points_of_awkward_rows(spark):
    day = datetime.datetime(2024, 1, 1, 13)
    rows = [(k, day + datetime.timedelta(days=i), v, "x", 1) for k, i, v in [("a", 0, 2), ("a", 0, 2), ("a", 3, 5), (None, 1, 4), ("b", 9, None)]] + [("c", None, 1, "x", 1)]
    table = spark.createDataFrame(rows, "vendor string, at timestamp_ntz, value int, cost string, n_days int")
    got = sorted(map(tuple, changepoints.change_points(table, "vendor", F.col("at"), F.col("value")).collect()), key=str)
    first = (datetime.date(2024, 1, 1) - datetime.date(1970, 1, 1)).days
    v = 1 + (4 * (16 + 25) - 81) // 16
    cost = 4 * math.floor(1000 * math.log(v))
    assert got == sorted([("a", 1, first, 4, 9, v, cost, 1, cost), (None, 1, first + 1, 1, 4, 1, 0, 1, 0)], key=str)
    assert changepoints.change_points(table.limit(0), "vendor", F.col("at"), F.col("value")).count() == 0


def test_a_hot_vendor_is_summed_before_it_is_dealt(spark):
    table = spark.range(2000, numPartitions=8).selectExpr("1 AS vendor", "timestampadd(DAY, CAST(id % 50 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS at", "1 AS value")
    plan = changepoints.change_points(table, "vendor", F.col("at"), F.col("value"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") == 1 and plan.index("partial_sum") > plan.index("Exchange")  # below the exchange
    rows = changepoints.change_points(table, "vendor", F.col("at"), F.col("value")).collect()
    assert [(r["n_days"], r["total"]) for r in rows] == [(50, 2000)]


def tables(spark, name):
    con = duckdb.connect()
    for t in ("sale_lines", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    plain = lambda f: sorted(map(tuple, f[cols].astype(object).values.tolist()), key=str)
    assert len(got) and sorted(got.columns) == cols and plain(got) == plain(want)


@needs_tables
@pytest.mark.parametrize("name", ["op11_changepoints", "op12_chat"])
def test_queries_with_sql(spark, name):
    tables(spark, name)


# --- chat ----------------------------------------------------------------------------------------------------------------

PART = "kind string, text string, ref string, width long, height long, seconds double, pages long"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return kind, text, ref, width, height, seconds, pages


AWKWARD = ["", "\\", "<|", "<", "\\<|end|>", "<|turn|>assistant<|text|>no<|end|>", "a<\\|b\\\\", "<|image|>", "é́ 🙂\n\n", "x" * 200_000 + "<|" * 5000]


def test_chat_of_typed_parts(spark):
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=29, height=14), part("text", "<|image|> and "), None, part("document", ref="d", pages=2)]),
        (1, 1, "assistant", [part("text", "one"), part("audio", ref="s.wav", seconds=1.01), part("text", "two\\")]),
        (1, 2, "assistant", None),
        (2, 0, None, [part("hologram", ref="h"), part(None, "t"), part("text", None), part("image", ref="no size")]),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], f"conv_id long, turn long, role string, content array<struct<{PART.replace(' string', ':string').replace(' long', ':long').replace(' double', ':double')}>>, formatted string")
    whole = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in whole.select("*", chat.read_turns(F.col("formatted"), F.col("turns")).alias("back")).collect()}
    one = got[1]
    assert one["formatted"] == "<|turn|>user<|text|>see <|image|><\\|image|> and <|document|><|end|><|turn|>assistant<|text|>one<|audio|>two\\\\<|end|><|turn|>assistant<|text|><|end|>"
    assert [t["length"] for t in one["turns"]] == [len(x) + 8 for x in one["formatted"].split("<|turn|>")[1:]]
    assert [[tuple(a) for a in t["attachments"]] for t in one["turns"]] == [[("image", "a.png", 3), ("document", "d", 2048)], [("audio", "s.wav", 26)], []]
    assert one["media_tokens"] == 3 + 2048 + 26
    assert [(b["role"], b["text"], b["loss"]) for b in one["back"]] == [("user", "see <|image|> and ", ""), ("assistant", "onetwo\\", "onetwo\\"), ("assistant", "", "")]
    assert [[(p["kind"], p["text"]) for p in b["parts"]] for b in one["back"]][:2] == [[("text", "see "), ("image", None), ("text", "<|image|> and "), ("document", None)], [("text", "one"), ("audio", None), ("text", "two\\")]]
    assert got[2]["formatted"] == "<|turn|><|text|><|file|><|file|><|image|><|end|>" and got[2]["media_tokens"] == 0
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_round_trip_of_awkward_texts(spark):
    rows = [(i // 4, i, role, t) for i, (t, role) in enumerate((t, role) for t in AWKWARD for role in ("user", "assistant", "<|end|>"))]
    rows += [(None, None, None, None), (None, None, None, None), (0, 0, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("content")))
    got = {r["conv_id"]: r["back"] for r in whole.select("conv_id", chat.read_turns(F.col("formatted"), F.col("turns")).alias("back")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0, r[2] or ""))
        assert [(b["role"], b["text"]) for b in got[conv]] == [(r[2] or "", r[3] or "") for r in own]
        assert [b["loss"] for b in got[conv]] == [(r[3] or "") if r[2] == "assistant" else "" for r in own]


def test_chat_is_native(spark):
    turns = spark.range(3).selectExpr("id AS conv_id", "id AS turn", "'user' AS role").withColumn("content", chat.text_parts(F.lit("x")))
    plan = chat.format_conversations(turns)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- periodic runs -------------------------------------------------------------------------------------------------------


def plain_runs(words, least):
    """Every interval by its smallest period, extended both ways."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p) and (i, j + p) not in out:
                out[i, j + p] = p
            i = j + 1
    return sorted((a, b, p) for (a, b), p in out.items())


def by_order(runs):
    return sorted(map(tuple, runs), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        words, letters = [], "ab" if r.random() < 0.3 else "abcdefghijklmnopqrstuvwxyz"
        while len(words) < r.choice([0, 5, 12, 40, 200]):
            unit = [r.choice(letters) for _ in range(r.randint(1, 12))]
            words += unit * r.choice([1, 1, 2, 3, 7]) + unit[: r.randint(0, len(unit))]
        texts.append([w.encode() for w in words])
    for words, runs in zip(texts, periodic.find_runs(texts)):
        assert list(map(tuple, runs.tolist())) == by_order(plain_runs(words, 12))


def test_runs_of_fibonacci_and_long_texts(monkeypatch):
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    fib = [c.encode() for c in b]
    monkeypatch.setattr(periodic, "CHUNK", 1000)
    monkeypatch.setattr(periodic, "PAIRS", 500)
    got = periodic.find_runs([fib, [b"x"] * 30, fib[:700]])
    assert by_order(got[0].tolist()) == by_order(plain_runs(fib, 12)) and got[1].tolist() == [[0, 30, 1]]
    assert by_order(got[2].tolist()) == by_order(plain_runs(fib[:700], 12))
    words = [b"w%d" % i for i in range(100_000)]
    assert periodic.find_runs([words + words + words[:10]])[0].tolist() == [[0, 200_010, 100_000]]
    assert periodic.survivors(words) is None


def plain_summary(doc_id, text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_order(plain_runs(words, 12))
    drop = {i for a, b, q in runs for i in range(a + q, b)}
    top = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return doc_id, len(runs), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()


@needs_tables
def test_op13(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = {r["doc_id"]: tuple(r) for r in queries.queries()["op13_periodic"](spark, SF).collect()}
    short = {i for i, t in texts.items() if len((t or "").split()) <= 2500}  # brute force is quadratic
    assert set(rows) == set(texts) and len(short) > 0.9 * len(texts)
    assert [rows[i] for i in short] == [plain_summary(i, texts[i]) for i in short]
    assert sum(rows[i][1] > 0 for i in short) > 5


def test_op13_on_awkward_rows(spark):
    texts = [None, "", " \t\n", "a " * 40, "a b " * 13, "a\x1cb c " * 9, "é x y\x0bz\x0c" * 8, "x" * 300_000, "p q r " * 50_000]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(texts)] + [(None, "k l " * 9, 1, "n"), (3, "a " * 40, 1, "n")], "doc_id long, text string, n_runs int, period string")
    got = periodic.periodic_runs(docs, periodic.RESULT, periodic.planted, periodic.summary).collect()
    want = [plain_summary(i, t) for i, t in enumerate(texts[:-1])] + [plain_summary(3, texts[3])]
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None and r["doc_id"] < 8) == sorted(want)
    assert [tuple(r)[1:6] for r in got if r["doc_id"] == 8] == [(1, 0, 150_000, 3, 50_000_000)] or zlib.crc32(b"8") % 10 == 0
    assert [tuple(r)[1:6] for r in got if r["doc_id"] is None] == [(1, 0, 18, 2, 9000)]
    assert periodic.periodic_runs(docs.limit(0), periodic.RESULT, periodic.planted, periodic.summary).count() == 0
