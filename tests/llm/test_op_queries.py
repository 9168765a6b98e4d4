"""The queries themselves on the smallest tables, each against its contract: libraries, patterns and brute force."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from plain import brute_links, pii_base, secret_base

from credence.llm import quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
RUN = queries.queries()


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return {i: x or "" for i, x in zip(t["doc_id"], t["text"])}


@pytest.fixture(scope="module")
def vectors():
    t = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    return np.array(t["vec_id"]), np.array(t["embedding"], np.float64)


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_op1(spark, vectors):
    ids, x = vectors
    got = RUN["op1_ann"](spark, SF).toPandas()
    assert sorted(got["query_id"].unique()) == sorted(i for i in ids if i % 100 == 0)
    hit = 0
    for q, own in got.groupby("query_id"):
        own, k = own.sort_values("rank"), int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        by = dict(zip(ids.tolist(), d))
        assert own["rank"].tolist() == list(range(1, 11)) and [by[v] for v in own["vec_id"]] == own["score"].tolist()
        d[k] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(own["vec_id"]))
    assert hit >= 0.9 * len(got)


def test_op2_and_op9(spark, texts):
    tok = library("word_bpe_49k.json")
    ids = {i: np.array([*tok.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in texts.items()}
    got = RUN["op2_pack"](spark, SF).toPandas()
    for i, own in got.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own["start"].tolist() == list(range(0, len(ids[i]), 4096)) and own["length"].sum() == len(ids[i])
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[i][a : a + 4096].tobytes()) for a in own["start"]]
    assert set(got["doc_id"]) == set(ids)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1
    rows = {r["doc_id"]: r for r in RUN["op9_token_store"](spark, SF).collect()}
    before = 0
    for i in sorted(ids):
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (before, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        before += len(ids[i])


def test_op3(spark, texts):
    tok = library("byte_bpe_50k.json")
    rows = {r["doc_id"]: r for r in RUN["op3_bpe"](spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, x in texts.items():
        ids = tok.encode(x, add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op4_pii", pii_base, ["email", "ip", "card", "phone"]), ("op10_secrets", secret_base, ["assign", "access", "hex"])])
def test_op4_and_op10(spark, texts, name, plain, kinds):
    for r in RUN[name](spark, SF).collect():
        base = plain(texts[r["doc_id"]])
        own = base.split(",") if base else []
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(x.startswith(k + ":") for x in own) for k in kinds]
        assert set(own) <= set(r["spans"].split(","))


def test_op5(spark, texts):
    ids = sorted(texts)
    want = brute_links([texts[i] for i in ids])
    rows = {r["doc_id"]: r for r in RUN["op5_jaccard"](spark, SF).collect()}
    assert [(rows[i]["class_id"], rows[i]["n_links"]) for i in ids] == [(ids[c], n) for c, n in want]


def test_op6(spark, texts):
    rows = {r["doc_id"]: r for r in RUN["op6_quality"](spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    known = [(rows[i]["score"], q) for i, q in labels.items() if i in rows and rows[i]["held_out"] and q is not None]
    good, bad = [s for s, q in known if q == 1], [s for s, q in known if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_op7(spark, vectors):
    ids, x = vectors
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    links, smallest = linked.sum(1) - 1, ids.copy()
    while True:  # the smallest id reachable
        further = np.where(linked, smallest[None, :], ids.max() + 1).min(1)
        if (further == smallest).all():
            break
        smallest = further
    rows = {r["vec_id"]: r for r in RUN["op7_vector_dedup"](spark, SF).collect()}
    assert [(rows[i]["n_links"], rows[i]["component_id"], rows[i]["kept"]) for i in ids] == list(zip(links.tolist(), smallest.tolist(), (smallest == ids).tolist()))


def test_op8(spark, texts):
    rows = {r["doc_id"]: r for r in RUN["op8_language"](spark, SF).collect()}
    true = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    assert set(rows) == set(texts) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [r["lang_pred"] == true[i] for i, r in rows.items() if r["held_out"] and true[i] is not None and any(map(str.isalpha, texts[i]))]
    assert np.mean(held) > 0.9
    assert all(r["lang_pred"] == "und" for i, r in rows.items() if not any(map(str.isalpha, texts[i])))


def test_op6_on_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "good words in a sentence. " * 20, 1, b"x"), (1, "another text under one id", 2, b"y"), (2, None, 3, b"z"), (None, "no id", 4, None), (3, "x" * 3_500_000, 5, b"")], "doc_id long, text string, quality int, x binary")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    net, out = quality.train_and_score(docs.select("doc_id", "text"), labels, ["doc_id"])
    rows = out.collect()
    assert net is not None and len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.train_and_score(docs.limit(0).select("doc_id", "text"), labels, ["doc_id"])[1].count() == 0


def _tiny(spark):
    from credence.llm import langid

    return langid.train(spark.createDataFrame([(i, "the water of night", "en") for i in range(5)] + [(9, "maison de l\u2019eau", "fr")], "doc_id long, text string, lang string"))


def test_copies_of_one_row_spread_over_shards(spark):
    from credence.llm import packing, token_store
    from credence.llm.common import fresh_path

    same = spark.range(40_000, numPartitions=4).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "100L AS length", "7L AS ids_crc32")
    packed = packing.pack(same.select("doc_id", "piece", "start", "length", "ids_crc32"), shard_pieces=2_000)
    fills = packed.groupBy("sequence_id").agg({"length": "sum", "offset": "count"}).toPandas()
    assert packed.count() == 40_000 and fills["sum(length)"].max() <= 4096 and len(fills) <= -(-40_000 // 40) + 20
    import public_tokenizers

    docs = spark.range(20_000, numPartitions=4).selectExpr("5L AS doc_id", "'the same text' AS text")
    manifest = token_store.write_store(docs, fresh_path(spark, "store"), public_tokenizers.path("word_bpe_49k.json"), shards=8)
    assert manifest.count() == 8 and manifest.agg({"n_docs": "max"}).first()[0] < 5_000
    assert token_store.read_store(manifest).count() == 20_000


def test_op8_on_awkward_tables(spark):
    from credence.llm import langid

    assert {r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "\u0301\u0302"), (2, "\u0301 \u0302 12"), (3, ""), (4, "!?")], "doc_id long, text string"), _tiny(spark), ["doc_id"]).collect()} == {"und"}
    long = "the water and the house " * 200_000
    docs = spark.createDataFrame([(i, "the water and the house of night", "en") for i in range(30)] + [(5, "le de et eau maison", "fr")] * 30 + [(100, long, None), (100, long, None), (101, None, None)], "doc_id long, text string, lang string")
    rows = langid.predict(docs, langid.train_outside_fold(docs), ["doc_id"]).collect()
    assert len(rows) == 63 and [r["lang_pred"] for r in rows if r["doc_id"] == 100] == ["en", "en"]
