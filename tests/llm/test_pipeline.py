"""Each stage of the pipeline against a plain version on a small table."""

import os

import pytest

import corpus_pipeline
from credence.llm import jaccard, langid, quality, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", "en", "s", 0), (9003, "12 34", None, "s", 5), (None, "no id here but some words to keep it apart", "en", "s", 42)], base.schema)
    path = str(tmp_path_factory.mktemp("d") / "documents.parquet")
    base.unionByName(extra).write.parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect())


def test_language_stage(spark, docs):
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == COLUMNS
    model = langid.train_outside_fold(docs)
    rows = docs.collect()
    langs, scores = model.predict([r["text"] or "" for r in rows])
    assert ids(out) == sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r, x, s in zip(rows, langs, scores) if x != "und" and s >= 0.5)


def test_quality_stage(spark, docs):
    out = corpus_pipeline.quality_filter(spark, docs, SF)
    assert out.columns == COLUMNS
    net = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    score = net.score(quality.features([r["text"] or "" for r in rows]))
    assert ids(out) == sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r, s in zip(rows, score) if s >= quality.THRESHOLD)


def test_near_duplicate_stage_keeps_one_of_a_class(spark, docs):
    twice = docs.union(docs.where("doc_id < 3"))
    out = corpus_pipeline.near_duplicates(spark, twice, SF)
    assert out.columns == COLUMNS
    rows = jaccard.near_duplicates(docs.select("doc_id", "text")).collect()
    assert ids(out) == sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in rows if r["doc_id"] is None or r["doc_id"] == r["class_id"]) == ids(out.distinct())


def test_different_texts_of_one_id_stay(spark, docs):
    words = " ".join("word%d" % i for i in range(30))
    rows = [(1, words, "en", "s", 1), (2, words + " more", "en", "s", 1), (2, "another text under the same number, which stays", "en", "s", 1), (2, "another text under the same number, which stays", "en", "t", 1), (3, "a", "en", None, None), (None, None, None, None, None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), SF)
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in spark.createDataFrame([rows[0], rows[2], rows[4], rows[5]], docs.schema).collect())


def test_secret_stage(spark, docs):
    out = corpus_pipeline.secret_scan(spark, docs, SF)
    assert out.columns == COLUMNS and ids(out) == ids(docs)
    for r in out.collect():
        assert not secrets.base_spans((r["text"] or "").replace("[SECRET]", " ")) and (r["text"] is None or r["n_chars"] == len(r["text"]))


def test_stages_take_empty_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    assert len(out) and (out.groupby("sequence_id")["length"].sum() <= 4096).all()
