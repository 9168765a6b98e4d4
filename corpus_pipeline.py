"""A corpus pipeline: each stage reads what the one before it kept, and decides on its own input.

1. language (language identification): texts without letters, or of which no language has half of the letters, go; a
   missing ``lang`` is filled with the language found.
2. quality (positive-unlabelled learning): documents that score below 0.7 go.
3. near_duplicates (chosen-path join at Jaccard 0.8 on word 5-grams): of each class one document stays, that of the smallest
   doc_id; different texts under one doc_id are documents of their own, equal rows are one.
4. secrets (rules and randomness tests): every secret found is replaced by ``[SECRET]``; ``n_chars`` follows.
5. packing (grouping genetic algorithm): the pieces of all remaining documents, with sequence and offset.

All but the last return the columns of ``documents``. Rows with null doc_id stay in stage 3, since they cannot be told
apart; null texts go in stage 1. Empty tables pass through. SQL cannot express these stages: the tests hold each against a
brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm import jaccard, langid, packing, quality, secrets
from credence.llm.common import fresh_path, staged

MIN_SHARE = 0.5


def _plain(docs: DataFrame) -> DataFrame:
    """docs with neutral names for all columns but the three that stages read, so that none clashes with theirs."""
    return docs.toDF(*[c if c in ("doc_id", "text", "lang") else f"_x{i}" for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    found = langid.predict(plain, langid.train_outside_fold(plain), plain.columns)
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SHARE))
    return kept.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for c in plain.columns]).toDF(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    net, scored = quality.train_and_score(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"), plain.columns)
    if net is None:  # nothing to learn from: no decision
        return docs
    return scored.where(F.col("score") >= quality.THRESHOLD).drop("score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    key = ["doc_id", "_mark"]
    decided = jaccard.near_duplicates(plain.select("doc_id", "text")).where(F.col("doc_id").isNotNull())
    rows = decided.groupBy("doc_id", F.col("mark").alias("_mark")).agg(F.bool_and("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    special = staged(rows.where(~F.col("_kept") | (F.col("_n") > 1)), "decided")  # the others stay as they are
    marked = plain.withColumn("_mark", F.xxhash64("text"))
    single = marked.join(special.select(*key), key, "left_anti")
    repeated = marked.join(special.where("_kept").select(*key), key, "left_semi")
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).cast("string") for c in plain.columns if c not in ("doc_id", "text")]))
    once = repeated.withColumn("_row", first).where(F.col("_row") == 1)
    return single.select(*plain.columns).unionByName(once.select(*plain.columns)).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(staged(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES = [
    ("language", language),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = fresh_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
