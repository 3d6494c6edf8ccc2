"""Driver queries of the training-data operators, with their contracts' columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm import ann, bpe, common, langid, lm, packing, pii, sharding, simhash, token_counts, topk, vectors

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def fold(doc_id: str = "doc_id") -> Column:
    """The fold, 0 to 4, of a document: crc32 of its id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after three edits of every document: a note after the first third, a
    mark in place of 24 characters in the middle, the last 16 characters gone."""
    docs = common.table(spark, sf_dir, "documents")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    third, half = F.floor(n / 3), F.floor(n / 2)
    edits = token_counts.edit_list((third, third, F.lit(" [see note 42] ")), (half, half + 24, F.lit("***")), (n - 22, n - 6, F.lit("")))
    out = token_counts.count_after_edits(docs, RANKS, PATTERN, edits)
    return out.withColumn("edited_sha256", F.sha2(F.col("edited_text").cast("binary"), 256)).drop("edited_text")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").where(vectors.finite(F.col("embedding")))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256))
    return topk.top_k(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 50 == 0, k=5)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count_of(base, k).alias(f"n_{k}") for k in pii.KINDS]
    total = F.size("spans").cast("long")
    added = [total.alias("n_spans"), (total - F.size(base)).alias("n_added")]
    return found.select("doc_id", *counts, F.sha2(pii.joined("spans", True).cast("binary"), 256).alias("base_sha256"), pii.joined("spans", False).alias("spans"), *added)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.table(spark, sf_dir, "documents"), 24)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold() != 0))
    named = docs.select(F.struct("doc_id", (fold() == 0).alias("held_out")).alias("doc"), "text")
    out = langid.identify(named, model, id_col="doc")
    return out.select("doc.doc_id", "doc.held_out", "lang_pred", "score", "margin", "rejected")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(common.table(spark, sf_dir, "documents"), fold() != 1)
    per_token = [(F.col("score") / F.col("n_tokens")).alias("score_per_token"), (F.col("n_elsewhere") / F.col("n_tokens")).alias("share_elsewhere")]
    return out.withColumn("held_out", fold() == 1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_failures", "n_elsewhere", *per_token)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(common.table(spark, sf_dir, "documents"), RANKS, PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), TOKENIZER, PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    each = (op1_token_counts, op2_top_k, op3_pii, op4_ann, op5_sharding, op6_langid, op7_lm_score, op8_bpe, op9_packing, op10_simhash, pipeline)
    return {f.__name__: f for f in each}


#: Integer products of all rows with the query rows, by joining components.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def oracle_sql():
    return {"op2_top_k": OP2_SQL}
