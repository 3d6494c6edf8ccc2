"""Corpus preparation: language ID, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. What a stage
returns is written as Parquet and read again before the next one. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm import common, langid, packing, pii, simhash
from driftlane.llm.queries import PATTERN, TOKENIZER, fold

#: SQL for run()'s rows: no stage of these can be put in SQL.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; a missing ``lang`` takes the told one.

    Rejected documents go: those without a letter, and those whose two nearest
    languages compress them to nearly the same size, against their own. The model learns from the labelled
    documents outside fold 0. Without any labelled document nothing can be told,
    and only documents without a letter go.
    """
    model = langid.fit(docs.where(fold() != 0))
    kept = _columns(docs)
    if not model:
        return docs.select(*kept).where(F.col("text").rlike(r"\p{L}"))
    told = langid.identify(docs.select(F.struct(*kept).alias("doc"), "text"), model, id_col="doc")
    lang = F.coalesce("doc.lang", "lang_pred").alias("lang")
    return told.where(~F.col("rejected")).select(*[lang if c == "lang" else F.col(f"doc.{c}").alias(c) for c in kept])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the least id, a null id being
    the last; of several with that id, whatever their texts, one row.

    Each row gets a number that is written with it, so ids need not be unique, and
    rows with one id and texts of different groups all stay."""
    kept = _columns(docs)
    numbered = common.stage(docs.select(*kept).withColumn("row", F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row").alias("key")
    groups = simhash.near_duplicates(numbered.select(key, "text"), id_col="key")
    first = groups.select(F.col("component_id.row").alias("row")).distinct()
    return numbered.join(first, "row", "left_semi").select(*kept)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and ``n_chars`` brought up to date."""
    out = pii.mask(docs.select(*_columns(docs)))
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, TOKENIZER, PATTERN)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("PII", personal_data), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = common.stage(function(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
