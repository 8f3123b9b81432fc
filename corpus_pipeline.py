"""A training corpus from raw documents, stage by stage.

Toxic documents go, of near-duplicates one stays, personal data is masked, and
what is left is packed into windows. Every stage is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.llm import near_dedup, packing, pii, toxicity
from cartwise.llm.shared import own_folder, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't reject. Rows are judged by their text,
    so copies of a document share its fate; a null or empty text stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the
    document of smallest id, once. Documents without words have no duplicates
    but repeated ids; rows with a null doc_id stay."""
    found = near_dedup.near_duplicates(docs, words=5, percent=80)
    kept = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.lit(1).alias("_kept"))
    once = Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")
    named = docs.filter("doc_id IS NOT NULL").join(kept.select("doc_id"), "doc_id", "left_semi")
    named = named.withColumn("_copy", F.row_number().over(once)).filter("_copy = 1").drop("_copy")
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with e-mail and IP addresses, card and phone numbers masked;
    n_chars follows the new text, and null texts stay null."""
    hidden = pii.redact(docs)
    chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return hidden.withColumn("n_chars", chars).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in windows; see `packing.pack`."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", mask_personal_data), ("packing", pack_windows)]

#: A trained model decides, which SQL can't say; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; the rows of the last one."""
    folder = own_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), folder, f"{number}-{name}")
    return docs
