"""A corpus made ready for training: five stages over ``documents``, each written as Parquet and read by the next.

All but the last return the columns that they were given; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import decontaminate, minhash, packing, quality, secrets
from sigloom.llm.store import keep


#: Ids of documents to leave out that are sent to all tasks, 16 MB of them; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the ids of ``gone`` (doc_id); texts stay where they are while those ids are few by count."""
    gone = keep(gone.where("doc_id is not null").distinct(), "left-out")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.  Null and empty texts are scored like others; rows with a null
    doc_id stay, as no decision can name them."""
    scored = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 0").select("doc_id"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): that of the smallest doc_id.  Rows with a null
    doc_id stay; rows that repeat a kept doc_id are that document."""
    found = minhash.near_duplicates(docs, words=5)
    return _without(docs, found.where("not kept").select("doc_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("runs") == 0).select("row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets taken out of the text and n_chars, where there is such a column, to match."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: No SQL expresses a fitted classifier or a packing: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
