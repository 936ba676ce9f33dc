"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Low quality goes, one document of each near-duplicate group stays, documents with
benchmark passages go, secrets are masked, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe, decontaminate, quality_classifier, secrets, similar, simhash
from readloom.llm.common import stored, table
from readloom.llm.queries import held_out, token_digests, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def session(spark: SparkSession) -> None:
    """Settings of the pipeline's session: its stages share Python workers, so texts go to them 16 MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    session(spark)
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality_classifier.score(docs.select(*COLUMNS), model, to="_score")
    return scored.where(F.col("_score") >= 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    SimHash fingerprints link within two bits, which pivot distance tables find, as in op6. Edited
    copies are further apart, so texts that are not connected by then are linked at a five-word
    similarity of 0.8 or more.
    """
    session(spark)
    docs = docs.select(*COLUMNS)
    named = similar.named_sets(docs)
    near = simhash.links(stored(named.select("fp").distinct(), "pipeline-fingerprints"))
    return simhash.keep_one(docs, named, similar.links(docs, named, near)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    session(spark)
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; no document goes. n_chars is counted anew."""
    session(spark)
    forest = secrets.train(secrets.labelled_findings(spark))
    masked = secrets.redact(docs.select(*COLUMNS), forest)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with digests of ids and decoded bytes."""
    session(spark)
    return bpe.encode(docs, *vocabulary(), keep=["doc_id", "lang", "source", "n_chars"], derive=token_digests(with_ids=True))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: The trained models and the components cannot be said in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
