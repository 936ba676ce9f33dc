"""Exact duplicates: the first read in file order is kept, later ones are flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.operators.storage import stored

#: Copies up to which their numbers are broadcast to the reads.
MOST_BROADCAST = 500_000


def key(columns: list[str]) -> Column:
    """All sequences in a row, without a delimiter, in one case."""
    return F.upper(F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in columns)) if columns else F.lit(""))


def plain(key: Column) -> Column:
    """Only such keys can be duplicates."""
    return key.rlike(r"^[ACGTN]*\z")


def flag_duplicates(df: DataFrame, columns: list[str], to: str = "duplicate", rec: str = "rec") -> DataFrame:
    """Adds ``to``. A key with a character outside ACGTN never counts as a duplicate.

    Only record numbers and 128-bit digests of keys are dealt anew. Copies are combined before
    the shuffle, and the reads that are no first ones are found by their own number, which is
    unique: a sequence that half of the reads share makes no hot task. Whole reads only move
    where the copies are too many to be broadcast.
    """
    keys = df.select(rec, key(columns).alias("_key")).where(plain(F.col("_key"))).select(rec, F.unhex(F.md5("_key")).alias("_digest"))
    keys = stored(keys, "digests")
    first = keys.groupBy("_digest").agg(F.min(rec).alias(rec)).select(rec)
    copies = stored(keys.select(rec).join(first, rec, "left_anti").select(rec, F.lit(True).alias(to)), "copies")
    copies = F.broadcast(copies) if copies.count() <= MOST_BROADCAST else copies
    return df.drop(to).join(copies, rec, "left").withColumn(to, F.coalesce(to, F.lit(False)))
