"""Lining up the records of up to four files: by position within a pair, by name between reads and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("comment", "mate", "seq", "plus", "qual")


def require(df: DataFrame, ok: Column, message: str | Column) -> DataFrame:
    """Fails the job at the first row that is not ``ok``. As a filter it cannot be pruned away."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def prefixed(df: DataFrame, side: str) -> DataFrame:
    return df.select("rec", "name", *(F.col(c).alias(f"{side}_{c}") for c in FIELDS if c in df.columns))


def pair(first: DataFrame, second: DataFrame, what: str) -> DataFrame:
    """Record k with record k (both already prefixed); unequal counts or names fail the job."""
    both = first.withColumn("_one", F.lit(True)).join(second.withColumnRenamed("name", "_name").withColumn("_two", F.lit(True)), "rec", "full_outer")
    both = require(both, F.col("_one").isNotNull() & F.col("_two").isNotNull(), f"{what} have different numbers of records")
    both = require(both, F.col("name").eqNullSafe(F.col("_name")), F.concat(F.lit(f"{what} have different names at record "), F.col("rec").cast("string")))
    return both.drop("_name", "_one", "_two")


def with_indexes(reads: DataFrame, indexes: DataFrame, strict: bool = True) -> DataFrame:
    """Indexes to reads by name. Strict: each name once on both sides. Else: the last record of a name, null where there is none."""
    fields = [c for c in indexes.columns if c not in ("rec", "name")]
    last = indexes.groupBy("name").agg(F.max_by(F.struct(*fields), "rec").alias("_last"), F.count("*").alias("_times"))
    if strict:
        last = require(last, F.col("_times") == 1, F.concat(F.lit("the index files have several records named "), F.col("name")))
        both = reads.join(last, "name", "full_outer")
        both = require(both, F.col("rec").isNotNull() & F.col("_times").isNotNull(), F.concat(F.lit("reads and indexes do not match at "), F.col("name")))
    else:
        both = reads.join(last, "name", "left")
    return both.select(*(c for c in reads.columns), *(F.col("_last")[c].alias(c) for c in fields))


def align(read1: DataFrame, read2: DataFrame | None = None, index1: DataFrame | None = None, index2: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """One wide row for each read: rec, name, r1_seq, r1_qual, ... for every side that is given."""
    reads = prefixed(read1, "r1")
    if read2 is not None:
        reads = pair(reads, prefixed(read2, "r2"), "the read files")
    given = [(s, d) for s, d in (("i1", index1), ("i2", index2)) if d is not None]
    if not given:
        return reads
    indexes = prefixed(given[0][1], given[0][0]).drop(*(f"{given[0][0]}_{c}" for c in ("comment", "mate", "plus")))
    if len(given) == 2:
        indexes = pair(indexes, prefixed(given[1][1], "i2").drop("i2_comment", "i2_mate", "i2_plus"), "the index files")
    return with_indexes(reads, indexes, strict)
