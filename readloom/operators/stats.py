"""Counts: barcodes with their mean qualities, combinations, lengths and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.quality import mean_scores
from readloom.plans.design import Token

LONG = ["table", "key", "assigned_name", "count", "average_quality"]


def barcode_table(df: DataFrame, token: Token) -> DataFrame:
    """seq, assigned, count, average_quality (array) of one token, over every parsed record."""
    c = token.column
    extra = [F.first(f"{c}_rc").alias("is_rc")] if f"{c}_rc" in df.columns else []
    return df.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias("seq"), F.col(f"{c}_id").alias("assigned")).agg(F.count("*").alias("count"), mean_scores(F.col(f"{c}_qual"), token.segment.size).alias("average_quality"), *extra)


def combinations(written: DataFrame, id_columns: list[str]) -> DataFrame:
    """How often each combination of names was written; one empty key where there are no tokens."""
    joined = F.concat_ws("_", *id_columns) if id_columns else F.lit("")
    return written.groupBy(joined.alias("combination")).agg(F.count("*").alias("count"))


def read_lengths(written: DataFrame, side: str) -> DataFrame:
    return written.groupBy(F.length(f"{side}_seq").cast("string").alias("length")).agg(F.count("*").alias("count"))


def read_statistics(processed: DataFrame, least: int = 22) -> DataFrame:
    """One row of totals over all reads (trimmed, with ``destination``)."""
    ok = F.length("r1_seq") >= least
    if "r2_seq" in processed.columns:
        ok = ok & (F.length("r2_seq") >= least)
    to = lambda d: F.count_if(ok & (F.col("destination") == d))
    return processed.agg(F.count("*").alias("TotalReads"), F.count_if(ok).alias("TotalWritten"), to("Main").alias("UniqueReads"), to("Duplicate").alias("DuplicateReads"), to("Rejected").alias("RejectedReads"))


def long_table(barcodes: dict[str, DataFrame], combined: DataFrame, lengths: dict[str, DataFrame], totals: DataFrame) -> DataFrame:
    """All tables below each other; NA where a column does not apply."""
    na = F.lit("NA")
    text = lambda a: F.concat_ws(",", F.transform(a, lambda x: x.cast("string")))
    parts = [d.select(F.lit(t).alias("table"), F.col("seq").alias("key"), F.col("assigned").alias("assigned_name"), "count", text("average_quality").alias("average_quality")) for t, d in barcodes.items()]
    parts += [combined.select(F.lit("Combinations").alias("table"), F.col("combination").alias("key"), na.alias("assigned_name"), "count", na.alias("average_quality"))]
    parts += [d.select(F.lit(t).alias("table"), F.col("length").alias("key"), na.alias("assigned_name"), "count", na.alias("average_quality")) for t, d in lengths.items()]
    wide = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("count")) for c in totals.columns))).alias("x"))
    parts += [wide.select(F.lit("ReadStatistics").alias("table"), "x.key", na.alias("assigned_name"), "x.count", na.alias("average_quality"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_count(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc("count"), key)


def listing(table: DataFrame, most: int = 20) -> str:
    """The most frequent barcodes of a table as text: sequence, name and count."""
    rows = by_count(table, "seq").limit(most).select("seq", "assigned", "count").collect()
    return "\n".join(f"{r['seq']}\t{r['assigned']}\t{r['count']}" for r in rows)


def orientation(table: DataFrame) -> DataFrame:
    """One row for a looked-up token: shares of assigned reads as given and reverse complemented, and of unassigned ones of all."""
    known = F.col("assigned") != "Un"
    counts = table.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(known, F.col("count"))), F.lit(0)).alias("assigned"), F.coalesce(F.sum(F.when(known & F.col("is_rc"), F.col("count"))), F.lit(0)).alias("rc"))
    share = lambda a, b: F.when(b > 0, 100.0 * a / b).otherwise(0.0)
    rc = share(F.col("rc"), F.col("assigned"))
    note = F.when(rc > 90, "reverse complement").when(rc > 10, "mixed").otherwise("")
    return counts.select(share(F.col("assigned") - F.col("rc"), F.col("assigned")).alias("pct_sense"), rc.alias("pct_rc"), share(F.col("total") - F.col("assigned"), F.col("total")).alias("pct_unassigned"), note.alias("note"))


def top_unassigned(tables: dict[str, DataFrame], most: int = 10) -> DataFrame:
    """The most frequent sequences without a name, of each token."""
    out = None
    for name, df in tables.items():
        own = df.where("assigned = 'Un'").orderBy(F.desc("count"), "seq").limit(most).select(F.lit(name).alias("token"), "seq", "count")
        out = own if out is None else out.unionByName(own)
    place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("count"), "seq"))
    return out.withColumn("place", place)
