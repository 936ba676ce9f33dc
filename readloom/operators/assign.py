"""Assigning barcode names to token sequences.

Names are found for distinct sequences and joined back. Looking up goes in three steps:
literally, through ambiguity codes, and with up to m mismatches. The last two meet by
equality: among m + 1 blocks of a barcode at least one has no mismatch, so the blocks'
plain expansions are joined and only those pairs are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import iupac
from readloom.operators.storage import ranked, stored
from readloom.plans.design import Token
from readloom.sources.lookup import Entry

UNKNOWN = "Un"
CHUNK = 500_000
#: Rows of the lookup side up to which it is broadcast; it is counted on the driver.
MOST_BROADCAST = 50_000
#: Plain sequences that a block with ambiguity codes may stand for; beyond, such entries are compared with every sequence.
MOST_EXPANDED = 1_024
#: Reads from which a sequence is popular: its name is broadcast even where those of all cannot be.
POPULAR = 100_000


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def match(sequences: DataFrame, table: dict[str, Entry], mismatches: int = 0) -> DataFrame:
    """seq, assigned, is_rc, distance for the distinct ``seq`` that have a name.

    Ties: an exact match, then one without mismatches, then fewest mismatches; then name, then sequence.
    """
    spark = sequences.sparkSession
    m = max(0, mismatches)
    rows, blocks, wild = [], [], []
    for seq, e in sorted(table.items()):
        rows.append((seq, e.name, e.is_rc))
        n = len(seq)
        cuts = [round(i * n / (m + 1)) for i in range(m + 2)]
        parts = [(b, cuts[b], cuts[b + 1] - cuts[b]) for b in range(m + 1) if cuts[b + 1] > cuts[b]]
        grown = [(b, at, k, iupac.expansions(seq[at : at + k], MOST_EXPANDED)) for b, at, k in parts]
        classes = [iupac.BASES[c] for c in seq]
        if len(parts) <= m or any(x is None for *_, x in grown):
            wild.append((n, seq, e.name, e.is_rc, classes))  # too short or too open to be cut into blocks
            continue
        blocks += [(n, b, at, k, x, seq, e.name, e.is_rc, classes) for b, at, k, found in grown for x in found]
    plain = spark.createDataFrame(rows, "lseq string, name string, is_rc boolean")
    exact = sequences.where(~F.col("seq").contains("N")).join(_hinted(plain, len(rows)), F.col("seq") == F.col("lseq")).select("seq", F.lit(0).alias("tier"), F.lit(0).alias("distance"), "name", "lseq", "is_rc")
    width_of = {len(s) for s in table}
    found = exact

    def compared(candidates: DataFrame) -> DataFrame:
        distance = F.lit(None).cast("int")
        for n in sorted(width_of):
            distance = F.when(F.length("seq") == n, iupac.mismatches(F.col("seq"), F.col("classes"), n)).otherwise(distance)
        return candidates.withColumn("distance", distance).where(F.col("distance") <= m).select("seq", F.when(F.col("distance") == 0, 1).otherwise(2).alias("tier"), "distance", "name", "lseq", "is_rc")

    if blocks:
        right = spark.createDataFrame(blocks, "n int, block int, at int, k int, part string, lseq string, name string, is_rc boolean, classes array<string>")
        shapes = sorted({(n, b, at, k) for n, b, at, k, *_ in blocks})
        cut = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(b).alias("block"), F.substring("seq", at + 1, k).alias("part")) for n, b, at, k in shapes)), lambda x: x["n"] == F.length("seq"))
        left = sequences.select("seq", F.explode(cut).alias("c")).select("seq", "c.n", "c.block", "c.part")
        found = found.unionByName(compared(left.join(_hinted(right.drop("at", "k"), len(blocks)), ["n", "block", "part"])))
    if wild:
        right = spark.createDataFrame(wild, "n int, lseq string, name string, is_rc boolean, classes array<string>")
        found = found.unionByName(compared(sequences.withColumn("n", F.length("seq")).join(_hinted(right, len(wild)), "n")))
    best = found.groupBy("seq").agg(F.min(F.struct("tier", "distance", "name", "lseq", "is_rc")).alias("b"))
    name = F.when(F.col("b.tier") == 2, F.concat(F.lit("r"), F.col("b.name"))).otherwise(F.col("b.name"))
    return best.select("seq", name.alias("assigned"), F.col("b.is_rc").alias("is_rc"), F.col("b.distance").alias("distance"))


def ids(sequences: DataFrame, prefix: str = "ID") -> DataFrame:
    """seq, assigned, reads: ID1, ID2, ... for (chunk, seq) rows, in order of the first chunk and the sequence."""
    first = sequences.groupBy("seq").agg(F.min("chunk").alias("chunk"), F.count("*").alias("reads"))
    return ranked(first, ["chunk", "seq"], "k").select("seq", F.concat(F.lit(prefix), F.col("k").cast("string")).alias("assigned"), "reads")


def or_unknown(sequence: Column) -> Column:
    """The sequence itself, or ``Un`` where there is none."""
    return F.coalesce(F.nullif(sequence, F.lit("")), F.lit(UNKNOWN))


def assign(df: DataFrame, token: Token, table: dict[str, Entry] | None = None, mismatches: int = 0, umi_as_sequence: bool = False) -> DataFrame:
    """Adds ``<token>_id`` (and, for a looked-up token, ``<token>_rc``)."""
    column, kind = token.column, token.segment.kind
    if kind == "S" or (kind == "I" and umi_as_sequence):
        return df.withColumn(f"{column}_id", or_unknown(F.col(column)))
    some = F.coalesce(F.col(column), F.lit("")) != ""
    if kind == "I":
        named = ids(df.where(some).select(F.col(column).alias("seq"), F.expr(f"rec div {CHUNK}").alias("chunk")))
        extra: list[str] = []
    else:
        # Stored: each step of the lookup would otherwise scan the reads again.
        seen = stored(df.where(some).groupBy(F.col(column).alias("seq")).agg(F.count("*").alias("reads")), "sequences")
        named = match(seen.select("seq"), table or {}, mismatches).drop("distance").join(seen, "seq")
        extra = ["is_rc"]
    return _back(df, column, stored(named, "names"), extra)


def _back(df: DataFrame, column: str, named: DataFrame, extra: list[str]) -> DataFrame:
    """Names to reads. Only sequences with a name are in ``named``. Few of them are broadcast, so that reads need no shuffle.

    Beyond, only names of popular sequences are; reads that need no other name get a key of their
    own for the join, so that neither missing tokens nor popular ones meet in one task.
    """
    names = {"assigned": f"{column}_id", "is_rc": f"{column}_rc"}
    added = [names[c] for c in ("assigned", *extra)]
    own = lambda n, to: n.select(F.col("seq").alias(to), *(F.col(c).alias(names[c]) for c in ("assigned", *extra)))
    if named.count() <= MOST_BROADCAST:
        joined = df.join(F.broadcast(own(named, column)), column, "left")
    else:
        popular = named.where(F.col("reads") >= POPULAR)  # at most one for so many reads
        popular = popular if popular.count() <= MOST_BROADCAST else popular.limit(0)
        rest = own(named.join(F.broadcast(popular.select("seq")), "seq", "left_anti"), "_seq")
        first = df.join(F.broadcast(own(popular, column)), column, "left")
        done = F.col(added[0]).isNotNull() | (F.coalesce(F.col(column), F.lit("")) == "")
        first = first.withColumn("_key", F.when(done, F.concat(F.lit("#"), F.col("rec").cast("string"))).otherwise(F.col(column)))
        second = first.withColumnsRenamed({c: f"_{c}" for c in added}).join(rest, F.col("_key") == F.col("_seq"), "left")
        joined = second.withColumns({c: F.coalesce(f"_{c}", c) for c in added})
    return joined.withColumn(added[0], F.coalesce(added[0], F.lit(UNKNOWN))).select(*df.columns, *added)


def annotated_name(name: Column, id_columns: list[str]) -> Column:
    """The name with all ids; a bare underscore where a run has no tokens."""
    return F.concat(name, F.lit("_"), F.concat_ws("_", *id_columns) if id_columns else F.lit(""))

