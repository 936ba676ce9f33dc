"""One query for each operator, over reads made from the tables, and the same rows in DuckDB's SQL.

The expressions that make reads are text that both engines understand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import dna_codec, iupac, quality
from readloom.operators import assign, dedup, route, stats, trim
from readloom.operators.align import align
from readloom.operators.storage import ranked, scratch_path, stored
from readloom.operators.tokens import slice_tokens
from readloom.plans import check
from readloom.plans.demux import DemuxConfig, Result, demultiplex, header_index_columns
from readloom.plans.design import parse, tokens
from readloom.sources import fastq, lookup, sink

ADAPTER = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
DESIGN = "4X|GATC*GGTC|8L|6I"
PREFIX = "run"
#: Bases of the longest made read: tokens, insert and tail.
LONGEST = 22 + 24 + 33


def dna(salt: str, key: str) -> str:
    return f"translate(md5(concat('{salt}', cast({key} as string))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


_K = "o_orderkey"
_BC = f"substr({dna('bc', f'{_K} % 25')}, 1, 8)"
_BARCODE = f"CASE WHEN {_K} % 7 = 0 THEN concat('N', substr({_BC}, 2)) WHEN {_K} % 11 = 0 THEN translate(reverse({_BC}), 'ACGT', 'TGCA') WHEN {_K} % 13 = 0 THEN substr({dna('rnd', _K)}, 1, 8) ELSE {_BC} END"
_FIXED = f"CASE WHEN {_K} % 5 = 3 THEN 'GGTC' WHEN {_K} % 5 = 4 THEN 'CCCC' ELSE 'GATC' END"
_TAIL = f"CASE WHEN {_K} % 17 = 0 THEN 'GGGGGG' WHEN {_K} % 19 = 0 THEN '{ADAPTER[:12]}' WHEN {_K} % 2 = 0 THEN '{ADAPTER}' ELSE substr({dna('tail', f'{_K} % 3')}, 1, 20) END"
_INSERT = f"substr({dna('ins', 'o_custkey % 200')}, 1, CASE WHEN {_K} % 23 = 0 THEN 9 ELSE 24 END)"
_SEQ = f"concat('ACGT', {_FIXED}, {_BARCODE}, substr({dna('umi', f'{_K} % 500')}, 1, 6), {_INSERT}, {_TAIL})"
_INDEXES = f"concat(substr({dna('i1', f'{_K} % 40')}, 1, 8), '+', substr({dna('i2', f'{_K} % 30')}, 1, 8))"

#: Name and expression of each column of the made reads.
READS = {
    "rec": _K,
    "name": f"concat('@rd', cast({_K} as string))",
    "comment": f"CASE WHEN {_K} % 3 = 0 THEN '' ELSE concat('1:N:0:', {_INDEXES}) END",
    "seq": _SEQ,
    "qual": f"substr(repeat(translate(md5(concat('q', cast({_K} as string))), '0123456789abcdef', '#+5:?ADFGHIIIIII'), 3), 1, cast(length({_SEQ}) as int))",
    "seq2": f"concat(substr({dna('ins2', 'o_custkey % 200')}, 1, 30), substr({dna('r2', f'{_K} % 4')}, 1, 4))",
}


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, as reads come from files in a real run: plans then start at a scan, with its columns pruned."""
    return stored(_made(spark, sf_dir), "reads")


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One file of keys becomes as many parts as a run with many read files would have.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").repartition(parts)
    return keys.selectExpr(*(f"{e} AS {n}" for n, e in READS.items()))


def read1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("rec", "name", "comment", F.lit(1).alias("mate"), "seq", F.lit("+").alias("plus"), "qual")


def read2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("rec", "name", F.lit("").alias("comment"), F.lit(2).alias("mate"), F.col("seq2").alias("seq"), F.lit("+").alias("plus"), F.repeat(F.lit("I"), F.length("seq2")).alias("qual"))


def lookup_text(spark: SparkSession, sf_dir: str, third: str = "SR|any") -> str:
    """A lookup table of the nations; the fourth has an ambiguity code."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS k", f"substr({dna('bc', 'n_nationkey')}, 1, 8) AS s").orderBy("k").collect()
    return "\n".join(f"BC{r['k']}\t{r['s'][:3] + 'N' + r['s'][4:] if r['k'] == 3 else r['s']}\t{third}" for r in rows)


def config(spark: SparkSession, sf_dir: str, **more) -> DemuxConfig:
    base = {"bc_read1": DESIGN, "lookup": lookup_text(spark, sf_dir), "max_mismatches": 1, "trim_barcodes": True, "umi_as_sequence": True, "reject_fixed": True, "deduplicate": True, "adapter_r1": ADAPTER, "split_on": "bcRead1-t3", "prefix": PREFIX}
    return DemuxConfig(**base | more)


def run(spark: SparkSession, sf_dir: str, **more) -> Result:
    return demultiplex(align(read1(spark, sf_dir)), config(spark, sf_dir, **more), keep=False)


def _sliced(spark: SparkSession, sf_dir: str, cut: bool = False) -> DataFrame:
    return slice_tokens(align(read1(spark, sf_dir)), {"bcRead1": parse(DESIGN)}, trim=cut)


def _barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir).select(F.col("r1_t3").alias("seq")).distinct()


def _table(spark: SparkSession, sf_dir: str, third: str = "SR|any") -> dict:
    designs = {"bcRead1": parse(DESIGN)}
    return lookup.by_token(lookup.parse(lookup_text(spark, sf_dir, third)), designs)[tokens(designs)[1]]


def synth_reads(spark, sf_dir):
    return reads(spark, sf_dir).select("rec", "name", "comment", "seq", "qual")


def token_slice(spark, sf_dir):
    return _sliced(spark, sf_dir).select("rec", F.col("r1_t2").alias("fixed"), F.col("r1_t3").alias("barcode"), F.col("r1_t4").alias("umi"), F.col("r1_t3_qual").alias("barcode_qual"))


def token_trim(spark, sf_dir):
    return _sliced(spark, sf_dir, cut=True).select("rec", F.col("r1_seq").alias("seq"), F.col("r1_qual").alias("qual"))


def fixed_barcode_reject(spark, sf_dir):
    return _sliced(spark, sf_dir).select("rec", "rejected")


def _with_header_indexes(spark, sf_dir):
    """Reads without a comment have the indexes in their names."""
    wide = align(read1(spark, sf_dir))
    return wide.withColumn("name", F.when(F.col("r1_comment") == "", F.concat("name", F.lit(":0_ACGTACGT+TTGCAACT"))).otherwise(F.col("name")))


def header_index_extract(spark, sf_dir):
    found = header_index_columns(_with_header_indexes(spark, sf_dir), DemuxConfig(bc_index1="8I", bc_index2="8I", indexes_in_header=True))
    return found.select("rec", "name", F.col("i1_seq").alias("index1"), F.col("i2_seq").alias("index2"), F.col("i1_qual").alias("quality1"))


_LINES = f"CASE {_K} % 5 WHEN 0 THEN concat('@r', cast({_K} as string), ' 1:N:0:AC') WHEN 1 THEN concat('@r', cast({_K} as string), ' 2:Y:18:') WHEN 2 THEN concat('@r', cast({_K} as string), '/2') WHEN 3 THEN concat('@r', cast({_K} as string), '/1 x y') ELSE concat('@SRR.', cast({_K} as string), ' 1 length=50') END"


def name_normalise(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{_K} AS rec", f"{_LINES} AS line")
    return lines.select("rec", *fastq.name_parts(F.col("line")))


def reverse_complement(spark, sf_dir):
    iupac.register(spark)
    return reads(spark, sf_dir).select("rec", iupac.reverse_complement_col(F.col("seq")).alias("rc"), F.expr("is_dna(seq)").alias("valid"), F.expr("hamming_distance(substr(seq, 1, 8), substr(seq, 9, 8))").cast("long").alias("distance"))


def lookup_orientation(spark, sf_dir):
    return spark.createDataFrame([(s, e.name, e.is_rc) for s, e in _table(spark, sf_dir).items()], "seq string, name string, is_rc boolean")


def _matched(spark, sf_dir, m, third="SR|any"):
    return assign.match(_barcodes(spark, sf_dir), _table(spark, sf_dir, third), m).select("seq", "assigned", "is_rc", F.col("distance").cast("long").alias("distance"))


def lookup_exact(spark, sf_dir):
    table = {s: e for s, e in _table(spark, sf_dir).items() if set(s) <= set("ACGT")}
    return assign.match(_barcodes(spark, sf_dir), table, 0).select("seq", "assigned")


def lookup_iupac(spark, sf_dir):
    return _matched(spark, sf_dir, 0)


def lookup_mismatch(spark, sf_dir):
    return _matched(spark, sf_dir, 2)


def lookup_scoped(spark, sf_dir):
    text = lookup_text(spark, sf_dir, "S|bcRead1-t3").split("\n")
    text = [x.replace("bcRead1-t3", "bcIndex1-t1") if i % 2 else x for i, x in enumerate(text)]
    designs = {"bcIndex1": parse("8L"), "bcRead1": parse(DESIGN)}
    table = lookup.by_token(lookup.parse("\n".join(text)), designs)[tokens(designs)[2]]
    return assign.match(_barcodes(spark, sf_dir), table, 0).select("seq", "assigned")


def lookup_min_distance(spark, sf_dir):
    found = lookup.smallest_distance(_table(spark, sf_dir))
    return spark.createDataFrame([(found[0],)], "distance long")


def paired_align(spark, sf_dir):
    wide = align(read1(spark, sf_dir), read2(spark, sf_dir))
    return wide.select("rec", "name", "r1_seq", "r2_seq", F.col("r2_mate").cast("long").alias("mate"))


def _index(spark, sf_dir):
    kept = reads(spark, sf_dir).where("rec % 4 <> 0")
    one = kept.select("rec", "name", F.expr("substr(seq, 9, 8)").alias("seq"), F.repeat(F.lit("I"), F.lit(8)).alias("qual"))
    again = kept.where("rec % 8 = 1").select((F.col("rec") + 10_000_000).alias("rec"), "name", F.lit("ACGTACGT").alias("seq"), F.lit("IIIIIIII").alias("qual"))
    return one.unionByName(again)


def index_left_join(spark, sf_dir):
    return align(read1(spark, sf_dir), index1=_index(spark, sf_dir), strict=False).select("rec", "name", F.col("i1_seq").alias("index1"))


def umi_as_sequence(spark, sf_dir):
    t = tokens({"bcRead1": parse(DESIGN)})[2]
    return assign.assign(_sliced(spark, sf_dir), t, umi_as_sequence=True).select("rec", F.col("r1_t4_id").alias("umi"))


def umi_ids(spark, sf_dir):
    t = tokens({"bcRead1": parse(DESIGN)})[2]
    return assign.assign(_sliced(spark, sf_dir), t).select("rec", F.col("r1_t4_id").alias("umi"))


def header_annotate(spark, sf_dir):
    return run(spark, sf_dir).processed.select("rec", "name_out")


def fastq_record(spark, sf_dir):
    return run(spark, sf_dir).records().select("rec", "text")


def dedup_flag(spark, sf_dir):
    return run(spark, sf_dir).processed.select("rec", "duplicate")


def dedup_case_invalid(spark, sf_dir):
    odd = F.when(F.col("rec") % 3 == 0, F.lower("seq2")).when(F.col("rec") % 5 == 0, F.concat("seq2", F.lit("R"))).otherwise(F.col("seq2"))
    return dedup.flag_duplicates(reads(spark, sf_dir).select("rec", odd.alias("s")), ["s"]).select("rec", "duplicate")


def adapter_trim(spark, sf_dir):
    found = trim.with_overlap(reads(spark, sf_dir), "seq", ADAPTER, "found").where("found is not null")
    return found.select("rec", F.col("found.offset").cast("long").alias("offset"), F.col("found.diff").cast("long").alias("diff"), F.col("found.length").cast("long").alias("length"), trim.keep_length(F.col("seq"), F.col("found")).cast("long").alias("keep"))


def quality_trim(spark, sf_dir):
    s, q = trim.quality_trim(F.col("seq"), F.col("qual"), 30)
    return reads(spark, sf_dir).select("rec", s.alias("seq"), q.alias("qual"))


def polyg_trim(spark, sf_dir):
    s, q = trim.poly_g_trim(F.col("seq"), F.col("qual"), 5)
    return reads(spark, sf_dir).select("rec", s.alias("seq"), q.alias("qual"))


def trim_pipeline(spark, sf_dir):
    return run(spark, sf_dir).processed.select("rec", F.col("r1_seq").alias("seq"), F.col("r1_qual").alias("qual"))


def length_filter(spark, sf_dir):
    return run(spark, sf_dir).written().select("rec")


def route_destination(spark, sf_dir):
    return run(spark, sf_dir).processed.select("rec", "destination")


def route_global_rejected(spark, sf_dir):
    return run(spark, sf_dir, global_rejected=True).records().select("rec", "file")


def output_filename(spark, sf_dir):
    return run(spark, sf_dir).records().select("rec", "file")


def barcode_table(spark, sf_dir):
    t = run(spark, sf_dir).barcodes()["Read_Sequence_2"]
    return t.select("seq", "assigned", "count", F.concat_ws(",", F.transform("average_quality", lambda x: x.cast("string"))).alias("average_quality"))


def avg_quality(spark, sf_dir):
    means = reads(spark, sf_dir).groupBy((F.col("rec") % 10).alias("part")).agg(quality.mean_scores(F.col("qual"), LONGEST).alias("m"))
    return means.select("part", F.posexplode("m").alias("position", "mean")).select("part", F.col("position").cast("long").alias("position"), "mean")


def combinations(spark, sf_dir):
    return run(spark, sf_dir).tables()["Combinations"]


def read_lengths(spark, sf_dir):
    return run(spark, sf_dir).tables()["Read1Length"]


def read_statistics(spark, sf_dir):
    return run(spark, sf_dir).tables()["ReadStatistics"]


def stats_long(spark, sf_dir):
    return demultiplex(align(read1(spark, sf_dir)), config(spark, sf_dir)).statistics()


def orientation_diagnostics(spark, sf_dir):
    return run(spark, sf_dir).diagnostics()["orientation_r1_t3"]


def top_unassigned(spark, sf_dir):
    return run(spark, sf_dir).diagnostics()["top_unassigned"].select("token", "seq", "count", F.col("place").cast("long").alias("place"))


def design_layout(spark, sf_dir):
    return check.layout(spark, {"bcRead1": parse(DESIGN)})


def flagship_demux(spark, sf_dir):
    """The whole run: file and record of every written read."""
    return run(spark, sf_dir).records()


def sorted_barcodes(spark, sf_dir):
    """Barcodes by falling count, ties by sequence, with their place."""
    t = run(spark, sf_dir).barcodes()["Read_Sequence_2"].select("seq", "count")
    return stats.by_count(t, "seq")


def _written(spark, sf_dir):
    """The made reads as gzip FASTQ files, in order, several tasks and files."""
    folder = scratch_path(spark, "fastq")
    wide = align(read1(spark, sf_dir))
    text = route.record(F.col("name"), F.col("r1_comment"), F.col("r1_mate"), F.col("r1_seq"), F.col("r1_plus"), F.col("r1_qual"))
    sorted_ = wide.select("rec", text.alias("value")).repartitionByRange(4, "rec").sortWithinPartitions("rec")
    sorted_.select("value").write.option("compression", "gzip").option("lineSep", "\n").text(folder)
    return folder


def fastq_scan(spark, sf_dir):
    """Several gzip files written and scanned: place of each record over all files, and its parts."""
    scanned = fastq.read(spark, _written(spark, sf_dir))
    return ranked(scanned, ["rec"], "place").select("place", "name", "comment", F.col("mate").cast("long").alias("mate"), "seq", "plus", "qual")


def fastq_roundtrip(spark, sf_dir):
    """A run written to gzip files and read back: the records of every file in their order."""
    paths = sink.write_fastq(run(spark, sf_dir).records(), scratch_path(spark, "written"))
    names = spark.createDataFrame([(i, p.rsplit("/", 1)[-1]) for i, p in enumerate(paths)], "number long, file string")
    back = fastq.read(spark, ",".join(paths)).withColumn("number", F.shiftright("rec", fastq.FILE_SHIFT))
    place = F.col("rec").bitwiseAND((1 << fastq.FILE_SHIFT) - 1) + 1
    text = F.concat_ws("\n", F.concat_ws(" ", "name", "comment"), "seq", "plus", "qual")
    return back.join(F.broadcast(names), "number").select("file", place.alias("place"), text.alias("text"))


def _index_file(spark, sf_dir, salt, of, n):
    return reads(spark, sf_dir).select("rec", "name", F.lit("").alias("comment"), F.lit(1).alias("mate"), F.expr(f"substr({dna(salt, f'rec % {of}')}, 1, {n})").alias("seq"), F.lit("+").alias("plus"), F.repeat(F.lit("I"), F.lit(n)).alias("qual"))


def index_pair(spark, sf_dir):
    """Two index files by position, to reads by name."""
    wide = align(read1(spark, sf_dir), index1=_index_file(spark, sf_dir, "i1", 40, 8), index2=_index_file(spark, sf_dir, "i2", 30, 10))
    return wide.select("rec", F.col("i1_seq").alias("index1"), F.col("i2_seq").alias("index2"))


def index_files_run(spark, sf_dir):
    """A run with two index files: their tokens come first in names and tags."""
    wide = align(read1(spark, sf_dir), index1=_index_file(spark, sf_dir, "i1", 40, 8), index2=_index_file(spark, sf_dir, "i2", 30, 10))
    more = {"bc_index1": "8I", "bc_index2": "4X|6I", "split_on": "bcRead1-t3|bcIndex2-t2", "deduplicate": False, "adapter_r1": ""}
    return demultiplex(wide, config(spark, sf_dir, **more), keep=False).records()


def header_run(spark, sf_dir):
    """A run with the indexes in the headers."""
    more = {"bc_index1": "8I", "bc_index2": "2X|6I", "indexes_in_header": True, "deduplicate": False, "adapter_r1": ""}
    return demultiplex(_with_header_indexes(spark, sf_dir), config(spark, sf_dir, **more), keep=False).records()


def paired_run(spark, sf_dir):
    """A run of pairs with tokens in both mates; copies are told by all tokens and both mates."""
    more = {"bc_read2": "6I|4X", "adapter_r1": "", "split_on": "bcRead2-t1|bcRead1-t3"}
    return demultiplex(align(read1(spark, sf_dir), read2(spark, sf_dir)), config(spark, sf_dir, **more), keep=False).records()


def untrimmed_run(spark, sf_dir):
    """Barcodes stay in the reads: adapters, qualities and copies are taken on whole reads."""
    return run(spark, sf_dir, trim_barcodes=False, reject_fixed=False).records()


def index_length(spark, sf_dir):
    """Indexes have to be exactly as long as their design; each slice of them."""
    wide = align(read1(spark, sf_dir), index1=_index_file(spark, sf_dir, "i1", 40, 12))
    cut = slice_tokens(wide, {"bcIndex1": parse("3L|2X|NNNN*ACGT|3I")})
    return cut.select("rec", F.col("i1_t1").alias("first"), F.col("i1_t3").alias("fixed"), F.col("i1_t4").alias("last"), "rejected")


def design_preview(spark, sf_dir):
    """The dry run's lines for the first records."""
    cfg = DemuxConfig(bc_read1=DESIGN, lookup=lookup_text(spark, sf_dir))
    lines = check.check_design(cfg, {"r1": read1(spark, sf_dir)}).split("\n")
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line long, said string")


def packed_keys(spark, sf_dir):
    """Sequences packed and unpacked: case is folded, nothing else changes."""
    pack = F.udf(lambda x: dna_codec.encode(x).hex())  # a plain function of the library, called for each distinct sequence
    unpack = F.udf(lambda x: dna_codec.decode(bytes.fromhex(x)))
    seen = reads(spark, sf_dir).select(F.when(F.col("rec") % 3 == 0, F.lower("seq2")).otherwise(F.col("seq2")).alias("seq")).distinct()
    return seen.withColumn("packed", pack("seq")).select("seq", (F.length("packed") / 2).cast("long").alias("n_bytes"), unpack("packed").alias("unpacked"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        flagship_demux, synth_reads, token_slice, token_trim, fixed_barcode_reject, header_index_extract, name_normalise, reverse_complement, lookup_orientation, lookup_exact, lookup_iupac, lookup_mismatch, lookup_scoped, lookup_min_distance,
        paired_align, index_left_join, umi_as_sequence, umi_ids, header_annotate, fastq_record, dedup_flag, dedup_case_invalid, adapter_trim, quality_trim, polyg_trim, trim_pipeline, length_filter, route_destination, route_global_rejected,
        output_filename, fastq_scan, fastq_roundtrip, index_pair, index_files_run, header_run, paired_run, untrimmed_run, index_length, design_preview, packed_keys, barcode_table, avg_quality, combinations, read_lengths, read_statistics, stats_long, orientation_diagnostics, top_unassigned, design_layout, sorted_barcodes,
    )
}


def _overlaps(source: str, seq: str) -> str:
    """Best overlap of the adapter in each row of ``source`` (rec, seq): by differences, then pass, then offset."""
    n, m = f"length({seq})", len(ADAPTER)
    return f"""(SELECT rec, o AS offs, diff, ln FROM (
  SELECT *, row_number() OVER (PARTITION BY rec ORDER BY diff, CASE WHEN o < 0 THEN 1 ELSE 0 END, o) AS k FROM (
    SELECT rec, o, ln, CAST(list_sum([CASE WHEN substr(s, greatest(o, 0) + i, 1) <> substr('{ADAPTER}', greatest(-o, 0) + i, 1) AND substr(s, greatest(o, 0) + i, 1) <> 'N' THEN 1 ELSE 0 END for i in range(1, ln + 1)]) AS BIGINT) AS diff, n
    FROM (SELECT rec, {seq} AS s, {n} AS n, o, CASE WHEN o >= 0 THEN least({n} - o, {m}) ELSE least({n}, {m} + o) END AS ln
          FROM {source}, range(1 - {m}, 120) x(o) WHERE {n} >= 15 AND (o < 0 OR o <= {n} - 15))
    WHERE ln >= 15 OR (o >= 0 AND o + ln >= n))
  WHERE ln > 0 AND diff <= least(2, CAST(floor(ln * 0.1) AS BIGINT)))
WHERE k = 1)"""


def _chain(m: int = 1, global_rejected: bool = False) -> str:
    """Every step of a run as a common table expression; only those that a query needs are evaluated."""
    select = ", ".join(f"{e} AS {n}" for n, e in READS.items())
    cls = "CASE WHEN substr(lseq, i, 1) = 'N' THEN 'ACGT' ELSE substr(lseq, i, 1) END"
    dest = "CASE " + ("WHEN rejected THEN 'Rejected' " if global_rejected else "") + "WHEN duplicate THEN 'Duplicate' WHEN rejected THEN 'Rejected' ELSE 'Main' END"
    tag = "CASE WHEN destination = 'Rejected' THEN '' ELSE '_' || bc END" if global_rejected else "'_' || bc"
    return f"""WITH r AS (SELECT {select} FROM orders),
base AS (SELECT n_nationkey AS k, substr({dna("bc", "n_nationkey")}, 1, 8) AS s FROM nation),
lrow AS (SELECT k, CASE WHEN k = 3 THEN concat(substr(s, 1, 3), 'N', substr(s, 5)) ELSE s END AS s FROM base),
lall AS (SELECT s AS lseq, concat('BC', CAST(k AS STRING)) AS name, false AS is_rc, 2 * k AS ord FROM lrow UNION ALL SELECT translate(reverse(s), 'ACGT', 'TGCA'), concat('BC', CAST(k AS STRING)), true, 2 * k + 1 FROM lrow),
l AS (SELECT lseq, arg_max(name, ord) AS name, bool_and(is_rc) AS is_rc FROM lall GROUP BY lseq),
t AS (SELECT *, substr(seq, 5, 4) AS fixed, substr(seq, 9, 8) AS barcode, substr(seq, 17, 6) AS umi, substr(seq, 23) AS rest, substr(qual, 23) AS restq, substr(seq, 5, 4) NOT IN ('GATC', 'GGTC') AS rejected FROM r),
b AS (SELECT DISTINCT barcode AS seq FROM t),
cand AS (SELECT b.seq, l.*, CASE WHEN b.seq = lseq AND NOT contains(b.seq, 'N') THEN 0 ELSE NULL END AS lit, CAST(list_sum([CASE WHEN strpos({cls}, substr(b.seq, i, 1)) > 0 THEN 0 ELSE 1 END for i in range(1, 9)]) AS BIGINT) AS d FROM b, l),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN lit = 0 THEN 0 WHEN d = 0 THEN 1 ELSE 2 END, d, name, lseq) AS k FROM cand WHERE lit = 0 OR d <= {m}) WHERE k = 1),
named AS (SELECT seq, CASE WHEN lit = 0 OR d = 0 THEN name ELSE 'r' || name END AS assigned, is_rc, CASE WHEN lit = 0 THEN 0 ELSE d END AS distance FROM best),
a AS (SELECT t.*, coalesce(assigned, 'Un') AS bc, is_rc FROM t LEFT JOIN named ON t.barcode = named.seq),
d AS (SELECT *, regexp_matches(key, '^[ACGTN]*$') AND row_number() OVER (PARTITION BY key ORDER BY rec) > 1 AS duplicate FROM (SELECT *, upper(concat(fixed, barcode, umi, rest)) AS key FROM a)),
ov AS {_overlaps("t", "rest")},
tr1 AS (SELECT d.*, CASE WHEN offs IS NULL THEN length(rest) WHEN offs >= 0 THEN offs ELSE greatest(length(rest) + offs, 0) END AS keep FROM d LEFT JOIN ov USING (rec)),
tr2 AS (SELECT *, regexp_replace(substr(restq, 1, keep), '[!-4]+$', '') AS q2, substr(rest, 1, keep) AS s1 FROM tr1),
tr3 AS (SELECT *, regexp_replace(substr(s1, 1, length(q2)), 'G{{5,}}$', '') AS s3 FROM tr2),
p AS (SELECT *, s3 AS r1_seq, substr(q2, 1, length(s3)) AS r1_qual, concat(name, '_', fixed, '_', bc, '_', umi) AS name_out, {dest} AS destination FROM tr3),
w AS (SELECT *, '{PREFIX}' || {tag} || '_R1_' || CASE destination WHEN 'Main' THEN 'demultiplexed' WHEN 'Duplicate' THEN 'duplicated' ELSE 'rejected' END || '.fastq.gz' AS file,
        concat(name_out, ' ', CASE WHEN comment = '' THEN '1:N:0:0' ELSE comment END, chr(10), r1_seq, chr(10), '+', chr(10), r1_qual) AS text FROM p WHERE length(r1_seq) >= 22)
"""


def _mean_list(quality_column: str, width: int) -> str:
    parts = ", ".join(f"CAST(CAST(sum(least(greatest(ascii(substr({quality_column}, {i}, 1)) - 33, 0), 93)) AS BIGINT) // count(*) AS STRING)" for i in range(1, width + 1))
    return f"concat_ws(',', {parts})"


def _table_sql(expression: str, start: int, width: int, name: str, assigned: str) -> str:
    return f"SELECT {name} AS \"table\", {expression} AS key, {assigned} AS assigned_name, count(*) AS count, {_mean_list(f'substr(qual, {start}, {width})', width)} AS average_quality FROM a GROUP BY {expression}, {assigned}"


def _oracles() -> dict[str, str]:
    c = _chain()
    barcode = f"SELECT barcode AS seq, bc AS assigned, count(*) AS count, {_mean_list('substr(qual, 9, 8)', 8)} AS average_quality FROM a GROUP BY barcode, bc"
    totals = "SELECT count(*) AS TotalReads, count(*) FILTER (length(r1_seq) >= 22) AS TotalWritten, count(*) FILTER (length(r1_seq) >= 22 AND destination = 'Main') AS UniqueReads, count(*) FILTER (length(r1_seq) >= 22 AND destination = 'Duplicate') AS DuplicateReads, count(*) FILTER (length(r1_seq) >= 22 AND destination = 'Rejected') AS RejectedReads FROM p"
    name5 = "concat('@r', cast(rec as string))"
    out = {
        "flagship_demux": c + "SELECT file, rec, text FROM w",
        "synth_reads": c + "SELECT rec, name, comment, seq, qual FROM r",
        "token_slice": c + "SELECT rec, fixed, barcode, umi, substr(qual, 9, 8) AS barcode_qual FROM t",
        "token_trim": c + "SELECT rec, rest AS seq, restq AS qual FROM t",
        "fixed_barcode_reject": c + "SELECT rec, NOT regexp_matches(fixed, '^(GATC|GGTC)$') AS rejected FROM t",
        "header_index_extract": c + ", h AS (SELECT rec, comment, CASE WHEN comment = '' THEN name || ':0_ACGTACGT+TTGCAACT' ELSE name END AS name FROM r) SELECT rec, CASE WHEN comment = '' THEN left(name, length(name) - 17) ELSE name END AS name, regexp_extract_all(CASE WHEN comment = '' THEN name ELSE comment END, '[ACGTN]{8}')[1] AS index1, regexp_extract_all(CASE WHEN comment = '' THEN name ELSE comment END, '[ACGTN]{8}')[2] AS index2, 'JJJJJJJJ' AS quality1 FROM h",
        "name_normalise": f"SELECT rec, CASE rec % 5 WHEN 4 THEN concat('@SRR.', cast(rec as string), ' 1 length=50') ELSE {name5} END AS name, CASE rec % 5 WHEN 0 THEN '1:N:0:AC' WHEN 1 THEN '2:Y:18:' WHEN 3 THEN 'x y' ELSE '' END AS comment, CASE WHEN rec % 5 IN (1, 2) THEN 2 ELSE 1 END AS mate FROM (SELECT o_orderkey AS rec FROM orders)",
        "reverse_complement": c + "SELECT rec, translate(reverse(seq), 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN') AS rc, regexp_matches(seq, '^[ACGTRYSWKMBDHVN]*$') AS valid, CAST(hamming(substr(seq, 1, 8), substr(seq, 9, 8)) AS BIGINT) AS distance FROM r",
        "lookup_orientation": c + "SELECT lseq AS seq, name, is_rc FROM l",
        "lookup_exact": c + "SELECT b.seq, name AS assigned FROM b JOIN l ON b.seq = lseq WHERE NOT contains(b.seq, 'N')",
        "lookup_iupac": _chain(0) + "SELECT seq, assigned, is_rc, distance FROM named",
        "lookup_mismatch": _chain(2) + "SELECT seq, assigned, is_rc, distance FROM named",
        "lookup_scoped": c + "SELECT b.seq, concat('BC', CAST(min(k) AS STRING)) AS assigned FROM b JOIN lrow ON regexp_matches(b.seq, '^' || replace(s, 'N', '[ACGT]') || '$') WHERE k % 2 = 0 GROUP BY b.seq",
        "lookup_min_distance": c + "SELECT CAST(min(hamming(x.lseq, y.lseq)) AS BIGINT) AS distance FROM l x JOIN l y ON x.lseq < y.lseq AND x.name <> y.name",
        "paired_align": c + "SELECT rec, name, seq AS r1_seq, seq2 AS r2_seq, CAST(2 AS BIGINT) AS mate FROM r",
        "index_left_join": c + "SELECT rec, name, CASE WHEN rec % 4 = 0 THEN NULL WHEN rec % 8 = 1 THEN 'ACGTACGT' ELSE substr(seq, 9, 8) END AS index1 FROM r",
        "umi_as_sequence": c + "SELECT rec, umi FROM t",
        "umi_ids": c + ", u AS (SELECT umi, row_number() OVER (ORDER BY min(rec // 500000), umi) AS k FROM t GROUP BY umi) SELECT rec, concat('ID', CAST(k AS STRING)) AS umi FROM t JOIN u USING (umi)",
        "header_annotate": c + "SELECT rec, concat(name, '_', fixed, '_', bc, '_', umi) AS name_out FROM a",
        "fastq_record": c + "SELECT rec, text FROM w",
        "dedup_flag": c + "SELECT rec, duplicate FROM d",
        "dedup_case_invalid": c + ", s AS (SELECT rec, upper(CASE WHEN rec % 3 = 0 THEN lower(seq2) WHEN rec % 5 = 0 THEN concat(seq2, 'R') ELSE seq2 END) AS s FROM r) SELECT rec, regexp_matches(s, '^[ACGTN]*$') AND row_number() OVER (PARTITION BY s ORDER BY rec) > 1 AS duplicate FROM s",
        "adapter_trim": c + f", o2 AS {_overlaps('r', 'seq')} SELECT rec, offs AS \"offset\", diff, ln AS length, CASE WHEN offs >= 0 THEN offs ELSE greatest(length(seq) + offs, 0) END AS keep FROM o2 JOIN r USING (rec)",
        "quality_trim": c + "SELECT rec, substr(seq, 1, length(q)) AS seq, q AS qual FROM (SELECT rec, seq, regexp_replace(qual, '[!->]+$', '') AS q FROM r)",
        "polyg_trim": c + "SELECT rec, s AS seq, substr(qual, 1, length(s)) AS qual FROM (SELECT rec, qual, regexp_replace(seq, 'G{5,}$', '') AS s FROM r)",
        "trim_pipeline": c + "SELECT rec, r1_seq AS seq, r1_qual AS qual FROM p",
        "length_filter": c + "SELECT rec FROM w",
        "route_destination": c + "SELECT rec, destination FROM p",
        "route_global_rejected": _chain(1, True) + "SELECT rec, file FROM w",
        "output_filename": c + "SELECT rec, file FROM w",
        "barcode_table": c + barcode,
        "avg_quality": c + f"SELECT rec % 10 AS part, CAST(i - 1 AS BIGINT) AS position, CAST(sum(least(greatest(ascii(substr(qual, i, 1)) - 33, 0), 93)) AS BIGINT) // count(*) AS mean FROM r, range(1, {LONGEST + 1}) x(i) GROUP BY rec % 10, i",
        "combinations": c + "SELECT concat(fixed, '_', bc, '_', umi) AS combination, count(*) AS count FROM w GROUP BY 1",
        "read_lengths": c + "SELECT CAST(length(r1_seq) AS STRING) AS length, count(*) AS count FROM w GROUP BY 1",
        "read_statistics": c + totals,
        "stats_long": c + f", tot AS ({totals}) "
        + " UNION ALL ".join(
            [
                _table_sql("fixed", 5, 4, "'Read_Sequence_1'", "fixed"),
                _table_sql("barcode", 9, 8, "'Read_Sequence_2'", "bc"),
                _table_sql("umi", 17, 6, "'Read_Sequence_3'", "umi"),
                "SELECT 'Combinations', concat(fixed, '_', bc, '_', umi), 'NA', count(*), 'NA' FROM w GROUP BY 2",
                "SELECT 'Read1Length', CAST(length(r1_seq) AS STRING), 'NA', count(*), 'NA' FROM w GROUP BY 2",
                *(f"SELECT 'ReadStatistics', '{k}', 'NA', {k}, 'NA' FROM tot" for k in ("TotalReads", "TotalWritten", "UniqueReads", "DuplicateReads", "RejectedReads")),
            ]
        ),
        "orientation_diagnostics": c + ", o AS (SELECT count(*) AS n, count(*) FILTER (bc <> 'Un') AS k, count(*) FILTER (bc <> 'Un' AND is_rc) AS rc FROM a) SELECT 100.0::DOUBLE * (k - rc) / k AS pct_sense, 100.0::DOUBLE * rc / k AS pct_rc, 100.0::DOUBLE * (n - k) / n AS pct_unassigned, CASE WHEN 100.0 * rc / k > 90 THEN 'reverse complement' WHEN 100.0 * rc / k > 10 THEN 'mixed' ELSE '' END AS note FROM o",
        "top_unassigned": c + ", u AS (SELECT barcode AS seq, count(*) AS count FROM a WHERE bc = 'Un' GROUP BY barcode), v AS (SELECT *, row_number() OVER (ORDER BY count DESC, seq) AS place FROM u) SELECT 'r1_t3' AS token, seq, count, place FROM v WHERE place <= 10",
        "design_layout": "SELECT * FROM (VALUES ('bcRead1', 1, 1, 4, 4, 'exclude', ''), ('bcRead1', 2, 5, 8, 4, 'fixed', 'GATC*GGTC'), ('bcRead1', 3, 9, 16, 8, 'lookup', ''), ('bcRead1', 4, 17, 22, 6, 'include', '')) v(design, token, first, last, width, kind, alternatives)",
        "sorted_barcodes": c + "SELECT barcode AS seq, count(*) AS count FROM a GROUP BY barcode ORDER BY count DESC, seq",
    }
    said = "CASE WHEN comment = '' THEN '1:N:0:0' ELSE comment END"
    out |= {
        "fastq_scan": c + f"SELECT row_number() OVER (ORDER BY rec) AS place, name, {said} AS comment, CAST(1 AS BIGINT) AS mate, seq, '+' AS plus, qual FROM r",
        "fastq_roundtrip": c + "SELECT file, row_number() OVER (PARTITION BY file ORDER BY rec) AS place, text FROM w",
        "index_pair": c + f"SELECT rec, {_index_sql('i1', 40, 8)} AS index1, {_index_sql('i2', 30, 10)} AS index2 FROM r",
        "index_length": c + f", i AS (SELECT rec, {_index_sql('i1', 40, 12)} AS s FROM r) SELECT rec, substr(s, 1, 3) AS first, substr(s, 6, 4) AS fixed, substr(s, 10, 3) AS last, false AS rejected FROM i",
        "index_files_run": c + _plain_run(f"{_index_sql('i1', 40, 8)}", f"substr({_index_sql('i2', 30, 10)}, 5, 6)", "name", "concat(i2, '_', bc)"),
        "header_run": c + _plain_run(f"regexp_extract_all({_HEADER}, '[ACGTN]{{8}}')[1]", f"substr(regexp_extract_all({_HEADER}, '[ACGTN]{{8}}')[2], 3, 6)", "CASE WHEN comment = '' THEN name || ':0_' ELSE name END", "bc"),
        "paired_run": c + """, pk AS (SELECT *, substr(seq2, 1, 6) AS umi2, substr(seq2, 11) AS rest2, upper(concat(fixed, barcode, umi, substr(seq2, 1, 6), rest, substr(seq2, 11))) AS key2 FROM a),
pd AS (SELECT *, regexp_matches(key2, '^[ACGTN]*$') AND row_number() OVER (PARTITION BY key2 ORDER BY rec) > 1 AS duplicate FROM pk),
pm AS (SELECT rec, 1 AS mate, rest AS s, restq AS q, CASE WHEN comment = '' THEN '1:N:0:0' ELSE comment END AS said, * EXCLUDE (rec) FROM pd UNION ALL SELECT rec, 2, rest2, repeat('I', CAST(length(rest2) AS INT)), '2:N:0:0', * EXCLUDE (rec) FROM pd)
SELECT concat('run_', umi2, '_', bc, '_R', CAST(mate AS STRING), '_', CASE WHEN duplicate THEN 'duplicated' WHEN rejected THEN 'rejected' ELSE 'demultiplexed' END, '.fastq.gz') AS file, rec,
       concat(name, '_', fixed, '_', bc, '_', umi, '_', umi2, ' ', said, chr(10), s, chr(10), '+', chr(10), q) AS text FROM pm WHERE length(rest) >= 22 AND length(rest2) >= 22""",
        "untrimmed_run": c + f""", ud AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rec) > 1 AND regexp_matches(key, '^[ACGTN]*$') AS duplicate FROM (SELECT *, upper(concat(fixed, barcode, umi, seq)) AS key FROM a)),
uo AS {_overlaps("t", "seq")},
u1 AS (SELECT ud.*, CASE WHEN offs IS NULL THEN length(seq) WHEN offs >= 0 THEN offs ELSE greatest(length(seq) + offs, 0) END AS keep FROM ud LEFT JOIN uo USING (rec)),
u2 AS (SELECT *, regexp_replace(substr(qual, 1, keep), '[!-4]+$', '') AS q2, substr(seq, 1, keep) AS s1 FROM u1),
u3 AS (SELECT *, regexp_replace(substr(s1, 1, length(q2)), 'G{{5,}}$', '') AS s3 FROM u2)
SELECT concat('run_', bc, '_R1_', CASE WHEN duplicate THEN 'duplicated' ELSE 'demultiplexed' END, '.fastq.gz') AS file, rec,
       concat(name, '_', fixed, '_', bc, '_', umi, ' ', {said}, chr(10), s3, chr(10), '+', chr(10), substr(q2, 1, length(s3))) AS text FROM u3 WHERE length(s3) >= 22""",
        "design_preview": c + """, f AS (SELECT rec, seq, row_number() OVER (ORDER BY rec) AS k FROM r), first3 AS (SELECT * FROM f WHERE k <= 3),
head AS (SELECT * FROM (VALUES (0, 'bcRead1: 4X|GATC*GGTC|8L|6I (22 bases)'), (1, '  t1 1-4 (4 bases) exclude'), (2, '  t2 5-8 (4 bases) fixed GATC*GGTC'), (3, '  t3 9-16 (8 bases) lookup'), (4, '  t4 17-22 (6 bases) include'), (20, 'lookup table: 25 lines')) v(line, said)),
body AS (SELECT 5 * k + i AS line, CASE i WHEN 0 THEN substr(seq, 1, 60) || CASE WHEN length(seq) > 60 THEN '...' ELSE '' END WHEN 1 THEN '  t1 ' || substr(seq, 1, 4)
                WHEN 2 THEN '  t2 ' || substr(seq, 5, 4) || CASE WHEN substr(seq, 5, 4) IN ('GATC', 'GGTC') THEN '  <- matches' ELSE '  <- NO MATCH' END WHEN 3 THEN '  t3 ' || substr(seq, 9, 8) ELSE '  t4 ' || substr(seq, 17, 6) END AS said FROM first3, range(0, 5) x(i))
SELECT CAST(line AS BIGINT) AS line, said FROM head UNION ALL SELECT CAST(line AS BIGINT), said FROM body""",
        "packed_keys": c + ", s AS (SELECT DISTINCT CASE WHEN rec % 3 = 0 THEN lower(seq2) ELSE seq2 END AS seq FROM r) SELECT seq, CAST(length(seq) // 4 + CASE WHEN length(seq) % 4 > 0 THEN 1 ELSE 0 END + 2 AS BIGINT) AS n_bytes, upper(seq) AS unpacked FROM s",
    }
    return out


_HEADER = "CASE WHEN comment = '' THEN name || ':0_ACGTACGT+TTGCAACT' ELSE comment END"


def _index_sql(salt: str, of: int, n: int) -> str:
    return f"substr({dna(salt, f'rec % {of}')}, 1, {n})"


def _plain_run(index1: str, index2: str, name: str, tags: str) -> str:
    """A run with two index tokens, without copies and trimming of adapters."""
    return f""", x AS (SELECT *, {index1} AS i1, {index2} AS i2, {name} AS named FROM a)
SELECT concat('{PREFIX}_', {tags}, '_R1_', CASE WHEN rejected THEN 'rejected' ELSE 'demultiplexed' END, '.fastq.gz') AS file, rec,
       concat(named, '_', i1, '_', i2, '_', fixed, '_', bc, '_', umi, ' ', CASE WHEN comment = '' THEN '1:N:0:0' ELSE comment END, chr(10), rest, chr(10), '+', chr(10), restq) AS text FROM x WHERE length(rest) >= 22"""


ORACLE_SQL = _oracles()
