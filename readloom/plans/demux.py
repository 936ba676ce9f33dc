"""The whole run: from aligned records to routed ones, with all tables.

The order of steps for a read is fixed: barcode trimming, duplicates, names, adapter,
quality and poly-G trimming, length, counting, routing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import assign, dedup, route, stats, trim
from readloom.operators.align import require
from readloom.operators.storage import stored
from readloom.operators.tokens import slice_tokens, token_columns
from readloom.plans.design import DESIGNS, SIDES, Design, Token, parse, resolve, tokens
from readloom.sources import fastq, lookup


class ConfigError(ValueError):
    pass


@dataclass
class DemuxConfig:
    bc_index1: str = ""
    bc_index2: str = ""
    bc_read1: str = ""
    bc_read2: str = ""
    lookup: str | None = None  # the table's text
    indexes_in_header: bool = False
    max_mismatches: int = 0
    trim_barcodes: bool = False
    umi_as_sequence: bool = False
    reject_fixed: bool = False
    global_rejected: bool = False
    deduplicate: bool = False
    adapter_r1: str = ""
    adapter_r2: str = ""
    overlap_diff_limit: int = 2
    overlap_require: int = 15
    diff_fraction: float = 0.1
    trim_quality: int = 20
    min_stretch_g: int = 5
    min_length: int = 22
    split_on: str = ""
    prefix: str = ""
    base1: str = "reads"
    base2: str = "reads"
    short_read: str = "keep"
    strict_index: bool = True
    threads: int = 1

    def designs(self) -> dict[str, Design]:
        return {d: parse(t) for d, t in zip(DESIGNS, (self.bc_index1, self.bc_index2, self.bc_read1, self.bc_read2), strict=True)}

    def require_lookup(self) -> None:
        """Looked-up tokens need a table."""
        missing = [d for d, x in self.designs().items() if any(s.kind == "L" for s in x.segments)]
        if missing and self.lookup is None:
            raise ConfigError(f"a lookup table is needed for {', '.join(missing)}")

    def validate(self, has_read2: bool = False, has_index_files: bool = False) -> None:
        self.require_lookup()
        if self.indexes_in_header and has_index_files:
            raise ConfigError("indexes come from the headers or from files, not from both")
        if min(self.overlap_diff_limit, self.overlap_require, self.diff_fraction, self.trim_quality, self.min_stretch_g) < 0 or self.diff_fraction > 100:
            raise ConfigError("trimming limits are out of range")
        if self.bc_read2 and not has_read2:
            raise ConfigError("bcRead2 needs a second read file")
        if self.min_length < 12:
            raise ConfigError("the shortest read length is 12")
        if self.threads < 1:
            raise ConfigError("at least one thread")
        if self.global_rejected and not self.reject_fixed:
            raise ConfigError("globalRejected needs rejectNonMatchingFixedBarcodes")
        if self.short_read not in ("keep", "reject"):
            raise ConfigError("short_read is keep or reject")
        resolve(self.split_on, self.designs())


@dataclass
class Result:
    """All reads with their verdicts, and what follows from them."""

    config: DemuxConfig
    tokens: list[Token]
    processed: DataFrame

    @property
    def id_columns(self) -> list[str]:
        return [f"{t.column}_id" for t in self.tokens]

    @property
    def has_read2(self) -> bool:
        return "r2_seq" in self.processed.columns

    def written(self) -> DataFrame:
        return route.long_enough(self.processed, self.config.min_length)

    def records(self) -> DataFrame:
        """file, rec, text of every written record."""
        c, out = self.config, []
        tags = [f"{t.column}_id" for t in resolve(c.split_on, c.designs())]
        tags = [t for t in tags if t in self.processed.columns]
        for mate, base in ((1, c.base1), (2, c.base2))[: 2 if self.has_read2 else 1]:
            s = f"r{mate}"
            text = route.record(F.col("name_out"), F.col(f"{s}_comment"), F.col(f"{s}_mate"), F.col(f"{s}_seq"), F.col(f"{s}_plus"), F.col(f"{s}_qual"))
            out.append(F.struct(route.file_name(c.prefix or base, F.col("destination"), tags, mate, c.global_rejected).alias("file"), text.alias("text")))
        return self.written().select("rec", F.explode(F.array(*out)).alias("x")).select("x.file", "rec", "x.text")

    def barcodes(self) -> dict[str, DataFrame]:
        """Tables of all tokens: Index_Sequence_1, ..., Read_Sequence_1, ..."""
        out: dict[str, DataFrame] = {}
        for kind, own in (("Index", [t for t in self.tokens if t.side[0] == "i"]), ("Read", [t for t in self.tokens if t.side[0] == "r"])):
            for j, t in enumerate(own, 1):
                out[f"{kind}_Sequence_{j}"] = stats.barcode_table(self.processed, t)
        return out

    def tables(self) -> dict[str, DataFrame]:
        w = self.written()
        lengths = {"Read1Length": stats.read_lengths(w, "r1")} | ({"Read2Length": stats.read_lengths(w, "r2")} if self.has_read2 else {})
        return self.barcodes() | {"Combinations": stats.combinations(w, self.id_columns)} | lengths | {"ReadStatistics": stats.read_statistics(self.processed, self.config.min_length)}

    def statistics(self) -> DataFrame:
        """All tables as one, in rows of table, key, assigned_name, count, average_quality."""
        t = self.tables()
        lengths = {k: v for k, v in t.items() if k.endswith("Length")}
        return stats.long_table({k: v for k, v in t.items() if "_Sequence_" in k}, t["Combinations"], lengths, t["ReadStatistics"])

    def diagnostics(self) -> dict[str, DataFrame]:
        """Orientation of each looked-up token, and the most frequent sequences without a name."""
        looked_up = {t.column: stats.barcode_table(self.processed, t) for t in self.tokens if t.segment.kind == "L"}
        out = {f"orientation_{k}": stats.orientation(v) for k, v in looked_up.items()}
        return out | ({"top_unassigned": stats.top_unassigned(looked_up)} if looked_up else {})


def header_index_columns(wide: DataFrame, config: DemuxConfig) -> DataFrame:
    """Index sequences from the headers of read 1, with constant qualities; both mates' names lose them."""
    found, name = fastq.header_indexes(F.col("name"), F.col("r1_comment"))
    wide = wide.withColumn("_found", found).withColumn("_name", name)
    wide = require(wide, F.size("_found") > 0, F.concat(F.lit("no index in the header of "), F.col("name")))
    wide = require(wide, F.size("_found") <= 2, F.concat(F.lit("more than two indexes in the header of "), F.col("name")))
    if config.bc_index2:
        wide = require(wide, F.size("_found") == 2, F.concat(F.lit("only one index in the header of "), F.col("name")))
    index = lambda i: F.coalesce(F.get("_found", F.lit(i)), F.lit(""))
    wide = wide.withColumns({f"i{i + 1}_seq": index(i) for i in range(2)} | {f"i{i + 1}_qual": F.repeat(F.lit("J"), F.length(index(i))) for i in range(2)})
    return wide.withColumn("name", F.col("_name")).drop("_found", "_name")


def demultiplex(wide: DataFrame, config: DemuxConfig, keep: bool = True) -> Result:
    """``wide`` comes from ``align``. ``keep`` writes the processed reads once, for files and tables alike."""
    has_read2 = "r2_seq" in wide.columns
    config.validate(has_read2, not config.indexes_in_header and "i1_seq" in wide.columns)
    designs = config.designs()
    if config.indexes_in_header:
        wide = header_index_columns(wide, config)
    # A design without its file is left aside.
    designs = {d: x if f"{SIDES[d]}_seq" in wide.columns else Design() for d, x in designs.items()}
    df = slice_tokens(wide, designs, config.trim_barcodes, config.short_read)
    if not config.reject_fixed:
        df = df.withColumn("rejected", F.lit(False))
    used = tokens(designs)
    # Before the names: the keys are sequences, so that only slices are evaluated to find copies.
    if config.deduplicate:
        df = dedup.flag_duplicates(df, [*token_columns(df, designs), "r1_seq", *(["r2_seq"] if has_read2 else [])])
    else:
        df = df.withColumn("duplicate", F.lit(False))
    table = lookup.by_token(lookup.parse(config.lookup), designs) if config.lookup is not None else {}
    for t in used:
        df = assign.assign(df, t, table.get(t), config.max_mismatches, config.umi_as_sequence)
    df = df.withColumn("name_out", assign.annotated_name(F.col("name"), [f"{t.column}_id" for t in used]))
    for side, adapter in (("r1", config.adapter_r1), ("r2", config.adapter_r2 if has_read2 else "")):
        df = trim.trim_side(df, side, adapter, config.overlap_diff_limit, config.overlap_require, config.diff_fraction, config.trim_quality, config.min_stretch_g)
    df = df.withColumn("destination", route.destination(F.col("duplicate"), F.col("rejected"), config.global_rejected))
    return Result(config, used, stored(df, "processed") if keep else df)
