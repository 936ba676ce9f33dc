"""Dry run: the layout of the designs and how the first records are cut, without writing anything."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import iupac
from readloom.plans.demux import DemuxConfig
from readloom.plans.design import SIDES, Design
from readloom.sources import fastq

LAYOUT = "design string, token int, first int, last int, width int, kind string, alternatives string"
_KINDS = {"L": "lookup", "I": "include", "X": "exclude", "S": "fixed"}


def layout_rows(name: str, design: Design) -> list[tuple]:
    return [(name, s.number, s.start + 1, s.end + 1, s.size, _KINDS[s.kind], "*".join(s.sequences)) for s in design.segments]


def layout(spark: SparkSession, designs: dict[str, Design]) -> DataFrame:
    """Every token with its bases, counted from 1."""
    return spark.createDataFrame([r for n, d in designs.items() for r in layout_rows(n, d)], LAYOUT)


def preview(design: Design, sequence: str, most: int = 60) -> list[str]:
    lines = [sequence[:most] + ("..." if len(sequence) > most else "")]
    if len(sequence) < design.total:
        return [*lines, f"  shorter than the design ({len(sequence)} of {design.total} bases)"]
    for s in design.segments:
        part = sequence[s.start : s.start + s.size]
        verdict = "" if s.kind != "S" else "  <- matches" if any(iupac.matches_py(part, x) for x in s.sequences) else "  <- NO MATCH"
        lines.append(f"  t{s.number} {part}{verdict}")
    return lines


def lookup_lines(text: str) -> int:
    return sum(bool(x) and not re.match("#|//", x) for x in text.splitlines())


def check_design(config: DemuxConfig, sides: dict[str, DataFrame], records: int = 3) -> str:
    """``sides``: r1, r2, i1 and i2 as far as given. With indexes in the headers, those of read 1 stand for i1 and i2."""
    config.require_lookup()
    if config.indexes_in_header and "r1" in sides:
        found, _ = fastq.header_indexes(F.col("name"), F.col("comment"))
        sides = sides | {f"i{i + 1}": sides["r1"].select("rec", F.coalesce(F.get(found, F.lit(i)), F.lit("")).alias("seq")) for i in range(2)}
    out: list[str] = []
    for name, design in config.designs().items():
        if not design:
            continue
        out.append(f"{name}: {design} ({design.total} bases)")
        out += [f"  t{n} {a}-{b} ({w} bases) {kind} {more}".rstrip() for _, n, a, b, w, kind, more in layout_rows(name, design)]
        df = sides.get(SIDES[name])
        if df is not None:
            for row in df.orderBy("rec").limit(records).select("seq").collect():
                out += preview(design, row["seq"])
    if config.lookup is not None:
        out.append(f"lookup table: {lookup_lines(config.lookup)} lines")
    return "\n".join(out)
