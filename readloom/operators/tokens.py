"""Slicing sequences by a design. All offsets are fixed, so every token is a substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import iupac
from readloom.operators.align import require
from readloom.plans.design import DESIGNS, SIDES, Design, tokens


def parsed(design: Design, side: str, index: bool) -> Column:
    """Whether the design's bases are there. An index has to have exactly as many."""
    length = F.least(F.length(f"{side}_seq"), F.length(f"{side}_qual"))
    return F.coalesce((length == design.total) if index else (length >= design.total), F.lit(False))


def slice_side(df: DataFrame, name: str, design: Design, trim: bool = False) -> DataFrame:
    """Adds ``<side>_t<n>`` and ``<side>_t<n>_qual`` for each reported token, null where nothing was parsed,
    ``<side>_parsed`` and ``<side>_bad`` (a fixed token without a match, or too short a read).

    ``trim`` takes the design's bases off parsed reads; those that match no fixed token included.
    """
    side, index = SIDES[name], name.startswith("bcIndex")
    seq, qual = F.col(f"{side}_seq"), F.col(f"{side}_qual")
    some = F.coalesce((F.length(seq) > 0) & (F.length(qual) > 0), F.lit(False))
    ok = some & parsed(design, side, index)
    if index:
        df = require(df, ~some | ok, F.concat(F.lit(f"{name}: the index of "), F.col("name"), F.lit(f" does not have {design.total} bases")))
    bad = F.lit(False)
    for s in design.segments:
        if s.kind == "S":
            bad = bad | (ok & ~iupac.matches(F.substring(seq, s.start + 1, s.size), s.sequences))
    new = {f"{side}_t{s.number}{q}": F.when(ok, F.substring(c, s.start + 1, s.size)) for s in design.tokens for q, c in (("", seq), ("_qual", qual))}
    new |= {f"{side}_parsed": ok, f"{side}_bad": bad | (some & ~ok)}
    if trim and not index:
        rest = lambda c: F.when(ok, F.substring(c, F.lit(design.total + 1), F.length(c))).otherwise(c)
        new |= {f"{side}_seq": rest(seq), f"{side}_qual": rest(qual)}
    return df.withColumns(new)


def slice_tokens(df: DataFrame, designs: dict[str, Design], trim: bool = False, short_read: str = "keep") -> DataFrame:
    """All designs, and ``rejected``: some fixed token does not match.

    A read shorter than its design is rejected only if a token of the other mate was parsed
    (``short_read="keep"``), or always (``"reject"``).
    """
    used = [d for d in DESIGNS if designs.get(d) and f"{SIDES[d]}_seq" in df.columns]
    for name in used:
        df = slice_side(df, name, designs[name], trim)
    rejected = F.lit(False)
    for name in (d for d in used if d.startswith("bcIndex")):
        rejected = rejected | F.col(f"{SIDES[name]}_bad")
    reads = [d for d in used if d.startswith("bcRead")]
    if reads:
        flagged, seen = F.lit(False), F.lit(short_read == "reject")
        for name in reads:
            flagged = flagged | F.col(f"{SIDES[name]}_bad")
            if designs[name].tokens:
                seen = seen | F.col(f"{SIDES[name]}_parsed")
        rejected = rejected | (flagged & seen)
    return df.withColumn("rejected", rejected)


def token_columns(df: DataFrame, designs: dict[str, Design]) -> list[str]:
    return [t.column for t in tokens(designs) if t.column in df.columns]
