"""Phred+33 qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_at(quality: Column, position: int) -> Column:
    """The score at a 1-based position; characters below ``!`` count as 0, above ``~`` as 93."""
    return F.least(F.greatest(F.ascii(F.substring(quality, position, 1)) - 33, F.lit(0)), F.lit(93))


def scores(quality: Column) -> Column:
    """All scores as an array."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.least(F.greatest(F.ascii(c) - 33, F.lit(0)), F.lit(93)))


def mean_scores(quality: Column, width: int) -> Column:
    """Aggregate: the mean score at each position, in whole numbers rounded down."""
    return F.array(*((F.sum(score_at(quality, i).cast("long")) / F.count(F.lit(1))).cast("long") for i in range(1, width + 1)))


def constant(sequence: Column, character: str = "J") -> Column:
    return F.repeat(F.lit(character), F.length(sequence))


def below(threshold: int) -> str:
    """A regular expression for trailing characters with a score under the threshold."""
    return rf"[\x00-\x{{{threshold + 32:x}}}]+\z"
