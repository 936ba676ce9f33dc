"""Nucleotide codes: regular expressions, reverse complement and mismatches as Columns."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The bases that each code stands for.
BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Each code and its complement.
CODES, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"

_RC = str.maketrans(CODES + CODES.lower(), COMPLEMENTS + COMPLEMENTS.lower())


def is_valid(sequence: str) -> bool:
    return all(c in BASES for c in sequence)


def validate(sequence: str) -> str:
    if not is_valid(sequence):
        raise ValueError(f"not a nucleotide sequence in upper-case codes: {sequence!r}")
    return sequence


def reverse_complement(sequence: str) -> str:
    return sequence[::-1].translate(_RC)


def reverse_complement_col(sequence: Column) -> Column:
    return F.translate(F.reverse(sequence), CODES + CODES.lower(), COMPLEMENTS + COMPLEMENTS.lower())


def is_valid_col(sequence: Column) -> Column:
    return sequence.rlike(rf"^[{CODES}]*\z")


def pattern(sequence: str) -> str:
    """A regular expression for the observed bases that a code sequence accepts; N and lower case never match."""
    return "".join(BASES[c] if len(BASES[c]) == 1 else f"[{BASES[c]}]" for c in validate(sequence))


def any_of(sequences: list[str] | tuple[str, ...]) -> str:
    return r"^(?:" + "|".join(map(pattern, sequences)) + r")\z"


def matches(observed: Column, sequences: list[str] | tuple[str, ...]) -> Column:
    return observed.rlike(any_of(sequences))


def matches_py(observed: str, expected: str) -> bool:
    return len(observed) == len(expected) and re.fullmatch(pattern(expected), observed) is not None


def expansions(sequence: str, most: int) -> list[str] | None:
    """All plain sequences that codes stand for, or None if they are more than ``most``."""
    size = 1
    for c in sequence:
        size *= len(BASES[c])
        if size > most:
            return None
    return ["".join(x) for x in itertools.product(*(BASES[c] for c in sequence))]


def mismatches(observed: Column, classes: Column, width: int) -> Column:
    """Positions at which the observed base is in no class; ``classes`` is an array of base sets as strings."""
    total = F.lit(0)
    for i in range(width):
        total = total + F.when(F.instr(classes[i], F.substring(observed, i + 1, 1)) > 0, 0).otherwise(1)
    return total


def hamming(a: Column, b: Column) -> Column:
    """Literal Hamming distance; null if the lengths differ."""
    at = F.sequence(F.lit(1), F.length(a))
    # sequence(1, 0) counts down, so empty strings are a case of their own
    count = F.when(F.length(a) == 0, 0).otherwise(F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))))
    return F.when(F.length(a) == F.length(b), count)


def hamming_py(a: str, b: str) -> int | None:
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else None


def register(spark: SparkSession) -> None:
    """SQL functions of this session: reverse_complement, is_dna, hamming_distance."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN translate(reverse(s), '{CODES + CODES.lower()}', '{COMPLEMENTS + COMPLEMENTS.lower()}')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_dna(s STRING) RETURNS BOOLEAN RETURN s rlike '^[{CODES}]*\\\\z'")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming_distance(a STRING, b STRING) RETURNS INT RETURN CASE WHEN length(a) <> length(b) THEN NULL WHEN length(a) = 0 THEN 0 ELSE size(filter(sequence(1, length(a)), i -> substring(a, i, 1) <> substring(b, i, 1))) END")
