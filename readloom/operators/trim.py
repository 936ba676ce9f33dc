"""Adapter, quality and poly-G trimming of 3' ends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import quality as q

OVERLAP = "offset int, diff int, length int"
_NONE = 1 << 29


def best_overlap(reads: list[str], adapter: str, most_diff: int = 2, require: int = 15, fraction: float = 0.1) -> np.ndarray:
    """(reads, 3) of offset, differences and overlap; offset is ``_NONE`` where the adapter is not found.

    All reads of a batch are compared at one offset at a time. Fewest differences win, then
    offsets from 0 on before negative ones, then the smallest.
    """
    count, m = len(reads), len(adapter)
    out = np.full((count, 3), _NONE)
    sizes = np.array([len(r) for r in reads], np.int64)
    width = int(sizes.max(initial=0))
    if not m or not width:
        return out
    table = np.zeros((count, width), np.uint8)
    flat = np.frombuffer("".join(reads).encode("latin-1", "replace"), np.uint8)
    table[np.arange(width) < sizes[:, None]] = flat
    wanted, free = np.frombuffer(adapter.encode("latin-1", "replace"), np.uint8), table == ord("N")
    able = sizes >= require
    for offset in [*range(0, width - require + 1), *range(1 - m, 0)]:
        # forward: the adapter begins in the read; backward: the read begins in the adapter
        at, skip = max(offset, 0), max(-offset, 0)
        length = np.minimum(sizes - at, m - skip)
        span = min(width - at, m - skip)
        if span <= 0:
            continue
        inside = np.arange(span) < length[:, None]
        differ = ((table[:, at : at + span] != wanted[skip : skip + span]) & ~free[:, at : at + span] & inside).sum(axis=1)
        ok = able & (length >= require) if offset < 0 else able & (offset <= sizes - require) & ((length >= require) | (at + length >= sizes))
        ok &= (differ <= np.minimum(most_diff, (length * fraction).astype(np.int64))) & (differ < out[:, 1])
        out[ok] = np.column_stack([np.full(ok.sum(), offset), differ[ok], length[ok]])
    return out


def with_overlap(df: DataFrame, sequence: str, adapter: str, to: str, most_diff: int = 2, require: int = 15, fraction: float = 0.1) -> DataFrame:
    """Adds a struct of offset, diff and length; null where the adapter is not found."""

    @F.pandas_udf(OVERLAP)
    def run(reads: pd.Series) -> pd.DataFrame:
        found = best_overlap(reads.fillna("").tolist(), adapter, most_diff, require, fraction)
        return pd.DataFrame(np.where(found == _NONE, -_NONE, found), columns=["offset", "diff", "length"], dtype="int32")

    # Else the optimizer copies the call into filters that it pushes down, and runs it twice.
    df = df.withColumn("_raw", run.asNondeterministic()(F.col(sequence)))
    return df.withColumn(to, F.when(F.col("_raw.offset") != -_NONE, F.col("_raw"))).drop("_raw")


def keep_length(sequence: Column, found: Column) -> Column:
    """How much of a read stays: up to the adapter; if the adapter begins before it, as much less."""
    cut = F.when(found["offset"] >= 0, found["offset"]).otherwise(F.greatest(F.length(sequence) + found["offset"], F.lit(0)))
    return F.when(found["offset"].isNull(), F.length(sequence)).otherwise(cut)


def quality_trim(sequence: Column, quality: Column, threshold: int = 20) -> tuple[Column, Column]:
    """Without trailing bases of a quality under the threshold; 0 or less leaves all."""
    if threshold <= 0:
        return sequence, quality
    rest = F.regexp_replace(quality, q.below(threshold), "")
    return F.substring(sequence, F.lit(1), F.length(rest)), rest


def poly_g_trim(sequence: Column, quality: Column, least: int = 5) -> tuple[Column, Column]:
    """Without a trailing run of G of at least ``least``; 0 leaves all."""
    if least <= 0:
        return sequence, quality
    rest = F.regexp_replace(sequence, rf"G{{{least},}}\z", "")
    return rest, F.substring(quality, F.lit(1), F.length(rest))


def trim_side(df: DataFrame, side: str, adapter: str, most_diff: int = 2, require: int = 15, fraction: float = 0.1, threshold: int = 20, least_g: int = 5) -> DataFrame:
    """Adapter, then quality, then poly-G. Without an adapter nothing is trimmed at all."""
    if not adapter:
        return df
    seq, qual = f"{side}_seq", f"{side}_qual"
    df = with_overlap(df, seq, adapter, "_found", most_diff, require, fraction).withColumn("_keep", keep_length(F.col(seq), F.col("_found")))
    df = df.withColumns({seq: F.substring(F.col(seq), F.lit(1), F.col("_keep")), qual: F.substring(F.col(qual), F.lit(1), F.col("_keep"))})
    s, q_ = quality_trim(F.col(seq), F.col(qual), threshold)
    df = df.withColumns({seq: s, qual: q_})
    s, q_ = poly_g_trim(F.col(seq), F.col(qual), least_g)
    return df.withColumns({seq: s, qual: q_}).drop("_found", "_keep")
