"""Demultiplexing reads as they arrive.

Slicing, naming, trimming and routing need no state and run on a stream as they do on a
table. Copies are flagged and routed like those of a table, by a state for each key that is
kept until the watermark on the time of arrival has passed it; of the copies in one
micro-batch the first by record number is kept, and a key's reads of one micro-batch are
held together, so triggers should be bounded. Only names that exist without looking at
other reads can be given: ``I`` tokens are reported as sequences.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from readloom.functions import iupac
from readloom.operators import assign, dedup, route, trim
from readloom.operators.tokens import slice_tokens, token_columns
from readloom.plans.demux import ConfigError, DemuxConfig, Result, header_index_columns
from readloom.plans.design import SIDES, Design, tokens
from readloom.sources import lookup

#: Sequences that are named beforehand for one token.
MOST_NAMED = 2_000_000


def within(sequence: str, mismatches: int) -> Iterator[str]:
    """All observed sequences (ACGTN) that an entry may be the name of."""
    for plain in itertools.product(*(iupac.BASES[c] for c in sequence)):
        for places in itertools.combinations(range(len(plain)), min(mismatches, len(plain))):
            for bases in itertools.product("ACGTN", repeat=len(places)):
                found = list(plain)
                for i, c in zip(places, bases, strict=True):
                    found[i] = c
                yield "".join(found)


def lookup_names(spark: SparkSession, config: DemuxConfig, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """For each looked-up token the names of all sequences that have one, found once before the stream starts.

    Where mismatches make these too many, they have to be ``known`` (seq); others are then without a name.
    """
    tables = lookup.by_token(lookup.parse(config.lookup or ""), config.designs())
    out = {}
    for t, table in tables.items():
        seen = known
        if seen is None:
            every: set[str] = set()
            for sequence in table:
                every.update(within(sequence, max(0, config.max_mismatches)))
                if len(every) > MOST_NAMED:
                    raise ConfigError(f"{t.column}: too many sequences within {config.max_mismatches} mismatches; say which are known")
            seen = spark.createDataFrame([(s,) for s in sorted(every)], "seq string")
        out[t.column] = assign.match(seen.select("seq").distinct(), table, config.max_mismatches).select("seq", "assigned")
    return out


def _flagged(df: DataFrame, keys: list[str], arrived: str, late: int) -> DataFrame:
    """Adds ``duplicate``; a key that is not plain is a read's own."""
    key = dedup.key(keys)
    own = F.when(dedup.plain(key), F.md5(key)).otherwise(F.concat_ws("#", F.lit(""), F.col("name"), F.col("rec").cast("string")))
    keyed = df.withColumn("_copy", own).withWatermark(arrived, f"{late} seconds")
    made = T.StructType([*df.schema.fields, T.StructField("duplicate", T.BooleanType())])
    names = df.columns

    def flag(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("rec", kind="stable")
        rows["duplicate"] = True
        if not state.exists:
            rows.iloc[0, rows.columns.get_loc("duplicate")] = False
        last = int(pd.Timestamp(rows[arrived].max()).timestamp() * 1000)
        state.update((max(last, state.get[0]) if state.exists else last,))
        state.setTimeoutTimestamp(max(last + 1000 * late, state.getCurrentWatermarkMs() + 1))
        yield rows[[*names, "duplicate"]]

    return keyed.groupBy("_copy").applyInPandasWithState(flag, made, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def demultiplex_stream(wide: DataFrame, config: DemuxConfig, names: dict[str, DataFrame], arrived: str | None = None, late: int = 600) -> Result:
    """``wide`` comes from ``align``. ``deduplicate`` needs ``arrived``, a column of times: copies may come ``late`` seconds apart."""
    if any(t.segment.kind == "I" for t in tokens(config.designs())) and not config.umi_as_sequence:
        raise ConfigError("numbered ids need all reads; use umi_as_sequence on a stream")
    if config.deduplicate and not arrived:
        raise ConfigError("copies on a stream need a column of arrival times")
    has_read2 = "r2_seq" in wide.columns
    config.validate(has_read2, not config.indexes_in_header and "i1_seq" in wide.columns)
    if config.indexes_in_header:
        wide = header_index_columns(wide, config)
    designs = {d: x if f"{SIDES[d]}_seq" in wide.columns else Design() for d, x in config.designs().items()}
    df = slice_tokens(wide, designs, config.trim_barcodes, config.short_read)
    used = tokens(designs)
    if config.deduplicate:
        df = _flagged(df, [*token_columns(df, designs), "r1_seq", *(["r2_seq"] if has_read2 else [])], arrived, late)
    else:
        df = df.withColumn("duplicate", F.lit(False))
    for t in used:
        if t.segment.kind == "L":
            named = names[t.column].withColumnsRenamed({"seq": t.column, "assigned": f"{t.column}_id"})
            df = df.join(named, t.column, "left").withColumn(f"{t.column}_id", F.coalesce(f"{t.column}_id", F.lit(assign.UNKNOWN)))
        else:
            df = df.withColumn(f"{t.column}_id", assign.or_unknown(F.col(t.column)))
    df = df.withColumn("name_out", assign.annotated_name(F.col("name"), [f"{t.column}_id" for t in used]))
    for side, adapter in (("r1", config.adapter_r1), ("r2", config.adapter_r2 if has_read2 else "")):
        df = trim.trim_side(df, side, adapter, config.overlap_diff_limit, config.overlap_require, config.diff_fraction, config.trim_quality, config.min_stretch_g)
    if not config.reject_fixed:
        df = df.withColumn("rejected", F.lit(False))
    return Result(config, used, df.withColumn("destination", route.destination(F.col("duplicate"), F.col("rejected"), config.global_rejected)))
