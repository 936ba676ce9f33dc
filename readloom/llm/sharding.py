"""Uniform shuffling into shards of exact size, by a hypergeometric communication matrix.

Every local partition puts its rows in random order. How many of them go to each target
block is drawn exactly: the matrix of counts has the law that it would have if all rows
were dealt at once (to the rounding of doubles), so each way to deal the rows is equally
likely and every block gets precisely its size. Nobody holds the matrix: partitions are
halved again and again, each half's counts are a multivariate hypergeometric draw from
those of the whole, with a generator seeded by the halving; so every task draws the same
numbers on the way to the row of its own partition. After the exchange each block is put
in random order again. Blocks are runs of slots of one shard, so that no task holds a
shard: their number grows with the rows and the bytes of their strings.

Shard sizes differ by one row at most (law ``rows``). Random orders come from hashes of
the seed and the row's keys; rows that agree in all keys are alike and may swap places.
Rows are dealt whole. Local partitions are those of the input; their ordered rows are
written to the shared folder before the only exchange, so a retried task meets the same
order. Null keys hash like any value; an empty table gives an empty result. Groups of
equal texts are not held together. Columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import stored

#: Rows in a block, and bytes of strings, on average.
BLOCK_ROWS, BLOCK_BYTES = 4_096, 32 << 20
#: Rows up to which the generator draws a whole vector by itself.
_VECTOR = 1_000_000_000


def block_sizes(total: int, shards: int, per_shard: int) -> np.ndarray:
    """Sizes of all blocks in order of their slots; those of a shard add up to its exact size."""
    sizes = np.full(shards, total // shards, np.int64)
    sizes[: total % shards] += 1
    out = np.repeat((sizes // per_shard)[:, None], per_shard, axis=1)
    out += np.arange(per_shard)[None, :] < (sizes % per_shard)[:, None]
    return out.ravel()


def deal(free: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` rows get places of each kind, of which ``free`` are left: a multivariate hypergeometric draw."""
    total = int(free.sum())
    if total < _VECTOR:
        return rng.multivariate_hypergeometric(free, n, method="marginals")
    if len(free) == 1:
        return np.array([n], np.int64)
    half = len(free) // 2
    good = int(free[:half].sum())
    first = _hypergeometric(rng, good, total - good, n)
    return np.concatenate([deal(free[:half], first, rng), deal(free[half:], n - first, rng)])


def matrix_row(p: int, rows: np.ndarray, blocks: np.ndarray, seed: int) -> np.ndarray:
    """How many rows of partition ``p`` go to each block; ``rows`` and ``blocks`` are the margins of the matrix."""
    low, high, upto, own = 0, len(rows), np.concatenate([[0], np.cumsum(rows)]), blocks
    while high - low > 1:
        middle = (low + high) // 2
        left = deal(own, int(upto[middle] - upto[low]), np.random.default_rng([seed, low, high]))
        if p < middle:
            high, own = middle, left
        else:
            low, own = middle, own - left
    return own


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # Beyond the generator's range: the law is symmetric in ``good`` and ``n``, and its weights around the
    # mode follow from their exact ratios. Outside 40 deviations they vanish in double precision.
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 64 + int(40 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumsum(np.log((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1))))
    fall = np.cumsum(np.log(down / (good - down + 1) * ((bad - n + down) / (n - down + 1))))
    weights = np.cumsum(np.exp(np.concatenate([fall[::-1], [0.0], rise])))
    return mode - len(down) + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def shuffle_into_shards(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    spark = df.sparkSession
    named = df.select(F.struct(*df.columns).alias("row"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    hashed = named.select("row", *(F.xxhash64(F.lit(f"{seed}-{turn}"), *(f"k{i}" for i in range(len(keys)))).alias(turn) for turn in ("first", "second")))
    # monotonically_increasing_id: partition in the upper 31 bits, place in it in the lower 33
    local = hashed.sortWithinPartitions("first", "second").withColumn("at", F.monotonically_increasing_id())
    local = stored(local.select("row", "second", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "shards")

    long = [F.coalesce(F.octet_length(F.col("row")[f.name]).cast("long"), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    measured = local.groupBy("part").agg(F.count("*").alias("count"), F.sum(sum(long, F.lit(0))).alias("bytes")).collect()  # one row a partition
    counted = {r["part"]: r["count"] for r in measured}
    held = sum(r["bytes"] for r in measured)
    counts = np.array([counted.get(p, 0) for p in range(max(counted, default=-1) + 1)], np.int64)
    total = int(counts.sum())
    per_shard = max(1, -(-total // (shards * block_rows)), -(-held // (shards * BLOCK_BYTES)))
    margins = spark.sparkContext.broadcast((counts, block_sizes(total, shards, per_shard)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, blocks = margins.value
        offsets = (np.cumsum(blocks) - blocks).reshape(shards, per_shard)
        offsets = (offsets - offsets[:, :1]).ravel()  # of a block in its shard
        now, ends = -1, None
        for batch in batches:
            part, place = batch.column("part").to_numpy(), batch.column("place").to_numpy()
            block = np.zeros(len(part), np.int32)
            for p in np.unique(part).tolist():
                if p != now:
                    now, ends = p, np.cumsum(matrix_row(p, rows, blocks, seed))
                own = part == p
                block[own] = np.searchsorted(ends, place[own], side="right")
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("second"), pa.array(block), pa.array((block // per_shard).astype(np.int32)), pa.array(offsets[block])], ["row", "second", "block", "shard", "base"])

    kept = {f.name: f for f in local.schema.fields}
    dealt = local.mapInArrow(run, T.StructType([kept["row"], kept["second"], T.StructField("block", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())]))
    slot = F.col("base") + F.row_number().over(Window.partitionBy("block").orderBy("second")) - 1
    names = [c for c in df.columns if c not in ("shard", "slot")]
    return dealt.select(*(F.col("row")[c].alias(c) for c in names), "shard", slot.cast("long").alias("slot"))
