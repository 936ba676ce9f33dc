"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a band: five of 150 minima of the set under random functions. Two sets at
0.8 share none of the 30 bands with a probability of seven in a million, more alike ones
with less. What is found is exact: a parity sketch, whose differing bits can be no more
than the differing shingles, discards most pairs, and the others are verified on their
whole sets.

This goes on from SimHash: links hold between fingerprints, and only sets whose fingerprints
are not connected yet are compared. Pairs are made in two steps, so that a large group of near
copies is not paired with itself: first every set is held against one set of each of its bands
only, that with the most exact copies, then pairs of a band that are not connected by then and
pass the sketch. All others are connected anyway.

Words are runs of non-space, A-Z lower-cased; a text of fewer words is one shingle. Texts
without words, null texts among them, have the empty set and are alike. Shingles are
64-bit hashes. Equal sets are one node, named by a hash of the set; they are linked also where
their fingerprints are far apart, because one text repeats what the other says once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import simhash
from readloom.llm.common import sliced, stored
from readloom.llm.simhash import fingerprints, numbered, same_row
from readloom.llm.words import LOWER, NOT_SPACE, mix, split

SHINGLE = 5
#: The least similarity, as a fraction of integers.
LEAST, OF = 8, 10
BANDS, ROWS = 30, 5
#: Bits of the parity sketch.
SKETCH = 512
#: Rows up to which the texts asked for are named by a broadcast.
MOST_BROADCAST = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    w = split(column, NOT_SPACE, LOWER)
    coded = w.words.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(x.as_buffer()) for x in coded.dictionary], np.uint64)
    words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(w.words) else hashes
    whole = max(0, len(words) - shingle + 1)
    state = np.full(whole, shingle, np.uint64)
    for k in range(shingle):
        state = mix(state * _STEP + words[k : k + whole])
    out = []
    for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            out.append(np.unique(state[lo : hi - shingle + 1]).view(np.int64))
            continue
        one = np.full(min(1, hi - lo), hi - lo, np.uint64)
        for k in range(lo, hi):
            one = mix(one * _STEP + words[k : k + 1])
        out.append(one.view(np.int64))
    return out


def name(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(np.sort(shingles).tobytes()) - (1 << 63)


def bands(shingles: np.ndarray, most: int = 4_096) -> np.ndarray:
    """A key for each band. The empty set has keys of its own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), most):
        np.minimum(least, (shingles[i : i + most].view(np.uint64)[:, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * _STEP + least[k::ROWS])
    return keys.view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit."""
    odd = np.bincount(shingles & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def named_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table: row (``simhash.numbered``), key (a hash of the text), the id, fp (the SimHash fingerprint), node (the name of the row's set), n (its size), bands and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            sets, longs = shingle_sets(batch.column("body")), pa.list_(pa.int64())
            made = [pa.array(fingerprints(batch.column("body"))), pa.array([name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bands(s) for s in sets], longs), pa.array([sketch(s) for s in sets], longs)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), batch.column("id"), *made], ["row", "key", "id", "fp", "node", "n", "bands", "sketch"])

    longs = T.ArrayType(T.LongType())
    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", T.LongType()), T.StructField("id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", longs), T.StructField("sketch", longs)])
    rows = numbered(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))).withColumn("key", F.xxhash64("body"))
    return stored(rows.mapInArrow(run, kind).withColumnRenamed("id", doc_id), "similar-rows")


def _may_be_similar(x: str, y: str) -> Column:
    """What sizes and sketches allow: similar sets differ in (n_x + n_y) / 9 shingles at most."""
    n_x, n_y = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    return (n_x * OF >= n_y * LEAST) & (n_y * OF >= n_x * LEAST) & (apart * (OF + LEAST) <= (n_x + n_y) * (OF - LEAST))


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(root_a, root_b) of those pairs of sets (a, b) that are similar as a whole. A set is made anew from one text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(shingle_sets(batch.column("body")), pa.list_(pa.int64()))], ["node", "s"])

    asked = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "row", "key"), "similar-asked")
    asked = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked
    found = numbered(docs.select(F.col(text).alias("body"))).join(asked, "row").where(same_row(F.col("key"), F.col("body")))
    sets = stored(found.select("node", "body").mapInArrow(run, "node long, s array<long>"), "similar-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
    met = F.size(F.array_intersect("s_a", "s_b"))
    return stored(both.where(met * (LEAST + OF) >= LEAST * (F.size("s_a") + F.size("s_b"))).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "similar-links")


def links(docs: DataFrame, named: DataFrame, near: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Pairs (a, b) of ``fp`` that connect all similar sets of ``docs`` and all fingerprints within two bits.

    ``named`` is the ``named_sets`` of ``docs``; ``near`` the ``simhash.links`` of its fingerprints, made here if not given.
    """
    near = simhash.links(stored(named.select("fp").distinct(), "similar-fingerprints")) if near is None else near
    firsts = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]  # of equal sets all are the same
    nodes = stored(named.groupBy("node").agg(F.min("row").alias("row"), F.min_by("key", "row").alias("key"), F.min("fp").alias("fp"), F.max("fp").alias("high"), F.count("*").alias("copies"), *firsts), "similar-nodes")
    equal = named.select("node", F.col("fp").alias("a")).join(nodes.where("fp <> high").select("node", F.col("fp").alias("b")), "node").where("a <> b").select("a", "b").distinct()
    by = Window.partitionBy("g")
    # Rows are shorter names than hashes. Most bands are of one set only. Stored, so that adaptive execution may split a hot key of a join.
    keyed = nodes.select("row", "copies", F.explode("bands").alias("g")).withColumn("lead", F.max(F.struct("copies", "row")).over(by)["row"]).withColumn("sets", F.count("*").over(by))
    keyed = stored(keyed.where("sets > 1 AND lead <> row").select("g", "row", "lead"), "similar-keys")
    sets = nodes.select("row", F.col("fp").alias("root"), F.struct("row", "n", "sketch", "node").alias("set"))
    x, y = (sets.select(F.col("row").alias(at), F.col("root").alias(f"root_{s}"), F.col("set").alias(s)) for s, at in (("x", "row"), ("y", "lead")))
    names = [F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("root_x").alias("root_a"), F.col("root_y").alias("root_b")]

    first = keyed.select("row", "lead").distinct().join(x, "row").join(y, "lead").where(F.expr(f"bit_count(root_x ^ root_y) > {simhash.WITHIN}") & _may_be_similar("x", "y"))
    first = _similar(stored(first.select(*names), "similar-pairs"), nodes, docs, text)
    found = simhash.components(near.select("a", "b").unionByName(equal).unionByName(first))
    roots = nodes.select("row", "fp").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("row", F.coalesce("root", "fp").alias("root"))
    rest = stored(keyed.select("g", "row").join(roots, "row"), "similar-rest")
    mixed = rest.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("g")
    rest = stored(rest.join(mixed, "g", "left_semi").join(sets.select("row", "set"), "row").select("g", "root", "set"), "similar-rest")
    x, y = (rest.select("g", F.col("root").alias(f"root_{s}"), F.col("set").alias(s)) for s in "xy")
    pairs = x.join(y, (x["g"] == y["g"]) & F.expr("x.row < y.row AND root_x <> root_y") & _may_be_similar("x", "y")).select(*names).distinct()
    rest = _similar(stored(pairs, "similar-pairs"), nodes, docs, text)
    return found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)
