"""SimHash near-dedup with pivot distance tables.

Each distinct fingerprint gets a table of its Hamming distances to fixed reference
fingerprints, the pivots. The tables find candidates, discard pairs, and only survivors
are compared bit by bit:

* Pivots come in groups. Those of a group differ from the first pivot within the group's
  bits only, so two fingerprints that agree there have equal distances relative to the
  first pivot. ``within`` changed bits touch at most as many groups: linked fingerprints
  share the relative distances of some choice of the other groups, which is the key of a
  cell. Cells of more than ``most`` fingerprints are divided by further pivots, whose
  groups are finer, in the same way; so divided, a cell holds a few hundred at the most.
* Within a cell, by the triangle inequality, distances of linked fingerprints differ by
  ``within`` at most in every coordinate: a pair whose largest difference exceeds it goes.

A cell reports its links as stars, one row for each member that is not alone, which
connect the same fingerprints. Components follow by alternating star contraction.

Copies of a fingerprint are one node. Texts without words have fingerprint zero, null
texts among them. A null id is never the smallest unless its component has no other.
Ids may be of any type that can be ordered; other columns are kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import private, sliced, stored
from readloom.llm.words import LOWER, NOT_SPACE, mix, split

SHINGLE, SEED, WITHIN = 3, 42, 2
#: Groups of bits and pivots of each group: the first division into cells, and the division of crowded ones.
GROUPS, PER_GROUP = 4, 12
FINE_GROUPS = 16
#: Fingerprints of a cell that are held against each other; larger cells are divided by further pivots.
MOST_PAIRED = 32
#: Rows that are dropped up to which they are broadcast.
MOST_BROADCAST = 200_000
#: Pairs of one cell, or of cells of one size, whose tables are compared at once.
_PAIRS = 1 << 18
_SLICE = 1 << 15


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints as signed integers."""
    w = split(column, NOT_SPACE, LOWER)
    keep = NOT_SPACE[w.data]
    inner = w.ends < len(w.data)
    apart = np.zeros(len(w.ends), bool)  # a separator after each word, but not between texts without one
    apart[inner] = ~keep[w.ends[inner]]
    keep[w.ends[apart]] = True
    joined = w.data[keep]
    joined[~NOT_SPACE[joined]] = 0x20
    joined = joined.tobytes()
    del keep
    starts = np.zeros(len(w.ends), w.ends.dtype)
    np.cumsum((w.ends - w.starts + apart)[:-1], out=starts[1:])
    ends = starts + w.ends - w.starts
    n_words = np.diff(w.bounds)
    counts = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    out = np.zeros(len(n_words), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    row, rows = 0, len(n_words)
    while row < rows:  # rows together up to a bound; a longer row by itself, in slices
        upto, some = row, 0
        while upto < rows and (upto == row or some + counts[upto] <= _SLICE):
            some += counts[upto]
            upto += 1
        lo = w.bounds[row]
        if upto == row + 1 and some > _SLICE:
            sums = np.zeros(64, np.int64)
            for i in range(0, some, _SLICE):
                j = min(some, i + _SLICE)
                sums += _bits([digest(joined[a:b], seed) for a, b in zip(starts[lo + i : lo + j].tolist(), ends[lo + i + shingle - 1 : lo + j + shingle - 1].tolist(), strict=True)]).sum(axis=0, dtype=np.int64)
            out[row] = weights[2 * sums > some].sum()
        elif some:
            own = counts[row:upto]
            first = np.repeat(w.bounds[row:upto], own) + np.arange(some) - np.repeat(np.cumsum(own) - own, own)
            last = np.minimum(first + shingle, np.repeat(w.bounds[row + 1 : upto + 1], own)) - 1
            bits = _bits([digest(joined[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)])
            full = np.flatnonzero(own)
            sums = np.add.reduceat(bits, (np.cumsum(own) - own)[full], axis=0, dtype=np.int32)
            out[row + full] = ((2 * sums > own[full][:, None]) * weights).sum(axis=1, dtype=np.uint64)
        row = upto
    return out.view(np.int64)


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and the fingerprint as a signed long."""
    keep = docs.columns if keep is None else keep
    keep = [c for c in keep if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fingerprints(batch.column(text)))], [*keep, to])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(to, T.LongType())]))


@cache
def pivots() -> tuple[np.ndarray, dict[str, list[np.ndarray]]]:
    """The reference fingerprints, the first of which all others begin from, and the places of each group's."""
    first = mix(np.arange(1, 2, dtype=np.uint64))
    found, places = [first], {"coarse": [], "fine": []}

    def group(kind: str, patterns: np.ndarray) -> None:
        places[kind].append(np.arange(len(patterns)) + sum(map(len, found)))
        found.append(first ^ patterns)

    width, one = 64 // GROUPS, np.uint64(1)
    for g in range(GROUPS):
        mask = ((one << np.uint64(width)) - one) << np.uint64(g * width)
        group("coarse", mix(np.arange(PER_GROUP, dtype=np.uint64) + np.uint64(1000 * (g + 1))) & mask)
    width = 64 // FINE_GROUPS
    for g in range(FINE_GROUPS):
        group("fine", one << np.arange(g * width, (g + 1) * width, dtype=np.uint64))
    return np.concatenate(found), places


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: (fingerprints, pivots)."""
    return np.bitwise_count(fps.view(np.uint64)[..., None] ^ pivots()[0]).astype(np.int8)


def _relative(table: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """(fingerprints, groups): a hash of the distances to each group's pivots, relative to the first pivot."""
    out = np.zeros((len(table), len(places)), np.uint64)
    for g, at in enumerate(places):
        factors = mix(at.astype(np.uint64)) | np.uint64(1)
        apart = (table[:, at].astype(np.int64) - table[:, :1]).view(np.uint64)
        out[:, g] = mix((apart * factors).sum(axis=1, dtype=np.uint64))
    return out


def cells(fps: np.ndarray, within: int = WITHIN) -> tuple[np.ndarray, np.ndarray]:
    """(choices, fingerprints) cell keys: one choice of groups that may hold all changes after the other; and the choice of each."""
    apart = _relative(distances(fps), pivots()[1]["coarse"])
    choices = list(itertools.combinations(range(GROUPS), within))
    keys = [mix(np.delete(apart, c, axis=1) * (mix(np.arange(GROUPS - within, dtype=np.uint64) + np.uint64(7)) | np.uint64(1))).sum(axis=1, dtype=np.uint64) for c in choices]
    return np.array(keys, np.uint64).view(np.int64), np.arange(len(choices), dtype=np.int16)


def divided(fps: np.ndarray, which: np.ndarray, keys: np.ndarray, within: int = WITHIN) -> np.ndarray:
    """(choices, fingerprints) keys of the finer cells: of the groups that may hold changes all finer groups but ``within`` agree."""
    apart = _relative(distances(fps), pivots()[1]["fine"])
    coarse, per = list(itertools.combinations(range(GROUPS), within)), FINE_GROUPS // GROUPS
    open_ = np.array([[g * per + k for g in c for k in range(per)] for c in coarse])[which]  # (fingerprints, finer groups)
    own = np.take_along_axis(apart, open_, axis=1) * (mix(np.arange(open_.shape[1], dtype=np.uint64) + np.uint64(77)) | np.uint64(1))
    out = []
    for i, c in enumerate(itertools.combinations(range(open_.shape[1]), within)):
        out.append(mix(np.delete(own, c, axis=1).sum(axis=1, dtype=np.uint64) ^ mix(keys.view(np.uint64) + np.uint64(i))))
    return np.array(out, np.uint64).view(np.int64)


def linked(values: np.ndarray, within: int = WITHIN) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Stars (root, member) of (cells, members) fingerprints; the number of pairs, and of those the tables leave."""
    n, m = values.shape
    table = distances(values)
    near = np.ones((n, m, m), bool)
    for k in range(table.shape[2]):
        near &= np.abs(table[:, :, None, k] - table[:, None, :, k]) <= within
    left = (int(near.sum()) - n * m) // 2
    near &= np.bitwise_count(values.view(np.uint64)[:, :, None] ^ values.view(np.uint64)[:, None, :]) <= within
    label = np.broadcast_to(np.arange(m), (n, m))
    while True:  # each takes the smallest label next to it
        least = np.where(near, label[:, None, :], m).min(axis=2)
        if (least == label).all():
            break
        label = np.take_along_axis(least, least, axis=1)
    cell, member = np.nonzero(label != np.arange(m))
    return values[cell, label[cell, member]], values[cell, member], n * m * (m - 1) // 2, left


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("fps")
        at, flat = column.offsets.to_numpy(), column.values.to_numpy()
        sizes = np.diff(at)
        for m in np.unique(sizes).tolist():
            rows = at[:-1][sizes == m]
            for i in range(0, len(rows), max(1, _PAIRS // (m * m))):
                part = rows[i : i + max(1, _PAIRS // (m * m))]
                a, b, _, _ = linked(np.sort(flat[part[:, None] + np.arange(m)], axis=1))  # the smallest is the root, which saves rounds later
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(nodes: DataFrame, most: int = MOST_PAIRED) -> DataFrame:
    """Pairs (a, b) that connect all of ``nodes`` (distinct fp) within ``WITHIN`` bits."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            keys, which = cells(fps)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(which, len(fps))), pa.array(keys.ravel()), pa.array(np.tile(fps, len(which)))], ["which", "key", "fp"])

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for keys in divided(fps, batch.column("which").to_numpy(), batch.column("key").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], ["key", "fp"])

    # Stored, so that both sides of the join are exchanged anew and adaptive execution may split a hot key.
    first = stored(nodes.select("fp").mapInArrow(keyed, "which smallint, key long, fp long"), "simhash-cells")
    sizes = stored(first.groupBy("which", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    member = stored(first.join(sizes, ["which", "key"]), "simhash-members")
    small = member.where(F.col("n") <= most).groupBy("which", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    crowded = member.where(F.col("n") > most).select("which", "key", "fp").mapInArrow(finer, "key long, fp long")
    fine = crowded.groupBy("key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")
    return small.unionByName(fine).mapInArrow(_stars, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): root is the smallest node of the component.

    Large-star and small-star steps in turn until nothing changes; the links are
    written to the shared folder after each round.
    """
    now, was = stored(edges.select("a", "b"), "links"), None
    if now.isEmpty():
        return now.withColumnsRenamed({"a": "node", "b": "root"})
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(_anew(least, "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(_anew(low, "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now = stored(small, "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.count_distinct("a"), F.count_if(F.col("b") > F.col("a"))).first()
        if tuple(state) == was and state[0] == state[2]:
            break
        was = tuple(state)
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def _anew(df: DataFrame, key: str) -> DataFrame:
    """Hides that ``df`` is already dealt by ``key``: a join then exchanges both sides, and adaptive execution may split a hot key."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(1).cast("long"))).withColumn(key, F.col(key).bitwiseXOR(F.lit(1).cast("long")))


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node (fp) with the root of its component."""
    found = components(edges).withColumnRenamed("node", "fp")
    return nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def dedup_components(hashed: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``hashed`` (a stored table) with ``component_id``: the smallest id reachable over links."""
    nodes = stored(hashed.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "simhash-nodes")
    rooted = stored(_rooted(nodes, links(nodes.select("fp"))), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.select("fp", "root").join(_anew(least, "root"), "root").select(F.col("fp").alias(fp), "component_id"), "simhash-components")
    return hashed.drop("component_id").join(named, fp, "left")


def keep_one(docs: DataFrame, named: DataFrame, edges: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id; of several, the first in ``docs``.

    ``named`` has ``row`` (``numbered``), ``key`` (xxhash64 of the text), the id and ``fp`` for every row;
    ``edges`` (a, b) of ``fp`` stand for ``links``. ``docs`` has to be a stored table, so that rows have
    their numbers again; the job fails if they have not. Only rows that go are looked for: texts are
    not dealt anew while those can be broadcast.
    """
    nodes = stored(named.select("fp").distinct(), "simhash-nodes")
    rooted = _rooted(nodes, links(nodes) if edges is None else edges)
    rows = stored(named.select("row", "key", F.col(doc_id).alias("id"), "fp").join(rooted, "fp").select("row", "key", "id", "root"), "simhash-rows")
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("one")).select(F.col("one.row").alias("row"))
    gone = stored(rows.select("row", "key").join(chosen, "row", "left_anti"), "simhash-gone")
    own, key = private(docs, "row", "key")
    gone = (F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone).withColumnsRenamed({"row": own, "key": key})
    stays = F.col(key).isNull() | ~same_row(F.col(key), F.col(text))
    return numbered(docs, own).join(gone, own, "left").where(stays).drop(own, key)


def numbered(docs: DataFrame, to: str = "row") -> DataFrame:
    """``docs`` with a number for every row: the same whenever the same stored table is read."""
    return docs.withColumn(to, F.monotonically_increasing_id())


def same_row(key: Column, text: Column) -> Column:
    """True; fails where the row of this number is not the one that was read before."""
    return F.when(F.xxhash64(text) == key, F.lit(True)).otherwise(F.raise_error(F.lit("rows were numbered otherwise: the documents have to be a stored table")).cast("boolean"))
