"""Stupid-backoff scores from n-gram counts of the whole corpus, computed relationally.

Texts are cut into segments of a bounded number of words. Each segment sends its
distinct n-grams (64-bit hashes, with their counts: combined before the shuffle) to the
partitions of the count tables, by hash; every partition sums them up to its count table
and joins that to the n-grams it was sent; the counts go back to the segments, where the
scores are summed for each document. A row is a block: the n-grams that one segment sends
to one partition, and only where there are any. So there are never more rows than
n-grams, in proportion to the words; while blocks are long they travel packed: sorted,
as differences, byte by byte, so that they compress. Single words and pairs go first; a
longer n-gram is only sent where both n-grams it is made of occur in other documents,
since it cannot be found elsewhere otherwise. An n-gram that is everywhere comes once
from each segment.

A document is scored by the counts of all others: its own occurrences are taken off,
else every n-gram would be found and nothing would back off. Exact copies of a document
are other documents. Words are maximal runs without ASCII white space. Null and empty
texts have no words and a score of 0. Repeated rows count as often as they come. Ids may
be of any type; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import sliced, small_batches, stored
from readloom.llm.words import IDENTITY, NOT_SPACE, mix, pack, split, unpack

ORDER, BACKOFF = 3, 0.4
#: Words of a segment (a longer text is a segment of its own) and bytes of text behind one partition of the tables.
SEGMENT_WORDS, BUCKET_BYTES = 1_000_000, 4 << 20
#: Blocks of fewer n-grams on average are sent as they are: packing each would cost more than it saves.
LEAST_PACKED = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)

SEGMENT = [T.StructField("segment", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("bounds", "hashes", "words")), T.StructField("n_words", T.LongType())]
BLOCK = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("packed", T.BooleanType()), T.StructField("grams", T.BinaryType()), T.StructField("counts", T.BinaryType())])
ANSWER = T.StructType([T.StructField("segment", T.LongType()), T.StructField("round", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("packed", T.BooleanType()), T.StructField("totals", T.BinaryType()), T.StructField("grams", T.BinaryType())])


def _pieces(values: np.ndarray, ends: np.ndarray, packed: bool) -> pa.Array:
    """A binary value for each piece of ``values``."""
    if packed:
        return pa.array([pack(x) for x in np.split(values, ends[:-1])] if len(ends) else [], pa.binary())
    offsets = np.concatenate([[0], 8 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values.astype("<u8")).tobytes())])


def _whole(data: bytes, packed: bool) -> np.ndarray:
    return unpack(data) if packed else np.frombuffer(data, "<u8")


def runs(values: np.ndarray, inverse: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct values in order, how often each comes, and the number of the distinct value at each place."""
    perm = np.argsort(values) if inverse else None
    ordered = values[perm] if inverse else np.sort(values)
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(first)
    which = None
    if inverse:
        which = np.empty(len(values), np.int64)
        which[perm] = np.cumsum(first) - 1
    return ordered[at], np.diff(at, append=len(values)), which


def n_grams(words: np.ndarray, rows: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order`` the hash of the n-gram that begins at a word; 0 where it leaves the text."""
    out = [np.maximum(mix(words), np.uint64(1))]
    for n in range(2, order + 1):
        grown = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            inside = rows[: len(rows) - n + 1] == rows[n - 1 :]
            grown[: len(words) - n + 1] = np.where(inside, np.maximum(mix(out[-1][: len(words) - n + 1] * _STEP + words[n - 1 :]), np.uint64(1)), 0)
        out.append(grown)
    return out


def segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = SEGMENT_WORDS) -> DataFrame:
    """The corpus as a stored table of words by number, a row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, []
        size = 0

        def out() -> pa.RecordBatch:
            ids = pa.chunked_array([x for x, _, _, _ in held]).combine_chunks()
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([b for _, b, _, _ in held]))]).astype("<u8")
            hashes, often, words = runs(np.concatenate([h[c] for _, _, h, c in held]), inverse=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small numbers
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            hashes, words = hashes[order], place[words]
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (pack(bounds), hashes.tobytes(), pack(words))), pa.array([len(words)], pa.int64()), listed], [*(f.name for f in SEGMENT), "doc_ids"])

        for batch in sliced(batches, "body"):
            w = split(batch.column("body"), NOT_SPACE, IDENTITY)
            coded = w.words.dictionary_encode()
            hashes = np.array([xxhash.xxh3_64_intdigest(x.as_buffer()) for x in coded.dictionary], np.uint64)
            held.append((batch.column("id"), np.diff(w.bounds), hashes, coded.indices.to_numpy(zero_copy_only=False)))
            size += len(w.words)
            if size >= most:
                yield out()
                number, held, size = number + 1, [], 0
        if held:
            yield out()

    kind = T.StructType([*SEGMENT, T.StructField("doc_ids", T.ArrayType(docs.schema[doc_id].dataType))])
    return stored(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).mapInArrow(run, kind), "segments")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One at a time: a row is a segment. Ids stay an Arrow array."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        ids = row.column("doc_ids")[0].values
        yield row.drop_columns(["doc_ids"]).to_pylist()[0] | {"doc_ids": ids}


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the documents, word hashes, document of each word."""
    bounds = unpack(row["bounds"]).astype(np.int64)
    words = np.frombuffer(row["hashes"], np.uint64)[unpack(row["words"]).astype(np.int64)]
    return bounds, words, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key, so that a sorted list falls into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def rounds(order: int) -> list[list[int]]:
    """The lengths that are counted together."""
    return [list(range(1, min(order, 2) + 1)), *([n] for n in range(3, order + 1))]


def look_up(row: dict, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Bounds of the documents; by length, for the word where an n-gram begins, its hash (0: not to be
    counted) and its count in other documents, as far as the row's answers go."""
    bounds, words, rows = _read(row)
    answered = {}
    for a in sorted(row["answers"], key=lambda a: (a["round"], a["bucket"])):
        answered.setdefault(a["round"], []).append(_whole(a["totals"], a["packed"]))
    seeds = mix(rows.astype(np.uint64) + np.uint64(1 << 40))
    grams, others = n_grams(words, rows, order), []
    for number, lengths in enumerate(rounds(order)):
        for n in lengths:
            if n > 2:
                both = np.zeros(len(words), bool)
                both[:-1] = (others[n - 2][:-1] > 0) & (others[n - 2][1:] > 0)
                grams[n - 1] = np.where(both, grams[n - 1], np.uint64(0))
        if number not in answered:
            break
        every = np.concatenate([grams[n - 1] for n in lengths])
        some = np.flatnonzero(every)
        keys, _, which = runs(every[some], inverse=True)
        totals = np.concatenate(answered[number]).astype(np.int64)
        assert len(totals) == len(keys)
        # What the document itself has of an n-gram comes off; one that comes once in all needs no look.
        here, other = totals[which], np.zeros(len(every), np.int64)
        again = np.flatnonzero(here > 1)
        _, own, place = runs(every[some[again]] ^ seeds[some[again] % max(1, len(words))], inverse=True)
        other[some[again]] = here[again] - own[place]
        others += list(other.reshape(len(lengths), -1))
    return bounds, grams, others


def _blocks(order: int, buckets: int, number: int):
    """The n-grams of one round, a row for each segment and partition of the count tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, grams, _ = look_up(row, order)
                every = np.concatenate([grams[n - 1] for n in rounds(order)[number]])
                keys, counts, _ = runs(every[every > 0])
                own, first = np.unique(_bucket(keys, buckets), return_index=True)
                ends = np.append(first[1:], len(keys))
                packed = len(keys) >= LEAST_PACKED * len(own)
                if packed:  # as differences within each block
                    steps = np.diff(keys, prepend=np.uint64(0))
                    steps[first] = keys[first]
                    keys = steps
                some = 64 if packed else 1 << 16
                for i in range(0, len(own), some):
                    a, upto = first[i], ends[i : i + some]
                    n = len(upto)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(own[i : i + n].astype(np.int64)), pa.array(np.full(n, row["segment"], np.int64)), pa.array(np.full(n, packed)), _pieces(keys[a : upto[-1]], upto - a, packed), _pieces(counts[a : upto[-1]], upto - a, packed)], BLOCK.names)

    return run


def count_and_join(table: pa.Table) -> pa.Table:
    """One partition of the count tables: sums each n-gram and gives every sender its n-grams' totals."""
    packed, grams, counts = (table.column(c).to_pylist() for c in ("packed", "grams", "counts"))
    keys = [np.cumsum(unpack(g), dtype=np.uint64) if p else np.frombuffer(g, "<u8") for g, p in zip(grams, packed, strict=True)]
    grams_, _, which = runs(np.concatenate(keys), inverse=True)
    sums = np.bincount(which, weights=np.concatenate([_whole(c, p) for c, p in zip(counts, packed, strict=True)])).astype(np.uint64)
    totals = sums[which]
    ends = np.cumsum([len(k) for k in keys])
    answers = [pack(totals[e - len(k) : e]) if p else totals[e - len(k) : e].tobytes() for e, k, p in zip(ends, keys, packed, strict=True)]
    none = pa.nulls(len(answers), pa.binary())
    found = table.select(["segment", "round", "bucket", "packed"]).append_column("totals", pa.array(answers, pa.binary())).append_column("grams", none)
    # The partition itself, without a segment; what came once is found nowhere else and left out.
    often = sums > 1
    own = [pa.array([None], pa.int64()), table.column("round").slice(0, 1).combine_chunks(), table.column("bucket").slice(0, 1).combine_chunks(), pa.array([True]), pa.array([pack(sums[often])], pa.binary()), pa.array([pack(np.diff(grams_[often], prepend=np.uint64(0)))], pa.binary())]
    return pa.concat_tables([found, pa.table(own, ANSWER.names)])


def score_segment(row: dict, order: int, total_words: int, backoff: float) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, words, summed log scores, and words found at each length ((documents, order))."""
    bounds, _, others = look_up(row, order)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # A round without answers sent nothing: its n-grams are in no other document.
    others += [np.zeros(len(rows), np.int64)] * (order - len(others))
    sizes = np.diff(bounds)
    rest = (total_words - sizes)[rows].astype(np.float64)
    place = np.arange(len(rows)) - bounds[:-1][rows]
    score, open_ = np.zeros(len(rows)), np.ones(len(rows), bool)
    found = np.zeros((len(sizes), order), np.int64)
    penalty = np.zeros(len(rows))
    for n in range(order, 0, -1):
        ending = np.flatnonzero(open_ & (place >= n - 1))
        have = others[n - 1][ending - n + 1]
        under = others[n - 2][ending - n + 1].astype(np.float64) if n > 1 else rest[ending]
        hit = have > 0
        at = ending[hit]
        score[at] = penalty[at] + np.log(have[hit] / under[hit])
        found[:, n - 1] = np.bincount(rows[at], minlength=len(sizes))
        open_[at] = False
        penalty[ending[~hit]] += math.log(backoff)
    score[open_] = penalty[open_] - np.log(rest[open_] + 1)
    return row["doc_ids"], sizes, np.bincount(rows, weights=score, minlength=len(sizes)), found


def _joined(docs: DataFrame, order: int, doc_id: str, text: str, segment_words: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """The segments with their n-grams' counts, the stored count tables and answers, and the words of the corpus."""
    cut = segments(docs, doc_id, text, segment_words)
    words = cut.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-words * 6 // bucket_bytes))
    names, sent = cut.columns, [c for c in ANSWER.names[1:] if c != "grams"]
    none = F.array().cast(T.ArrayType(T.StructType([ANSWER[c] for c in sent])))
    known, joined = None, cut.withColumn("answers", none)
    for number in range(len(rounds(order))):
        blocks = joined.mapInArrow(_blocks(order, buckets, number), BLOCK)
        with small_batches(docs.sparkSession):
            answers = stored(blocks.groupBy("round", "bucket").applyInArrow(count_and_join, ANSWER), "counts")
        known = answers if known is None else known.unionByName(answers)
        gathered = known.where(F.col("segment").isNotNull()).groupBy("segment").agg(F.collect_list(F.struct(*sent)).alias("answers"))
        joined = cut.join(gathered, "segment", "left").select(*names, F.coalesce("answers", none).alias("answers"))
    return joined, known, words


def count_tables(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The count tables: round (0: words and pairs), bucket (the partition), gram (hash) and total, of n-grams that came twice or more."""
    _, known, _ = _joined(docs, order, doc_id, text, segment_words, bucket_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grams = np.cumsum(unpack(r["grams"]), dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), r["round"], np.int32)), pa.array(np.full(len(grams), r["bucket"], np.int64)), pa.array(grams), pa.array(unpack(r["totals"]).astype(np.int64))], ["round", "bucket", "gram", "total"])

    return known.where(F.col("segment").isNull()).select("round", "bucket", "grams", "totals").mapInArrow(run, "round int, bucket long, gram long, total long")


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (sum), mean_log_score, and found_n: words found by an n-gram of that length."""
    joined, _, words = _joined(docs, order, doc_id, text, segment_words, bucket_bytes)
    kind = joined.schema["doc_ids"].dataType.elementType
    shape = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType()), *(T.StructField(f"found_{n}", T.LongType()) for n in range(1, order + 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids, sizes, sums, found = score_segment(row, order, words, backoff)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sums), pa.array(sums / np.maximum(sizes, 1)), *(pa.array(found[:, n]) for n in range(order))], shape.names)

    with small_batches(docs.sparkSession):  # a few numbers for each document
        return stored(joined.mapInArrow(run, shape), "scores")
