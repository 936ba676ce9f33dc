"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of all training tokens once; any number of benchmarks
can be searched in it afterwards. The index is made of segments: each holds some documents
in one row, their words numbered through in one position space, and for every term (named
by a 64-bit hash of the word) the sorted list of its positions, packed. A document lies in
one segment only, so a segment is searched by itself and the list of a term that is
everywhere is never gathered: hot terms are split by document range.

The test items are a stated query set: their windows go to all segments in slices of a
bounded number of words, made, searched and dropped one after the other. In a segment all
windows start from their rarest terms; the lists are shifted by the terms' offsets and
intersected, rarest first, for all windows at once. A proximity match asks for some of the
rarest terms of a window close to each other, in any order; rare is what few documents of
the whole corpus have, and a word of the window that a document lacks does not matter.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
Null and empty texts have no words; items without words have no windows. An item of
fewer words than a window is one window. Items with one id count as one item; null item
ids are named by an empty string. Repeated documents are searched each by themselves.
Document ids may be of any type and keep it. Other columns than id and text are left out
of results; ``drop_contaminated`` returns its rows with all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import private, sliced, stored
from readloom.llm.words import ALNUM, LOWER, pack, split, unpack

WINDOW = 10
#: Words of the test items that are broadcast at once: about 150 bytes a word, 30 MB.
MOST_QUERY_WORDS = 200_000
#: Documents and bytes of text of a segment (a longer text is a segment by itself).
SEGMENT_ROWS, SEGMENT_BYTES = 4_096, 8 << 20
#: Contaminated documents up to which they are broadcast to be dropped.
MOST_BROADCAST = 200_000
#: Positions that the intersection of all windows holds at once.
_AT_ONCE = 1 << 20
#: A proximity match: so many of the rarest terms within the window's length plus so many words.
NEAR_TERMS, SLOP = 4, 5
#: The rarest terms that these may be of.
NEAR_OF = 6
#: Rows of the near table and candidates that are held against a segment at once.
_NEAR_ROWS, _NEAR_PAIRS = 1 << 12, 1 << 14


def hashes(words: pa.Array) -> np.ndarray:
    """The names of distinct words in the index."""
    return np.array([xxhash.xxh3_64_intdigest(x.as_buffer()) for x in words], np.uint64)


@dataclass
class Windows:
    """All windows of the items: ``terms`` is (windows, length), -1 beyond a short window's end."""

    vocabulary: np.ndarray  # hashes of the terms
    terms: np.ndarray
    lengths: np.ndarray
    item: np.ndarray  # of each window
    item_ids: list[str] = field(default_factory=list)
    near: np.ndarray | None = None  # see near_table


def near_table(windows: Windows, documents: np.ndarray, near_terms: int = NEAR_TERMS, near_of: int = NEAR_OF, slop: int = SLOP) -> np.ndarray:
    """What proximity asks for, from the ``documents`` of the corpus that have each term.

    A row is (item, span, terms needed, terms to begin from, rarest terms of the corpus padded
    by -1). Any choice of the needed terms has one of those to begin from.
    """
    rows = set()
    for item, length, terms in zip(windows.item.tolist(), windows.lengths.tolist(), windows.terms.tolist(), strict=True):
        own = dict.fromkeys(terms[:length])
        need = min(near_terms, len(own))
        chosen = sorted((t for t in own if documents[t]), key=lambda t: documents[t])[:near_of]
        if len(chosen) >= need:
            rows.add((item, length + slop, need, len(chosen) - need + 1, *chosen, *[-1] * (near_of - len(chosen))))
    return np.array(sorted(rows), np.int64).reshape(-1, 4 + near_of)


def make_windows(items: list[tuple[str, str]], size: int = WINDOW) -> Windows:
    w = split(pa.array([t or "" for _, t in items], pa.large_string()), ALNUM, LOWER)
    coded = w.words.dictionary_encode()
    ids, names = coded.indices.to_numpy(zero_copy_only=False), sorted({n for n, _ in items})
    number = {n: i for i, n in enumerate(names)}
    rows, lengths, of = [], [], []
    for i, (name, _) in enumerate(items):
        own = ids[w.bounds[i] : w.bounds[i + 1]]
        if len(own) >= size:
            rows.append(np.lib.stride_tricks.sliding_window_view(own, size))
        elif len(own):
            rows.append(np.concatenate([own, np.full(size - len(own), -1)])[None, :])
        else:
            continue
        lengths.append(np.full(len(rows[-1]), min(len(own), size)))
        of.append(np.full(len(rows[-1]), number[name]))
    if not rows:
        return Windows(hashes(coded.dictionary), np.zeros((0, size), np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), names)
    table = np.unique(np.column_stack([np.concatenate(of), np.concatenate(lengths), np.concatenate(rows)]).astype(np.int32), axis=0)
    return Windows(hashes(coded.dictionary), table[:, 2:], table[:, 1], table[:, 0], names)


@dataclass
class Segment:
    """Positions of terms in some documents. ``starts`` bounds each document's positions, ``bounds`` each term's list."""

    starts: np.ndarray
    terms: np.ndarray  # ascending
    bounds: np.ndarray
    postings: np.ndarray

    def of(self, vocabulary: np.ndarray) -> Segment:
        """Only the lists of these terms, which are named by their places from now on."""
        at = np.minimum(np.searchsorted(self.terms, vocabulary), max(0, len(self.terms) - 1))
        own = np.flatnonzero(self.terms[at] == vocabulary) if len(self.terms) else np.zeros(0, np.int64)
        which, _ = _ranges(self.bounds[at[own]], self.bounds[at[own] + 1])
        sizes = self.bounds[at[own] + 1] - self.bounds[at[own]]
        return Segment(self.starts, own, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), self.postings[which])


def build_segment(texts: pa.Array) -> Segment:
    w = split(texts, ALNUM, LOWER)
    coded = w.words.dictionary_encode()
    names = hashes(coded.dictionary)
    order = np.argsort(names)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    own = place[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int32)
    return Segment(w.bounds.astype(np.int64), names[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(order)))]).astype(np.int64), np.argsort(own, kind="stable"))


def search_segment(segment: Segment, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Exact matches: windows and first positions. ``segment`` has the windows' terms only."""
    counts = np.zeros(len(windows.vocabulary) + 1, np.int64)
    first = np.zeros(len(windows.vocabulary) + 1, np.int64)
    counts[segment.terms] = np.diff(segment.bounds)
    first[segment.terms] = segment.bounds[:-1]
    counts[-1] = np.iinfo(np.int64).max  # the filler of short windows comes last
    present = np.flatnonzero((counts[windows.terms] > 0).all(axis=1))  # a phrase needs all of its words
    total = int(segment.starts[-1]) + 1
    keys = np.repeat(segment.terms, np.diff(segment.bounds)) * total + segment.postings
    order = np.argsort(counts[windows.terms[present]], axis=1, kind="stable")
    rarest = np.take_along_axis(windows.terms[present].astype(np.int64), order, axis=1)  # their products exceed 32 bits
    found_w, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.cumsum(counts[rarest[:, 0]]) if len(present) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(present):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _AT_ONCE, side="right")))
        t = rarest[lo:hi, 0]
        at, which = _ranges(first[t], first[t] + counts[t])
        which += lo
        starts = segment.postings[at] - order[which, 0]
        for k in range(1, windows.terms.shape[1]):
            t, p = rarest[which, k], order[which, k]
            asked = t * total + starts + p
            i = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
            ok = (t < 0) | ((starts + p >= 0) & (starts + p < total) & (keys[i] == asked))
            which, starts = which[ok], starts[ok]
        # A phrase ends in the document where it begins.
        inside = starts >= 0
        which, starts = which[inside], starts[inside]
        document = np.minimum(np.searchsorted(segment.starts, starts, side="right"), len(segment.starts) - 1)
        inside = starts + windows.lengths[present[which]] <= segment.starts[document]
        found_w.append(present[which[inside]])
        found_s.append(starts[inside])
        lo = hi
    return np.concatenate(found_w), np.concatenate(found_s)


def search_near(segment: Segment, near: np.ndarray, vocabulary: int) -> np.ndarray:
    """Proximity matches (item, document): some term to begin from has enough of the row's terms less than its span away."""
    found = [np.zeros((0, 2), np.int64)]
    n, total = len(segment.starts) - 1, max(1, int(segment.starts[-1]))
    term = np.repeat(segment.terms.astype(np.int64), np.diff(segment.bounds))
    keys = term * total + segment.postings
    held = np.unique(term * n + np.searchsorted(segment.starts, segment.postings, side="right") - 1)
    term, document = held // max(1, n), held % max(1, n)
    for part in (near[i : i + _NEAR_ROWS] for i in range(0, len(near) if len(held) else 0, _NEAR_ROWS)):
        chosen = part[:, 4:]
        order = np.argsort(chosen, axis=None, kind="stable")
        ends = np.searchsorted(chosen.ravel()[order], np.arange(vocabulary + 1))
        at, some = _ranges(ends[term], ends[term + 1])
        pairs, times = np.unique(document[some] * len(part) + order[at] // chosen.shape[1], return_counts=True)
        pairs = pairs[times >= part[pairs % len(part), 2]]
        for i in range(0, len(pairs), _NEAR_PAIRS):
            d, row = pairs[i : i + _NEAR_PAIRS] // len(part), part[pairs[i : i + _NEAR_PAIRS] % len(part)]
            slot, which = _ranges(np.zeros(len(row), np.int64), row[:, 3])
            base = row[which, 4 + slot] * total
            at, some = _ranges(np.searchsorted(keys, base + segment.starts[d[which]]), np.searchsorted(keys, base + segment.starts[d[which] + 1]))
            which = which[some]
            place, span, low, high = keys[at] - base[some], row[which, 1], segment.starts[d[which]], segment.starts[d[which] + 1]
            met = np.zeros(len(which), np.int64)
            for t in row[which, 4:].T:
                after = np.searchsorted(keys, t * total + place)
                before = keys[np.maximum(after - 1, 0)]
                close = (after > 0) & (before >= t * total + np.maximum(low, place - span + 1)) & (before <= t * total + place)
                close |= (after < len(keys)) & (keys[np.minimum(after, len(keys) - 1)] <= t * total + np.minimum(high, place + span) - 1)
                met += close & (t >= 0)
            which = which[met >= row[which, 2]]
            found.append(np.column_stack([row[which, 0], d[which]]))
    return np.unique(np.concatenate(found), axis=0)


def _ranges(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    sizes = highs - lows
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) + (lows - np.cumsum(sizes) + sizes)[which], which


def hits(segment: Segment, windows: Windows) -> tuple[list[np.ndarray], list[set[str]], list[set[str]]]:
    """For each document: its hit positions, the items found exactly, the items found near."""
    n = len(segment.starts) - 1
    own = segment.of(windows.vocabulary)
    positions: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    items: list[set[str]] = [set() for _ in range(n)]
    close: list[set[str]] = [set() for _ in range(n)]
    which, starts = search_segment(own, windows)
    documents = np.searchsorted(segment.starts, starts, side="right") - 1
    for d, item in np.unique(np.column_stack([documents, windows.item[which]]), axis=0).tolist():
        items[d].add(windows.item_ids[item])
    at, of = _ranges(starts, starts + windows.lengths[which])
    covered = np.unique(at)
    for d in np.unique(documents).tolist():
        lo, hi = segment.starts[d], segment.starts[d + 1]
        positions[d] = covered[np.searchsorted(covered, lo) : np.searchsorted(covered, hi)] - lo
    for item, d in [] if windows.near is None else search_near(own, windows.near, len(windows.vocabulary)).tolist():
        close[d].add(windows.item_ids[item])
    return positions, items, close


def query_slices(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text", most: int = MOST_QUERY_WORDS) -> Iterator[Windows]:
    """The items' windows, in slices of at most ``most`` words each (or one item); one slice at a time is on the driver."""
    held: list[tuple[str, str]] = []
    words = 0
    for name, body in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        some = len(body) // 2 + 1
        if held and words + some > most:
            yield make_windows(held, size)
            held, words = [], 0
        held.append((name, body))
        words += some
    if held:
        yield make_windows(held, size)


INDEX = [T.StructField("segment", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("starts", "terms", "bounds", "postings", "documents"))]


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SEGMENT_ROWS, most: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index: a row for each segment, with the postings of all tokens, the ids of its documents and ``keys``, hashes of their texts."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(sliced(batches, "body", rows, most), TaskContext.get().partitionId() << 33):
            s = build_segment(batch.column("body"))
            of = np.searchsorted(s.starts, s.postings, side="right")
            new = np.append(True, of[1:] != of[:-1])[: len(of)]
            new[s.bounds[:-1]] = True
            documents = np.add.reduceat(new, s.bounds[:-1], dtype=np.int32) if len(of) else np.zeros(0, np.int32)
            postings = s.postings.astype(np.int64)
            postings[1:] -= s.postings[:-1]
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("id", "key")]
            packed = (pack(np.diff(s.starts)), s.terms.tobytes(), pack(np.diff(s.bounds)), pack(postings), pack(documents))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in packed), *lists], [*(f.name for f in INDEX), "doc_ids", "keys"])

    made = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), F.xxhash64(text).alias("key")).mapInArrow(run, T.StructType([*INDEX, T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("keys", T.ArrayType(T.LongType()))]))
    return stored(made, "postings")


def _opened(row: dict) -> Segment:
    starts, bounds = (np.concatenate([[0], np.cumsum(unpack(row[c]).astype(np.int64))]) for c in ("starts", "bounds"))
    return Segment(starts, np.frombuffer(row["terms"], np.uint64), bounds, np.cumsum(unpack(row["postings"]).view(np.int64)))


def document_frequencies(index: DataFrame, windows: Windows) -> np.ndarray:
    """In how many documents of the whole corpus each term of the items is."""
    shared = index.sparkSession.sparkContext.broadcast(windows.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, documents in zip(*(batch.column(c) for c in ("terms", "documents")), strict=True):
                terms, documents = np.frombuffer(terms.as_buffer(), np.uint64), unpack(documents.as_buffer())
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, shared.value), len(terms) - 1)
                    found += np.where(terms[at] == shared.value, documents[at].astype(np.int64), 0)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["term", "n"])

    found = index.select("terms", "documents").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(windows.vocabulary), np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    shared.unpersist()
    return out


FOUND = [
    T.StructField("key", T.LongType()),
    T.StructField("segment", T.LongType()),
    T.StructField("place", T.IntegerType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("near_items", T.ArrayType(T.StringType())),
]


def search_index(index: DataFrame, windows: Windows, only_found: bool = False) -> tuple[DataFrame, Broadcast]:
    """A row for each document (or, for each that was found): its number of words, the positions hit, the items found exactly and near."""
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                s = _opened({f.name: row[f.name].as_buffer() for f in INDEX[1:]})
                positions, items, near = hits(s, shared.value)
                n, strings = len(positions), pa.list_(pa.string())
                made = [row["doc_ids"].values, row["keys"].values, pa.array([row["segment"].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(np.diff(s.starts)), pa.array([p.tolist() for p in positions], pa.list_(pa.int64())), pa.array([sorted(x) for x in items], strings), pa.array([sorted(x) for x in near], strings)]
                out = pa.RecordBatch.from_arrays(made, ["doc_id", *(f.name for f in FOUND)])
                yield out.filter(pa.array([bool(x or y) for x, y in zip(items, near, strict=True)], pa.bool_())) if only_found else out

    kind = index.schema["doc_ids"].dataType.elementType
    return index.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *FOUND])), shared


def _searched(index: DataFrame, benchmark: DataFrame, size: int, most: int, near: bool, only_found: bool) -> DataFrame:
    """All slices one after the other. A single slice is searched as the result is read; several are stored each and put together by (segment, place)."""
    slices = query_slices(benchmark, size, most=most)
    now, later = next(slices, None), next(slices, None)
    now = make_windows([], size) if now is None else now
    if near:
        now.near = near_table(now, document_frequencies(index, now))
    if later is None:
        return search_index(index, now, only_found)[0]
    parts = None
    while now is not None:
        found, shared = search_index(index, now, only_found=True)
        found = stored(found, "found")
        shared.unpersist()
        parts = found if parts is None else parts.unionByName(found)
        now, later = later, next(slices, None)
        if now is not None and near:
            now.near = near_table(now, document_frequencies(index, now))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = parts.groupBy("segment", "place").agg(*(F.first(c).alias(c) for c in ("doc_id", "key", "n_words")), *(merged(c) for c in ("hits", "items", "near_items")))
    if only_found:
        return found
    every, _ = search_index(index, make_windows([], size))
    found = found.select("segment", "place", "hits", "items", "near_items")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return every.drop("hits", "items", "near_items").join(found, ["segment", "place"], "left").select("doc_id", "key", "segment", "place", "n_words", *(none(c) for c in ("hits", "items", "near_items")))


def search(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MOST_QUERY_WORDS) -> DataFrame:
    """doc_id, n_words, hits (positions), items and near_items of every document of a stored ``index``."""
    return _searched(index, benchmark, size, most, near=True, only_found=False).select("doc_id", "n_words", "hits", "items", "near_items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MOST_QUERY_WORDS) -> DataFrame:
    """Index and search in one."""
    return search(build_index(docs), benchmark, size, most)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, most: int = MOST_QUERY_WORDS) -> DataFrame:
    """``docs`` without those in which an item's window occurs: indexed, searched and dropped by id and text."""
    index = build_index(docs, doc_id, text)
    found = _searched(index, benchmark, size, most, near=False, only_found=True)
    bad = stored(found.select(F.col("doc_id").alias("id"), "key").distinct(), "contaminated")
    if bad.count() <= MOST_BROADCAST:
        bad = F.broadcast(bad)
    own_id, own_key = private(docs, "bad_id", "bad_key")
    bad = bad.withColumnsRenamed({"id": own_id, "key": own_key})
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(text)) == F.col(own_key)), "left_anti")
