"""Quality rules on repetition: how much of a text lies in n-grams and lines it has already had.

Each batch of texts is split at once with numpy; words become exact integers by a
dictionary of the batch, and rolling hashes over the words' 64-bit values give the
n-grams of every length in one pass each. An n-gram found twice or more in a text
covers its words at every occurrence, the first included; covered characters are
counted once per length. Lines are compared exactly.

Null and empty texts have no words, fail the base rules and keep zero shares.
Rows are handled one by one: repeated rows give repeated results. A worker holds about
10 bytes for each byte of one slice of texts, or of one longer text; n-grams are compared
by ranges of their hashes, so that sorting adds little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from readloom.llm.common import sliced
from readloom.llm.words import IDENTITY, NOT_SPACE, mix, raw, split, sums

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: The largest share of a text's word characters inside duplicated n-grams, by length. First occurrences
#: count too, so a short page whose one heading comes again as its footer reaches 0.3 without being junk.
MOST_IN_NGRAMS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: The largest share of word characters in lines that equal an earlier one, and of such lines among those with a word.
MOST_IN_LINES, MOST_LINES = 0.25, 0.40
#: Symbols for each word.
MOST_SYMBOLS = 0.10

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: N-grams that are sorted at once.
_SORTED = 1 << 20


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    out = np.zeros(len(keys), bool)
    ranges = max(1, -(-len(keys) // _SORTED))
    part = np.zeros(len(keys), np.uint16 if ranges < 1 << 16 else np.uint32)
    for i in range(0, len(keys) if ranges > 1 else 0, _SORTED):
        part[i : i + _SORTED] = ((keys[i : i + _SORTED] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    for k in range(ranges):
        own = np.flatnonzero(part == k) if ranges > 1 else np.arange(len(keys))
        order = np.argsort(keys[own])
        same = np.diff(keys[own][order]) == 0
        out[own[order[1:][same]]] = True
        out[own[order[:-1][same]]] = True
    return out


def measures(columns: pa.Array, lengths: list[int]) -> dict[str, np.ndarray]:
    """Counts for each text. ``covered_n``: characters of words inside duplicated n-grams of length n."""
    w = split(columns, NOT_SPACE, IDENTITY)
    n_rows, n_words = len(w.bounds) - 1, np.diff(w.bounds)
    joined, small = w.words.buffers()[2], w.starts.dtype
    offsets = np.frombuffer(w.words.buffers()[1], small)[: len(w.words) + 1]
    chars = sums((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80, offsets, np.int32)
    out = {"n_words": n_words, "word_chars": sums(chars, w.bounds), "n_symbols": sums(SYMBOLS[w.data], w.row_bytes)}
    ids, bounds = w.words.dictionary_encode().indices.to_numpy(zero_copy_only=False), w.bounds
    del w, joined, offsets
    values, seeds = mix(ids.astype(np.uint64) + np.uint64(1)), mix(np.arange(n_rows, dtype=np.uint64) + np.uint64(1 << 40))
    rows = np.repeat(np.arange(n_rows, dtype=np.int32), n_words)
    left = np.repeat(bounds[1:].astype(small), n_words) - np.arange(len(rows), dtype=small)  # words from here to the end of the text
    rolled, n = values.copy(), 1
    for length in sorted({3, *lengths}):
        while n < length:  # h(i, n + 1) = h(i, n) * base + value(i + n)
            rolled = rolled[:-1]
            rolled *= _BASE
            rolled += values[n:]
            n += 1
        whole = np.flatnonzero(left[: len(rolled)] >= length).astype(small)
        covered = np.zeros(len(rows) + 1, np.int32)
        if len(whole):
            keys = mix(rolled[whole])
            keys ^= seeds[rows[whole]]
            starts = whole[repeated(keys)]
            del keys
            covered[starts] += 1
            covered[starts + length] -= 1
        inside = np.cumsum(covered[:-1], dtype=np.int32) > 0
        if length == 3:
            out["n_repeat_words"] = sums(inside, bounds)
        if length in lengths:
            out[f"covered_{length}"] = sums(chars * inside, bounds)
    del values, rolled, rows, left, chars, covered
    # lines
    lines = pc.split_pattern(pc.fill_null(columns, ""), "\n")
    of = pc.list_parent_indices(lines).to_numpy()
    flat = pc.list_flatten(lines)
    line_data, line_bounds = raw(flat)
    solid = sums(NOT_SPACE[line_data] & ((line_data & 0xC0) != 0x80), line_bounds)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    seen = np.ones(len(of), bool)
    if len(of):
        _, first = np.unique(of.astype(np.int64) * (codes.max() + 1) + codes, return_index=True)
        seen[first] = False
    again = seen & (solid > 0)
    out["n_lines"] = np.bincount(of[solid > 0], minlength=n_rows)
    out["n_dup_lines"] = np.bincount(of[again], minlength=n_rows)
    out["dup_line_chars"] = np.bincount(of[again], weights=solid[again], minlength=n_rows).astype(np.int64)
    return out


def quality_rules(docs: DataFrame, text: str = "text", most: dict[int, float] | None = None, least_words: int = 50) -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``reason`` (the first broken rule, null if none) and ``kept``.

    A column of ``docs`` with the name of a measure is replaced.
    """
    most = MOST_IN_NGRAMS if most is None else most
    lengths = sorted(most)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"covered_{n}" for n in lengths)]
    added = [*(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_failed", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("kept", T.BooleanType())]
    new = {f.name for f in added}
    old = [c for c in docs.columns if c == text or c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            m = measures(batch.column(text), lengths)
            words, chars = m["n_words"], np.maximum(m["word_chars"], 1)
            base = (words < least_words) | (100 * m["n_repeat_words"] > 50 * words)
            broken = [("base", base)]
            broken += [(f"repeated {n}-grams", m[f"covered_{n}"] > most[n] * chars) for n in lengths]
            broken += [("repeated lines", (m["dup_line_chars"] > MOST_IN_LINES * chars) | (m["n_dup_lines"] > MOST_LINES * np.maximum(m["n_lines"], 1)))]
            broken += [("symbols", m["n_symbols"] > MOST_SYMBOLS * np.maximum(words, 1))]
            reason = np.full(len(words), None, dtype=object)
            for name, hit in reversed(broken):
                reason[hit] = name
            kept = ~np.logical_or.reduce([hit for _, hit in broken])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in old), *(pa.array(m[c], pa.int64()) for c in counts), pa.array(base), pa.array(reason, pa.string()), pa.array(kept)], [*old, *counts, "base_failed", "reason", "kept"])

    return docs.select(*old).mapInArrow(run, T.StructType([*(docs.schema[c] for c in old), *added]))
