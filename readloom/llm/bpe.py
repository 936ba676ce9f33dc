"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk + overlap`` characters is cut into overlapping chunks
that are pre-tokenised in parallel, each from its own start. Neighbouring chunks
are stitched at the first pre-token boundary that both have inside their overlap:
the pattern only looks forward, so from a common boundary on both go on alike.
The pieces between the stitches are encoded in parallel and their ids joined in
order. Where some neighbours share no boundary (one endless run of letters), the
whole text is encoded as one piece. Decoding concatenates the tokens' raw bytes.

Null and empty texts have no tokens. Rows are never matched by a key of the input,
so repeated rows and repeated keys stay apart. Long rows are numbered in their scan, so
the input has to be a stored table or a deterministic plan over one: a task that is run
again then numbers its rows alike. Columns are kept by name (``keep``); one named like an
added column is left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import sliced

CHUNK, OVERLAP = 16_384, 1_024
#: A pre-token that ends this close to a cut could have gone on (the longest alternatives look 3 characters ahead).
MARGIN = 4
#: Characters that are left to the library's own splitting; the same pattern splits longer texts. Both give the same ids.
LONGEST = 1 << 20
_KNOWN = 1 << 16

_codecs: dict[str, Codec] = {}


class Codec:
    """An encoder of one vocabulary; one per Python worker."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("readloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("readloom-piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) > LONGEST:
            return self.encode_pieces(text)
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def encode_pieces(self, text: str) -> bytes:
        """The same ids, pre-token by pre-token: the encoder's own regex engine gives up on runs of a million characters."""
        whole, known = self.whole.encode_to_numpy, {}
        out = []
        for m in self.pattern.finditer(text):
            piece = m.group()
            ids = known.get(piece)
            if ids is None:
                ids = whole(piece, disallowed_special=()).astype("<u4").tobytes()
                if len(known) < _KNOWN:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(vocabulary: Broadcast) -> Codec:
    content, pattern = vocabulary.value
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(content, pattern)
    return _codecs[key]


def load_vocabulary(path: str, pattern: str) -> tuple[bytes, str]:
    """Read on the driver and broadcast: executors need no copy of the file (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read(), pattern


@dataclass
class Derive:
    """Columns made from the ids of a batch in the worker that has just encoded it: one Python process a task, not two."""

    fields: list[T.StructField]
    make: Callable[[Codec, list[bytes]], list[pa.Array]]
    with_ids: bool = True


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, derive: Derive | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``token_ids`` binary (little-endian unsigned 32-bit), a row for each row; and what ``derive`` adds."""
    assert MARGIN < overlap <= chunk
    spark = docs.sparkSession
    derive = derive or Derive([], lambda use, ids: [])
    keep = [c for c in keep if c not in {"token_ids"} | {f.name for f in derive.fields}]
    shared = spark.sparkContext.broadcast(load_vocabulary(path, pattern))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("body"))
    long = F.coalesce(F.length("body"), F.lit(0)) > chunk + overlap

    made = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if derive.with_ids else []), *derive.fields])
    short = rows.where(~long).mapInArrow(_encoder(shared, derive), made)

    at = [T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType())]
    cut = T.StructType([*fields, T.StructField("body", T.StringType()), *at])
    spans = T.ArrayType(T.LongType(), False)
    marked = T.StructType([*cut.fields, T.StructField("head", spans), T.StructField("tail", spans)])
    chunks = rows.where(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_cutter(chunk, overlap), cut)
    chunks = chunks.repartition(F.col("row"), F.col("part")).mapInArrow(_pre_tokeniser(shared, chunk, overlap), marked)
    by = Window.partitionBy("row").orderBy("part")
    stitched = (
        chunks.withColumn("upto", F.array_min(F.array_intersect("tail", F.lead("head").over(by))))
        .withColumn("start", F.coalesce(F.lag("upto").over(by), F.lit(0)))
        .withColumn("whole", F.max(F.col("upto").isNull() & ~F.col("last")).over(Window.partitionBy("row")))
    )
    base = F.col("part").cast("long") * chunk
    begin = F.col("start") - F.when(F.col("part") > 0, base).otherwise(0)
    end = F.when(F.col("last"), F.length("body").cast("long")).otherwise(F.col("upto") - base)
    own = (
        F.when(F.col("whole") & F.col("last"), F.col("body"))
        .when(F.col("whole"), F.substring("body", 1, chunk))
        .otherwise(F.substring(F.col("body"), (begin + 1).cast("int"), (end - begin).cast("int")))
    )
    pieces = (
        stitched.withColumn("own", own)
        .groupBy("row", F.when(F.col("whole"), F.lit(-1)).otherwise(F.col("part")).alias("part"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "own"))), lambda x: x["own"]), "").alias("body"), *(F.first(f.name).alias(f.name) for f in fields))
    )
    encoded = pieces.select("row", "part", *(f.name for f in fields), "body").mapInArrow(_encoder(shared), T.StructType([*at[:2], *fields, T.StructField("ids", T.BinaryType())]))
    joined = encoded.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"]).alias("parts"), *(F.first(f.name).alias(f.name) for f in fields))
    joined = joined.select(*(f.name for f in fields), "parts").mapInArrow(_joiner(shared, derive), made)
    names = {"ids": "token_ids"} | {f"k{i}": c for i, c in enumerate(keep)}
    return short.unionByName(joined).select(*(F.col(f.name).alias(names.get(f.name, f.name)) for f in made))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds the decoded bytes; they are the UTF-8 of the text that was encoded."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared)
        for batch in sliced(batches, ids):
            out = pa.array([use.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, to])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(to, T.BinaryType())]))


def _finish(batch: pa.RecordBatch, without: str, ids: list[bytes], use: Codec, derive: Derive | None) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != without]
    columns = [batch.column(n) for n in names]
    if derive is None or derive.with_ids:
        names, columns = [*names, "ids"], [*columns, pa.array(ids, pa.binary())]
    if derive is not None:
        names, columns = [*names, *(f.name for f in derive.fields)], [*columns, *derive.make(use, ids)]
    return pa.RecordBatch.from_arrays(columns, names)


def _encoder(shared: Broadcast, derive: Derive | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared)
        for batch in sliced(batches, "body"):
            yield _finish(batch, "body", [use.encode(x or "") for x in batch.column("body").to_pylist()], use, derive)

    return run


def _cutter(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            names = [n for n in batch.schema.names if n not in ("body", "row")]
            for i in range(batch.num_rows):
                text, row = batch.column("body")[i].as_py(), batch.column("row")[i].as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for first in range(0, n, 64):
                    parts = range(first, min(n, first + 64))
                    body = [text[p * chunk :] if p == n - 1 else text[p * chunk : (p + 1) * chunk + overlap] for p in parts]
                    kept = [batch.column(c).slice(i, 1).take(pa.array([0] * len(parts))) for c in names]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(body, pa.string()), pa.array([row] * len(parts), pa.int64()), pa.array(parts, pa.int32()), pa.array([p == n - 1 for p in parts])], [*names, "body", "row", "part", "last"])

    return run


def _pre_tokeniser(shared: Broadcast, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = codec(shared).pattern
        for batch in sliced(batches, "body"):
            heads, tails = [], []
            for text, part, last in zip(*(batch.column(c).to_pylist() for c in ("body", "part", "last")), strict=True):
                ends = [m.end() for m in pattern.finditer(text)]
                heads.append([part * chunk + e for e in (0, *ends) if e < overlap] if part else [])
                tails.append([] if last else [part * chunk + e for e in ends if chunk <= e <= len(text) - MARGIN])
            spans = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, spans), pa.array(tails, spans)], [*batch.schema.names, "head", "tail"])

    return run


def _joiner(shared: Broadcast, derive: Derive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared)
        for batch in batches:  # rows of ids, four bytes a token
            yield _finish(batch, "parts", [b"".join(x) for x in batch.column("parts").to_pylist()], use, derive)

    return run
