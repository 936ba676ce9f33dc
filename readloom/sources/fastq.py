"""FASTQ files as DataFrames.

A path is one file, a folder, a pattern, or several of these separated by commas; lanes
of one run are read together. Every file is read by one task, whatever their number, so
records are numbered there while the lines stream through: no shuffle. A record's number
has the file's number in its upper bits, so files that belong together (mates, indexes)
line up file by file. Names are split by built-in functions afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "rec long, line string, seq string, plus string, qual string"
_NAMES = ["rec", "line", "seq", "plus", "qual"]
#: Bits of a record's number within its file.
FILE_SHIFT = 40
#: Suffixes of files that Spark reads in one piece.
_WHOLE = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")


def files(spark: SparkSession, path: str) -> list[str]:
    """The files of ``path``: those given by name in that order, those of a folder or pattern by name. Missing ones are an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: list[str] = []
    for part in filter(None, (p.strip() for p in path.split(","))):
        given = jvm.org.apache.hadoop.fs.Path(part)
        fs = given.getFileSystem(conf)
        states = [s for s in (fs.globStatus(given) or [])]
        inner = [x for s in states for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
        names = sorted(x.getPath().toString() for x in inner if not x.isDirectory() and x.getPath().getName()[:1] not in "._")
        if not names:
            raise ValueError(f"cannot open {part}")
        found += names
    if not found:
        raise ValueError(f"cannot open {path!r}")
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """rec, name, comment, mate, seq, plus, qual of all files of ``path`` (gzip of one or more members, or plain)."""
    paths = files(spark, path)
    whole = [p for p in paths if p.endswith(_WHOLE)]
    # \n only: carriage returns stay. A plain file that is read in parts comes in order, so its one task sees whole records.
    text = lambda p: spark.read.option("lineSep", "\n").text(p)
    parts = [text(p).coalesce(1).select("value").mapInArrow(_records({0: (paths.index(p), p)}), RAW) for p in paths if not p.endswith(_WHOLE)]
    if whole:
        # As in metadata: encoded, and local paths with one slash or three.
        uris = [(paths.index(p), p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).toUri().toString()) for p in whole]
        forms = [(n, p, form) for n, p, u in uris for form in {u, *(f"file:{slashes}{u[5:].lstrip('/')}" for slashes in ("/", "///") if u.startswith("file:/"))}]
        hashes = spark.createDataFrame(forms, "number long, path string, form string").select("number", "path", F.xxhash64("form").alias("file")).collect()
        known = {r["file"]: (r["number"], r["path"]) for r in hashes}
        parts.append(text(whole).select("value", F.xxhash64("_metadata.file_path").alias("file")).mapInArrow(_records(known), RAW))
    raw = reduce(DataFrame.union, parts)
    return raw.select("rec", *name_parts(F.col("line")), "seq", "plus", "qual")


def _records(known: dict[int, tuple[int, str]]):
    """Lines to records, file after file; ``known`` gives each file's number and name by the hash of its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held = None, 0, pa.array([], pa.string())

        def finished() -> None:
            if len(held) and held.to_pylist() != [""]:
                raise ValueError(f"{known[now][1]}: the last record is cut short")

        for batch in batches:
            ids = batch.column("file").to_numpy() if "file" in batch.schema.names else np.zeros(batch.num_rows, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if int(ids[a]) != now:
                    finished()
                    now, number, held = int(ids[a]), 0, pa.array([], pa.string())
                # What stands after the last whole record waits; an empty name in it may still be the end.
                lines = pa.concat_arrays([held, batch.column("value").slice(a, b - a).cast(pa.string())])
                count = len(lines) // 4
                held = lines.slice(4 * count)
                if count:
                    yield _batch(lines, count, number, *known[now])
                    number += count
        finished()

    return run


def _batch(lines: pa.Array, count: int, number: int, file: int, path: str) -> pa.RecordBatch:
    at = np.arange(count, dtype=np.int64) * 4
    line, seq, plus, qual = (lines.take(pa.array(at + k)) for k in range(4))
    bases, scores = (pc.utf8_length(x).to_numpy() for x in (seq, qual))
    wrong = np.flatnonzero(bases != scores)
    if len(wrong):
        raise ValueError(f"{path}: record {number + int(wrong[0]) + 1} has {bases[wrong[0]]} bases and {scores[wrong[0]]} qualities")
    return pa.RecordBatch.from_arrays([pa.array((file << FILE_SHIFT) + number + np.arange(count, dtype=np.int64)), line, seq, plus, qual], _NAMES)


def name_parts(line: Column) -> list[Column]:
    """name, comment and mate. The delimiters are tried in order: `` 1:``, `` 2:``, then ``/1`` and ``/2``."""
    one, two = F.locate(" 1:", line), F.locate(" 2:", line)
    at = F.when(one > 0, one).otherwise(two)
    space = F.locate(" ", line)
    word = F.when(space > 0, F.substring(line, F.lit(1), space - 1)).otherwise(line)
    slash = word.rlike(r"/[12]\z")
    rest = F.when(space > 0, F.substring(line, space + 1, F.length(line))).otherwise("")
    name = F.when(at > 0, F.substring(line, F.lit(1), at - 1)).when(slash, F.substring(word, F.lit(1), F.length(word) - 2)).otherwise(line)
    comment = F.when(at > 0, F.substring(line, at + 1, F.length(line))).when(slash, rest).otherwise("")
    mate = F.when(one > 0, 1).when(two > 0, 2).when(slash, F.right(word, F.lit(1)).cast("int")).otherwise(1)
    return [name.alias("name"), comment.alias("comment"), mate.alias("mate")]


def header_indexes(name: Column, comment: Column) -> tuple[Column, Column]:
    """Index sequences found in a header, and the name without them.

    The comment is scanned first, then the name: runs of two or more of ACGTN after the
    last colon. From a name they are erased, and one trailing character with them unless
    it is alphanumeric, ``_`` or ``:``.
    """
    after = lambda c: F.substring_index(c, ":", -1)
    runs = lambda c: F.regexp_extract_all(after(c), F.lit("[ACGTN]{2,}"), F.lit(0))
    from_comment = F.size(runs(comment)) > 0
    found = F.when(from_comment, runs(comment)).otherwise(runs(name))
    head = F.substring(name, F.lit(1), F.length(name) - F.length(after(name)))
    erased = F.concat(head, F.regexp_replace(after(name), "[ACGTN]{2,}", ""))
    erased = F.regexp_replace(erased, r"[^0-9A-Za-z_:]\z", "")
    return found, F.when(from_comment | (F.size(runs(name)) == 0), name).otherwise(erased)
