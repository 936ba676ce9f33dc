"""Writing web pages as WARC archives and reading selected records back, index first.

Writing makes the index: each task appends gzip members to an archive of its own in
the shared folder and returns offset, length, URL and digest of every record; Spark
commits these index rows, so only archives of successful attempts are ever named.
Reading takes any selection of index rows, sorts them by archive and offset, coalesces
neighbouring byte ranges into few reads, and checks each record's digest.

Of records with equal payloads of at least ``least`` bytes the one with the smallest
page id is a response; the others are revisits that name it (``WARC-Refers-To``, its URI
and page id). Smaller payloads, null and empty ones included (null counts as empty), are
always responses and take part in no join. Payloads travel only where a payload has so
many different copies that their digests cannot be broadcast; a popular one never does.

Repeated page ids: the first row met is the response. Every record has an id of its own,
repeated rows too. Rows with a null id or URL are written without that header and come
back as null. URLs are written as they are, but line breaks in them as ``%0D`` and
``%0A``, which is how they come back. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import scratch_path, sliced, stored

LEAST = 100
#: Ranges at most this far apart are read at once, up to this many bytes.
GAP, MOST_READ = 64 << 10, 8 << 20
#: Payloads with copies whose digests are broadcast (about 150 bytes each); beyond, only those of so many rows are.
MOST_KNOWN, POPULAR = 200_000, 50_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def mark_revisits(pages: DataFrame, least: int = LEAST, most_known: int = MOST_KNOWN, popular: int = POPULAR) -> DataFrame:
    """page_id, url, payload, digest, record (its id), and of revisits ``first_id``, ``first_url`` and ``first_record``."""
    # uid tells equal rows apart. Both uses below scan ``pages`` alike, so a row has the same uid in both:
    # ``pages`` has to be a stored table (or a deterministic plan over one).
    run = uuid.uuid4().hex
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("record", F.concat_ws("-", F.lit(run), F.monotonically_increasing_id().cast("string")))
    large = F.octet_length("payload") >= least
    # One row for each payload that occurs more than once: copies are counted before the shuffle.
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record", "url")).alias("one")
    copies = stored(rows.where(large).groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", "n", F.col("one.page_id").alias("first_id"), F.col("one.record").alias("first_record"), F.col("one.url").alias("first_url")), "warc-copies")
    few = copies.count() <= most_known
    known = copies if few else copies.where(F.col("n") > popular)  # at most one row for ``popular`` pages
    if not few and known.count() > most_known:
        known = copies.limit(0)  # too many to be broadcast: all go through the join, where adaptive execution splits what is hot
    marked = rows.join(F.broadcast(known.drop("n")), "digest", "left")
    if not few:
        rest = copies.join(F.broadcast(known.select("digest")), "digest", "left_anti").drop("n")
        open_ = large & F.col("first_record").isNull()
        asked = marked.where(open_).drop("first_id", "first_record", "first_url").join(rest, "digest", "left")
        marked = marked.where(~open_).unionByName(asked)
    again = F.coalesce(F.col("record") != F.col("first_record"), F.lit(False))
    return marked.select("page_id", "url", "payload", "digest", "record", again.alias("again"), *(F.when(again, F.col(c)).alias(c) for c in ("first_id", "first_record", "first_url")))


def _header(lines: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines if v is not None) + b"\r\n"


def _clean(url: str | None) -> str | None:
    """A header's value holds no line breaks."""
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def _urn(record: str | None) -> str | None:
    return None if record is None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, record)}>"


def info(name: str) -> bytes:
    """The record that begins an archive."""
    block = b"software: readloom\r\nformat: WARC File Format 1.1\r\n"
    return _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def record(r: dict) -> bytes:
    """One record. A revisit keeps the HTTP header, with the length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(r['payload'])}\r\n\r\n".encode()
    block = http if r["again"] else http + r["payload"]
    lines: list[tuple[str, object]] = [("WARC-Type", "revisit" if r["again"] else "response"), ("WARC-Record-ID", _urn(r["record"])), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(r["url"])), ("X-Page-ID", r["page_id"]), ("WARC-Payload-Digest", f"sha256:{r['digest']}")]
    if r["again"]:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(r["first_record"])), ("WARC-Refers-To-Target-URI", _clean(r["first_url"])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", r["first_id"])]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _header(lines) + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    number = lambda k: int(fields[k]) if k in fields else None
    response = fields["WARC-Type"] == "response"
    if response and len(payload) != length:
        raise ValueError(f"record of page {fields.get('X-Page-ID')} is cut short")
    return {
        "page_id": number("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload_bytes": length,
        "payload": payload if response else None,
    }


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith(("file:", "/")) else (pafs.LocalFileSystem(), root)


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(marked: DataFrame, root: str | None = None, level: int = 6) -> DataFrame:
    """Writes one archive for each task that has rows; returns the index as a stored table."""
    folder = root or scratch_path(marked.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset = None, "", 0
        try:
            for batch in sliced(batches, "payload"):
                rows = []
                for r in batch.to_pylist():
                    if out is None:  # named anew at each attempt: a late attempt never overwrites
                        fs, path = _open(folder)
                        fs.create_dir(path)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        start = _member(info(name), level)
                        out.write(start)
                        offset = len(start)
                    data = _member(record(r), level)
                    out.write(data)
                    rows.append((f"{folder}/{name}", offset, len(data), _clean(r["url"]), r["digest"], "revisit" if r["again"] else "response"))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _INDEX_TYPES, strict=True)], [f.name for f in INDEX])
        finally:
            if out is not None:
                out.close()

    return stored(marked.mapInArrow(run, INDEX), "warc-index")


_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
_RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def coalesce_ranges(rows: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = MOST_READ) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) as (archive, start, end, records): reads of at most ``most`` bytes, or one record."""
    now: tuple[str, int, int, list[tuple[int, int]]] | None = None
    for archive, offset, length in rows:
        if now and now[0] == archive and offset - now[2] <= gap and max(now[2], offset + length) - now[1] <= most:
            now[3].append((offset, length))
            now = (archive, now[1], max(now[2], offset + length), now[3])
        else:
            if now:
                yield now
            now = (archive, offset, offset + length, [(offset, length)])
    if now:
        yield now


def read_records(index: DataFrame, with_payload: bool = True, gap: int = GAP, most: int = MOST_READ) -> DataFrame:
    """The records that ``index`` selects. A revisit's payload is null here; its digest and length are those of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = ((a, o, n) for b in batches for a, o, n in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
        opened, file = None, None
        for archive, start, end, records in coalesce_ranges(wanted, gap, most):
            if opened != archive:
                if file is not None:
                    file.close()
                fs, path = _open(archive)
                opened, file = archive, fs.open_input_file(path)
            data = file.read_at(end - start, start)
            found = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in records]
            for x in found:
                if x["payload"] is not None and hashlib.sha256(x["payload"]).hexdigest() != x["payload_digest"]:
                    raise ValueError(f"page {x['page_id']}: the payload differs from its digest")
                if not with_payload:
                    x["payload"] = None
            yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in found], t) for f, t in zip(RECORD, _RECORD_TYPES, strict=True)], [f.name for f in RECORD])
        if file is not None:
            file.close()

    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return sorted_.mapInArrow(run, RECORD)
