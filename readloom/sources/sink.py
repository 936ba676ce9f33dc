"""Writing routed records as gzip FASTQ files, in input order, and tables as TSV."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that one run may write; a design split by every cell makes more.
MOST_FILES = 20_000
#: Files that are put together at once.
_THREADS = 8


class Store:
    """Hadoop's file system under a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        return sorted(str(s.getPath().getName()) for s in self.fs.listStatus(self.path(folder)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def join(self, folder: str, target: str, head: bytes = b"") -> None:
        """The part files of ``folder`` one after the other as ``target``. One part alone is renamed: nothing passes through here."""
        parts = [n for n in self.names(folder) if n.startswith("part-")]
        self.delete(target)
        if len(parts) == 1 and not head:
            if not self.fs.rename(self.path(f"{folder}/{parts[0]}"), self.path(target)):
                raise OSError(f"cannot write {target}")
            return
        out = self.fs.create(self.path(target), True)
        try:
            if head:
                out.write(bytearray(head))
            for part in parts:
                data = self.fs.open(self.path(f"{folder}/{part}"))
                try:
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, self.conf, False)
                finally:
                    data.close()
        finally:
            out.close()


def write_fastq(records: DataFrame, folder: str, merge: bool = True, most_files: int = MOST_FILES) -> list[str]:
    """``records``: file, rec, text. Returns the files' paths.

    Rows are dealt out by range of (file, rec), so that a large file is written by many
    tasks, each a gzip member in order. ``merge`` joins the members of each file, which
    is a valid gzip file; without it every file is a folder of parts, and nothing passes
    through the driver. More files than ``most_files`` are refused before any is written.
    A failure leaves nothing.
    """
    spark = records.sparkSession
    store, folder = Store(spark, folder), folder.rstrip("/")
    count = records.select("file").distinct().count()
    if count > most_files:
        raise ValueError(f"{count} output files, at most {most_files} are allowed: split on fewer tokens")
    staging = f"{folder}/.staging-{uuid.uuid4().hex}"
    store.fs.mkdirs(store.path(folder))
    made: list[str] = []
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        named = records.select(F.col("file").alias("_file"), "rec", F.col("text").alias("value"))
        sorted_ = named.repartitionByRange(parts, "_file", "rec").sortWithinPartitions("_file", "rec")
        sorted_.drop("rec").write.partitionBy("_file").option("compression", "gzip").option("lineSep", "\n").text(staging)
        unescaped = store.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        targets = [(f"{staging}/{d}", f"{folder}/{unescaped(d[6:])}") for d in store.names(staging) if d.startswith("_file=")]
        made = [t for _, t in targets]

        def place(move: tuple[str, str]) -> None:
            if merge:
                store.join(*move)
            else:
                store.delete(move[1])
                store.fs.rename(*map(store.path, move))

        with ThreadPoolExecutor(_THREADS) as pool:
            list(pool.map(place, targets))
    except BaseException:
        for target in made:
            store.delete(target)
        raise
    finally:
        store.delete(staging)
    return made


def write_tsv(table: DataFrame, path: str, merge: bool = True) -> None:
    """A table in its order, with a header: as one file, or (``merge=False``) as a folder of parts. No task holds all of it."""
    store = Store(table.sparkSession, path)
    if not merge:
        table.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
        return
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        table.write.option("sep", "\t").option("header", False).option("emptyValue", "").csv(staging)
        store.join(staging, path, ("\t".join(table.columns) + "\n").encode())
    finally:
        store.delete(staging)
