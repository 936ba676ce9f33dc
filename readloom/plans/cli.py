"""Command line: python -m readloom.plans.cli -r reads_R1.fastq.gz -o results ..."""

from __future__ import annotations

import argparse
import contextlib
import resource
import sys
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from readloom.operators import route, storage
from readloom.operators.align import align
from readloom.plans.check import check_design
from readloom.plans.demux import ConfigError, DemuxConfig, Result, demultiplex
from readloom.sources import fastq, lookup, sink

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom", description=__doc__)
    a = p.add_argument
    for short, long in (("-i", "--index1File"), ("-I", "--index2File"), ("-r", "--read1File"), ("-R", "--read2File"), ("-o", "--outputDir"), ("-p", "--outputPrefix"), ("-1", "--bcIndex1"), ("-2", "--bcIndex2"), ("-3", "--bcRead1"), ("-4", "--bcRead2"), ("-l", "--bclookupFilePath"), ("-d", "--outputDemultiplexingOn"), ("-a", "--adapterR1"), ("-A", "--adapterR2")):
        a(short, long, default="")
    for short, long in (("-H", "--bcIndexesInHeader"), ("-t", "--bcTrim"), ("-u", "--returnUMIasSequences"), ("-f", "--rejectNonMatchingFixedBarcodes"), ("-D", "--deduplicateReads")):
        a(short, long, action="store_true")
    for long in ("--globalRejected", "--statsTSV", "--checkDesign", "--keepQuiet"):
        a(long, action="store_true")
    a("-m", "--bcMaxMismatches", type=int, default=0)
    a("--trimOverlapDiffLimit", type=int, default=2)
    a("--trimOverlapRequire", type=int, default=15)
    a("--trimdiffPercentLimit", type=float, default=0.1)
    a("--trimQuality", type=int, default=20)
    a("--trimMinStretchG", type=int, default=5)
    a("-k", "--minLengthRead", type=int, default=22)
    a("-c", "--numThreads", type=int, default=1)
    a("--statsParquet", default="", help="folder for all tables as Parquet")
    a("--looseIndex", action="store_true", help="reads without an index record go on as Un; of several records the last counts")
    a("--shortRead", choices=("keep", "reject"), default="keep", help="reads shorter than their design")
    a("--noMerge", action="store_true", help="leave every output file as a folder of gzip parts")
    a("--maxFiles", type=int, default=sink.MOST_FILES, help="most output files")
    a("--version", action="version", version=VERSION)
    return p


def config_of(o: argparse.Namespace, table: str | None) -> DemuxConfig:
    return DemuxConfig(
        bc_index1=o.bcIndex1, bc_index2=o.bcIndex2, bc_read1=o.bcRead1, bc_read2=o.bcRead2, lookup=table, indexes_in_header=o.bcIndexesInHeader, max_mismatches=o.bcMaxMismatches, trim_barcodes=o.bcTrim, umi_as_sequence=o.returnUMIasSequences,
        reject_fixed=o.rejectNonMatchingFixedBarcodes, global_rejected=o.globalRejected, deduplicate=o.deduplicateReads, adapter_r1=o.adapterR1, adapter_r2=o.adapterR2, overlap_diff_limit=o.trimOverlapDiffLimit, overlap_require=o.trimOverlapRequire,
        diff_fraction=o.trimdiffPercentLimit, trim_quality=o.trimQuality, min_stretch_g=o.trimMinStretchG, min_length=o.minLengthRead, split_on=o.outputDemultiplexingOn, prefix=o.outputPrefix, base1=route.base_name(o.read1File.split(",")[0]), base2=route.base_name(o.read2File.split(",")[0]), threads=o.numThreads, strict_index=not o.looseIndex, short_read=o.shortRead,
    )


def run(argv: list[str], spark: SparkSession | None = None) -> tuple[Result | None, str]:
    """The result (None for a dry run) and what is printed."""
    o = parser().parse_args(argv)
    if not o.read1File or not (o.outputDir or o.checkDesign):
        raise ConfigError("read1File and outputDir are required")
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    table = "\n".join(r["value"] for r in spark.read.option("lineSep", "\n").text(o.bclookupFilePath).collect()) if o.bclookupFilePath else None
    config = config_of(o, table)
    # An index file without any index design is never read.
    given = {"r1": o.read1File, "r2": o.read2File} | ({"i1": o.index1File, "i2": o.index2File} if o.bcIndex1 or o.bcIndex2 else {})
    given = {s: fastq.files(spark, path) for s, path in given.items() if path}
    if len({len(x) for x in given.values()}) > 1:
        raise ConfigError("as many files are needed for each of " + ", ".join(given))
    sides = {s: fastq.read(spark, ",".join(x)) for s, x in given.items()}
    if o.checkDesign:
        return None, check_design(config, sides)
    config.validate("r2" in sides, bool(o.index1File or o.index2File))
    folder, began, made = o.outputDir.rstrip("/"), time.monotonic(), []
    store, tag = sink.Store(spark, folder), f"readloom-{uuid.uuid4().hex}"
    spark.sparkContext.addJobTag(tag)
    try:
        with contextlib.nullcontext() if o.keepQuiet else progress(spark):
            wide = align(sides["r1"], sides.get("r2"), sides.get("i1"), sides.get("i2"), config.strict_index)
            if config.deduplicate or any(s.kind in "LI" for d in config.designs().values() for s in d.segments):
                wide = storage.stored(wide, "aligned")  # else every token and the keys would parse the files again
            result = demultiplex(wide, config)
            made += sink.write_fastq(result.records(), folder, not o.noMerge, o.maxFiles)
            if o.statsTSV:
                made.append(f"{folder}/{o.outputPrefix + '_' if o.outputPrefix else ''}demux_statistics.tsv")
                sink.write_tsv(result.statistics().orderBy("table", "count", "key", ascending=[True, False, True]), made[-1], not o.noMerge)
            if o.statsParquet:
                for name, df in result.tables().items():
                    made.append(f"{o.statsParquet.rstrip('/')}/{name}")
                    df.write.mode("overwrite").parquet(made[-1])
            return result, summary(result, o.keepQuiet, time.monotonic() - began)
    except BaseException:  # a failed or interrupted run leaves no outputs
        spark.sparkContext.cancelJobsWithTag(tag)
        for path in made:
            store.delete(path)
        raise
    finally:
        spark.sparkContext.removeJobTag(tag)


@contextlib.contextmanager
def progress(spark: SparkSession, every: float = 10.0) -> Iterator[None]:
    """Says to stderr how many tasks of the running stages are done."""
    done = threading.Event()

    def watch() -> None:
        tracker, began = spark.sparkContext.statusTracker(), time.monotonic()
        while not done.wait(every):
            for stage in tracker.getActiveStageIds():
                if info := tracker.getStageInfo(stage):
                    print(f"{time.monotonic() - began:.0f} s: {info.name}: {info.numCompletedTasks} of {info.numTasks} tasks", file=sys.stderr)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


def peak_memory(spark: SparkSession) -> str:
    """The driver's peak in MB: that of Python, and of the JVM's heap."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    heap = sum(b.getPeakUsage().getUsed() for b in beans)
    return f"Peak memory of the driver: Python {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10} MB, JVM {heap >> 20} MB"


def summary(result: Result, quiet: bool = False, seconds: float | None = None) -> str:
    t = result.tables()["ReadStatistics"].first()
    lines = [f"Reads processed: {t['TotalReads']}", f"Reads written: {t['TotalWritten']}", f"Unique reads: {t['UniqueReads']}"]
    lines += [f"Duplicate reads: {t['DuplicateReads']}"] * result.config.deduplicate + [f"Rejected reads: {t['RejectedReads']}"] * result.config.reject_fixed
    if seconds is not None:
        lines.append(f"Reads a minute: {60 * t['TotalReads'] / max(seconds, 1e-9):.0f} ({1e6 * seconds / max(1, t['TotalReads']):.1f} microseconds a read)")
        lines.append(peak_memory(result.processed.sparkSession))
    if not quiet:
        for name, df in result.diagnostics().items():
            lines += [f"{name}: " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in df.collect()]
        if result.config.lookup is not None:
            for token, table in lookup.by_token(lookup.parse(result.config.lookup), result.config.designs()).items():
                if warning := lookup.density_warning(table, result.config.max_mismatches):
                    lines.append(f"{token.column}: {warning}")
    return "\n".join(lines)


def main() -> int:
    try:
        print(run(sys.argv[1:])[1])
    except (ConfigError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if spark := SparkSession.getActiveSession():
            storage.release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
