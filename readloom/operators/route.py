"""Where a read goes, under which name, and as what text."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIXES = {"Main": "demultiplexed", "Duplicate": "duplicated", "Rejected": "rejected"}


def long_enough(df: DataFrame, least: int = 22) -> DataFrame:
    """Drops a pair if either mate is too short."""
    ok = F.length("r1_seq") >= least
    if "r2_seq" in df.columns:
        ok = ok & (F.length("r2_seq") >= least)
    return df.where(ok)


def destination(duplicate: Column, rejected: Column, global_rejected: bool = False) -> Column:
    """Main, Duplicate or Rejected. Duplicates come before rejected reads, unless rejected ones are kept in one place."""
    first = F.when(F.lit(global_rejected) & rejected, "Rejected")
    return first.when(duplicate, "Duplicate").when(rejected, "Rejected").otherwise("Main")


def file_name(base: Column | str, to: Column, tags: list[str], mate: int, global_rejected: bool = False) -> Column:
    """``<base>[_tag...]_R<mate>_<suffix>.fastq.gz``; reads rejected globally have no tags."""
    base = F.lit(base) if isinstance(base, str) else base
    suffix = F.when(to == "Main", SUFFIXES["Main"]).when(to == "Duplicate", SUFFIXES["Duplicate"]).otherwise(SUFFIXES["Rejected"])
    end = F.concat(F.lit(f"R{mate}_"), suffix, F.lit(".fastq.gz"))
    tagged = F.concat_ws("_", base, *(F.col(t) for t in tags), end)
    return F.when(F.lit(global_rejected) & (to == "Rejected"), F.concat_ws("_", base, end)).otherwise(tagged)


@dataclass(frozen=True)
class OutputName:
    """One output file's name outside of a table, to be edited tag by tag; ``file_name`` is the same for rows."""

    folder: str
    base: str
    tags: tuple[str, ...] = ()

    def tagged(self, tag: str, at: int | None = None) -> OutputName:
        """With one tag more, at the end or at a place."""
        at = len(self.tags) if at is None else at
        return replace(self, tags=(*self.tags[:at], tag, *self.tags[at:]))

    def without(self, tag: str | int) -> OutputName:
        """Without a tag, told by its place or by its name (wherever it comes)."""
        return replace(self, tags=tuple(t for i, t in enumerate(self.tags) if (i if isinstance(tag, int) else t) != tag))

    def edited(self, at: int, tag: str) -> OutputName:
        return replace(self, tags=(*self.tags[:at], tag, *self.tags[at + 1 :]))

    def path(self, mate: int, to: str = "Main") -> str:
        return f"{self.folder.rstrip('/')}/{'_'.join([self.base, *self.tags, f'R{mate}', SUFFIXES[to]])}.fastq.gz"


def record(name: Column, comment: Column, mate: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """The four lines of a record; an empty comment becomes ``<mate>:N:0:0``."""
    said = F.when(F.coalesce(comment, F.lit("")) == "", F.concat(mate.cast("string"), F.lit(":N:0:0"))).otherwise(comment)
    return F.concat_ws("\n", F.concat(name, F.lit(" "), said), seq, plus, qual)


def base_name(path: str) -> str:
    """The file's name without its last two suffixes."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    for _ in range(2):
        head, dot, _ = name.rpartition(".")
        name = head if dot else name
    return name
