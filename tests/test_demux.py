"""Operators on DataFrames and whole runs on files, against a plain version of the steps for each read."""

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from readloom.functions import iupac, quality
from readloom.operators import assign, dedup, route, stats, storage, trim
from readloom.operators.align import align
from readloom.operators.tokens import slice_tokens
from readloom.plans import cli
from readloom.plans.demux import DemuxConfig, demultiplex
from readloom.plans.design import parse, tokens
from readloom.sources import fastq, lookup
from readloom.streaming import stream
from tests.test_driver import AD, INS, TABLE, plain_overlap

READ = "rec long, name string, comment string, mate int, seq string, plus string, qual string"


def reads(spark, seqs, mate=1, quals=None, comment=""):
    return spark.createDataFrame([(i, f"@r{i}", comment, mate, s, "+", (quals or {}).get(i, "I" * len(s))) for i, s in enumerate(seqs)], READ)


def fails(df, text):
    with pytest.raises(Exception, match=text):
        df.write.format("noop").mode("overwrite").save()


def test_name_parts(spark):
    lines = ["@a 1:N:0:ACGT", "@a 2:N:0:ACGT", "@a/2", "@a/1 x y", "@SRR1.1 1 length=50", "@b 2:x 1:y", ""]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in lines], "line string").select(*fastq.name_parts(F.col("line"))).collect()]
    assert got == [("@a", "1:N:0:ACGT", 1), ("@a", "2:N:0:ACGT", 2), ("@a", "", 2), ("@a", "x y", 1), ("@SRR1.1 1 length=50", "", 1), ("@b 2:x", "1:y", 1), ("", "", 1)]


def test_header_indexes(spark):
    rows = [("@n", "1:N:0:ACGTACGT+TTGCAACT"), ("@A:1:0_ACGTACGT+TTGCAACT", "1:N:0:1"), ("@A:1:0_ACGTACGT_BLABLA123", ""), ("@n", "1:N:0:1"), ("@n", "1:N:0:AC+GT+AA")]
    got = [(r[0], r[1]) for r in spark.createDataFrame(rows, "n string, c string").select(*(x.alias(str(i)) for i, x in enumerate(fastq.header_indexes(F.col("n"), F.col("c"))))).collect()]
    assert got == [(["ACGTACGT", "TTGCAACT"], "@n"), (["ACGTACGT", "TTGCAACT"], "@A:1:0_"), (["ACGTACGT"], "@A:1:0__BLABLA123"), ([], "@n"), (["AC", "GT", "AA"], "@n")]


def test_slicing(spark):
    seqs = ["GAATCAATTGAATCGAACTACTCTCAGCGT", "ATGCCAATTGAATCGAACTACTCTCAGCGT", "CCCCCAATTGAATCGAACTACTCTCAGCGT", "GAATC", ""]
    out = slice_tokens(align(reads(spark, seqs)), {"bcRead1": parse("GAATC*ATGCC|10X|10L|5I")}, trim=True).orderBy("rec").collect()
    assert [(r["r1_t1"], r["r1_t3"], r["r1_t4"], r["rejected"], r["r1_seq"]) for r in out] == [
        ("GAATC", "AACTACTCTC", "AGCGT", False, ""), ("ATGCC", "AACTACTCTC", "AGCGT", False, ""), ("CCCCC", "AACTACTCTC", "AGCGT", True, ""), (None, None, None, False, "GAATC"), (None, None, None, False, "")]
    fixed = slice_tokens(align(reads(spark, ["GATC", "GGTC", "GCTC", "GNTC", "gatc"])), {"bcRead1": parse("GRTC")}).orderBy("rec")
    assert [r["rejected"] for r in fixed.collect()] == [False, False, True, True, True]
    short = align(reads(spark, ["ACGTACG"]), reads(spark, ["ACGTACGT"], 2))
    designs = {"bcRead1": parse("8I"), "bcRead2": parse("8I")}
    assert slice_tokens(short, designs).first()["rejected"] and not slice_tokens(short, {"bcRead1": parse("8I")}).first()["rejected"]
    assert slice_tokens(short, {"bcRead1": parse("8I")}, short_read="reject").first()["rejected"]
    for size in (7, 9):
        fails(slice_tokens(align(reads(spark, ["ACGT"]), index1=reads(spark, ["A" * size])), {"bcIndex1": parse("8L")}), "does not have 8 bases")


def test_lookup_matches(spark):
    designs = {"bcRead1": parse("8L")}
    table = next(iter(lookup.by_token(lookup.parse(TABLE), designs).values()))
    seen = ["ACGTTTAA", "TTAAACGT", "GGACCTTA", "GGGCCTTA", "CATGCATG", "GACCGGTT", "AACCGGTC", "ACGTTTAC", "ACGTTTAN"]
    df = spark.createDataFrame([(s,) for s in seen], "seq string")
    names = lambda m: {r["seq"]: (r["assigned"], r["is_rc"]) for r in assign.match(df, table, m).collect()}
    none, one = names(0), names(1)
    assert none == {"ACGTTTAA": ("BC01", False), "TTAAACGT": ("BC02", False), "GGACCTTA": ("BC03", False), "GGGCCTTA": ("BC03", False), "CATGCATG": ("BC04", False), "GACCGGTT": ("BC05", True)}
    assert one["ACGTTTAC"] == one["ACGTTTAN"] == ("rBC01", False)
    e = lookup.Entry
    tie = assign.match(spark.createDataFrame([("AAAAAAAA",)], "seq string"), {"AAAAAAAC": e("BCB", False), "AAAAAAAG": e("BCA", False)}, 1).first()
    assert tie["assigned"] == "rBCA" and assign.match(df, {}, 1).count() == 0


@pytest.mark.parametrize("expanded", [1_024, 1])
def test_lookup_against_all_pairs(spark, monkeypatch, expanded):
    monkeypatch.setattr(assign, "MOST_EXPANDED", expanded)
    r = random.Random(7)
    table = {"".join(r.choice("ACGTACGTRN") for _ in range(r.choice([2, 6, 6, 8]))): lookup.Entry(f"n{r.randrange(9)}", False) for _ in range(30)}
    seen = ["".join(r.choice("ACGTN") for _ in range(r.choice([2, 6, 8]))) for _ in range(300)] + list(table)
    df = spark.createDataFrame([(s,) for s in set(seen)], "seq string")
    for m in (0, 1, 3):
        want = {}
        for s in set(seen):
            found = []
            for t, e in table.items():
                if len(s) == len(t):
                    d = sum(b not in iupac.BASES[c] for b, c in zip(s, t, strict=True))
                    if s == t and "N" not in s:
                        found.append((0, 0, e.name, t))
                    elif d <= m:
                        found.append((1 if d == 0 else 2, d, e.name, t))
            if found:
                tier, _, name, _ = min(found)
                want[s] = "r" + name if tier == 2 else name
        assert {x["seq"]: x["assigned"] for x in assign.match(df, table, m).collect()} == want


def test_ids_are_numbered_by_chunk_and_sequence(spark):
    rows = [("CC", 0), ("AA", 1), ("BB", 0), ("AA", 2), ("CC", 3)]
    got = {r["seq"]: r["assigned"] for r in assign.ids(spark.createDataFrame(rows, "seq string, chunk long")).collect()}
    assert got == {"BB": "ID1", "CC": "ID2", "AA": "ID3"}
    many = storage.ranked(spark.range(1000).selectExpr("id * 7 % 1000 AS v"), ["v"], "k").collect()
    assert all(r["k"] == r["v"] + 1 for r in many)


def test_output_names(spark):
    name = route.OutputName("out/", "run").tagged("b").tagged("a", 0).tagged("x")
    assert name.tags == ("a", "b", "x") and name.without("x").without(0).tags == ("b",) and name.edited(1, "y").tags == ("a", "y", "x")
    df = spark.createDataFrame([("a", "b", "x", d) for d in route.SUFFIXES], "t1 string, t2 string, t3 string, d string")
    got = [r[0] for r in df.select(route.file_name("run", F.col("d"), ["t1", "t2", "t3"], 2)).collect()]
    assert [name.path(2, d) for d in route.SUFFIXES] == [f"out/{x}" for x in got]


def test_copies_are_found_without_moving_reads(spark):
    df = spark.range(1000).selectExpr("id AS rec", "concat('ACGT', cast(id % 7 as string)) AS a", "repeat('x', 500) AS other")
    plan = dedup.flag_duplicates(df.withColumn("a", F.translate("a", "0123456", "ACGTACG")), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_duplicates(spark):
    got = lambda rows, c: [r["duplicate"] for r in dedup.flag_duplicates(spark.createDataFrame(rows, "rec long, a string, b string"), c).orderBy("rec").collect()]
    assert got([(0, "ACGT", ""), (1, "acgt", ""), (2, "ACGR", ""), (3, "ACGR", ""), (4, None, None), (5, "", "")], ["a"]) == [False, True, False, False, False, True]
    assert got([(0, "AC", "GT"), (1, "ACG", "T")], ["a", "b"]) == [False, True]


def test_trimming(spark):
    seqs = [INS + AD, INS + AD[:14], AD[5:], AD[5:] + "ACGT", INS + "GGGGG", INS + "GGGG", INS, INS + "GGGGGGAA", INS + "N" * 20]
    quals = {6: "I" * 20 + "4455", 7: "I" * 30 + "##"}
    out = trim.trim_side(align(reads(spark, seqs, quals=quals)), "r1", AD).orderBy("rec").collect()
    want = [24, 38, 23, 27, 24, 28, 24, 24, len(plain_trim(seqs[8], "I" * 44, AD, 20, 5)[0])]
    assert [len(r["r1_seq"]) for r in out] == [len(r["r1_qual"]) for r in out] == want
    same = trim.trim_side(align(reads(spark, seqs)), "r1", "")
    assert [r["r1_seq"] for r in same.orderBy("rec").collect()] == seqs
    odd = spark.createDataFrame([("ACGT", "I]^\\")], "s string, q string")
    for threshold, keep in ((59, 4), (60, 3), (61, 3), (62, 0), (0, 4), (-5, 4)):  # scores 40, 60, 61, 59
        s, _ = trim.quality_trim(F.col("s"), F.col("q"), threshold)
        assert len(odd.select(s.alias("s")).first()["s"]) == keep


def test_qualities(spark):
    row = spark.createDataFrame([("!I~ \x1f",), ("#I!II",)], "q string")
    assert row.select(quality.scores(F.col("q")).alias("s")).first()["s"] == [0, 40, 93, 0, 0]
    assert row.agg(quality.mean_scores(F.col("q"), 3).alias("m")).first()["m"] == [1, 40, 46]


def test_alignment_errors(spark):
    one, two = reads(spark, ["ACGT", "ACGT"]), reads(spark, ["ACGT", "ACGT"], 2)
    assert align(one, two).count() == 2
    fails(align(one, reads(spark, ["ACGT"], 2)), "different numbers")
    fails(align(one, two.withColumn("name", F.concat("name", F.lit("x")))), "different names")
    fails(align(one, index1=reads(spark, ["ACGT"])), "do not match")
    fails(align(one, index1=one.unionByName(one.withColumn("rec", F.col("rec") + 9))), "several records")
    fails(align(one, index1=one, index2=reads(spark, ["ACGT"])), "the index files have different")
    loose = align(one, index1=reads(spark, ["ACGT"]), strict=False).orderBy("rec").collect()
    assert [r["i1_seq"] for r in loose] == ["ACGT", None]


def plain_trim(seq, qual, adapter, threshold, least_g):
    if adapter:
        found = plain_overlap(seq, adapter)
        if found:
            keep = found[0] if found[0] >= 0 else max(len(seq) + found[0], 0)
            seq, qual = seq[:keep], qual[:keep]
        while qual and max(0, min(93, ord(qual[-1]) - 33)) < threshold:
            seq, qual = seq[:-1], qual[:-1]
        run = len(seq) - len(seq.rstrip("G"))
        if least_g and run >= least_g:
            seq, qual = seq[:-run], qual[: len(seq) - run]
    return seq, qual


def plain_run(pairs, config):
    """Each read in file order; returns (file, record) pairs and totals."""
    designs = {"bcRead1": parse(config.bc_read1), "bcRead2": parse(config.bc_read2)}
    tables = lookup.by_token(lookup.parse(config.lookup), designs)
    seen, out, totals = set(), [], Counter()
    for name, comment, mates in pairs:
        found, flagged, parsed, cut = [], False, False, []
        for (d, design), (seq, qual) in zip(designs.items(), mates, strict=True):
            ok = design and seq and len(seq) >= design.total
            flagged |= bool(design and seq and not ok)
            for s in design.segments:
                part = seq[s.start : s.start + s.size] if ok else None
                if s.kind == "S" and ok:
                    flagged |= not any(iupac.matches_py(part, x) for x in s.sequences)
                if s.kind != "X":
                    parsed |= bool(ok)
                    found.append((d, s, part))
            cut.append((seq[design.total :], qual[design.total :]) if ok and config.trim_barcodes else (seq, qual))
        ids = []
        for d, s, part in found:
            if not part:
                ids.append("Un")
            elif s.kind != "L":
                ids.append(part)
            else:
                table = next(v for t, v in tables.items() if (t.design, t.segment.number) == (d, s.number))
                best = min(((0 if t == part and "N" not in part else 1 if k == 0 else 2, k, e.name, t) for t, e in table.items() if len(t) == len(part) for k in [sum(b not in iupac.BASES[c] for b, c in zip(part, t, strict=True))] if k <= config.max_mismatches), default=None)
                ids.append("Un" if best is None else "r" * (best[0] == 2) + best[2])
        rejected = config.reject_fixed and flagged and parsed
        key = ("".join(p or "" for _, _, p in found) + "".join(s for s, _ in cut)).upper()
        plain = set(key) <= set("ACGTN")
        duplicate = config.deduplicate and plain and key in seen
        if plain:
            seen.add(key)
        done = [plain_trim(s, q, a, config.trim_quality, config.min_stretch_g) for (s, q), a in zip(cut, (config.adapter_r1, config.adapter_r2), strict=True)]
        totals["TotalReads"] += 1
        if any(len(s) < config.min_length for s, _ in done):
            continue
        totals["TotalWritten"] += 1
        to = "rejected" if config.global_rejected and rejected else "duplicated" if duplicate else "rejected" if rejected else "demultiplexed"
        totals[to] += 1
        tag = "" if config.global_rejected and to == "rejected" else f"_{ids[1]}"
        for mate, (s, q) in enumerate(done, 1):
            out.append((f"run{tag}_R{mate}_{to}.fastq.gz", f"{name}_{'_'.join(ids)} {comment or f'{mate}:N:0:0'}\n{s}\n+\n{q}\n"))
    return out, totals


def made_pairs(n, seed):
    r = random.Random(seed)
    seq = lambda k, bases="ACGT": "".join(r.choice(bases) for _ in range(k))
    codes = ["ACGTTTAA", "TTAAACGT", "GGACCTTA", "CATGCATG", "GACCGGTT", "AACCGGTC"]
    inserts = [seq(30) for _ in range(12)]
    for i in range(n):
        code = r.choice(codes) if r.random() < 0.8 else seq(8, "ACGTN")
        if r.random() < 0.3:
            k = r.randrange(8)
            code = code[:k] + r.choice("ACGTN") + code[k + 1 :]
        one = r.choice(["GATC", "GGTC", "GNTC", "AAAA"]) + code + r.choice(["AC", "GT"]) + r.choice(inserts) + r.choice(["", AD, AD[:15], AD[:14], "GGGGGGG", seq(9, "ACGTR")])
        two = seq(2, "AC") + "TT" + r.choice(inserts)
        if r.random() < 0.05:
            one = one[: r.randrange(12)]
        yield f"@r{i}", r.choice(["", "1:N:0:AC"]), [(s, "".join(r.choice("#5?IIII") for _ in s)) for s in (one, two)]


@pytest.mark.parametrize("more", [{}, {"global_rejected": True}, {"trim_barcodes": False, "max_mismatches": 0}])
def test_runs_against_the_plain_version(spark, tmp_path, more):
    pairs = list(made_pairs(300, len(more)))
    config = DemuxConfig(**{"bc_read1": "GRTC|8L|2I", "bc_read2": "2I|2X", "lookup": TABLE.replace("bcRead1-t1", "bcRead1-t2"), "max_mismatches": 1, "trim_barcodes": True, "umi_as_sequence": True, "reject_fixed": True, "deduplicate": True, "adapter_r1": AD, "adapter_r2": AD[:20], "split_on": "bcRead1-t2", "prefix": "run"} | more)
    sides = [spark.createDataFrame([(i, n, c, m + 1, x[m][0], "+", x[m][1]) for i, (n, c, x) in enumerate(pairs)], READ).repartition(5) for m in (0, 1)]
    result = demultiplex(align(*sides), config)
    want, totals = plain_run(pairs, config)
    assert Counter((r["file"], r["text"] + "\n") for r in result.records().collect()) == Counter(want)
    t = result.tables()["ReadStatistics"].first()
    assert (t["TotalReads"], t["TotalWritten"], t["UniqueReads"], t["DuplicateReads"], t["RejectedReads"]) == tuple(totals[k] for k in ("TotalReads", "TotalWritten", "demultiplexed", "duplicated", "rejected"))
    assert result.tables()["Combinations"].agg(F.sum("count")).first()[0] == totals["TotalWritten"]
    if not more:  # through files, in input order
        for m in (0, 1):
            with gzip.open(tmp_path / f"x_R{m + 1}.fastq.gz", "wt") as f:
                f.writelines(f"{n} {c or f'{m + 1}:N:0:0'}\n{x[m][0]}\n+\n{x[m][1]}\n" for n, c, x in pairs)
        (tmp_path / "table.tsv").write_text(config.lookup)
        argv = ["-r", f"{tmp_path}/x_R1.fastq.gz", "-R", f"{tmp_path}/x_R2.fastq.gz", "-o", f"{tmp_path}/out", "-3", config.bc_read1, "-4", config.bc_read2, "-l", f"{tmp_path}/table.tsv", "-m", "1", "-t", "-u", "-f", "-D", "-a", AD, "-A", AD[:20], "-d", "bcRead1-t2", "-p", "run", "--statsTSV"]
        _, said = cli.run(argv, spark)
        assert f"Reads written: {totals['TotalWritten']}" in said
        want, _ = plain_run([(n, c or None, x) for n, c, x in pairs], config)
        by_file = {}
        for file, text in want:
            by_file[file] = by_file.get(file, "") + text
        assert {p.name: gzip.open(p, "rt").read() for p in (tmp_path / "out").glob("*.gz")} == by_file
        lines = (tmp_path / "out" / "run_demux_statistics.tsv").read_text().splitlines()
        assert lines[0] == "table\tkey\tassigned_name\tcount\taverage_quality" and f"ReadStatistics\tTotalReads\tNA\t{totals['TotalReads']}\tNA" in lines
        assert cli.run([*argv, "--checkDesign"], spark)[0] is None


def test_fastq_files(spark, tmp_path):
    record = "@a 1:N:0:X\nACGT\n+\nIIII\n"
    whole = gzip.compress(record.encode()) + gzip.compress(b"@b/2\nAC\n+x\nI]\n")
    (tmp_path / "a.gz").write_bytes(whole)
    rows = [tuple(r) for r in fastq.read(spark, f"{tmp_path}/a.gz").orderBy("rec").collect()]
    assert rows == [(0, "@a", "1:N:0:X", 1, "ACGT", "+", "IIII"), (1, "@b", "", 2, "AC", "+x", "I]")]
    (tmp_path / "plain").write_text("".join(f"@r{i} 1:\nACGT\n+\nIIII\n" for i in range(5000)))
    assert [r["rec"] for r in fastq.read(spark, f"{tmp_path}/plain").collect()] == list(range(5000))
    (tmp_path / "cr").write_bytes(b"@a\r\nAC\r\n+\r\nII\r\n")
    assert fastq.read(spark, f"{tmp_path}/cr").first()["seq"] == "AC\r"
    (tmp_path / "empty").write_bytes(b"")
    assert fastq.read(spark, f"{tmp_path}/empty").count() == 0
    (tmp_path / "cut.gz").write_bytes(gzip.compress(record.encode() * 5000)[:-200])
    (tmp_path / "three").write_text(record + "@b\nAC\n+\n")
    (tmp_path / "uneven").write_text("@b\nAC\n+\nI\n")
    fails(fastq.read(spark, f"{tmp_path}/cut.gz"), "(?i)end of|EOF|corrupt|FAILED_READ")
    fails(fastq.read(spark, f"{tmp_path}/three"), "cut short")
    fails(fastq.read(spark, f"{tmp_path}/uneven"), "2 bases and 1 qual")


def test_header_runs(spark):
    wide = align(reads(spark, [INS], comment="1:N:0:ACGTACGT+TTGCAACT"))
    config = DemuxConfig(bc_index1="8I", bc_index2="4X|4I", indexes_in_header=True, umi_as_sequence=True)
    row = demultiplex(wide, config).processed.first()
    assert row["name_out"] == "@r0_ACGTACGT_AACT" and row["i1_t1_qual"] == "J" * 8
    fails(demultiplex(align(reads(spark, [INS], comment="1:N:0:1")), config, keep=False).processed, "no index")
    fails(demultiplex(align(reads(spark, [INS], comment="1:N:0:AC+GT+AA")), config, keep=False).processed, "more than two")
    fails(demultiplex(align(reads(spark, [INS], comment="1:N:0:ACGTACGT")), config, keep=False).processed, "only one")
    bare = demultiplex(align(reads(spark, [INS])), DemuxConfig()).records().first()
    assert bare["text"].startswith("@r0_ 1:N:0:0\n") and bare["file"] == "reads_R1_demultiplexed.fastq.gz"


def test_diagnostics(spark):
    t = tokens({"bcRead1": parse("8L")})[0]
    table = {"ACGTTTAA": lookup.Entry("a", False), "GACCGGTT": lookup.Entry("b", True)}
    df = assign.assign(slice_tokens(align(reads(spark, ["ACGTTTAA"] + ["GACCGGTT"] * 3 + ["TTTTTTTT"] * 4 + ["CCCCCCCC"] * 4)), {"bcRead1": parse("8L")}), t, table)
    counted = stats.barcode_table(df, t)
    assert stats.listing(counted, 2) == "CCCCCCCC\tUn\t4\nTTTTTTTT\tUn\t4"
    row = stats.orientation(counted).first()
    assert (row["pct_sense"], row["pct_rc"], round(row["pct_unassigned"], 3), row["note"]) == (25.0, 75.0, 66.667, "mixed")
    assert [(r["seq"], r["count"]) for r in stats.top_unassigned({"x": counted}).orderBy("place").collect()] == [("CCCCCCCC", 4), ("TTTTTTTT", 4)]


def test_many_files(spark, tmp_path, monkeypatch):
    """Lanes: one task a file, records numbered file by file, mates paired by file."""
    for mate in (1, 2):
        for lane in (2, 1, 3):
            with gzip.open(tmp_path / f"L{lane}_R{mate}.fastq.gz", "wt") as f:
                f.writelines(f"@l{lane}r{i} {mate}:N:0:AC\n{'ACGT' * lane}\n+\n{'IIII' * lane}\n" for i in range(200 * lane))
    df = fastq.read(spark, f"{tmp_path}/*_R1.fastq.gz")
    rows = df.orderBy("rec").collect()
    assert [r["name"] for r in rows] == [f"@l{n}r{i}" for n in (1, 2, 3) for i in range(200 * n)]
    assert [r["rec"] for r in rows] == [(n << fastq.FILE_SHIFT) + i for n, k in enumerate((200, 400, 600)) for i in range(k)]
    given = fastq.read(spark, f"{tmp_path}/L3_R1.fastq.gz,{tmp_path}/L1_R1.fastq.gz")
    assert [r["name"] for r in given.orderBy("rec").collect()][:601:600] == ["@l3r0", "@l1r0"]
    wide = align(df, fastq.read(spark, f"{tmp_path}/*_R2.fastq.gz"))
    assert wide.count() == 1200 and len(fastq.files(spark, str(tmp_path))) == 6
    (tmp_path / "a b").mkdir()
    with gzip.open(tmp_path / "a b" / "x y%.fastq.gz", "wt") as f:
        f.write("@s 1:\nAC\n+\nII\n")
    assert [r["name"] for r in fastq.read(spark, f"{tmp_path}/a b/x y%.fastq.gz").collect()] == ["@s"]
    (tmp_path / "plain.fastq").write_text("@p 1:\nAC\n+\nII\n")
    both = fastq.read(spark, f"{tmp_path}/plain.fastq,{tmp_path}/L1_R1.fastq.gz").orderBy("rec").collect()
    assert both[0]["name"] == "@p" and both[1]["rec"] == 1 << fastq.FILE_SHIFT and len(both) == 201
    with gzip.open(tmp_path / "L4_R1.fastq.gz", "wt") as f:
        f.write("@x 1:\nAC\n")
    fails(fastq.read(spark, f"{tmp_path}/*_R1.fastq.gz"), "L4_R1.fastq.gz: the last record is cut short")
    with pytest.raises(ValueError, match="cannot open"):
        fastq.read(spark, f"{tmp_path}/missing.gz")
    with pytest.raises(cli.ConfigError, match="as many files"):
        cli.run(["-r", f"{tmp_path}/L1_R1.fastq.gz,{tmp_path}/L2_R1.fastq.gz", "-R", f"{tmp_path}/L1_R2.fastq.gz", "-o", f"{tmp_path}/o"], spark)
    argv = ["-r", f"{tmp_path}/L1_R1.fastq.gz,{tmp_path}/L2_R1.fastq.gz", "-R", f"{tmp_path}/L1_R2.fastq.gz,{tmp_path}/L2_R2.fastq.gz", "-o", f"{tmp_path}/o", "-p", "x", "-k", "12", "--statsTSV", "--statsParquet", f"{tmp_path}/stats"]
    said = cli.run(argv, spark)[1]
    assert "Reads processed: 600" in said and "Reads written: 0" in said and "Reads a minute" in said and "Peak memory" in said
    monkeypatch.setattr(cli, "summary", None)  # a failing last step takes all outputs with it
    with pytest.raises(TypeError):
        cli.run(argv, spark)
    assert not list((tmp_path / "o").iterdir()) and not list((tmp_path / "stats").iterdir())


def test_loose_indexes_and_unmerged_files(spark, tmp_path):
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f, gzip.open(tmp_path / "i.fastq.gz", "wt") as g:
        f.writelines(f"@r{i} 1:N:0:A\n{INS}\n+\n{'I' * len(INS)}\n" for i in range(6))
        g.writelines(f"@r{i} 1:N:0:A\n{'ACGT' if i < 3 else 'GGGG'}\n+\nIIII\n" for i in (0, 1, 2, 4))
    argv = ["-r", f"{tmp_path}/r.fastq.gz", "-i", f"{tmp_path}/i.fastq.gz", "-1", "4I", "-u", "-o", f"{tmp_path}/out", "-d", "bcIndex1-t1", "-p", "x", "--keepQuiet"]
    with pytest.raises(Exception, match="do not match"):
        cli.run(argv, spark)
    _, said = cli.run([*argv, "--looseIndex", "--noMerge", "--statsTSV"], spark)
    names = {p.name for p in (tmp_path / "out").iterdir() if p.name.endswith(".gz")}
    assert names == {f"x_{t}_R1_demultiplexed.fastq.gz" for t in ("ACGT", "GGGG", "Un")} and all((tmp_path / "out" / n).is_dir() for n in names)
    assert (tmp_path / "out" / "x_demux_statistics.tsv").is_dir()
    with pytest.raises(ValueError, match="3 output files"):
        cli.run([*argv, "--looseIndex", "--maxFiles", "2", "-o", f"{tmp_path}/other"], spark)
    header = ["-r", f"{tmp_path}/h.fastq.gz", "-H", "-1", "4I|2X", "-2", "GGRC", "--checkDesign"]
    with gzip.open(tmp_path / "h.fastq.gz", "wt") as f:
        f.write(f"@a 1:N:0:ACGTAA+GGAC\n{INS}\n+\n{'I' * len(INS)}\n@b 1:N:0:TTTTAA+GGTC\n{INS}\n+\n{'I' * len(INS)}\n")
    shown = cli.run(header, spark)[1]
    assert "t1 ACGT" in shown and "t1 GGAC  <- matches" in shown and "t1 GGTC  <- NO MATCH" in shown
    with pytest.raises(cli.ConfigError, match="not from both"):
        cli.run(["-r", f"{tmp_path}/r.fastq.gz", "-i", f"{tmp_path}/i.fastq.gz", "-H", "-o", f"{tmp_path}/x"], spark)
    short = ["-r", f"{tmp_path}/r.fastq.gz", "-3", "40I", "-u", "-f", "-k", "12", "-o", f"{tmp_path}/s", "--keepQuiet"]
    assert "Rejected reads: 0" in cli.run(short, spark)[1] and "Rejected reads: 6" in cli.run([*short, "--shortRead", "reject"], spark)[1]


def test_names_beyond_a_broadcast(spark, monkeypatch):
    """Popular, rare, missing and unknown tokens get the same names on both ways."""
    t = tokens({"bcRead1": parse("4L|4I")})
    seqs = [r for i in range(40) for r in ["ACGT" + "GGGG"] * 3 + [f"{'ACGT'[i % 4] * 4}{'ACGT'[i % 3] * 2}AC"]] + ["ACG", ""]
    df = slice_tokens(align(reads(spark, seqs)), {"bcRead1": parse("4L|4I")})
    table = {"ACGT": lookup.Entry("a", False), "AAAA": lookup.Entry("b", True), "CCCC": lookup.Entry("c", False)}
    found = []
    for most, popular in ((50_000, 100_000), (1, 50), (0, 1), (2, 100_000)):
        monkeypatch.setattr(assign, "MOST_BROADCAST", most)
        monkeypatch.setattr(assign, "POPULAR", popular)
        named = assign.assign(assign.assign(df, t[0], table), t[1])
        assert named.columns == [*df.columns, "r1_t1_id", "r1_t1_rc", "r1_t2_id"]
        found.append(sorted(map(tuple, named.select("rec", "r1_t1_id", "r1_t1_rc", "r1_t2_id").collect())))
    assert all(x == found[0] for x in found) and len(found[0]) == len(seqs)


def test_stream(spark, tmp_path):
    config = DemuxConfig(bc_read1="8L", lookup=TABLE.replace("bcRead1-t1", "any"), trim_barcodes=True, deduplicate=True, min_length=12)
    seqs = ["ACGTTTAA" + INS, "ACGTTTAA" + INS, "CATGCATG" + INS, "AAAAAAAA" + INS, "ACGT"]
    wide = align(reads(spark, seqs)).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    wide.write.parquet(f"{tmp_path}/in")
    names = stream.lookup_names(spark, config, spark.createDataFrame([(s[:8],) for s in seqs], "seq string"))
    out = stream.demultiplex_stream(spark.readStream.schema(wide.schema).parquet(f"{tmp_path}/in"), config, names, arrived="at").written()
    q = out.writeStream.format("memory").queryName("demuxed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    got = sorted((r["name_out"].split("_")[1], r["destination"]) for r in spark.table("demuxed").collect())
    assert got == [("BC01", "Duplicate"), ("BC01", "Main"), ("BC04", "Main"), ("Un", "Main")]
    with pytest.raises(cli.ConfigError, match="arrival"):
        stream.demultiplex_stream(wide, config, names)


def test_paired_stream_equals_the_batch_run(spark, tmp_path):
    pairs = list(made_pairs(130, 3))
    pairs += [(f"{n}again", c, x) for n, c, x in pairs[::2]]
    config = DemuxConfig(bc_read1="GRTC|8L|2I", bc_read2="2I|2X", lookup=TABLE.replace("bcRead1-t1", "bcRead1-t2"), max_mismatches=1, trim_barcodes=True, umi_as_sequence=True, reject_fixed=True, deduplicate=True, adapter_r1=AD, adapter_r2=AD[:20], split_on="bcRead1-t2", prefix="run")
    sides = [spark.createDataFrame([(i, n, c, m + 1, x[m][0], "+", x[m][1]) for i, (n, c, x) in enumerate(pairs)], READ) for m in (0, 1)]
    wide = align(*sides).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    for part in range(2):  # two micro-batches: the state outlives the first
        wide.where(F.col("rec").between(part * 150, 149 if part == 0 else 999)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    names = stream.lookup_names(spark, config)
    source = spark.readStream.schema(wide.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = stream.demultiplex_stream(source, config, names, arrived="at").records()
    q = out.writeStream.format("memory").queryName("paired").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(240)
    want = Counter(map(tuple, demultiplex(wide.drop("at"), config).records().collect()))
    got = Counter(map(tuple, spark.table("paired").collect()))
    assert sum("duplicated" in f for f, _, _ in want) > 5
    assert Counter((f, t) for f, _, t in got.elements()) == Counter((f, t) for f, _, t in want.elements())
