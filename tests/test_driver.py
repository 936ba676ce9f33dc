"""Designs, lookup tables, names, packing and trimming: fixed examples, without files."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.functions import dna_codec, iupac
from readloom.operators import route, trim
from readloom.plans import check
from readloom.plans.demux import ConfigError, DemuxConfig
from readloom.plans.design import DesignError, parse, resolve, tokens
from readloom.sources import lookup

AD = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
INS = "ACGTTGCAACTGATTCCATGCTAA"


def test_designs():
    d = parse("14X|GATC*ATGC*TTTT|8I|10L")
    assert [(s.kind, s.size) for s in d.segments] == [("X", 14), ("S", 4), ("I", 8), ("L", 10)]
    assert (d.total, d.starts, d.ends, len(d.tokens)) == (36, [0, 14, 18, 26], [13, 17, 25, 35], 3)
    assert d.segments[1].sequences == ("GATC", "ATGC", "TTTT") and str(d) == "14X|GATC*ATGC*TTTT|8I|10L"
    assert [(s.kind, s.size) for s in parse("8|20|8").segments] == [("L", 8), ("L", 20), ("L", 8)]
    d = parse("15X|8L|30X|8L|30X|8L")
    assert d.total == 99 and [s.number for s in d.tokens] == [2, 4, 6]
    for blank in ("", "   ", None):
        assert (parse(blank).starts, parse(blank).ends) == ([0], [])
    assert parse("8L|").total == 8 and parse("GATC*").total == 4
    for bad in ("|8L", "8L||4I", "*GATC", "GATC**ATGC", "0L", "L", "-3I", "8l", "8L | 4I", "GAZC", "GATC*ATG", "99999999999999999999I"):
        with pytest.raises(DesignError):
            parse(bad)


def test_token_names():
    designs = {"bcIndex1": parse("8X|8I|10I"), "bcIndex2": parse("8I|10I"), "bcRead1": parse("10I|CATGTA"), "bcRead2": parse("10X|41I|8I")}
    names = lambda spec: [(t.design, t.segment.number) for t in resolve(spec, designs)]
    assert names("bcIndex1-t2|bcIndex2-t2") == [("bcIndex1", 2), ("bcIndex2", 2)]
    assert names("bcRead2-t3|bcIndex1-t3") == [("bcIndex1", 3), ("bcRead2", 3)]
    assert names("bcIndex1-t2 | bcIndex1-t2") == [("bcIndex1", 2)] * 2 and names("") == []
    for bad in ("bcIndex1", "bcFoo-t1", "bcIndex1-t1", "bcIndex1-t0", "bcIndex1-t9"):
        with pytest.raises(DesignError):
            resolve(bad, designs)
    with pytest.raises(DesignError, match="bcFoo-t1.*no token 9"):
        resolve("bcFoo-t1|bcIndex1-t9", designs)


TABLE = "BC01\tACGTTTAA\tS|any\nBC02\tTTAAACGT\tS|any\nBC03\tGGRCCTTA\tSR|bcRead1-t1\n# comment\nBC04\tCATGCATG // palindrome\nBC05\tAACCGGTC\tR\n\nshort\n"


def test_lookup_table():
    designs = {"bcIndex1": parse("8L"), "bcRead1": parse("8L")}
    rows = lookup.parse(TABLE)
    assert [r.name for r in rows] == ["BC01", "BC02", "BC03", "BC04", "BC05"]
    index, read = (lookup.by_token(rows, designs)[t] for t in tokens(designs))
    assert read["CATGCATG"] == lookup.Entry("BC04", False) and read["GACCGGTT"] == lookup.Entry("BC05", True) and "AACCGGTC" not in read
    assert "GGRCCTTA" in read and "GGRCCTTA" not in index and "TAAGGYCC" in read
    for third in ("any", "sr", "S|", "foo", "S|bcRead9-t1"):
        with pytest.raises(ValueError):
            lookup.parse(f"a\tACGT\t{third}")
    with pytest.raises(ValueError):
        lookup.by_token(lookup.parse("a\tACGT\tS|bcRead2-t1"), designs)
    for stored_nowhere in ("X|any", "|any"):
        assert not any(lookup.by_token(lookup.parse(f"a\tACGTACGT\t{stored_nowhere}"), designs).values())
    with pytest.raises(ValueError):
        lookup.parse("a\tACGT\r\nb\tACGA\r\n")
    later = lookup.by_token(lookup.parse("a\tACGTACGA\tS\nb\tACGTACGA\tS"), designs)
    assert all(t["ACGTACGA"].name == "b" for t in later.values())


def test_table_density():
    e = lookup.Entry
    table = {"AAAAAAAC": e("x", False), "AAAAAAAG": e("y", False), "AAAAAATT": e("x", False), "CC": e("z", False)}
    assert lookup.smallest_distance(table)[0] == 1 and lookup.smallest_distance({"A": e("x", False)}) is None
    assert "differ in 1" in lookup.density_warning(table, 1) and lookup.density_warning(table, 0) is None


def test_smallest_distance_is_exact_at_any_size():
    e, r = lookup.Entry, random.Random(2)
    for size, alphabet in ((30, "ACGTN"), (200, "ACGT"), (6_000, "ACGT")):
        table = {"".join(r.choice(alphabet) for _ in range(r.choice([9, 10]) if size < 1000 else 14)): e(f"n{r.randrange(size)}", False) for _ in range(size)}
        if size < 1000:
            want = min((iupac.hamming_py(a, b), a, b) for a in table for b in table if a < b and len(a) == len(b) and table[a].name != table[b].name)
            assert lookup.smallest_distance(table) == want
    near = "ACGTACGTACGTAC"
    table |= {near: e("x", False), near[:-1] + "G": e("y", False)}
    assert lookup.smallest_distance(table)[0] == 1 and "differ in 1" in lookup.density_warning(table, 1)


def test_config_errors():
    for bad in ({"bc_read1": "8L"}, {"indexes_in_header": True}, {"bc_read2": "8I"}, {"min_length": 11}, {"global_rejected": True}, {"trim_quality": -1}, {"diff_fraction": 101}, {"threads": 0}, {"split_on": "bcRead1-t1"}, {"short_read": "x"}):
        with pytest.raises((ConfigError, DesignError)):
            DemuxConfig(**bad).validate(False, True)
    DemuxConfig(bc_read1="8I", max_mismatches=-1, trim_quality=0).validate()


@given(st.text("ACGTRYSWKMBDHVNacgtn", max_size=40))
@settings(max_examples=60, deadline=None)
def test_reverse_complement_is_its_own_inverse(s):
    assert iupac.reverse_complement(iupac.reverse_complement(s)) == s


@given(st.text("ACGTNacgtn", max_size=300))
@settings(max_examples=100, deadline=None)
def test_packing_folds_case_only(s):
    assert dna_codec.decode(dna_codec.encode(s)) == s.upper()


def test_packed_bytes():
    for s, packed in (("ACGT", "04e400"), ("ACGTNACGTTTTACGGGNA", "13e490ffa40203100002"), ("A" * 20, "14000000000000"), ("N" * 20, "14000000000003ffff0f"), ("ACGT" * 5, "14e4e4e4e4e400"), ("", "0000")):
        assert dna_codec.encode(s).hex() == packed and dna_codec.decode(bytes.fromhex(packed)) == s
    with pytest.raises(ValueError):
        dna_codec.encode("ACGTX")


def plain_overlap(read, adapter, most=2, require=15, pct=0.1):
    best = None
    n, m = len(read), len(adapter)
    if n < require or not m:
        return None
    for back, offsets in ((False, range(n - require + 1)), (True, range(1 - m, 0))):
        for o in offsets:
            size = min(n, m + o) if back else min(n - o, m)
            if size < require and (back or o + size < n):
                continue
            a = adapter[-o:] if back else adapter
            r = read if back else read[o:]
            diff = sum(x != y and x != "N" for x, y in zip(r[:size], a[:size], strict=True))
            if diff <= min(most, int(size * pct)) and (best is None or diff < best[1]):
                best = (o, diff, size)
    return best


def test_overlap_examples():
    for read, want in (
        (INS + AD, (24, 0, 33)), (INS + AD[:15], (24, 0, 15)), (INS + AD[:14], None), (INS + "C" + AD[1:], (24, 1, 33)), (INS + "CC" + AD[2:15], None), (INS + "NN" + AD[2:15], (24, 0, 15)),
        (AD[5:], (-5, 0, 28)), (AD[5:] + "ACGT", (-5, 0, 28)), (INS + "GGGGG", None), ("", None), ("ACGT", None),
    ):
        got = trim.best_overlap([read], AD)[0]
        assert (None if got[0] == trim._NONE else tuple(got)) == want == plain_overlap(read, AD)


def test_overlap_on_random_reads():
    r = random.Random(1)
    reads = []
    for _ in range(400):
        cut = r.randrange(33)
        body = "".join(r.choice("ACGTN") for _ in range(r.randrange(50))) + AD[cut if r.random() < 0.3 else 0 :][: r.randrange(34)]
        reads.append("".join(r.choice("ACGT") if r.random() < 0.04 else c for c in body))
    for adapter in (AD, AD[:16], AD[:5]):
        for require in (15, 6):
            got = trim.best_overlap(reads, adapter, require=require)
            assert [None if g[0] == trim._NONE else tuple(map(int, g)) for g in got] == [plain_overlap(x, adapter, require=require) for x in reads]
    assert np.array_equal(trim.best_overlap([], AD), np.zeros((0, 3)))


def test_preview_and_names():
    d = parse("GRTC|4X|2I")
    assert check.preview(d, "GATCAAAACC") == ["GATCAAAACC", "  t1 GATC  <- matches", "  t2 AAAA", "  t3 CC"]
    assert "NO MATCH" in check.preview(d, "GCTCAAAACC")[1] and "shorter" in check.preview(d, "GATC")[1]
    assert check.layout_rows("bcRead1", d)[1] == ("bcRead1", 2, 5, 8, 4, "exclude", "")
    assert route.base_name("x/file_R1.fastq.gz") == "file_R1" and check.lookup_lines("# a\n//b\n\nx\ty\n") == 1
