"""The near-duplicate stage against brute-force five-word similarity."""

import itertools
import random

import corpus_pipeline as cp
import numpy as np
import pytest

from readloom.llm import similar, simhash
from tests.llm.test_llm_structure import plain_fingerprint


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def survivors(rows):
    """The smallest id of each component of rows (id, text) linked at 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
    return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == x) for x in set(root))


def stored(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_near_duplicate_stage(spark, monkeypatch, tmp_path):
    r = random.Random(8)
    rows = []
    for n in (1, 4, 5, 6, 30, 80, 200, 248, 600):
        first = [f"w{r.randrange(5000)}" for _ in range(n)]
        rows.append(first)
        for edits in (1, 2, 3, 4, 6, 9, 14):
            other = list(first)
            for _ in range(edits):
                other[r.randrange(n)] = f"x{r.randrange(5000)}"
            rows += [other, ["License", "notice:", "use", "it", "as", "you", "like", *other]]
    texts = [*(" ".join(w) for w in rows), "", None, " \n", " ".join(rows[-1]).upper()]
    rows = list(zip(r.sample(range(1000), len(texts)), texts, strict=True))
    docs = stored(spark, tmp_path, rows)
    want = survivors(rows)
    assert len(want) < len(rows) - 20
    for most in (200_000, 0):
        monkeypatch.setattr(similar, "MOST_BROADCAST", most)
        monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
        assert sorted(x["doc_id"] for x in cp.near_duplicates(spark, docs, "").collect()) == want


def test_stage_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(x["doc_id"] for x in cp.near_duplicates(spark, docs, "").collect())
    assert got == survivors([(x["doc_id"], x["text"]) for x in docs.collect()])


def test_texts_without_an_own_id_stay(spark, tmp_path):
    rows = [(None, f"lost text {i} number {i} of some {i}") for i in range(5)] + [(7, f"again text {i} number {i} of many {i}") for i in range(4)]
    rows += [(None, rows[0][1]), (7, rows[5][1]), (8, rows[1][1])]
    docs = stored(spark, tmp_path, rows)
    want = sorted([(8, rows[1][1]), *((-1, t) for i, t in rows[:5] if t != rows[1][1]), *rows[5:9]])
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["text"]) for x in cp.near_duplicates(spark, docs, "").collect()) == want


def test_rows_that_are_numbered_otherwise_fail_the_job(spark):
    rows = [(i, "the same words again and again " * 3 if i % 2 else f"other words {i} and some more of them") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    named = similar.named_sets(docs)
    with pytest.raises(Exception, match="numbered otherwise"):
        simhash.keep_one(docs.where("doc_id > 3"), named, similar.links(docs, named)).collect()


def test_several_families_that_share_a_key(spark, tmp_path):
    """Texts of one key that are not alike, some of them alike among each other but not like the key's smallest set."""
    r = random.Random(5)
    shared = [f"s{i}" for i in range(8)]
    rows = []
    for k in range(6):
        body = [f"w{k}x{i}" for i in range(30 + 2 * k)]
        for _ in range(5):
            other = list(body)
            other[r.randrange(len(body))] = f"y{r.randrange(99)}"
            rows.append(" ".join([*shared, *other]))
    rows = list(enumerate(rows))
    docs = stored(spark, tmp_path, rows)
    assert sorted(x["doc_id"] for x in cp.near_duplicates(spark, docs, "").collect()) == survivors(rows)


def test_sketches_discard_no_similar_pair():
    r = np.random.default_rng(3)
    for n in (3, 20, 90, 700, 4_000):
        for _ in range(60):
            whole = r.integers(-(2**62), 2**62, n)
            gone = int(r.integers(0, n // 5 + 1))
            other = np.unique(np.concatenate([whole[gone:], r.integers(-(2**62), 2**62, int(r.integers(0, gone + 1)))]))
            whole = np.unique(whole)
            apart = int(np.bitwise_count((similar.sketch(whole) ^ similar.sketch(other)).view(np.uint64)).sum())
            both = len(np.intersect1d(whole, other))
            assert apart <= len(whole) + len(other) - 2 * both
            if 10 * both >= 8 * (len(whole) + len(other) - both):
                assert 9 * apart <= len(whole) + len(other)


def test_bands_find_pairs_at_the_limit():
    r = np.random.default_rng(4)
    missed = 0
    for _ in range(400):  # sets of exactly 0.8
        shared = r.integers(-(2**62), 2**62, 80)
        a, b = (np.unique(np.concatenate([shared, r.integers(-(2**62), 2**62, 10)])) for _ in "ab")
        missed += not (similar.bands(a) == similar.bands(b)).any()
        assert not (similar.bands(a) == similar.bands(r.integers(-(2**62), 2**62, 90))).any()
    assert missed == 0
    assert (similar.bands(a, most=7) == similar.bands(a)).all() and len(similar.bands(a[:0])) == similar.BANDS


def test_stage_links_by_fingerprints_and_by_words(spark, tmp_path):
    """Groups are what two bits of SimHash and five-word similarity connect together, each of them needed."""
    r = random.Random(12)
    rows, seen = [], set()
    for k in range(9):
        often = [f"o{k}x{i}" for i in range(7)] * 20
        for n in (0, 60, 80, 100, 130):  # few other bits, quite other sets
            rows.append(" ".join([*often, *(f"t{r.randrange(10**6)}" for _ in range(n))]))
    body = [f"b{i}" for i in range(120)]
    rows += [" ".join([f"c{i}" for i in range(7)] * n + body) for n in (2, 60)]  # equal sets, other bits
    rows += [" ".join([*body[:k], "other", *body[k + 1 :]]) for k in (30, 70)]
    rows = list(zip(r.sample(range(1000), len(rows)), rows, strict=True))
    fps, sets = [plain_fingerprint(t) for _, t in rows], [shingles(t) for _, t in rows]

    def left(bits, words):
        root = list(range(len(rows)))
        for i, j in itertools.combinations(range(len(rows)), 2):
            near, alike = (fps[i] ^ fps[j]).bit_count() <= 2, 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
            seen.add((fps[i] ^ fps[j]).bit_count() if not alike else -1)
            if (bits and near) or (words and alike):
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
        return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == x) for x in set(root))

    want = left(True, True)
    assert {0, 1, 2, 3, -1} <= seen and len({len(want), len(left(True, False)), len(left(False, True))}) == 3
    got = sorted(x["doc_id"] for x in cp.near_duplicates(spark, stored(spark, tmp_path, rows), "").collect())
    assert got == want
