"""Word splitting, quality rules, decontamination and language model against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import decontaminate, language_model, quality_rules
from readloom.llm.words import ALNUM, IDENTITY, LOWER, NOT_SPACE, pack, split, unpack

DOCS = "doc_id long, text string, n_words string"  # n_words: a column with a clashing name
ODD = [None, "", " ", "\n\n", "a", "\x00b\x00 c", "x\x0by\x0cz", "é É ß", " lead and trail ", "same line\nsame line\n\n \nother", "日本語 テキスト", "a b c a b c a b c"]


def texts(n: int, seed: int = 1) -> list:
    r = random.Random(seed)
    words = ["The", "of", "é", "foo", "bar", "#x", "$", "zweÜ", "a1", "|"]
    made = ["".join(r.choice(words) + r.choice([" ", "\n", "  ", ", ", "\t"]) for _ in range(r.randrange(90))) for _ in range(n)]
    return ODD + made + ODD[:4] + ["w" * 50_000 + " tail", "long text " * 20_000]


def table(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def documents(spark, n=60, seed=1):
    rows = [(i, t, "x") for i, t in enumerate(texts(n, seed))]
    return rows, table(spark, rows)


def test_split():
    for member, change, pattern in ((NOT_SPACE, IDENTITY, r"[^\x20\x09-\x0D]+"), (ALNUM, LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        column = texts(30)
        w = split(pa.array(column, pa.string()), member, change)
        low = lambda t: re.sub("[A-Z]+", lambda m: m.group().lower(), t or "") if change is LOWER else t or ""
        want = [re.findall(pattern, low(t)) for t in column]
        got = [x.decode() for x in w.words.to_pylist()]
        assert got == [x for ws in want for x in ws]
        assert np.diff(w.bounds).tolist() == [len(x) for x in want]
    assert len(split(pa.array([], pa.string()), NOT_SPACE, IDENTITY).words) == 0
    sliced = pa.array(["skip", "a b", None, "c"]).slice(1)
    assert split(sliced, NOT_SPACE, IDENTITY).words.to_pylist() == [b"a", b"b", b"c"]


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    covered = {}
    for n in (3, *quality_rules.MOST_IN_NGRAMS):
        count = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        covered[n] = {j for i in range(len(words) - n + 1) if count[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    seen, dup, lines, dup_chars = set(), 0, 0, 0
    for line in (text or "").split("\n"):
        solid = sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
        lines += solid > 0
        if solid and line in seen:
            dup, dup_chars = dup + 1, dup_chars + solid
        seen.add(line)
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
    base = len(words) < 50 or 100 * len(covered[3]) > 50 * len(words)
    bad = any(sum(len(words[j]) for j in covered[n]) > most * max(chars, 1) for n, most in quality_rules.MOST_IN_NGRAMS.items())
    bad |= dup_chars > quality_rules.MOST_IN_LINES * max(chars, 1) or dup > quality_rules.MOST_LINES * max(lines, 1) or symbols > quality_rules.MOST_SYMBOLS * max(len(words), 1)
    return len(words), chars, symbols, dup, len(covered[3]), base, not (base or bad)


def test_quality_rules(spark):
    rows, df = documents(spark)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == plain_rules(text), i
        assert (r["reason"] is None) == r["kept"]
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def plain_hits(text, items, size=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    words, hit, names = fold(text), set(), set()
    for name, item in items:
        w = fold(item)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add(str(name) if name is not None else "")
    return len(words), sorted(hit), sorted(names)


@pytest.mark.parametrize("most", [1_000_000, 40, 1])
def test_decontamination(spark, most):
    r = random.Random(5)
    vocabulary = ["the", "of", "Rare%d" % r.randrange(9), "é", "x9", "and"] + [f"w{i}" for i in range(12)]
    passage = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, passage(k)) for i, k in enumerate((30, 12, 10, 9, 3, 1))] + [(50, None), (51, ""), (52, "..."), (3, passage(11)), (None, passage(14))]
    rows = []
    for i in range(40):
        words = passage(r.randrange(60)).split()
        if i % 3 == 0:
            item = (items[r.randrange(len(items))][1] or "").upper().split()
            words[5:5] = item[r.randrange(3) :]
        rows.append((i, ", ".join(words)))
    rows += [(i + 100, t) for i, t in enumerate(ODD)] + [(7, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["hits"], r["items"]) for r in decontaminate.find_contamination(df, bench, most=most).collect()), key=str)
    assert got == sorted(((i, *plain_hits(t, items)) for i, t in rows), key=str)
    kept = sorted((str(x["doc_id"]) for x in decontaminate.drop_contaminated(df, bench).collect()))
    assert kept == sorted(str(i) for i, t in rows if not plain_hits(t, items)[1])
    assert decontaminate.find_contamination(df, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


def test_phrases_stay_in_their_document(spark):
    df = spark.createDataFrame([(0, "a b c"), (1, "d e f")], "doc_id long, text string").coalesce(1)
    found = decontaminate.find_contamination(df, spark.createDataFrame([(1, "c d")], "item_id long, text string")).collect()
    assert all(not r["hits"] and not r["near_items"] for r in found)


def test_proximity(spark):
    rows = [(0, "one two three four"), (1, "four three x two one"), (2, "one " + "x " * 30 + "two three four"), (3, "one two three")]
    found = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "one two three four")], "item_id long, text string"))
    assert {r["doc_id"]: (bool(r["hits"]), bool(r["near_items"])) for r in found.collect()} == {0: (True, True), 1: (False, True), 2: (False, False), 3: (False, False)}


def plain_scores(rows, order=3, backoff=0.4):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    grams = [[Counter(tuple(d[i : i + n]) for i in range(len(d) - n + 1)) for n in range(1, order + 1)] for d in docs]
    total = [Counter() for _ in range(order)]
    for g in grams:
        for a, b in zip(total, g, strict=True):
            a.update(b)
    for (i, _), d, own in zip(rows, docs, grams, strict=True):
        c = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        rest, score, found = sum(map(len, docs)) - len(d), 0.0, [0] * order
        for k in range(len(d)):
            penalty = 0.0
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(d[k - n + 1 : k + 1])
                if c(g):
                    score += penalty + math.log(c(g) / (c(g[:-1]) if n > 1 else rest))
                    found[n - 1] += 1
                    break
                penalty += math.log(backoff)
            else:
                score += penalty - math.log(rest + 1)
        yield i, len(d), score, found


@pytest.mark.parametrize(("words", "size"), [(1_000_000, 4 << 20), (40, 64)])
def test_language_model(spark, words, size):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(30)))) for i in range(60)] + [(100, None), (101, ""), (102, "zz yy zz"), (5, "a b c d"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x["doc_id"], x["n_words"], round(x["log_score"], 6), [x["found_1"], x["found_2"], x["found_3"]]) for x in language_model.score(df, segment_words=words, bucket_bytes=size).collect()), key=str)
    assert got == sorted(((i, n, round(s, 6) + 0.0, f) for i, n, s, f in plain_scores(rows)), key=str)
    assert language_model.score(df.limit(0)).count() == 0


def test_blocks_are_no_more_than_n_grams(spark, monkeypatch):
    """However many partitions the count tables have, and packed or not, the scores are the same."""
    r = random.Random(4)
    rows = [(f"d{i}", " ".join(r.choice("abcdefghijkl") for _ in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    want = sorted((i, round(s, 6) + 0.0) for i, _, s, _ in plain_scores(rows))
    for least in (0, 64):
        monkeypatch.setattr(language_model, "LEAST_PACKED", least)
        got = language_model.score(df, segment_words=200, bucket_bytes=1).collect()
        assert sorted((x["doc_id"], round(x["log_score"], 6)) for x in got) == want
    cut = language_model.segments(df, most=200)
    empty = cut.selectExpr("*", "cast(array() as array<struct<round:int,bucket:bigint,packed:boolean,totals:binary>>) AS answers")
    whole = Counter(g for _, t in rows for w in [t.split()] for g in [*w, *zip(w, w[1:])])
    for size in (4 << 20, 1):
        counted = language_model.count_tables(df, segment_words=200, bucket_bytes=size).where("round = 0")
        assert Counter(r["total"] for r in counted.collect()) == Counter(n for n in whole.values() if n > 1)
    blocks = empty.mapInArrow(language_model._blocks(3, 1 << 30, 0), language_model.BLOCK).count()
    assert blocks <= sum(len({*t.split(), *zip(t.split(), t.split()[1:])}) for _, t in rows)


def test_counts_are_packed():
    values = np.array([0, 1, 255, 256, 2**63], np.uint64)
    assert unpack(pack(values)).tolist() == values.tolist() and unpack(pack(values[:0])).tolist() == []


def test_one_index_serves_several_benchmarks(spark, monkeypatch):
    rows, df = documents(spark, 30, seed=9)
    index = decontaminate.build_index(df)
    monkeypatch.setattr(decontaminate, "build_index", None)
    for items in ([(1, "foo bar a1 the"), (2, "é")], [("x", rows[20][1]), ("y", "of")]):
        bench = spark.createDataFrame(items, f"item_id {'long' if items[0][0] == 1 else 'string'}, text string")
        got = sorted(((r["doc_id"], r["n_words"], r["hits"], r["items"]) for r in decontaminate.search(index, bench).collect()), key=str)
        assert got == sorted(((i, *plain_hits(t, items)) for i, t, _ in rows), key=str)


def test_dropping_keeps_columns_and_ids(spark, monkeypatch):
    rows = [("a", "one two three", 1), ("a", "clean text", 2), (None, "one two three", 3), (None, None, 4), ("b", "x one two three", 5), ("b", "x one two three", 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, bad_id int").coalesce(2)
    bench = spark.createDataFrame([(1, "One, two three")], "item_id long, text string")
    for most in (200_000, 0):
        monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
        got = decontaminate.drop_contaminated(df, bench)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[3]], key=str)


def test_long_texts_in_little_memory():
    """One text of 100 MB: what numpy and Python hold at once, as a multiple of the text."""
    import tracemalloc

    from readloom.llm import quality_classifier, simhash

    r = np.random.default_rng(1)
    words = np.array([f"w{i}x" if i % 9 else f"w{i}\n" for i in range(50_000)])
    text = " ".join(words[r.integers(0, len(words), 14_500_000)].tolist())
    assert len(text) > 95 << 20
    column = pa.array([text], pa.string())
    del text
    for job, most in ((lambda: quality_rules.measures(column, list(quality_rules.MOST_IN_NGRAMS)), 10), (lambda: simhash.fingerprints(column), 10), (lambda: quality_classifier.features(column), 10)):
        tracemalloc.start()
        job()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(column[0].as_buffer()), peak / len(column[0].as_buffer())


def test_positions_beyond_32_bits_of_term_and_place(spark, monkeypatch):
    """A large segment: terms times positions exceed 32 bits."""
    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randrange(9_000)}" for _ in range(1_500))) for i in range(250)]
    items = [(i, " ".join(rows[i][1].split()[40:70])) for i in range(0, 250, 5)] + [(1000 + i, " ".join(f"w{r.randrange(9_000)}" for _ in range(40))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {x["doc_id"]: (x["items"], x["hits"]) for x in found.collect()}
    assert {i: x for i, x in got.items() if x[0]} == {i: ([str(i)], list(range(40, 70))) for i in range(0, 250, 5)}


def test_operators_leave_the_session_as_it_is(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before, catalog = [spark.conf.get(k) for k in keys], {t.name for t in spark.catalog.listTables()}
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(5)], "doc_id long, text string")
    assert language_model.score(df).count() == quality_rules.quality_rules(df).count() == decontaminate.find_contamination(df, df.withColumnRenamed("doc_id", "item_id")).count() == 5
    assert [spark.conf.get(k) for k in keys] == before and {t.name for t in spark.catalog.listTables()} == catalog
