"""The pipeline against a plain version, stage by stage, and the registered queries."""

import base64
import hashlib
import os
import re
from collections import Counter

import corpus_pipeline as cp
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__
from readloom.llm import quality_classifier, secrets
from readloom.llm.queries import ORACLE_SQL, QUERIES, held_out
from tests.llm.test_llm_similar import survivors
from tests.llm.test_llm_structure import PATH
from tests.llm.test_llm_text import plain_hits

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in cp.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    rows = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    assert all(s.columns == docs.columns for s in steps[:-1])
    # 1: a plain score with the same model
    model = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out())
    ids = sorted(rows[0])
    score = model.score(quality_classifier.features(pa.array([rows[0][i]["text"] for i in ids])))
    assert sorted(rows[1]) == [i for i, s in zip(ids, score, strict=True) if s >= 0.5]
    # 2: the smallest id of each group
    assert sorted(rows[2]) == survivors([(i, r["text"]) for i, r in rows[1].items()])
    # 3
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t))
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [fold(t)] for i in range(max(1, len(w) - 9))}
    bad = {i for i, r in rows[2].items() for w in [fold(r["text"])] if any(tuple(w[k : k + 10]) in grams for k in range(max(1, len(w) - 9)))}
    assert all(plain_hits(rows[2][i]["text"], items)[1] for i in sorted(bad)[:3])
    assert set(rows[3]) == set(rows[2]) - bad
    # 4: what the made tables hide is masked, nothing else changes
    hidden = r'AKIA[A-Z0-9]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}'
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        want = re.sub(hidden, secrets.MASK, rows[3][i]["text"])
        assert r["text"] == want and r["n_chars"] == len(want)
    # 5
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == plain.encode_ordinary(rows[4][i]["text"])
        assert r["decoded_sha256"] == hashlib.sha256(rows[4][i]["text"].encode()).hexdigest()
    assert {r["doc_id"]: r["ids_sha256"] for r in cp.run(spark, SF).collect()} == {i: r["ids_sha256"] for i, r in rows[5].items()}


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_queries_are_registered():
    found = __spark_entry__.queries()
    assert set(QUERIES) <= set(found) and "pipeline" in found
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in QUERIES}
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(want.fetchall())
