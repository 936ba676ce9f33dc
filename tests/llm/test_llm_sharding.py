"""op9_sharding deals whole documents."""

import zlib
from collections import Counter

from readloom.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def test_query_deals_whole_documents(spark, monkeypatch):
    docs, dealt = spark.read.parquet(f"{SF}/documents.parquet"), []

    def watched(df, keys, **more):
        dealt.append(sharding_of(df, keys, **more))
        return dealt[0]

    sharding_of = sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", watched)
    got = queries.op9_sharding(spark, SF).collect()
    assert Counter(map(tuple, dealt[0].select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    body = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(b) + 1, zlib.crc32(b)) for i, b in body.items()}
    assert max(Counter(r["shard"] for r in got).values()) - min(Counter(r["shard"] for r in got).values()) <= 1


def test_long_texts_make_more_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 1000 if i % 3 else None) for i in range(200)], "doc_id long, text string").repartition(3)
    asked, sizes = [], sharding.block_sizes
    monkeypatch.setattr(sharding, "block_sizes", lambda *a: asked.append(a) or sizes(*a))
    monkeypatch.setattr(sharding, "BLOCK_BYTES", 5_000, raising=False)
    got = sharding.shuffle_into_shards(df, ["doc_id"], shards=4).collect()
    assert asked[0][2] > 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(50))
