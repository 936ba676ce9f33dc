"""The operators on their tables, with production parameters: one query each, and SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import bpe, chat, decontaminate, language_model, quality_classifier, quality_rules, secrets, sharding, simhash, warc
from readloom.llm.common import stored, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document, and the items whose rarest window terms stand close together in it."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
        F.sha2(F.concat_ws(",", F.array_sort("near_items")), 256).alias("near_items_sha256"),
    )


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose rarest window terms stand close together in a document, exact or not."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("near_items") > 0).select("doc_id", F.explode("near_items").alias("item_id"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and the verdict for every document."""
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates for secrets with the forest's verdict."""
    forest = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), forest)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def token_digests(with_ids: bool = False) -> bpe.Derive:
    """The number of tokens and the digests of the ids and of the bytes that they decode to."""

    def make(use: bpe.Codec, ids: list[bytes]) -> list[pa.Array]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return [pa.array(np.array([len(x) // 4 for x in ids], np.int64)), pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(use.decode(x)) for x in ids], pa.string())]

    return bpe.Derive([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], make, with_ids)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.encode(table(spark, sf_dir, "documents"), *vocabulary(), keep=["doc_id"], derive=token_digests())


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the held-out third are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality_classifier.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    hashed = stored(simhash.with_fingerprint(table(spark, sf_dir, "documents"), keep=["doc_id"]), "fingerprints")
    found = simhash.dedup_components(hashed)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by the trigrams of all others."""
    scored = language_model.score(table(spark, sf_dir, "documents"))
    # Sums of logarithms depend on their order in the last places.
    return scored.select("doc_id", "n_words", (F.round("log_score", 4) + 0.0).alias("log_score"), (F.round("mean_log_score", 6) + 0.0).alias("mean_log_score"), "found_1", "found_2", "found_3")


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    rotated = chat.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rotated.select("conv_id", "speaker", "part", "n_turns", "n_own", "rendered", mask.alias("mask"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt uniformly into 16 shards whose row counts differ by one at most."""
    docs = table(spark, sf_dir, "documents")
    dealt = sharding.shuffle_into_shards(docs, docs.columns)
    body = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(body) + 1).cast("long"), F.crc32(body.cast("binary")).cast("long")
    return dealt.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.xxhash64(body).alias("text_group"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back by the index."""
    index = warc.write_archives(warc.mark_revisits(table(spark, sf_dir, "pages")))
    return warc.read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_quality_rules, op3_secrets, op4_bpe, op5_quality_classifier, op6_simhash, op7_language_model, op8_chat_rotation, op9_sharding, op10_warc, proximity_matches)
}

#: The words of documents and items, windows, and proximity: the six rarest terms that the corpus has, four of them near.
_WINDOWS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ws AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS ts
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
numbered AS (SELECT *, row_number() OVER () AS wid FROM ws),
own AS (SELECT *, count(*) OVER (PARTITION BY wid) AS size FROM (SELECT wid, item_id, n, t, min(j) AS j FROM (SELECT wid, item_id, n, unnest(ts) AS t, unnest(range(1, n + 1)) AS j FROM numbered) GROUP BY wid, item_id, n, t)),
post AS (SELECT * FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE t IN (SELECT t FROM own)),
df AS (SELECT t, count(DISTINCT doc_id) AS f FROM post GROUP BY t),
ranked AS (SELECT wid, item_id, n, t, least(4, size) AS need, row_number() OVER (PARTITION BY wid ORDER BY f, j) AS r FROM own JOIN df USING (t)),
chosen AS (SELECT *, count(*) OVER (PARTITION BY wid) AS c FROM ranked WHERE r <= 6),
pick AS (SELECT * FROM chosen WHERE c >= need),
anchor AS (SELECT wid, item_id, n, need, doc_id, p FROM pick JOIN post USING (t) WHERE r <= c - need + 1),
near AS (SELECT DISTINCT doc_id, item_id FROM (
           SELECT a.doc_id, a.item_id FROM anchor a JOIN pick c ON c.wid = a.wid JOIN post x ON x.doc_id = a.doc_id AND x.t = c.t AND abs(x.p - a.p) < a.n + 5
           GROUP BY a.wid, a.item_id, a.doc_id, a.p, a.need HAVING count(DISTINCT x.t) >= a.need))
"""

_SPACE = r"\x20\x09-\x0D"

ORACLE_SQL: dict[str, str] = {
    "op8_chat_rotation": r"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body) - 1 AS k FROM t),
people AS (SELECT DISTINCT conv_id, speaker AS me FROM t WHERE speaker <> 'system'),
parts AS (SELECT DISTINCT conv_id, k // 256 AS part FROM n WHERE k >= 256),
force AS (SELECT p.conv_id, p.part, -1 AS k, arg_max(n.speaker, n.k) AS speaker, arg_max(n.body, n.k) AS body
          FROM parts p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.speaker = 'system' AND n.k < p.part * 256 GROUP BY p.conv_id, p.part),
shown AS (SELECT conv_id, k // 256 AS part, k, speaker, body FROM n UNION ALL SELECT * FROM force),
r AS (SELECT n.conv_id, me, part, k, coalesce(speaker = me, false) AS own,
             CASE WHEN speaker = me THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head,
             body || '<|end|>' || chr(10) AS said
      FROM shown n LEFT JOIN people ON n.conv_id IS NOT DISTINCT FROM people.conv_id),
s AS (SELECT *, sum(length(head) + length(said)) OVER (PARTITION BY conv_id, me, part ORDER BY k) AS upto FROM r)
SELECT conv_id, me AS speaker, CAST(part AS BIGINT) AS part, count(*) FILTER (k >= 0) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || said, '' ORDER BY k) AS rendered,
       coalesce(string_agg(CAST(upto - length(said) AS BIGINT) || ':' || CAST(upto AS BIGINT), ',' ORDER BY k) FILTER (own), '') AS mask
FROM s GROUP BY conv_id, me, part
""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha256(html) AS digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM f)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
""",
}


def _op2_sql() -> str:
    """The n-gram and line shares in SQL, with the limits of ``quality_rules``."""
    most = quality_rules.MOST_IN_NGRAMS
    lengths = ", ".join(f"({n})" for n in (3, *most))
    over = " OR ".join(f"coalesce(max(cc) FILTER (n = {n}), 0) > {limit} * greatest(any_value(word_chars), 1)" for n, limit in most.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, x) > 1 AS again, length(regexp_replace(x, '[{_SPACE}]', '', 'g')) AS c
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^{_SPACE}]')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup, coalesce(sum(c) FILTER (again), 0) AS dup_chars FROM l GROUP BY doc_id),
g AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS times
      FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (VALUES {lengths}) v(n) WHERE len(w) >= n))),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM g WHERE times > 1),
s AS (SELECT c.doc_id, n, count(*) AS cw, sum(length(w[p])) AS cc FROM c JOIN d USING (doc_id) GROUP BY c.doc_id, n),
r AS (SELECT b.doc_id, coalesce(max(cw) FILTER (n = 3), 0) AS n_repeat, {over} AS repeated FROM b LEFT JOIN s USING (doc_id) GROUP BY b.doc_id),
f AS (SELECT b.*, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words,
             n_words < 50 OR 100 * n_repeat > 50 * n_words AS base_failed,
             repeated OR coalesce(dup_chars, 0) > {quality_rules.MOST_IN_LINES} * greatest(word_chars, 1) OR coalesce(n_dup, 0) > {quality_rules.MOST_LINES} * greatest(coalesce(n_lines, 0), 1)
             OR n_symbols > {quality_rules.MOST_SYMBOLS} * greatest(n_words, 1) AS broken
      FROM b LEFT JOIN lines USING (doc_id) JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR broken) AS kept FROM f
"""


ORACLE_SQL["op2_quality_rules"] = _op2_sql()


def _xxh64_sql(source: str, seed: int) -> str:
    """Common table expressions that end in ``hashed`` (g, h): XXH64 of the texts ``g`` of ``source``, in 128-bit integers.

    A rotation by r is a product with 2^r modulo 2^64 - 1.
    """
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    big = lambda n: f"{n}::UHUGEINT"
    word = big(2**64)
    mul = lambda a, b: f"(({a}) * {big(b)} % {word})"
    add = lambda *xs: f"(({' + '.join(xs)}) % {word})"
    turn = lambda a, r: f"(({a}) * {big(2**r)} % {big(2**64 - 1)})"
    lane = lambda acc, x: mul(turn(add(acc, mul(x, p2)), 31), p1)
    eight = lambda h, x: add(mul(turn(f"xor({h}, {lane(big(0), x)})", 27), p1), big(p4))
    four = lambda h, x: add(mul(turn(f"xor({h}, {mul(x, p1)})", 23), p2), big(p3))
    byte = lambda h, x: mul(turn(f"xor({h}, {mul(x, p5)})", 11), p1)
    number = lambda at, n: "CAST('0x' || " + " || ".join(f"substr(x, CAST(2 * ({at}) + {2 * k + 1} AS INT), 2)" for k in reversed(range(n))) + " AS UBIGINT)::UHUGEINT"
    starts = [(seed + p1 + p2) % 2**64, (seed + p2) % 2**64, seed, (seed - p1) % 2**64]
    v = ", ".join(f"list_reduce([{big(start)}] || lanes[{j + 1}:stripes * 4:4], lambda a, y: {lane('a', 'y')}) AS v{j}" for j, start in enumerate(starts))
    met = add(*(turn(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18))))
    for j in range(4):
        met = add(mul(f"xor({met}, {lane(big(0), f'v{j}')})", p1), big(p4))
    return f"""
h0 AS (SELECT g, hex(encode(g)) AS x, strlen(g) AS n FROM {source}),
h1 AS (SELECT *, n // 32 AS stripes, list_transform(range(0, n // 8), lambda i: {number('8 * i', 8)}) AS lanes FROM h0),
h2 AS (SELECT *, {v} FROM h1),
h3 AS (SELECT *, (CASE WHEN stripes > 0 THEN {met} ELSE {big((seed + p5) % 2**64)} END + n::UHUGEINT) % {word} AS a3 FROM h2),
h4 AS (SELECT *, list_reduce([a3] || lanes[stripes * 4 + 1:], lambda a, y: {eight('a', 'y')}) AS a4 FROM h3),
h5 AS (SELECT *, CASE WHEN n % 8 >= 4 THEN {four('a4', number('n // 8 * 8', 4))} ELSE a4 END AS a5 FROM h4),
h6 AS (SELECT *, list_reduce([a5] || list_transform(range(n - n % 4, n), lambda i: {number('i', 1)}), lambda a, y: {byte('a', 'y')}) AS a6 FROM h5),
h7 AS (SELECT g, {mul(f'xor(a6, a6 // {big(2**33)})', p2)} AS a7 FROM h6),
h8 AS (SELECT g, {mul(f'xor(a7, a7 // {big(2**29)})', p3)} AS a8 FROM h7),
hashed AS (SELECT g, CAST(xor(a8, a8 // {big(2**32)}) AS UBIGINT) AS h FROM h8)"""


def _op6_sql() -> str:
    """Fingerprints by sums of bits, and what can be reached over pairs of at most two differing bits."""
    sums = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))
    bits = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {2**b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)),
distinct_s AS (SELECT DISTINCT g FROM s),{_xxh64_sql('distinct_s', simhash.SEED)},
counted AS (SELECT doc_id, count(*) AS n, {sums} FROM s JOIN hashed USING (g) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN (SELECT doc_id, {bits} AS fp FROM counted) USING (doc_id)),
nodes AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON bit_count(xor(a.fp, b.fp)) <= {simhash.WITHIN}),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS fp, min(least) AS component_id FROM reach JOIN nodes ON nodes.fp = reach.b GROUP BY a)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN named USING (fp)
"""


ORACLE_SQL["op6_simhash"] = _op6_sql()
ORACLE_SQL["op7_language_model"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, p, w[p] AS a, CASE WHEN p > 1 THEN concat(w[p - 1], ' ', w[p]) END AS b, CASE WHEN p > 2 THEN concat(w[p - 2], ' ', w[p - 1], ' ', w[p]) END AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
others AS (SELECT doc_id, n, p, (SELECT count(*) FROM g) - n AS rest,
                  count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS x,
                  CASE WHEN p > 1 THEN count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY doc_id, b) ELSE 0 END AS y,
                  CASE WHEN p > 2 THEN count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) ELSE 0 END AS z FROM g),
under AS (SELECT *, lag(x) OVER one AS x_before, lag(y) OVER one AS y_before FROM others WINDOW one AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, CASE WHEN z > 0 THEN 3 WHEN y > 0 THEN 2 WHEN x > 0 THEN 1 ELSE 0 END AS found,
             CASE WHEN z > 0 THEN ln(z / y_before) WHEN y > 0 THEN CASE WHEN p > 2 THEN ln(0.4) ELSE 0 END + ln(y / x_before)
                  WHEN x > 0 THEN ln(0.4) * (least(p, 3) - 1) + ln(x / rest) ELSE ln(0.4) * least(p, 3) - ln(rest + 1) END AS score FROM under),
t AS (SELECT doc_id, sum(score) AS score, count(*) FILTER (found = 1) AS f1, count(*) FILTER (found = 2) AS f2, count(*) FILTER (found = 3) AS f3 FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) + 0.0 AS log_score, round(coalesce(score, 0) / greatest(len(w), 1), 6) + 0.0 AS mean_log_score,
       coalesce(f1, 0) AS found_1, coalesce(f2, 0) AS found_2, coalesce(f3, 0) AS found_3
FROM d LEFT JOIN t USING (doc_id)
"""
ORACLE_SQL["proximity_matches"] = _WINDOWS + "SELECT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM near"
ORACLE_SQL["op1_decontaminate"] = (
    _WINDOWS
    + """,
win AS (SELECT item_id, n, array_to_string(ts, ' ') AS g FROM ws),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM grams JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
close AS (SELECT doc_id, count(*) AS n_near, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS near_names FROM near GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near_names, '')) AS near_items_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN close USING (doc_id)
"""
)
