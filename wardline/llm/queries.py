"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, bpe_trie, conversations, exact_dedup, importance, licenses, lm_scoring, mixing, near_dedup, quality, sentencepiece_codec, token_shards, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_shards.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann_forest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.lm_scores(_table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 8) for c in ("base_score", "score")})


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p.start)
    names = lambda c: F.transform(c, lambda p: p.label)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    # words that a phrase or template covers
    covered = F.flatten(F.transform(F.concat("places", "spans"), lambda p: F.sequence(p.start, p.end - 1)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names("places")).alias("base_labels"),
        joined(names(F.concat("places", "spans"))).alias("labels"),
        F.coalesce(F.size(F.array_distinct(covered)) / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0)).alias("score"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents"), piece_model())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_trie.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_token_shards, op3_exact_dedup, op4_toxicity, op5_nearest, op6_lm_scoring, op7_licenses, op8_sentencepiece, op9_mixing, op10_near_dedup, op11_importance, op12_conversations, op13_byte_bpe)}


_EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id
         AND row_number() OVER (PARTITION BY d.text_sha256, doc_id) = 1 AS kept,
       text_sha256
FROM d JOIN g USING (text_sha256)
"""

_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS weight,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k
  FROM s
), f AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (weight - coalesce(sum(w) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT level FROM f WHERE cap / w >= level ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM lv) * w, cap)) AS target FROM o
), e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         round(t.target)::BIGINT AS flow,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', '42', d.doc_id, d.size)), d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE size * (flow // source_size + (flow % source_size > 0 AND before + size / 2.0::DOUBLE <= flow % source_size)::INT) END::BIGINT AS taken
FROM e
"""


#: crc32 of a short ASCII text; a fixed polynomial, bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(string_split({x}, ''), lambda ch: ord(ch)::BIGINT), lambda a, b: "
    "list_reduce(range(8), lambda h, i: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END, xor(a, b)), 4294967295), 4294967295)"
)

_LM = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CRC % 7 = 2 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w
  FROM documents
), t AS (
  SELECT r, held_out, unnest(w) AS tok, unnest(list_concat([NULL], w)[1:len(w)]) AS prev, unnest(list_concat([NULL, NULL], w)[1:len(w)]) AS prev2 FROM d
), u AS (
  SELECT tok, count(*) AS c FROM t WHERE NOT held_out GROUP BY tok
), b AS (
  SELECT prev, tok, count(*) AS c FROM t WHERE NOT held_out AND prev IS NOT NULL GROUP BY prev, tok
), g AS (
  SELECT prev2, prev, tok, count(*) AS c FROM t WHERE NOT held_out AND prev2 IS NOT NULL GROUP BY prev2, prev, tok
), n AS (
  SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM u
), p AS (
  SELECT t.r, coalesce(u.c, 0) AS c, coalesce(h.c, 0) AS ch, coalesce(b.c, 0) AS cb, coalesce(x.c, 0) AS cx, coalesce(g.c, 0) AS cg,
         (coalesce(u.c, 0) + 1)::DOUBLE / (n.n + n.v + 1) AS p1
  FROM t CROSS JOIN n LEFT JOIN u USING (tok) LEFT JOIN u h ON t.prev = h.tok LEFT JOIN b ON t.prev = b.prev AND t.tok = b.tok
  LEFT JOIN b x ON t.prev2 = x.prev AND t.prev = x.tok LEFT JOIN g ON t.prev2 = g.prev2 AND t.prev = g.prev AND t.tok = g.tok
), q AS (
  SELECT *, CASE WHEN ch > 0 THEN (cb + 40.0::DOUBLE * p1) / (ch + 40.0::DOUBLE) ELSE p1 END AS p2 FROM p
), s AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, fsum(log10(p1)) AS base_score,
         fsum(log10(CASE WHEN cx > 0 THEN (cg + 40.0::DOUBLE * p2) / (cx + 40.0::DOUBLE) ELSE p2 END)) AS score
  FROM q GROUP BY r
)
SELECT doc_id, held_out, n_tokens, n_known, n.n AS train_tokens, round(base_score, 8) AS base_score, round(score, 8) AS score
FROM d JOIN s USING (r) CROSS JOIN n
""".replace("CRC", _CRC.format(x="doc_id::VARCHAR"))
)


#: crc32 of a text's UTF-8 bytes, half a byte at a time.
_CRC_TABLE = [0]
for _i in range(1, 16):
    _x = _i
    for _ in range(4):
        _x = _x >> 1 ^ (0xEDB88320 if _x & 1 else 0)
    _CRC_TABLE.append(_x)
_HALF = lambda x: f"xor({_CRC_TABLE}[({x} & 15) + 1], {x} >> 4)"
_BYTES_CRC = (
    "xor(list_reduce(list_transform(range(strlen({g})), lambda i: ('0x' || substr(hex({g}), 2 * i + 1, 2))::BIGINT), "
    "lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"
)

_IMPORTANCE = r"""
WITH x AS (
  SELECT row_number() OVER () AS r, true AS own, doc_id, WORDS AS w FROM documents
  UNION ALL SELECT 0, false, NULL, WORDS FROM benchmark
), f AS (
  SELECT r, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM x
), c AS (
  SELECT g, CRC % 10000 AS bucket FROM (SELECT DISTINCT g FROM f)
), n AS (
  SELECT count(*) FILTER (WHERE own)::BIGINT AS s, count(*) FILTER (WHERE NOT own)::BIGINT AS t FROM f
), b AS (
  SELECT bucket, floor(1000 * ln((count(*) FILTER (WHERE NOT own) + 1)::DOUBLE * (any_value(n.s) + 10000) / ((count(*) FILTER (WHERE own) + 1)::DOUBLE * (any_value(n.t) + 10000))))::BIGINT AS gain
  FROM f JOIN c USING (g) CROSS JOIN n GROUP BY bucket
), v AS (
  SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN c USING (g) JOIN b USING (bucket) WHERE own GROUP BY r
), d AS (
  SELECT doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM x LEFT JOIN v USING (r) WHERE own
), k AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY fit) AS total FROM d
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * total // 100 THEN place END AS rank FROM k
""".replace("WORDS", r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')").replace("CRC", _BYTES_CRC.format(g="g", step=_HALF(_HALF("xor(c, b)"))))


def _chart_sql() -> str:
    """The weighted chart as a recursion over turns: per conversation the cheapest (cost, audit) of nothing, system, asked and answered."""
    item = lambda x, cost, letter: f"{{'c': ({x}).c + {cost}, 'a': ({x}).a || '{letter}'}}"
    kept = lambda x, initial: f"CASE WHEN fault NOT IN (1, 2) AND initial = '{initial}' THEN {item(x, '(fault = 3)::INT', 'K')} END"
    other = lambda x: f"CASE WHEN fault NOT IN (1, 2) THEN {item(x, '2 + (fault = 3)::INT', 'R')} END"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    before = [kept(x, "u") for x in "nsa"] + [other(x) for x in "nsa"]
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS h FROM conversations
), r AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) c(i) WHERE h <> 0 AND (i = 0 OR h = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM r
), f AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
  FROM o
), chart AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS p, {{'c': 0::BIGINT, 'a': ''}} AS n, {{'c': 1000000000::BIGINT, 'a': ''}} AS s, {{'c': 2::BIGINT, 'a': 'I'}} AS u, {{'c': 4::BIGINT, 'a': 'II'}} AS a FROM conversations
  UNION ALL
  SELECT conv_id, p, n, s, u, {least("a", item("u", 2, "I"))} FROM (
    SELECT conv_id, p, n, s, {least("u", item("n", 2, "I"), item("s", 2, "I"), item("a", 2, "I"))} AS u, a FROM (
      SELECT c.conv_id, f.p, {item("n", 3, "D")} AS n, {least(item("s", 3, "D"), kept("n", "s"))} AS s,
             {least(item("u", 3, "D"), *before)} AS u, {least(item("a", 3, "D"), kept("u", "a"), other("u"))} AS a
      FROM chart c JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.p = c.p + 1))
), best AS (
  SELECT conv_id, list_min([arg_max(n, p), arg_max(a, p)]) AS b FROM chart GROUP BY conv_id
), e AS (
  SELECT conv_id, (b).a AS audit, unnest(range(1, len((b).a) + 1)) AS i FROM best
), q AS (
  SELECT conv_id, i, audit[i] AS letter, count(*) FILTER (WHERE audit[i] <> 'I') OVER w AS p, count(*) FILTER (WHERE audit[i] <> 'D') OVER w AS pos
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), l AS (
  SELECT q.*, f.role, CASE WHEN letter <> 'I' THEN f.text ELSE '' END AS text,
         max(CASE WHEN pos = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS led
  FROM q LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.p = q.p
), t AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (pos - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS repaired
  FROM l WHERE letter <> 'D' GROUP BY conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       (b).c AS cost, (b).a AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM best b LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
""".replace("CRC", _CRC.format(x="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"))


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": _EXACT_DEDUP, "op6_lm_scoring": _LM, "op9_mixing": _MIXING, "op11_importance": _IMPORTANCE, "op12_conversations": _chart_sql()}
