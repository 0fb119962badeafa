"""Registered queries of the training-data operators: ``opN_<name>`` applies
operator N with production parameters to its whole table and derives the
contract's columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, dialogue, language, lines, mixing, negatives, pii, quality_pu, quality_trees, simhash,
               substrings, toxicity, urls)
from .common import in_fold, read_table


def pii_key(spark: SparkSession) -> str:
    """The surrogate key from ``hanga.pii.key``; only tables without real
    personal data, like the test tables, may go without the setting."""
    return spark.conf.get("hanga.pii.key", pii.TEST_KEY)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in its text, and their places and kinds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, pii_key(spark))


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality_pu.classify(docs, read_table(spark, sf_dir, "labels"), ~in_fold("doc_id", 4, 2))
    return got.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op3_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.classify(docs, read_table(spark, sf_dir, "labels"), ~in_fold("doc_id", 5, 0))
    return got.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted",
                      "offending")


# verdict, host, path
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
             ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).drop("url")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the labelled spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = language.identify(docs, ~in_fold("doc_id", 4, 2))
    return got.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score",
                      "lang_spans")


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the trees' score."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_trees.filter_quality(docs, read_table(spark, sf_dir, "labels")).drop("text")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity and place of every leaked benchmark item."""
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"),
                               read_table(spark, sf_dir, "benchmark"))


# Words of a passage that op8 reports wherever it occurs twice
PASSAGE_WORDS = 50


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, the
    text that stays (a character that a cut splits reads as U+FFFD), and
    n_passage_words: words in passages of PASSAGE_WORDS or more words that occur
    anywhere else too. Passages under 400 bytes are only reported there."""
    got = substrings.remove_repeats(read_table(spark, sf_dir, "documents"), passage_words=PASSAGE_WORDS)
    return got.select("doc_id", "n_bytes",
                      (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
                      F.aggregate("passages", F.lit(0).cast("long"),
                                  lambda n, p: n + p["end"] - p["start"]).alias("n_passage_words"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    docs = read_table(spark, sf_dir, "documents")
    got = simhash.simhash_components(docs)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


# Production targets: shares of tokens, relative to those of the categories that
# occur. Sources are evened out, languages and topics set to fixed shares; null
# and unlisted sources and languages together have the share of ``other``.
MIX_TARGETS = {
    "source": {**{f"src{i}": 0.05 for i in range(20)}, "other": 0.05},
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2, "other": 0.1},
    "topic": {"prose": 0.7, "table": 0.1, "contact": 0.1, "license": 0.05, "code": 0.05},
}
MIX_SHARE = 0.5
MIX_ROUNDS = 30          # at most, in the query: its SQL unrolls them (tiny tables cannot meet the targets)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its cell, weight, probability (6 digits) and whether it is drawn."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    got = mixing.sample_mix(docs, MIX_TARGETS, MIX_SHARE, MIX_ROUNDS, keep_all=True)
    return got.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"),
                      F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 6).alias("weight"),
                      F.round("mix_probability", 6).alias("probability"),
                      F.col("mix_drawn").alias("drawn"))


def _op10_sql() -> str:
    """The same raking, unrolled round by round over the cells."""
    axes = ("source", "lang", "topic")
    topic = "CASE " + " ".join(f"WHEN contains(text, '{part}') THEN '{name}'"
                               for name, part in mixing.TOPIC_PATTERNS) + " ELSE 'prose' END"
    known = {a: ", ".join(f"'{k}'" for k in MIX_TARGETS[a]) for a in axes}
    steps = [f"""marked AS MATERIALIZED (
      SELECT doc_id, source, lang, {topic} AS topic,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
             ('0x' || substr(md5('{mixing.SEED}' || chr(31) || coalesce(doc_id::VARCHAR, chr(0)) || chr(31)
                                 || coalesce(text, chr(0))), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
      FROM documents)""",
             "keyed AS MATERIALIZED (SELECT *, " + ", ".join(
                 f"CASE WHEN {a} IN ({known[a]}) THEN {a} ELSE 'other' END AS c_{a}" for a in axes)
             + " FROM marked)",
             """f0 AS MATERIALIZED (SELECT c_source, c_lang, c_topic, sum(tokens)::DOUBLE AS tok,
      sum(tokens)::DOUBLE AS f FROM keyed WHERE tokens > 0 GROUP BY ALL)"""]
    steps += [f"t_{a}(name, share) AS (VALUES " + ", ".join(f"('{k}', {v!r}::DOUBLE)"
                                                         for k, v in MIX_TARGETS[a].items()) + ")"
              for a in axes]
    n = 0
    for _ in range(MIX_ROUNDS):
        for a in axes:
            steps.append(f"m{n} AS MATERIALIZED (SELECT c_{a} AS name, sum(f) AS v FROM f{n} GROUP BY 1)")
            steps.append(f"""f{n + 1} AS MATERIALIZED (
      SELECT c_source, c_lang, c_topic, tok, f * CASE WHEN v > 0 THEN
               (SELECT sum(tok) FROM f{n}) * coalesce(share, 0)
               / (SELECT sum(share) FROM m{n} JOIN t_{a} USING (name) WHERE v > 0) / v ELSE 0 END AS f
      FROM f{n} JOIN m{n} ON m{n}.name = c_{a} LEFT JOIN t_{a} ON t_{a}.name = c_{a})""")
            n += 1
    steps.append(f"""w AS MATERIALIZED (SELECT *, f / greatest(tok, 1) AS weight,
      {MIX_SHARE} * sum(tok) OVER () AS budget FROM f{n})""")
    steps.append("""r AS MATERIALIZED (SELECT *, greatest(budget - (sum(tok) OVER o - tok), 0)
        / nullif(sum(tok * weight) OVER (ORDER BY weight, c_source DESC, c_lang DESC, c_topic DESC
                                         ROWS UNBOUNDED PRECEDING), 0) AS c
      FROM w WINDOW o AS (ORDER BY weight DESC, c_source, c_lang, c_topic ROWS UNBOUNDED PRECEDING))""")
    steps.append("""k AS MATERIALIZED (SELECT weight AS top, c FROM r WHERE weight <= 0 OR c * weight < 1
      ORDER BY weight DESC, c_source, c_lang, c_topic LIMIT 1)""")
    steps.append("""p AS MATERIALIZED (SELECT r.*, CASE WHEN (SELECT top FROM k) IS NULL
        OR weight > (SELECT top FROM k) THEN 1.0 ELSE coalesce((SELECT c FROM k), 0) * weight END AS prob FROM r)""")
    return "WITH " + ",\n".join(steps) + """
    SELECT doc_id, source, lang, topic, tokens, round(coalesce(weight, 0), 6) AS weight,
           round(coalesce(prob, 0), 6) AS probability, u < coalesce(prob, 0) AS drawn
    FROM keyed LEFT JOIN p USING (c_source, c_lang, c_topic)"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = lines.drop_frequent_lines(docs)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP11_SQL = """
WITH l AS (SELECT doc_id, i, line,
                  translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
often AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN often USING (key) GROUP BY doc_id"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores."""
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("id") % 50 == 0, label=label)


_OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y,
         list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.id AS anchor_id, b.id, a.y = b.y AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3"""


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after their damage; lost ones stay, with
    ``present`` false. Nulls read as one space."""
    key = F.concat(*[F.coalesce(c, F.lit(" ")) for c in (F.col("conv_id").cast("string"), F.lit(":"),
                                                         F.col("turn").cast("string"))])
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("damage"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("damage") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, cheapest repair and digest."""
    rows = damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return dialogue.repair(rows, present=F.col("present"))[0]


_BLANKS_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# CRC-32 by its table; the cheapest script row by row, keeping the best per state
_OP13_SQL = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS d FROM key, crc_table),
r AS MATERIALIZED (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM hit, (SELECT unnest([0, 1]) AS copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
f AS MATERIALIZED (
  SELECT conv_id, turn, i, role, text, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS s,
         CASE WHEN rtrim(text, {_BLANKS_SQL}) = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(rtrim(text, {_BLANKS_SQL}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM r),
step(p, s, q, role) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'),
                               (2, 'a', 3, 'assistant')),
ins(p, q, c, a, t) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
e AS MATERIALIZED (
  SELECT conv_id, i, p, p AS q, 2 AS c, 'D' AS a, []::VARCHAR[] AS t FROM f, (SELECT unnest([0, 1, 2, 3]) AS p)
  UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || text]
  FROM f JOIN step USING (s) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [step.role || ':' || text]
  FROM f, step WHERE fault NOT IN ('blank', 'duplicate') AND step.role IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM conversations),
w AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS c, '' AS a, []::VARCHAR[] AS t FROM ids
      UNION ALL SELECT * FROM (
        SELECT w.conv_id, e.i, e.q, w.c + ins.c + e.c AS c, w.a || ins.a || e.a AS a, w.t || ins.t || e.t AS t
        FROM w JOIN ins ON ins.p = w.q
        JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.p = ins.q
        QUALIFY row_number() OVER (PARTITION BY w.conv_id, e.q ORDER BY w.c + ins.c + e.c, w.a || ins.a || e.a) = 1)),
best AS (SELECT w.conv_id, w.c + ins.c AS c, w.a || ins.a AS a, w.t || ins.t AS t FROM w JOIN ins ON ins.p = w.q
         WHERE ins.q IN (0, 3) AND w.i = (SELECT count(*) FROM r WHERE r.conv_id IS NOT DISTINCT FROM w.conv_id)
         QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.c + ins.c, w.a || ins.a) = 1),
pair AS (SELECT conv_id, lag(s) OVER (PARTITION BY conv_id ORDER BY i) || s AS x FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated FROM f GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated,
       (SELECT count(*) FROM pair WHERE pair.conv_id IS NOT DISTINCT FROM best.conv_id
        AND x NOT IN ('su', 'ua', 'au')) AS illegal,
       c AS cost, a AS audit, sha256(array_to_string(t, chr(10))) AS repaired_sha256
FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op10_mixing": op10_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
    "op2_quality_pu": op2_quality_pu,
    "op3_toxicity_mil": op3_toxicity_mil,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_quality_trees": op6_quality_trees,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
}
ORACLE_SQL: dict[str, str] = {"op10_mixing": _op10_sql(), "op11_line_dedup": _OP11_SQL,
                              "op12_hard_negatives": _OP12_SQL,
                              "op13_conversation_repair": _OP13_SQL}
