"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (content_sort, context_mixing, decontaminate, hard_negatives, licences, line_spread, packing, pii, quality, secret_scan, simhash, token_alignment, topk)
from .common import table


def remainder(column: str, by: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return context_mixing.lm_scores(docs, remainder("doc_id", 7) == 2)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"), words_path=public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "guess_costs")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_inner_product(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_spread.remove_spread_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    voters = quality.fit(docs, labels, remainder("doc_id", 4) != 2)
    rows = quality.score(docs, voters)
    return rows.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("__score").alias("score"),
                       (F.col("__score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.Alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                        public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return aligned.documents().withColumnRenamed("groups", "groups_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licence_sql() -> str:
    """Notices of one line; the longer licences are covered by tests."""
    known: dict[str, str] = {}
    for licence, text in licences.KNOWN:
        form = licences.canonical(licences.text_words(text))
        known[form] = min(known.get(form, licence), licence)
    form = "' ' || trim(regexp_replace(lower(unit), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
    for word, same in licences.EQUIVALENT:
        form = f"replace({form}, {_text(f' {word} ')}, {_text(f' {same} ')})"
    values = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in sorted(known.items()))
    return f"""WITH known(form, licence) AS (VALUES {values}),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, 0 AS line, array_to_string(parts, chr(10)) AS unit FROM lines
          UNION ALL SELECT doc_id, unnest(range(1, len(parts) + 1)), unnest(parts) FROM lines WHERE len(parts) > 1)
SELECT doc_id, CASE WHEN line = 0 THEN 'text' ELSE 'line' END AS scope, CAST(line AS BIGINT) AS line, licence, count(*) AS n
FROM units JOIN known ON trim({form}) = known.form GROUP BY ALL"""


LINE_SQL = f"""WITH parts AS (SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS lines FROM documents),
rows AS (SELECT doc_id, site, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM parts),
spread AS (SELECT trim(line, ' ') AS form, min((doc_id, pos)) AS first FROM rows WHERE trim(line, ' ') <> ''
           GROUP BY 1 HAVING count(DISTINCT site) >= {line_spread.SITES}),
marked AS (SELECT doc_id, pos, line, first IS NOT NULL AND first <> (doc_id, pos) AS gone
           FROM rows LEFT JOIN spread ON trim(line, ' ') = form)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM marked GROUP BY doc_id"""

TOPK_SQL = """WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

EXACT_SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.e, c.e)]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_lm_scores, op3_simhash, op4_secrets, op5_topk, op6_pii,
                                   op7_packing, op8_licences, op9_line_dedup, op10_quality, op11_exact_dedup, op12_token_alignment,
                                   op13_hard_negatives)}
ORACLE = {"op5_topk": TOPK_SQL, "op8_licences": _licence_sql(), "op9_line_dedup": LINE_SQL, "op11_exact_dedup": EXACT_SQL, "op13_hard_negatives": NEGATIVES_SQL}
