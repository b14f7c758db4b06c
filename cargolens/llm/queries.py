"""The registered queries: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import decontaminate, dialogue, hpy, language, packing, pii, quality
from cargolens.llm import resample, sharding, simhash, templates, vectors, wrapper
from cargolens.llm.common import fold, table


def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    return language.identify(docs, ["doc_id", held.alias("held_out")], ~held)


def vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), vectors.quantise().alias("vector")
    )
    return vectors.top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.drop_recurring_lines(table(spark, sf_dir, "documents"))


def pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels")
    return quality.score_quality(docs, labels, ["doc_id", held.alias("held_out")], ~held)


def benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items)


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2
    return hpy.score_documents(docs, ["doc_id", held.alias("held_out")], ~held)


def kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return dialogue.digests(dialogue.repair(dialogue.damage(turns), turns))


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, target)


VECTOR_SQL = """
WITH parts AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)
              AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_SPACE = r"[ \t\x0B\f\r]"
TEMPLATE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS parts
  FROM documents),
lines AS (
  SELECT doc_id, text, unnest(generate_series(1, len(parts))) AS pos, parts
  FROM (SELECT DISTINCT doc_id, text, parts FROM docs)),
shaped AS (
  SELECT doc_id, text, pos, string_split_regex(
           regexp_replace(trim(parts[pos]), '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g'),
           '{_SPACE}+') AS tokens
  FROM lines WHERE regexp_matches(parts[pos], '[^ \t\x0B\f\r]')),
leafed AS (
  SELECT doc_id, text, pos, tokens, len(tokens) AS n, tokens[1:3] AS head,
         CASE WHEN len(tokens) < 8 THEN 10 ELSE 3 END AS needed
  FROM shaped
  UNION ALL
  SELECT doc_id, text, pos, [''], 1, ['whole', array_to_string(tokens, ' ')], 2
  FROM shaped WHERE len(tokens) >= 50),
leaves AS (
  SELECT n, head FROM (SELECT DISTINCT n, head, needed, doc_id, text FROM leafed)
  GROUP BY n, head, needed HAVING count(*) >= needed),
own AS (SELECT leafed.* FROM leafed JOIN leaves USING (n, head)),
places AS (
  SELECT doc_id, text, pos, n, head, needed, unnest(generate_series(1, n)) AS place, unnest(tokens) AS token
  FROM own),
constant AS (
  SELECT n, head, place, token
  FROM (SELECT DISTINCT n, head, needed, place, token, doc_id, text FROM places)
  GROUP BY n, head, needed, place, token HAVING count(*) >= needed),
marked AS (
  SELECT doc_id, text, pos, n, head, needed,
         list({{'place': place, 'token': token}} ORDER BY place) AS template, count(*) AS constants
  FROM places JOIN constant USING (n, head, place, token)
  GROUP BY doc_id, text, pos, n, head, needed HAVING count(*) >= 0.6 * n),
recurring AS (
  SELECT n, head, template FROM (SELECT DISTINCT n, head, needed, template, doc_id, text FROM marked)
  GROUP BY n, head, needed, template HAVING count(*) >= needed),
ranked AS (
  SELECT doc_id, text, pos, row_number() OVER (
           PARTITION BY n, head, template ORDER BY doc_id NULLS LAST, pos) AS nth
  FROM marked JOIN recurring USING (n, head, template)),
gone AS (
  SELECT doc_id, text, list(DISTINCT pos) AS gone FROM ranked WHERE nth > 1 GROUP BY doc_id, text)
SELECT docs.doc_id,
       CASE WHEN gone IS NULL THEN docs.text ELSE
         coalesce(array_to_string(list_transform(
           list_filter(generate_series(1, len(parts)), lambda i: NOT list_contains(gone, i)),
           lambda i: parts[i]), chr(10)), '') END AS text,
       CAST(coalesce(len(parts), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(gone), 0) AS INTEGER) AS n_dropped
FROM docs LEFT JOIN gone
  ON docs.doc_id IS NOT DISTINCT FROM gone.doc_id AND docs.text = gone.text
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_profiles": language_profiles,
        "op2_vector_approximation": vector_approximation,
        "op3_line_templates": line_templates,
        "op4_pairwise_quality": pairwise_quality,
        "op5_benchmark_windows": benchmark_windows,
        "op6_simhash_components": simhash_components,
        "op7_personal_data": personal_data,
        "op8_best_fit_packing": best_fit_packing,
        "op9_pitman_yor_scores": pitman_yor_scores,
        "op10_kd_shards": kd_shards,
        "op11_wrapper_induction": wrapper_induction,
        "op12_conversation_repair": conversation_repair,
        "op13_importance_resampling": importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_vector_approximation": VECTOR_SQL,
        "op3_line_templates": TEMPLATE_SQL,
        "op5_benchmark_windows": decontaminate.SQL,
        "op12_conversation_repair": dialogue.SQL,
        "op13_importance_resampling": resample.SQL,
    }
