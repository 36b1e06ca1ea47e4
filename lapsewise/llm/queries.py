"""The queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsewise.llm import alignment, ann, chat, decontam, html, licenses, maxent, mixing, neardup, periodic, pii, quality, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_quality(spark, folder):
    return quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_pseudonyms(spark, folder):
    masked = pii.mask(_table(spark, folder, "documents").select("doc_id", "text"), kinds="kinds")
    return masked.withColumn("n_values", F.size("kinds").cast("bigint")).withColumn("kinds", F.concat_ws(",", "kinds"))


def op3_near_duplicates(spark, folder):
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op4_mix_sources(spark, folder):
    mixed = mixing.mix(_table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_neighbours(spark, folder):
    return ann.neighbours(_table(spark, folder, "embeddings"))


def op6_licenses(spark, folder):
    found = licenses.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.drop("text", "detections")


def op7_toxicity(spark, folder):
    return toxicity.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_decontaminate(spark, folder):
    return decontam.digests(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_format_chats(spark, folder):
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat.digests(chat.format_turns(turns.unionByName(extra)))


def op10_main_text(spark, folder):
    return html.main_text(_table(spark, folder, "pages"))


def op11_language_model(spark, folder):
    return maxent.judge(_table(spark, folder, "documents").select("doc_id", "text"))


def op12_alignment(spark, folder):
    return alignment.align(_table(spark, folder, "documents"))


def op13_periodic_runs(spark, folder):
    return periodic.digests(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_pseudonyms, op3_near_duplicates, op4_mix_sources, op5_neighbours, op6_licenses, op7_toxicity, op8_decontaminate, op9_format_chats,
    op10_main_text, op11_language_model, op12_alignment, op13_periodic_runs,
)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_SPACED}')), 0)::BIGINT AS size,
         md5('mix-1' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), ratios AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS most, sum(source_size) OVER ()::BIGINT AS total FROM weighed
), levels AS (
  SELECT r.most, (1.5::DOUBLE * any_value(r.total) - 2.0::DOUBLE * coalesce(sum(o.source_size) FILTER (WHERE o.most < r.most), 0)::BIGINT)
         / sum(o.weight) FILTER (WHERE o.most >= r.most)::BIGINT AS level
  FROM (SELECT DISTINCT most, total FROM ratios) r, ratios o GROUP BY r.most
), found AS (SELECT min_by(level, most) AS level FROM levels WHERE level <= most), filled AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(level, 0) * weight) AS target FROM ratios, (SELECT max(level) AS level FROM found)
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS repeats FROM filled
), keys AS (
  SELECT source, key, sum(size) AS size FROM sized GROUP BY source, key
), middles AS (
  SELECT source, key, sum(size) OVER (PARTITION BY source ORDER BY key) - size / 2.0::DOUBLE AS middle FROM keys
), once AS (
  SELECT m.source, m.key, m.middle <= p.target - p.repeats * p.source_size AS again
  FROM middles m JOIN planned p ON m.source IS NOT DISTINCT FROM p.source
)
SELECT s.doc_id, s.size, p.source_size, p.target, s.size * (p.repeats + o.again::BIGINT) AS taken
FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
JOIN once o ON s.source IS NOT DISTINCT FROM o.source AND s.key = o.key
"""

DECONTAMINATE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}'), []) AS w FROM documents
), items AS (
  SELECT item_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}'), []) AS w FROM benchmark
), shingled AS (
  SELECT item_id, w, least(len(w), 13) AS k FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM shingled)
), sizes AS (SELECT DISTINCT k FROM windows), doc_windows AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)
), found AS (
  SELECT r, d.k, i, item_id FROM doc_windows d JOIN windows USING (k, win)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""

_ESCAPED = r"replace(replace(replace({}, '\', '\b'), '#', '\h'), '<', '\l')"

CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS seq,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(replace({_ESCAPED.format('role')}, chr(10), '\n')) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM ordered GROUP BY conv_id
"""

NEAR_DUPLICATES_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_SPACED}'), []) AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM docs
), sized AS (SELECT r, doc_id, len(s)::BIGINT AS n FROM sets), items AS (
  SELECT r, unnest(s) AS item FROM sets
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM items a JOIN items b ON a.item = b.item AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sized x ON x.r = a JOIN sized y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (
  SELECT r AS a, r AS b FROM sized UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), smallest AS (
  SELECT reach.a AS r, min(sized.doc_id) AS component_id FROM reach JOIN sized ON sized.r = reach.b GROUP BY reach.a
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN smallest USING (r)
"""

TWINS = {
    "op3_near_duplicates": NEAR_DUPLICATES_SQL,
    "op4_mix_sources": MIX_SQL,
    "op8_decontaminate": DECONTAMINATE_SQL,
    "op9_format_chats": CHAT_SQL,
}
