"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, decontaminate, langid, linedup, mixing, probminhash, quality, rlz, simhash, warc
from .session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_classes(_table(spark, sf_dir, "documents"))


def op7_langid_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    model = langid.train(docs.where("not held_out").select("text", "lang"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~langid.held_out(F.col("doc_id"), 5, 0)))
    out = quality.score(docs.withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 0)), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.dedup_bytes(_table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontaminate, op3_rlz, op4_line_chunks, op5_pareto_mix, op6_probminhash, op7_langid_bayes, op8_zstd_quality, op9_arc_to_warc, op10_column_bwt)}

ORACLE_SQL = {
    "op3_rlz": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, pos, array_to_string(w[pos : pos + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM words)
), firsts AS (
  SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING count(*) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS places
  FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS p FROM windows JOIN firsts USING (g) WHERE first < doc_id)
  GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END AS k
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""",
    "op4_line_chunks": r"""
WITH lines AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), ends AS (
  SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR (i > 1 AND (
    ('0x' || substr(md5(l[i - 1]), 1, 8))::BIGINT * 31 + ('0x' || substr(md5(l[i]), 1, 8))::BIGINT) % 3 = 0)) AS e FROM lines
), chunks AS (
  SELECT doc_id, k, e[k] - coalesce(e[k - 1], 0) AS n, array_to_string(l[coalesce(e[k - 1], 0) + 1 : e[k]], chr(10)) AS c
  FROM (SELECT doc_id, l, e, unnest(range(1, len(e) + 1)) AS k FROM ends)
), marked AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY c, n > 1 ORDER BY doc_id, k) > 1 AS gone FROM chunks
), kept AS (
  SELECT doc_id, sum(n) AS n, sum(n) FILTER (gone) AS g, string_agg(c, chr(10) ORDER BY k) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n END::BIGINT AS n_lines, coalesce(g, 0)::BIGINT AS n_lines_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM kept JOIN lines USING (doc_id)""",
    "op5_pareto_mix": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / pow(2, 52) AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS s, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM docs GROUP BY source
), rounds AS (
  SELECT 0 AS r, NULL::DOUBLE AS level
  UNION ALL
  SELECT r + 1, (SELECT (sum(s) - coalesce(sum(3 * s) FILTER (level IS NOT NULL AND level * w > 3 * s), 0))
                        / nullif(sum(w) FILTER (level IS NULL OR level * w <= 3 * s), 0) FROM sources)
  FROM rounds WHERE r < (SELECT count(*) FROM sources) + 1
), targets AS (
  SELECT source, s, least(3 * s, coalesce((SELECT level FROM rounds ORDER BY r DESC LIMIT 1), 0) * w) AS target FROM sources
), ranked AS (
  SELECT d.doc_id, d.source, d.size, s, target, floor(CASE WHEN s > 0 THEN target / s ELSE 0 END) AS whole,
         CASE WHEN s > 0 THEN target / s ELSE 0 END - floor(CASE WHEN s > 0 THEN target / s ELSE 0 END) AS p, u
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM ranked WHERE p > 0
  UNION ALL SELECT *, NULL FROM ranked WHERE p <= 0
)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN p > 0 AND upto - size / 2.0 <= target - whole * s THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed""",
    "op9_arc_to_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), q AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS kept FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept > page_id THEN kept END AS refers_to
FROM q""",
    "op10_column_bwt": r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 100)) AS g
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS pos FROM docs)
), firsts AS (
  SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING count(*) > 1
), hits AS (
  SELECT doc_id, pos FROM windows JOIN firsts USING (g) WHERE first < doc_id
), steps AS (
  SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS opens FROM hits
), spans AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b
  FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM steps) GROUP BY doc_id, s
), gaps AS (
  SELECT doc_id, b AS kept_from, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS kept_to FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id
), kept AS (
  SELECT g.doc_id, string_agg(substr(h, 2 * kept_from + 1, 2 * (kept_to - kept_from)), '' ORDER BY kept_from) AS k
  FROM gaps g JOIN docs USING (doc_id) GROUP BY g.doc_id
), sums AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
}
