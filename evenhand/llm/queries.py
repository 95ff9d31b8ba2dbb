"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm import audit, bpe, crosspoly, importance, lengths, linedup, minhash, nbsvm, pfair, rules, secrets, suffix, windows
from evenhand.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "anomaly", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents")))


def token_count_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer documents and tokens kept for context limits from 128 to 131,072."""
    return lengths.truncated_totals(_histogram(spark, sf_dir), [2**i for i in range(7, 18)])


def token_count_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.quantiles(_histogram(spark, sf_dir), [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents")).drop("removed")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("component")


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Target weights of the mixture: source srcN gets 1 + N modulo 5 shares.
TARGETS = {f"src{n}": 1 + n % 5 for n in range(20)}


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.mixed(docs, TARGETS)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.duplicate_passages(table(spark, sf_dir, "documents"))
    text = F.transform("spans", lambda s: F.concat_ws(":", s["x"].cast("string"), s["y"].cast("string")))
    return found.withColumn("spans", F.array_join(text, ","))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup(table(spark, sf_dir, "documents")).drop("keep")


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scans, op2_quality_rules, op3_token_counts, op4_suffix_array_dedup, op5_minhash_near_dedup, op6_cross_polytope, op7_quality_classifier, op8_pfair_mixing, op9_byte_bpe, op10_compact_windows, op11_importance_resampling, op12_filter_audit, op13_line_dedup, token_count_limits, token_count_quantiles)}


#: Links by all shared shingles, and what can be reached by them.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o),
m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


#: Filters by regular expressions, copies by a window, and all orders of the five letters.
FILTER_AUDIT_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
 || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
 || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
 || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
 FROM w LEFT JOIN g USING (doc_id)),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)),
s AS (SELECT o AS filter_order, i::INT AS step, substr(o, i, 1) AS x, substr(o, 1, i - 1) AS earlier FROM o, range(1, 6) r(i) WHERE length(o) = 5),
c AS (SELECT part, filter_order, step, x, translate(fails, earlier, '') <> fails AS gone, contains(fails, x) AS failing, fails = x AS alone, good, toxic FROM f, s),
t AS (SELECT part, filter_order, step, x, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed, count(*) FILTER (gone AND failing) AS redundant, count(*) FILTER (alone) AS unique_fails, count(*) FILTER (NOT gone AND failing AND good) AS good_lost, count(*) FILTER (NOT gone AND failing AND toxic) AS toxic_lost FROM c GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM t
"""

#: Lines by their keys; the largest document that holds a frequent one keeps it.
LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(k.doc_id <> largest, false)) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(k.doc_id <> largest, false)), '')) AS kept_sha256
FROM k LEFT JOIN d ON k.key = d.key GROUP BY k.doc_id
"""


def oracle_sql() -> dict:
    return {"op5_minhash_near_dedup": NEAR_DEDUP_SQL, "op12_filter_audit": FILTER_AUDIT_SQL, "op13_line_dedup": LINE_DEDUP_SQL}
