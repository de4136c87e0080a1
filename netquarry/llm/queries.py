"""Queries of the language-model problems (2, 3, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import encode, leaks, sample, spans, split
from netquarry.sources.tables import spread, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.segments(table(spark, d, "eval_units"), table(spark, d, "flows")).select("eval_unit_id", "flow_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces, their flows as text."""
    p = split.pieces(table(spark, d, "eval_units"), table(spark, d, "flows"))
    return p.withColumn("flow_ids", F.concat_ws(",", F.transform("flow_ids", lambda x: x.cast("string"))))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return split.checked(split.pieces(table(spark, d, "eval_units"), table(spark, d, "flows")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sample.exhausted_strata(table(spark, d, "eval_units"), table(spark, d, "sample_targets"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.draw(table(spark, d, "eval_units"), table(spark, d, "sample_targets"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """The report with its maps as JSON and its list as text."""
    r = sample.report(table(spark, d, "eval_units"), table(spark, d, "sample_targets"))
    return r.select("plan_id", "total_selected", *[F.to_json(c).alias(c) for c in ("per_stratum_available", "per_stratum_selected")], F.concat_ws(",", "undersampled_strata").alias("undersampled_strata"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(spread(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.held(spread(table(spark, d, "documents")), table(spark, d, "heldout_items"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, d, "documents")), table(spark, d, "heldout_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_chars(spread(table(spark, d, "documents")))


def p10_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spans.clusters(spread(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_report, p3_found, p3_sample, p3_report, p8_ids, p9_found, p9_leaks, p10_found, p10_clusters)}

_P2 = """u AS (SELECT eval_unit_id, any_value(list_distinct(flow_ids)) AS ids FROM eval_units GROUP BY 1),
b AS (SELECT eval_unit_id, unnest(ids) AS flow_id FROM u WHERE len(ids) > 80),
f AS (SELECT _flow_id AS flow_id, any_value(ts_start) AS ts FROM flows WHERE src_ip IS NOT NULL AND ts_start IS NOT NULL GROUP BY 1),
l AS (SELECT eval_unit_id, flow_id, ts - lag(ts) OVER (PARTITION BY eval_unit_id ORDER BY ts, flow_id) AS gap FROM b JOIN f USING (flow_id))"""
_CATEGORY = "translate(lower(trim(any_value({}), chr(32)||chr(9)||chr(10)||chr(13))), ' -', '__')"
_P3 = f"""u AS (SELECT eval_unit_id, {_CATEGORY.format('unit_type')} AS t, {_CATEGORY.format('gold_label')} AS l FROM eval_units GROUP BY 1),
c AS (SELECT t, l, count(*) AS n FROM u WHERE t IS NOT NULL AND l IS NOT NULL GROUP BY ALL),
w AS (SELECT plan_id, s.unit_type AS shown_type, s.gold_label AS shown_label, s.unit_type AS t, s.gold_label AS l, coalesce(c.n, 0) AS available,
 greatest(CAST(min_units AS DECIMAL(30,12)), CAST(target_share AS DECIMAL(12,6)) * CAST(sample_share AS DECIMAL(12,6)) * (SELECT CAST(sum(n) AS BIGINT) FROM c)) AS wanted FROM sample_targets s LEFT JOIN c ON s.unit_type = c.t AND s.gold_label = c.l),
q AS (SELECT *, least(available, CAST(ceil(wanted) AS BIGINT)) AS quota FROM w)"""


def _json(count: str) -> str:
    return f"'{{' || string_agg('\"' || t || ':' || l || '\":' || {count}, ',' ORDER BY t, l) || '}}'"


def _grams(table: str, key: str) -> str:
    words = "regexp_extract_all(lower(regexp_replace(text, '[\u200b\u00ad]', '', 'g')), '[\\p{L}\\p{N}]+')"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS k FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) >= 12"


ORACLE = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) JOIN ({_grams('heldout_items', 'item_id')}) USING (k)",
    "p10_found": """WITH w AS (SELECT doc_id, i AS s, hash(substr(text, i, 300)) AS a, md5(substr(text, i, 300)) AS b FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
k AS (SELECT a, b FROM w GROUP BY ALL HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) - s AS step FROM w JOIN k USING (a, b))
SELECT doc_id, CAST(sum(least(300, coalesce(step, 300))) AS BIGINT) AS shared_chars FROM m GROUP BY 1""",
    "p2_found": f"WITH {_P2} SELECT eval_unit_id, flow_id FROM l WHERE gap IS NULL OR gap >= 60",
    "p2_report": f"WITH {_P2} SELECT eval_unit_id, count(*) AS flow_count, true AS within_limit, true AS overlaps_hold FROM l GROUP BY 1",
    "p3_found": f"WITH {_P3} SELECT plan_id, shown_type AS unit_type, shown_label AS gold_label FROM q WHERE available < wanted",
    "p3_sample": f"""WITH {_P3}, k AS (SELECT u.*, row_number() OVER (PARTITION BY t, l ORDER BY CAST('0x' || substr(md5('0|' || eval_unit_id), 1, 12) AS BIGINT), eval_unit_id) AS rank FROM u WHERE t IS NOT NULL AND l IS NOT NULL)
SELECT plan_id, t AS unit_type, l AS gold_label, eval_unit_id FROM k JOIN q USING (t, l) WHERE rank <= quota""",
    "p3_report": f"""WITH {_P3} SELECT plan_id, CAST(sum(quota) AS BIGINT) AS total_selected, {_json('available')} AS per_stratum_available, {_json('quota')} AS per_stratum_selected,
coalesce(string_agg(t || ':' || l, ',' ORDER BY t, l) FILTER (available < wanted), '') AS undersampled_strata FROM q GROUP BY 1""",
}
