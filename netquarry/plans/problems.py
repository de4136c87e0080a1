"""Queries of the general training-data problems (1, 4, 5, 6, 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import drift, features, heavy_keys, instants, sessions
from netquarry.sources.tables import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return features.entity_features(features.service_events(table(spark, d, "flows"), table(spark, d, "services")))


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    """The table with its map of services as JSON."""
    return features.feature_table(p1_found(spark, d), table(spark, d, "hosts")).withColumn("services", F.to_json("services"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(table(spark, d, "flows"))


def p4_durations(spark: SparkSession, d: str) -> DataFrame:
    s = p4_found(spark, d).withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    return s.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("session_count"), F.sum("flow_count").alias("flow_count"), F.sum("duration_us").alias("duration_us"), F.max("duration_us").alias("longest_us")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_sources(table(spark, d, "flows")).select("src_ip")


def p5_hosts(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.host_states(table(spark, d, "flows")).where("src_ip is not null")


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    return instants.normalized(spread(table(spark, d, "raw_starts")), table(spark, d, "exporters"), table(spark, d, "zone_abbreviations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).select("record_id", "epoch_us")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return instants.unit_report(_normalized(spark, d))


def p6_notations(spark: SparkSession, d: str) -> DataFrame:
    """The report's records by exporter and chosen notation, without what the posterior leaves open."""
    return p6_report(spark, d).select("exporter_id", "notation", "records")


def p6_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of day and month inferred with the declared ones withheld, of exporters whose clear dates all show one order."""
    starts, exporters = spread(table(spark, d, "raw_starts")), table(spark, d, "exporters")
    found = instants.inferred_orders(starts, exporters, table(spark, d, "zone_abbreviations"))
    return found.where((F.col("clear_dmy") > 0) != (F.col("clear_mdy") > 0)).drop("ambiguous_records")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = drift.changes(table(spark, d, "raw_files"), spread(table(spark, d, "raw_records")), table(spark, d, "column_aliases"))
    return found.where("top").select("file_id", "field_name", "change_kind")


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "raw_files"), spread(table(spark, d, "raw_records")), table(spark, d, "column_aliases"))


def p7_columns(spark: SparkSession, d: str) -> DataFrame:
    """The table's canonical columns, without the extras."""
    return p7_table(spark, d).drop("extras")


_NESTED = "concat('{\"line\":', line_no, ',\"flow\":{\"srcip\":\"h', record_id % 7, '\",\"n', CASE WHEN file_id % 2 = 0 THEN '' ELSE 'ew' END, '\":{\"a\":1,\"b\":2,\"c\":', file_id % 3, '}}}')"


def p7_nested(spark: SparkSession, d: str) -> DataFrame:
    """Changes, at any depth, of files whose payloads hold the flow in an object; the inner object's name changes with the file's number."""
    records = spread(table(spark, d, "raw_records")).where("file_id is not null").withColumn("payload", F.expr(_NESTED))
    found = drift.changes(table(spark, d, "raw_files"), records, table(spark, d, "column_aliases"))
    return found.select("file_id", "field_name", "change_kind", "script_cost")


QUERIES = {f.__name__: f for f in (p1_found, p1_features, p4_found, p4_durations, p5_found, p5_hosts, p6_found, p6_report, p6_notations, p6_orders, p7_found, p7_table, p7_columns, p7_nested)}

_FLOWS = """
f AS (SELECT _flow_id, any_value(index_id) AS index_id, nullif(lower(trim(any_value(src_ip), chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11))), '') AS src_ip,
             CAST(round(any_value(ts_start) * 1e6) AS BIGINT) AS start_us, any_value(dst_port) AS dst_port, upper(trim(any_value(protocol))) AS protocol,
             CAST(coalesce(any_value(bytes_out), 0) AS BIGINT) AS bytes_out, CAST(coalesce(any_value(bytes_in), 0) AS BIGINT) AS bytes_in,
             CAST(round(coalesce(any_value(flow_duration_ms), 0) * 1000) AS BIGINT) AS lasts_us, any_value(_is_malicious) AS mal
      FROM flows GROUP BY _flow_id)
"""
_P1 = f"""WITH {_FLOWS}, n AS (SELECT *, CASE protocol WHEN '1' THEN 'ICMP' WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '132' THEN 'SCTP' ELSE protocol END AS proto FROM f)
SELECT index_id, src_ip AS host, service_id, count(*) AS flow_count, CAST(sum(bytes_out) AS BIGINT) AS bytes_out_total, min(start_us) AS first_us, max(start_us) AS last_us
FROM n JOIN services s ON n.dst_port = s.dst_port AND n.proto = upper(trim(s.protocol)) WHERE src_ip IS NOT NULL AND start_us IS NOT NULL GROUP BY ALL"""
_TOTALS = "flow_count, malicious_flow_count, distinct_destinations, distinct_malicious_destinations, ts_start_min, ts_start_max, bytes_out_total, bytes_in_total"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ENDS = r"(?:\s*([+-]\d{2}(?::?\d{2})?)|\s*([A-Za-z]{1,5}))?"
_AM_PM = r"(?:\s*([AaPp][Mm]))?"
#: The notations of start texts: regular expression and what its groups are.
_NOTATIONS = {
    "iso": (r"(\d{4})-(\d{2})-(\d{2})(?:[Tt]|\s+)" + _CLOCK + _ENDS, "y mo d h mi s f off ab"),
    "basic": (r"(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + _ENDS, "y mo d h mi s f off ab"),
    "packed": (r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})", "y mo d h mi s"),
    "dots": (r"(\d{1,2})\.(\d{1,2})\.(\d{4})\s+" + _CLOCK + _AM_PM + _ENDS, "d mo y h mi s f ap off ab"),
    "dmy": (r"(\d{1,2})/(\d{1,2})/(\d{4})\s+" + _CLOCK + _AM_PM + _ENDS, "d mo y h mi s f ap off ab"),
    "mdy": (r"(\d{1,2})/(\d{1,2})/(\d{4})\s+" + _CLOCK + _AM_PM + _ENDS, "mo d y h mi s f ap off ab"),
    "mail": (r"(?:([A-Za-z]{3,9}),\s*)?(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})\s+" + _CLOCK + _AM_PM + _ENDS, "wd d mon y h mi s f ap off ab"),
    "log": (r"(\d{1,2})/([A-Za-z]{3,9})/(\d{4}):" + _CLOCK + _ENDS, "d mon y h mi s f off ab"),
    "yearless": (r"([A-Za-z]{3,9})\s+(\d{1,2})\s+" + _CLOCK + _ENDS, "mon d h mi s f off ab"),
}
_MONTHS = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"
_WEEKDAYS = "['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday']"


def _notation(name: str) -> str:
    pattern, groups = _NOTATIONS[name]
    have = groups.split()
    got = lambda g: f"coalesce(g['{g}'], '')" if g in have else "''"
    named = f"list_position(list_transform({_MONTHS}, lambda m: CASE WHEN lower({got('mon')}) IN (m, substr(m, 1, 3)) OR m = 'september' AND lower({got('mon')}) = 'sept' THEN 1 ELSE 0 END), 1)"
    month = f"CAST({got('mo')} AS INTEGER)" if "mo" in have else named
    years = "[CAST(" + got("y") + " AS INTEGER)]" if "y" in have else "range(year(received_at) - 2, year(received_at) + 3)"
    order = f" AND date_order = '{name}'" if name in ("dmy", "mdy") else ""
    day_name = f" AND ({got('wd')} = '' OR len(list_filter({_WEEKDAYS}, lambda d: lower({got('wd')}) IN (d, substr(d, 1, 3)))) > 0)" if "wd" in have else ""
    return f"""SELECT record_id, '{name}' AS notation, rec, time_zone, unnest({years}) AS y, {month} AS mo, CAST({got('d')} AS INTEGER) AS d, CAST({got('h')} AS INTEGER) AS h, CAST({got('mi')} AS INTEGER) AS mi, coalesce(try_cast({got('s')} AS INTEGER), 0) AS s,
CAST(rpad(substr({got('f')}, 1, 6), 6, '0') AS BIGINT) AS f, lower({got('ap')}) AS ap, replace({got('off')}, ':', '') AS off, upper({got('ab')}) AS ab FROM (SELECT *, regexp_extract(t, '^(?:{pattern})$', [{', '.join(f"'{g}'" for g in have)}]) AS g FROM r WHERE regexp_full_match(t, '{pattern}'){order}) WHERE true{day_name}"""


_P6 = f"""r AS (SELECT record_id, received_at, epoch_us(received_at) AS rec, trim(start_text, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)) AS t, time_zone, date_order FROM raw_starts LEFT JOIN exporters USING (exporter_id)),
n AS (SELECT record_id, rec, CASE WHEN abs(v) < 1e11 THEN 'epoch_s' WHEN abs(v) < 1e14 THEN 'epoch_ms' WHEN abs(v) < 1e17 THEN 'epoch_us' ELSE 'epoch_ns' END AS notation, CASE WHEN abs(v) < 1e11 THEN CAST(floor(CAST(v AS DECIMAL(20,8)) * 1000000) AS BIGINT)
  WHEN abs(v) < 1e14 THEN CAST(floor(CAST(v AS DECIMAL(22,8)) * 1000) AS BIGINT) WHEN abs(v) < 1e17 THEN CAST(floor(v) AS BIGINT) ELSE CAST(floor(v) AS BIGINT) // 1000 END AS u
  FROM (SELECT record_id, rec, try_cast(t AS DECIMAL(38,9)) AS v FROM r WHERE regexp_full_match(t, '[+-]?\\d+(?:\\.\\d*)?(?:[eE][+-]?\\d{{1,3}})?') AND NOT regexp_full_match(t, '\\d{{14}}')) WHERE v IS NOT NULL),
p AS ({' UNION ALL '.join(_notation(n) for n in _NOTATIONS)}),
w AS (SELECT *, CASE WHEN ap = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE ap WHEN 'pm' THEN 12 ELSE 0 END END AS hh, CASE WHEN off <> '' THEN (CASE substr(off, 1, 1) WHEN '-' THEN -1 ELSE 1 END) * (CAST(substr(off, 2, 2) AS INTEGER) * 60 + coalesce(try_cast(substr(off, 4, 2) AS INTEGER), 0))
  WHEN ab = 'Z' THEN 0 WHEN ab <> '' THEN (SELECT max(offset_minutes) FROM zone_abbreviations z WHERE upper(z.abbreviation) = ab) END AS minutes FROM p),
l AS (SELECT *, epoch_us(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, hh, mi, s) AS TIMESTAMP)) + f AS wall FROM w WHERE mo BETWEEN 1 AND 12 AND hh < 24 AND mi < 60 AND s < 60 AND (off = '' OR abs(minutes) < 1140 AND coalesce(try_cast(substr(off, 4, 2) AS INTEGER), 0) < 60)),
e AS (SELECT record_id, notation, rec, wall - minutes * 60000000 AS u FROM l WHERE minutes IS NOT NULL AND wall IS NOT NULL),
z AS (SELECT *, epoch_us(timezone(time_zone, make_timestamp(wall))) AS c FROM l WHERE off = '' AND ab = '' AND time_zone IS NOT NULL AND wall IS NOT NULL),
k AS (SELECT record_id, notation, rec, wall, time_zone, c, unnest([c, c - 3600000000, c + 3600000000, c - 1800000000, c + 1800000000]) AS u FROM z),
m AS (SELECT record_id, notation, rec, wall, bool_or(epoch_us(timezone(time_zone, make_timestamptz(u))) = wall) AS exists_, list(u) FILTER (epoch_us(timezone(time_zone, make_timestamptz(u))) = wall) AS us,
  any_value(wall - (epoch_us(timezone(time_zone, make_timestamptz(c - 21600000000))) - (c - 21600000000))) AS before FROM k GROUP BY ALL),
i AS (SELECT record_id, notation, rec, unnest(CASE WHEN exists_ THEN us ELSE [before] END) AS u FROM m),
a AS (SELECT record_id, notation, rec, u FROM n UNION ALL SELECT * FROM e UNION ALL SELECT * FROM i),
b AS (SELECT record_id, notation, coalesce(max(u) FILTER (u <= rec), min(u)) AS epoch_us FROM a WHERE abs(rec - u) <= 400 * 86400000000 GROUP BY ALL)"""
_P4 = f"""WITH {_FLOWS}, t AS (SELECT src_ip, start_us, start_us + greatest(lasts_us, 0) AS end_us, _flow_id FROM f WHERE src_ip IS NOT NULL AND start_us IS NOT NULL),
l AS (SELECT *, max(end_us) OVER (PARTITION BY src_ip ORDER BY start_us, _flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR start_us > before + 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY start_us, _flow_id) AS k FROM l),
o AS (SELECT src_ip, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS flow_count FROM s GROUP BY src_ip, k)
"""
ORACLE = {
    "p1_found": _P1,
    "p1_features": f"""WITH p AS ({_P1}),
s AS (SELECT index_id, host, '{{' || string_agg('"' || service_id || '":{{"flow_count":' || flow_count || ',"bytes_out_total":' || bytes_out_total || ',"first_us":' || first_us || ',"last_us":' || last_us || '}}', ',' ORDER BY service_id) || '}}' AS services FROM p GROUP BY ALL),
h AS (SELECT index_id, nullif(lower(trim(host, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11))), '') AS host, built_at, {_TOTALS} FROM hosts),
b AS (SELECT index_id, host, {_TOTALS} FROM h WHERE index_id IS NOT NULL AND host IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY index_id, host ORDER BY built_at DESC NULLS LAST, {', '.join(f'{c} DESC NULLS LAST' for c in _TOTALS.split(', '))}) = 1)
SELECT index_id, host, {_TOTALS}, coalesce(services, '{{}}') AS services FROM b FULL JOIN s USING (index_id, host)""",
    "p4_found": _P4 + "SELECT * FROM o",
    "p4_durations": _P4
    + "SELECT src_ip, count(*) AS session_count, CAST(sum(flow_count) AS BIGINT) AS flow_count, CAST(sum(end_us - start_us) AS BIGINT) AS duration_us, max(end_us - start_us) AS longest_us FROM o GROUP BY 1",
    "p5_found": f"WITH {_FLOWS} SELECT src_ip FROM f WHERE src_ip IS NOT NULL GROUP BY 1 HAVING count(*) >= CAST(0.02 AS DECIMAL(18,12)) * (SELECT count(*) FROM f)",
    "p5_hosts": f"""WITH {_FLOWS} SELECT src_ip, count(*) AS flow_count, CAST(count(*) FILTER (mal) AS BIGINT) AS malicious_flow_count, CAST(sum(bytes_out) AS BIGINT) AS bytes_out_total,
CAST(sum(bytes_in) AS BIGINT) AS bytes_in_total, min(start_us) AS first_us, max(start_us) AS last_us FROM f WHERE src_ip IS NOT NULL GROUP BY 1""",
    "p6_found": f"WITH {_P6} SELECT record_id, epoch_us FROM b",
    "p6_notations": f"WITH {_P6} SELECT exporter_id, notation, count(*) AS records FROM b JOIN raw_starts USING (record_id) GROUP BY ALL",
    "p6_orders": r"""WITH t AS (SELECT exporter_id, received_at, regexp_extract(trim(start_text, chr(32)||chr(9)||chr(10)||chr(13)), '^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp][Mm]))?(?:\s*([+-]\d{2}(?::?\d{2})?)|\s*([A-Za-z]{1,5}))?$', ['a','b','y','h','mi','s','f','ap','off','ab']) AS g FROM raw_starts),
v AS (SELECT t.exporter_id, received_at, g.*, CAST(g.h AS INTEGER) AS hour FROM t LEFT JOIN exporters USING (exporter_id) WHERE g.a <> '' AND (time_zone IS NOT NULL OR g.off <> '' OR g.ab <> '') AND CAST(g.mi AS INTEGER) < 60 AND coalesce(try_cast(g.s AS INTEGER), 0) < 60),
c AS (SELECT *, CASE WHEN ap = '' THEN hour WHEN hour BETWEEN 1 AND 12 THEN hour % 12 + CASE WHEN lower(ap) = 'pm' THEN 12 ELSE 0 END END AS hh FROM v),
r AS (SELECT exporter_id, received_at, try_cast(y || '-' || b || '-' || a AS DATE) + to_hours(hh) AS dmy, try_cast(y || '-' || a || '-' || b AS DATE) + to_hours(hh) AS mdy FROM c WHERE hh < 24),
w AS (SELECT exporter_id, coalesce(abs(epoch(received_at) - epoch(dmy)) <= 400 * 86400, false) AS d, coalesce(abs(epoch(received_at) - epoch(mdy)) <= 400 * 86400, false) AS m FROM r),
n AS (SELECT exporter_id, count(*) FILTER (d AND NOT m) AS clear_dmy, count(*) FILTER (m AND NOT d) AS clear_mdy, count(*) FILTER (d AND m) AS n_open FROM w WHERE d OR m GROUP BY 1)
SELECT exporter_id, clear_dmy, clear_mdy, CASE WHEN clear_dmy > 0 THEN n_open ELSE 0 END AS open_dmy, CASE WHEN clear_mdy > 0 THEN n_open ELSE 0 END AS open_mdy FROM n WHERE (clear_dmy > 0) <> (clear_mdy > 0)""",
    "p7_nested": """WITH h AS (SELECT DISTINCT file_id FROM raw_records), l AS (SELECT file_id, lag(file_id) OVER (PARTITION BY feed_id ORDER BY file_seq) AS before FROM raw_files),
c AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'flow.n' ELSE 'flow.new' END AS new, CASE WHEN file_id % 2 = 0 THEN 'flow.new' ELSE 'flow.n' END AS old FROM l WHERE before IS NOT NULL AND (file_id - before) % 2 <> 0 AND file_id IN (FROM h) AND before IN (FROM h))
SELECT file_id, unnest([old, new]) AS field_name, 'renamed' AS change_kind, 2.0 AS script_cost FROM c""",
    "p7_columns": f"""WITH a AS (SELECT lower(alias_name) AS alias, arg_min(canonical_name, alias_rank) AS col, min(alias_rank) AS r FROM column_aliases GROUP BY 1),
o AS (SELECT record_id, file_id, line_no, payload AS p FROM raw_records WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT'),
k AS (SELECT record_id, file_id, line_no, p, unnest(json_keys(p)) AS key FROM o),
v AS (SELECT record_id, file_id, line_no, lower(key) AS key, json_type(p, '$."' || key || '"') AS t, json_extract_string(p, '$."' || key || '"') AS x FROM k),
f AS (SELECT DISTINCT file_id, key, col, r FROM v JOIN a ON a.alias = v.key),
c AS (SELECT file_id, key, col FROM f QUALIFY row_number() OVER (PARTITION BY file_id, col ORDER BY r, key) = 1),
m AS (SELECT file_id, median(try_cast(x AS DOUBLE)) > 1e12 AS ms FROM v JOIN c USING (file_id, key) WHERE col = 'ts_start' AND t <> 'BOOLEAN' GROUP BY 1),
s AS (SELECT v.record_id, v.file_id, v.line_no, c.col, v.t, v.x, try_cast(v.x AS DOUBLE) AS n, coalesce(m.ms, false) AS ms FROM v JOIN c USING (file_id, key) LEFT JOIN m USING (file_id)),
e AS (SELECT record_id, file_id, line_no, col, CASE WHEN col IN ('src_ip', 'dst_ip') THEN CASE WHEN regexp_full_match(x, '\\d{{1,10}}') AND CAST(x AS BIGINT) < 4294967296
  THEN concat_ws('.', CAST(x AS BIGINT) >> 24, (CAST(x AS BIGINT) >> 16) & 255, (CAST(x AS BIGINT) >> 8) & 255, CAST(x AS BIGINT) & 255) ELSE x END ELSE x END AS x,
  CASE WHEN col <> 'ts_start' THEN n WHEN n IS NOT NULL THEN n / CASE WHEN ms THEN 1000 ELSE 1 END ELSE epoch(try_cast(x AS TIMESTAMPTZ)) END AS n FROM s)
SELECT record_id, file_id, line_no, {', '.join(f"max(x) FILTER (col = '{c}') AS {c}" if t == 'string' else f"CAST(round_even(max(n) FILTER (col = '{c}'), 0) AS BIGINT) AS {c}" if t == 'long' else f"max(n) FILTER (col = '{c}') AS {c}" for c, t in drift.CANONICAL.items())}
FROM o LEFT JOIN e USING (record_id, file_id, line_no) GROUP BY ALL""",
    "p7_found": """WITH r AS (SELECT file_id, CASE WHEN json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT' THEN payload END AS p FROM raw_records),
o AS (SELECT file_id, p FROM r WHERE p IS NOT NULL),
e AS (SELECT file_id, p, unnest(json_keys(p)) AS k FROM o),
v AS (SELECT file_id, lower(k) AS key, json_type(p, '$."' || k || '"') AS t FROM e),
g AS (SELECT file_id, key, bool_or(t = 'VARCHAR') AS is_text, bool_or(t IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')) AS is_number, bool_or(t = 'BOOLEAN') AS is_truth FROM v GROUP BY ALL),
c AS (SELECT g.*, coalesce(a.canonical_name, g.key) AS field, row_number() OVER (PARTITION BY file_id, coalesce(a.canonical_name, g.key) ORDER BY a.r) AS rn
      FROM g LEFT JOIN (SELECT lower(alias_name) AS alias, canonical_name, min(alias_rank) AS r FROM column_aliases GROUP BY ALL) a ON a.alias = g.key),
x AS (SELECT * FROM c WHERE rn = 1),
b AS (SELECT file_id, lag(file_id) OVER (PARTITION BY feed_id ORDER BY file_seq) AS before FROM raw_files),
n AS (SELECT b.file_id AS f, x.* FROM b JOIN x ON x.file_id = b.file_id WHERE before IS NOT NULL),
p AS (SELECT b.file_id AS f, x.* FROM b JOIN x ON x.file_id = b.before),
j AS (SELECT coalesce(n.f, p.f) AS file_id, coalesce(n.field, p.field) AS field_name, n.key AS nk, p.key AS pk, n.is_text AS nt, n.is_number AS nn, n.is_truth AS nb, p.is_text AS pt, p.is_number AS pn, p.is_truth AS pb
      FROM n FULL JOIN p ON n.f = p.f AND n.field = p.field)
SELECT file_id, field_name, 'added' AS change_kind FROM j WHERE pk IS NULL UNION ALL SELECT file_id, field_name, 'removed' FROM j WHERE nk IS NULL
UNION ALL SELECT file_id, field_name, 'renamed' FROM j WHERE nk <> pk
UNION ALL SELECT file_id, field_name, 'retyped' FROM j WHERE (nt OR nn OR nb) AND (pt OR pn OR pb) AND (nt <> pt OR nn <> pn OR nb <> pb)""",
}
