"""DuckDB SQL for every registered query that SQL can express; names equal those of the queries."""

from __future__ import annotations

# fixed values: hint words per kind of input
HINTS = (
    ("钻孔数据", ("钻孔", "孔号", "孔深", "borehole", "hole_id", "rqd")), ("地质图", ("地层代号", "断层", "产状", "strata", "fault", "polygon")),
    ("物探数据", ("tsp", "gpr", "tem", "地质雷达", "瞬变电磁", "预报", "综合结论")), ("遥感影像", ("dem", "dsm", "影像", "栅格", "像元", "nodata", "geotiff")),
    ("点云数据", ("point cloud", "点云", "intensity", "classification", "las", "laz")), ("地质剖面", ("剖面", "section", "坡高", "坡度", "里程", "高程")),
    ("属性表", ("属性", "编号", "名称", "类型", "description")), ("网格模型", ("node_id", "element_id", "节点编号", "单元编号", "mesh", "obj", "vtk")),
)

SQL: dict[str, str] = {}

# --- profiles -------------------------------------------------------------------------------


def _profile(table: str, numeric: list[str], texts: list[str], sigma: float) -> str:
    parts = []
    for c in numeric:
        parts.append(f"""
        SELECT '{c}' AS field, count(*) AS total, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 4) AS null_ratio,
          count(DISTINCT {c}) AS "unique", count({c}) - count(DISTINCT {c}) AS duplicate_count, count({c}) AS numeric_count,
          count(*) FILTER (WHERE abs({c} - med) > {sigma} * CASE WHEN 1.4826 * mad <= 1e-12 THEN sd ELSE 1.4826 * mad END) AS outlier_count,
          'numeric' AS dtype, min({c})::DOUBLE AS min_val, max({c})::DOUBLE AS max_val, round(avg({c}), 4) AS mean_val,
          round(stddev_pop({c}), 4) AS std_val, round(any_value(med), 6) AS median, NULL::VARCHAR AS unit_detected
        FROM {table}, (SELECT median({c}) AS med, stddev_pop({c}) AS sd FROM {table}),
          (SELECT median(abs({c} - m)) AS mad FROM {table}, (SELECT median({c}) AS m FROM {table}))""")
    for c in texts:
        parts.append(f"""
        SELECT '{c}', count(*), count(*) - count({c}), 0.0, count(DISTINCT {c}), count({c}) - count(DISTINCT {c}), 0, 0, 'text',
          NULL, NULL, NULL, NULL, NULL, NULL FROM {table}""")
    return " UNION ALL ".join(parts)


SQL["profile_fields"] = _profile("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], [], 1.0)
SQL["profile_event_values"] = _profile("events", ["value"], ["event_type", "props"], 3.0)
SQL["profile_samples"] = """
SELECT 'o_orderstatus' AS field, string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS samples FROM (FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL SELECT 'o_totalprice', string_agg(o_totalprice::VARCHAR, '|' ORDER BY o_orderkey) FROM (FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL SELECT 'o_orderpriority', string_agg(o_orderpriority, '|' ORDER BY o_orderkey) FROM (FROM orders ORDER BY o_orderkey LIMIT 5)"""
_missing = lambda c: f"""
SELECT '{c}' AS field, count(*) AS total, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS ratio,
  CASE WHEN (count(*) - count({c})) / count(*) > 0.5 THEN 'critical' WHEN (count(*) - count({c})) / count(*) > 0.1 THEN 'warning' END AS severity
FROM documents LEFT JOIN labels USING (doc_id)"""
SQL["profile_missing"] = " UNION ALL ".join(_missing(c) for c in ("text", "lang", "quality", "toxic"))
_dtype = lambda c, e: f"""
SELECT '{c}' AS field, count({e}) AS present, count(TRY_CAST({e} AS DOUBLE)) AS numeric_count,
  CASE WHEN count({e}) = 0 THEN 'empty' WHEN count(TRY_CAST({e} AS DOUBLE)) / count({e}) > 0.8 THEN 'numeric' ELSE 'text' END AS dtype FROM events"""
SQL["dtype_inference"] = " UNION ALL ".join(
    _dtype(c, e) for c, e in (("k", "props->>'$.k'"), ("event_type", "event_type"), ("value", "value::VARCHAR"), ("none", "props->>'$.none'"))
)
_mix = lambda c: f"""
SELECT '{c}' AS field, 0 AS text_count, count(*) FILTER (WHERE {c} <> floor({c})) AS number_count, count(*) FILTER (WHERE {c} = floor({c})) AS integer_count, false AS mixed FROM lineitem"""
SQL["value_type_mix"] = " UNION ALL ".join(_mix(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + """
UNION ALL SELECT 'l_returnflag', count(*), 0, 0, false FROM lineitem"""
_mode = lambda c: f"""
SELECT '{c}' AS field, "mode", mode_count FROM (SELECT {c} AS "mode", count(*) AS mode_count FROM orders GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)"""
SQL["value_modes"] = " UNION ALL ".join(_mode(c) for c in ("o_orderstatus", "o_orderpriority"))
SQL["value_frequencies"] = " UNION ALL ".join(
    f"SELECT '{c}' AS field, {c}::VARCHAR AS value, count(*) AS n FROM part GROUP BY 1, 2" for c in ("p_type", "p_size", "p_brand")
)
SQL["duplicate_rows"] = """
SELECT 'documents' AS source, count(*) AS row_count, count(*) - count(DISTINCT text) AS duplicate_count, 1 AS key_fields FROM documents
UNION ALL SELECT 'events', count(*), count(*) - count(DISTINCT (user_id, event_type, ts::DATE)), 3 FROM events"""
SQL["duplicate_identifiers"] = """
SELECT md5(text) AS identifier, doc_id AS row_id, occurrences FROM (SELECT *, count(*) OVER (PARTITION BY text) AS occurrences FROM documents) WHERE occurrences > 1"""
SQL["dedup_keep_first"] = """
SELECT doc_id, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY trim(text, E' \\n\\t\\r') ORDER BY doc_id) = 1"""
SQL["coordinate_precision"] = """
WITH c AS (SELECT l_quantity AS v FROM lineitem UNION ALL SELECT l_extendedprice FROM lineitem UNION ALL SELECT l_tax FROM lineitem),
d AS (SELECT v, length(rtrim(CASE WHEN contains(v::VARCHAR, '.') THEN split_part(v::VARCHAR, '.', 2) ELSE '' END, '0')) AS p FROM c)
SELECT count(*) AS cells, 0 AS invalid, 0 AS non_finite, count(*) AS finite_cells, count(*) FILTER (WHERE abs(v) > 50000) AS out_of_range,
  count(*) FILTER (WHERE p < 2) AS low_precision, count(*) FILTER (WHERE p < 2) / count(*) > 0.2 AS low_precision_flag FROM d"""
SQL["decimal_places"] = """
SELECT length(rtrim(split_part(l_extendedprice::VARCHAR, '.', 2), '0'))::INTEGER AS places, count(*) AS cells FROM lineitem GROUP BY 1"""
SQL["schema_variants"] = "SELECT list_aggregate(list_sort(json_keys(props)), 'string_agg', ',') AS key_set, count(*) AS rows FROM events GROUP BY 1"
SQL["key_union"] = """
SELECT key, min(event_id) AS first_row, 0 AS first_pos FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) GROUP BY 1"""

# --- cleaning -------------------------------------------------------------------------------

SQL["fill_median_mode"] = """
WITH r AS (SELECT doc_id, quality, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS judged FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(quality::DOUBLE, (SELECT median(quality) FROM r)) AS quality,
  coalesce(judged, (SELECT judged FROM r WHERE judged IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(doc_id) LIMIT 1)) AS judged FROM r"""
_BOUNDS = "(SELECT m, 1.4826 * median(abs(value - m)) AS s FROM events, (SELECT median(value) AS m FROM events) GROUP BY m)"
SQL["outlier_flags"] = f"""
SELECT event_type, count(*) AS events, count(*) FILTER (WHERE abs(value - m) > 3 * s) AS outliers FROM events, {_BOUNDS} GROUP BY 1"""
SQL["clip_outliers"] = f"SELECT event_id, round(greatest(m - 3 * s, least(m + 3 * s, value)), 6) AS value FROM events, {_BOUNDS}"
SQL["clip_zscore"] = """
SELECT event_id, round(greatest(m - 2 * s, least(m + 2 * s, value)), 5) AS value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)"""
_DEDUPED = """d AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, value,
  CASE WHEN event_type <> 'error' THEN (props->>'$.k')::DOUBLE END AS k FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id) = 1),
t AS (SELECT *, value * 0.001 AS mm FROM d), b AS (SELECT m, 1.4826 * median(abs(mm - m)) AS s FROM t, (SELECT median(mm) AS m FROM t) GROUP BY m)"""
SQL["clean_table"] = f"""
WITH {_DEDUPED}
SELECT event_id, user_id, event_type, day, round(greatest(m - 3 * s, least(m + 3 * s, mm)), 8) AS thickness_m, coalesce(k, (SELECT median(k) FROM d)) AS k FROM t, b"""
SQL["cleaning_actions"] = f"""
WITH {_DEDUPED}
SELECT 'remove_duplicates' AS action, 'user_id,event_type,day' AS field, 'keep_first' AS method, (SELECT count(*) FROM events) - (SELECT count(*) FROM d) AS count
UNION ALL SELECT 'normalize_unit', 'thickness_mm', 'mm->m', count(*) FROM d
UNION ALL SELECT 'clip_outliers', 'thickness_m', 'median_mad', count(*) FROM t, b WHERE mm < m - 3 * s OR mm > m + 3 * s"""
SQL["clean_simple"] = """
SELECT min(conv_id * 1000 + turn) AS row_id, role, (CASE WHEN role = 'system' THEN 0 ELSE length(text) * 0.5 END)::DOUBLE::VARCHAR AS size FROM conversations
GROUP BY role, CASE WHEN role = 'system' THEN -1 ELSE length(text) END, 3"""
SQL["unit_convert"] = """
SELECT p_partkey, round(p_size * CASE p_type WHEN 'SMALL' THEN 0.001 WHEN 'MEDIUM' THEN 0.01 WHEN 'LARGE' THEN 0.3048 WHEN 'PROMO' THEN 1000 ELSE 1 END, 6)::DOUBLE AS si_value,
  CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'm' WHEN p_type = 'PROMO' THEN 'kg/m3' ELSE 'furlong' END AS si_unit FROM part"""
SQL["header_units"] = "SELECT p_partkey, round(p_size * 0.001, 6)::DOUBLE AS length_m, round(p_retailprice * pi() / 180, 6) AS dip_rad FROM part"

# --- issues and scores ----------------------------------------------------------------------

_ISSUES = """i AS (
SELECT 1 AS check_no, 'attributes' AS category, 'warning' AS severity, 4 AS cost, l_returnflag || l_linestatus AS file, l_orderkey * 10 + l_linenumber AS row_id, 'discount ' || l_discount AS message FROM lineitem WHERE l_discount > 0.09
UNION ALL SELECT 2, 'attributes', 'info', 1, l_returnflag || l_linestatus, l_orderkey * 10 + l_linenumber, 'tax too high' FROM lineitem WHERE l_tax > 0.07
UNION ALL SELECT 3, 'topology', 'critical', 10, l_returnflag || l_linestatus, l_orderkey * 10 + l_linenumber, 'quantity at its limit' FROM lineitem WHERE l_quantity = 50 AND l_discount = 0)"""
SQL["issue_rollup"] = f"WITH {_ISSUES} SELECT category, severity, count(*) AS issue_count, sum(cost)::BIGINT AS penalty FROM i GROUP BY ROLLUP (category, severity)"
SQL["quality_score"] = f"""
WITH {_ISSUES} SELECT count(*) AS issue_count, sum(cost)::BIGINT AS penalty, greatest(0, 100 - sum(cost))::INTEGER AS score,
  CASE WHEN 100 - sum(cost) >= 95 THEN 'excellent' WHEN 100 - sum(cost) >= 85 THEN 'good' WHEN 100 - sum(cost) >= 70 THEN 'acceptable' ELSE 'review' END AS grade, count(*) = 0 AS passed
FROM i WHERE check_no = 3"""
SQL["severity_counts"] = f"""
WITH {_ISSUES} SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM i"""
SQL["category_status"] = f"""
WITH {_ISSUES}, k(ordinal, category) AS (VALUES (0, 'geometry'), (1, 'topology'), (2, 'attributes'), (3, 'consistency'), (4, 'coordinate'))
SELECT k.ordinal, k.category, count(i.check_no) AS issue_count, CASE WHEN bool_or(severity = 'critical') THEN 'failed' WHEN bool_or(severity = 'warning') THEN 'review' ELSE 'passed' END AS status,
  coalesce(arg_min(message, (file, check_no, row_id, message)), 'no issue found') AS summary FROM k LEFT JOIN i USING (category) GROUP BY 1, 2"""
SQL["file_status"] = f"""
WITH {_ISSUES} SELECT name, CASE WHEN count(check_no) > 0 THEN 'issues_found' ELSE 'checked' END AS status, count(check_no) AS issue_count
FROM (SELECT DISTINCT l_returnflag || l_linestatus AS name FROM lineitem) LEFT JOIN (FROM i WHERE severity = 'critical') ON name = file GROUP BY 1"""
SQL["issue_numbers"] = f"""
WITH {_ISSUES}, u AS (SELECT DISTINCT file, check_no, row_id, message FROM i WHERE check_no <> 2)
SELECT printf('Q-%04d', row_number() OVER (ORDER BY file, check_no, row_id, message)) AS issue_id, file, check_no, row_id, message, 'row ' || row_id AS location FROM u"""

# --- constraints and templates --------------------------------------------------------------

_absent = lambda c: f"SELECT 'missing' AS \"check\", '{c}' AS field, count(*) - count({c}) AS count, count(*) AS total, NULL::VARCHAR AS severity FROM lineitem"
SQL["constraint_checks"] = " UNION ALL ".join(
    _absent(c) for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
) + "".join(f"""
UNION ALL SELECT '{kind}', '{c}', count(*) FILTER (WHERE {bad}), count(*), CASE WHEN count(*) FILTER (WHERE {bad}) > 0 THEN 'warning' END FROM lineitem"""
    for kind, c, bad in (("range", "l_discount", "l_discount < 0 OR l_discount > 0.05"), ("range", "l_tax", "l_tax < 0 OR l_tax > 0.06"),
                         ("range", "l_quantity", "l_quantity < 10"), ("allowed", "l_returnflag", "l_returnflag NOT IN ('A', 'N')"))) + """
UNION ALL SELECT 'unique', 'l_orderkey + l_linenumber', count(*) - count(DISTINCT (l_orderkey, l_linenumber)), count(*), CASE WHEN count(*) > count(DISTINCT (l_orderkey, l_linenumber)) THEN 'error' END FROM lineitem"""
SQL["range_violations"] = """
WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS r, 'l_discount' AS field, 'range' AS "check", l_discount::VARCHAR AS value FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_tax', 'range', l_tax::VARCHAR FROM lineitem WHERE l_tax < 0 OR l_tax > 0.06
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_quantity', 'range', l_quantity::VARCHAR FROM lineitem WHERE l_quantity < 10
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_returnflag', 'allowed', l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))
SELECT field, "check", count(*) AS cells, count(DISTINCT r) AS rows, max(value) AS highest FROM v GROUP BY 1, 2"""
SQL["unique_key"] = "SELECT 'l_orderkey + l_linenumber' AS unique_key, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_count FROM lineitem"
_MAPPED = """m AS (SELECT o_orderkey, o_orderkey AS order_id, o_custkey AS customer_id, round(o_totalprice / 1000 * 2 + 5, 6) AS x, lower(o_orderstatus) AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN '1 Urgent' WHEN '2-HIGH' THEN '2 High' WHEN '3-MEDIUM' THEN '3 Medium' WHEN '4-NOT SPECIFIED' THEN '4 Not Specified' ELSE '5 Low' END AS priority,
  'unknown' AS origin, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status_std,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'top' ELSE o_orderpriority END AS priority_std FROM orders)"""
SQL["template_projection"] = f"WITH {_MAPPED} SELECT * FROM m"
SQL["template_constraints"] = f"WITH {_MAPPED} " + " UNION ALL ".join(
    f"SELECT 'missing' AS \"check\", '{c}' AS field, 0 AS count, count(*) AS total, NULL::VARCHAR AS severity FROM m"
    for c in ("order_id", "customer_id", "x", "status", "priority", "origin", "status_std", "priority_std")
) + """ UNION ALL SELECT 'missing', 'absent', count(*), count(*), 'error' FROM m
UNION ALL SELECT 'range', 'x', count(*) FILTER (WHERE x < 100 OR x > 900), count(*), 'warning' FROM m
UNION ALL SELECT 'range', 'status', count(*), count(*), 'warning' FROM m
UNION ALL SELECT 'allowed', 'status', count(*) FILTER (WHERE status NOT IN ('f', 'o')), count(*), 'warning' FROM m
UNION ALL SELECT 'allowed', 'priority_std', count(*) FILTER (WHERE priority_std <> 'top'), count(*), 'warning' FROM m
UNION ALL SELECT 'unique', 'customer_id + status', count(*) - count(DISTINCT (customer_id, status)), count(*), 'error' FROM m"""
SQL["transform_failures"] = """
SELECT 'kind' AS field, 'transform_failed' AS problem, count(*) AS cells FROM events WHERE TRY_CAST(event_type AS DOUBLE) IS NULL
UNION ALL SELECT 'none', 'missing_required', count(*) FROM events WHERE props->>'$.none' IS NULL"""
SQL["value_map_default"] = """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'normal' END AS level, o_orderpriority, count(*) AS orders FROM orders GROUP BY 1, 2"""
# base: points for project, source, format and rule categories
SQL["template_recommend"] = r"""
WITH h AS (SELECT DISTINCT lower(unnest(json_keys(props))) AS header FROM events UNION SELECT DISTINCT lower(event_type) FROM events),
u AS (SELECT DISTINCT upper(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]+[.]([^./]+)$', 1)) AS format FROM pages),
t(name, slot, header) AS (VALUES ('orders', 0, 'order id'), ('orders', 0, 'o_orderkey'), ('orders', 1, 'o_custkey'), ('orders', 2, 'o_totalprice'), ('orders', 3, 'o_orderstatus'),
  ('orders', 4, 'o_orderpriority'), ('orders', 5, 'nowhere'), ('orders light', 0, 'order id'), ('orders light', 0, 'o_orderkey'), ('orders light', 1, 'o_custkey'),
  ('customers', 0, 'c_custkey'), ('customers', 1, 'c_name'), ('customers', 2, 'c_phone'), ('customers', 2, 'telephone'),
  ('events', 0, 'k'), ('events', 1, 'buy'), ('events', 1, 'purchase'), ('events', 2, 'signup'), ('events', 3, 'nothing')),
f(name, base, rule_count) AS (VALUES ('orders', 35 + 25 + 4, 4), ('orders light', 12 + 25 + 1, 1), ('customers', 12 + 8 + 1, 1), ('events', 12 + 8 + 1, 1)),
g(name, format) AS (VALUES ('orders', 'CSV'), ('orders', 'PARQUET'), ('orders light', 'PARQUET'), ('customers', 'CSV'), ('events', 'HTML'), ('events', 'CSV')),
p AS (SELECT name, CASE WHEN count(u.format) > 0 THEN least(15, 5 + 5 * count(u.format)) ELSE 0 END AS points FROM g LEFT JOIN u USING (format) GROUP BY 1),
c AS (SELECT name, count(DISTINCT slot) AS field_count, count(DISTINCT CASE WHEN h.header IS NOT NULL THEN slot END) AS fields_hit FROM t LEFT JOIN h USING (header) GROUP BY 1)
SELECT name, rule_count, fields_hit, field_count::INTEGER AS field_count, round(fields_hit / field_count, 6) AS field_coverage,
  least(100, base + points + round_even(20 * fields_hit / field_count, 0))::INTEGER AS score
FROM c JOIN f USING (name) JOIN p USING (name)"""


def _hints() -> str:
    score = lambda words: " + ".join(f"contains(t, '{w.lower()}')::INTEGER" for w in words)
    scores = ", ".join(f"{score(words)} AS s{i}" for i, words in enumerate(words for _, words in HINTS))
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(HINTS))) + ")"
    cases = " ".join(f"WHEN s{i} = {top} THEN '{name}'" for i, (name, _) in enumerate(HINTS))
    return f"""WITH s AS (SELECT {scores} FROM (SELECT lower(source || ' ' || lang || ' ' || text) AS t FROM documents))
SELECT CASE WHEN {top} = 0 THEN '通用数据' {cases} END AS kind, count(*) AS inputs FROM s GROUP BY 1"""


SQL["classify_inputs"] = _hints()
