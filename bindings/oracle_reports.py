"""DuckDB counterparts of ``queries_more``; every constant is written out."""

SQL: dict[str, str] = {}

_F = """f AS (SELECT doc_id, source, lang, doc_id % 4 AS kind, n_chars % 7 AS deep FROM documents)"""
_P = f"""{_F}, p AS (
  SELECT source, doc_id, 'Polygon' AS geom_type, 1 AS depth, unnest([doc_id, 4, 4, 0])::DOUBLE AS x, 0::DOUBLE AS z, kind FROM f WHERE kind = 0
  UNION ALL SELECT source, doc_id, 'Polygon', 1, unnest([doc_id, 4, 4, doc_id])::DOUBLE, 0, kind FROM f WHERE kind = 1
  UNION ALL SELECT source, doc_id, 'Polygon', 1, unnest([doc_id, 4, 4])::DOUBLE, 0, kind FROM f WHERE kind = 2
  UNION ALL SELECT source, doc_id, 'Point', deep + 1, doc_id::DOUBLE, 0, kind FROM f WHERE kind = 3
  UNION ALL SELECT source, doc_id, 'Point', unnest(range(2, deep + 2)), 0::DOUBLE, 3, kind FROM f WHERE kind = 3)"""
SQL["geometry_points"] = f"WITH {_P} SELECT geom_type, depth::INTEGER AS depth, count(*) AS points, sum(x) AS sum_x, sum(z) AS sum_z FROM p GROUP BY 1, 2"
SQL["ring_checks"] = f"""WITH {_F} SELECT kind = 2 AS too_short, kind = 0 AS open, count(*) AS rings FROM f WHERE kind < 3 GROUP BY 1, 2"""
SQL["feature_quality"] = f"""WITH {_P},
i AS (SELECT 'OPEN_BOUNDARY' AS code, 'critical' AS severity, count(*) AS n FROM f WHERE kind = 0
  UNION ALL SELECT 'INVALID_RING', 'critical', count(*) FROM f WHERE kind = 2
  UNION ALL SELECT 'MISSING_ATTRIBUTE', 'critical', count(*) FROM f WHERE doc_id % 5 = 0 UNION ALL SELECT 'MISSING_ATTRIBUTE', 'warning', count(*) FROM f WHERE doc_id % 5 = 0
  UNION ALL SELECT 'INCONSISTENT_SCHEMA', 'warning', count(*) FROM (SELECT source FROM f GROUP BY 1 HAVING count(DISTINCT doc_id % 5 = 0) > 1)
  UNION ALL SELECT 'COORDINATE_RANGE', 'warning', (max(x) > 150)::INTEGER FROM p)
SELECT code, severity, sum(n)::BIGINT AS issues FROM i GROUP BY 1, 2 HAVING sum(n) > 0"""
SQL["feature_models"] = f"""WITH {_F},
xy AS (SELECT source, unnest([(doc_id, 0, 0), (4, 0, 0), (4, 3, 0), (0, 3, 0)]) AS v FROM f WHERE kind = 0
  UNION ALL SELECT source, unnest([(doc_id, 0, 0), (4, 0, 0), (4, 3, 0)]) FROM f WHERE kind IN (1, 2)
  UNION ALL SELECT source, (doc_id, 1, 0) FROM f WHERE kind = 3 UNION ALL SELECT source, (0, 2, 3) FROM f WHERE kind = 3 AND deep > 0),
pv AS (SELECT source, (doc_id, 1, 0) AS v FROM f WHERE kind = 3 UNION ALL SELECT source, (0, 2, 3) FROM f WHERE kind = 3 AND deep > 0)
SELECT model_id, vertices, coalesce(faces, 0) AS faces, coalesce(vertex_props, 0) AS vertex_props, coalesce(faces, 0) AS face_props
FROM (SELECT source AS model_id, count(DISTINCT v) AS vertices FROM xy GROUP BY 1) LEFT JOIN (SELECT source AS model_id, count(*) AS faces FROM f WHERE kind < 3 GROUP BY 1) USING (model_id)
LEFT JOIN (SELECT source AS model_id, count(DISTINCT v) AS vertex_props FROM pv GROUP BY 1) USING (model_id)"""
SQL["feature_columns"] = """SELECT CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS lang, count(*) AS rows, count(*) FILTER (WHERE doc_id % 5 <> 0) AS n,
  (sum(doc_id) FILTER (WHERE doc_id % 4 = 3 AND n_chars % 7 = 0))::DOUBLE AS longitude FROM documents GROUP BY 1"""
SQL["csv_documents"] = "SELECT doc_id, md5(text) AS md5, false AS _ragged FROM documents"
SQL["csv_layouts"] = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS price,
  count(*) FILTER (WHERE o_orderkey % 2 = 1) AS customers, 0::BIGINT AS ragged FROM orders GROUP BY 1"""
SQL["table_points"] = r"""SELECT p_type AS kind, count(*) AS points, sum(regexp_extract(p_brand, '(\d+)', 1)::DOUBLE) AS x, sum(p_size::DOUBLE) AS y,
  round(sum(CASE WHEN p_name LIKE 's%' THEN 0 ELSE p_retailprice END), 2)::DOUBLE AS z FROM part GROUP BY 1"""
SQL["conversion_plan"] = """WITH s AS (SELECT (['.obj', '.stl', '.csv', '.las', '.dwg', 'unknown'])[page_id % 6 + 1] AS source_format FROM pages)
SELECT source_format, 'GEOJSON' AS target_format, 'GIS平台' AS target_platform, source_format IN ('.obj', '.stl', '.csv') AS supported,
  CASE WHEN source_format IN ('.obj', '.stl', '.csv') THEN 'can be converted' ELSE 'no parser for this format' END AS message, count(*) AS files FROM s GROUP BY ALL"""
_B = """c AS (SELECT c_custkey & 1 = 1 AS f, c_custkey & 2 = 2 AS l, c_custkey & 4 = 4 AS v, c_custkey & 8 = 8 AS w, c_custkey % 5 = 0 AS m FROM customer)"""
SQL["information_losses"] = f"""WITH {_B}, n AS (SELECT 'CSV' AS target, 'faces are kept in the sidecar only' AS loss, count(*) AS models FROM c WHERE f
  UNION ALL SELECT 'CSV', 'lines are kept in the sidecar only', count(*) FROM c WHERE l UNION ALL SELECT 'CSV', 'face attributes are kept in the sidecar only', count(*) FROM c WHERE w
  UNION ALL SELECT 'GEOJSON', 'vertex attributes of faces are kept in the sidecar only', count(*) FROM c WHERE f AND v
  UNION ALL SELECT t, t || ' does not hold all attributes; they are kept in the sidecar', count(*) FROM c, (VALUES ('OBJ'), ('STL')) x(t) WHERE v OR w GROUP BY t
  UNION ALL SELECT 'STL', 'STL does not hold lines; they are kept in the sidecar', count(*) FROM c WHERE l)
SELECT loss, models, target FROM n WHERE models > 0"""
SQL["sidecar_need"] = f"""WITH {_B} SELECT fmt, CASE fmt WHEN 'CSV' THEN f OR l OR w OR m WHEN 'GEOJSON' THEN m OR (f AND v) ELSE v OR w OR m END AS needed, count(*) AS models
FROM c, (VALUES ('CSV'), ('GEOJSON'), ('OBJ')) x(fmt) GROUP BY 1, 2"""
SQL["csv_round_trip"] = """SELECT replace(p_brand, '#', '') AS model_id, p_type AS kind, count(*) AS points, sum(p_size)::DOUBLE AS x, sum(p_partkey + 1)::BIGINT AS ids, count(DISTINCT p_name) AS names,
  'success' AS state, 0::BIGINT AS losses, 100::BIGINT AS quality_score FROM part GROUP BY 1, 2"""
SQL["geojson_round_trip"] = """SELECT 'n' || s_nationkey AS model_id, count(*) AS points, sum(s_suppkey)::DOUBLE AS x, round(sum(round(s_acctbal, 2)), 2)::DOUBLE AS y, count(DISTINCT s_name) AS names, count(*) AS ok
FROM supplier GROUP BY 1"""
SQL["kept_attributes"] = """SELECT 'ID' AS key, count(*) AS rows, count(DISTINCT p_partkey) AS values FROM part UNION ALL SELECT 'Name', count(*), count(DISTINCT p_name) FROM part"""
SQL["table_quality"] = """WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS q, count(*) FILTER (WHERE toxic IS NULL) AS x FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'MISSING_ATTRIBUTE' AS code, 'attributes' AS category, 'critical' AS severity, NULL AS field, 'missing required columns: owner' AS message
UNION ALL SELECT 'MISSING_ATTRIBUTE', 'attributes', 'critical', 'quality', 'quality: ' || q || ' of ' || n || ' missing' FROM t WHERE q > 0
UNION ALL SELECT 'MISSING_ATTRIBUTE', 'attributes', CASE WHEN x / n >= 0.5 THEN 'critical' ELSE 'warning' END, 'toxic', 'toxic: ' || x || ' of ' || n || ' missing' FROM t WHERE x > 0
UNION ALL SELECT 'INCONSISTENT_SCHEMA', 'consistency', 'warning', 'size', 'mixed value types in size'"""
SQL["location_samples"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders)
SELECT o_orderpriority, total, string_agg(o_orderkey, '、' ORDER BY o_orderkey) || CASE WHEN total > 5 THEN ' and ' || total || ' in all' ELSE '' END AS places FROM r WHERE k <= 5 GROUP BY 1, 2"""
SQL["unpaired_models"] = """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), p AS (SELECT * FROM customer FULL JOIN a ON c_custkey = o_custkey)
SELECT coalesce(c_custkey, o_custkey)::VARCHAR AS pair_name, 'position' AS dimension, CASE WHEN o_custkey IS NULL THEN 'after_missing' WHEN c_custkey IS NULL THEN 'before_missing' ELSE 'parse_failed' END AS metric,
  CASE WHEN o_custkey IS NULL OR c_custkey IS NULL THEN 1.0::DOUBLE END AS deviation, false AS passed FROM p WHERE o_custkey IS NULL OR c_custkey IS NULL OR NOT c_acctbal > 0"""
SQL["retry_outcomes"] = """WITH e AS (SELECT event_id, (props->>'$.k')::INTEGER % 6 AS need, event_type = 'error' AS broken FROM events),
s AS (SELECT event_id, CASE WHEN need = 0 OR (NOT broken AND need <= 3) THEN 'success' ELSE 'failed' END AS state, CASE WHEN broken THEN 0 ELSE least(need, 3) END AS retries FROM e)
SELECT state, retries, count(*) AS items, sum(event_id)::BIGINT AS ids FROM s GROUP BY 1, 2"""
SQL["job_list"] = """WITH i AS (SELECT user_id, ts, event_type = 'error' AS e, event_type = 'view' AS v, (props->>'$.k')::INTEGER AS k FROM events),
j AS (SELECT user_id AS job_id, min(ts) AS created, count(*) AS total, bool_or(e AND k > 80) AS cancelled, bool_or(e AND k BETWEEN 21 AND 80) AS failed, bool_or(e AND k <= 20) AS skipped,
  bool_or(NOT e AND NOT (v AND k < 10)) AS success FROM i GROUP BY 1)
SELECT job_id, regexp_replace(strftime(created, '%Y-%m-%d %H:%M:%S.%f'), '[.]?0*$', '') AS created_at, total FROM j WHERE NOT (cancelled AND failed) AND (cancelled OR failed OR skipped) AND success"""
SQL["job_outputs"] = """WITH p AS (SELECT o_custkey AS report_id, o_orderkey AS ordinal, left(o_orderpriority, 1) AS d, o_orderstatus <> 'P' AS main, o_totalprice > 200000 AS side FROM orders),
l AS (SELECT report_id, ordinal, 0 AS pos, 'o' || d AS path FROM p WHERE main UNION ALL SELECT report_id, ordinal, main::INTEGER, 'side' FROM p WHERE side
  UNION ALL SELECT report_id, ordinal, main::INTEGER + 1, 's' || d FROM p WHERE side)
SELECT report_id, path, min((ordinal, pos))[1] AS ordinal, min((ordinal, pos))[2]::INTEGER AS pos FROM l GROUP BY 1, 2"""
SQL["error_texts"] = """WITH e AS (SELECT event_type, (props->>'$.k')::INTEGER % 7 AS k FROM events)
SELECT CASE event_type WHEN 'error' THEN array_to_string(list_transform(([0, 2, 3, 4])[1 : greatest(1, k)], lambda i: 'e' || i), '；') WHEN 'click' THEN 'm；n' ELSE event_type END AS text, count(*) AS items FROM e GROUP BY 1"""
SQL["version_archive"] = """WITH o AS (SELECT *, printf('VER-%08d', o_orderkey) AS version_id, left(o_orderpriority, 1) AS d FROM orders WHERE o_orderstatus <> 'O')
SELECT version_id, true AS archived, CASE WHEN o_orderstatus = 'P' THEN '/arch/draft' || d || '_' || version_id ELSE '' END AS archive_path FROM o"""
SQL["archive_manifest"] = """WITH o AS (SELECT 'out' || left(o_orderpriority, 1) AS name FROM orders WHERE o_orderstatus = 'F')
SELECT name, name IN ('out1', 'out3') AS copied, count(*) AS versions, count(*) FILTER (WHERE name IN ('out1', 'out3')) AS targets FROM o GROUP BY 1, 2"""
SQL["number_kinds"] = """WITH c AS (SELECT event_id % 5 AS m, event_id, value FROM events)
SELECT CASE m WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'text' WHEN 3 THEN NULL ELSE 'number' END AS kind, count(*) AS cells,
  round(sum(CASE m WHEN 0 THEN event_id WHEN 1 THEN value WHEN 4 THEN 1000 END), 3)::DOUBLE AS total FROM c GROUP BY 1"""
SQL["comparison_roles"] = """SELECT CASE WHEN page_id % 5 IN (0, 2) THEN 'before' WHEN page_id % 5 IN (1, 3) THEN 'after' END AS role, count(*) AS files FROM pages GROUP BY 1"""
SQL["stream_dedup"] = "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1"
SQL["stream_issue_rate"] = """WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events), d AS (SELECT ts::DATE AS day, event_type AS category, value FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, category, count(*) AS rows, count(*) FILTER (WHERE value > 100) AS issues FROM d, m WHERE day + INTERVAL 1 DAY <= mark GROUP BY 1, 2"""
