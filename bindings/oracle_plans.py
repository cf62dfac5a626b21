"""DuckDB counterparts of ``queries_plans``."""

from bindings.oracle_more import SQL as MORE, _AREA, _C

SQL: dict[str, str] = {}

_G = f"""{_C.replace('c AS (', 'c0 AS (', 1)}, bad AS (SELECT fid, bool_or(p_type = 'PROMO') AS bad FROM c0 JOIN part ON vid = p_partkey GROUP BY 1),
c AS (SELECT fid, pos, vid, n FROM c0 JOIN bad USING (fid) WHERE NOT bad)"""
_M = f"""{_G}, e AS (SELECT fid, vid AS a, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS b FROM {{corners}} WINDOW w AS (PARTITION BY fid ORDER BY pos)),
u AS (SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS uses, count(*) FILTER (WHERE a <= b) AS upward FROM e GROUP BY 1, 2),
k AS (SELECT p_partkey AS vid, p_size::DOUBLE AS x, regexp_extract(p_brand, '(\\d+)', 1)::DOUBLE AS y, p_retailprice AS z FROM part WHERE p_type <> 'PROMO'),
w AS (SELECT sum(n - 1)::BIGINT AS n FROM (SELECT count(*) AS n FROM k GROUP BY x, y, z))"""
_AREAS = _AREA[_AREA.index(", v AS ("):]
_ISSUES = f"""{_M.format(corners='c')}{_AREAS},
i AS (SELECT 20 AS no, 'geometry' AS category, 'EMPTY_GEOMETRY' AS code, 'critical' AS severity, 'gone' AS file, NULL::BIGINT AS n
UNION ALL SELECT 22, 'topology', 'INVALID_INDEX', 'critical', 'lineitem', (SELECT count(*) FROM bad WHERE bad)
UNION ALL SELECT 23, 'geometry', 'DEGENERATE_FACE', 'critical', 'lineitem', (SELECT count(*) FROM area WHERE area <= 1e-12)
UNION ALL SELECT 25, 'geometry', 'OPEN_BOUNDARY', 'critical', 'lineitem', (SELECT count(*) FROM u WHERE uses = 1)
UNION ALL SELECT 26, 'topology', 'NON_MANIFOLD_EDGE', 'critical', 'lineitem', (SELECT count(*) FROM u WHERE uses > 2)
UNION ALL SELECT 27, 'topology', 'INCONSISTENT_ORIENTATION', 'warning', 'lineitem', (SELECT count(*) FROM u WHERE uses = 2 AND upward <> 1)
UNION ALL SELECT 24, 'consistency', 'DUPLICATE_FACE', 'warning', 'lineitem', (SELECT count(*) - count(DISTINCT s) FROM (SELECT fid, list(vid ORDER BY vid) AS s FROM c GROUP BY 1))
UNION ALL SELECT 28, 'consistency', 'DUPLICATE_VERTEX', 'warning', 'lineitem', (SELECT n FROM w)
UNION ALL SELECT 42, 'coordinate', 'COORDINATE_RANGE', 'warning', 'coordinates', (SELECT sum((x > 1000)::INTEGER + (y > 1000)::INTEGER + (z > 1000)::INTEGER) FROM k)),
f AS (SELECT * FROM i WHERE n > 0 OR n IS NULL)"""
SQL["mesh_quality_report"] = f"""WITH {_ISSUES} SELECT code, category, severity, file, n, 'Q-' || lpad(row_number() OVER (ORDER BY file, no)::VARCHAR, 4, '0') AS issue_id FROM f"""
SQL["mesh_light_report"] = f"""WITH {_M.format(corners='c0')}
SELECT 'DUPLICATE_RECORD' AS code, 'duplicates' AS category, CASE WHEN n > 10 THEN 'warning' ELSE 'info' END AS severity, 'lineitem' AS file, n FROM w WHERE n > 0
UNION ALL SELECT 'FIELD_VALIDATION', 'field_validation', 'critical', 'lineitem', count(*) FROM bad WHERE bad
UNION ALL SELECT 'OUTLIER_VALUE', 'outliers', 'warning', 'lineitem', count(*) FROM u WHERE uses = 1"""
SQL["comparison_report"] = f"SELECT * REPLACE (pair_name || '.obj' AS pair_name) FROM ({MORE['compare_bounds']})"
SQL["mesh_quality_states"] = f"""WITH {_ISSUES}, r AS (SELECT category, count(*) AS issue_count, max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS worst FROM f GROUP BY 1)
SELECT c.category, coalesce(issue_count, 0) AS issue_count, CASE worst WHEN 3 THEN 'failed' WHEN 2 THEN 'review' ELSE 'passed' END AS status
FROM (VALUES ('geometry'), ('topology'), ('attributes'), ('consistency'), ('coordinate')) c(category) LEFT JOIN r USING (category)"""
SQL["clean_and_recheck"] = """WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity, l_returnflag, l_extendedprice FROM lineitem),
k AS (SELECT DISTINCT CASE WHEN id % 10 <> 0 THEN l_quantity END AS q, CASE WHEN id % 4 <> 0 THEN l_returnflag END AS f, l_extendedprice AS price FROM l)
SELECT count(*) AS rows, count(*) AS quantities, count(*) AS flags, round(sum(price), 2) AS price FROM k"""
