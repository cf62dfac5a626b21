"""DuckDB counterparts of ``queries_files``: what the written files hold, from the tables themselves."""

SQL: dict[str, str] = {}

_C = """c AS (SELECT (c_custkey // 256)::INTEGER AS g, c_custkey % 256 AS j, c_custkey % 100 AS x, c_nationkey AS y, c_acctbal AS z, c_custkey % 4 + 3 AS k,
  count(*) OVER (PARTITION BY c_custkey // 256) AS n, c_custkey % 256 - min(c_custkey % 256) OVER (PARTITION BY c_custkey // 256) AS i FROM customer),
t AS (SELECT g, i, unnest(range(k)) AS o, n FROM c),
f AS (SELECT g, count(*) AS corners, sum((i + o) % n)::BIGINT AS ids FROM t GROUP BY 1),
v AS (SELECT g, count(*) AS vertices, sum(x)::DOUBLE AS x, round(sum(z), 2) AS z, count(*) AS faces, sum(k)::BIGINT AS quality FROM c GROUP BY 1)"""
SQL["vtk_words"] = f"WITH {_C} SELECT g, vertices, x, z, faces, corners, ids FROM v JOIN f USING (g)"
SQL["ply_properties"] = f"WITH {_C} SELECT g, vertices, x, z, faces, corners, ids, quality FROM v JOIN f USING (g)"
SQL["stl_text"] = f"""WITH {_C}, p AS (SELECT g, x, y, k FROM c UNION SELECT g, x + 1, y, k FROM c UNION SELECT g, x, y + 1, k FROM c)
SELECT g, count(*) AS vertices, sum(x)::DOUBLE AS x, any_value(faces) AS faces FROM p JOIN (SELECT g, faces FROM v) USING (g) GROUP BY 1"""
SQL["ifc_statements"] = """WITH c AS (SELECT (c_custkey // 256)::INTEGER AS g, c_custkey % 256 AS i FROM customer),
e AS (SELECT g, i % 200 AS id FROM c UNION ALL SELECT g, i + 1000 FROM c),
w AS (SELECT g, CASE WHEN i % 50 = 0 THEN '' ELSE 'g' || (i % 100) END AS gid FROM c),
d AS (SELECT g, count(*) AS duplicate_ids FROM (SELECT g, id FROM e GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
r AS (SELECT g, count(*) AS duplicate_global_ids FROM (SELECT g, gid FROM w GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
SELECT c.g, 2 * count(*) AS entities, count(*) AS products, count(*) AS points, count(*) FILTER (WHERE i % 50 = 0) AS empty_global_ids, c.g % 3 <> 0 AS complete,
  coalesce(any_value(duplicate_ids), 0) AS duplicate_ids, coalesce(any_value(duplicate_global_ids), 0) AS duplicate_global_ids
FROM c LEFT JOIN d USING (g) LEFT JOIN r USING (g) GROUP BY c.g"""
SQL["json_documents"] = """SELECT (c_custkey // 256)::INTEGER AS g, CASE WHEN c_custkey // 256 % 3 = 1 THEN 'List' ELSE 'FeatureCollection' END AS json_type, count(*) AS rows, count(*) - 1 AS last,
  sum(c_custkey % 256)::BIGINT AS no, CASE WHEN c_custkey // 256 % 3 = 1 THEN NULL ELSE sum(c_custkey % 100)::BIGINT END AS x, count(*) AS names FROM customer GROUP BY c_custkey // 256"""
SQL["version_documents"] = """SELECT 'p' || (o_orderkey // 1024) AS project_name, 'm' AS module_name, '1.' || (o_orderkey % 7) AS version_number, count(*) AS versions,
  strftime(min(o_orderdate), '%Y-%m-%d') AS first, 2 * count(*) AS tags, 'f' || max(o_orderkey % 5) || '.csv' AS last_file FROM orders GROUP BY 1, 2, 3"""
_T = "t AS (SELECT (c_custkey // 256)::INTEGER AS g, string_agg(c_acctbal::VARCHAR, chr(10) ORDER BY c_custkey) || chr(10) AS text FROM customer GROUP BY 1)"
SQL["file_scan"] = f"WITH {_T} SELECT '表格' AS category, count(*) AS count, sum(strlen(text))::BIGINT AS size_bytes FROM t"
SQL["file_digests"] = f"WITH {_T} SELECT g, strlen(text) AS length, sha256(text) AS sha256 FROM t"
SQL["run_manifest"] = f"""WITH {_T} SELECT run AS run_id, 'export' AS kind, '256' AS block, count(*) AS files, count(*) AS outputs, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS digests
FROM t, (VALUES ('first'), ('second')) r(run) GROUP BY run"""
SQL["archive_tables"] = """SELECT facet, count(*) AS rows, count(*) AS versions FROM orders, (VALUES ('metadata'), ('lineage'), ('quality'), ('parameters'), ('workflow'), ('copies')) f(facet)
WHERE o_orderstatus = 'F' GROUP BY 1"""  # a version has one output, the only kind of file an archive copies
SQL["stl_writer"] = f"WITH {_C} SELECT 3 * count(*) AS vertices, (3 * sum(x) + count(*))::DOUBLE AS x, (3 * sum(y) + count(*))::DOUBLE AS y, (3 * sum(k))::DOUBLE AS z FROM c"
