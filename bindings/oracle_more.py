"""DuckDB SQL, second part: vocabulary, meshes, comparison, versions and batches."""

from __future__ import annotations

import re

from bindings.tables import DICTIONARY_ROWS, ROCK, STRATA, STRUCTURE, WATER

SQL: dict[str, str] = {}

# --- vocabulary -----------------------------------------------------------------------------

_fold = lambda text: re.sub(r"[\s_\-]+", "", text.lower())
_index = sorted({
    (r["domain"], _fold(text), r["canonical"], priority, system)
    for r in DICTIONARY_ROWS
    for priority, system, text in (
        (0, "CANONICAL", r["canonical"]), *((2, "ALIAS", a) for a in r["aliases"]), *((1, k, v) for k, v in r["codes"].items()),
    )
})
_entries = [(r["domain"], r["canonical"], r["codes"].get("PROJECT", ""), r["codes"].get("SYMBOL", "")) for r in DICTIONARY_ROWS]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
_TOKEN = r"regexp_replace(lower(trim(raw)), '[\s_\-,;:/\\()\[\]{}<>]+', '', 'g')"
_TERMS = f"""idx(domain, tok, canonical, priority, system) AS (VALUES {_values(_index)}),
dict(domain, canonical, project, symbol) AS (VALUES {_values(_entries)}),
terms AS (SELECT 'p_name' AS field, '{ROCK}' AS domain, p_name AS raw, count(*) AS rows FROM part GROUP BY 3
  UNION ALL SELECT 'p_type', '{STRATA}', p_type, count(*) FROM part GROUP BY 3
  UNION ALL SELECT 'event_type', '{WATER}', event_type, count(*) FROM events GROUP BY 3
  UNION ALL SELECT 'lang', '{STRUCTURE}', lang, count(*) FROM documents GROUP BY 3),
k AS (SELECT *, {_TOKEN} AS tok FROM terms),
cand AS (SELECT field, raw, idx.canonical, min((priority, system)) AS ps FROM k JOIN idx USING (domain, tok) GROUP BY 1, 2, 3),
ex AS (SELECT field, raw, arg_min(canonical, (ps[1], canonical)) AS best, min((ps[1], canonical, ps[2]))[3] AS sys, min(ps[1]) AS p, count(*) AS n,
  string_agg(canonical, '、' ORDER BY ps[1], canonical) AS cands FROM cand GROUP BY 1, 2),
sp AS (SELECT k.field, k.raw, idx.tok AS w, min(idx.canonical) AS canonical, instr(any_value(k.tok), idx.tok) AS st, length(idx.tok) AS ln
  FROM k JOIN idx ON k.domain = idx.domain AND length(idx.tok) >= 2 AND contains(k.tok, idx.tok) ANTI JOIN ex ON k.field = ex.field AND k.raw = ex.raw GROUP BY 1, 2, 3),
outer_ AS (SELECT * FROM sp a WHERE NOT EXISTS (SELECT 1 FROM sp b WHERE b.field = a.field AND b.raw = a.raw AND b.ln > a.ln AND b.st <= a.st AND b.st + b.ln >= a.st + a.ln)),
once AS (SELECT * FROM outer_ QUALIFY row_number() OVER (PARTITION BY field, raw, canonical ORDER BY ln DESC, st) = 1),
"""


def _mapping(strategy: str, policy: str) -> str:
    """CTE ``m`` with one row per (field, raw)."""
    keep = strategy == "keep_original"
    pick = "WHERE 1 = 0" if keep else ("QUALIFY row_number() OVER (PARTITION BY field, raw ORDER BY st, ln DESC, canonical) = 1" if strategy == "longest" else "")
    kind = "longest_substring" if strategy == "longest" else "composite"
    clash_kind = "conflict_review" if policy == "review" else "conflict_kept"
    clash = "coalesce(ex.n, 0) > 1" if policy != "override" else "false"
    many_kept = "ex.n > 1" if keep else "false"
    base = "CASE ex.p WHEN 0 THEN 1.0 WHEN 1 THEN 0.97 ELSE 0.95 END"
    return f"""comp AS (SELECT field, raw, string_agg(canonical, '；' ORDER BY st, ln DESC, canonical) AS names FROM (SELECT * FROM once {pick}) GROUP BY 1, 2),
hit AS (SELECT field, raw, best AS canonical, 1 AS ord FROM ex WHERE NOT ({many_kept}) UNION ALL
  SELECT field, raw, canonical, row_number() OVER (PARTITION BY field, raw ORDER BY st, ln DESC, canonical) FROM (SELECT * FROM once {pick})),
codes AS (SELECT field, raw, string_agg(project, '|' ORDER BY ord) FILTER (WHERE project <> '') AS project, string_agg(symbol, '|' ORDER BY ord) FILTER (WHERE symbol <> '') AS symbol
  FROM hit JOIN k USING (field, raw) JOIN dict ON dict.domain = k.domain AND dict.canonical = hit.canonical GROUP BY 1, 2),
m AS (SELECT k.field, k.domain, k.raw, k.rows,
  CASE WHEN {clash} OR {many_kept} THEN k.raw WHEN ex.n IS NOT NULL THEN ex.best ELSE coalesce(comp.names, k.raw) END AS canonical,
  CASE WHEN {clash} THEN '{clash_kind}' WHEN {many_kept} THEN 'ambiguous_kept' WHEN ex.p = 0 THEN 'canonical' WHEN ex.p = 1 THEN 'code:' || ex.sys WHEN ex.p = 2 THEN 'alias'
    WHEN comp.names IS NOT NULL THEN '{kind}' ELSE 'none' END AS matched_by,
  round(CASE WHEN {many_kept} THEN 0.0 WHEN ex.n > 1 THEN greatest(0.55, {base} - 0.15) WHEN ex.n = 1 THEN {base} WHEN comp.names IS NOT NULL THEN 0.72 ELSE 0.0 END, 4)::DOUBLE AS confidence,
  CASE WHEN {clash} THEN '' ELSE coalesce(codes.project, '') END AS project_code, CASE WHEN {clash} THEN '' ELSE coalesce(codes.symbol, '') END AS symbol,
  coalesce(ex.n, 0)::INTEGER AS candidates, ex.cands
  FROM k LEFT JOIN ex USING (field, raw) LEFT JOIN comp USING (field, raw) LEFT JOIN codes USING (field, raw))"""


def _with_mapping(strategy: str, policy: str, select: str) -> str:
    return f"WITH {_TERMS}{_mapping(strategy, policy)} {select}"


_plain = ("prefer_canonical", "review")
SQL["term_mappings"] = _with_mapping(*_plain, "SELECT * EXCLUDE (cands) FROM m")
SQL["term_mappings_longest"] = _with_mapping("longest", "override", "SELECT * EXCLUDE (cands) FROM m")
SQL["term_mappings_original"] = _with_mapping("keep_original", "keep_original", "SELECT * EXCLUDE (cands) FROM m")
SQL["term_conflicts"] = _with_mapping(*_plain, "SELECT field, domain, raw, cands AS candidates, 'review' AS resolution FROM m WHERE candidates > 1")
SQL["unmapped_terms"] = _with_mapping(*_plain, "SELECT field, raw, rows FROM m WHERE confidence = 0")
SQL["term_relations"] = _with_mapping(*_plain, """SELECT m.field, m.raw, m.canonical AS source_term, 'next_to' AS type, 'bolt' AS target FROM m JOIN hit USING (field, raw)
WHERE m.field = 'p_name' AND hit.canonical = 'ring'""")
_rate = "round(count(*) FILTER (WHERE confidence > 0) / count(*), 4)"
SQL["semantic_coverage"] = _with_mapping(*_plain, f"""SELECT domain, count(*) AS total, count(*) FILTER (WHERE confidence > 0) AS mapped, count(*) FILTER (WHERE confidence = 0) AS unmapped,
{_rate} AS coverage FROM m GROUP BY ROLLUP (domain)""")
SQL["semantic_score"] = _with_mapping(*_plain, f""", f AS (SELECT count(*) AS total, count(*) FILTER (WHERE confidence > 0) AS mapped, count(*) FILTER (WHERE candidates > 1) AS conflicts,
count(*) FILTER (WHERE confidence = 0) AS unmapped, {_rate} AS coverage FROM m),
s AS (SELECT *, greatest(0, least(100, 100 - unmapped * 3 - round_even((1 - coverage) * 35, 0) - least(15, conflicts * 3)))::INTEGER AS score FROM f)
SELECT *, CASE WHEN score >= 95 THEN 'excellent' WHEN score >= 85 THEN 'good' WHEN score >= 70 THEN 'acceptable' ELSE 'review' END AS grade FROM s""")
SQL["normalise_table"] = _with_mapping("prefer_canonical", "override", """SELECT p_partkey, a.canonical AS p_name_canonical, a.project_code AS p_name_project_code, a.confidence AS p_name_confidence,
b.canonical AS p_type_canonical, b.symbol AS p_type_target_code, b.matched_by AS p_type_matched_by
FROM part JOIN m a ON a.field = 'p_name' AND a.raw = p_name JOIN m b ON b.field = 'p_type' AND b.raw = p_type""")
SQL["normalise_table_hot"] = SQL["normalise_table"]
SQL["infer_domains"] = f"""WITH {_TERMS.rstrip().rstrip(',')},
w AS (SELECT 'p_name' AS field, p_name AS raw FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_brand', p_brand FROM part
  UNION ALL SELECT 'event_type', event_type FROM events UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents),
v AS (SELECT DISTINCT field, {_TOKEN} AS tok FROM w WHERE raw IS NOT NULL),
sure AS (SELECT domain, tok FROM idx GROUP BY 1, 2 HAVING count(DISTINCT canonical) = 1),
h AS (SELECT field, domain, count(*) AS hits FROM v JOIN sure USING (tok) GROUP BY 1, 2), n AS (SELECT field, count(*) AS n FROM v GROUP BY 1)
SELECT field, arg_max(domain, hits) AS domain, max(hits) AS hits, any_value(n) AS sampled FROM h JOIN n USING (field) GROUP BY 1 HAVING max(hits) >= greatest(2, any_value(n) // 2)"""
_D = """d AS (SELECT p_type AS domain, p_name AS canonical, min(p_brand) AS brand, min(p_size) AS size FROM part GROUP BY 1, 2)"""
SQL["dictionary_audit"] = f"""WITH {_D}, n AS (SELECT domain, replace(canonical, ' ', '') AS token, canonical FROM d UNION SELECT domain, 'size' || size, canonical FROM d),
c AS (SELECT domain, lower(brand) AS token, canonical FROM d WHERE brand <> 'Brand#1')
SELECT 'alias_conflict' AS problem, domain, '' AS system, token, canonical FROM n QUALIFY count(*) OVER (PARTITION BY domain, token) > 1
UNION ALL SELECT 'code_conflict', domain, 'PROJECT', token, canonical FROM c QUALIFY count(*) OVER (PARTITION BY domain, token) > 1
UNION ALL SELECT 'missing_project_code', domain, 'PROJECT', '', canonical FROM d WHERE brand = 'Brand#1'"""
SQL["dictionary_stats"] = """WITH d AS (SELECT p_type AS domain, p_name, count(DISTINCT p_brand) AS a, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 2 END AS c FROM part GROUP BY 1, 2)
SELECT domain, count(*) AS terms, sum(a)::BIGINT AS aliases, sum(c)::BIGINT AS codes FROM d GROUP BY ROLLUP (domain)"""
SQL["dictionary_merge"] = f"""WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT '{STRATA}' AS domain, n_name AS canonical, CASE WHEN n_regionkey = 0 THEN r_name ELSE r_name || '|' || lower(r_name) END AS aliases, n_nationkey::VARCHAR AS project,
  CASE WHEN n_regionkey = 0 THEN '' ELSE r_name END AS symbol FROM n
UNION ALL SELECT '{STRATA}', lower(n_name), n_name, '', r_name FROM n WHERE n_regionkey <> 0"""
SQL["code_translate"] = """SELECT 'n ' || c_nationkey AS value, 'R' || n_regionkey AS mapped_value, n_name AS canonical_name,
  'n ' || c_nationkey || ' [PROJECT] → ' || n_name || ' → R' || n_regionkey || ' [SYMBOL]' AS route, count(*) AS customers
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""

# --- meshes ---------------------------------------------------------------------------------

_C = """c AS (SELECT l_orderkey AS fid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey AS vid, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem QUALIFY n >= 3)"""
_E = _C + """, e AS (SELECT fid, vid AS a, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS b FROM c WINDOW w AS (PARTITION BY fid ORDER BY pos)),
u AS (SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS uses, count(*) FILTER (WHERE a <= b) AS upward FROM e GROUP BY 1, 2)"""
SQL["mesh_edges"] = f"WITH {_E} SELECT uses, count(*) AS edges, sum(upward)::BIGINT AS upward FROM u GROUP BY 1"
SQL["mesh_boundary"] = f"WITH {_E} SELECT u, v FROM u WHERE uses = 1"
SQL["mesh_nonmanifold"] = f"WITH {_E} SELECT u, v, uses FROM u WHERE uses > 2"
SQL["mesh_orientation"] = f"WITH {_E} SELECT u, v, upward FROM u WHERE uses = 2 AND upward <> 1"
SQL["mesh_topology"] = f"""WITH {_E} SELECT 'lineitem' AS model_id, count(*) AS edges, count(*) FILTER (WHERE uses = 1) AS boundary, count(*) FILTER (WHERE uses > 2) AS non_manifold,
  count(*) FILTER (WHERE uses = 2 AND upward <> 1) AS orientation FROM u"""
SQL["mesh_duplicate_faces"] = f"""WITH {_C}, f AS (SELECT fid, list(vid ORDER BY vid) AS s FROM c GROUP BY 1)
SELECT 'lineitem' AS model_id, count(*) - count(DISTINCT s) AS duplicate_faces, count(DISTINCT s) AS distinct_faces FROM f"""
SQL["mesh_invalid_index"] = f"""WITH {_C}, f AS (SELECT fid, count(*) AS size, count(*) FILTER (WHERE p_type = 'PROMO') AS bad FROM c JOIN part ON vid = p_partkey GROUP BY 1)
SELECT bad = 0 AS valid, count(*) AS faces, sum(size)::BIGINT AS corners, sum(bad)::BIGINT AS bad_refs FROM f GROUP BY 1"""
_V = """v AS (SELECT p_partkey AS vid, p_size::DOUBLE AS x, regexp_extract(p_brand, '(\\d+)', 1)::DOUBLE AS y, p_retailprice AS z FROM part)"""
_PLACED = f"""{_C}, {_V}, p AS (SELECT fid, pos, n, vid, x, y, z, {', '.join(f'first_value({a}) OVER w AS o{a}, coalesce(lead({a}) OVER w, first_value({a}) OVER w) AS n{a}' for a in 'xyz')}
  FROM c JOIN v USING (vid) WINDOW w AS (PARTITION BY fid ORDER BY pos))"""
_U, _W = [f"({a} - o{a})" for a in "xyz"], [f"(n{a} - o{a})" for a in "xyz"]
_CROSS = [f"({_U[i]} * {_W[j]} - {_U[j]} * {_W[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
_LEN = f"sqrt({' + '.join(f'{c} * {c}' for c in _CROSS)})"
_FAN = "pos >= 1 AND pos + 1 < n"
_AREA = f"{_PLACED}, area AS (SELECT fid, coalesce(sum(0.5 * {_LEN}) FILTER (WHERE {_FAN}), 0) AS area FROM p GROUP BY 1)"
SQL["face_areas"] = f"WITH {_AREA} SELECT fid, round(area, 3) AS area FROM area"
SQL["mesh_degenerate"] = f"WITH {_AREA} SELECT fid FROM area WHERE area <= 1e-12"
SQL["triangle_normals"] = f"""WITH {_PLACED}, t AS (SELECT fid, {_LEN} AS len, {_CROSS[0]} AS cx, {_CROSS[2]} AS cz FROM p WHERE {_FAN})
SELECT fid, count(*) AS triangles, round(sum(CASE WHEN len <= 1e-15 THEN 0 ELSE cx / len END), 5) AS nx, round(sum(abs(CASE WHEN len <= 1e-15 THEN 0 ELSE cz / len END)), 5) AS nz FROM t GROUP BY 1"""
_RING = [("x", "z")]
SQL["ring_closure"] = f"""WITH {_PLACED}
SELECT fid, count(*)::INTEGER AS points, (count(*) + CASE WHEN arg_min((x, z), pos) = arg_max((x, z), pos) THEN 0 ELSE 1 END)::INTEGER AS closed_points,
  round(abs(sum(x * nz - nx * z)) / 2, 4) AS area, round(sum(sqrt((x - nx) * (x - nx) + (z - nz) * (z - nz))), 4) AS perimeter FROM p GROUP BY 1"""
SQL["duplicate_vertices"] = "SELECT min(l_orderkey * 10 + l_linenumber) AS first_vid, count(*) AS n FROM lineitem GROUP BY l_quantity, round(l_discount, 6), round(l_tax, 6) HAVING count(*) > 1"
SQL["vertex_weld"] = "SELECT p_partkey AS vid, min(p_partkey) OVER (PARTITION BY p_size, round(p_retailprice / 100, 0)) AS new_vid FROM part"
SQL["mesh_clean"] = f"""WITH {_C}, w AS (SELECT p_partkey AS vid, min(p_partkey) OVER (PARTITION BY p_size, p_brand) AS new_vid FROM part),
f AS (SELECT fid, count(*) AS size, count(DISTINCT new_vid) AS d, list(new_vid ORDER BY new_vid) AS s FROM c JOIN w USING (vid) GROUP BY 1),
g AS (SELECT (SELECT count(*) FROM part) AS vi, (SELECT count(DISTINCT new_vid) FROM w) AS vo, count(*) AS fi, count(*) FILTER (WHERE d >= 3) AS fs, count(DISTINCT s) FILTER (WHERE d >= 3) AS fo FROM f)
SELECT 'lineitem' AS model_id, vi AS vertices_in, vo AS vertices_out, fi AS faces_in, fo AS faces_out, vi - vo AS merged_vertices, fi - fs AS removed_invalid_faces, fs - fo AS removed_duplicate_faces FROM g"""
_N = """pt AS (SELECT s_nationkey::VARCHAR AS model_id, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, year(l_shipdate) >= 2000 AS is_after FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_BOX = ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}, max({a}) - min({a}) AS span_{a}, (min({a}) + max({a})) / 2 AS centre_{a}" for a in "xyz")
_DIAG = "sqrt(" + " + ".join(f"(max({a}) - min({a})) ** 2" for a in "xyz") + ") AS diagonal"
SQL["model_bounds"] = f"""WITH {_N}, b AS (SELECT model_id, count(*) AS vertices, {_BOX}, {_DIAG} FROM pt GROUP BY 1)
SELECT model_id, vertices, min_x, max_x, span_x, centre_x, {', '.join(f'round({m}_{a}, 6) AS {m}_{a}' for a in 'yz' for m in ('min', 'max', 'span', 'centre'))}, round(diagonal, 6) AS diagonal FROM b"""
SQL["model_summary"] = f"""WITH {_C}, f AS (SELECT fid, count(*) AS n FROM c GROUP BY 1)
SELECT 'lineitem' AS model_id, (SELECT count(*) FROM part) AS vertex_count, count(*) AS face_count, sum(n - 2)::BIGINT AS triangle_count, 0::BIGINT AS line_count FROM f"""
SQL["coordinate_shift"] = f"""WITH {_V} SELECT 'lineitem' AS model_id, vid, x - (SELECT (min(x) + max(x)) / 2 FROM v) AS x, y - (SELECT (min(y) + max(y)) / 2 FROM v) AS y,
  round(z - (SELECT (min(z) + max(z)) / 2 FROM v), 6) AS z FROM v"""
SQL["normalised_box"] = f"""WITH {_V}, b AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM v)
SELECT 'lineitem' AS model_id, vid, round((x - cx) / s, 8) AS x, round((y - cy) / s, 8) AS y, round((z - cz) / s, 8) AS z FROM v, b"""
SQL["stride_sample"] = """WITH r AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, count(*) OVER () AS n FROM part)
SELECT p_partkey, p_name, idx FROM r WHERE idx IN (SELECT least(floor(i * (n / 100)), n - 1) FROM range(100) t(i), (SELECT any_value(n) AS n FROM r))"""

# --- slices, comparison and distances -------------------------------------------------------

_SLICE = f"""{_PLACED}, s AS (SELECT p.*, z - pos_z AS da, nz - pos_z AS db FROM p, (SELECT (min(z) + max(z)) / 2 AS pos_z FROM v)),
t AS (SELECT *, CASE WHEN abs(da) + abs(db) > 1e-9 THEN abs(da) / (abs(da) + abs(db)) ELSE 0 END AS t, abs(da) <= 1e-9 AND abs(db) <= 1e-9 AS flat FROM s),
raw AS (SELECT x AS u, y AS v FROM t WHERE flat UNION ALL SELECT nx, ny FROM t WHERE flat UNION ALL SELECT x + t * (nx - x), y + t * (ny - y) FROM t WHERE NOT flat AND da * db <= 0),
q AS (SELECT min((u, v)) AS uv FROM raw GROUP BY round(u * 1e9), round(v * 1e9)), pts AS (SELECT uv[1] AS u, uv[2] AS v FROM q)"""
SQL["plane_slice"] = f"WITH {_SLICE} SELECT round(u, 6) AS u, round(v, 6) AS v FROM pts"
SQL["slice_area"] = f"""WITH {_SLICE}, a AS (SELECT u, v, atan2(v - (SELECT avg(v) FROM pts), u - (SELECT avg(u) FROM pts)) AS ang FROM pts),
l AS (SELECT u, v, coalesce(lead(u) OVER w, first_value(u) OVER w) AS nu, coalesce(lead(v) OVER w, first_value(v) OVER w) AS nv FROM a WINDOW w AS (ORDER BY ang, u, v))
SELECT 'lineitem' AS model_id, count(*) AS points, round(abs(sum(u * nv - nu * v)) / 2, 2) AS area, round(sum(sqrt((u - nu) ** 2 + (v - nv) ** 2)), 2) AS perimeter FROM l"""
_sides = ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ba" for c in ("vertices", "diagonal", *(f"{m}_{x}" for m in ("min", "max", "span", "centre") for x in "xyz")))
_PAIR = f"""{_N}, box AS (SELECT model_id, is_after, count(*) AS vertices, {_BOX}, {_DIAG} FROM pt GROUP BY 1, 2),
pr AS (SELECT b.model_id AS pair_name, {_sides} FROM box b JOIN box a ON a.model_id = b.model_id AND a.is_after AND NOT b.is_after)"""
_item = lambda dim, metric, before, after, dev, th, crit: f"""
SELECT pair_name, '{dim}' AS dimension, '{metric}' AS metric, ({before})::DOUBLE AS value_before, ({after})::DOUBLE AS value_after, ({dev})::DOUBLE AS dev, {th}::DOUBLE AS threshold, {crit} AS crit FROM pr"""
_SHIFT = "sqrt(" + " + ".join(f"(b_centre_{x} - a_centre_{x}) ** 2" for x in "xyz") + ")"
_ITEMS = _PAIR + ", it AS (" + " UNION ALL ".join([
    _item("scale", "diagonal", "b_diagonal", "a_diagonal", "abs(b_diagonal - a_diagonal) / b_diagonal", 0.01, 1e18),
    _item("scale", "vertices", "b_vertices", "a_vertices", "abs(b_vertices - a_vertices) / greatest(b_vertices, 1)", 0.01, 1e18),
    *[_item("extent", f"span_{x}", f"b_span_{x}", f"a_span_{x}", f"abs(b_span_{x} - a_span_{x}) / greatest(abs(b_span_{x}), 1e-9)", 0.0005, 3) for x in "xyz"],
    _item("position", "centre_shift", "0", _SHIFT, f"{_SHIFT} / greatest(b_diagonal, 1e-9)", 0.0005, 5),
    *[_item("boundary", f"{m}_{x}", f"b_{m}_{x}", f"a_{m}_{x}", f"abs(b_{m}_{x} - a_{m}_{x}) / greatest(b_diagonal, 1e-9)", 0.0005, 1e18) for x in "xyz" for m in ("min", "max")],
]) + ")"
SQL["compare_bounds"] = f"""WITH {_ITEMS} SELECT pair_name, dimension, metric, round(value_before, 6) AS value_before, round(value_after, 6) AS value_after, round(dev, 6) AS deviation, threshold,
  dev <= threshold AS passed, CASE WHEN dev > threshold * crit THEN 'critical' WHEN dev > threshold THEN 'warning' ELSE 'info' END AS severity FROM it"""
SQL["comparison_rollup"] = f"""WITH {_ITEMS} SELECT d.dimension, count(it.metric) AS total, count(*) FILTER (WHERE dev <= threshold) AS passed, count(it.metric) - count(*) FILTER (WHERE dev <= threshold) AS failed,
  round(coalesce(count(*) FILTER (WHERE dev <= threshold) / nullif(count(it.metric), 0), 0), 4) AS pass_rate
FROM (VALUES ('position'), ('extent'), ('attributes'), ('scale'), ('boundary')) d(dimension) LEFT JOIN it USING (dimension) GROUP BY 1"""
SQL["comparison_score"] = f"""WITH {_ITEMS}, s AS (SELECT count(*) AS total_checks, count(*) FILTER (WHERE dev <= threshold) AS passed_checks FROM it),
r AS (SELECT *, round_even(passed_checks * 100 / total_checks, 0)::INTEGER AS score FROM s)
SELECT *, CASE WHEN score >= 95 THEN 'excellent' WHEN score >= 85 THEN 'good' WHEN score >= 70 THEN 'acceptable' ELSE 'review' END AS grade FROM r"""
_ATTR = """k AS (SELECT DISTINCT event_type AS file_id, ts >= TIMESTAMP '2024-01-11' AS after, 'k_' || (props->>'$.k') || '_' || floor(value / 30)::BIGINT AS attribute FROM events),
ch AS (SELECT file_id, attribute, CASE WHEN count(*) = 2 THEN 'kept' WHEN bool_or(after) THEN 'added' ELSE 'lost' END AS change FROM k GROUP BY 1, 2)"""
SQL["attribute_changes"] = f"WITH {_ATTR} SELECT file_id, change, count(*) AS attributes FROM ch GROUP BY 1, 2"
SQL["attribute_retention"] = f"""WITH {_ATTR}, s AS (SELECT file_id, count(*) FILTER (WHERE change <> 'added') AS nb, count(*) FILTER (WHERE change <> 'lost') AS na, count(*) FILTER (WHERE change = 'kept') AS kept FROM ch GROUP BY 1)
SELECT file_id AS pair_name, 'attributes' AS dimension, 'retention' AS metric, nb::DOUBLE AS value_before, na::DOUBLE AS value_after, round(1 - kept / nb, 6) AS deviation, 0.1::DOUBLE AS threshold,
  kept / nb >= 0.9 AS passed, CASE WHEN kept / nb < 0.5 THEN 'critical' WHEN nb > kept THEN 'warning' ELSE 'info' END AS severity FROM s
UNION ALL SELECT file_id, 'attributes', 'lost_fields', nb - kept, 0, 1, 0, false, 'critical' FROM s WHERE nb > kept"""
_STEM = r"""trim(regexp_replace(regexp_replace(lower(regexp_replace(name, '(.)\.[^.]*$', '\1')), '[_\-\s]+', '_', 'g'), '^_+|_+$', '', 'g'))"""
SQL["pair_files"] = f"""WITH f AS (SELECT page_id AS id, regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1) AS name, starts_with(url, 'https') AS after FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY after, lower(name) ORDER BY id) AS r FROM f),
p1 AS (SELECT b.id AS b, a.id AS a FROM n b JOIN n a ON lower(b.name) = lower(a.name) AND b.r = a.r AND a.after AND NOT b.after),
rest AS (SELECT id, after, {_STEM} AS stem FROM f WHERE id NOT IN (SELECT b FROM p1) AND id NOT IN (SELECT a FROM p1)),
m AS (SELECT *, row_number() OVER (PARTITION BY after, stem ORDER BY id) AS r FROM rest),
p2 AS (SELECT b.id AS b, a.id AS a FROM (FROM m WHERE NOT after) b FULL JOIN (FROM m WHERE after) a ON a.stem = b.stem AND a.r = b.r),
p AS (SELECT 'name' AS rule, b, a FROM p1 UNION ALL SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'stem' ELSE 'unmatched' END, b, a FROM p2)
SELECT rule, count(*) AS pairs, sum(b)::BIGINT AS before_ids, sum(a)::BIGINT AS after_ids FROM p GROUP BY 1"""
_EMB = """e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label >= 5 AS after FROM embeddings),
d AS (SELECT a.vec_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS distance FROM e a JOIN e b ON a.after AND NOT b.after GROUP BY 1)"""
SQL["nn_distances"] = f"WITH {_EMB} SELECT vec_id, round(distance, 9) AS distance FROM d"
_P95 = "min(distance) FILTER (WHERE rn >= ceil(n * 0.95::DOUBLE))"
SQL["nn_heatmap"] = f"""WITH {_EMB}, r AS (SELECT distance, row_number() OVER (ORDER BY distance) AS rn, count(*) OVER () AS n FROM d),
g AS (SELECT sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS diagonal FROM e WHERE NOT after)
SELECT 'all' AS model_id, count(*) AS points, round(max(distance), 9) AS max_distance, round({_P95}, 9) AS p95_distance, round(avg(distance), 8) AS mean_distance, round(any_value(diagonal), 8) AS diagonal,
  round(max(distance) / any_value(diagonal), 8) AS normalized_max FROM r, g"""
SQL["nn_lines"] = f"""WITH {_N}, t AS (SELECT model_id, x, y, z, count(*) AS c FROM pt WHERE is_after GROUP BY ALL), f AS (SELECT DISTINCT model_id, x, y, z FROM pt WHERE NOT is_after),
d AS (SELECT t.model_id, t.x, t.y, t.z, any_value(c) AS c, min(sqrt((t.x - f.x) * (t.x - f.x) + (t.y - f.y) * (t.y - f.y) + (t.z - f.z) * (t.z - f.z))) AS distance FROM t JOIN f USING (model_id) GROUP BY 1, 2, 3, 4),
r AS (SELECT *, sum(c) OVER (PARTITION BY model_id ORDER BY distance) AS rn, sum(c) OVER (PARTITION BY model_id) AS n FROM d)
SELECT model_id, any_value(n)::BIGINT AS points, round(max(distance), 8) AS max_distance, round({_P95}, 8) AS p95_distance, round(sum(distance * c) / any_value(n), 7) AS mean_distance FROM r GROUP BY 1"""

# --- boreholes, versions, batches -----------------------------------------------------------

SQL["nested_borehole"] = """SELECT c_custkey AS BH_ID, 0::INTEGER AS part, count(o_orderkey)::INTEGER AS layers, coalesce(string_agg(left(o_orderpriority, 1), '' ORDER BY o_orderkey), '') AS stack,
  arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS water_level, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS water_type,
  arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS ucs FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"""
SQL["layer_cylinders"] = """SELECT o_custkey AS BH_ID, o_orderkey || '#' || o_orderpriority AS lithology, round(100.0::DOUBLE - (o_totalprice / 1000 + o_totalprice / 500) / 2, 6) AS z,
  round(o_totalprice / 500 - o_totalprice / 1000, 6) AS height, 0.8::DOUBLE AS radius FROM orders JOIN customer ON o_custkey = c_custkey"""
_VER = """o AS (SELECT *, left(o_orderpriority, 1) AS d, floor(o_totalprice / 50000)::BIGINT AS p FROM orders),
ver AS (SELECT printf('VER-%08d', o_orderkey) AS version_id, CASE WHEN o_orderstatus = 'P' THEN 'draft' || d ELSE 'V1.' || d || '.' || p END AS version_number, o_custkey::VARCHAR AS project_name,
  o_orderstatus AS module_name, o_orderpriority AS description, strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_totalprice, d, p, o_orderkey, o_orderstatus = 'F' AS archived FROM o)"""
SQL["version_numbers"] = f"""WITH {_VER}, t AS (SELECT project_name, max((1, d::BIGINT, p)) AS m FROM ver WHERE module_name <> 'P' GROUP BY 1)
SELECT project_name, 'V' || m[1] || '.' || m[2] || '.' || (m[3] + 1) AS next_number FROM t"""
SQL["version_latest"] = f"""WITH {_VER} SELECT project_name, arg_max(version_id, (created_at, version_id)) AS version_id, arg_max(version_number, (created_at, version_id)) AS version_number, count(*) AS total_versions FROM ver GROUP BY 1"""
SQL["version_stats"] = f"""WITH {_VER} SELECT module_name, count(*) AS total, count(*) FILTER (WHERE archived) AS archived, count(*) FILTER (WHERE o_totalprice > 250000) AS with_sources,
  count(*) FILTER (WHERE module_name <> 'P') AS with_quality, count(*) AS with_outputs FROM ver GROUP BY 1"""
SQL["version_resolution"] = f"""WITH {_VER}, used AS (SELECT DISTINCT module_name, version_number, d, p FROM ver),
asked AS (SELECT DISTINCT module_name, version_number, CASE WHEN module_name <> 'P' THEN d END AS d, CASE WHEN module_name <> 'P' THEN p END AS p FROM ver WHERE project_name <> '0')
SELECT a.module_name, a.version_number, CASE WHEN a.module_name = 'P' THEN a.version_number || '-2' ELSE 'V1.' || a.d || '.' || min(a.p + i) END AS assigned
FROM asked a, range(1, 100) t(i) WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.module_name = a.module_name AND u.version_number = 'V1.' || a.d || '.' || (a.p + i)) GROUP BY 1, 2, a.d"""
SQL["version_assignment"] = f"""WITH {_VER}, b AS (SELECT project_name, max((1, d::BIGINT, p)) AS m FROM ver WHERE NOT archived AND module_name <> 'P' GROUP BY 1),
n AS (SELECT project_name, o_orderkey AS row_id, row_number() OVER (PARTITION BY project_name ORDER BY o_orderkey) - 1 AS nth FROM ver WHERE archived)
SELECT row_id, CASE WHEN m IS NULL THEN 'V1.0.' || nth ELSE 'V1.' || m[2] || '.' || (m[3] + 1 + nth) END AS version_number FROM n LEFT JOIN b USING (project_name)"""
_fields = lambda: " UNION ALL ".join(
    f"SELECT id_a, id_b, '{name}' AS field, {expr.replace('#', 'a')} AS before, {expr.replace('#', 'b')} AS after FROM x" for name, expr in (
        ("version_number", "#.version_number"), ("module_name", "#.module_name"), ("description", "#.description"), ("created_by", "'x'"),
        ("quality_score", "CASE WHEN #.module_name <> 'P' THEN #.d ELSE '-' END"), ("quality_grade", "'-'"),
        ("data_sources", "CASE WHEN #.o_totalprice > 250000 THEN 'f' || #.d ELSE '' END"), ("output_files", "'out' || #.d"), ("tags", "#.module_name"),
        ("archived", "CASE WHEN #.archived THEN 'archived' ELSE 'not archived' END"), ("param_price", "floor(#.o_totalprice)::BIGINT::VARCHAR"),
    )
)
SQL["version_diff"] = f"""WITH {_VER}, r AS (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY created_at DESC, version_id DESC) AS rn FROM ver),
x AS (SELECT a.version_id AS id_a, b.version_id AS id_b, a, b FROM r a JOIN r b ON a.project_name = b.project_name AND a.rn = 2 AND b.rn = 1),
f AS ({_fields()} UNION ALL SELECT DISTINCT id_a, id_b, 'param_p' || k, CASE WHEN a.d = k THEN '1' ELSE '' END, CASE WHEN b.d = k THEN '1' ELSE '' END FROM (SELECT *, unnest([a.d, b.d]) AS k FROM x))
SELECT *, before <> after AS changed FROM f"""
SQL["parameter_diff"] = """WITH l AS (SELECT l_returnflag, l_suppkey, l_linenumber::VARCHAR AS name, sum(l_quantity)::BIGINT::VARCHAR AS value FROM lineitem GROUP BY ALL)
SELECT l_suppkey, name, coalesce(b.value, '') AS before, coalesce(a.value, '') AS after, coalesce(b.value, '') <> coalesce(a.value, '') AS changed
FROM (FROM l WHERE l_returnflag = 'A') b FULL JOIN (FROM l WHERE l_returnflag = 'R') a USING (l_suppkey, name)"""
SQL["version_lineage"] = f"""WITH {_VER} SELECT version_id, 'version ' || version_number || ' (' || version_id || ') | ' || CASE WHEN o_totalprice > 250000 THEN 'sources: f' || d || ' → ' ELSE '' END ||
  'params: price=' || floor(o_totalprice)::BIGINT || ', p' || d || '=1 → workflow: load → ' || CASE WHEN module_name <> 'P' THEN 'quality: ' || d || ' → ' ELSE '' END || 'outputs: out' || d AS trace_chain, 5::INTEGER AS phases FROM ver"""
SQL["import_skip_duplicates"] = """WITH e AS (SELECT user_id, event_type, ts::DATE AS day, event_id, ts >= TIMESTAMP '2024-01-11' AS late FROM events),
f AS (SELECT user_id, event_type, day, min(event_id) AS event_id FROM e WHERE late GROUP BY ALL)
SELECT event_type, count(*) AS imported, sum(event_id)::BIGINT AS ids FROM f ANTI JOIN (FROM e WHERE NOT late) USING (user_id, event_type, day) GROUP BY 1"""
_ITEM = """b AS (SELECT user_id AS job_id, event_type, (props->>'$.k')::INTEGER AS k FROM events),
i AS (SELECT job_id, CASE WHEN event_type = 'error' AND k > 80 THEN 'cancelled' WHEN event_type = 'error' AND k > 20 THEN 'failed' WHEN event_type = 'error' THEN 'skipped'
  WHEN event_type = 'view' AND k < 10 THEN 'unselected' ELSE 'success' END AS state, CASE WHEN event_type = 'error' THEN k ELSE 0 END AS retries FROM b),
j AS (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE state = 'success') AS success, count(*) FILTER (WHERE state = 'failed') AS failed,
  count(*) FILTER (WHERE state IN ('skipped', 'cancelled', 'unselected')) AS skipped, count(*) FILTER (WHERE state = 'cancelled') AS cancelled, sum(retries)::BIGINT AS retried,
  count(*) FILTER (WHERE state = 'skipped') AS policy FROM i GROUP BY 1),
js AS (SELECT job_id, total, success, failed, skipped, cancelled, retried, CASE WHEN cancelled > 0 AND failed > 0 THEN 'failed' WHEN failed = 0 AND policy + cancelled = 0 THEN 'completed'
  WHEN success > 0 THEN 'partial' ELSE 'failed' END AS status, round((total - cancelled) / total * 100, 4)::DOUBLE AS progress FROM j)"""
SQL["batch_status"] = f"WITH {_ITEM} SELECT * FROM js"
SQL["batch_summary"] = f"""WITH {_ITEM} SELECT count(*) AS total_jobs, sum(total)::BIGINT AS total_files, sum(success)::BIGINT AS total_success, sum(failed)::BIGINT AS total_failed, sum(skipped)::BIGINT AS total_skipped,
  sum(retried)::BIGINT AS total_retried, round(sum(success) / (sum(success) + sum(failed)), 4) AS success_rate FROM js"""
SQL["batch_status_counts"] = f"""WITH {_ITEM} SELECT count(*) AS total, 0::BIGINT AS queued, 0::BIGINT AS running, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status IN ('failed', 'partial')) AS failed, 0::BIGINT AS cancelled FROM js"""
SQL["template_outcomes"] = """SELECT CASE WHEN o_orderstatus = 'F' THEN 'applied' WHEN o_orderpriority = '5-LOW' THEN 'not_requested' ELSE 'failed' END AS status, count(*) AS items FROM orders GROUP BY 1"""
SQL["retryable"] = "SELECT value > 50 AS retryable, event_type, count(*) AS items FROM events GROUP BY 1, 2"
SQL["visible_logs"] = """SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'TRACE' ELSE 'WARNING' END AS level FROM events WHERE event_type <> 'view'"""
SQL["file_distribution"] = """WITH s AS (SELECT source AS category, count(*) AS count, sum(n_chars)::BIGINT AS size_bytes FROM documents GROUP BY 1)
SELECT *, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576)
  ELSE printf('%.2f GB', size_bytes / 1073741824) END AS size FROM s"""
SQL["file_names"] = r"""WITH f AS (SELECT page_id, split_part(regexp_replace(url, '[?#].*$', ''), '/', -1) AS name FROM pages)
SELECT page_id, lower(regexp_extract(name, '.(\.[^.]+)$', 1)) AS suffix, coalesce(nullif(trim(regexp_replace(name, '[^\p{L}\p{N}_-]', '_', 'g'), '_'), ''), 'file') AS stem,
  trim(regexp_replace(lower(regexp_replace(name, '(.)\.[^.]*$', '\1')), '[_\-\s]+', '_', 'g'), '_') AS pair_key FROM f"""
SQL["ratio_parsing"] = """SELECT l_returnflag, round(CASE l_returnflag WHEN 'A' THEN least(l_quantity / 100, 1) WHEN 'N' THEN l_discount ELSE 0.05 END, 6)::DOUBLE AS ratio, count(*) AS cells FROM lineitem GROUP BY 1, 2"""
SQL["text_entities"] = r"""WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)
SELECT tag, count(*) AS uses, count(DISTINCT page_id) AS pages FROM t GROUP BY 1"""
SQL["running_totals"] = """SELECT o_custkey, o_orderkey, o_orderstatus, (sum((o_orderstatus = 'F')::INTEGER) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS finished FROM orders"""
SQL["mesh_round_trip"] = f"""WITH {_C}, f AS (SELECT fid, count(*) AS n FROM c GROUP BY 1), s AS (SELECT (SELECT count(*) FROM part) AS vertex_count, count(*) AS face_count, sum(n - 2)::BIGINT AS triangle_count FROM f)
SELECT 'lineitem' AS model_id, k."check", true AS passed, s.* FROM (VALUES ('readable'), ('vertices'), ('bounds'), ('faces'), ('lines')) k("check"), s"""
SQL["stream_intake"] = "SELECT event_type, CASE WHEN value BETWEEN 0 AND 100 THEN 'good' ELSE 'dead' END AS state, count(*) AS rows FROM events GROUP BY 1, 2"
