"""DuckDB counterparts of ``queries_space``."""

SQL: dict[str, str] = {}

_P = """p AS (SELECT l_returnflag AS model, l_orderkey * 8 + l_linenumber AS id, l_quantity::DOUBLE AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax, 's' || (l_suppkey % 7) AS maker FROM lineitem)"""
SQL["attribute_idw"] = f"""WITH {_P}, t AS (SELECT p_partkey, model, p_size::DOUBLE AS x, p_retailprice / 20 AS y, (p_partkey % 11)::DOUBLE AS z FROM part, (VALUES ('A'), ('N'), ('R')) v(model)),
n AS (SELECT p_partkey, t.model, l_tax, CASE WHEN id % 2 = 0 THEN l_tax END AS even_tax, (t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y) + (t.z - p.z) * (t.z - p.z) AS d2
  FROM t JOIN p ON p.model = t.model AND p.x BETWEEN t.x - 2 AND t.x + 2 AND (t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y) + (t.z - p.z) * (t.z - p.z) <= 4),
a AS (SELECT p_partkey, model, count(*) AS samples, sqrt(min(d2)) AS nearest,
  coalesce(avg(l_tax) FILTER (WHERE d2 = 0), sum(l_tax / d2) FILTER (WHERE d2 > 0) / sum(1 / d2) FILTER (WHERE d2 > 0)) AS l_tax,
  coalesce(avg(even_tax) FILTER (WHERE d2 = 0), sum(even_tax / d2) FILTER (WHERE d2 > 0) / sum(1 / d2) FILTER (WHERE d2 > 0 AND even_tax IS NOT NULL)) AS even_tax FROM n GROUP BY 1, 2)
SELECT p_partkey, model, coalesce(samples, 0) AS samples, round(nearest, 6) AS nearest, round(l_tax, 6) AS l_tax, round(even_tax, 6) AS even_tax,
  CASE WHEN samples IS NULL THEN 'none' WHEN nearest = 0 THEN 'exact' ELSE 'inverse_distance' END AS method FROM t LEFT JOIN a USING (p_partkey, model)"""

_D = lambda a: f"((floor({a} / 4) + 0.5) * 4 - {a})"
SQL["point_thinning"] = f"""WITH {_P} SELECT model, id FROM p QUALIFY row_number() OVER (PARTITION BY model, floor(x / 4), floor(y / 4), floor(z / 4)
  ORDER BY {_D('x')} * {_D('x')} + {_D('y')} * {_D('y')} + {_D('z')} * {_D('z')}, id) = 1"""
SQL["point_thinning_first"] = f"WITH {_P} SELECT model, id FROM p QUALIFY row_number() OVER (PARTITION BY model, floor(x / 9), floor(y / 9), floor(z / 9) ORDER BY id) = 1"


def _voxels(size: int) -> str:
    cell = ", ".join(f"floor({a} / {size})::BIGINT AS i{a}" for a in "xyz")
    return f"""{_P}, c AS (SELECT *, {cell} FROM p), k AS (SELECT model, ix, iy, iz, maker, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT model, ix, iy, iz, maker AS mode_maker FROM k QUALIFY row_number() OVER (PARTITION BY model, ix, iy, iz ORDER BY n DESC, maker) = 1),
v AS (SELECT model, ix, iy, iz, count(*) AS points, avg(l_tax) AS mean_l_tax FROM c GROUP BY ALL)"""


for _name, _size in (("voxel_table", 5), ("voxel_coarse", 15)):
    SQL[_name] = f"WITH {_voxels(_size)} SELECT model, ix, iy, iz, points, round(mean_l_tax, 9) AS mean_l_tax, mode_maker FROM v JOIN m USING (model, ix, iy, iz)"
_EDGES = ", ".join(f"min(i{a}) AS lo_i{a}, max(i{a}) AS hi_i{a}, min(i{a}) * 5.0::DOUBLE AS lo_{a}, (max(i{a}) + 1) * 5.0::DOUBLE AS hi_{a}" for a in "xyz")
SQL["voxel_index"] = f"""WITH {_voxels(5)} SELECT model, count(*) AS voxels, sum(points)::BIGINT AS points, {_EDGES},
  round(count(*) / ((max(ix) - min(ix) + 1)::DOUBLE * (max(iy) - min(iy) + 1) * (max(iz) - min(iz) + 1)), 6) AS occupancy FROM v GROUP BY 1"""
SQL["voxel_fill"] = f"""WITH {_voxels(5)}, b AS (SELECT model, min(ix) AS a1, max(ix) AS a2, min(iy) AS b1, max(iy) AS b2, min(iz) AS c1, max(iz) AS c2 FROM v GROUP BY 1),
d AS (SELECT i.i AS di, j.i AS dj, k.i AS dk FROM (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(i), (VALUES (-1), (0), (1)) k(i)),
n AS (SELECT model, ix + di AS ix, iy + dj AS iy, iz + dk AS iz, avg(mean_l_tax) AS mean_l_tax FROM v, d GROUP BY ALL)
SELECT model, ix, iy, iz, round(mean_l_tax, 9) AS mean_l_tax, 0 AS filled FROM v
UNION ALL SELECT model, ix, iy, iz, round(mean_l_tax, 9), 1 FROM n JOIN b USING (model)
WHERE ix BETWEEN a1 AND a2 AND iy BETWEEN b1 AND b2 AND iz BETWEEN c1 AND c2 AND NOT EXISTS (SELECT 1 FROM v WHERE v.model = n.model AND v.ix = n.ix AND v.iy = n.iy AND v.iz = n.iz)"""


def _clip() -> str:
    """Corner rows cut plane by plane: each keeps the corners inside and adds the crossings of the edges that start at them."""
    out = [r"""c0 AS (SELECT l_orderkey AS fid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, p_partkey AS vid, p_size::DOUBLE AS x,
  regexp_extract(p_brand, '(\d+)', 1)::DOUBLE AS y, p_retailprice AS z FROM lineitem JOIN part ON p_partkey = l_partkey QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 3)"""]
    planes = [("x", 8.0, ">="), ("x", 42.0, "<="), ("y", 14.0, ">="), ("y", 47.0, "<="), ("z", 950.0, ">="), ("z", 1500.0, "<=")]
    for k, (axis, at, op) in enumerate(planes, 1):
        first = "ROW(x, y, z) <= ROW(nx, ny, nz)"
        share = f"(CASE WHEN {first} THEN ({at} - {axis}) / (n{axis} - {axis}) ELSE ({at} - n{axis}) / ({axis} - n{axis}) END)"
        cross = ", ".join(f"{at}::DOUBLE" if a == axis else f"CASE WHEN {first} THEN {a} + (n{a} - {a}) * {share} ELSE n{a} + ({a} - n{a}) * {share} END" for a in "xyz")
        follow = ", ".join(f"coalesce(lead({a}) OVER w, first_value({a}) OVER w) AS n{a}" for a in "xyz")
        out.append(f"n{k} AS (SELECT *, {follow} FROM c{k - 1} WINDOW w AS (PARTITION BY fid ORDER BY pos))")
        out.append(f"""c{k} AS (SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY pos, half) AS pos, vid, x, y, z FROM (
  SELECT fid, pos, 0 AS half, vid, x, y, z FROM n{k} WHERE {axis} {op} {at}
  UNION ALL SELECT fid, pos, 1, NULL, {cross} FROM n{k} WHERE ({axis} {op} {at}) <> (n{axis} {op} {at}))
  QUALIFY count(*) OVER (PARTITION BY fid) >= 3)""")
    follow = ", ".join(f"coalesce(lead({a}) OVER w, first_value({a}) OVER w) AS n{a}" for a in "xyz")
    out.append(f"""e AS (SELECT * FROM (SELECT *, {follow} FROM c6 WINDOW w AS (PARTITION BY fid ORDER BY pos)) WHERE x <> nx OR y <> ny OR z <> nz QUALIFY count(*) OVER (PARTITION BY fid) >= 3)""")
    return ",\n".join(out)


SQL["box_clip"] = f"""WITH {_clip()},
r AS (SELECT fid, x - fx AS x, y - fy AS y, z - fz AS z, coalesce(lead(x) OVER w, fx) - fx AS nx, coalesce(lead(y) OVER w, fy) - fy AS ny, coalesce(lead(z) OVER w, fz) - fz AS nz
  FROM (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, first_value(z) OVER w AS fz FROM e WINDOW w AS (PARTITION BY fid ORDER BY pos)) WINDOW w AS (PARTITION BY fid ORDER BY pos)),
s AS (SELECT fid, count(*) AS corners, sum(y * nz - z * ny) / 2 AS a, sum(z * nx - x * nz) / 2 AS b, sum(x * ny - y * nx) / 2 AS c FROM r GROUP BY 1)
SELECT fid, corners::INTEGER AS corners, round(sqrt(a * a + b * b + c * c), 3) AS area FROM s"""
SQL["box_clip_mesh"] = f"""WITH {_clip()}, u AS (SELECT vid, x, y, z, count(*) AS uses FROM e GROUP BY ALL)
SELECT vid IS NULL AS is_new, uses, count(*) AS vertices, round(sum(x + y + z), 2) AS sum_xyz FROM u GROUP BY 1, 2"""
