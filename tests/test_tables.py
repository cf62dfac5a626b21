import math

import pytest
from pyspark.sql import functions as F

from terraloom import fixed_values as fv
from terraloom.functions.skew import join_by_weight
from terraloom.operators import cleaning, dedup, issues, profiling
from terraloom.plans import preprocessing, quality
from terraloom.sources import features, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def survey(spark):
    rows = [
        (2, "B1", "1250", "2.5", "30", "sand"), (3, "B1", "1250", "2.5", "30", "sand"), (4, "B2", "1300", "2.6", "45", "clay"), (5, "B3", "", "2.4", "60", "n/a"),
        (6, "B4", "1275", "2.5", "90", "sand"), (7, "B5", "1260", "bad", "30", "clay"),
    ]
    return frame(spark, rows, "_row_id bigint, id string, thickness_mm string, pressure_MPa string, dip_angle_deg string, soil string")


def test_profile_of_text_cells(spark):
    rows = [(i, c, t) for i, (c, t) in enumerate([("1", "a"), ("01", "b"), ("1.0", "nan"), ("x", ""), (None, " "), ("2", "a")])]
    p = {r["field"]: r for r in profiling.profile_fields(frame(spark, rows, "i bigint, c string, t string"), ["c", "t"], order_by="i").collect()}
    assert (p["c"]["missing"], p["c"]["unique"], p["c"]["duplicate_count"], p["c"]["dtype"]) == (1, 4, 1, "text")
    assert (p["c"]["min_val"], p["c"]["max_val"], p["c"]["mean_val"]) == (1.0, 2.0, 1.25)
    assert p["t"]["missing"] == 2 and p["t"]["min_val"] is None
    assert p["c"]["sample_values"] == ["1", "01", "1.0", "x", "2"]


def test_outliers_fall_back_to_the_deviation(spark):
    df = frame(spark, [(float(v),) for v in [5] * 20 + [50]], "v double")
    p = profiling.profile_fields(df, ["v"], 3.0).first()
    assert p["outlier_count"] == 1 and p["median"] == 5.0
    flat = profiling.profile_fields(frame(spark, [(5.0,)] * 4, "v double"), ["v"]).first()
    assert flat["outlier_count"] == 0


def test_dedup_keeps_the_first_row(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", i) for i in range(300)]
    df = frame(spark, rows, "id bigint, k string, v int").repartition(7)
    kept = {(r["k"], r["id"]) for r in dedup.keep_first(df, ["k"], ["id"]).collect()}
    assert ("hot", 1) in kept and len(kept) == 101
    plan = dedup.keep_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the hot key is cut before the shuffle
    assert dedup.duplicate_rows(df, ["k"]).first()["duplicate_count"] == 199
    assert {r["occurrences"] for r in dedup.duplicate_identifiers(df, "k", "id").collect()} == {200}


def test_cleaning_in_order(spark):
    df = survey(spark)
    plan = cleaning.plan_cleaning(df, "_row_id", sigma=3.0)
    out = {r["_row_id"]: r for r in cleaning.clean(df, plan, "_row_id").collect()}
    assert len(out) == 5 and plan.rows_in - plan.rows_out == 1
    assert set(out[2].asDict()) == {"_row_id", "id", "thickness_m", "pressure_Pa", "dip_angle_rad", "soil"}
    assert float(out[2]["thickness_m"]) == pytest.approx(1.25) and float(out[2]["pressure_Pa"]) == pytest.approx(2.5e6)
    assert float(out[5]["thickness_m"]) == pytest.approx(1.2675)          # median of 1250 1300 1275 1260
    assert out[5]["soil"] == "sand" and out[7]["pressure_Pa"] == "bad"    # mode by first seen; unreadable cells stay
    actions = {(r["action"], r["field"]): r["count"] for r in cleaning.cleaning_actions(df, plan).collect()}
    assert actions[("fill_missing", "thickness_mm")] == 1 and actions[("normalize_unit", "pressure_MPa")] == 4


def test_cleaning_is_idempotent_and_clips(spark):
    rows = [(i, float(v)) for i, v in enumerate([10, 11, 12, 13, 14, 15, 16, 500])]
    df = frame(spark, rows, "id bigint, v double")
    once = cleaning.clean(df, cleaning.plan_cleaning(df, "id"), "id")
    bound = 13.5 + 3 * 1.4826 * 2.0
    assert max(r["v"] for r in once.collect()) == pytest.approx(bound)
    twice = cleaning.clean(once, cleaning.plan_cleaning(once, "id"), "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_repeated_clip_without_mad(spark):
    values = [5.0] * 30 + [1000.0]
    df = frame(spark, list(enumerate(values)), "id bigint, v double")
    plan = cleaning.plan_cleaning(df, "id", deduplicate=False)
    current = list(values)
    for _ in range(20):  # by hand: median 5, sigma is the deviation
        mean = sum(current) / len(current)
        sd = math.sqrt(sum((x - mean) ** 2 for x in current) / len(current))
        low, high = 5 - 3 * sd, 5 + 3 * sd
        if sd <= 1e-12 or not any(x < low or x > high for x in current):
            break
        current = [max(low, min(high, x)) for x in current]
    got = {r["id"]: r["v"] for r in cleaning.clean(df, plan, "id").collect()}
    assert got[30] == pytest.approx(current[30])


def test_simple_cleaner(spark):
    df = frame(spark, [(1, "a", "1"), (2, "a", "1"), (3, "b", "n/a"), (4, "c ", "x")], "id bigint, k string, v string")
    out = cleaning.clean_simple(df, "id", fill_missing="0", sigma=0, unit_factors={"v": 10})
    assert [(r["id"], r["k"], r["v"]) for r in out.orderBy("id").collect()] == [(1, "a", "10.0"), (3, "b", "0.0"), (4, "c ", "x")]


def test_delimited_text(spark, write):
    path = write("t.csv", "﻿id,x,note\n1,2.5,a\n\n2,bad,\"b,c\"\n3,4,d,extra\n4,5\n")
    df = tables.read_delimited(spark, path)
    rows = {r["_row_id"]: r for r in df.collect()}
    assert df.columns == ["_row_id", "id", "x", "note", "_ragged"]
    assert rows[4]["note"] == "b,c" and rows[5]["_ragged"] and not rows[2]["_ragged"] and rows[6]["note"] is None


def test_split_files_keep_line_numbers(spark, write):
    from terraloom.sources.files import numbered_lines

    path = write("big.txt", "".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = numbered_lines(spark, path)
        assert got.rdd.getNumPartitions() >= 1
        assert all(r["value"] == f"line {r['line_no']}" for r in got.collect()) and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_coordinate_tables(spark):
    df = frame(spark, [(2, "1", "2", "", "a"), (3, "x", "2", "3", "b")], "_row_id bigint, `东坐标` string, `北坐标` string, `高程` string, soil string")
    with pytest.raises(Exception, match="bad coordinate"):
        tables.table_points(df).collect()
    only = tables.table_points(df, "skip", aliases=fv.CONVERTER_AXES).collect()
    assert [(r["row_id"], r["x"], r["y"], r["z"], r["props"]) for r in only] == [(2, 1.0, 2.0, 0.0, {"soil": "a"})]


GEOJSON = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "properties": {"name": "a", "depth_mm": 1500}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0, 1], [4, 0, 1], [4, 3, 1], [0, 3, 1]]]}},
 {"type": "Feature", "properties": {"name": "", "kind": "k"}, "geometry": {"type": "Point", "coordinates": [1000000000.0, 2]}},
 {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "GeometryCollection", "geometries": [
   {"type": "LineString", "coordinates": [[0, 0, 1], [4, 0, 1]]}, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}]}}]}"""


def test_features(spark, write):
    records = tables.read_json_records(spark, write("f.geojson", GEOJSON)).cache()
    assert records.count() == 3
    columns = tables.props_to_columns(records, with_point=True)
    assert set(columns.columns) >= {"name", "kind", "depth_mm", "longitude", "latitude"}
    rings = features.rings(features.geometries(records))
    checks = {(r["ordinal"], r["open"]) for r in features.ring_checks(rings).collect()}
    assert checks == {(0, True), (2, False)}
    vertices, corners, lines, vertex_props, face_props = features.model_tables(records)
    assert {r["fid"]: r["props"]["name"] for r in face_props.collect()} == {0: "a", 1: "a"} and vertex_props.first()["props"]["kind"] == "k"
    assert vertices.count() == 8 and {(r["fid"], r["pos"]) for r in corners.collect()} == {(0, i) for i in range(4)} | {(1, i) for i in range(3)}
    assert [r["vid"] for r in lines.orderBy("pos").collect()] == [0, 1]
    cleaned = {r["feature_id"]: r for r in cleaning.clean_features(features.cleaning_rows(records)).collect()}
    assert len(cleaned[0]["polygons"][0][0]) == 5
    assert cleaned[0]["props"] == {"depth_m": "1.5", "kind": "k", "name": "a"} and cleaned[1]["props"]["name"] == "a"


def test_feature_quality(spark, write):
    records = tables.read_json_records(spark, write("f.geojson", GEOJSON))
    rules = quality.QualityRules.of({"required_attributes": ["name"], "unknown": 1, "max_missing_ratio": 5})
    assert rules.max_missing_ratio == 1.0
    report = quality.quality_report(spark, quality.feature_quality_issues(records, rules), [quality.feature_coordinates(records)], rules)
    assert {r["code"] for r in report.issues.collect()} == {"OPEN_BOUNDARY", "MISSING_ATTRIBUTE", "INCONSISTENT_SCHEMA", "COORDINATE_RANGE"}


def test_table_quality(spark, write):
    text = "id,x,y,z,lithology,density\n1,1.0,2.0,3.0,sand,2.5\n1,bad,2.0,3.0,,2.6\n2,3.0,2.0,3.0,clay,dense\n3,3.0,2.0,3.0,clay,2.1,9\n"
    df = tables.read_delimited(spark, write("q.csv", text))
    rules = quality.QualityRules.of(required_attributes=["lithology", "owner"])
    report = quality.quality_report(spark, quality.table_quality_issues("q.csv", df, rules), [quality.table_coordinates("q.csv", df)], rules)
    rows = report.issues.collect()
    assert {r["code"] for r in rows} == {"MISSING_ATTRIBUTE", "INVALID_COORDINATE", "DUPLICATE_ID", "INCONSISTENT_SCHEMA"}
    assert sorted(r["issue_id"] for r in rows)[0] == "Q-0001" and not report.summary.first()["passed"]
    empty = quality.quality_report(spark, [], [], quality.QualityRules(check_coordinate=False))
    assert empty.summary.first()["grade"] == "pending"


def test_preprocessing_report_improves(spark):
    df = survey(spark)
    before, cleaned, after = preprocessing.clean_and_recheck({"s": df}, required_fields=["id", "owner"])
    codes = {r["category"] for r in before.issues.collect()}
    assert codes >= {"field_validation", "missing_values", "duplicates", "unit_normalization"}
    assert after.summary.first()["score"] > before.summary.first()["score"]
    assert before.frames["actions"].count() > 2 and cleaned["s"].count() == 5
    status = {r["category"]: r["status"] for r in before.categories.collect()}
    assert status["field_validation"] == "failed" and status["outliers"] in ("passed", "passed_with_notes", "review", "failed")


def test_texts_are_parsed_by_spelling(spark, monkeypatch):
    """Spellings are counted before they are parsed: the parser sees each of them once."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([" 1 ", "1", "01", "1.0", "word", " word", "NaN", "-Inf", "1_0", None, ""] * 3)], "_row_id long, t string")
    seen = []
    real = profiling.V.staged
    monkeypatch.setattr(profiling.V, "staged", lambda rows, cell: seen.append(rows) or real(rows, cell))
    got = {r["value"]: (r["n"], r["first_row"]) for r in profiling.value_frequencies(df, ["t"], "_row_id").collect()}
    assert got == {"1": (9, 0), "1.0": (3, 3), "word": (6, 4), "NaN": (3, 6), "-Infinity": (3, 7), "10": (3, 8)}
    assert seen[0].count() == 9
    assert [r["k"] for r in dedup.keep_first(df, ["t"], ["_row_id"]).select(F.col("_row_id").alias("k")).orderBy("k").collect()] == [0, 2, 3, 4, 6, 7, 8, 9]


def test_scores(spark):
    rows = [(1, "geometry", "A", "f", None, None, "critical", "m", ""), (2, "geometry", "B", "f", None, 4, "warning", "m2", "")]
    frame_ = spark.createDataFrame(rows, issues.ISSUE_SCHEMA)
    assert issues.score(frame_, fv.QUALITY_PENALTY).first()["score"] == 86
    total = {(r["category"], r["severity"]): r["penalty"] for r in issues.issue_rollup(frame_, fv.QUALITY_PENALTY).collect()}
    assert total[(None, None)] == 14 and total[("geometry", "warning")] == 4


def test_weighted_join_is_a_left_join(spark):
    rows = frame(spark, [(i, "hot" if i % 3 == 0 else f"k{i % 11}") for i in range(600)] + [(1000, None)], "i int, k string")
    lookup = rows.filter("k is not null and k <> 'k5'").groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.upper("k"))
    plain = sorted((r["i"], r["v"] or "") for r in rows.join(lookup.drop("w"), "k", "left").collect())
    for share in (5, 20_000):  # with and without hot keys
        got = join_by_weight(rows, lookup, ["k"], "w", 601, share)
        assert sorted((r["i"], r["v"] or "") for r in got.collect()) == plain


def test_partition_count_does_not_matter(spark):
    rows = [(i, float((i * 37) % 101), "ab"[i % 2]) for i in range(500)]
    seen = set()
    for n in (1, 8, 64):
        df = frame(spark, rows, "id bigint, v double, t string").repartition(n)
        p = profiling.profile_fields(df, ["v", "t"], 1.0, "id").orderBy("field").collect()
        seen.add(str(p))
    assert len(seen) == 1


def test_rows_without_an_entry_are_spread(spark):
    """A third of the keys blank and a third null: no partition of the join gets them all."""
    rows = frame(spark, [(i, "" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 50}") for i in range(3_000)], "i int, k string")
    lookup = frame(spark, [(f"k{j}", 20, j) for j in range(50)], "k string, w int, v int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "20", "-1"), strict=True):
            spark.conf.set(k, v)
        got = join_by_weight(rows, lookup, ["k"], "w", 1_000, 5, F.col("k") == "").withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 3_000 and all((r["v"] is None) == (r["k"] in ("", None)) for r in got)
    sizes = {}
    for r in got:
        sizes[r["p"]] = sizes.get(r["p"], 0) + 1
    assert max(sizes.values()) < 600
