import struct

from pyspark.sql import functions as F

from terraloom.functions.ordering import group_index
from terraloom.operators import batch
from terraloom.plans import conversion
from terraloom.sources import features, files, manifests, meshes, tables


def test_files_with_other_headers_are_aligned_by_name(spark, write, folder):
    write("c/a.csv", "id,x\n1,5\n2,6\n")
    write("c/b.csv", "x,id,extra\n7,3,e\n8,4,f,too many\n")
    write("c/c.csv", "id,x\n9,1,1\n")
    rows = {r["id"]: (r["x"], r["extra"], r["_ragged"]) for r in tables.read_delimited(spark, f"{folder}/c/*.csv").collect()}
    assert rows == {"1": ("5", None, False), "2": ("6", None, False), "3": ("7", "e", False), "4": ("8", "f", True), "9": ("1", None, True)}


def test_quoted_cells_hold_line_breaks(spark, write):
    text = 'id,note,z\n1,"first\nsecond ""quoted""\n\nlast",a\n2,plain,b\n3,"x\ny",c\n4,"one, ""two""",d\n'
    rows = {r["id"]: r for r in tables.read_delimited(spark, write("q.csv", text)).collect()}
    assert {k: (r["note"], r["z"]) for k, r in rows.items()} == {
        "1": ('first\nsecond "quoted"\n\nlast', "a"), "2": ("plain", "b"), "3": ("x\ny", "c"), "4": ('one, "two"', "d"),
    }
    assert [rows[k]["_row_id"] for k in "1234"] == [2, 6, 7, 9]


def test_quotes_inside_plain_cells_open_nothing(spark, write):
    text = 'id,note,z\n1,5" pipe,x\n2,plain,b\n3,"a\n6"" b\n,""c",d\n4,2\' 3" tall,y\n5,"""q"",\nr",e\n6,"full","f"\n'
    rows = {r["id"]: (r["note"], r["z"], r["_row_id"], r["_ragged"]) for r in tables.read_delimited(spark, write("q.csv", text)).collect()}
    assert rows == {
        "1": ('5" pipe', "x", 2, False), "2": ("plain", "b", 3, False), "3": ('a\n6" b\n,"c', "d", 4, False), "4": ('2\' 3" tall', "y", 7, False),
        "5": ('"q",\nr', "e", 8, False), "6": ("full", "f", 10, False),
    }


def test_a_cell_that_never_closes_is_reported_and_swallows_no_rows(spark, write):
    text = 'id,note\n1,a\n2,"stray\n' + "".join(f"{k},b\n" for k in range(3, 40))
    rows = {r["id"]: (r["_row_id"], r["_ragged"]) for r in tables.read_delimited(spark, write("q.csv", text)).collect()}
    assert rows == {str(k): (k + 1, k == 2) for k in range(1, 40)}


def test_collections_of_any_depth(spark, write):
    inner = '{"type": "Point", "coordinates": [1, 2]}'
    for _ in range(6):
        inner = '{"type": "GeometryCollection", "geometries": [%s, {"type": "Point", "coordinates": [3, 4]}]}' % inner
    records = tables.read_json_records(spark, write("deep.geojson", '{"type": "Feature", "properties": {}, "geometry": %s}' % inner))
    assert features.geometries(records).count() == 7


def test_every_key_comes_back_from_retries(spark):
    items = spark.createDataFrame([(i,) for i in range(3)], "file_id int")
    attempt = lambda df, number: df.select("file_id", (F.col("file_id") == 0).alias("ok"), F.lit("读取 failed").alias("error"))
    for retries, last in ((-1, 0), (0, 0), (2, 2), (21, 21)):
        got = {r["file_id"]: (r["state"], r["retries"]) for r in batch.run_with_retry(items, attempt, retries).collect()}
        assert got == {0: ("success", 0), 1: ("failed", last), 2: ("failed", last)}


def test_cancelled_and_unselected_items(spark):
    rows = [("a", "success"), ("a", "cancelled"), ("b", "success"), ("b", "unselected"), ("c", "cancelled"), ("c", "failed")]
    jobs = batch.job_status(spark.createDataFrame([(j, s, 0) for j, s in rows], "job_id string, state string, retries int"))
    got = {r["job_id"]: (r["status"], r["skipped"]) for r in jobs.collect()}
    assert got == {"a": ("partial", 1), "b": ("completed", 1), "c": ("failed", 1)}


def test_scan_has_no_hidden_cap(spark, write, folder):
    for i in range(510):
        write(f"many/f{i}.csv", "1")
    assert files.scan_directories(spark, [f"{folder}/many"]).count() == 510
    assert files.scan_directories(spark, [f"{folder}/many"], max_files=7).count() == 7


def test_manifest_paths_are_folded(spark):
    df = spark.createDataFrame([("file:///a/b", "../x/./a.csv"), ("/a", "b//c/../d"), ("/a", "/abs/../kept"), ("/a", "../../../up"), ("/a", "")], "f string, p string")
    got = [r[0] for r in df.select(manifests._join_path(F.col("f"), F.col("p"))).collect()]
    assert got == ["file:///a/x/a.csv", "/a/b/d", "/abs/../kept", "/up", ""]


FACETS = [((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (0, 1, 0))]


def test_corpus_of_both_kinds_of_stl(spark, write, folder):
    body = b"".join(struct.pack("<12fH", 0, 0, 1, *[float(v) for p in f for v in p], 0) for f in FACETS)
    write("stl/b.stl", b"\0" * 80 + struct.pack("<I", len(FACETS)) + body)
    text = "".join("facet normal 0 0 1\nouter loop\n" + "".join(f"vertex {x} {y} {z}\n" for x, y, z in f) + "endloop\nendfacet\n" for f in FACETS)
    write("stl/a.stl", f"solid a\n{text}endsolid a\n")
    models = conversion.read_models(spark, ".stl", f"{folder}/stl")
    assert sorted((r["model_id"][-5:], r["n"]) for r in models.faces.groupBy("model_id").agg(F.count("*").alias("n")).collect()) == [("a.stl", 2), ("b.stl", 2)]
    assert {r["count"] for r in models.vertices.groupBy("model_id").count().collect()} == {4}


def test_corpus_of_coordinate_tables(spark, write, folder):
    for i in range(5):
        write(f"pts/{i}.csv", f"x,y,z,soil\n{i},0,1,sand\n\n{i},1,1,clay\n")
    models = conversion.read_models(spark, ".csv", f"{folder}/pts/*.csv")
    assert models.vertices.count() == 10 and {r["vid"] for r in models.vertices.collect()} == {0, 1}
    done = conversion.convert(models, "csv", f"{folder}/out")
    assert done.summary.first()["state"] == "completed"
    back = spark.read.option("header", "true").csv(f"{folder}/out")
    assert {(r["vertex_id"], r["soil"]) for r in back.collect()} == {("1", "sand"), ("2", "clay")}


def test_feature_attributes_reach_the_sidecar(spark, write, folder):
    text = '{"type": "Feature", "properties": {"kind": "pit"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 0]]]}}'
    models = conversion.read_models(spark, ".geojson", write("g/one.geojson", text))
    done = conversion.convert(models, "obj", f"{folder}/obj")
    assert done.status.first()["losses"] == 1
    assert [(r["owner"], r["props"]) for r in spark.read.parquet(f"{folder}/obj_attributes").collect()] == [("face", {"kind": "pit"})]


def test_folder_parts_are_ordered_by_number(spark, write, folder):
    for n in (2, 10, 99999, 100000):
        write(f"parts/part-{n:05d}-x.txt", f"line {n}\n")
    got = [r["value"] for r in files.numbered_lines(spark, f"{folder}/parts/*", by_folder=True).orderBy("line_no").collect()]
    assert got == ["line 2", "line 10", "line 99999", "line 100000"]


def test_group_index_with_and_without_heavy_groups(spark):
    rows = spark.createDataFrame([(i * 3, None if i % 11 == 0 else "hot" if i % 2 else f"k{i % 7}") for i in range(300)], "id bigint, k string")
    want = {}
    for r in sorted(rows.collect()):
        want.setdefault(r["k"], []).append(r["id"])
    for heavy in (10, 60, 1000):
        got = {}
        for r in group_index(rows, ["k"], "id", "n", heavy=heavy, bits=4).orderBy("n").collect():
            assert r["n"] == len(got.setdefault(r["k"], []))
            got[r["k"]].append(r["id"])
        assert got == want


def test_registered_queries_with_whole_stage_codegen(spark):
    """The fixture turns code generation off to save time; production runs with it."""
    from bindings.queries_more import QUERIES

    order = lambda df: sorted(map(str, df.collect()))
    for name in ("dedup_keep_first", "normalise_table_hot", "mesh_edges", "batch_status", "nested_borehole", "location_samples", "feature_models"):
        plain = order(QUERIES[name](spark, "/root/testdata/sf0.001"))
        spark.conf.set("spark.sql.codegen.wholeStage", "true")
        try:
            assert order(QUERIES[name](spark, "/root/testdata/sf0.001")) == plain
        finally:
            spark.conf.set("spark.sql.codegen.wholeStage", "false")


def _same_as_sql(spark, folder, name, **columns):
    """Rows of a registered query over small tables, and of its SQL in DuckDB; both sorted."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    con = duckdb.connect()
    for t, (rows, schema) in columns.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as from read_parquet('{folder}/{t}.parquet/*.parquet')")
    sql = con.execute(oracle_sql()[name])
    names = [d[0] for d in sql.description]
    return sorted((tuple(r[n] for n in names) for r in queries()[name](spark, folder).collect()), key=str), sorted(sql.fetchall(), key=str)


def test_blank_texts_are_not_missing_in_profile_missing(spark, folder):
    texts = ["a", "", " ", None, "　\n", "b", "c", "d"]
    documents = [(i, t, None if i == 1 else "" if i % 2 else "en") for i, t in enumerate(texts)]
    got, want = _same_as_sql(
        spark, folder, "profile_missing", documents=(documents, "doc_id bigint, text string, lang string"),
        labels=([(0, 1, None), (2, 0, 1)], "doc_id bigint, quality bigint, toxic bigint"),
    )
    assert got == want and [r[:3] for r in want] == [("lang", 8, 1), ("quality", 8, 6), ("text", 8, 1), ("toxic", 8, 7)]


def test_shares_are_rounded_as_sql_does(spark, folder):
    documents = [(i, "t", "en" if i >= 41 else None) for i in range(640)]
    got, want = _same_as_sql(
        spark, folder, "profile_missing", documents=(documents, "doc_id bigint, text string, lang string"),
        labels=([(i, 1, 1) for i in range(630)], "doc_id bigint, quality bigint, toxic bigint"),
    )
    assert got == want and want[0] == ("lang", 640, 41, 0.064062, None)


ODD_TEXTS = [
    "plain", "", None, " ", "\n", "a\rb", "a\r\nb", "a\r", "\r", "\r\n\r\n", "x\n\r\ny\r", '"\r"', 'say "x",\ry', 'a,"b\nc",d', "back\\", '\\"x\\', "nul\0in", "\0", '\0"',
    "﻿bom", "x y\x85z", "null", "  lead\n \ntrail  ", ',\n",', "#c", '""', 'doc_id,"text"', "'q'\n'",
]


def test_odd_texts_come_back_from_csv_documents(spark, folder):
    got, want = _same_as_sql(spark, folder, "csv_documents", documents=(list(enumerate(ODD_TEXTS)), "doc_id bigint, text string"))
    assert got == want and len(want) == len(ODD_TEXTS)


def test_quoted_cells_keep_their_line_ends_and_empty_texts(spark, write, folder):
    write("e/crlf.csv", 'id,note\r\n1,"a\r\nb\rc\nd\r"\r\n2,""\r\n3,\r\n')
    write("e/cr.csv", 'id,note\r4,"a\rb"\r5,x\r\r6,"\r"')
    write("e/lf.csv", 'id,note\n7,"a\n\nb"\n8,"nul\0"\n')
    rows = {r["id"]: (r["note"], r["_row_id"], r["_ragged"]) for r in tables.read_delimited(spark, f"{folder}/e/*.csv").collect()}
    assert rows == {
        "1": ("a\r\nb\rc\nd\r", 2, False), "2": ("", 7, False), "3": (None, 8, False), "4": ("a\rb", 2, False), "5": ("x", 4, False), "6": ("\r", 6, False),
        "7": ("a\n\nb", 2, False), "8": ("nul\0", 5, False),
    }


def test_line_ends_in_small_splits_and_in_files_without_line_feeds(spark, write, folder, monkeypatch):
    ends = ["\n", "\r\n", "\r"]
    lines = [("x" * (i % 40), ends[(i * i) % 3]) for i in range(3000)]
    write("s/mixed.txt", "".join(v + e for v, e in lines) + "last")
    write("s/back.txt", "".join(f"line {i}\r" for i in range(1000)))
    want, old = [*lines, ("last", "\n")], spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(files, "LONGEST", 2000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = files.numbered_lines(spark, f"{folder}/s/*.txt", keep_ends=True).orderBy("line_no")
        assert [(r["value"], r["end"]) for r in df.filter(F.endswith("file", F.lit("mixed.txt"))).collect()] == want
        back = df.filter(F.endswith("file", F.lit("back.txt"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["line_no"], r["value"]) for r in back] == [(i + 1, f"line {i}") for i in range(1000)]
    assert {r["end"] for r in back} == {"\n"}  # longer than LONGEST: read at its carriage returns, never held whole
