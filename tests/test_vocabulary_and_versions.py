import json
import random

import pytest
from pyspark.sql import functions as F

from terraloom import fixed_values as fv
from terraloom.operators import batch, borehole, semantic as S, templates as T, versions as R
from terraloom.plans import batching, vocabulary
from terraloom.sources import byte_ranges, files, manifests
from terraloom.streaming import intake

ROWS = [
    {"domain": "岩性", "canonical": "砂岩", "aliases": ["Sandstone"], "codes": {"PROJECT": "LIT-S", "SYMBOL": "S"}},
    {"domain": "岩性", "canonical": "石英砂岩", "aliases": [], "codes": {"PROJECT": "LIT-QS"}},
    {"domain": "岩性", "canonical": "泥岩", "aliases": ["Mudstone", "软岩"], "codes": {"PROJECT": "LIT-M", "SYMBOL": "M"}, "relations": [{"type": "overlies", "target": "砂岩"}]},
    {"domain": "岩性", "canonical": "页岩", "aliases": ["软岩"], "codes": {"PROJECT": "LIT-SH"}},
    {"domain": "围岩等级", "canonical": "I级围岩", "aliases": ["Ⅰ级围岩"], "codes": {"PROJECT": "RC-I"}},
    {"domain": "地层", "canonical": "第四系", "aliases": ["Q"], "codes": {"SYMBOL": "Q"}},
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return S.dictionary_from_rows(spark, ROWS).cache()


def match(spark, dictionary, terms, strategy="prefer_canonical"):
    df = spark.createDataFrame(terms, "domain string, raw string")
    return {r["raw"]: r for r in S.attach_entries(S.match_terms(df, S.term_index(dictionary), strategy), dictionary).collect()}


def test_matching(spark, dictionary):
    rock = [("岩性", t) for t in ("砂 岩", "ＳＡＮＤＳＴＯＮＥ", "lit-m", "软岩", "石英砂岩夹泥岩", "花岗岩", "泥岩和砂岩")]
    got = match(spark, dictionary, [*rock, ("围岩等级", "VII级围岩"), ("围岩等级", "Ⅰ级围岩")])
    assert (got["砂 岩"]["confidence"], got["ＳＡＮＤＳＴＯＮＥ"]["matched_by"], got["lit-m"]["matched_by"]) == (1.0, "alias", "code:PROJECT")
    assert got["软岩"]["candidates"] == ["泥岩", "页岩"] and got["软岩"]["confidence"] == pytest.approx(0.8)
    assert got["石英砂岩夹泥岩"]["canonical"] == "石英砂岩；泥岩" and got["石英砂岩夹泥岩"]["project_code"] == "LIT-QS|LIT-M"
    assert got["泥岩和砂岩"]["matched_terms"] == ["泥岩", "砂岩"]
    assert got["花岗岩"]["confidence"] == 0 and got["花岗岩"]["project_code"] == ""
    assert got["VII级围岩"]["confidence"] == 0 and got["Ⅰ级围岩"]["canonical"] == "I级围岩"
    assert match(spark, dictionary, rock, "longest")["石英砂岩夹泥岩"]["canonical"] == "石英砂岩"
    kept = match(spark, dictionary, rock, "keep_original")
    assert kept["软岩"]["confidence"] == 0 and kept["石英砂岩夹泥岩"]["matched_by"] == "none"


def test_composites_equal_the_greedy_choice(spark):
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(14)})
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 12))) for _ in range(80)} - set(words))
    d = S.dictionary_from_rows(spark, [{"domain": "岩性", "canonical": w, "aliases": [], "codes": {}} for w in words])
    got = match(spark, d, [("岩性", t) for t in terms])
    for t in terms:  # longest first, spans inside a chosen span skipped
        spans = sorted((-len(w), t.find(w), w) for w in words if w in t)
        chosen = []
        for n, start, w in spans:
            if not any(start >= s and start - n <= e for s, e, _ in chosen):
                chosen.append((start, start - n, w))
        assert got[t]["matched_terms"] == [w for _, _, w in sorted(chosen)]


def test_vocabulary_report(spark, dictionary):
    extra = spark.createDataFrame([("岩性", "花岗岩", "granite|G1", "LIT-G")], "`语义域` string, `规范名` string, `别名` string, `项目编码` string")
    data = spark.createDataFrame(
        [(2, "砂岩", "Granite", "x"), (3, "软岩", "无", "y"), (4, "怪石", "砂岩", "z")], "_row_id bigint, `岩性` string, c2 string, `备注` string"
    )
    report, out = vocabulary.vocabulary_report({"dict": extra, "data": data}, dictionary, field_domains={"c2": "lithology"})
    rows = {r["_row_id"]: r for r in out["data"].collect()}
    assert rows[2]["c2_project_code"] == "LIT-G" and rows[3]["岩性_canonical"] == "软岩" and rows[3]["岩性_project_code"] == "" and rows[3]["c2_canonical"] is None
    assert {r["raw"] for r in report.frames["unmapped"].collect()} == {"怪石"} and report.frames["conflicts"].count() == 1
    assert report.summary.first()["coverage"] == 0.8 and report.issues.count() == 1
    assert S.field_domain("主要岩性") == "岩性" and S.field_domain("指标值") is None and S.field_domain("RockClass") == "围岩等级"


def test_dictionaries(spark, dictionary, write):
    audit = {(r["problem"], r["token"]) for r in S.audit_dictionary(dictionary).collect()}
    assert ("alias_conflict", "软岩") in audit and ("missing_project_code", "") in audit
    codes = spark.createDataFrame([("岩性", "lit-s"), ("岩性", "none")], "domain string, value string")
    got = {r["value"]: r for r in S.translate_codes(codes, dictionary, "PROJECT", "SYMBOL").collect()}
    assert got["lit-s"]["mapped_value"] == "S" and got["none"]["mapped_value"] == "none"
    library = {"domains": {"rock": {"砂岩": {"aliases": ["ss", " "], "gb_code": "9"}, "泥岩": {"aliases": "a|b，c"}}, "bogus": {"x": {}}}}
    read = {r["canonical"]: r for r in manifests.read_dictionary_library(spark, write("lib.json", json.dumps(library, ensure_ascii=False))).collect()}
    assert read["砂岩"]["codes"] == {"PROJECT": "9"} and read["砂岩"]["aliases"] == ["ss"] and read["泥岩"]["aliases"] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        manifests.read_dictionary_library(spark, write("none.json", "{}"))


POINTS = T.RuleTemplate(
    name="points", input_formats=["CSV"], data_source="点云数据",
    field_mappings=[T.FieldMapping("X坐标", "x", ["X"], "float", "float(value)", True), T.FieldMapping("分类", "class", ["Class"], "integer", "int(value)"), T.FieldMapping("编号", "id")],
    coordinate_rule=T.CoordinateRule(offset_x=1, scale_factor=2, precision=3),
    attribute_mappings=[T.ValueMap("class", "class_name", {"2": "ground", "9": "water"}, "other")],
    quality_check_rule=T.QualityRule(required_fields=["x"], unique_fields=["id"], numeric_ranges={"x": [0, 10]}, max_missing_ratio=0.2),
)


def test_template_application(spark):
    df = spark.createDataFrame([(1, "1.0004", "2", "a"), (2, "--", "9.5", "a"), (3, "7", "9", None)], "row_id bigint, x string, class string, `编号` string")
    done = T.apply_template(df, POINTS, "row_id")
    rows = {r["row_id"]: r for r in done.rows.collect()}
    assert (rows[1]["x"], rows[1]["class_name"], rows[2]["x"], rows[2]["class_name"], rows[3]["class_name"]) == (3.001, "ground", None, "other", "water")
    assert {(r["row_id"], r["problem"]) for r in done.problems.collect()} == {(2, "missing_required"), (2, "transform_failed")}
    checks = {(r["check"], r["field"]): r["severity"] for r in T.check_constraints(done.rows.select("x", "class", "id"), POINTS.quality_check_rule).collect()}
    assert checks[("missing", "x")] == "error" and checks[("unique", "id")] == "error" and checks[("range", "x")] == "warning" and checks[("missing", "id")] == "warning"
    assert batching.apply_in_batch(df, ".csv", POINTS, "row_id").status == "failed"
    assert batching.apply_in_batch(df, ".obj", POINTS, "row_id").status == "skipped" and batching.apply_in_batch(df, ".csv", None).status == "not_requested"
    good = df.filter("row_id <> 2")
    assert batching.apply_in_batch(good, ".csv", POINTS, "row_id").status == "applied"


def test_template_catalogue(spark, write, folder):
    bad = T.RuleTemplate("", project_type="?", quality_check_rule=T.QualityRule(max_missing_ratio=2))
    assert len(T.catalogue(spark, [bad]).first()["errors"]) == 3
    loaded = T.RuleTemplate.from_dict({**json.loads(POINTS.to_json()), "surprise": 1, "field_mappings": [{"source_field": "a", "target_field": "b", "odd": 2}]})
    assert loaded.field_mappings[0].target_field == "b"
    write("t/points.json", POINTS.to_json())
    write("t/template_index.json", "{}")
    assert T.fingerprint(T.load_templates(spark, f"{folder}/t")[0]) == T.fingerprint(POINTS)
    twin = T.duplicate_template(POINTS, "points 2")
    table = T.catalogue(spark, [POINTS, twin])
    assert T.list_templates(table, data_source="点云数据", tag=None).count() == 2 and T.list_templates(table, tag="x").count() == 0
    with pytest.raises(ValueError):
        T.save_templates(table, T.catalogue(spark, [bad]))
    assert T.save_templates(table, T.catalogue(spark, [POINTS])).count() == 2 and T.delete_templates(table, ["points"], ["points"]).count() == 2
    inputs = spark.createDataFrame([("a/点云.csv", "点云 intensity classification"), ("b.txt", "nothing")], "path string, text string")
    headers = spark.createDataFrame([("x",), (" class ",)], "header string")
    report = batching.template_report(inputs, headers, table)
    best = report["best"].first()
    assert (best["name"], best["score"]) == ("points 2", 25 + 10 + 13 + 4)  # equal scores: the higher version text wins


MANIFEST = {
    "project_name": "P", "module_name": "M",
    "versions": [
        {"version_number": "V1.0.0", "created_at": "2026-01-01T00:00:00", "data_sources": [{"path": "v1/a.csv", "role": "in"}, "v1/b.obj"], "conversion_params": {"k": 1},
         "quality_results": {"path": "q.json"}, "workflow_steps": [{"step": "load", "status": "ok"}], "output_files": [], "tags": ["t"]},
        {"version_number": "V1.1.0", "created_at": "2026-02-01T00:00:00", "project_name": "P", "data_sources": ["v1/b.obj"], "conversion_params": {"k": 2, "n": "x"}, "quality_results": {"score": 91, "grade": "A", "n": 1}},
        {"version_number": "V1.1.0", "created_at": "2026-02-01T00:00:00", "project_name": "P"},
    ],
}


def test_versions(spark, write):
    write("q.json", '{"score": 84, "grade": "B"}')
    path = write("history.json", json.dumps(MANIFEST))
    write("v1/a.csv", "x")
    raw = manifests.read_version_manifests(spark, path)
    docs = spark.read.text(path.replace("history", "q"), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    v = manifests.attach_quality(raw, docs)
    fresh = R.skip_registered(v, v.limit(0)).drop("file", "version_id")
    v = R.version_ids(fresh.withColumn("ordinal", F.col("ordinal").cast("bigint")), "ordinal", F.to_date("created_at")).cache()
    assert v.count() == 2 and R.skip_registered(raw, v).count() == 0
    first, second = v.orderBy("ordinal").collect()
    assert first["quality_results"] == {"score": "84", "grade": "B"} and first["version_id"] == "VER-20260101-0001" and first["data_sources"][1]["name"] == "b.obj"
    pairs = spark.createDataFrame([(first["version_id"], second["version_id"]), ("gone", second["version_id"])], "id_a string, id_b string")
    diff = {r["field"]: r for r in R.diff_versions(v, pairs).filter(F.col("id_a") != "gone").collect()}
    assert diff["data_sources"]["summary"] == "removed: a.csv" and (diff["param_n"]["before"], diff["param_n"]["after"]) == ("", "x") and not diff["module_name"]["changed"]
    assert R.diff_versions(v, pairs).filter("id_a = 'gone'").first()["summary"] == "version not found"
    trace = {r["version_number"]: r["trace_chain"] for r in R.lineage(v).collect()}
    assert trace["V1.0.0"] == f"version V1.0.0 ({first['version_id']}) | sources: a.csv, b.obj → params: k=1 → workflow: load → quality: 84"
    report = R.version_report(v, "V1.0.0").first()
    assert (report["latest_version"], report["current_version"], report["total_versions"]) == ("V1.1.0", "V1.0.0", 2)
    assert R.next_numbers(v).first()["next_number"] == "V1.1.1"
    listed = files.list_files(spark, [path.rsplit("/", 1)[0]])
    facts = {r["name"]: r["exists"] for r in R.with_file_facts(v, listed).collect()}
    assert facts == {"a.csv": True, "b.obj": False}
    done = R.archive(v, v.limit(1).select("version_id"), "/arch")
    assert done.filter("archived").count() == 1
    tasks = v.select(F.col("ordinal").alias("row_id"), "project_name", "module_name", "description", "created_at", "created_by", "data_sources", "conversion_params", "quality_results", F.lit(None).cast(f"array<{R.STEP_TYPE}>").alias("workflow_steps"), "output_files", "tags")
    new = batching.versions_from_tasks(v, tasks).orderBy("version_id").collect()
    assert [r["version_number"] for r in new] == ["V1.1.1", "V1.1.2"] and new[0]["version_id"].endswith("-0003") and len(new[0]["workflow_steps"]) == 5


def test_boreholes(spark):
    holes = spark.createDataFrame([("ZK1", 1.0, 2.0, 100.0), ("ZK2", 3.0, 4.0, 90.0)], "BH_ID string, X double, Y double, Z double")
    layers = spark.createDataFrame([("ZK1", i, float(i), i + 1.0, f"l{i}") for i in range(5)], "BH_ID string, _row_id bigint, depth_top double, depth_bottom double, lithology string")
    water = spark.createDataFrame([("ZK1", 9, 5.0, "late"), ("ZK1", 2, 3.0, "first")], "BH_ID string, _row_id bigint, water_level double, type string")
    tests = spark.createDataFrame([("ZK2", 1, 1.0, 2.0, 3.0)], "BH_ID string, _row_id bigint, UCS double, RQD double, permeability double")
    docs = {(r["BH_ID"], r["part"]): r for r in borehole.nest_documents(holes, layers, water, tests, 100).collect()}
    assert [l["name"] for l in docs[("ZK1", 0)]["lithology"]] == [f"l{i}" for i in range(5)] and docs[("ZK1", 0)]["groundwater"]["type"] == "first"
    assert docs[("ZK2", 0)]["lithology"] == [] and docs[("ZK2", 0)]["groundwater"] is None and docs[("ZK2", 0)]["engineering"]["UCS"] == 1.0
    parts = borehole.nest_documents(holes, layers, water, tests, part_layers=2).filter("BH_ID = 'ZK1'").orderBy("part").collect()
    assert [len(p["lithology"]) for p in parts] == [2, 2, 1]
    c = borehole.layer_cylinders(holes, layers).filter("lithology = 'l1'").first()["geometry"]
    assert c["center"][2] == 98.5 and c["height"] == 1.0 and c["radius"] == 0.8


def test_batches(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "file_id int")

    def attempt(df, number):
        ok = (F.col("file_id") < 2) | ((F.col("file_id") == 2) & (number >= 2))
        error = F.when(~ok, F.when(F.col("file_id") == 5, "不支持的目标格式 读取").when(F.col("file_id") == 4, "broken").otherwise("读取 failed"))
        return df.select("file_id", ok.alias("ok"), error.alias("error"))

    got = {r["file_id"]: (r["state"], r["retries"]) for r in batch.run_with_retry(items, attempt, 3).collect()}
    assert got == {0: ("success", 0), 1: ("success", 0), 2: ("success", 2), 3: ("failed", 3), 4: ("failed", 0), 5: ("failed", 0)}
    assert {r["state"] for r in batch.run_with_retry(items, attempt, 3, "skip").collect()} == {"success", "skipped"}
    with pytest.raises(RuntimeError, match="aborted"):
        batch.run_with_retry(items, attempt, 3, "abort")
    jobs = batch.job_status(spark.createDataFrame([("a", "success", 0), ("a", "failed", 1), ("b", "success", 0), ("c", "failed", 0)], "job_id string, state string, retries int"))
    assert {r["job_id"]: r["status"] for r in jobs.collect()} == {"a": "partial", "b": "completed", "c": "failed"}
    assert batch.batch_summary(jobs).first()["success_rate"] == 0.5
    texts = spark.createDataFrame([(["a", "b", "", "c", "d", "e"], None), ([], ["m"]), ([], [])], "e array<string>, m array<string>")
    assert [r[0] for r in texts.select(batch.error_text(F.col("e"), F.col("m"), F.lit("st"))).collect()] == ["a；b；c；d", "m", "st"]
    outs = spark.createDataFrame([("r", 0, "x", ["s"]), ("r", 1, "x", ["y"]), ("r", 2, "", None)], "report_id string, ordinal int, output string, sidecar_files array<string>")
    assert [r["path"] for r in batch.collect_outputs(outs).orderBy("ordinal", "pos").collect()] == ["x", "s", "y"]


def test_scan(spark, write, folder):
    for name in ("d/a.csv", "d/sub/b.OBJ", "d/c.las", "d/readme.md"):
        write(name, "1")
    found = files.scan_directories(spark, [f"{folder}/d", f"{folder}/d/sub"]).collect()
    assert [(r["name"], r["category"]) for r in found] == [("b.OBJ", "三维模型"), ("c.las", "点云"), ("a.csv", "表格")]
    assert files.scan_directories(spark, [f"{folder}/d"], ["*.csv", "*.las"], recursive=False, max_files=1).first()["name"] == "c.las"
    assert files.format_summary(files.scan_directories(spark, [f"{folder}/d"], category="表格")).first()["count"] == 1
    assert len(byte_ranges.checksums(spark, f"{folder}/d").first()["sha256"]) == 64


def test_stream_intake(spark, folder):
    rows = [(1, "2026-01-01 00:01:00", "a", 5.0), (2, "2026-01-01 00:02:00", None, 5.0), (3, "2026-01-01 00:03:00", "b", 50.0), (3, "2026-01-01 00:04:00", "b", 7.0)]
    df = spark.createDataFrame(rows, "id bigint, ts string, kind string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{folder}/in/x.parquet")
    read = lambda: intake.file_stream(spark, f"{folder}/in/x.parquet", df.schema)
    for _ in range(2):  # a second start finds nothing new
        intake.split_intake(read(), f"{folder}/cp", f"{folder}/good", f"{folder}/dead", ["kind"], {"v": (0, 10)}).awaitTermination(120)
    good, dead = spark.read.parquet(f"{folder}/good"), spark.read.parquet(f"{folder}/dead")
    assert good.count() == 2 and {r["id"]: r["problems"] for r in dead.collect()} == {2: ["missing:kind"], 3: ["range:v"]}
    stream = intake.dedup_stream(read(), ["id"], "ts", "1 hour")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{folder}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 3
    rate = intake.issue_rate(read(), "kind", "ts", F.col("v") > 10, "1 hour")
    q = rate.writeStream.format("memory").queryName("rate").outputMode("complete").option("checkpointLocation", f"{folder}/c3").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["category"]: (r["rows"], r["issues"]) for r in spark.table("rate").collect()} == {"a": (1, 0), None: (1, 0), "b": (2, 1)}


def test_tokens_of_terms_are_made_after_the_count(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "Ring").when(F.col("id") % 3 == 1, " none ").otherwise("ｂolt").alias("word"))
    terms = S.column_terms(rows, {"word": "d"})
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Range" not in plan  # no Python over the rows themselves
    assert sorted(map(tuple, terms.collect())) == [("word", "d", "Ring", 334), ("word", "d", "ｂolt", 333)]
