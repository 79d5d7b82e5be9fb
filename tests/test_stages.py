"""Three-stage records, checks, rewards, retrieval."""

import json

from pyspark.sql import functions as F

from planquarry.operators import retrieval as R
from planquarry.operators import stages as S

REGIONS = f"array<{S.REGION}>"
FEATURES = "array<struct<category:string,size:string,bbox:array<double>,region_id:string>>"


def test_targets_and_messages(spark):
    rows = [
        ("a", "Section View", "", [50.0, 10.0, 90.0, 90.0]), ("a", "Detail View", "", [0.0, 10.0, 40.0, 90.0]), ("a", "Notes", "", [0.0, 0.0, 5.0, 5.0]),
        ("a", "Fillet", None, [1.0, 20.0, 2.0, 21.0]), ("b", "Chamfer", "C1", [1.0, 1.0, 2.0, 2.0]),
    ]
    t = S.targets(spark.createDataFrame(rows, "image string, cat string, size string, box array<double>"))
    got = {r.image: r for r in t.collect()}
    assert [(x.region_id, x.category) for x in got["a"].regions] == [("r001", "View Region"), ("r002", "View Region"), ("d001", "Notes")]
    assert [(x.region_id, x.category) for x in got["a"].views] == [("r001", "Detail View"), ("r002", "Section View")]
    assert got["a"].features[0].size == "" and got["b"].regions is None
    chat = t.withColumn("feature_scope", F.lit(None).cast("array<string>")).withColumn("m", S.messages(("one", "two", "three"))).withColumn("kind", S.row_kind(F.col("m")))
    said = {r.image: r for r in chat.collect()}
    assert said["a"].kind == "three_stage" and said["b"].kind == "feature_only"
    assert json.loads(said["a"].m[1].content)["regions"][0]["region_id"] == "r001" and json.loads(said["b"].m[1].content)["feature_scope"] is None


def checked(spark, column, rows, schema):
    return [r.e for r in spark.createDataFrame(rows, schema).select(column.alias("e")).collect()]


def test_checks(spark):
    good, box = ("r001", "view region", [0.0, 0.0, 5.0, 5.0]), [0.0, 0.0, 5.0, 5.0]
    e = checked(spark, S.check_regions(F.col("r")), [([good],), ([good, good],), ([("", "Fillet", [1.0])],), (None,), ([],)], f"r {REGIONS}")
    assert e == [[], ["repeated region_id"], ["regions[0] needs region_id", "regions[0] has no allowed category", "regions[0] has no valid bbox"], ["regions must be a list"], []]
    e = checked(spark, S.check_views(F.col("m"), F.col("v")), [("first-angle", [("r001", "iso view", None)]), ("x", [("r001", "Notes", box)])], f"m string, v {REGIONS}")
    assert e == [[], ["unknown projection_method", "views[0] has no allowed category"]]
    e = checked(
        spark, S.check_features(F.col("s"), F.col("f")),
        [(["Fillet"], [("fillet", "", box, None)]), (["Fillet"], [("Chamfer", None, box, None)]), ([], [("Chamfer", "", box, None)]), (None, [])], f"s array<string>, f {FEATURES}",
    )
    assert e == [[], ["features[0] is outside feature_scope", "features[0] needs a size, empty or not"], [], ["feature_scope must be a list"]]
    e = checked(
        spark, S.check_across(F.col("r"), F.col("v"), F.col("f")),
        [([good], [("r001", "", None)], [("", "", None, "r001")]), ([good], [("r009", "", None)], [("", "", None, "r7")]), (None, None, [("", "", None, "r7")]), (None, [("r7", "", None)], [("", "", None, "r7")])],
        f"r {REGIONS}, v {REGIONS}, f {FEATURES}",
    )
    assert e == [[], ["regions without view: r001", "views without region: r009", "features of unknown regions: r7"], [], []]


def test_clean_regions_and_noise(spark):
    box = [0.1, 0.2, 0.5, 0.6]
    rows = [([("r001", "view area", box), ("r001", "Notes", box), (None, "BOM", box), ("x", "Fillet", box), ("y", "Notes", [1.0])],)]
    out = spark.createDataFrame(rows, f"r {REGIONS}").select(S.clean_regions(F.col("r")).alias("c"), S.noisy_boxes(F.array(F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1000.0)])), 3, F.lit("k")).alias("n")).first()
    assert [(x.region_id, x.category, x.bbox) for x in out.c] == [(f"r00{i}", c, [100.0, 200.0, 500.0, 600.0]) for i, c in ((1, "View Region"), (2, "Notes"), (3, "Bill of Materials"))]
    a, b, c, d = out.n[0]
    assert 0 <= a < c <= 1000 and 0 <= b < d <= 1000


def test_scopes_and_slices(spark):
    chat = F.array(*[F.struct(F.lit(r).alias("role"), F.lit("").alias("content")) for r in ("system", "user", "assistant", "user")])
    row = spark.range(1).select(
        S.layout_scope(F.lit('a layout_scope={"views":["x"]} layout_scope={"views":["y"],"documents":[]} tail')).alias("s"), S.layout_scope(F.lit("none")).alias("n"), F.size(S.before_answer(chat)).alias("k")
    ).first()
    assert row.s.views == ["y"] and row.n is None and row.k == 2


def test_rewards_and_weights(spark):
    one, yes, no = F.lit(1.0), F.lit(True), F.lit(False)
    row = spark.range(1).select(
        S.reward(one, one, one, one, one, yes, no).alias("full"), S.reward(one, one, one, one, one, no, no).alias("unread"), S.loss_weight(F.lit("holes"), F.array_repeat(F.lit("圆孔"), 8)).alias("busy"),
        S.loss_weight(F.lit("holes"), F.lit(None).cast("array<string>")).alias("holes"), S.loss_weight(F.lit("duyin"), F.array_repeat(F.lit("圆孔"), 20)).alias("other"), S.channel_of(F.array(F.lit("Fillet"), F.lit("Pin Hole"))).alias("c"),
    ).first()
    assert abs(row.full - 1) < 1e-9 and (row.unread, row.busy, row.holes, row.other, row.c) == (0.0, 4.0, 2.0, 1.0, "holes")
    f = spark.createDataFrame([(1, 0, [0.0, 0.0, 2.0, 2.0]), (1, 1, [90.0, 90.0, 95.0, 95.0])], "image int, pos int, box array<double>")
    v = spark.createDataFrame([(1, [0.0, 0.0, 10.0, 10.0])], "image int, box array<double>")
    assert S.cross_view(f, v).first().share == 0.5


def test_title_block(spark):
    at = lambda x, y: [[x, y], [x + 10.0, y], [x + 10.0, y + 4], [x, y + 4]]
    rows = [("a", 0, "Material: Steel", at(0.0, 0.0)), ("a", 1, "Scale", at(0.0, 50.0)), ("a", 2, "1:2", at(30.0, 52.0)), ("a", 3, "far", at(60.0, 50.0)), ("a", 4, "", at(0.0, 9.0)), ("b", 0, None, None)]
    got = R.title_block(spark.createDataFrame(rows, "image string, pos int, text string, box array<array<double>>")).collect()
    assert sorted((r.image, r.field, r.value) for r in got) == [("a", "material", "Steel"), ("a", "scale", "1:2")]


def test_rules(spark):
    rules = spark.createDataFrame([("a.md", ["Fillet"], 1, ["radius"]), ("b.md", ["Fillet", "Chamfer"], 0, ["edge", "R"]), ("c.md", [], 2, [])], "file string, categories array<string>, step int, keywords array<string>")
    want = F.array(F.lit("Fillet"), F.lit("Chamfer"))
    assert [r.file for r in R.by_categories(rules, want).collect()] == ["b.md", "a.md"]
    assert [r.file for r in R.by_step(rules, 1).collect()] == ["a.md", "b.md"]
    assert [r.file for r in R.by_keywords(rules, F.lit("The RADIUS of an edge")).collect()] == ["b.md", "a.md"]
    parts = spark.createDataFrame([("q", 1, "aaaa"), ("q", 2, "bbbb"), ("q", 3, "c")], "q string, k int, t string")
    assert R.within_budget(parts, "q", "k", "t", 8).count() == 2
    assert spark.range(1).select(R.context([F.lit("abc"), F.lit(""), F.lit("defgh")], 2).alias("c")).first().c == "abc\n\ndef"
