"""Other shapes of records."""

from pyspark.sql import functions as F

from planquarry.operators import reshape as R
from planquarry.operators import stages as S

ITEM = "struct<category:string,size:string,bbox:array<double>>"


def test_chats(spark):
    rows = [([("user", [("image", None, "/x/a.png"), ("text", " what?", None)]), ("assistant", [("text", "yes", None)]), ("assistant", None)],)]
    got = spark.createDataFrame(rows, f"c array<struct<role:string,content:{R.PART}>>").select(R.plain_chat(F.col("c")).alias("p")).first().p
    assert [(m.role, m.content) for m in got.messages][:2] == [("user", "<image> what?"), ("assistant", "yes")] and got.images == ["/x/a.png"]
    assert spark.range(1).select(R.rerooted(F.array(F.lit("/x/a.png")), "/y/").alias("p")).first().p == ["/y/a.png"]
    chats = [(1, ["/x/a.png"], [("user", "q"), ("assistant", "v"), ("Assistant", "f")]), (2, ["/x/b.png"], [("assistant", "v")]), (3, ["/z/a.png"], [("assistant", "w"), ("assistant", "g")])]
    t = spark.createDataFrame(chats, "pos int, images array<string>, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in R.ground_truth(t).collect()] == [("a.png", "w", "g")]
    assert sorted(r.image for r in R.image_names(t, t).collect()) == ["a.png", "b.png"]


def test_flat_and_back(spark):
    box = [0.0, 0.0, 5.0, 5.0]
    items = [("Notes", "", box), ("iso view", "", box), ("fillet", "R1", box), ("other", None, box)]
    s = spark.createDataFrame([(items,)], f"i array<{ITEM}>").select(R.stages_of_flat(F.col("i")).alias("s")).first().s
    assert [(r.region_id, r.category) for r in s.regions] == [("r001", "View Region"), ("d001", "Notes")]
    assert [v.category for v in s.views] == ["Isometric View"] and [f.category for f in s.features] == ["Fillet", "other"]
    flat = spark.createDataFrame([([("d001", "Notes", box)], None, [("Fillet", None, box)])], f"d array<{S.REGION}>, v array<{S.REGION}>, f array<{ITEM}>")
    got = flat.select(R.flat_result(F.col("d"), F.col("v"), F.col("f")).alias("x")).first().x
    assert [(a.category, a["size"]) for a in got] == [("Notes", ""), ("Fillet", "")]


def test_linked_views(spark):
    regions = [("r001", "View Region", [0.0, 0.0, 9.0, 9.0]), ("r002", "View Region", [50.0, 50.0, 90.0, 90.0]), ("d001", "Notes", [0.0, 0.0, 1.0, 1.0])]
    views = [("zz", "section view", [52.0, 52.0, 88.0, 88.0]), ("r002", "detail", None), ("", "iso view", None), ("r001", "top view", None), ("q", "Fillet", None)]
    df = spark.createDataFrame([(views, regions)], f"v array<{S.REGION}>, r array<{S.REGION}>")
    got = df.select(R.linked_views(F.col("v"), F.col("r")).alias("x")).first().x
    assert [(a.region_id, a.category, a.bbox[0]) for a in got] == [("r002", "Section View", 50.0), ("r001", "Isometric View", 0.0)]


def test_labels_scores_and_runs(spark):
    cases = [("Chamfer", "R3", "Fillet"), ("Fillet Group", "2x45°", "Chamfer Group"), ("Round Hole Group", "4xM6", "Threaded Hole Group"), ("Round Hole", "8H7", "Pin Hole"), ("Bending", "R3", "Bending"), ("Fillet", None, "Fillet")]
    got = spark.createDataFrame(cases, "c string, s string, e string").select(R.relabelled(F.col("c"), F.col("s")).alias("x"), "e").collect()
    assert all(r.x == r.e for r in got)
    row = spark.range(1).select(R.scope(F.array(F.lit("slot"), F.lit("x"), F.lit("Slotted Hole")), ["Fillet"]).alias("a"), R.scope(F.lit(None).cast("array<string>"), ["Fillet"]).alias("b"), R.focus_score(*[F.lit(1.0)] * 5).alias("f")).first()
    assert (row.a, row.b) == (["Slotted Hole"], ["Fillet"]) and abs(row.f - 1) < 1e-9
    stats = spark.createDataFrame([("A", 1, 0, 1), ("B", 0, 1, 0)], "cat string, tp long, fp long, fn long")
    r = R.weighted_f1(stats, {"A": 2.0}).first()
    assert abs(r.precision - 2 / 3) < 1e-9 and r.recall == 0.5
    runs = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "label string, f1 double")
    assert {x.label: x.f1_change for x in R.compared(runs, "a", ["f1"]).collect()} == {"a": 0.0, "b": 2.0}
    arrays = spark.createDataFrame([("k", [1.0, 2.0]), ("k", [3.0, 4.0])], "key string, v array<double>")
    assert R.mean_arrays(arrays, "key", "v").first().v == [2.0, 3.0]
    last = R.last_per_key(spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key string, ord int, v string"), "key", "ord").first()
    assert (last.ord, last.v) == (2, "y")
    log = R.log_rows(spark.createDataFrame([("r", [(1, 0.5), (2, None)])], "run string, log_history array<struct<step:int,loss:double>>"))
    assert log.count() == 2
