"""Drawings of many boxes: the choices of the matrix, without it."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from planquarry.operators import matching as M

BOX = "image int, pos int, cat string, box array<double>, size string"


def drawn(r, images, n, kinds):
    """Boxes with equal ones, bad ones and one far away."""
    rows = []
    for image in range(images):
        for pos in range(n):
            x, y = float(r.integers(0, 20)), float(r.integers(0, 20))
            rows.append((image, pos, str(r.choice(kinds)), [x, y, x + float(r.integers(0, 9)), y + float(r.integers(1, 9))], str(r.choice(["", "R5"]))))
        rows.append((image, n, kinds[0], [1e9, 1e9, 1e9 + 4, 1e9 + 4], ""))
        rows.append((image, n + 1, None, [1.0, 1.0, 6.0, 6.0], ""))
        rows.append((image, n + 2, kinds[0], [float("nan"), 1.0, 6.0, float("inf")], ""))
        rows.append((image, n + 3, kinds[0], None, "R5"))
    return rows


def applied(monkeypatch, kind, name, make):
    """The function that `make` would run on each group."""

    class Found(Exception):
        pass

    def keep(self, f, schema):
        raise Found(f)

    with monkeypatch.context() as m, pytest.raises(Found) as found:
        m.setattr(kind, name, keep)
        make()
    return found.value.args[0]


def test_rivals_of_a_crowded_drawing_go_as_in_a_small_one(spark, monkeypatch):
    rows = drawn(np.random.default_rng(5), 5, 60, ["Chamfer", "Fillet", "Fillet Group", "Round Hole"])
    df = spark.createDataFrame(rows, BOX)
    listed = lambda: sorted((x.image, x.pos) for x in M.suppress_across(df).collect())
    wanted = listed()
    monkeypatch.setattr(M, "MATRIX", 0, raising=False)
    assert listed() == wanted and len(wanted) < len(rows)


def test_rivals_of_a_crowded_drawing_are_found_in_time(spark, monkeypatch):
    """40,000 boxes that stay, two more that go: comparing each with all later ones takes over 10 seconds."""
    from pyspark.sql import GroupedData

    n = 40000
    x, y = np.arange(n) % 200 * 10.0, np.arange(n) // 200 * 10.0
    boxes = np.stack([x, y, x + 8, y + 8], 1)
    boxes = np.concatenate([boxes, boxes[[7, n - 1]]])
    df = spark.createDataFrame([(0, 0, "Chamfer", [0.0, 0.0, 1.0, 1.0], "")], BOX)
    one = applied(monkeypatch, GroupedData, "applyInArrow", lambda: M.suppress_across(df))
    cats = ["Chamfer" if k < n else "Fillet" for k in range(n + 2)]
    columns = {"image": np.zeros(n + 2, np.int32), "pos": np.arange(n + 2, dtype=np.int32), "cat": cats, "box": boxes.tolist(), "size": [""] * (n + 2), "mixed": [True] * (n + 2)}
    began = time.process_time()
    assert sorted(one(pa.table(columns))["pos"].to_pylist()) == list(range(n))
    assert time.process_time() - began < 5


@pytest.mark.parametrize("how", ["greedy", "label", "prediction", "truth"])
@pytest.mark.parametrize("same", [True, False])
def test_crowded_drawings_are_matched_as_small_ones(spark, monkeypatch, how, same):
    r = np.random.default_rng(6)
    p, g = (spark.createDataFrame(drawn(r, 4, n, ["A", "B"]), BOX) for n in (70, 50))
    listed = lambda: [sorted(map(tuple, M.match(p, g, t, how, same, strict).collect())) for t, strict in ((0.2, False), (0.5, True), (0.85, False))]
    wanted = listed()
    monkeypatch.setattr(M, "MATRIX", 0, raising=False)
    assert listed() == wanted and all(wanted)


@pytest.mark.parametrize("how", ["greedy", "label", "prediction", "truth"])
def test_a_crowded_drawing_is_matched_in_little_memory(spark, monkeypatch, how):
    """4,000 boxes on either side: one matrix of them takes 128 MB, and several were held."""
    import tracemalloc

    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    df = spark.createDataFrame([(0, 0, "A", [0.0, 0.0, 1.0, 1.0], "")], BOX)
    one = applied(monkeypatch, PandasCogroupedOps, "applyInPandas", lambda: M.match(df, df, 0.4, how, False))
    r = np.random.default_rng(7)
    x, y = r.integers(0, 300, (2, 4000)).astype(float)
    side = pd.DataFrame({"image": 0, "pos": np.arange(4000), "cat": "A", "b0": x, "b1": y, "b2": x + r.integers(20, 100, 4000), "b3": y + r.integers(20, 80, 4000)})
    tracemalloc.start()
    out = one(side, side)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) > 3900 and (out["iou"] >= 0.4).all() and most < 100e6


def _lines(spark, r, images, n):
    """Lines with both sides, either, neither; order keys that are null, NaN or tied by the first."""
    rows = []
    for image in range(images):
        for k in range(n):
            true, seen = ([float(v) for v in (*c, *(c + r.integers(0, 9, 2)))] for c in r.integers(0, 20, (2, 2)))
            key = [None, float("nan"), 1.5, -2.0][int(r.integers(0, 4))]
            kinds = [None if r.random() < 0.1 else str(r.choice(["A", "B"])) for _ in range(2)]
            rows.append((image, key, k, kinds[0], true if r.random() < 0.9 else None, f"s{k}", kinds[1], seen if r.random() < 0.8 else None))
    return spark.createDataFrame(rows, "image long, a double, b int, cat string, box array<double>, size string, p_cat string, p_box array<double>")


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_lines_are_matched_as_sides_with_positions(spark, monkeypatch, most):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    monkeypatch.setattr(M, "MATRIX", most)
    lines = _lines(spark, np.random.default_rng(8), 5, 60).cache()
    placed = lines.withColumn("pos", F.row_number().over(Window.partitionBy("image").orderBy("a", "b")))
    p, g = placed.select("image", "pos", F.col("p_cat").alias("cat"), F.col("p_box").alias("box")), placed
    for how in M.HOW:
        for same in (True, False):
            m = M.match(p, g, 0.2, how, same)
            wanted = sorted(map(tuple, m.join(g.selectExpr("image", "pos AS g", "size"), ["image", "g"]).select("image", "p", "g", "iou", "same", "size").collect()))
            found = M.match_lines(M.dealt(lines), ("a", "b"), 0.2, how, same, of_truth=("size",))
            assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 20


@pytest.mark.parametrize("name", ["metrics_per_category"])
def test_lines_of_a_drawing_are_dealt_once_and_not_sorted_by_spark(spark, name):
    """Each side was ranked by a window over its own sort, and matches were joined to the boxes again."""
    from planquarry.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("hashpartitioning(image") == plan.count("REPARTITION_BY") == 1
    assert plan.count("Sort [image") == 1


@pytest.mark.parametrize("how", ["label", "prediction", "truth"])
def test_turns_whose_partners_are_all_taken_are_passed_over(how):
    """512 turns take one box; those of the next 600 that overlap it find no other, and 20 boxes elsewhere stay free."""
    from planquarry.operators import crowded

    first, near = np.array([[0.0, 0, 40, 40]]), np.array([[1.0, 1, 41, 41]])
    far = np.arange(1, 21)[:, None] * 1000 + first
    many, few = np.concatenate([first.repeat(512, 0), near.repeat(600, 0)]), np.concatenate([first, far])
    p, g = (few, many) if how == "truth" else (many, few)
    if how == "truth":
        p = p[::-1]
    cats = [np.zeros(len(z), int) for z in (p, g)]
    found = crowded.choose(p, g, *cats, *[c == 0 for c in cats], 0.4, False, False, how)
    iou = M._overlaps(p, g)
    assert sorted(found) == sorted(M._choose(iou, iou >= 0.4, np.ones(iou.shape, bool), how)) and len(found) == 1


def test_counts_of_lines_are_those_of_their_matches(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    lines = _lines(spark, np.random.default_rng(9), 5, 60).cache()
    placed = lines.withColumn("pos", F.row_number().over(Window.partitionBy("image").orderBy("a", "b")))
    predicted = placed.where("p_box IS NOT NULL").selectExpr("image", "pos", "p_cat AS cat", "p_box AS box")
    truth = placed.where("box IS NOT NULL").select("image", "pos", "cat", "box")
    seen = lambda df: sorted(((r.cat, r.tp, r.fp, r.fn, round(r.iou_sum, 9)) for r in df.select("cat", "tp", "fp", "fn", "iou_sum").collect()), key=str)
    for same in (True, False):
        matches = M.match_lines(lines, ("a", "b"), 0.2, same_category=same)
        assert seen(M.line_counts(lines, ("a", "b"), 0.2, same_category=same)) == seen(M.counts(predicted, truth, matches))


@pytest.mark.parametrize("name", ["metrics_per_category", "metrics_summary", "metrics_summary_true_categories", "stats_merged_from_parts"])
def test_metrics_read_their_lines_once(spark, name):
    """No table beside the matching: an executor's heap grew with the matched rows and with two more scans."""
    from planquarry.plans import registry

    query = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    times = 2 if name == "stats_merged_from_parts" else 1  # its second part is the first one's exchange again
    assert plan.count("parquet") == times and "Join" not in plan


@pytest.mark.parametrize("mb, tasks", [(0, 4), (100, 50), (2000, 200), (3000, 200), (6400, 400), (10**6, 1 << 14)])
def test_lines_are_dealt_by_writers_that_hold_no_rows(spark, mb, tasks):
    """Up to 200 tasks rows go straight to files; beyond them a writer fills an executor's memory with a split's rows, so tasks grow first."""
    rows = spark.range(mb << 17).selectExpr("id AS image")
    plan = M.dealt(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [image#" in plan and f"], {tasks}" in plan


@pytest.mark.parametrize("name", ["metrics_summary", "metrics_summary_true_categories"])
def test_summaries_deal_large_tables_by_writers_that_hold_no_rows(spark, monkeypatch, name):
    """The query itself asks for 200 tasks where its lines alone, at so many bytes a task, would ask for far more."""
    from planquarry.plans import registry

    monkeypatch.setattr(M, "DEALT", 1)
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "], 200" in plan
