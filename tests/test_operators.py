"""Table operators on small cases, sources, sinks and streams."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from planquarry.operators import matching as M
from planquarry.operators import metrics as S
from planquarry.operators import ranking as K
from planquarry.operators import records as R
from planquarry.operators import sampling as P
from planquarry.sources import readers, sinks
from planquarry.streaming import watch as W

PAIRS = "image int, p int, g int, iou double, same boolean"


def pairs(spark, *rows):
    return spark.createDataFrame([(1, p, g, v, True) for p, g, v in rows], PAIRS)


def matched(df):
    return sorted((r.p, r.g) for r in df.collect())


def test_greedy_orders(spark):
    c = pairs(spark, (0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.5))
    assert matched(M.greedy(c)) == [(0, 0), (1, 1)]
    assert matched(M.greedy(pairs(spark, (0, 0, 0.7), (1, 0, 0.7)))) == [(0, 0)]
    turns = pairs(spark, (0, 0, 0.6), (1, 0, 0.9))
    assert matched(M.in_prediction_order(turns)) == [(0, 0)] and matched(M.greedy(turns)) == [(1, 0)]
    assert matched(M.in_prediction_order(pairs(spark, (0, 0, 0.5), (0, 1, 0.5)))) == [(0, 0)]
    assert matched(M.in_truth_order(pairs(spark, (0, 0, 0.5), (1, 0, 0.5)))) == [(1, 0)]
    assert matched(M.greedy(pairs(spark))) == []


def box_rows(spark, rows):
    return spark.createDataFrame(rows, "image int, pos int, cat string, box array<double>, size string, priority int")


def test_counts_and_suppression(spark):
    p = box_rows(spark, [(1, 0, "A", [0.0, 0.0, 10.0, 10.0], "", 1), (1, 1, "A", [0.0, 0.0, 10.0, 9.0], "Ø8", 2), (1, 2, "B", [50.0, 50.0, 60.0, 60.0], "", 1)])
    kept = M.suppress(p, 0.5)
    assert sorted((r.pos, r.cat, r["size"]) for r in kept.collect()) == [(1, "A", "Ø8"), (2, "B", "")]
    g = box_rows(spark, [(1, 0, "A", [0.0, 0.0, 10.0, 10.0], "", 1), (1, 1, "C", [1.0, 1.0, 2.0, 2.0], "", 1)])
    stats = {r.cat: (r.tp, r.fp, r.fn) for r in M.counts(p, g, M.greedy(M.candidates(p, g, 0.4))).collect()}
    assert stats == {"A": (1, 1, 0), "B": (0, 1, 0), "C": (0, 0, 1)}
    views = box_rows(spark, [(1, 0, "V", [0.0, 0.0, 20.0, 20.0], "", 1), (1, 1, "V", [40.0, 40.0, 80.0, 80.0], "", 1)])
    assert sorted((r.pos, r.view) for r in M.assign_to_views(p, views).collect()) == [(0, 0), (1, 0), (2, 1)]


def test_suppression_runs_over_all_boxes_of_a_drawing(spark, tmp_path):
    """Drawings of 110 boxes against brute force, by the operator and by the query."""
    from planquarry.plans import matching as queries
    from planquarry.plans.boxes import boxes

    r = random.Random(4)
    lines = [(500 * (k % 110) + k // 110 + 1, k % 7 + 1, r.randrange(1, 400), r.randrange(1, 300), "RAN"[k % 3], "OF"[k % 2], "1995-01-01", float(k)) for k in range(220)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate string, l_extendedprice double"
    spark.createDataFrame(lines, names).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    predicted, _ = boxes(spark, f"file://{tmp_path}")
    ranked = predicted.withColumn("priority", F.when(F.col("size") == "", 1).otherwise(2))
    wanted, groups = set(), {}
    for b in ranked.collect():
        groups.setdefault((b.image, b.cat), []).append(b)

    def over(p, q):
        w, h = (max(0, min(p[i + 2], q[i + 2]) - max(p[i], q[i])) for i in (0, 1))
        return 5 * w * h >= 2 * ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h)

    for (image, cat), found in groups.items():
        kept = []
        for b in sorted(found, key=lambda b: (-b.priority, b.pos)):
            same = [k for k in kept if over(k[1], b.box)]
            for k in same:
                k[2] = k[2] or b["size"]
            if not same:
                kept.append([b.pos, b.box, b["size"]])
        wanted |= {(image, cat, pos, size) for pos, _, size in kept}
    assert max(pos for _, _, pos, _ in wanted) > 60 and len(wanted) < ranked.count()
    assert sorted(wanted) == sorted((k.image, k.cat, k.pos, k["size"]) for k in M.suppress(ranked, 0.4).collect())
    got = queries.overlapping_boxes_suppressed(spark, f"file://{tmp_path}").collect()
    assert sorted(w[:3] for w in wanted) == sorted(tuple(k) for k in got)


def test_scores(spark):
    row = spark.range(1).select(
        S.f1(F.lit(0), F.lit(0), F.lit(0)).alias("a"), S.refined_reward(F.lit(0.5), F.lit(0.9)).alias("b"), S.penalised_quality(F.lit(1.5), F.lit(2), F.lit(3), F.lit(2)).alias("c"),
        S.index_percentile(F.array(*map(F.lit, [3, 1, 2])), 0.5).alias("d"), S.cad_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0)).alias("e"),
    ).first()
    assert (row.a, row.b, row.d) == (0.0, 1.0, 2) and row.c == pytest.approx(1.45 / 3) and row.e == pytest.approx(1.0)


def test_align_takes_turns(spark):
    truth = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c"]), (2, ["b"]), (3, ["z"])], "pos long, keys array<string>")
    predictions = spark.createDataFrame([(0, ["a"]), (1, ["b"]), (2, ["a", "c"])], "pos long, keys array<string>")
    assert sorted((r.truth, r.prediction) for r in R.align(truth, predictions).collect()) == [(0, 0), (1, 2), (2, 1), (3, None)]


def test_merge_sources(spark):
    rows = [("i", "s1", "t", "A", "8", [1.0, 2.0, 3.0, 4.0]), ("i", "s2", "t", "A", "Ø8", [1.0, 2.0, 3.0, 4.0001]), ("i", "s1", "t", "B", "", [1.0, 2.0, 3.0, 4.0])]
    got = R.merge_sources(spark.createDataFrame(rows, "image string, source string, task string, cat string, size string, box array<double>")).collect()
    assert sorted((r.cat, tuple(r.sources), r["size"], r.conflict) for r in got) == [("A", ("s1", "s2"), "Ø8", True), ("B", ("s1",), "", False)]


def test_merge_shards(spark):
    same = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("j", 3, "y")], "key string, ord int, v string")
    assert sorted((r.key, r.ord, r.v) for r in R.merge_shards(same, "key", "ord").collect()) == [("j", 3, "y"), ("k", 1, "x")]
    with pytest.raises(Exception, match="shards disagree on k"):
        R.merge_shards(same.union(spark.createDataFrame([("k", 4, "z")], same.schema)), "key", "ord").collect()


def test_preferences_leaks_projection(spark):
    s = spark.createDataFrame([("a", 0, 0.50), ("a", 1, 0.54), ("b", 0, 0.50), ("b", 1, 0.60)], "image string, sample int, score double")
    assert [(r.image, r.chosen, r.rejected) for r in R.preference_pairs(s, 0.05).collect()] == [("b", 1, 0)]
    f = spark.createDataFrame([("f", "train"), ("f", "val"), ("g", "train")], "family string, split string")
    assert [r.family for r in R.leaks(f).collect()] == ["f"]
    both = spark.range(1).select(R.projection_of(F.array(F.lit("unknown"), F.lit("first_angle"))).alias("a"), R.projection_of(F.array(F.lit("x"), F.lit("y"))).alias("b")).first()
    assert tuple(both) == ("first_angle", "unknown")


def test_ranking(spark):
    rows = spark.createDataFrame([(15,), (20,), (3,)], "step long")
    train = spark.createDataFrame([(10, 1.0), (20, 2.0)], "step long, loss double").withColumn("at", F.col("step"))
    assert sorted((r.step, r.nearest["at"]) for r in K.nearest_step(rows, train).collect()) == [(3, 10), (15, 10), (20, 20)]
    reports = spark.createDataFrame([("a", 0.9, 0.97), ("b", 0.8, 0.99)], "label string, score double, valid double")
    ranked = K.rank_reports(reports, F.col("valid") >= 0.98, [F.desc("score"), "label"]).orderBy("rank").collect()
    assert [(r.label, r.eligible) for r in ranked] == [("b", True), ("a", False)]
    runs = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.1), ("r", 3, None), ("r", 4, 0.9)], "run string, step long, loss double")
    assert sorted(r.step for r in K.keep_policy(runs, 2).where("keep").collect()) == [1, 2, 4]


def test_sampling(spark):
    rows = spark.range(100).select(F.col("id").alias("index"), (F.col("id") % 2).cast("string").alias("s"))
    split = {r.split: r["count"] for r in P.stratified(rows, "s", {"train": 0.8, "val": 0.1, "test": 0.1}, 1).groupBy("split").count().collect()}
    assert split == {"train": 80, "val": 10, "test": 10}
    assert P.holdout(rows, 0.05, 1).where("split = 'val'").count() == 5 and P.holdout(rows.limit(0), 0.05, 1).count() == 0
    assert [r["index"] for r in P.random_select(rows, 5, 1, "n").collect()] == [r["index"] for r in P.random_select(rows.repartition(7), 5, 1, "n").collect()]
    labels = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, []), (4, None)], "index long, labels array<string>")
    assert sorted(r["index"] for r in P.oversample(labels, "labels", {"b": 3}).collect()) == [1, 2, 2, 2, 3, 4]
    pool = spark.createDataFrame([(k, ["rare"] if k % 20 == 0 else ["common"]) for k in range(100)], "index long, labels array<string>")
    got = {r["index"] for r in P.balanced_select(pool, ["rare", "common"], 6, 1, "x").collect()}
    assert len(got) == 6 and sum(i % 20 == 0 for i in got) == 3
    families = spark.createDataFrame([(f"f{k}", 10) for k in range(20)], "family string, n long")
    shares = {r.split: r.n for r in P.split_families(families, {"train": 0.8, "val": 0.2}, 1).groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert shares == {"train": 160, "val": 40}


def test_readers(spark, tmp_path):
    item = {"dataitem_name": "a.png", "width": 10, "height": 20, "tasks": [{"task_name": "t", "task_values": [{"value": {"label": " Fillet ", "size": "R1"}, "bbox": [9, 9, 1, 1]}, {"value": {"label": ""}, "bbox": [1, 1, 2, 2]}]}]}
    (tmp_path / "list.json").write_text(json.dumps([item]))
    (tmp_path / "wrapped.json").write_text("﻿" + json.dumps({"records": [item, item]}))
    assert readers.json_items(spark, f"file://{tmp_path}/list.json").count() == 1
    items = readers.json_items(spark, f"file://{tmp_path}/wrapped.json")
    rows = readers.annotations(items).collect()
    assert len(rows) == 2 and rows[0].cat == "Fillet" and rows[0].box == [1.0, 1.0, 9.0, 9.0]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[2]\n{"a": \n{"a": 3}\n')
    good, bad = readers.lines_with_errors(spark, f"file://{tmp_path}/x.jsonl", "a int")
    assert sorted(r.a for r in good.collect()) == [1, 3] and bad.count() == 2
    with pytest.raises(Exception):
        readers.json_lines(spark, f"file://{tmp_path}/x.jsonl", "a int").collect()


def test_images_rules_chunks(spark, tmp_path):
    folder = tmp_path / "img"
    folder.mkdir()
    (folder / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 40))
    (folder / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 12)
    (folder / "c.bin").write_bytes(b"none")
    files = readers.image_sizes(spark, f"file://{folder}")
    assert {r.image: (r.width, r.height) for r in files.collect()} == {"a.png": (30, 40), "b.jpg": (9, 7), "c.bin": (None, None)}
    items = spark.createDataFrame([("a.png", 1, 1), ("z.png", 5, 6), ("y.png", None, 6)], "image string, width int, height int")
    got = {r.image: (r.width, r.height, r.status) for r in readers.resolved_images(items, files).collect()}
    assert got == {"a.png": (30, 40, "local"), "z.png": (5, 6, "metadata_only"), "y.png": (None, None, "missing")}
    (tmp_path / "r.md").write_text("---\ncategories: [Fillet, \"Round Hole\"]\nstep: 2\nkeywords: [radius]\n---\nBody text\n")
    r = readers.rules(spark, f"file://{tmp_path}/r.md").first()
    assert (r.categories, r.step, r.keywords, r.content) == (["Fillet", "Round Hole"], 2, ["radius"], "Body text")
    text = F.lit("aaaa\n\nbbbb\n\ncccc\n\n\n")
    assert spark.range(1).select(readers.chunks(text, 10, 2).alias("c")).first().c == ["aaaa\n\nbbbb", "bb\n\ncccc"]


def test_labelling_export(spark, tmp_path):
    row = {"id": 1, "data": {"image": "/x/a.png"}, "annotations": [{"result": [{"type": "rectanglelabels", "original_width": 200, "original_height": 100, "value": {"x": 10, "y": 20, "width": 30, "height": 40, "rectanglelabels": ["Fillet"]}}, {"type": "choices", "value": {"choices": ["c"]}}]}]}
    (tmp_path / "e.json").write_text(json.dumps([row]))
    export = readers.json_items(spark, f"file://{tmp_path}/e.json", readers.LABELLING)
    assert [tuple(r) for r in readers.labelling_boxes(export).collect()] == [("a.png", "Fillet", [20.0, 20.0, 80.0, 60.0])]
    assert readers.is_labelling_export(["data", "annotations"]) and not readers.is_labelling_export(["data"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    n, digest = sinks.write_one_file(df, str(tmp_path / "o.jsonl"), ["k"])
    assert n == 2 and len(digest) == 64
    assert sinks.content_digest(df) == sinks.content_digest(df.repartition(3)) != sinks.content_digest(df.union(df))
    sinks.append_new(df, f"file://{tmp_path}/t", ["k"])
    sinks.append_new(spark.createDataFrame([(2, "x"), (3, "c")], df.schema), f"file://{tmp_path}/t", ["k"])
    assert sorted(r.k for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [1, 2, 3]
    many = spark.range(10).select(F.col("id").alias("pos"))
    sinks.write_batches(many.where("pos < 6"), f"file://{tmp_path}/b", "pos", 4)
    sinks.write_batches(many, f"file://{tmp_path}/b", "pos", 4)
    assert spark.read.json(f"file://{tmp_path}/b").where("batch = 2").count() == 2
    ordered = sinks.in_reference_order(df, spark.createDataFrame([(2, 0), (1, 1)], "k int, pos int"), "k")
    assert [r.k for r in ordered.collect()] == [2, 1]


def test_watch_appends_once_and_reranks(spark, tmp_path):
    base = f"file://{tmp_path}"
    row = lambda c, s, f: json.dumps({"checkpoint": c, "step": s, "precision": 0.1, "recall": 0.1, "f1": f, "avg_quality": 0.1})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(row("a", 1, 0.2) + "\n" + row("b", 1, 0.3) + "\n")
    run = lambda: W.watch(spark, f"{base}/in", f"{base}/done", f"{base}/rank", f"{base}/state", files=1).awaitTermination()
    run()
    assert [(r.checkpoint, r.rank) for r in spark.read.parquet(f"{base}/rank").orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    (tmp_path / "in" / "2.json").write_text(row("a", 2, 0.9) + "\n" + row("a", 1, 0.2) + "\n")
    run()
    assert [(r.checkpoint, r.f1) for r in spark.read.parquet(f"{base}/rank").orderBy("rank").collect()] == [("a", 0.9), ("b", 0.3)]
    assert spark.read.parquet(f"{base}/done").count() == 3


def test_match_equals_the_folds(spark):
    import random

    r = random.Random(1)

    def side(n):
        rows = []
        for image in range(6):
            for pos in range(n if image else 0):
                x, y = float(r.randint(0, 20)), float(r.randint(0, 20))
                rows.append((image, pos, r.choice(["A", "B", None]), [x, y, x + r.randint(0, 9), y + r.randint(1, 9)], "", 1))
        return box_rows(spark, rows)

    p, g = side(25), side(20)
    listed = lambda df: sorted((x.image, x.p, x.g, x.iou, x.same) for x in df.collect())
    for same in (True, False):
        c = M.candidates(p, g, 0.2, same)
        assert listed(M.match(p, g, 0.2, "greedy", same)) == listed(M.greedy(c))
        assert listed(M.match(p, g, 0.2, "prediction", same)) == listed(M.in_prediction_order(c))
        assert listed(M.match(p, g, 0.2, "truth", same)) == listed(M.in_truth_order(c))
    assert M.match(p.limit(0), g, 0.2).count() == 0


def test_the_stream_ranks_all_results_as_the_batch_query_does(spark, tmp_path):
    from planquarry.plans import streams

    rows = [(k, 40 + k % 30, float((k * 7919) % 1000)) for k in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"file://{tmp_path}/events.parquet")
    batch = streams.results_ranked(spark, f"file://{tmp_path}").collect()
    stream = streams.results_ranked_as_they_come(spark, f"file://{tmp_path}").select("checkpoint", "step", "rank").collect()
    assert len(batch) == 30 and sorted(map(tuple, stream)) == sorted(map(tuple, batch))


@pytest.mark.parametrize("n", [2, 5, 30])
def test_balanced_selection_is_greedy_over_the_whole_pool(spark, n):
    """All candidates in every turn, on a pool of more than 50 * n rows of a target for the smallest n."""
    r, targets = random.Random(n), ["a", "b", "c", "d"]
    rows = [(k, ["a"] if r.random() < 0.8 else r.sample(["a", "b", "c", "d", "x", "y"], r.randrange(4))) for k in range(400)] + [(400, None), (401, ["a", "b", "c", "d"])]
    own = {i: set(held or []) & set(targets) for i, held in rows}
    rank = lambda i: P._hash(7, "t", i)
    covered, out = dict.fromkeys(targets, 0), []
    while len(out) < n and (left := [i for i in own if i not in out and own[i]]):
        viable = [t for t in targets if any(t in own[i] for i in left)]
        target = min(viable, key=lambda t: (covered[t], sum(t in h for h in own.values()), P._hash(7, "t:target", targets.index(t))))
        best = max((i for i in left if target in own[i]), key=lambda i: (math.fsum(1 / (1 + covered[t]) for t in own[i]), -rank(i)))
        out.append(best)
        for t in own[best]:
            covered[t] += 1
    pool = spark.createDataFrame(rows, "index long, labels array<string>")
    got = P.balanced_select(pool, targets, n, 7, "t").orderBy("turn").collect()
    assert [g["index"] for g in got] == out
    assert spark.range(1).select(P.X.stable_rank(7, "t", F.lit(3))).first()[0] == rank(3)


def test_balanced_selection_fills_up_in_the_order_of_fillers(spark):
    rows = [(k, ["a"] if k < 3 else []) for k in range(60)]
    got = P.balanced_select(spark.createDataFrame(rows, "index long, labels array<string>"), ["a"], 10, 7, "t").orderBy("turn").collect()
    rest = sorted(range(3, 60), key=lambda i: P._hash(8, "t:filler", i))
    assert [g["index"] for g in got] == [*sorted(range(3), key=lambda i: P._hash(7, "t", i)), *rest[:7]]


def test_all_orders_are_aligned(spark):
    """Every order on both sides, against records taken in turn."""
    from planquarry.plans import records

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS k", "concat('d', o_orderdate) AS d", "concat('c', o_custkey) AS c", "concat('p', o_orderpriority) AS p").orderBy("k").collect()
    own, free, wanted = {}, {o.k for o in orders}, []
    for o in orders:
        for key in (o.c, o.p, o.d):
            own.setdefault(key, o.k)
    for o in orders:
        key = next((key for key in (o.d, o.c) if own[key] in free), None)
        free -= {own[key]} if key else set()
        wanted.append((o.k, own[key] if key else None, key))
    got = sorted(tuple(r) for r in records.records_aligned_all(spark, sf).select("truth", "prediction", "key").collect())
    assert got == sorted(wanted) and len(got) == len(orders)


def test_alike_classes_are_suppressed_in_turn(spark):
    """Against the rule read aloud: boxes in order, each against the later ones."""
    import random

    from planquarry.operators import matching

    r = random.Random(3)
    rows = []
    for image in range(12):
        for pos in range(r.randint(1, 14)):
            x = float(r.choice([0, 1, 2, 40]))
            rows.append((image, pos, r.choice(["Chamfer", "Fillet", "Fillet Group", "Round Hole"]), r.choice([[x, 0.0, x + 20, 20.0], None, [x, 0.0, x + 20, 20.0]]), r.choice(["", None, "R5"])))

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(0, w) * max(0, h)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    wanted = set()
    for image in {x[0] for x in rows}:
        own = sorted(x for x in rows if x[0] == image)
        gone = set()
        for k, a in enumerate(own):
            if k in gone:
                continue
            for j in range(k + 1, len(own)):
                b = own[j]
                if j in gone or not a[3] or not b[3] or a[2] == b[2] or "Round Hole" in (a[2], b[2]) or overlap(a[3], b[3]) <= 0.7:
                    continue
                gone.add(k if b[4] and not a[4] else j)
            if k not in gone:
                wanted.add((image, a[1]))
    df = spark.createDataFrame(rows, "image int, pos int, cat string, box array<double>, size string").repartition(3)
    assert {(x.image, x.pos) for x in matching.suppress_across(df).collect()} == wanted


def test_benchmark_rows_are_the_best_of_all(spark):
    import math
    import random
    from collections import Counter

    from planquarry.operators import sampling

    r = random.Random(5)
    rows = [(f"d{k:03d}", sorted(r.sample("abcdef", r.randint(0, 3))), r.randint(0, 40)) for k in range(150)]
    n = 30
    weight = {c: 1 / math.sqrt(x) for c, x in Counter(c for x in rows for c in x[1]).items()}
    chosen, out, left = Counter(), [], list(rows)
    for _ in range(n):
        score = lambda x: round(sum(weight[c] / (1 + chosen[c]) for c in x[1]) + 0.05 * len(x[1]) - 0.002 * max(0, x[2] - 12), 8)
        best = max(left, key=lambda x: (score(x), len(x[1]), -x[2], x[0]))
        left.remove(best)
        out.append(best[0])
        chosen.update(best[1])
    df = spark.createDataFrame(rows, "name string, categories array<string>, objects int").repartition(4)
    assert [x.name for x in sampling.benchmark_select(df, n).orderBy("turn").collect()] == out
    assert sampling.benchmark_select(df.where("false"), n).count() == 0


def test_hard_and_general_rows(spark):
    import pytest

    from planquarry.operators import sampling

    pool = spark.createDataFrame([(k, ["a"] if k % 10 == 0 else ["b"] if k % 10 == 1 else []) for k in range(60)], "index long, labels array<string>")
    got = sampling.hard_and_general(pool, ["a", "b"], 20, 0.3, 1, "m").collect()
    parts = {p: sorted(x["index"] for x in got if x["part"] == p) for p in ("hard", "general")}
    assert len(parts["hard"]) == 6 and len(parts["general"]) == 14 and not set(parts["hard"]) & set(parts["general"])
    assert sum(k % 10 == 0 for k in parts["hard"]) == 3 and sum(k % 10 == 1 for k in parts["hard"]) == 3
    with pytest.raises(ValueError):
        sampling.hard_and_general(pool, ["a"], 200, 0.1, 1, "m")


def test_holdout_cut_by_bins(spark, monkeypatch):
    """The same rows as a sort of all ranks gives."""
    import hashlib

    from planquarry.operators import sampling

    monkeypatch.setattr(sampling, "SORTED", 2)
    monkeypatch.setattr(sampling, "BINS", 8)
    rank = lambda k: (int.from_bytes(hashlib.sha256(f"5\0holdout\0{k}".encode()).digest()[:8], "big"), k)
    for n, share in ((500, 0.1), (500, 0.97), (3, 0.01), (40, 1.0)):
        got = sampling.holdout(spark.range(n).withColumnRenamed("id", "index").repartition(3), share, 5).collect()
        wanted = sorted(range(n), key=rank)[: max(1, int(n * share))]
        assert len(got) == n and sorted(x["index"] for x in got if x["split"] == "val") == sorted(wanted)
    assert sampling.holdout(spark.range(0).withColumnRenamed("id", "index"), 0.5, 5).count() == 0
