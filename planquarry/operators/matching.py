"""One-to-one matching of predicted and true boxes.

`match` deals both sides by image and works one image at a time on arrays: all overlaps at once, then the order
of choice; drawings of more than MATRIX pairs find only the pairs that overlap (`crowded`). A fold in SQL functions says the same (`candidates`, then `greedy` or an ordered variant) and is there
for candidates that come from elsewhere; it copies its state at every step, so it is for few candidates per image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import crowded

# More pairs of a drawing's boxes than this are not held as one matrix.
MATRIX = 1 << 22
# Coordinates beyond it keep the matrix: areas overflow.
FAR = 1e100


def _overlaps(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """IoU of every box with every other; 0 where the union is empty."""
    w = np.minimum(p[:, None, 2], g[None, :, 2]) - np.maximum(p[:, None, 0], g[None, :, 0])
    h = np.minimum(p[:, None, 3], g[None, :, 3]) - np.maximum(p[:, None, 1], g[None, :, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda b: np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)
    union = area(p)[:, None] + area(g)[None, :] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def _paired(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """IoU of each box with the one beside it."""
    w = np.minimum(p[:, 2], g[:, 2]) - np.maximum(p[:, 0], g[:, 0])
    h = np.minimum(p[:, 3], g[:, 3]) - np.maximum(p[:, 1], g[:, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda b: np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)
    union = area(p) + area(g) - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def _choose(iou: np.ndarray, fine: np.ndarray, same: np.ndarray, how: str) -> list[tuple[int, int]]:
    if how in ("greedy", "label"):
        u, v = np.nonzero(fine)
        score = iou[u, v]
        if how == "label":
            score = np.where(score >= 0.8, 0.5, score * 0.5) + np.where(same[u, v], 0.5, 0.0)
        order = np.lexsort((v, u, -score))
        free_p, free_g, out = bytearray(b"\1" * len(iou)), bytearray(b"\1" * iou.shape[1]), []
        for p, g in zip(u[order].tolist(), v[order].tolist()):
            if free_p[p] and free_g[g]:
                free_p[p] = free_g[g] = 0
                out.append((p, g))
        return out
    left = np.where(fine, iou, -1.0)
    out = []
    if how == "prediction":
        for p in range(len(left)):
            g = int(left[p].argmax())
            if left[p, g] >= 0:
                out.append((p, g))
                left[:, g] = -1
        return out
    for g in range(left.shape[1]):
        column = left[::-1, g]
        p = len(left) - 1 - int(column.argmax())
        if left[p, g] >= 0:
            out.append((p, g))
            left[p] = -1
    return out


def _chosen(a: np.ndarray, b: np.ndarray, cats: list[np.ndarray], known: list[np.ndarray], threshold: float, how: str, same_category: bool, strict: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the matched boxes a (predicted) and b of one drawing; cats, known: codes of both sides' categories, and which are not null."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int)
    if len(a) * len(b) > most and threshold > 1e-6 and all(np.abs(x[crowded.sound(x)]).max(initial=0) < FAR for x in (a, b)):
        usable = [x | (not same_category) for x in known]
        chosen = crowded.choose(a, b, *cats, *usable, threshold, strict, same_category, how)
    else:
        iou = _overlaps(a, b)
        same = cats[0][:, None] == cats[1][None, :]
        fine = (iou > threshold) if strict else (iou >= threshold)
        if same_category:
            fine &= same & known[0][:, None]
        chosen = _choose(iou, fine, same, how)
    u, v = np.array(chosen, int).reshape(-1, 2).T
    return u, v


HOW = ("greedy", "label", "prediction", "truth")


def match(predicted: DataFrame, truth: DataFrame, threshold: float, how: str = "greedy", same_category: bool = True, strict: bool = False) -> DataFrame:
    """Rows (image, p, g, iou, same). how: "greedy" (best overlap of the image first), "label" (overlap and label count
    half each, 0.8 is full), "prediction" or "truth" (each in turn takes its best free partner; of equal ones the first,
    or for "truth" the last). Ties otherwise by position. Positions are unique per image and side; null categories are
    equal to each other only where classes need not agree."""
    if how not in HOW:
        raise ValueError(f"unknown order of choice: {how}")
    kind = dict(predicted.dtypes)["image"]
    most = MATRIX
    flat = lambda df: df.where("box IS NOT NULL").select("image", "pos", "cat", *[F.col("box")[i].alias(f"b{i}") for i in range(4)])

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, g = left.sort_values("pos"), right.sort_values("pos")
        corner = ["b0", "b1", "b2", "b3"]
        a, b = p[corner].to_numpy(float), g[corner].to_numpy(float)
        codes, _ = pd.factorize(pd.concat([p["cat"], g["cat"]]), use_na_sentinel=False)
        cats = [codes[: len(p)], codes[len(p) :]]
        u, v = _chosen(a, b, cats, [x["cat"].notna().to_numpy() for x in (p, g)], threshold, how, same_category, strict, most)
        image = p["image"].iloc[:1].repeat(len(u)).to_numpy()
        return pd.DataFrame({"image": image, "p": p["pos"].to_numpy()[u], "g": g["pos"].to_numpy()[v], "iou": _paired(a[u], b[v]), "same": cats[0][u] == cats[1][v]})

    grouped = flat(predicted).groupBy("image").cogroup(flat(truth).groupBy("image"))
    return grouped.applyInPandas(one, f"image {kind}, p int, g int, iou double, same boolean")


# Bytes of input, as Spark estimates them, that are dealt to one task, and to which this grows before there are more tasks than
# Spark writes a file each for.
DEALT, DEALT_AT_MOST = 2 << 20, 16 << 20


def dealt(rows: DataFrame, key: str = "image") -> DataFrame:
    """Rows dealt by key to as many tasks as their size asks for, at least the session's number, and sorted by it: what a task sorts
    and holds does not grow with the input, and columns that are added later are not sorted."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    conf = rows.sparkSession.conf
    # With more tasks than this Spark's writers hold a split's rows in memory, as many as fit, before they write any.
    straight = int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), min(size // DEALT, max(straight, size // DEALT_AT_MOST), 1 << 14))
    return rows.repartition(parts, key).sortWithinPartitions(key)


def _ranked(rows: pa.Table, order: tuple[str, ...]) -> pa.Table:
    """Rows in Spark's order: null first, NaN last."""
    keys = {}
    for k, name in enumerate(order):
        column = rows[name]
        if pa.types.is_floating(column.type):
            keys[f"{k} nan"] = pc.fill_null(pc.cast(pc.is_nan(column), pa.int8()), -1)
            column = pc.if_else(pc.is_nan(column), pa.scalar(0, column.type), column)
        keys[f"{k}"] = column
    return rows.take(pc.sort_indices(pa.table(keys), sort_keys=[(k, "ascending") for k in keys], null_placement="at_start"))


def _each_drawing(lines: DataFrame, order: tuple[str, ...], threshold: float, how: str, same_category: bool, strict: bool, carried: tuple[str, ...], made, schema: str) -> DataFrame:
    """What `made` finds in each drawing: it gets the ranked lines, the numbers of the lines with either side, the matched rows of these,
    their overlaps, and the codes of both sides' categories, which of them are not null, and the categories of the codes."""
    if how not in HOW:
        raise ValueError(f"unknown order of choice: {how}")
    most = MATRIX
    sides = ("p_box", "p_cat"), ("box", "cat")
    names = list(dict.fromkeys(["image", *order, "cat", "p_cat", *carried]))
    corners = [F.col(box)[i].cast("double").alias(f"{box}{i}") for box, _ in sides for i in range(4)]
    there = [F.col(box).isNotNull().alias(f"{box}?") for box, _ in sides]

    def one(rows: pa.Table) -> pa.Table:
        rows = _ranked(rows.combine_chunks(), order)
        at = [np.flatnonzero(rows[f"{box}?"].to_numpy()) for box, _ in sides]
        a, b = (np.stack([rows[f"{box}{i}"].to_numpy()[k] for i in range(4)], 1) for k, (box, _) in zip(at, sides))
        both = [rows[cat].take(pa.array(k)) for k, (_, cat) in zip(at, sides)]
        known = [pc.is_valid(x).to_numpy() for x in both]
        codes, kinds = pd.factorize(pd.concat([x.to_pandas() for x in both]), use_na_sentinel=False)
        cats = [codes[: len(a)], codes[len(a) :]]
        u, v = _chosen(a, b, cats, known, threshold, how, same_category, strict, most)
        return made(rows, at, (u, v), _paired(a[u], b[v]), cats, known, kinds)

    return lines.select(*names, *corners, *there).groupBy("image").applyInArrow(one, schema)


def match_lines(
    lines: DataFrame, order: tuple[str, ...], threshold: float, how: str = "greedy", same_category: bool = True, strict: bool = False, of_truth: tuple[str, ...] = (), of_predicted: tuple[str, ...] = ()
) -> DataFrame:
    """`match` of drawings whose true and predicted boxes lie side by side: lines (image, cat, box, p_cat, p_box), a side's box null
    where it is missing. The position of either side is the line's rank by `order` in its image, from 1. Spark does not sort a
    drawing's lines; lines from `dealt` are not dealt again. of_truth and of_predicted name columns that matched rows bring along."""
    types = dict(lines.dtypes)

    def made(rows, at, chosen, iou, cats, known, kinds):
        p, g = (k[x] for k, x in zip(at, chosen))
        out = {"image": rows["image"].take(pa.array(p)), "p": pa.array(p + 1, pa.int32()), "g": pa.array(g + 1, pa.int32()), "iou": iou, "same": cats[0][chosen[0]] == cats[1][chosen[1]]}
        out |= {c: rows[c].take(pa.array(k)) for k, carried in ((g, of_truth), (p, of_predicted)) for c in carried}
        return pa.table(out)

    carried = "".join(f", {c} {types[c]}" for c in (*of_truth, *of_predicted))
    schema = f"image {types['image']}, p int, g int, iou double, same boolean{carried}"
    return _each_drawing(lines, order, threshold, how, same_category, strict, (*of_truth, *of_predicted), made, schema)


def line_counts(lines: DataFrame, order: tuple[str, ...], threshold: float, how: str = "greedy", same_category: bool = True, strict: bool = False) -> DataFrame:
    """`counts` of `match_lines` per category `cat`, added up where a drawing is matched: its lines are read once, and no matched row
    leaves it. Rows without category are misses, those of either side in a row of their own."""

    def made(rows, at, chosen, iou, cats, known, kinds):
        n = [np.bincount(c, minlength=len(kinds)) for c in cats]
        of = cats[1][chosen[1]]
        good = (cats[0][chosen[0]] == of) & known[1][chosen[1]]
        tp, total = np.bincount(of[good], minlength=len(kinds)), np.bincount(of[good], iou[good], len(kinds))
        none = np.zeros(len(kinds), np.int64)
        sides = [(kinds[x > 0], np.full((x > 0).sum(), truth), x[x > 0], hits[x > 0], sums[x > 0]) for truth, x, hits, sums in ((True, n[1], tp, total), (False, n[0], none, none * 0.0))]
        kind, *rest = (np.concatenate(x) for x in zip(*sides))
        return pa.table({"cat": pa.array(kind, rows["cat"].type, from_pandas=True), **dict(zip(("truth", "n", "tp", "iou_sum"), map(pa.array, rest)))})

    parts = _each_drawing(lines, order, threshold, how, same_category, strict, (), made, f"cat {dict(lines.dtypes)['cat']}, truth boolean, n long, tp long, iou_sum double")
    side = F.when(F.col("cat").isNull(), F.col("truth"))
    n_p, n_g = (F.sum(F.when(F.col("truth") == t, F.col("n")).otherwise(0)) for t in (False, True))
    tp = F.sum("tp")
    return parts.groupBy("cat", side.alias("side")).agg(tp.alias("tp"), (n_p - tp).alias("fp"), (n_g - tp).alias("fn"), F.sum("iou_sum").alias("iou_sum")).drop("side")


def candidates(predicted: DataFrame, truth: DataFrame, threshold: float, same_category: bool = True, strict: bool = False) -> DataFrame:
    """(image, p, g, iou, same) of pairs that overlap by `threshold` (more than it if strict).

    predicted, truth: (image, pos, cat, box array<double>)."""
    p = predicted.select("image", F.col("pos").alias("p"), F.col("cat").alias("p_cat"), F.col("box").alias("p_box"))
    g = truth.select("image", F.col("pos").alias("g"), F.col("cat").alias("g_cat"), F.col("box").alias("g_box"))
    key = ["image"]
    if same_category:
        p, g, key = p.withColumn("cat", F.col("p_cat")), g.withColumn("cat", F.col("g_cat")), ["image", "cat"]
    over = G.iou(F.col("p_box"), F.col("g_box"))
    pairs = p.join(g, key).select("image", "p", "g", over.alias("iou"), F.col("p_cat").eqNullSafe(F.col("g_cat")).alias("same"))
    return pairs.where(F.col("iou") > threshold if strict else F.col("iou") >= threshold)


def _state() -> Column:
    whole = F.array().cast("array<int>")
    return F.struct(whole.alias("p"), whole.alias("g"), F.array().cast("array<struct<p:int,g:int,iou:double,same:boolean>>").alias("m"))


def _take(s: Column, p: Column, g: Column, iou: Column, same: Column) -> Column:
    row = F.struct(p.alias("p"), g.alias("g"), iou.alias("iou"), same.alias("same"))
    return F.struct(F.array_append(s["p"], p).alias("p"), F.array_append(s["g"], g).alias("g"), F.array_append(s["m"], row).alias("m"))


def _rows(folded: DataFrame) -> DataFrame:
    return folded.select("image", F.explode("m").alias("m")).select("image", "m.p", "m.g", "m.iou", "m.same")


def greedy(pairs: DataFrame, score: Column | None = None) -> DataFrame:
    """Best pairs first, over all of an image's pairs; ties by prediction, then truth. Rows (image, p, g, iou, same)."""
    score = F.col("iou") if score is None else score
    listed = pairs.groupBy("image").agg(F.array_sort(F.collect_list(F.struct((-score).alias("k"), "p", "g", "iou", "same"))).alias("c"))

    def step(s: Column, x: Column) -> Column:
        free = ~F.array_contains(s["p"], x["p"]) & ~F.array_contains(s["g"], x["g"])
        return F.when(free, _take(s, x["p"], x["g"], x["iou"], x["same"])).otherwise(s)

    return _rows(listed.select("image", F.aggregate("c", _state(), step)["m"].alias("m")))


def _one_sided(pairs: DataFrame, first: str, second: str, descending_tie: bool) -> DataFrame:
    tie = -F.col(second) if descending_tie else F.col(second)
    choice = F.struct((-F.col("iou")).alias("k"), tie.alias("t"), F.col("p"), F.col("g"), F.col("iou"), F.col("same"))
    options = pairs.groupBy("image", F.col(first).alias("turn")).agg(F.array_sort(F.collect_list(choice)).alias("o"))
    listed = options.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("turn", "o"))).alias("c"))

    def step(s: Column, x: Column) -> Column:
        free = F.filter(x["o"], lambda o: ~F.array_contains(s[second], o[second]))
        best = F.try_element_at(free, F.lit(1))
        return F.when(F.size(free) > 0, _take(s, best["p"], best["g"], best["iou"], best["same"])).otherwise(s)

    return _rows(listed.select("image", F.aggregate("c", _state(), step)["m"].alias("m")))


def in_prediction_order(pairs: DataFrame) -> DataFrame:
    """Each prediction in turn takes its best free truth; of equal ones the first."""
    return _one_sided(pairs, "p", "g", False)


def in_truth_order(pairs: DataFrame) -> DataFrame:
    """Each truth in turn takes its best free prediction; of equal ones the last."""
    return _one_sided(pairs, "g", "p", True)


def counts(predicted: DataFrame, truth: DataFrame, matches: DataFrame, by: str = "cat") -> DataFrame:
    """Per category: tp, fp, fn, iou_sum. A match of unequal categories is a miss on both sides. Matches that bring the truth's `by`
    along are not joined to it."""
    good = matches.where("same")
    if by not in matches.columns:
        good = good.join(truth.select("image", F.col("pos").alias("g"), by), ["image", "g"])
    tp = good.groupBy(by).agg(F.count(F.lit(1)).alias("tp"), F.sum("iou").alias("iou_sum"))
    n_p = predicted.groupBy(by).agg(F.count(F.lit(1)).alias("n_p"))
    n_g = truth.groupBy(by).agg(F.count(F.lit(1)).alias("n_g"))
    all_ = n_g.join(n_p, by, "full_outer").join(tp, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return all_.select(
        by, zero("tp").alias("tp"), (zero("n_p") - zero("tp")).alias("fp"), (zero("n_g") - zero("tp")).alias("fn"), F.coalesce("iou_sum", F.lit(0.0)).alias("iou_sum")
    )


def assign_to_views(features: DataFrame, views: DataFrame) -> DataFrame:
    """Each feature to the view that holds most of it: score = share of its area inside + 1 if its centre is inside;
    candidates have their centre or a quarter of their area inside; ties to the first view. (image, pos, view or null)."""
    inner, outer = F.col("box"), F.col("view_box")
    inside, share = G.center_in(inner, outer), G.containment(inner, outer)
    v = views.select("image", F.col("pos").alias("view"), F.col("box").alias("view_box"))
    scored = features.join(v, "image").where(inside | (share >= 0.25)).select("image", "pos", "view", (share + inside.cast("int")).alias("score"))
    best = scored.groupBy("image", "pos").agg(F.max_by("view", F.struct("score", -F.col("view"))).alias("view"))
    return features.select("image", "pos").join(best, ["image", "pos"], "left")


def suppress(boxes: DataFrame, threshold: float, priority: str = "priority") -> DataFrame:
    """Of boxes of one class that overlap by `threshold` the one of higher priority stays (ties: first); a kept box
    without size takes the size of what it replaces. boxes: (image, pos, cat, box, size, priority). Works on arrays, one
    image and class at a time; each kept box is compared with those after it."""
    types = dict(boxes.dtypes)
    rows = boxes.select("image", "cat", F.col("pos").cast("int").alias("pos"), F.col("box").cast("array<double>").alias("box"), F.coalesce("size", F.lit("")).alias("size"), (-F.col(priority)).alias("k"), F.col(priority).isNotNull().alias("known"))

    def one(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[("known", "ascending"), ("k", "ascending"), ("pos", "ascending")]))
        corners = np.array([b if b is not None and None not in b else [np.nan] * 4 for b in group["box"].to_pylist()], float)
        sizes = group["size"].to_pylist()
        sized = np.array([s != "" for s in sizes])
        left, kept = np.ones(len(sizes), bool), []
        for k in range(len(sizes)):
            if left[k]:
                kept.append(k)
                same = _overlaps(corners[k : k + 1], corners[k + 1 :])[0] >= threshold
                left[k + 1 :] &= ~same
                if not sized[k] and (same & sized[k + 1 :]).any():
                    sizes[k] = sizes[k + 1 + int((same & sized[k + 1 :]).argmax())]
        out = group.select(["image", "cat", "pos", "box"]).take(kept)
        return out.append_column("size", pa.array([sizes[k] for k in kept], pa.string()))

    return rows.groupBy("image", "cat").applyInArrow(one, f"image {types['image']}, cat {types['cat']}, pos int, box array<double>, size string")


# Classes that are taken for each other, and the overlap from which one of two goes.
ALIKE, ALIKE_OVERLAP = ["Chamfer", "Fillet", "Chamfer Group", "Fillet Group"], 0.7
# End of fixed values.


def suppress_across(boxes: DataFrame) -> DataFrame:
    """Of two boxes of different classes in ALIKE that overlap by more than ALIKE_OVERLAP one goes: that without size, else
    the later one. Boxes take their turn in order; one that has gone takes none. Others stay as they are.
    boxes: (image, pos, cat, box, size); rows without box stay."""
    names = ["image", "pos", "cat", "box", "size"]
    most = MATRIX
    mixed = F.coalesce(F.col("cat").isin(ALIKE) & F.col("box").isNotNull(), F.lit(False))
    rows = boxes.select(*names, mixed.alias("mixed"))

    def one(group: pa.Table) -> pa.Table:
        others = group.filter(pc.invert(group["mixed"])).select(names)
        group = group.filter(group["mixed"]).select(names).combine_chunks()
        group = group.take(pc.sort_indices(group, sort_keys=[("pos", "ascending")]))
        corners = pc.list_flatten(group["box"]).to_numpy().astype(float).reshape(-1, 4)
        codes = pc.index_in(group["cat"], pa.array(ALIKE)).to_numpy().astype(np.int64)
        sized = pc.fill_null(pc.not_equal(group["size"], ""), False).to_numpy()
        if len(codes) ** 2 > most and np.abs(corners[crowded.sound(corners)]).max(initial=0) < FAR:
            left = crowded.rivals_suppressed(corners, codes, sized, ALIKE_OVERLAP)
        else:
            left = np.ones(len(codes), bool)
            for k in range(len(codes)):
                if left[k]:
                    rivals = (_overlaps(corners[k : k + 1], corners[k + 1 :])[0] > ALIKE_OVERLAP) & left[k + 1 :] & (codes[k + 1 :] != codes[k])
                    better = rivals & sized[k + 1 :] & ~sized[k]
                    left[k + 1 :] &= ~rivals | better
                    left[k] = not better.any()
        return pa.concat_tables([group.filter(pa.array(left)), others])

    # Other rows go along with their image: the input is read and dealt once.
    return rows.groupBy("image").applyInArrow(one, boxes.select(*names).schema)
