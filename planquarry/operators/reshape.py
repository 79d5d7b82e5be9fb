"""Other shapes of records: chats of older formats, flat results, names and ground truth out of chats, relabelling,
logs and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vocabulary as V
from .metrics import ratio
from .stages import REGION

PART = "array<struct<type:string,text:string,image:string>>"


def plain_chat(chat: Column) -> Column:
    """struct<messages, images> of a chat whose contents are arrays of parts: texts are joined, an image becomes the mark
    `<image>` and its path goes to `images`. chat: array<struct<role, content array<struct<type, text, image>>>>."""
    said = lambda p: F.when(p["type"] == "image", "<image>").otherwise(F.coalesce(p["text"], F.lit("")))
    texts = F.transform(chat, lambda m: F.struct(m["role"].alias("role"), F.array_join(F.transform(m["content"], said), "").alias("content")))
    parts = F.flatten(F.transform(chat, lambda m: F.coalesce(m["content"], F.array().cast(PART))))
    paths = F.transform(F.filter(parts, lambda p: p["type"] == "image"), lambda p: p["image"])
    return F.struct(texts.alias("messages"), paths.alias("images"))


def rerooted(images: Column, root: str) -> Column:
    return F.transform(images, lambda p: F.concat(F.lit(root.rstrip("/") + "/"), X.basename(p)))


def image_names(*tables: DataFrame) -> DataFrame:
    """Distinct base names in the `images` of several datasets."""
    names = [t.select(F.explode("images").alias("p")).select(X.basename(F.col("p")).alias("image")) for t in tables]
    out = names[0]
    for n in names[1:]:
        out = out.unionByName(n)
    return out.distinct()


def ground_truth(rows: DataFrame) -> DataFrame:
    """(image, views, features): first and second answer of chats with two answers at least; of repeats the last row.
    rows: (pos, images, messages)."""
    answers = F.transform(F.filter("messages", lambda m: F.lower(m["role"]) == "assistant"), lambda m: m["content"])
    flat = rows.select("pos", F.get("images", 0).alias("p"), answers.alias("a")).where("size(a) >= 2 AND p IS NOT NULL")
    named = flat.select(X.basename(F.col("p")).alias("image"), "pos", F.get("a", 0).alias("views"), F.get("a", 1).alias("features"))
    return named.groupBy("image").agg(F.max_by(F.struct("views", "features"), "pos").alias("r")).select("image", "r.*")


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a resumed run reads its results."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def flat_result(documents: Column, views: Column, features: Column) -> Column:
    """One list of (category, size, bbox) of documents, views and features, in this order."""
    item = lambda a: F.struct(a["category"].alias("category"), F.lit("").alias("size"), a["bbox"].alias("bbox"))
    sized = lambda a: F.struct(a["category"].alias("category"), F.coalesce(a["size"], F.lit("")).alias("size"), a["bbox"].alias("bbox"))
    none = F.array().cast("array<struct<category:string,size:string,bbox:array<double>>>")
    of = lambda items, f: F.coalesce(F.transform(items, f), none)
    return F.concat(of(documents, item), of(views, item), of(features, sized))


def stages_of_flat(items: Column) -> Column:
    """struct<regions, views, features> of a flat list: views get ids r001.., documents d001.., others are features."""
    named = F.transform(items, lambda a: F.struct(F.coalesce(V.category(a["category"]), a["category"]).alias("category"), a["size"].alias("size"), a["bbox"].alias("bbox")))

    def routed(all_: Column) -> Column:
        views = F.filter(all_, lambda a: a["category"].isin(V.VIEWS))
        documents = F.filter(all_, lambda a: a["category"].isin(V.DOCUMENTS))
        rest = F.filter(all_, lambda a: ~F.coalesce(a["category"].isin(V.VIEWS + V.DOCUMENTS), F.lit(False)))

        def region(prefix: str, name=None):
            return lambda a, i: F.struct(F.format_string(prefix + "%03d", i + 1).alias("region_id"), (F.lit(name) if name else a["category"]).alias("category"), a["bbox"].alias("bbox"))

        regions = F.concat(F.transform(views, region("r", V.GENERIC)), F.transform(documents, region("d")))
        return F.struct(regions.alias("regions"), F.transform(views, region("r")).alias("views"), rest.alias("features"))

    return G.let(named, routed)


def linked_views(views: Column, regions: Column) -> Column:
    """Views tied to generic regions: an unknown id goes to the free region that overlaps most, else to the first free one;
    a region serves once; the region's box stays. Views of no known category, and those left over, are dropped."""
    generic = F.filter(regions, lambda r: r["category"] == V.GENERIC)
    named = F.transform(views, lambda a: F.struct(F.trim(F.coalesce(a["region_id"], F.lit(""))).alias("id"), V.category(a["category"], "view").alias("category"), a["bbox"].alias("bbox")))
    good = F.filter(named, lambda a: a["category"].isNotNull())

    def step(s: Column, a: Column) -> Column:
        taken = F.transform(s, lambda x: x["region_id"])
        known = F.exists(generic, lambda r: r["region_id"] == a["id"])
        free = F.filter(generic, lambda r: ~F.array_contains(taken, r["region_id"]))
        scored = F.transform(free, lambda r, i: F.struct(G.iou(a["bbox"], r["bbox"]).alias("iou"), r["region_id"].alias("id")))
        best = F.array_max(F.filter(scored, lambda x: x["iou"] > 0))["id"]
        wanted = F.when(known, a["id"]).otherwise(F.coalesce(best, F.get(free, 0)["region_id"]))
        region = F.get(F.filter(free, lambda r: r["region_id"] == wanted), 0)
        row = F.struct(region["region_id"].alias("region_id"), a["category"].alias("category"), region["bbox"].alias("bbox"))
        return F.when(region.isNotNull(), F.array_append(s, row)).otherwise(s)

    return F.aggregate(good, F.array().cast(f"array<{REGION}>"), step)


def scope(values: Column, fallback: list[str]) -> Column:
    """Known feature categories once each, in order; the fallback where none is left."""
    names = F.array_distinct(F.filter(F.transform(values, lambda c: V.category(c, "feature")), lambda c: c.isNotNull()))
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, names).otherwise(F.array(*[F.lit(c) for c in fallback]))


# Spellings of sizes that tell a class.
RADIUS, CHAMFERED, THREAD, FIT = r"^R\d", r"^[CD]\d|x45|45°", r"^M\d|\dxM\d", r"H[67]"
# End of fixed values.


def relabelled(category: Column, size: Column) -> Column:
    """Category as the size tells: radii are fillets, chamfer sizes are chamfers, M sizes in holes are threads, fits are
    pin holes; groups stay groups."""
    group = F.when(F.endswith(category, F.lit(" Group")), " Group").otherwise("")
    base = F.regexp_replace(category, " Group$", "")
    to = (
        F.when((base == "Chamfer") & size.rlike(RADIUS), "Fillet")
        .when((base == "Fillet") & size.rlike(CHAMFERED), "Chamfer")
        .when((base == "Round Hole") & size.rlike(THREAD), "Threaded Hole")
        .when((base == "Round Hole") & size.rlike(FIT), "Pin Hole")
    )
    return F.coalesce(F.concat(to, group), category)


def log_rows(states: DataFrame) -> DataFrame:
    """(run, step, epoch, loss, eval_loss) of trainer states (run, log_history array<struct<..>>)."""
    return states.select("run", F.inline("log_history"))


def focus_score(exact: Column, macro: Column, strict: Column, valid: Column, constrained: Column) -> Column:
    """0.40 exact rate, 0.40 macro F1, 0.10 strict F1, 0.05 readable answers, 0.05 answers without violations."""
    return 0.40 * exact + 0.40 * macro + 0.10 * strict + 0.05 * valid + 0.05 * constrained


def weighted_f1(stats: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Precision, recall and F1 over categories, each count times its category's weight (1 where none is given)."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    w = F.coalesce(F.try_element_at(table, F.col("cat")), F.lit(1.0)) if table is not None else F.lit(1.0)
    tp, fp, fn = (F.sum(w * F.col(c)) for c in ("tp", "fp", "fn"))
    sums = stats.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(p.alias("precision"), r.alias("recall")).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def compared(runs: DataFrame, base: str, values: list[str]) -> DataFrame:
    """Each run's values less those of the run `base`. runs: (label, values..); runs are few."""
    other = runs.where(F.col("label") == base).select(*[F.col(v).alias(f"__{v}") for v in values]).limit(1)
    return runs.crossJoin(F.broadcast(other)).select("label", *values, *[(F.col(v) - F.col(f"__{v}")).alias(f"{v}_change") for v in values])


def mean_arrays(rows: DataFrame, by: str, values: str) -> DataFrame:
    """Element-wise mean of equally long arrays per key."""
    each = rows.select(by, F.posexplode(values).alias("i", "v"))
    return each.groupBy(by, "i").agg(F.avg("v").alias("v")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(values))
