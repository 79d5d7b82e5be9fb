"""Three-stage records of a drawing: regions, views, features; their building, checking, scoring and formatting.

Stage 1: regions array<struct<region_id, category, bbox>>. Stage 2: projection_method and views of the same shape.
Stage 3: feature_scope array<string> (null: everything is in scope; empty: nothing is) and features
array<struct<category, size, bbox, region_id>>. Checks give arrays of messages, empty where all is well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vocabulary as V

REGION = "struct<region_id:string,category:string,bbox:array<double>>"

# Weights of the composite reward, and of channels in the loss.
REWARD = {"format": 0.10, "category": 0.30, "overlap": 0.25, "size": 0.20, "completeness": 0.10, "cross_view": 0.05}
CHANNELS = {"holes": 2.0, "yuanjiao": 1.0, "duyin": 1.0, "default": 1.0}
HOLE, MANY_ROUND, MANY = "圆孔", 8, 14


def targets(annotations: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """(image, regions, projection_method, views, features): targets of each drawing from canonical annotations.

    annotations: (image, cat, size, box). Items stand in reading order (top, left, category); views are regions r001..,
    documents d001..; a drawing without views has null regions and views. methods: (image, methods array<string>)."""
    view, document = F.col("cat").isin(V.VIEWS), F.col("cat").isin(V.DOCUMENTS)
    item = F.struct(F.col("box")[1].alias("y"), F.col("box")[0].alias("x"), "cat", F.coalesce("size", F.lit("")).alias("size"), "box")
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, item)))
    lists = annotations.groupBy("image").agg(pick(view).alias("v"), pick(document).alias("d"), pick(F.col("cat").isin(V.FEATURES)).alias("f"))

    def region(prefix: str, name=None):
        return lambda a, i: F.struct(F.format_string(prefix + "%03d", i + 1).alias("region_id"), (F.lit(name) if name else a["cat"]).alias("category"), a["box"].alias("bbox"))

    regions = F.concat(F.transform("v", region("r", V.GENERIC)), F.transform("d", region("d")))
    some = F.size("v") > 0
    out = lists.select(
        "image",
        F.when(some, regions).alias("regions"),
        F.when(some, F.transform("v", region("r"))).alias("views"),
        F.transform("f", lambda a: F.struct(a["cat"].alias("category"), a["size"].alias("size"), a["box"].alias("bbox"))).alias("features"),
    )
    if methods is None:
        return out.withColumn("projection_method", F.lit("unknown"))
    from .records import projection_of

    known = methods.select("image", projection_of(F.col("methods")).alias("projection_method"))
    return out.join(known, "image", "left").withColumn("projection_method", F.coalesce("projection_method", F.lit("unknown")))


def messages(prompts: tuple[str, str, str], image: str = "image") -> Column:
    """A target row as chat messages: three questions with answers, or the last one only where there are no views."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    one = F.to_json(F.struct(F.col("regions").alias("regions")))
    two = F.to_json(F.struct("projection_method", "views"))
    three = F.to_json(F.struct("feature_scope", "features"), {"ignoreNullFields": "false"})
    ask = [F.lit(p) for p in prompts]
    whole = F.array(*[say(r, t) for r, t in (("user", ask[0]), ("assistant", one), ("user", ask[1]), ("assistant", two), ("user", ask[2]), ("assistant", three))])
    return F.when(F.col("regions").isNotNull(), whole).otherwise(F.array(say("user", ask[2]), say("assistant", three)))


def row_kind(chat: Column) -> Column:
    """three_stage, feature_only or invalid, by the order of roles; a leading system message is allowed."""
    roles = F.transform(chat, lambda m: m["role"])
    body = F.filter(roles, lambda r: r != "system")
    turns = lambda n: F.array(*[F.lit(x) for x in ("user", "assistant") * n])
    lead = F.coalesce(F.size(roles) - F.size(body) <= 1, F.lit(False))
    return F.when(lead & (body == turns(3)), "three_stage").when(lead & (body == turns(1)), "feature_only").otherwise("invalid")


def layout_scope(content: Column, fields: str = "views array<string>, documents array<string>") -> Column:
    """The JSON after the last `layout_scope=` of a prompt, whatever follows it."""
    return F.when(F.contains(content, F.lit("layout_scope=")), F.from_json(F.substring_index(content, "layout_scope=", -1), fields))


def before_answer(chat: Column) -> Column:
    """Messages up to the first answer."""
    at = F.array_position(F.transform(chat, lambda m: m["role"]), F.lit("assistant"))
    return F.when(at > 0, F.slice(chat, F.lit(1), (at - 1).cast("int"))).otherwise(chat)


def _messages(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def _each(items: Column, name: str, checks) -> Column:
    """Messages of all items, each after its place; checks(item) lists (is bad, what)."""

    def one(a: Column, i: Column) -> Column:
        return _messages(*[F.when(F.coalesce(bad, F.lit(True)), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"] {what}"))) for bad, what in checks(a)])

    return F.coalesce(F.flatten(F.transform(items, one)), F.array().cast("array<string>"))


def _repeated(items: Column) -> Column:
    ids = F.filter(F.transform(items, lambda a: F.trim(a["region_id"])), lambda x: x != "")
    return F.size(ids) > F.size(F.array_distinct(ids))


def check_regions(regions: Column) -> Column:
    whole = _messages(F.when(regions.isNull(), "regions must be a list"), F.when(_repeated(regions), "repeated region_id"))
    return F.concat(whole, _each(regions, "regions", lambda a: [
        (F.coalesce(F.trim(a["region_id"]), F.lit("")) == "", "needs region_id"),
        (V.category(a["category"], "region").isNull(), "has no allowed category"),
        (~G.valid(a["bbox"]), "has no valid bbox"),
    ]))


def check_views(method: Column, views: Column) -> Column:
    whole = _messages(
        F.when(V.projection(method).isNull(), "unknown projection_method"), F.when(views.isNull(), "views must be a list"), F.when(_repeated(views), "repeated region_id")
    )
    return F.concat(whole, _each(views, "views", lambda a: [
        (F.coalesce(F.trim(a["region_id"]), F.lit("")) == "", "needs region_id"),
        (V.category(a["category"], "view").isNull(), "has no allowed category"),
        (a["bbox"].isNotNull() & ~G.valid(a["bbox"]), "has no valid bbox"),
    ]))


def check_features(scope: Column, features: Column) -> Column:
    names = F.transform(scope, lambda c: V.category(c, "feature"))
    known = F.array_distinct(F.filter(names, lambda c: c.isNotNull()))
    whole = _messages(
        F.when(scope.isNull(), "feature_scope must be a list"),
        F.when(F.exists(names, lambda c: c.isNull()), "unknown category in feature_scope"),
        F.when(F.size(known) != F.size(scope), "repeated or unknown categories in feature_scope"),
        F.when(features.isNull(), "features must be a list"),
    )
    outside = lambda c: F.coalesce((F.size(known) > 0) & c.isNotNull() & ~F.array_contains(known, c), F.lit(False))
    return F.concat(whole, _each(features, "features", lambda a: [
        (V.category(a["category"], "feature").isNull(), "has no allowed category"),
        (outside(V.category(a["category"], "feature")), "is outside feature_scope"),
        (a["size"].isNull(), "needs a size, empty or not"),
        (~G.valid(a["bbox"]), "has no valid bbox"),
    ]))


def check_across(regions: Column, views: Column, features: Column) -> Column:
    """References between stages: generic regions and views name the same ids; features name ids that exist."""
    ids = lambda items: F.array_distinct(F.filter(F.transform(items, lambda a: F.trim(a["region_id"])), lambda x: x != ""))
    own = ids(F.filter(regions, lambda a: V.category(a["category"], "region") == V.GENERIC))
    seen = ids(views)
    told = lambda what, left: F.when(F.size(left) > 0, F.concat(F.lit(what), F.array_join(F.array_sort(left), ", ")))
    allowed = F.coalesce(own, seen)
    wrong = F.array_except(ids(features), allowed)
    return _messages(
        F.when(own.isNotNull() & seen.isNotNull(), told("regions without view: ", F.array_except(own, seen))),
        F.when(own.isNotNull() & seen.isNotNull(), told("views without region: ", F.array_except(seen, own))),
        F.when(allowed.isNotNull(), told("features of unknown regions: ", wrong)),
    )


def clean_regions(regions: Column) -> Column:
    """Regions with canonical category and whole-number box; others go; missing or repeated ids get the first free r###."""
    named = F.transform(
        regions, lambda a: F.struct(F.trim(F.coalesce(a["region_id"], F.lit(""))).alias("region_id"), V.category(a["category"], "region").alias("category"), G.normalize(G.box(a["bbox"])).alias("bbox"))
    )
    good = F.filter(named, lambda a: a["category"].isNotNull() & a["bbox"].isNotNull())

    def step(s: Column, a: Column) -> Column:
        taken = F.transform(s, lambda x: x["region_id"])
        spare = F.filter(F.transform(F.sequence(F.lit(1), F.size(s) + 1), lambda i: F.format_string("r%03d", i)), lambda x: ~F.array_contains(taken, x))
        fresh = (a["region_id"] != "") & ~F.array_contains(taken, a["region_id"])
        return F.array_append(s, F.struct(F.when(fresh, a["region_id"]).otherwise(F.get(spare, 0)).alias("region_id"), a["category"].alias("category"), a["bbox"].alias("bbox")))

    return F.aggregate(good, F.array().cast(f"array<{REGION}>"), step)


def noisy_boxes(boxes: Column, seed: int, key: Column, most: int = 8) -> Column:
    """Boxes moved by up to `most` per side, drawn from a hash of seed, key and place; clamped and kept open."""

    def moved(b: Column, i: Column) -> Column:
        shift = lambda j: F.pmod(F.xxhash64(F.lit(seed), key, i, F.lit(j)), F.lit(2 * most + 1)) - most
        at = lambda j: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), b[j] + shift(j)))
        open_ = lambda s: F.array(s[0], s[1], F.greatest(s[2], F.least(s[0] + 1, F.lit(1000.0))), F.greatest(s[3], F.least(s[1] + 1, F.lit(1000.0))))
        return G.let(F.array(*[at(j) for j in range(4)]), open_)

    return F.transform(boxes, moved)


def cross_view(features: DataFrame, views: DataFrame) -> DataFrame:
    """(image, share): share of a drawing's features whose centre, or half of whose area, lies in one of its views."""
    v = views.select("image", F.col("box").alias("v"))
    inside = G.center_in(F.col("box"), F.col("v")) | (G.containment(F.col("box"), F.col("v")) >= 0.5)
    held = features.join(v, "image").where(inside).select("image", "pos").distinct().withColumn("held", F.lit(1))
    return features.join(held, ["image", "pos"], "left").groupBy("image").agg(F.avg(F.coalesce("held", F.lit(0))).alias("share"))


def reward(category: Column, overlap: Column, size: Column, completeness: Column, cross: Column, parsed: Column, empty: Column) -> Column:
    """Weighted sum of the parts; 0 for an answer that can't be read, 1 where there is nothing to find and nothing found."""
    parts = {"category": category, "overlap": overlap, "size": size, "completeness": completeness, "cross_view": cross}
    total = F.lit(REWARD["format"])
    for name, part in parts.items():
        total = total + REWARD[name] * part
    return F.when(~parsed, 0.0).when(empty, 1.0).otherwise(total)


def loss_weight(channel: Column, objects: Column) -> Column:
    """Weight of an answer: by channel for holes, two more for many round holes or many objects; else 1."""
    rounds = F.size(F.filter(objects, lambda x: x == HOLE))
    busy = F.coalesce((rounds >= MANY_ROUND) | (F.size(objects) >= MANY), F.lit(False))
    return F.when(channel == "holes", CHANNELS["holes"] + F.when(busy, 2.0).otherwise(0.0)).otherwise(1.0)


def channel_of(categories: Column) -> Column:
    """holes if a drawing has any, else yuanjiao for fillets, else default."""
    has = lambda word: F.exists(categories, lambda c: F.contains(c, F.lit(word)))
    return F.when(has("Hole"), "holes").when(has("Fillet"), "yuanjiao").otherwise("default")


def scope_suffix(instruction: Column, views: Column, documents: Column) -> Column:
    """What a prompt says about the categories that were annotated: an instruction, then the scope as `layout_scope` reads it."""
    scope = F.to_json(F.struct(views.alias("view_scope"), documents.alias("document_scope")))
    return F.concat(F.lit("\n"), instruction, F.lit("\nlayout_scope="), scope)


def of_categories(items: Column, names: list[str]) -> Column:
    """Items of these categories."""
    return F.filter(items, lambda a: F.coalesce(a["category"].isin(names), F.lit(False)))


def scoped_regions(regions: Column, views: Column, allowed: list[str]) -> Column:
    """Regions without the generic ones whose view is known and not allowed; those without a view stay. Of several views
    of a region the last one counts."""
    named = F.filter(views, lambda v: F.coalesce(v["region_id"], F.lit("")) != "")

    def inside(r: Column) -> Column:
        own = F.filter(named, lambda v: v["region_id"] == r["region_id"])
        known = F.coalesce(F.size(own), F.lit(0)) > 0
        fine = F.coalesce(F.try_element_at(own, F.lit(-1))["category"].isin(allowed), F.lit(False))
        return ~(F.coalesce(r["category"] == V.GENERIC, F.lit(False)) & known & ~fine)

    return F.filter(regions, inside)


def format_reward(parsed: Column) -> Column:
    """1 for an answer that could be read, else 0."""
    return F.when(parsed.isNotNull(), 1.0).otherwise(0.0)


def answer_lengths(chat: Column) -> Column:
    """Signs of each answer of a chat, in order."""
    return F.transform(F.filter(chat, lambda m: m["role"] == "assistant"), lambda m: F.length(F.coalesce(m["content"], F.lit(""))))
