"""Queries on keys, boxes, chats, readers and sinks, scopes and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import keys as N
from ..operators import matching as M
from ..operators import metrics as S
from ..operators import reshape as R
from ..operators import retrieval as Q
from ..operators import sampling as B
from ..operators import stages as T
from ..sources import readers, sinks
from ..sources.shared import shared_path
from ..sources.tables import table
from .boxes import BASE, boxes, for_duckdb

QUERIES, ORACLE_SQL = {}, {}
_BASE = "WITH " + for_duckdb(BASE)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# Keys and labels


@query(
    "record_keys",
    """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN concat('s', c_custkey % 40) END AS s, concat('i', c_custkey) AS i, concat('x', c_custkey % 50, '.png') AS f FROM customer)
SELECT c_custkey, concat_ws('|', s, i, concat('d/e/', f), f) AS keys, coalesce(s, i) AS primary_id, CASE WHEN s IS NULL THEN concat('image:d/e/', f) ELSE concat('sample_id:', s) END AS shard FROM t""",
)
def record_keys(spark, sf):
    k = F.col("c_custkey")
    sample = F.when(k % 3 > 0, F.concat(F.lit("s"), k % 40)).otherwise(F.lit("  "))
    image = F.concat(F.lit("d/e/x"), k % 50, F.lit(".png"))
    rows = table(spark, sf, "customer").select("c_custkey", sample.alias("sample"), F.concat(F.lit(" i"), k, F.lit(" ")).alias("id"), F.array(image, N.file_name(image)).alias("images"))
    keys = N.record_keys([F.col("sample"), F.col("id"), F.lit(None)], F.col("images"))
    shard = N.shard_key({"sample_id": F.col("sample"), "image": F.get("images", 0)})
    return rows.select("c_custkey", F.array_join(keys, "|").alias("keys"), N.primary_id(keys, F.lit("none")).alias("primary_id"), shard.alias("shard"))


@query(
    "splits_and_checkpoints",
    """SELECT p_partkey, ['test', 'val', 'val', 'train'][p_partkey % 4 + 1] AS split,
 CASE WHEN p_partkey % 2 = 0 THEN concat('run/', p_partkey % 4, '/checkpoint-', p_partkey) ELSE concat(p_partkey % 4, '/checkpoint-', p_partkey) END AS label,
 concat(p_brand, '_', CASE WHEN p_size % 2 = 0 THEN '' ELSE p_size::VARCHAR END) AS label_size FROM part""",
)
def splits_and_checkpoints(spark, sf):
    k = F.col("p_partkey")
    file = F.concat(F.lit("train/x_"), F.element_at(F.array(*[F.lit(x) for x in ("TESTset", "my-validation", "dev", "rest")]), (k % 4 + 1).cast("int")), F.lit(".jsonl"))
    path = F.concat(F.when(k % 2 == 0, "/models/run/").otherwise("/other/"), k % 4, F.lit("/checkpoint-"), k)
    size = F.when(F.col("p_size") % 2 == 1, F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey", N.split_of(file).alias("split"), N.checkpoint_label(path, "/models").alias("label"), N.label_size(F.col("p_brand"), size).alias("label_size")
    )


_TWO = V.VIEWS[:3], V.FEATURES[:5]


def _picked(k, names, of: int):
    """Names by the bits of k."""
    return F.filter(F.array(*[F.when(F.shiftright(k % of, i) % 2 == 1, F.lit(c)) for i, c in enumerate(names)]), lambda c: c.isNotNull())


def _picked_sql(names, of: int, prefix: str = "") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN ((p_partkey % {of}) >> {i}) % 2 = 1 THEN '{prefix}{c}' END" for i, c in enumerate(names)) + "], lambda x: x IS NOT NULL)"


@query(
    "scopes_of_rows",
    f"""SELECT p_partkey, array_to_string(list_concat({_picked_sql(_TWO[0], 8, 'view:')}, {_picked_sql(_TWO[1], 32, 'feature:')}), '|') AS tokens,
 len(list_intersect({_picked_sql(_TWO[1], 32)}, ['{_TWO[1][1]}', '{_TWO[1][4]}'])) > 0 AS rare,
 concat(chr(10), 'only these', chr(10), 'layout_scope=', '{{"view_scope":[', array_to_string(list_transform({_picked_sql(_TWO[0], 8)}, lambda x: concat('"', x, '"')), ','), '],"document_scope":["Notes"]}}') AS suffix,
 len({_picked_sql(_TWO[0], 8)})::INT AS read_back, len({_picked_sql([*_TWO[1][:1], 'zzz', *_TWO[1][2:]], 32)}) - CASE WHEN ((p_partkey % 32) >> 1) % 2 = 1 THEN 1 ELSE 0 END AS known FROM part""",
)
def scopes_of_rows(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", _picked(k, _TWO[0], 8).alias("v"), _picked(k, _TWO[1], 32).alias("f"), _picked(k, [*_TWO[1][:1], "zzz", *_TWO[1][2:]], 32).alias("g"))
    suffix = T.scope_suffix(F.lit("only these"), F.col("v"), F.array(F.lit("Notes")))
    known = F.filter(R.scope(F.col("g"), []), lambda c: c.isNotNull())
    return rows.select(
        "p_partkey",
        F.array_join(N.tokens(F.col("v"), F.col("f")), "|").alias("tokens"),
        F.arrays_overlap("f", F.array(F.lit(_TWO[1][1]), F.lit(_TWO[1][4]))).alias("rare"),
        suffix.alias("suffix"),
        F.size(T.layout_scope(suffix, "view_scope array<string>, document_scope array<string>")["view_scope"]).alias("read_back"),
        F.size(known).cast("long").alias("known"),
    )


@query(
    "projections_and_stems",
    """SELECT p_partkey, ['first_angle', 'third_angle', 'unknown', NULL][p_partkey % 4 + 1] AS projection, CASE WHEN p_partkey % 5 = 0 THEN 'image' ELSE concat('a_b_', p_partkey, '.c') END AS stem,
 replace(concat(p_partkey % 7 + 1, '.', p_partkey % 9 + 1), ' ', '') AS number FROM part""",
)
def projections_and_stems(spark, sf):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("First  Angle_Projection", "第三角投影", " ", "fourth")]), (k % 4 + 1).cast("int"))
    stem = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("a /b "), k, F.lit(".c")))
    return table(spark, sf, "part").select(
        "p_partkey", V.projection(name).alias("projection"), X.safe_stem(stem).alias("stem"), X.number(F.concat(k % 7 + 1, F.lit("."), k % 9 + 1, F.lit("00"))).alias("number")
    )


# Boxes


@query(
    "boxes_moved",
    _BASE
    + """, t AS (SELECT *, x1::DOUBLE AS a, y1::DOUBLE AS b, (x1 + w)::DOUBLE AS c, (y1 + h)::DOUBLE AS d, CAST('0.1' AS DOUBLE) AS p FROM gt)
SELECT CAST(image AS BIGINT) AS image, pos, round_even(greatest(0, a - (c - a) * p), 0) AS ex1, round_even(least(1000, d + (d - b) * p), 0) AS ey2,
 CAST(trunc(greatest(0, least(1280.0::DOUBLE, a / 1000 * 1280 - 1280 * CAST('0.01' AS DOUBLE)))) AS INT) AS dx1, CAST(trunc(greatest(0, least(960.0::DOUBLE, d / 1000 * 960 + 960 * CAST('0.01' AS DOUBLE)))) AS INT) AS dy2,
 (a + c) / 2 AS cx, (b + d) / 2 AS cy, a AS ox1, d AS oy2 FROM t""",
)
def boxes_moved(spark, sf):
    """Boxes padded, in pixels of a drawing, their centres, and in order after their corners were swapped."""
    _, truth = boxes(spark, sf)
    b = F.col("box")
    wide, pixels, middle = G.expand(b), G.denormalize(b, F.lit(1280), F.lit(960), 0.01), G.center(b)
    back = G.ordered(F.array(b[2], b[1], b[0], b[3]))
    return truth.select(
        "image", "pos", wide[0].alias("ex1"), wide[3].alias("ey2"), pixels[0].alias("dx1"), pixels[3].alias("dy2"), middle["x"].alias("cx"), middle["y"].alias("cy"),
        back[0].alias("ox1"), back[3].alias("oy2"),
    )


@query(
    "boxes_in_crops",
    _BASE
    + """, t AS (SELECT image, pos, greatest(0, least(1000, (x1 - 50.0) / 300 * 1000)) AS a, greatest(0, least(1000, (y1 - 50.0) / 300 * 1000)) AS b,
 greatest(0, least(1000, (x1 + w - 50.0) / 300 * 1000)) AS c, greatest(0, least(1000, (y1 + h - 50.0) / 300 * 1000)) AS d FROM gt)
SELECT CAST(image AS BIGINT) AS image, pos, CASE WHEN fine THEN round_even(a, 0) END AS x1, CASE WHEN fine THEN round_even(d, 0) END AS y2, fine FROM (SELECT *, a < c AND b < d AS fine FROM t)""",
)
def boxes_in_crops(spark, sf):
    """Boxes of a drawing in its crop 50..350; those that lie outside are null."""
    _, truth = boxes(spark, sf)
    own = G.global_to_crop(F.col("box"), F.array(*[F.lit(float(v)) for v in (50, 50, 350, 350)]))
    return truth.select("image", "pos", own[0].alias("x1"), own[3].alias("y2"), own.isNotNull().alias("fine"))


@query(
    "boxes_repaired",
    _BASE
    + """, t AS (SELECT image, pos, round_even(least(x1 / 250.0, 1.0) * 1000, 0) AS a, round_even(least((x1 + w * (pos % 2)) / 250.0, 1.0) * 1000, 0) AS c FROM gt),
u AS (SELECT *, CASE WHEN c <= a THEN least(a + 1, 1000) ELSE c END AS up FROM t)
SELECT CAST(image AS BIGINT) AS image, pos, CASE WHEN up <= a AND a > 0 THEN a - 1 ELSE a END AS x1, up AS x2, c AS plain FROM u""",
)
def boxes_repaired(spark, sf):
    """Boxes of a drawing 250 wide; every other one has no width and is widened by one."""
    _, truth = boxes(spark, sf)
    b, side = F.col("box"), F.lit(250)
    flat = F.array(b[0], b[1], F.when(F.col("pos") % 2 == 1, b[2]).otherwise(b[0]), b[3])
    fixed, plain = G.normalize_repaired(flat, side, side), G.normalize_repaired(flat, side, side, "none")
    return truth.select("image", "pos", fixed[0].alias("x1"), fixed[2].alias("x2"), plain[2].alias("plain"))


@query(
    "categories_relabelled",
    """WITH t AS (SELECT p_partkey, ['Chamfer', 'Fillet Group', 'Round Hole', 'Round Hole Group', 'Pin Hole'][p_partkey % 5 + 1] AS cat, ['R5', 'C2', 'M6', '4xM8', 'Ø5H7', ''][p_partkey % 6 + 1] AS size FROM part)
SELECT p_partkey, cat, size, CASE WHEN cat = 'Chamfer' AND size = 'R5' THEN 'Fillet' WHEN cat = 'Fillet Group' AND size = 'C2' THEN 'Chamfer Group'
 WHEN cat LIKE 'Round Hole%' AND size IN ('M6', '4xM8') THEN replace(cat, 'Round', 'Threaded') WHEN cat LIKE 'Round Hole%' AND size = 'Ø5H7' THEN replace(cat, 'Round', 'Pin') ELSE cat END AS told FROM t""",
)
def categories_relabelled(spark, sf):
    k = F.col("p_partkey")
    pick = lambda names: F.element_at(F.array(*[F.lit(c) for c in names]), (k % len(names) + 1).cast("int"))
    cat, size = pick(["Chamfer", "Fillet Group", "Round Hole", "Round Hole Group", "Pin Hole"]), pick(["R5", "C2", "M6", "4xM8", "Ø5H7", ""])
    return table(spark, sf, "part").select("p_partkey", cat.alias("cat"), size.alias("size"), R.relabelled(cat, size).alias("told"))


@query("chamfers_against_fillets")
def chamfers_against_fillets(spark, sf):
    """Boxes of the drawings as chamfers, fillets and holes, a copy of each of another class beside it; one of two alike goes."""
    _, truth = boxes(spark, sf)
    pick = lambda n: F.element_at(F.array(*[F.lit(c) for c in ("Chamfer", "Fillet", "Fillet Group", "Round Hole")]), (n % 4 + 1).cast("int"))
    size = F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("size"))
    one = F.struct((F.col("pos") * 2).alias("pos"), pick(F.col("pos")).alias("cat"), F.col("box"), size.alias("size"))
    two = F.struct((F.col("pos") * 2 + 1).alias("pos"), pick(F.col("pos") + 1).alias("cat"), F.transform("box", lambda v: v + 1).alias("box"), F.col("size"))
    both = truth.select("image", F.explode(F.array(one, two)).alias("b")).select("image", "b.*")
    return M.suppress_across(both).select("image", "pos", "cat")


# Metrics


_SHIP = """s AS (SELECT concat('c', l_linenumber) AS cat, count(*) FILTER (l_returnflag = 'N') AS tp, count(*) FILTER (l_returnflag = 'R') AS fp, count(*) FILTER (l_returnflag = 'A') AS fn FROM lineitem GROUP BY 1)"""


def _ship(spark, sf):
    n = lambda f: F.sum((F.col("l_returnflag") == f).cast("long"))
    return table(spark, sf, "lineitem").groupBy(F.concat(F.lit("c"), "l_linenumber").alias("cat")).agg(n("N").alias("tp"), n("R").alias("fp"), n("A").alias("fn"))


@query(
    "weighted_f1",
    f"""WITH {_SHIP}, w AS (SELECT sum(k * tp) AS tp, sum(k * fp) AS fp, sum(k * fn) AS fn FROM (SELECT *, CASE cat WHEN 'c1' THEN 3.0::DOUBLE WHEN 'c2' THEN 0.5 ELSE 1 END AS k FROM s))
SELECT round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM w""",
)
def weighted_f1(spark, sf):
    out = R.weighted_f1(_ship(spark, sf), {"c1": 3.0, "c2": 0.5})
    return out.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "runs_compared",
    f"WITH {_SHIP}, b AS (SELECT tp, fp FROM s WHERE cat = 'c1') SELECT s.cat AS label, s.tp AS tp, s.fp AS fp, s.tp - b.tp AS tp_change, s.fp - b.fp AS fp_change FROM s, b",
)
def runs_compared(spark, sf):
    return R.compared(_ship(spark, sf).withColumnRenamed("cat", "label"), "c1", ["tp", "fp"])


@query(
    "exact_rates",
    "SELECT p_brand AS cat, count(*) FILTER (p_size > 20) AS passed, count(*) AS total, count(*) FILTER (p_size > 20) / count(*) AS rate FROM part GROUP BY 1",
)
def exact_rates(spark, sf):
    return S.exact_rates(table(spark, sf, "part").select(F.col("p_brand").alias("cat"), (F.col("p_size") > 20).alias("exact")))


@query(
    "mean_vectors",
    """WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
SELECT label, CAST(i AS INT) AS i, round(avg(v::DOUBLE), 6) AS mean FROM e GROUP BY label, i""",
)
def mean_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return R.mean_arrays(rows, "label", "v").select("label", F.posexplode("v").alias("i", "mean")).select("label", "i", F.round("mean", 6).alias("mean"))


@query(
    "rewards",
    """WITH t AS (SELECT p_partkey, (p_size % 10) / 10.0::DOUBLE AS a, (p_partkey % 7) / 7.0::DOUBLE AS b FROM part)
SELECT p_partkey, round(CASE WHEN p_partkey % 11 = 0 THEN 0.0 WHEN p_partkey % 13 = 0 THEN 1.0 ELSE 0.1 + 0.3 * a + 0.25 * b + 0.2 * a + 0.1 * b + 0.05 END, 9)::DOUBLE AS reward,
 CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS format FROM t""",
)
def rewards(spark, sf):
    k = F.col("p_partkey")
    a, b = F.col("p_size") % 10 / F.lit(10.0), k % 7 / F.lit(7.0)
    total = T.reward(a, b, a, b, F.lit(1.0), k % 11 != 0, k % 13 == 0)
    return table(spark, sf, "part").select("p_partkey", F.round(total, 9).alias("reward"), T.format_reward(F.when(k % 11 != 0, F.lit("x"))).alias("format"))


# Chats


def _chats(spark, sf):
    """(conv_id, messages array<struct<role, content>>) in the order of turns."""
    rows = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")).alias("m"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return listed.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


_CHATS = "c AS (SELECT conv_id, list(struct_pack(t := turn, r := role, c := coalesce(text, '')) ORDER BY turn, role, coalesce(text, '')) AS m FROM conversations GROUP BY conv_id)"


@query(
    "chats_by_kind",
    f"""WITH {_CHATS}, r AS (SELECT conv_id, m, list_transform(m, lambda x: x.r) AS roles, list_filter(list_transform(m, lambda x: x.r), lambda x: x <> 'system') AS body FROM c)
SELECT conv_id, CASE WHEN len(roles) - len(body) > 1 THEN 'invalid' WHEN body = ['user', 'assistant', 'user', 'assistant', 'user', 'assistant'] THEN 'three_stage' WHEN body = ['user', 'assistant'] THEN 'feature_only' ELSE 'invalid' END AS kind,
 CAST(CASE WHEN list_position(roles, 'assistant') > 0 THEN list_position(roles, 'assistant') - 1 ELSE len(roles) END AS INT) AS asked,
 array_to_string(list_transform(list_filter(m, lambda x: x.r = 'assistant'), lambda x: length(x.c)::VARCHAR), ',') AS lengths FROM r""",
)
def chats_by_kind(spark, sf):
    c = F.col("messages")
    return _chats(spark, sf).select(
        "conv_id", T.row_kind(c).alias("kind"), F.size(T.before_answer(c)).alias("asked"), F.array_join(T.answer_lengths(c).cast("array<string>"), ",").alias("lengths")
    )


@query(
    "chats_of_parts",
    f"""WITH {_CHATS} SELECT conv_id, sha256(array_to_string(list_transform(m, lambda x: concat('<image>', x.c)), '|')) AS digest, len(m)::INT AS n_images, concat('/new/', conv_id, '.png') AS first_image FROM c""",
)
def chats_of_parts(spark, sf):
    """Chats whose contents are an image and a text, as plain texts with a list of images."""
    part = lambda kind, text, image: F.struct(F.lit(kind).alias("type"), text.alias("text"), image.alias("image"))
    path, none = F.concat(F.lit("old/"), F.col("conv_id"), F.lit(".png")), F.lit(None).cast("string")
    parts = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.array(part("image", none, path), part("text", m["content"], none)).alias("content")))
    plain = _chats(spark, sf).select("conv_id", R.plain_chat(parts).alias("p"))
    body = F.array_join(F.transform("p.messages", lambda m: m["content"]), "|")
    return plain.select("conv_id", F.sha2(body.cast("binary"), 256).alias("digest"), F.size("p.images").alias("n_images"), F.get(R.rerooted(F.col("p.images"), "/new/"), 0).alias("first_image"))


@query(
    "truth_of_chats",
    f"""WITH {_CHATS}, a AS (SELECT conv_id, list_transform(list_filter(m, lambda x: x.r = 'assistant'), lambda x: x.c) AS a FROM c),
k AS (SELECT concat('i', conv_id % 97, '.png') AS image, arg_max(a, conv_id) AS a FROM a WHERE len(a) >= 2 GROUP BY 1) SELECT image, sha256(a[1]) AS views, sha256(a[2]) AS features FROM k""",
)
def truth_of_chats(spark, sf):
    image = F.array(F.concat(F.lit("a/i"), F.col("conv_id") % 97, F.lit(".png")))
    rows = _chats(spark, sf).select(F.col("conv_id").alias("pos"), image.alias("images"), "messages")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(c)
    return R.ground_truth(rows).select("image", digest("views"), digest("features"))


@query(
    "results_resumed",
    "SELECT o_custkey AS key, max(o_orderkey) AS ord, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey",
)
def results_resumed(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
    return R.last_per_key(rows, "key", "ord").select("key", "ord", "status")


@query("images_known", "SELECT DISTINCT concat('i', c_custkey % 60, '.png') AS image FROM customer UNION SELECT concat('s', s_suppkey, '.png') FROM supplier")
def images_known(spark, sf):
    a = table(spark, sf, "customer").select(F.array(F.concat(F.lit("a/b/i"), F.col("c_custkey") % 60, F.lit(".png"))).alias("images"))
    b = table(spark, sf, "supplier").select(F.array(F.concat(F.lit("c\\s"), F.col("s_suppkey"), F.lit(".png"))).alias("images"))
    return R.image_names(a, b)


@query(
    "images_resolved",
    """SELECT concat('i', p_partkey) AS image, CASE WHEN p_partkey % 3 = 0 THEN 640 WHEN p_partkey % 3 = 1 THEN p_size END::INT AS width, CASE WHEN p_partkey % 3 = 0 THEN 480 WHEN p_partkey % 3 = 1 THEN p_size + 1 END::INT AS height,
 ['local', 'metadata_only', 'missing'][p_partkey % 3 + 1] AS status FROM part""",
)
def images_resolved(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    image = F.concat(F.lit("i"), k).alias("image")
    items = table(spark, sf, "part").select(image, F.when(k % 3 < 2, size).alias("width"), F.when(k % 3 < 2, (size + 1).cast("int")).alias("height"))
    files = table(spark, sf, "part").where(k % 3 == 0).select(image, F.concat(F.lit("d/"), k).alias("path"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return readers.resolved_images(items, files)


# Stages


_KINDS = [V.VIEWS[0], V.DOCUMENTS[0], V.FEATURES[0], "odd one"]


@query(
    "flat_lists",
    _BASE
    + """ SELECT CAST(image AS BIGINT) AS image, count(*)::INT AS n_flat, (count(*) FILTER (pos % 4 IN (0, 1)))::INT AS n_regions, (count(*) FILTER (pos % 4 = 0))::INT AS n_views, (count(*) FILTER (pos % 4 IN (2, 3)))::INT AS n_features,
 printf('d%03d', count(*) FILTER (pos % 4 = 1)) AS last_id FROM gt GROUP BY image""",
)
def flat_lists(spark, sf):
    """Flat lists to stages and back."""
    _, truth = boxes(spark, sf)
    name = F.element_at(F.array(*[F.lit(c) for c in _KINDS]), (F.col("pos") % 4 + 1).cast("int"))
    item = F.struct("pos", name.alias("category"), "size", F.col("box").alias("bbox"))
    rows = truth.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.select("image", F.transform("items", lambda a: F.struct(a["category"].alias("category"), a["size"].alias("size"), a["bbox"].alias("bbox"))).alias("items"))
    s = rows.select("image", R.stages_of_flat(F.col("items")).alias("s"))
    documents = F.filter("s.regions", lambda r: r["category"] != V.GENERIC)
    back = R.flat_result(documents, F.col("s.views"), F.col("s.features"))
    return s.select(
        "image", F.size(back).alias("n_flat"), F.size("s.regions").alias("n_regions"), F.size("s.views").alias("n_views"), F.size("s.features").alias("n_features"),
        F.get("s.regions", F.size("s.regions") - 1)["region_id"].alias("last_id"),
    )


@query(
    "regions_cleaned",
    """SELECT p_partkey, 2 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN p_partkey % 2 = 0 THEN 'r002,r001,r003' ELSE 'r002,r001' END AS ids,
 CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS in_scope FROM part""",
)
def regions_cleaned(spark, sf):
    """Regions with missing and repeated ids, an unknown category and, in every other row, a title block; then those in scope."""
    k = F.col("p_partkey")
    corner = F.array(*[F.lit(float(v)) for v in (10, 10, 200, 200)])
    region = lambda i, c: F.struct(F.lit(i).alias("region_id"), F.lit(c).alias("category"), corner.alias("bbox"))
    raw = F.array(region("r002", "view_region"), region("r002", "View Region"), region("r9", "zzz"))
    raw = F.when(k % 2 == 0, F.concat(raw, F.array(region(None, "标题栏")))).otherwise(raw)
    views = F.array(F.struct(F.lit("r001").alias("region_id"), F.when(k % 3 == 0, V.VIEWS[1]).otherwise(V.VIEWS[0]).alias("category")))
    rows = table(spark, sf, "part").select("p_partkey", T.clean_regions(raw).alias("r"), views.alias("v"))
    inside = T.scoped_regions(F.col("r"), F.col("v"), [V.VIEWS[0]])
    return rows.select(
        "p_partkey", F.size("r").alias("n"), F.array_join(F.transform("r", lambda r: r["region_id"]), ",").alias("ids"), F.size(inside).alias("in_scope")
    )


@query(
    "views_linked",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'r002,r001' ELSE 'r001,r002' END AS ids FROM part""",
)
def views_linked(spark, sf):
    """Two views of unknown ids; the first lies on the second region in every other row."""
    at = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    region = lambda i, b: F.struct(F.lit(i).alias("region_id"), F.lit(V.GENERIC).alias("category"), b.alias("bbox"))
    left, right = at(0, 0, 100, 100), at(300, 0, 400, 100)
    views = F.array(
        F.struct(F.lit("").alias("region_id"), F.lit("front view").alias("category"), F.when(F.col("p_partkey") % 2 == 0, right).otherwise(left).alias("bbox")),
        F.struct(F.lit("v7").alias("region_id"), F.lit("Top View").alias("category"), at(800, 800, 900, 900).alias("bbox")),
        F.struct(F.lit("v8").alias("region_id"), F.lit("no view").alias("category"), left.alias("bbox")),
    )
    linked = R.linked_views(views, F.array(region("r001", left), region("r002", right)))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(linked, lambda r: r["region_id"]), ",").alias("ids"))


# Readers and sinks


@query("lines_read", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def lines_read(spark, sf):
    """Orders written as JSON lines and read back, strictly."""
    path = shared_path(spark, "lines")
    sinks.write_json_lines(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    return readers.json_lines(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("bad_lines", "SELECT o_orderkey % 5 > 0 AS good, count(*) AS n FROM orders WHERE o_orderkey % 7 > 0 GROUP BY 1")
def bad_lines(spark, sf):
    """Lines of which some are cut off and some are blank: how many are read, how many are reported."""
    path, k = shared_path(spark, "lines"), F.col("o_orderkey")
    line = F.when(k % 7 == 0, " ").when(k % 5 == 0, F.concat(F.lit('{"k": '), k)).otherwise(F.concat(F.lit('{"k": '), k, F.lit("}")))
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    good, bad = readers.lines_with_errors(spark, path, "k long")
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count(F.lit(1)).alias("n"))


@query(
    "annotations_read",
    """SELECT concat('d', c_custkey) AS image, concat('t', c_nationkey) AS task, concat('L', c_custkey % 5) AS cat, CASE WHEN c_custkey % 2 = 0 THEN 'M6' ELSE '' END AS size, 1.0::DOUBLE AS x1, (c_custkey % 50 + 5)::DOUBLE AS x2 FROM customer WHERE c_custkey % 9 > 0""",
)
def annotations_read(spark, sf):
    """Raw items in files, lists and wrapped lists, as rows of annotations; those without label are left out."""
    k, path = F.col("c_custkey"), shared_path(spark, "items")
    size = F.when(k % 2 == 0, '"M6"').otherwise("null")
    label = F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("L"), k % 5))
    item = F.format_string(
        '{"dataitem_name": "d%d", "tasks": [{"task_name": " t%d ", "task_values": [{"value": {"label": "%s", "size": %s}, "bbox": [%d, 2, 1, 9]}]}]}', k, F.col("c_nationkey"), label, size, k % 50 + 5
    )
    listed = table(spark, sf, "customer").select((k % 20).alias("file"), item.alias("i")).groupBy("file").agg(F.array_join(F.collect_list("i"), ", ").alias("v"))
    whole = F.when(F.col("file") % 2 == 0, F.concat(F.lit("["), "v", F.lit("]"))).otherwise(F.concat(F.lit(f'{{"{readers.WRAPPERS[0]}": ['), "v", F.lit("]}")))
    # A file per list: each is one JSON text.
    listed.select("file", whole.alias("value")).write.partitionBy("file").text(path)
    rows = readers.annotations(readers.json_items(spark, f"{path}/*"))
    return rows.select("image", "task", "cat", "size", F.col("box")[0].alias("x1"), F.col("box")[2].alias("x2"))


@query(
    "labelled_boxes",
    "SELECT concat('i', c_custkey, '.png') AS image, concat('L', c_custkey % 4) AS cat, round_even((c_custkey % 50)::DOUBLE * 800 / 100, 0) AS x1, round_even((c_custkey % 50 + 10)::DOUBLE * 800 / 100, 0) AS x2 FROM customer WHERE c_custkey % 3 > 0",
)
def labelled_boxes(spark, sf):
    """A labelling tool's rectangles, in percent, as boxes in pixels; other results are left out."""
    k = F.col("c_custkey")
    value = F.struct(
        (k % 50).cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(10.0).alias("width"), F.lit(5.0).alias("height"), F.array(F.concat(F.lit("L"), k % 4)).alias("rectanglelabels")
    )
    result = F.struct(F.when(k % 3 == 0, "choices").otherwise("rectanglelabels").alias("type"), F.lit(800.0).alias("original_width"), F.lit(600.0).alias("original_height"), value.alias("value"))
    data = F.struct(F.concat(F.lit("up/load\\i"), k, F.lit(".png")).alias("image"))
    rows = table(spark, sf, "customer").select(data.alias("data"), F.array(F.struct(F.array(result).alias("result"))).alias("annotations"))
    out = readers.labelling_boxes(rows)
    return out.select("image", "cat", F.col("box")[0].alias("x1"), F.col("box")[2].alias("x2"))


@query("batches_written", "SELECT p_partkey // 64 AS batch, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY 1")
def batches_written(spark, sf):
    """Parts in batches by position; writing them again changes nothing."""
    path = shared_path(spark, "batches")
    rows = table(spark, sf, "part").select("p_partkey", "p_size")
    for _ in range(2):
        sinks.write_batches(rows, path, "p_partkey", 64)
    read = spark.read.schema("p_partkey long, p_size long, batch long").json(path)
    return read.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


@query("rows_appended_once", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM orders")
def rows_appended_once(spark, sf):
    """A resumed run appends only what is not there yet."""
    path, orders = shared_path(spark, "appended"), table(spark, sf, "orders").select("o_orderkey")
    sinks.append_new(orders.where("o_orderkey % 2 = 0").withColumn("run", F.lit("first")), path, ["o_orderkey"])
    sinks.append_new(orders.withColumn("run", F.lit("second")), path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("reports_read", "SELECT concat('run-', r_regionkey) AS label, r_regionkey / 10 AS f1, r_regionkey::BIGINT + 1 AS step FROM region")
def reports_read(spark, sf):
    path, k = shared_path(spark, "reports"), F.col("r_regionkey")
    regions = table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct((k / 10).alias("f1"), (k + 1).alias("step"))).alias("value"))
    regions.write.partitionBy("r_regionkey").text(path)
    labels = [r.r_regionkey for r in regions.select("r_regionkey").collect()]
    return readers.reports(spark, {f"run-{k}": f"{path}/r_regionkey={k}" for k in labels}, "f1 double, step long")


@query(
    "trainer_logs",
    "SELECT concat('run', c_nationkey) AS run, c_custkey AS step, c_custkey / 10 AS loss FROM customer",
)
def trainer_logs(spark, sf):
    entry = F.struct(F.col("c_custkey").alias("step"), (F.col("c_custkey") / 10).alias("loss"))
    states = table(spark, sf, "customer").groupBy(F.concat(F.lit("run"), "c_nationkey").alias("run")).agg(F.collect_list(entry).alias("log_history"))
    return R.log_rows(states)


# Rules


def _rules(spark, sf):
    """A rule for each nation: categories, step and keywords."""
    k = F.col("n_nationkey")
    names = F.array(*[F.lit(c) for c in V.FEATURES])
    return table(spark, sf, "nation").select(
        F.format_string("%02d.md", k).alias("file"), F.slice(names, (k % 7 + 1).cast("int"), 3).alias("categories"), (k % 4).cast("int").alias("step"), F.array(F.lower("n_name"), F.lit("Thread")).alias("keywords")
    )


@query("rules_of_step", "SELECT printf('%02d.md', n_nationkey) AS file FROM nation WHERE n_nationkey % 4 IN (0, 2) ORDER BY 1 LIMIT 9")
def rules_of_step(spark, sf):
    return Q.by_step(_rules(spark, sf), 2, 9).select("file")


@query(
    "rules_of_keywords",
    "SELECT printf('%02d.md', n_nationkey) AS file, (1 + CASE WHEN contains('a thread from france to peru', lower(n_name)) THEN 1 ELSE 0 END)::INT AS hits FROM nation ORDER BY 2 DESC, 1 LIMIT 6",
)
def rules_of_keywords(spark, sf):
    return Q.by_keywords(_rules(spark, sf), F.lit("A thread from France to Peru"), 6).select("file", F.col("hits").cast("int").alias("hits"))


@query(
    "texts_within_budget",
    "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, sum(length(p_name)) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS s FROM part) WHERE s <= 200",
)
def texts_within_budget(spark, sf):
    return Q.within_budget(table(spark, sf, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey", "p_name", 200).select("p_brand", "p_partkey")


@query("contexts", "SELECT p_partkey, substr(concat(p_name, chr(10), chr(10), p_type), 1, 40) AS context FROM part")
def contexts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", Q.context([F.col("p_name"), F.lit(""), F.col("p_type")], 10).alias("context"))


# Selections


def _pool(spark, sf):
    labels = F.array(F.concat(F.lit("s"), F.col("p_size") % 11), F.concat(F.lit("b"), F.col("p_partkey") % 3))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("index"), labels.alias("labels"))


@query("hard_and_general")
def hard_and_general(spark, sf):
    """Forty rows, a quarter of which cover the sizes evenly."""
    return B.hard_and_general(_pool(spark, sf), [f"s{k}" for k in range(11)], 40, 0.25, 7, "mix")


@query("benchmark_chosen")
def benchmark_chosen(spark, sf):
    """Forty-eight parts by what rare labels they add."""
    rows = _pool(spark, sf).select(F.col("index").cast("string").alias("name"), F.col("labels").alias("categories"), (F.col("index") % 30).alias("objects"))
    return B.benchmark_select(rows, 48)
