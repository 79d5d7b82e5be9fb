"""Queries on records, boxes, rankings, samples and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import metrics as S
from ..operators import ranking as K
from ..operators import records as R
from ..operators import sampling as P
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


# Labels as annotators write them: every alias, in several spellings.
_SPELLINGS = [s for names in V.ALIASES.values() for s in names] + ["Round  Hole", " ROUND_HOLE ", "round/hole", "front VIEW", "no such thing", ""]


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_ALIAS_ROWS = ", ".join(f"('{V._key(s)}', '{n}')" for n, others in V.ALIASES.items() for s in (n, *others))


@query(
    "category_by_alias",
    f"""WITH a(k, name) AS (SELECT DISTINCT * FROM (VALUES {_ALIAS_ROWS})), t AS (SELECT p_partkey, ([{_quoted(_SPELLINGS)}])[p_partkey % {len(_SPELLINGS)} + 1] AS label FROM part)
SELECT p_partkey, label, name AS category, CASE WHEN name IN ({_quoted(V.FEATURES)}) THEN name END AS feature, coalesce(name, trim(label)) AS lenient FROM t LEFT JOIN a
ON a.k = trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '[\\s_/]+', ' ', 'g'), '\\s*-\\s*', ' - ', 'g'), '\\s+', ' ', 'g'))""",
)
def category_by_alias(spark, sf):
    words = F.array(*[F.lit(s) for s in _SPELLINGS])
    label = F.element_at(words, (F.col("p_partkey") % len(_SPELLINGS) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", label.alias("label"))
    c = F.col("label")
    return rows.select("p_partkey", "label", V.category(c).alias("category"), V.category(c, "feature").alias("feature"), V.category(c, strict=False).alias("lenient"))


def _raw(k: Column) -> Column:
    """Sizes as drawings spell them."""
    n = k % 97 + 1
    t = n.cast("string")
    forms = [
        F.concat(F.lit("φ"), t, F.lit(",50 mm")), F.concat(F.lit("4-Ø"), t, F.lit(".0")), F.concat(F.lit("M"), t, F.lit(" DP ")), F.concat(t, F.lit("×45 degrees")),
        F.concat(F.lit("DIA. "), t), F.concat(F.lit("2x M"), t), F.concat(F.lit("R"), t, F.lit(".10")), F.lit(""), F.concat(F.lit("LL "), t), F.concat(t, F.lit("MM H7")),
    ]
    return F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))


_FORMS = """CASE {k} % 10 WHEN 0 THEN concat('φ', n, ',50 mm') WHEN 1 THEN concat('4-Ø', n, '.0') WHEN 2 THEN concat('M', n, ' DP ') WHEN 3 THEN concat(n, '×45 degrees')
 WHEN 4 THEN concat('DIA. ', n) WHEN 5 THEN concat('2x M', n) WHEN 6 THEN concat('R', n, '.10') WHEN 7 THEN '' WHEN 8 THEN concat('LL ', n) ELSE concat(n, 'MM H7') END"""
#: What each form comes to, by kind.
_CANONICAL = """CASE p_partkey % 10 WHEN 0 THEN concat(CASE WHEN kind LIKE 'Round Hole%' THEN '' ELSE 'Ø' END, {n}, '.50')
 WHEN 1 THEN concat('4', CASE WHEN kind LIKE '% Group' THEN 'X' ELSE '-' END, CASE WHEN kind LIKE 'Round Hole%' THEN '' ELSE 'Ø' END, {n})
 WHEN 2 THEN concat('M', {n}, 'DP') WHEN 3 THEN concat({n}, 'X45°') WHEN 4 THEN concat('Ø.', {n}) WHEN 5 THEN concat('2XM', {n}) WHEN 6 THEN concat('R', {n}, '.10')
 WHEN 7 THEN '' WHEN 8 THEN concat(CASE WHEN kind LIKE 'Slotted Hole%' THEN '' ELSE 'LL' END, {n}) ELSE concat({n}, 'H7') END"""
_TOKENS = """list_concat(list_transform(regexp_extract_all({s}, '\\d+(?:\\.\\d+)?'), lambda x: concat('N:', CASE WHEN contains(x, '.') THEN regexp_replace(x, '\\.?0+$', '') ELSE x END)),
 list_transform(list_filter(['M', 'R', 'Ø', 'H7', 'DP', '°', '@', '+', '/'], lambda x: contains({s}, x)), lambda x: concat('S:', x)))"""
_HELD = "len(list_filter({t}, lambda u: u = x))"


@query(
    "size_normalized",
    f"""WITH t AS (SELECT p_partkey, ([{_quoted(V.FEATURES)}])[p_partkey % {len(V.FEATURES)} + 1] AS kind, p_partkey % 97 + 1 AS n, (p_partkey + 10) % 97 + 1 AS m FROM part),
c AS (SELECT *, {_FORMS.format(k='p_partkey')} AS raw, {_CANONICAL.format(n='n')} AS size, {_CANONICAL.format(n='m')} AS other FROM t),
k AS (SELECT *, {_TOKENS.format(s='size')} AS x_, {_TOKENS.format(s='other')} AS y_ FROM c),
h AS (SELECT *, list_sum(list_transform(list_distinct(x_), lambda x: least({_HELD.format(t='x_')}, {_HELD.format(t='y_')}))) AS shared FROM k)
SELECT p_partkey, kind, raw, size, round(CASE WHEN size = other THEN 1.0 WHEN size = '' OR other = '' OR shared = 0 THEN 0.0 ELSE 2 * (shared / len(x_)) * (shared / len(y_)) / (shared / len(x_) + shared / len(y_)) END, 9)::DOUBLE AS similarity FROM h""",
)
def size_normalized(spark, sf):
    names = F.array(*[F.lit(c) for c in V.FEATURES])
    kind = F.element_at(names, (F.col("p_partkey") % len(V.FEATURES) + 1).cast("int"))
    raw, other = _raw(F.col("p_partkey")), _raw(F.col("p_partkey") + 10)
    rows = table(spark, sf, "part").select("p_partkey", kind.alias("kind"), raw.alias("raw"), other.alias("other"))
    k = F.col("kind")
    return rows.select("p_partkey", "kind", "raw", X.size(F.col("raw"), k).alias("size"), F.round(X.size_similarity(F.col("raw"), F.col("other"), k), 9).alias("similarity"))


@query(
    "names_and_families",
    """WITH t AS (SELECT c_custkey, ([concat('a7e', c_custkey % 50, '_rot', c_custkey % 360, '.png'), concat('12345678_page_', c_custkey % 3, '.jpg'), concat('Part ', c_custkey % 40, '_flip_h.png'),
 concat('plain-', c_custkey, '.png')])[c_custkey % 4 + 1] AS name FROM customer), s AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM t)
SELECT c_custkey, name, stem, regexp_matches(lower(stem), '(_rot\\d+|_flip_h)$') AS augmented,
 regexp_replace(regexp_replace(regexp_replace(lower(stem), '\\s+', '_', 'g'), '(_rot\\d+|_flip_h)$', ''), '_page_\\d+$', '') AS family, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM s""",
)
def names_and_families(spark, sf):
    k = F.col("c_custkey")
    forms = [
        F.concat(F.lit("a7e"), k % 50, F.lit("_rot"), k % 360, F.lit(".png")), F.concat(F.lit("12345678_page_"), k % 3, F.lit(".jpg")),
        F.concat(F.lit("Part "), k % 40, F.lit("_flip_h.png")), F.concat(F.lit("plain-"), k, F.lit(".png")),
    ]
    rows = table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(*forms), (k % 4 + 1).cast("int")).alias("name"))
    c = F.col("name")
    return rows.select("c_custkey", "name", X.stem(c).alias("stem"), X.is_augmented(c).alias("augmented"), X.family_id(c).alias("family"), X.slug(c).alias("slug"))


@query(
    "edit_distances",
    "SELECT p_partkey, levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) AS distance, levenshtein(p_brand, p_type) AS plain FROM part",
)
def edit_distances(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.edit_distance(F.col("p_name"), F.col("p_type")).alias("distance"), F.levenshtein("p_brand", "p_type").cast("long").alias("plain"))


@query(
    "boxes_normalized",
    _BASE
    + """, n AS (SELECT image, pos, least(x1 / 320.0, 1.0) * 1000 AS a, least(y1 / 320.0, 1.0) * 1000 AS b, least((x1 + w) / 320.0, 1.0) * 1000 AS c, least((y1 + h) / 320.0, 1.0) * 1000 AS d FROM gt)
SELECT CAST(image AS BIGINT) AS image, pos, round_even(a, 0) AS x1, round_even(b, 0) AS y1, round_even(c, 0) AS x2, round_even(d, 0) AS y2, a < c AND b < d AS fine FROM n""",
)
def boxes_normalized(spark, sf):
    """Pixels of drawings 320 wide and high, to 0..1000; halves round to even."""
    _, truth = boxes(spark, sf)
    side = F.lit(320)
    raw = F.transform("box", lambda v: v / side * G.SCALE)
    whole = G.normalize(F.col("box"), side, side, pixels=True)
    flat = F.transform(raw, lambda v: F.rint(F.least(v, F.lit(1000.0))))
    kept = F.coalesce(whole, flat)
    return truth.select("image", "pos", *[kept[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], whole.isNotNull().alias("fine"))


@query(
    "box_relations",
    _BASE
    + """, j AS (SELECT a.image AS image, a.pos AS pos, a.x1 AS ax, a.y1 AS ay, a.w AS aw, a.h AS ah, b.x1 AS bx, b.y1 AS by_, b.w AS bw, b.h AS bh,
 greatest(0, least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1)) * greatest(0, least(a.y1 + a.h, b.y1 + b.h) - greatest(a.y1, b.y1)) AS o FROM gt a JOIN gt b ON a.image = b.image AND b.pos = a.pos + 1)
SELECT CAST(image AS BIGINT) AS image, pos, CAST(aw * ah AS DOUBLE) AS area, CAST(o AS DOUBLE) AS overlap, o / (aw * ah + bw * bh - o) AS iou, o / (aw * ah) AS containment,
 bx <= ax + aw / 2 AND ax + aw / 2 <= bx + bw AND by_ <= ay + ah / 2 AND ay + ah / 2 <= by_ + bh AS center_inside, bx <= ax AND by_ <= ay AND bx + bw >= ax + aw AND by_ + bh >= ay + ah AS contained FROM j""",
)
def box_relations(spark, sf):
    _, truth = boxes(spark, sf)
    other = truth.select("image", (F.col("pos") - 1).alias("pos"), F.col("box").alias("b"))
    a, b = F.col("box"), F.col("b")
    return truth.join(other, ["image", "pos"]).select(
        "image", "pos", G.area(a).alias("area"), G.intersection(a, b).alias("overlap"), G.iou(a, b).alias("iou"), G.containment(a, b).alias("containment"),
        G.center_in(a, b).alias("center_inside"), G.contains(b, a).alias("contained"),
    )


@query(
    "crops",
    _BASE
    + """, t AS (SELECT *, CAST(x1 AS DOUBLE) AS a, CAST(y1 AS DOUBLE) AS b, CAST(x1 + w AS DOUBLE) AS c, CAST(y1 + h AS DOUBLE) AS d FROM gt)
SELECT CAST(image AS BIGINT) AS image, pos, CAST(greatest(0, floor(a - (c - a) * 0.1)) AS BIGINT) AS left_, CAST(greatest(0, floor(b - (d - b) * 0.1)) AS BIGINT) AS top,
 CAST(least(380, ceil(c + (c - a) * 0.1)) AS BIGINT) AS right_, CAST(least(380, ceil(d + (d - b) * 0.1)) AS BIGINT) AS bottom,
 round_even(200 + a / 1000 * 400, 0) AS gx1, round_even(200 + c / 1000 * 400, 0) AS gx2 FROM t""",
)
def crops(spark, sf):
    """Padded pixel crops, and boxes of a crop (200..600 both ways) back in the drawing."""
    _, truth = boxes(spark, sf)
    p = G.expand_pixels(F.col("box"), F.lit(380), F.lit(380), 0.1)
    back = G.crop_to_global(F.col("box"), F.array(*[F.lit(float(v)) for v in (200, 200, 600, 600)]))
    return truth.select("image", "pos", *[p[i].alias(n) for i, n in enumerate(("left_", "top", "right_", "bottom"))], back[0].alias("gx1"), back[2].alias("gx2"))


@query(
    "region_ids",
    _BASE + " SELECT CAST(image AS BIGINT) AS image, pos, printf('r%03d', row_number() OVER (PARTITION BY image ORDER BY y1, x1, cat, pos)) AS region_id FROM gt",
)
def region_ids(spark, sf):
    _, truth = boxes(spark, sf)
    w = Window.partitionBy("image").orderBy(F.col("box")[1], F.col("box")[0], "cat", "pos")
    return truth.select("image", "pos", F.format_string("r%03d", F.row_number().over(w)).alias("region_id"))


@query(
    "chat_rows",
    _BASE
    + """ SELECT CAST(image AS BIGINT) AS image, count(*) AS n, sha256(string_agg(concat(cat, '|', size, '|', x1, ',', y1, ',', x1 + w, ',', y1 + h), ';' ORDER BY y1, x1, cat, pos)) AS answer FROM gt GROUP BY image""",
)
def chat_rows(spark, sf):
    """A drawing's annotations as the text of an answer, in reading order."""
    _, truth = boxes(spark, sf)
    b = F.transform("box", lambda v: v.cast("long"))
    item = F.struct(b[1].alias("y"), b[0].alias("x"), "cat", "pos", F.concat(F.col("cat"), F.lit("|"), F.col("size"), F.lit("|"), F.array_join(b.cast("array<string>"), ",")).alias("t"))
    listed = truth.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select("image", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items.t", ";").cast("binary"), 256).alias("answer"))


@query(
    "records_aligned",
    """WITH p AS (SELECT o_orderkey AS pos, o_custkey % 300 AS a, o_custkey % 700 AS b FROM orders), t AS (SELECT o_orderkey AS pos, o_custkey % 300 AS a FROM orders),
own AS (SELECT k, min(pos) AS prediction FROM (SELECT concat('a', a) AS k, pos FROM p UNION ALL SELECT concat('b', b), pos FROM p) GROUP BY k),
ask AS (SELECT t.pos AS truth, own.prediction, own.k AS key FROM t JOIN own ON own.k = concat('a', t.a)), win AS (SELECT prediction, min(truth) AS truth FROM ask GROUP BY prediction)
SELECT t.pos AS truth, ask.prediction AS prediction, ask.key AS key FROM t LEFT JOIN win ON win.truth = t.pos LEFT JOIN ask ON ask.truth = win.truth""",
)
def records_aligned(spark, sf):
    orders = table(spark, sf, "orders")
    a, b = (F.concat(F.lit(n), F.col("o_custkey") % m) for n, m in (("a", 300), ("b", 700)))
    predictions = orders.select(F.col("o_orderkey").alias("pos"), F.array(a, b).alias("keys"))
    truth = orders.select(F.col("o_orderkey").alias("pos"), F.array(a).alias("keys"))
    return R.align(truth, predictions)


@query("records_aligned_all")
def records_aligned_all(spark, sf):
    """All orders on both sides, with different key lists: a true record asks by day and customer, a prediction names customer, priority and day."""
    day, customer, priority = (F.concat(F.lit(n), F.col(c).cast("string")) for n, c in (("d", "o_orderdate"), ("c", "o_custkey"), ("p", "o_orderpriority")))
    orders = table(spark, sf, "orders")
    predictions = orders.select(F.col("o_orderkey").alias("pos"), F.array(customer, priority, day).alias("keys"))
    truth = orders.select(F.col("o_orderkey").alias("pos"), F.array(day, customer).alias("keys"))
    return R.align(truth, predictions)


@query(
    "sources_merged",
    """WITH r AS (SELECT l_orderkey % 200 AS image, concat('s', l_suppkey % 3) AS source, 't' AS task, l_returnflag AS cat, CASE WHEN l_linenumber = 1 THEN '' WHEN l_partkey % 2 = 0 THEN concat('M', l_partkey % 5) ELSE concat('', l_partkey % 5) END AS size,
 l_partkey % 12 AS x FROM lineitem), g AS (SELECT image, cat, x, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT CASE WHEN size <> '' THEN size END) AS n,
 list(DISTINCT size) FILTER (size <> '') AS sizes FROM r GROUP BY image, cat, x)
SELECT CAST(image AS BIGINT) AS image, cat, CAST(x AS DOUBLE) AS x, sources, coalesce((SELECT max(struct_pack(m := length(regexp_replace(upper(s), '[^ØRMC°X×]', '', 'g')), n := length(s), s := s)) FROM (SELECT unnest(sizes) AS s)).s, '') AS size, n > 1 AS conflict FROM g""",
)
def sources_merged(spark, sf):
    part = F.col("l_partkey") % 5
    size = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("M"), part)).otherwise(part.cast("string"))
    x = (F.col("l_partkey") % 12).cast("double")
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 200).alias("image"), F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("source"), F.year("l_shipdate").cast("string").alias("task"),
        F.col("l_returnflag").alias("cat"), size.alias("size"), F.array(x, x, x + 1, x + 1.0001).alias("box"),
    )
    m = R.merge_sources(rows)
    return m.select("image", "cat", F.col("box")[0].alias("x"), F.array_join("sources", ",").alias("sources"), "size", "conflict")


@query("shards_merged", "SELECT o_custkey AS key, min(o_orderkey) AS ord, o_custkey % 7 AS value FROM orders GROUP BY o_custkey")
def shards_merged(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 7).alias("value"))
    return R.merge_shards(rows, "key", "ord")


@query(
    "exact_duplicates_first_kept",
    "SELECT image, cat, pos FROM (SELECT l_orderkey % 500 AS image, l_returnflag AS cat, l_orderkey * 10 + l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey % 500, l_returnflag, l_partkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1",
)
def exact_duplicates_first_kept(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"image": F.col("l_orderkey") % 500, "v": F.col("l_partkey") % 50})
    kept = R.first_of(rows, ["image", "l_returnflag", "v"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return kept.select("image", F.col("l_returnflag").alias("cat"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


@query(
    "pending_work",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')",
)
def pending_work(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "O", "ok").alias("status"))
    return R.pending(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("rows_with_files", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def rows_with_files(spark, sf):
    files = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(files, "c_custkey", "left_semi")


@query(
    "preference_pairs",
    """WITH s AS (SELECT l_orderkey AS image, l_linenumber AS sample, l_discount AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) = 1)
SELECT image, arg_max(sample, struct_pack(a := score, b := -sample)) AS chosen, arg_min(sample, struct_pack(a := score, b := sample)) AS rejected, max(score) AS high, min(score) AS low
FROM s GROUP BY image HAVING max(score) - min(score) >= 0.05""",
)
def preference_pairs(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("sample"), F.col("l_discount").alias("score"), "l_partkey", "l_extendedprice")
    one = R.first_of(rows, ["image", "sample"], ["l_partkey", "l_extendedprice"]).select("image", "sample", "score")
    return R.preference_pairs(one, 0.05)


@query(
    "leaking_families",
    "SELECT family, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT o_custkey AS family, o_orderstatus AS split FROM orders) GROUP BY family HAVING count(*) > 1",
)
def leaking_families(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("split"))
    return R.leaks(rows).select("family", F.array_join("splits", ",").alias("splits"))


@query(
    "audit_issues",
    """WITH i AS (SELECT 'error' AS severity, 'late' AS code, concat('order ', o_orderkey) AS detail FROM orders WHERE o_totalprice > 400000 UNION ALL
SELECT 'warning', concat('status_', o_orderstatus), concat('order ', o_orderkey) FROM orders WHERE o_orderkey % 10 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY severity, code ORDER BY detail) AS k FROM i)
SELECT severity, code, count(*) AS n, string_agg(CASE WHEN k <= 3 THEN detail END, ';' ORDER BY detail) AS examples FROM r GROUP BY severity, code""",
)
def audit_issues(spark, sf):
    orders = table(spark, sf, "orders")
    detail = F.concat(F.lit("order "), "o_orderkey").alias("detail")
    late = orders.where("o_totalprice > 400000").select(F.lit("error").alias("severity"), F.lit("late").alias("code"), detail)
    tens = orders.where("o_orderkey % 10 = 0").select(F.lit("warning").alias("severity"), F.concat(F.lit("status_"), "o_orderstatus").alias("code"), detail)
    return R.issues(late.unionByName(tens)).select("severity", "code", "n", F.array_join("examples", ";").alias("examples"))


@query(
    "duplicate_records",
    "SELECT count(*) - count(DISTINCT concat(o_custkey, '|', o_orderstatus, '|', o_orderpriority)) AS duplicates, count(*) AS n FROM orders",
)
def duplicate_records(spark, sf):
    row = F.sha2(F.to_json(F.struct("o_custkey", "o_orderpriority", "o_orderstatus")).cast("binary"), 256)
    n = F.count(F.lit(1))
    return table(spark, sf, "orders").agg((n - F.count_distinct(row)).alias("duplicates"), n.alias("n"))


@query("label_distribution", "SELECT p_type AS label, count(*) AS objects, count(DISTINCT p_brand) AS images FROM part GROUP BY p_type")
def label_distribution(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("label")).agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("p_brand").alias("images"))


@query(
    "dominant_category",
    """SELECT image, cat FROM (SELECT l_orderkey % 500 AS image, concat(l_returnflag, l_linestatus) AS cat, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC, first, cat DESC) = 1""",
)
def dominant_category(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("image"), F.concat("l_returnflag", "l_linestatus").alias("cat"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return P.dominant(rows, "image", "cat", "pos")


@query(
    "index_percentiles",
    """WITH v AS (SELECT c_nationkey AS g, list(c_acctbal ORDER BY c_acctbal) AS v FROM customer GROUP BY c_nationkey) SELECT g, CAST(len(v) AS BIGINT) AS n, v[CAST(least(len(v), floor(len(v) * 0.1) + 1) AS INT)] AS p10,
 v[CAST(least(len(v), floor(len(v) * 0.5) + 1) AS INT)] AS p50, v[CAST(least(len(v), floor(len(v) * 0.9) + 1) AS INT)] AS p90, v[len(v)] AS top FROM v""",
)
def index_percentiles(spark, sf):
    v = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.collect_list("c_acctbal").alias("v"))
    parts = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "top": 1.0}
    return v.select("g", F.size("v").cast("long").alias("n"), *[S.index_percentile(F.col("v"), p).alias(n) for n, p in parts.items()])


_DOUBLE = "CAST({} AS DOUBLE)"


@query(
    "cad_scores",
    """WITH s AS (SELECT c_custkey AS run, (c_custkey % 100) / 100.0 AS a, (c_custkey % 37) / 37.0 AS b, (c_custkey % 11) / 11.0 AS c, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 51) / 51.0 END AS d FROM customer)
SELECT run, round(CASE WHEN d IS NULL THEN 0.55 * a + 0.20 * b + 0.15 * c + 0.10 * a ELSE 0.75 * (0.55 * a + 0.20 * b + 0.15 * c + 0.10 * a) + 0.25 * (0.85 * d + 0.15 * c) END, 9) AS score,
 round(greatest(0.0, least(1.0, b + 0.5 * greatest(-0.2, least(0.2, b - a)))), 3) AS reward FROM s""",
)
def cad_scores(spark, sf):
    k = F.col("c_custkey")
    a, b, c = (k % 100) / 100, (k % 37) / 37, (k % 11) / 11
    d = F.when(k % 9 != 0, (k % 51) / 51)
    reward = F.greatest(F.lit(0.0), F.least(F.lit(1.0), b + 0.5 * F.greatest(F.lit(-0.2), F.least(F.lit(0.2), b - a))))
    return table(spark, sf, "customer").select(k.alias("run"), F.round(S.cad_score(a, b, c, a, d, c), 9).alias("score"), F.round(reward, 3).alias("reward"))


@query(
    "refined_rewards",
    "SELECT c_custkey AS run, round_even(greatest(0.0, least(1.0, b + 0.5 * greatest(-0.2, least(0.2, b - a)))), 4) AS reward FROM (SELECT c_custkey, (c_custkey % 64) / 64.0 AS a, (c_custkey % 32) / 32.0 AS b FROM customer)",
)
def refined_rewards(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("run"), S.refined_reward((k % 64) / 64, (k % 32) / 32).alias("reward"))


_LOG = "SELECT user_id AS run, event_id AS step, value AS loss FROM events"


@query(
    "nearest_steps",
    f"""WITH a AS (SELECT run, step FROM ({_LOG}) WHERE step % 7 = 0), b AS (SELECT * FROM ({_LOG}) WHERE step % 7 <> 0),
j AS (SELECT a.run AS run, a.step AS step, b.step AS other, b.loss AS loss, row_number() OVER (PARTITION BY a.run, a.step ORDER BY abs(b.step - a.step), b.step) AS k FROM a JOIN b ON a.run = b.run)
SELECT a.run AS run, a.step AS step, j.other AS other, j.loss AS loss FROM a LEFT JOIN j ON j.run = a.run AND j.step = a.step AND j.k = 1""",
)
def nearest_steps(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    rows, others = log.where("step % 7 = 0").select("run", "step"), log.where("step % 7 <> 0").withColumn("other", F.col("step"))
    out = K.nearest_step(rows, others, by=["run"])
    return out.select("run", "step", F.col("nearest.other").alias("other"), F.col("nearest.loss").alias("loss"))


@query(
    "change_from_first",
    f"SELECT run, step, (loss - first_value(loss) OVER w) / first_value(loss) OVER w * 100 AS change, loss = min(loss) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM ({_LOG}) WHERE loss <> 0 WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
def change_from_first(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss")).where("loss <> 0")
    return K.change_from_first(log, "loss").select("run", "step", "change", "best")


@query(
    "checkpoints_kept",
    f"SELECT run, step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss NULLS LAST, step) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS b FROM ({_LOG})) WHERE a <= 3 OR b = 1",
)
def checkpoints_kept(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return K.keep_policy(log, 3).where("keep").select("run", "step")


@query(
    "latest_per_checkpoint",
    "SELECT user_id AS run, event_type AS kind, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type",
)
def latest_per_checkpoint(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("kind")).agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query(
    "reports_ranked",
    """SELECT label, eligible, row_number() OVER (ORDER BY eligible DESC, score DESC, label) AS rank FROM (SELECT s_suppkey AS label, s_acctbal AS score, s_suppkey % 4 <> 0 AS eligible FROM supplier)""",
)
def reports_ranked(spark, sf):
    reports = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("label"), F.col("s_acctbal").alias("score"))
    return K.rank_reports(reports, F.col("label") % 4 != 0, [F.desc("score"), "label"]).select("label", "eligible", F.col("rank").cast("long").alias("rank"))


@query(
    "capped_per_group",
    "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 5",
)
def capped_per_group(spark, sf):
    return K.first_per(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 5).select("c_nationkey", "c_custkey")


@query(
    "vector_top_k",
    """WITH s AS (SELECT a.vec_id AS query, b.vec_id AS vec, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT query, vec, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec) AS INT) AS rank FROM s QUALIFY rank <= 5""",
)
def vector_top_k(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    return K.vector_top_k(queries, e.select(F.col("vec_id").alias("vec"), F.col("embedding").alias("v")), 5).select("query", "vec", "rank")


@query(
    "rules_by_overlap",
    """WITH r AS (SELECT p_partkey AS rule, list_distinct([p_brand, p_type, concat('s', p_size % 10)]) AS cats FROM part), q AS (SELECT ['Brand#11', 's3', 's7', p_type] AS want FROM part ORDER BY p_partkey LIMIT 1)
SELECT rule, CAST(len(list_intersect(cats, want)) AS INT) AS hits FROM r, q WHERE len(list_intersect(cats, want)) > 0 ORDER BY hits DESC, rule LIMIT 25""",
)
def rules_by_overlap(spark, sf):
    part = table(spark, sf, "part")
    want = part.orderBy("p_partkey").limit(1).select(F.array(F.lit("Brand#11"), F.lit("s3"), F.lit("s7"), "p_type").alias("want"))
    cats = F.array_distinct(F.array("p_brand", "p_type", F.concat(F.lit("s"), F.col("p_size") % 10)))
    hits = F.size(F.array_intersect("cats", "want"))
    return part.select(F.col("p_partkey").alias("rule"), cats.alias("cats")).crossJoin(F.broadcast(want)).select("rule", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "rule").limit(25)


@query("sharded_by_position", "SELECT o_orderkey, o_orderkey % 7 AS shard FROM orders")
def sharded_by_position(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(7).cast("long")).alias("shard"))


_RANK = "('0x' || substr(sha256('{seed}' || chr(0) || '{ns}' || chr(0) || CAST({index} AS VARCHAR)), 1, 16))::UBIGINT"


@query("selected_by_hash", f"SELECT o_orderkey FROM orders ORDER BY {_RANK.format(seed=7, ns='sample', index='o_orderkey')}, o_orderkey LIMIT 500")
def selected_by_hash(spark, sf):
    return P.random_select(table(spark, sf, "orders").select("o_orderkey"), 500, 7, "sample", "o_orderkey").select("o_orderkey")


@query(
    "kept_by_hash",
    "SELECT o_orderkey FROM orders WHERE ('0x' || substr(sha256('3' || chr(0) || CAST(o_orderkey AS VARCHAR) || chr(0) || o_orderpriority), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.25",
)
def kept_by_hash(spark, sf):
    return table(spark, sf, "orders").where(X.keep(3, F.col("o_orderkey"), F.col("o_orderpriority"), 0.25)).select("o_orderkey")


@query(
    "stratified_split",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_RANK.format(seed=5, ns="split", index="o_orderkey")}, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def stratified_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return P.stratified(rows, "o_orderstatus", {"train": 0.8, "val": 0.1, "test": 0.1}, 5, "o_orderkey").select("o_orderkey", "split")


@query(
    "holdout_split",
    f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_RANK.format(seed=9, ns='holdout', index='o_orderkey')}, o_orderkey) <= greatest(1, floor((SELECT count(*) FROM orders) * 0.05)) THEN 'val' ELSE 'train' END AS split FROM orders",
)
def holdout_split(spark, sf):
    return P.holdout(table(spark, sf, "orders").select("o_orderkey"), 0.05, 9, "o_orderkey").select("o_orderkey", "split")


@query(
    "oversampled",
    "SELECT p_partkey, CAST(unnest(generate_series(0, greatest(CASE p_brand WHEN 'Brand#11' THEN 4 WHEN 'Brand#22' THEN 2 ELSE 1 END, CASE WHEN p_size < 5 THEN 3 ELSE 1 END) - 1)) AS INT) AS copy FROM part",
)
def oversampled(spark, sf):
    labels = F.array("p_brand", F.when(F.col("p_size") < 5, "small").otherwise("large"))
    rows = table(spark, sf, "part").select("p_partkey", labels.alias("labels"))
    return P.oversample(rows, "labels", {"Brand#11": 4, "Brand#22": 2, "small": 3}).select("p_partkey", "copy")


@query("balanced_selection")
def balanced_selection(spark, sf):
    pool = table(spark, sf, "part").select(F.col("p_partkey").alias("index"), F.array("p_brand", "p_type").alias("labels"))
    targets = [r.p_brand for r in table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").limit(5).collect()]
    return P.balanced_select(pool, targets, 40, 11, "balanced")


@query("families_split")
def families_split(spark, sf):
    families = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return P.split_families(families, {"train": 0.8, "val": 0.1, "test": 0.1}, 3)


@query(
    "quota_selection",
    f"""SELECT p_partkey FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY {_RANK.format(seed=2, ns="quota", index="p_partkey")}, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE k <= CAST(ceil(n * 0.1) AS INT)""",
)
def quota_selection(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    quotas = part.groupBy("p_brand").agg(F.ceil(F.count(F.lit(1)) * 0.1).alias("quota"))
    return P.quota(part, "p_brand", quotas, 2, "p_partkey").select("p_partkey")
