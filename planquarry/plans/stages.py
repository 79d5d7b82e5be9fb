"""Queries on three-stage records, weights and title blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import retrieval as R
from ..operators import stages as S
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


_NAMES = V.VIEWS[:4] + V.DOCUMENTS[:2] + V.FEATURES[:6]
_LIST = ", ".join(f"'{n}'" for n in _NAMES)


def _annotations(spark, sf):
    _, truth = boxes(spark, sf)
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("pos") % len(_NAMES) + 1).cast("int"))
    return truth.select("image", "pos", name.alias("cat"), "size", "box")


@query(
    "stage_targets",
    _BASE
    + f""", a AS (SELECT *, ([{_LIST}])[pos % {len(_NAMES)} + 1] AS name FROM gt), k AS (SELECT *, pos % {len(_NAMES)} AS kind FROM a)
SELECT CAST(image AS BIGINT) AS image, count(*) FILTER (kind < 6) AS n_regions, count(*) FILTER (kind < 4) AS n_views, count(*) FILTER (kind >= 6) AS n_features,
 arg_min(name, struct_pack(y := y1, x := x1, c := name)) FILTER (kind < 4) AS first_view FROM k GROUP BY image HAVING count(*) FILTER (kind < 4) > 0""",
)
def stage_targets(spark, sf):
    t = S.targets(_annotations(spark, sf)).where("views IS NOT NULL")
    n = lambda c: F.size(c).cast("long")
    return t.select("image", n("regions").alias("n_regions"), n("views").alias("n_views"), n("features").alias("n_features"), F.get("views", 0)["category"].alias("first_view"))


@query(
    "stage_errors",
    _BASE
    + f""", v AS (SELECT image, count(*) FILTER (pos % {len(_NAMES)} < 4) AS views, count(*) FILTER (pos % {len(_NAMES)} < 4 AND (x1 + w > 1000 OR y1 + h > 1000)) AS bad FROM gt GROUP BY image)
SELECT CAST(image AS BIGINT) AS image, bad::INT AS in_regions, bad::INT AS in_views, CASE WHEN image % 5 = 0 THEN 1 ELSE 0 END AS across FROM v WHERE views > 0""",
)
def stage_errors(spark, sf):
    """How many messages the checks give on targets that were spoilt in places."""
    t = S.targets(_annotations(spark, sf)).where("views IS NOT NULL")
    spoilt = t.withColumn("regions", F.when(F.col("image") % 5 == 0, F.slice("regions", F.lit(2), F.size("regions"))).otherwise(F.col("regions")))
    return spoilt.select(
        "image", F.size(S.check_regions(F.col("regions"))).alias("in_regions"), F.size(S.check_views(F.col("projection_method"), F.col("views"))).alias("in_views"),
        F.size(S.check_across(F.col("regions"), F.col("views"), F.lit(None).cast("array<struct<region_id:string>>"))).alias("across"),
    )


@query(
    "cross_view_share",
    _BASE
    + """, v AS (SELECT image, x1, y1, w * 2 AS w, h * 2 AS h FROM gt WHERE pos <= 3), f AS (SELECT * FROM gt WHERE pos > 3)
SELECT CAST(image AS BIGINT) AS image, round(avg(CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.image = f.image AND ((v.x1 <= f.x1 + f.w / 2 AND f.x1 + f.w / 2 <= v.x1 + v.w AND v.y1 <= f.y1 + f.h / 2 AND f.y1 + f.h / 2 <= v.y1 + v.h)
  OR 2 * greatest(0, least(f.x1 + f.w, v.x1 + v.w) - greatest(f.x1, v.x1)) * greatest(0, least(f.y1 + f.h, v.y1 + v.h) - greatest(f.y1, v.y1)) >= f.w * f.h)) THEN 1.0 ELSE 0.0 END), 9) AS share FROM f GROUP BY image""",
)
def cross_view_share(spark, sf):
    _, truth = boxes(spark, sf)
    b = F.col("box")
    wide = F.array(b[0], b[1], b[0] + (b[2] - b[0]) * 2, b[1] + (b[3] - b[1]) * 2)
    out = S.cross_view(truth.where("pos > 3"), truth.where("pos <= 3").select("image", wide.alias("box")))
    return out.select("image", F.round("share", 9).alias("share"))


@query(
    "loss_weights",
    """WITH t AS (SELECT p_partkey, ['holes', 'yuanjiao', 'duyin', 'default'][p_partkey % 4 + 1] AS channel, p_size % 16 AS a, p_size % 7 AS b FROM part)
SELECT p_partkey, CASE WHEN channel = 'holes' THEN 2.0 + CASE WHEN a >= 8 OR a + b >= 14 THEN 2.0 ELSE 0.0 END ELSE 1.0 END::DOUBLE AS weight FROM t""",
)
def loss_weights(spark, sf):
    channel = F.element_at(F.array(*[F.lit(c) for c in ("holes", "yuanjiao", "duyin", "default")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    objects = F.concat(F.array_repeat(F.lit(S.HOLE), F.col("p_size") % 16), F.array_repeat(F.lit("x"), F.col("p_size") % 7))
    return table(spark, sf, "part").select("p_partkey", S.loss_weight(channel, objects).alias("weight"))


@query(
    "title_block_fields",
    """SELECT c_custkey AS image, 'material' AS field, concat('M', c_nationkey) AS value FROM customer UNION ALL SELECT c_custkey, 'scale', concat('1:', c_custkey % 9) FROM customer""",
)
def title_block_fields(spark, sf):
    at = lambda x, y: F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((x, y), (x + 10, y), (x + 10, y + 4), (x, y + 4))])
    line = lambda pos, text, x, y: F.struct(F.lit(pos).alias("pos"), text.alias("text"), at(x, y).alias("box"))
    lines = F.array(
        line(0, F.concat(F.lit("材料："), F.lit("M"), F.col("c_nationkey")), 0.0, 0.0), line(1, F.lit("SCALE:"), 0.0, 50.0), line(2, F.lit("zzz"), 90.0, 50.0), line(3, F.concat(F.lit("1:"), F.col("c_custkey") % 9), 30.0, 55.0)
    )
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("image"), F.explode(lines).alias("l")).select("image", "l.*")
    return R.title_block(rows)
