"""Embedding near-dedup with spherical-cap filters.

A filter direction is a product code: the space is turned by a fixed random rotation and cut into two halves,
each half has CODE random unit directions, and every pair of them is one of CODE * CODE filters. A vector is
list-decoded to all filters whose inner product with it exceeds CAP: per half, only directions that can still
reach CAP with the other half's best are tried. Vectors of equal label that share a filter are compared by
cosine in double precision, in tiles of bounded size. A pair is counted in the smallest filter it shares, so
links are counted once and pairs are never written out.
"""

from __future__ import annotations

import functools
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, frugal, table, written

COSINE = 0.93
CODE = 160
#: Cap height in standard deviations of a random direction's inner product.
CAP = 2.9
LEAST = 24
#: CODE and CAP hold for labels of up to about 34,000 vectors. Larger ones get more directions and higher caps.
CAP_ROWS = 64
MOST_CODE = 4096
TILE = 128
#: Tiles of an Arrow batch: each holds up to TILE vectors twice over.
BATCH_TILES = 64
_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@functools.lru_cache(maxsize=8)
def _code(dim: int, code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.RandomState(dim)
    turn = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    half = dim // 2
    a, b = r.normal(size=(code, half)), r.normal(size=(code, dim - half))
    a /= np.maximum(np.linalg.norm(a, axis=1), 1e-12)[:, None]
    b /= np.maximum(np.linalg.norm(b, axis=1), 1e-12)[:, None]
    return turn, a / np.sqrt(2), b / np.sqrt(2)


def decode(x: np.ndarray, code: int = CODE, cap: float = CAP, least: int = LEAST) -> list[np.ndarray]:
    """Sorted filter numbers of each unit vector. Every vector has `least` filters at least."""
    dim = x.shape[1]
    turn, a, b = _code(dim, code)
    y = x @ turn
    left, right = y[:, : dim // 2] @ a.T, y[:, dim // 2 :] @ b.T
    level = np.full(len(x), cap / np.sqrt(dim))
    down = np.argsort(-right, axis=1, kind="stable")
    best = np.take_along_axis(right, down, axis=1)
    out = []
    for k in range(len(x)):
        i = np.flatnonzero(left[k] >= level[k] - best[k, 0])
        # With each direction of one half go the first so many of the other half's, which stand in descending order.
        many = np.searchsorted(-best[k], left[k, i] - level[k], "right")
        if many.sum() < least:
            # A vector in few caps lowers its cap height until it has `least` filters; they are among these.
            near = np.sort(np.argsort(-left[k], kind="stable")[:least]), np.sort(down[k, :least])
            every = left[k, near[0]][:, None] + right[k, near[1]][None, :]
            u, v = np.nonzero(every >= np.partition(every, -least, axis=None)[-least])
            out.append(np.sort(near[0][u] * code + near[1][v]))
            continue
        j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append(np.sort(np.repeat(i, many) * code + down[k, j]))
    return out


def code_for(rows: int) -> tuple[int, float, int]:
    """(directions per half, cap height, least filters) for a label of so many vectors: a cap holds about CAP_ROWS of them
    at most, until a half has MOST_CODE directions. Higher caps are shared less often, so a vector is in more of them."""
    filters, more = CODE * CODE * (1 - NormalDist().cdf(CAP)), 0.35
    code = min(MOST_CODE, int(np.ceil((filters * CODE**-more * rows / CAP_ROWS) ** (1 / (2 - more)))))
    if code <= CODE:
        return CODE, CAP, LEAST
    scale = (code / CODE) ** more
    return code, -NormalDist().inv_cdf(filters * scale / (code * code)), int(LEAST * scale)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by pairs (u, v)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(left: dict, right: dict | None, here: int, cosine: float):
    """Links inside a tile (right is None) or between two: (ids, link weights, edge ends a, edge ends b).

    Pairs whose smallest shared filter is not `here` are left to that filter."""
    other = left if right is None else right
    near = left["x"] @ other["x"].T >= cosine
    if right is None:
        near = np.triu(near, 1)
    if near.any():
        wanted = [np.concatenate([f[f < here] for f in t["filters"]]) for t in (left, other)]
        known = np.intersect1d(*wanted)
        if len(known):
            marks = []
            for t in (left, other):
                m = np.zeros((len(t["id"]), len(known)), np.float32)
                for k, f in enumerate(t["filters"]):
                    spot = np.searchsorted(known, f[f < here])
                    fine = spot < len(known)
                    fine[fine] = known[spot[fine]] == f[f < here][fine]
                    m[k, spot[fine]] = 1
                marks.append(m)
            near &= (marks[0] @ marks[1].T) == 0
    u, v = np.nonzero(near)
    n = len(left["id"])
    if right is None:
        ids, weight = left["id"], np.bincount(u, left["w"][v], minlength=n) + np.bincount(v, left["w"][u], minlength=n)
        roots = _roots(n, u, v)
    else:
        ids = np.concatenate([left["id"], right["id"]])
        weight = np.concatenate([np.bincount(u, right["w"][v], minlength=n), np.bincount(v, left["w"][u], minlength=len(right["id"]))])
        roots = _roots(len(ids), u, v + n)
    hit = np.flatnonzero(weight > 0)
    return ids[hit], weight[hit].astype(np.int64), ids[roots[hit]]


def _tile(rows: pa.ListScalar, width) -> dict:
    """A tile's rows (id, w, vector, filters below the tile's; the last two as raw bytes) as arrays, vectors in double precision and of length 1."""
    values = rows.values
    x, filters = ([np.frombuffer(v.as_buffer(), t) for v in values.field(k)] for k, t in (("x", width), ("filters", np.int32)))
    x = np.stack(x).astype(np.float64)
    return {"id": values.field("id").to_numpy(), "w": values.field("w").to_numpy().astype(np.float64), "x": x / np.linalg.norm(x, axis=1)[:, None], "filters": filters}


def usable(column: str = "embedding"):
    """Vectors that can link: not null, no null or non-finite component, not zero."""
    wide = F.transform(column, lambda v: v.cast("double"))
    fine = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(wide, lambda v: v != 0), F.lit(False))


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, code: int | None = None, cap: float | None = None, tile: int = TILE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Without `code` and `cap` the largest label's vectors choose them (`code_for`).

    Rows without label or with an unusable vector link with nothing. Equal vectors of a label are handled as one
    with a weight; ids are taken to be distinct, and a null id links with its exact copies only. Vectors of different lengths never link.
    """
    rows = rows.select("vec_id", "embedding", "label")
    good = rows.where(F.col("label").isNotNull() & usable()).withColumn("dim", F.size("embedding"))
    firsts = written(
        good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w")), "vectors"
    )
    if code is None or cap is None:
        most = firsts.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        code, cap, least = code_for(most)
    else:
        least = LEAST
    label_type = dict(rows.dtypes)["label"]
    width = np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64

    @frugal

    def decoded(batches):
        for b in batches:
            dims = b.column(1).to_pylist()
            x = b.column(2).to_pylist()
            filters, raw, vectors = ([None] * len(x) for _ in range(3))
            for dim in set(dims):
                at = [k for k, d in enumerate(dims) if d == dim]
                unit = np.array([x[k] for k in at], np.float64)
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                for k, f in zip(at, decode(unit, code, cap, least)):
                    filters[k], raw[k], vectors[k] = f, f.astype(np.int32).tobytes(), np.array(x[k], width).tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), b.column(4), pa.array(vectors, pa.binary()), pa.array(raw, pa.binary()), pa.array(filters, pa.list_(pa.int32()))],
                ["label", "dim", "id", "w", "x", "raw", "filters"],
            )

    coded = written(
        firsts.mapInArrow(decoded, f"label {label_type}, dim int, id long, w long, x binary, raw binary, filters array<int>"), "vectors"
    )
    key = ["label", "dim", "filter"]
    spread = coded.select("label", "dim", F.posexplode("filters").alias("before", "filter"), "id")
    counts = spread.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    member = spread.join(counts, key).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).select(*key, "tiles", "tile", "id", "before")
    # A tile asks only whether a pair shares a smaller filter: filters are sorted, so that is the beginning of their bytes.
    row = F.struct("id", "w", "x", F.substring("raw", F.lit(1), F.col("before") * 4).alias("filters"))
    tiles = written(
        member.join(coded.select("id", "w", "x", "raw"), "id").groupBy(*key, "tiles", "tile").agg(F.collect_list(row).alias("rows")).select("label", "dim", "filter", "tiles", "tile", "rows"), "vectors"
    )
    a, b = tiles.where("tiles > 1").alias("a"), tiles.where("tiles > 1").alias("b")
    pairs = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("a.tile") < F.col("b.tile")]).select(
        "a.filter", F.col("a.rows").alias("rows"), F.col("b.rows").alias("others")
    )
    work = tiles.select("filter", "rows", F.lit(None).cast(tiles.schema["rows"].dataType).alias("others")).unionByName(pairs)

    @frugal

    def links(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                others = batch.column(2)[k]
                ids, weight, root = _compare(_tile(batch.column(1)[k], width), _tile(others, width) if others.is_valid else None, batch.column(0)[k].as_py(), cosine)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(weight, pa.int64()), pa.array(root, pa.int64())], ["id", "links", "root"])

    spark = rows.sparkSession
    per_batch = spark.conf.get(_PER_BATCH)
    spark.conf.set(_PER_BATCH, min(BATCH_TILES, int(per_batch)) if int(per_batch) > 0 else BATCH_TILES)
    try:
        found = written(work.mapInArrow(links, "id long, links long, root long"), "vectors")
    finally:
        spark.conf.set(_PER_BATCH, per_batch)
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_first = (
        firsts.join(counted, "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "dim", "embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    )
    linked = good.join(per_first, ["label", "dim", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("label").isNull() | ~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all `embeddings`. Null labels and unusable vectors stand alone, equal vectors are one with a weight
    (0.0 and -0.0 are equal), vectors of different lengths never link, an empty table gives no rows."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embeddings": op3_embeddings}

_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS n FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node), k AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT m.vec_id AS vec_id, coalesce(k.n, 0) AS n_links, c.root AS component_id, m.vec_id = c.root AS kept FROM embeddings m JOIN c ON c.node = m.vec_id LEFT JOIN k ON k.x = m.vec_id
"""
ORACLE_SQL = {"op3_embeddings": _SQL}
