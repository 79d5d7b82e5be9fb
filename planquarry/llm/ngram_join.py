"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact to the last link.

A text is its set of n-word shingles. Equal sets are one node. For a link (Jaccard >= share) two sets must share
a token among the first |A| - ceil(share |A|) + 1 of each in any one fixed order (prefix filter). The order puts
tokens that occur once first, then others, then very frequent ones; which is which is read from two Bloom
filters of bounded size, built from counts over all texts. A false positive in them changes the order for all
texts alike, hence costs time and loses nothing.

1. Counts: each task sends its distinct shingles with their counts to partitions by hash.
2. Postings: per text, its prefix tokens that are not unique.
3. Stars: each node is verified against the hub of most of its (token, size band) buckets; a bucket's hub is the
   node with the smallest share of tokens of its own.
4. Tiles: buckets whose nodes are still in several components are cut into size-banded tiles; within tiles and
   between tiles of neighbouring bands, bitmap signatures bound every overlap from above by bit counts. The nodes
   with a partner left (not the pairs) get their sorted arrays, and exact intersections, likeliest first, give
   links that span what is linked in the tile.

Components need no more links than that: two nodes in one component already are not compared again, so groups
of thousands of copies cost about one comparison per member, and no step writes pairs of nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bloom_filter, in_filter
from .common import frugal, frugal_group, merged, parts_for, roots, table, written
from .textblocks import blocks, mix, shingle_sets

SHARE = 75  # percent
WORDS = 5
#: A shingle in at least this many rows is frequent.
FREQUENT = 9
TILE = 256
#: Tokens of a tile's sets.
TILE_TOKENS = 1 << 19
_U = np.uint64
_MASK = _U((1 << 48) - 1)


def _need(n):
    """Smallest overlap that sets of n (and a partner at least as large) need: ceil(share * n)."""
    return -(-SHARE * n // 100)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, key): set size, and a hash of the whole set; texts without words get keys of their own from their ids."""

    @frugal

    def run(batches):
        for b in batches:
            for at, data, offsets in blocks(b):
                tokens, bounds = shingle_sets(data, offsets, words)
                n = np.diff(bounds)
                sums = np.append(_U(0), np.cumsum(mix(tokens + _U(1)), dtype=_U))
                key = mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(_U))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n, pa.int64()), _signed(key)], ["doc_id", "n", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key long")


def _counted(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """(token, n): shingles (48 bits of their hashes) in two rows or more, n saturating at 255."""
    high = _U(24)

    @frugal

    def send(batches):
        held: list = []
        size = 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            part = ((tokens >> high) * _U(parts) >> high).astype(np.int64)
            cut = np.searchsorted(part, np.arange(parts + 1))
            raw = tokens.view(np.uint8).reshape(-1, 8)[:, :6]
            few = np.minimum(counts, 255).astype(np.uint8)
            rows = [(p, raw[i:j].tobytes(), few[i:j].tobytes()) for p, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                ["part", "tokens", "counts"],
            )

        for b in batches:
            for _, data, offsets in blocks(b):
                tokens, _ = shingle_sets(data, offsets, words)
                held.append(tokens & _MASK)
                size += len(tokens)
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    @frugal_group

    def count(key, rows):
        tokens, counts = [], []
        for t, c in zip(rows.column(1), rows.column(2)):
            raw = np.zeros((len(c.as_buffer()), 8), np.uint8)
            raw[:, :6] = np.frombuffer(t.as_buffer(), np.uint8).reshape(-1, 6)
            tokens.append(raw.view(_U).ravel())
            counts.append(np.frombuffer(c.as_buffer(), np.uint8))
        tokens, counts = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        cut = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        n = np.add.reduceat(counts[order].astype(np.int64), cut)
        many = n > 1
        return pa.Table.from_arrays([_signed(tokens[cut][many]), pa.array(np.minimum(n[many], 255), pa.int32())], ["token", "n"])

    sent = docs.select("doc_id", "text").mapInArrow(send, "part int, tokens binary, counts binary")
    return sent.groupBy("part").applyInArrow(count, "token long, n int")


def _postings(docs: DataFrame, words: int, filters) -> DataFrame:
    """(token, key, n, central): of each set's prefix in the order (unique, others, frequent; hash), the tokens not unique.
    filters: broadcast Bloom filters of the tokens that are several and of those that are frequent."""

    @frugal

    def run(batches):
        (several, several_bits), (frequent, frequent_bits) = filters.value
        for b in batches:
            for _, data, offsets in blocks(b):
                tokens, bounds = shingle_sets(data, offsets, words)
                n = np.diff(bounds)
                sums = np.append(_U(0), np.cumsum(mix(tokens + _U(1)), dtype=_U))
                key = mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(_U))
                low = tokens & _MASK
                rank = in_filter(several, several_bits, low).astype(np.uint8)
                hit = np.flatnonzero(rank)
                rank[hit] += in_filter(frequent, frequent_bits, low[hit])
                doc = np.repeat(np.arange(len(n)), n)
                prefix = n - _need(n) + 1
                unique = np.bincount(doc[rank == 0], minlength=len(n))
                left = prefix - unique
                # Only texts whose prefix reaches beyond their unique tokens can have a partner.
                some = np.flatnonzero((rank > 0) & (left > 0)[doc])
                some = some[np.lexsort((low[some], rank[some], doc[some]))]
                d = doc[some]
                first = np.searchsorted(d, np.arange(len(n)))
                some = some[np.arange(len(d)) - first[d] < left[d]]
                # The same set twice in a block is posted once.
                d = doc[some]
                _, owner = np.unique(key, return_index=True)
                own = np.zeros(len(n), bool)
                own[owner] = True
                some, d = some[own[d]], d[own[d]]
                # Central sets have few tokens of their own.
                central = 1_000_000 * np.maximum(left, 0) // np.maximum(prefix, 1)
                yield pa.RecordBatch.from_arrays(
                    [_signed(low[some]), _signed(key[d]), pa.array(n[d], pa.int64()), pa.array(central[d], pa.int64())], ["token", "key", "n", "central"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "token long, key long, n long, central long")


def _sets(docs: DataFrame, words: int, held) -> DataFrame:
    """(key, tokens, bitmap) of the rows whose ids are in the broadcast Bloom filter `held`."""

    @frugal

    def run(batches):
        bloom, bits = held.value
        for b in batches:
            wanted = in_filter(bloom, bits, b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U))
            b = b.filter(pa.array(wanted))
            for _, data, offsets in blocks(b):
                tokens, bounds = shingle_sets(data, offsets, words)
                n = np.diff(bounds)
                sums = np.append(_U(0), np.cumsum(mix(tokens + _U(1)), dtype=_U))
                key = mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(_U))
                parts = [tokens[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [_signed(key), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([_bitmap(p) for p in parts], pa.binary())],
                    ["key", "tokens", "bitmap"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "key long, tokens binary, bitmap binary")


def _bitmap(tokens: np.ndarray) -> bytes:
    """Four to eight bits per token: 2**k bits, bit (hash mod 2**k) set for each token."""
    bits = 1 << max(6, int(4 * len(tokens) - 1).bit_length())
    on = np.zeros(bits, np.uint8)
    on[(tokens >> _U(16)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def _folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to `size` bytes: a token's bit in the fold is its hash mod the smaller size."""
    out = np.zeros((len(maps), size), np.uint8)
    for k, m in enumerate(maps):
        out[k] = np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, size), axis=0)
    return out.view(_U)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _bound(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """No more tokens than this are shared by sets of n and m tokens with these bitmaps (rows of words)."""
    # A bit that only one of them has set stands for at least one token that the other lacks.
    only = [np.bitwise_count(p & ~q).sum(1, dtype=np.int64) for p, q in ((x, y), (y, x))]
    return np.minimum(n - only[0], m - only[1])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those with 100 |A n B| >= SHARE |A u B|: (a, b). Bit counts first, then the arrays."""
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta"), F.col("bitmap").alias("ba"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb"), F.col("bitmap").alias("bb"))

    @frugal

    def run(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[k].as_buffer(), _U) for c in (2, 3))
                maps = [b.column(c)[k].as_py() for c in (4, 5)]
                maps = _folded(maps, min(map(len, maps)))
                n, m = len(x), len(y)
                most = _bound(maps[:1], maps[1:], np.array([n]), np.array([m]))[0]
                if 100 * most >= SHARE * (n + m - most):
                    shared = _overlap(x, y)
                    ok[k] = 100 * shared >= SHARE * (n + m - shared)
            b = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", "ba", "bb").mapInArrow(run, "a long, b long")


def _candidates(n, m, c, d, x, y, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, bound) of the pairs of unequal components that sizes and bit counts don't rule out."""
    fit = (100 * np.minimum.outer(n, m) >= SHARE * np.maximum.outer(n, m)) & (c[:, None] != d[None, :])
    if same:
        fit &= np.triu(np.ones(fit.shape, bool), 1)
    u, v = np.nonzero(fit)
    shared = np.empty(len(u), np.int64)
    for i in range(0, len(u), 1 << 14):
        p, q = u[i : i + (1 << 14)], v[i : i + (1 << 14)]
        shared[i : i + (1 << 14)] = _bound(x[p], y[q], n[p], m[q])
    fine = 100 * shared >= SHARE * (n[u] + m[v] - shared)
    return u[fine], v[fine], shared[fine]


def _bounded(tiles: DataFrame) -> DataFrame:
    """(bucket, key, comp): of each tile or pair of tiles (rows, others; others null: within rows) the nodes that have a
    partner of another component left by the bit counts. A node is one row of a tile, however many partners it has.
    Equal sets of nodes are one bucket."""

    @frugal

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, others = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                same = others is None
                others = rows if same else others
                n, m = (np.array([r["n"] for r in t], np.int64) for t in (rows, others))
                c, d = (np.array([r["comp"] for r in t], np.int64) for t in (rows, others))
                size = min(len(r["bitmap"]) for r in rows + others)
                x, y = _folded([r["bitmap"] for r in rows], size), _folded([r["bitmap"] for r in others], size)
                u, v, _ = _candidates(n, m, c, d, x, y, same)
                met = {rows[i]["key"]: rows[i]["comp"] for i in np.unique(u).tolist()} | {others[i]["key"]: others[i]["comp"] for i in np.unique(v).tolist()}
                if met:
                    keys = np.array(sorted(met), np.int64)
                    bucket = mix(mix(keys.view(_U)).sum(dtype=_U, keepdims=True) + _U(len(keys))).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(bucket, len(keys))), pa.array(keys), pa.array([met[x] for x in keys.tolist()], pa.int64())], ["bucket", "key", "comp"]
                    )

    return tiles.mapInArrow(run, "bucket long, key long, comp long").dropDuplicates(["bucket", "key"])


def _spanning(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect, inside each bucket, what its exact links connect: fewer than it has nodes. A pair whose
    ends are connected already is not compared."""

    @frugal_group

    def run(key, rows):
        keys, comps = rows.column("key").to_pylist(), rows.column("comp").to_numpy()
        tokens = [np.frombuffer(x.as_buffer(), _U) for x in rows.column("tokens").combine_chunks()]
        maps = rows.column("bitmap").to_pylist()
        n = np.array([len(x) for x in tokens], np.int64)
        bits = _folded(maps, min(map(len, maps)))
        u, v, shared = _candidates(n, n, comps, comps, bits, bits, True)
        root = {c: c for c in comps.tolist()}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i in np.argsort(-shared, kind="stable").tolist():
            a, b = int(u[i]), int(v[i])
            p, q = top(int(comps[a])), top(int(comps[b]))
            if p != q:
                both = _overlap(tokens[a], tokens[b])
                if 100 * both >= SHARE * (n[a] + n[b] - both):
                    root[p] = q
                    out.append((keys[a], keys[b]))
        a, b = zip(*out) if out else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    one = sets.dropDuplicates(["key"])
    return met.join(one, "key").select("bucket", "key", "comp", "tokens", "bitmap").groupBy("bucket").applyInArrow(run, "a long, b long")


def _tiles(postings: DataFrame, known: DataFrame, bits: DataFrame) -> DataFrame:
    """Tiles and pairs of tiles (rows, others) of the buckets whose nodes are in several components."""
    placed = postings.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key")).withColumn("band", _band())
    banded = placed.groupBy("token", "band").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")
    )
    # A band of a bucket is open if there are several components in it and its neighbours.
    near = banded.select("token", F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"), "lo", "hi")
    near = near.groupBy("token", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token", "band")
    open_ = written(banded.join(near, ["token", "band"]).select("token", "band", "rows", "tokens"), "ngram")
    whole = open_.groupBy("token").agg((F.sum("rows").alias("all_rows")), F.sum("tokens").alias("all_tokens"))
    open_ = open_.join(whole, "token").select(
        "token",
        "band",
        F.when((F.col("all_rows") <= TILE) & (F.col("all_tokens") <= TILE_TOKENS), 0)
        .otherwise(F.ceil(F.greatest(F.col("rows") / TILE, F.col("tokens") / TILE_TOKENS)))
        .cast("int").alias("tiles"),
    )
    member = written(
        placed.join(open_, ["token", "band"]).select("token", "tiles", "band", F.struct("key", "n", "comp").alias("m")), "ngram"
    )
    with_bits = lambda rows: rows.join(bits, rows.m.key == bits.key).select(*rows.columns[:-1], F.struct("m.key", "m.n", "m.comp", "bitmap").alias("m"))
    # A small bucket is one tile; buckets of the same nodes (the tokens of a shared passage) are one bucket.
    small = member.where("tiles = 0").groupBy("token").agg(F.sort_array(F.collect_list("m")).alias("members")).select("members").distinct()
    small = with_bits(small.select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("m"))).groupBy("bucket").agg(F.collect_list("m").alias("rows"))
    # In a large one a tile holds one size band's share of the nodes.
    tile = F.pmod(F.xxhash64("m.key"), F.col("tiles")).cast("int").alias("tile")
    large = written(
        with_bits(member.where("tiles > 0").select("token", "band", tile, "m")).groupBy("token", "band", "tile").agg(F.collect_list("m").alias("rows")), "ngram"
    )
    same = [F.col("a.token") == F.col("b.token"), F.expr("(a.band = b.band AND a.tile < b.tile) OR a.band + 1 = b.band")]
    across = large.alias("a").join(large.alias("b"), same).select(F.col("a.rows").alias("rows"), F.col("b.rows").alias("others"))
    alone = small.select("rows").unionByName(large.select("rows")).where("size(rows) > 1")
    return alone.select("rows", F.lit(None).cast(large.schema["rows"].dataType).alias("others")).unionByName(across)


def _band():
    """Sets that can link are in one size band or in neighbouring ones."""
    return F.floor(F.log("n") / F.log(F.lit(100 / SHARE))).cast("int")


def jaccard_components(docs: DataFrame, words: int = WORDS, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: exact components of the links of Jaccard >= 0.75.

    Null text is empty; texts without words have no shingles and link with nothing; repeated rows stay rows. Null ids
    link like others; a component's id is its smallest id, null if it has none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = written(_sizes(docs, words), "ngram")
    total = int(sizes.agg(F.sum("n")).first()[0] or 0)
    nodes = sizes.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("owner"))
    parts = min(parts_for(spark, total * 8, 12 << 20), 1 << 20)
    counted = written(_counted(docs, words, parts), "ngram")
    several = counted.count()
    often = counted.where(F.col("n") >= FREQUENT)
    filters = spark.sparkContext.broadcast((bloom_filter(counted, "token", several), bloom_filter(often, "token", often.count())))
    postings = written(_postings(docs, words, filters).dropDuplicates(["token", "key"]), "ngram")
    filters.destroy()
    banded = postings.withColumn("band", _band())
    stars = (
        banded.groupBy("token", "band")
        .agg(F.max(F.struct("central", "key", "n")).alias("hub"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select("token", "band", "hub")
    )
    # A node points at one hub of higher (central, key), so pointers make a forest.
    best = (
        banded.join(stars, ["token", "band"])
        .where(f"key <> hub.key AND 100 * least(n, hub.n) >= {SHARE} * greatest(n, hub.n)")
        .groupBy("key", "hub")
        .agg(F.count(F.lit(1)).alias("shared"))
        .groupBy("key")
        .agg(F.max_by("hub.key", F.struct("shared", "hub")).alias("b"))
        .select(F.col("key").alias("a"), "b")
    )
    # Nodes of tokens with one node only have no partner; the others' texts are read again for their sets.
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("token")
    postings = written(postings.join(shared, "token"), "ngram")
    wanted = nodes.join(postings.select("key").distinct(), "key", "left_semi").select(F.coalesce("owner", F.lit(0)).cast("long").alias("owner"))
    wanted = written(wanted, "ngram")
    owners = spark.sparkContext.broadcast(bloom_filter(wanted, "owner", wanted.count()))
    sets = written(_sets(docs, words, owners), "ngram")
    owners.destroy()
    links = written(_verified(best, sets), "ngram")
    known = roots(links.distinct())
    bits = sets.select("key", "bitmap").dropDuplicates(["key"])
    met = written(_bounded(_tiles(postings, known, bits)), "ngram")
    known = merged(known, _spanning(met, sets))
    comps = nodes.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    comps = written(comps, "ngram")
    # Written, so that a join on a component of very many sets can be split.
    smallest = written(comps.groupBy("comp").agg(F.min("owner").alias("component_id")), "ngram")
    of_key = comps.join(smallest, "comp").select("key", "component_id")
    linked = sizes.where("n > 0").join(of_key, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of all `documents`. Null and empty texts have no shingles and stand alone, ids may be null or
    repeated, texts may be of any length, an empty table gives no rows; other columns are not looked at."""
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}

_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""
ORACLE_SQL = {"op1_ngram_join": _SQL}
