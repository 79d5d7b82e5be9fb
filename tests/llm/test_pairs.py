"""n-gram join and vectors against brute force."""

import random
import re

import numpy as np
import pytest

from planquarry.llm import ngram_join, vectors
from tests.llm.cases import UPPER, documents, frame, table_dir


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(w) >= 5:
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def groups(ids, linked):
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    found = groups(ids, links)
    return sorted((i, len(sets[i]), found[i]) for i in ids)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_matches_brute_force(spark, tmp_path, seed, monkeypatch):
    rows = documents(seed, near=60, passage=60)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    sf = table_dir(spark, tmp_path, documents=frame(spark, rows).repartition(5))
    got = sorted(tuple(r) for r in ngram_join.op1_ngram_join(spark, sf).collect())
    assert got == jaccard_groups(rows)


def test_jaccard_saturated_filters(spark, monkeypatch):
    """Filters that say yes to everything cost time, not links."""
    rows = documents(3)
    made = ngram_join.bloom_filter
    monkeypatch.setattr(ngram_join, "bloom_filter", lambda *a: (np.full_like(made(*a)[0], 255), made(*a)[1]))
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert got == jaccard_groups(rows)


def test_jaccard_empty_and_repeated(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f"), (9, "a b c d e q"), (7, None), (7, "")]
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert got == [(2, 2, 2), (5, 2, 2), (5, 2, 2), (7, 0, 7), (7, 0, 7), (9, 2, 9)]


def test_jaccard_null_ids(spark):
    big = 2**53 + 1
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g h"), (big, "q r s t u v w x y"), (big + 2, "q r s t u v w x y z"), (None, "k l m n o p")]
    got = [tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 3, None), (None, 4, None), (big, 5, big), (big + 2, 6, big), (None, 2, None)], key=str)


def test_jaccard_threshold_is_exact(spark):
    """Sets of 10 and 11 shingles that share 9: 900 < 75 * 12 is false, so they link; one word less and they don't."""
    base = [f"t{i}" for i in range(14)]
    linked = [(1, " ".join(base)), (2, " ".join(["z0", "z1"] + base[1:]))]
    assert jaccard_groups(linked)[1][2] == 1
    apart = [(1, " ".join(base)), (2, " ".join(["z0", "z1"] + base[2:]))]
    for rows in (linked, apart):
        got = sorted(tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
        assert got == jaccard_groups(rows)


def cosine_rows(seed=0):
    r = np.random.RandomState(seed)
    rows, nan = [], float("nan")
    for label in (1, 2):
        centre = r.normal(size=16)
        for _ in range(60):
            rows.append((list(map(float, (centre + r.normal(size=16) * 0.25).astype(np.float32))), label))
        for _ in range(40):
            rows.append((list(map(float, r.normal(size=16).astype(np.float32))), label))
    rows += [(rows[0][0], 1)] * 5 + [(rows[0][0], 2), (rows[0][0], None), (None, 1), ([0.0] * 16, 1), ([nan] * 16, 1), ([1.0] * 3, 1), ([], 1)]
    rows.append(([None] + [1.0] * 15, 1))
    return [(k * 2 + 1, e, label) for k, (e, label) in enumerate(rows)]


@pytest.mark.parametrize("tile", [16, 400])
def test_vectors_match_brute_force(spark, tile):
    rows = cosine_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, tile=tile).collect()}
    fine = [(i, np.array(e, float), y) for i, e, y in rows if y is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    links = [
        (a[0], b[0])
        for k, a in enumerate(fine)
        for b in fine[k + 1 :]
        if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93
    ]
    assert links
    comp = groups([r[0] for r in rows], links)
    count = {i: sum(i in link for link in links) for i in comp}
    found = sum(v[0] for v in got.values())
    # Filters find nearly every pair, and nothing that is no link.
    assert found >= 0.98 * 2 * len(links)
    assert all(got[i][0] <= count[i] for i in comp)
    assert {i: v[1:] for i, v in got.items()} == {i: (comp[i], comp[i] == i) for i in comp}


def test_recall_at_the_threshold():
    r = np.random.RandomState(5)
    x = r.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=(800, 64))
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(vectors.decode(x), vectors.decode(y))]
    assert np.mean(met) >= 0.98


def test_no_more_than_one_link_in_five_hundred_is_missed_at_the_threshold():
    r = np.random.RandomState(11)
    x = r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=(6000, 64))
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    for cosine, most in ((0.93, 0.002), (0.96, 0.0002)):
        y = cosine * x + np.sqrt(1 - cosine**2) * z
        met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(vectors.decode(x), vectors.decode(y))]
        assert 1 - np.mean(met) <= most


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, links int")
    assert vectors.near_vectors(df).count() == 0


def test_components_of_long_paths(spark):
    from planquarry.llm.common import components

    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    random.Random(0).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


def test_vector_code_grows_with_the_label():
    """Caps of large labels hold no more vectors, and lose no more pairs."""
    assert vectors.code_for(0) == vectors.code_for(30_000) == (vectors.CODE, vectors.CAP, vectors.LEAST)
    r = np.random.RandomState(3)
    x = r.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    y = 0.94 * x + np.sqrt(1 - 0.94**2) * z / np.linalg.norm(z, axis=1)[:, None]
    for n in (10**5, 10**6):
        code, *_ = rule = vectors.code_for(n)
        one, other = vectors.decode(x, *rule), vectors.decode(y, *rule)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(one, other)]) >= 0.995
        every = np.concatenate(one)
        assert len(every) / (code * code) * n / len(x) <= 1.5 * vectors.CAP_ROWS


def test_vector_decoding_finds_every_filter_over_the_cap():
    r = np.random.RandomState(4)
    x = r.normal(size=(60, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn, a, b = vectors._code(16, 20)
    y = x @ turn
    for cap, least in ((1.5, 3), (2.6, 8)):
        for k, found in enumerate(vectors.decode(x, 20, cap, least)):
            every = ((y[k, :8] @ a.T)[:, None] + (y[k, 8:] @ b.T)[None, :]).ravel()
            over = np.flatnonzero(every >= cap / 4)
            assert sorted(found) == sorted(over if len(over) >= least else np.argsort(-every, kind="stable")[:least])


def test_vectors_signed_zeros_and_null_ids(spark):
    rows = [(1, [0.0, 1.0], "a"), (2, [-0.0, 1.0], "a"), (3, [0.0, 1.0, 0.0], "a"), (None, [1.0, 0.0], "b"), (5, None, "a"), (6, [0.0, 0.0], "a")]
    got = {(r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (None, 0, None), (5, 0, 5), (6, 0, 6)}
