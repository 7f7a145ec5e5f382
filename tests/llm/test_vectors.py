"""Exact and approximate search over vectors."""

import math

import numpy as np
import pytest

from needledrop.llm.forest import grow, leaves_of, margins, neighbours, search_leaves
from needledrop.llm.queries import op10_forest_neighbours
from needledrop.llm.topk import exact_top_k, search_shard

KIND = "vec_id long, embedding array<float>, label int, rank string, score string, leaf int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "a", "b", 1) for i, v in vectors], KIND)


def sample(n=300, d=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=d)]) for i in range(n)]


def odd():
    return [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [math.nan] * 8), (903, [math.inf] + [0.0] * 7), (None, [1.0] * 8)]


def brute(vectors, asked, k, value):
    out = {}
    for q, v in asked:
        scored = sorted((-value(v, w), i) for i, w in vectors if i != q)[:k]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def integer(v, w):
    return sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, w))


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard_rows", [16, 100_000])
def test_exact_top_k_equals_brute_force(spark, shard_rows):
    vectors = sample() + [(400, sample()[3][1]), (401, sample()[3][1])]  # ties
    asked = [v for v in vectors if v[0] % 10 == 0]
    have = frame(spark, vectors + odd())
    df = exact_top_k(frame(spark, asked + odd()), have, 10, query_rows=7, shard_rows=shard_rows)
    assert got(df) == brute(vectors, asked, 10, integer)


def test_exact_top_k_of_few_short_or_no_vectors(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, [0.0, 0.0])]
    df = exact_top_k(frame(spark, few), frame(spark, few), 10)
    found = got(df)
    assert found[1] == [(1, 2, 1024 * 1024), (2, 3, 0), (3, 4, 0)]
    empty = frame(spark, [])
    assert exact_top_k(empty, empty, 10).count() == 0
    assert exact_top_k(frame(spark, few), empty, 10).count() == 0


def test_non_essential_terms_are_probed_only_while_competitive():
    rng = np.random.default_rng(1)
    postings, query = rng.integers(-50, 50, (5000, 16)), rng.integers(-50, 50, 16)
    query[4:] //= 25
    score, ids = search_shard(query, -1, postings, np.arange(5000), postings.max(axis=0), postings.min(axis=0), 10)
    want = np.lexsort((np.arange(5000), -(postings @ query)))[:10]
    assert list(ids) == list(want) and list(score) == list((postings @ query)[want])


@pytest.mark.parametrize("block_rows", [64, 65536])
def test_forest_recall_and_scores(spark, block_rows):
    vectors = sample(1200, 16, 3) + [(2000 + i, sample(1, 16, 8)[0][1]) for i in range(300)]  # a hot vector
    asked = [v for v in vectors if v[0] % 20 == 0]
    zero = [(3000, [0.0] * 16)]
    df = neighbours(frame(spark, asked), frame(spark, vectors + odd() + zero), 20, block_rows=block_rows)
    found = got(df)
    dot = lambda v, w: float(sum(a * b for a, b in zip(v, w)))
    want = brute(vectors, asked, 20, dot)
    assert {q: len(r) for q, r in found.items()} == {q: 20 for q in want}
    share = [len({i for _, i, _ in found[q]} & {i for _, i, _ in want[q]}) / 20 for q in want]
    assert np.mean(share) >= 0.9
    table = dict(vectors)
    for q, best in found.items():
        assert [(r, i) for r, i, _ in best] == [(n + 1, i) for n, (_, i) in enumerate(sorted((-s, i) for _, i, s in best))]
        assert all(abs(s - dot(table[q], table[i])) < 1e-12 for _, i, s in best)
    # Equal scores go to the smaller ids: a copy of the hot vector finds its first copies.
    hot = [i for _, i, _ in found[2000]]
    assert hot == list(range(2001, 2021))


def recall_of(df, names, vectors, asked, k=20):
    score = vectors[asked] @ vectors.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = names[np.argsort(-score, axis=1)[:, :k]]
    found = got(df)
    assert set(found) == set(names[asked].tolist()) and {len(r) for r in found.values()} == {k}
    return np.mean([len({i for _, i, _ in found[q]} & set(w)) / k for q, w in zip(names[asked].tolist(), want.tolist())])


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_forest_recall_on_the_given_tables(spark, scale):
    folder = f"/root/testdata/{scale}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    vectors, names = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    assert recall_of(op10_forest_neighbours(spark, folder), names, vectors, np.flatnonzero(names % 20 == 0)) >= 0.95


@pytest.mark.parametrize("spread", [0.0, 0.5])
@pytest.mark.parametrize("n", [1000, 5000])
def test_forest_recall_without_structure_and_with_uneven_norms(spark, n, spread):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, 64)) * rng.lognormal(0, spread, (n, 1))).astype(np.float32)
    df = frame(spark, list(enumerate(vectors.tolist())))
    found = neighbours(df.where("vec_id % 20 = 0"), df, 20, block_rows=700, query_rows=90)
    assert recall_of(found, np.arange(n), vectors.astype(float), np.arange(0, n, 20)) >= 0.95


@pytest.mark.parametrize("copies", [1, 15, 25, 60])
def test_every_query_has_k_rows_or_all(spark, copies):
    groups = [(100 * g + i, sample(3, 8, 5)[g][1]) for g in range(3) for i in range(copies)]
    have = frame(spark, groups + groups[:2])
    found = got(neighbours(have, have, 20, sample_rows=40, leaf_rows=4))
    assert {q: len(r) for q, r in found.items()} == {i: min(20, 3 * copies - 1) for i, _ in groups}


def test_queue_follows_the_margins():
    points = np.random.default_rng(2).normal(size=(500, 6))
    forest = grow(points, 4, 16, 1)
    missed = margins(forest, points[:20])
    for q, m in zip(points, missed):
        order = search_leaves(forest, q, lambda found: False)
        assert sorted(order) == list(range(missed.shape[1])) and np.allclose(m[order], np.sort(m))
    # A point may lie on a border, where the order of a sum decides its side.
    assert np.allclose(np.take_along_axis(missed, leaves_of(forest, points[:20]), axis=1), 0)


def test_forest_of_few_or_no_vectors(spark):
    few = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None)]
    assert got(neighbours(frame(spark, few), frame(spark, few), 20)) == {1: [(1, 2, 0.5)], 2: [(1, 1, 0.5)]}
    assert neighbours(frame(spark, few), frame(spark, []), 20).count() == 0
    assert neighbours(frame(spark, []), frame(spark, few), 20).count() == 0
