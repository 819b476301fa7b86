"""Nearest vectors by inverted lists against all pairs."""

import numpy as np
import pytest

from placelens.operators import products, similar, vectors


def by_hand(keys, x, k):
    score = np.round(x @ x.T, 9)
    out = []
    for i, a in enumerate(keys):
        order = [j for j in np.lexsort((keys, -score[i])) if keys[j] != a][:k]
        out += [(int(a), int(keys[j]), r, score[i, j]) for r, j in enumerate(order, 1)]
    return out


def check(spark, keys, x, k):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(keys, x)], "id long, v array<double>").repartition(4)
    got = sorted((r["id"], r["other"], r["rank"], r["score"]) for r in similar.top_similar(df, "id", "v", k).collect())
    want = sorted(by_hand(np.array(keys), x, k), key=lambda r: (r[0], r[2]))
    got.sort(key=lambda r: (r[0], r[2]))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-8)


def test_clustered_vectors_compare_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "PER_LIST", 16)
    monkeypatch.setattr(similar, "BLOCK", 64)
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 8))
    x = np.repeat(centres, 40, axis=0) + r.normal(size=(1600, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    check(spark, list(range(1600)), x, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    own = similar.cut(similar.distinct_vectors(df, "id", "v", 5), "own")
    assert similar.pairs_compared(similar.search(own, 6)) < 0.1 * 1600**2


def test_copies_lengths_and_ties(spark, monkeypatch):
    monkeypatch.setattr(similar, "PER_LIST", 8)
    monkeypatch.setattr(similar, "BLOCK", 32)
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 4)) * r.uniform(0.1, 9, (120, 1))
    x[:50] = x[0]  # a group of copies larger than k and than a block
    x[50:60] = 0
    x[60:90] = np.round(x[60:90])
    check(spark, (np.arange(120) * 7 % 120).tolist(), x, 6)
    check(spark, list(range(3)), x[57:60], 6)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0])], "id long, v array<double>")
    assert similar.top_similar(df, "id", "v", 3).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert similar.top_similar(one, "id", "v", 3).count() == 0


def test_neighbours_with_names_and_missing_ones(spark):
    top = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2), (1, 9, 0.7, 3), (2, 9, 0.9, 1)], "k long, other long, score double, rank int")
    catalogue = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", "z")], "k long, rank string, score string")
    got = {r.k: (r.similar, r.missing) for r in similar.with_neighbours(top, catalogue, "k", ["rank", "score"]).collect()}
    assert got[2] == ([], 1) and got[1][1] == 1
    assert [(x.rank, x.other, x.score, tuple(x.named)) for x in got[1][0]] == [(1, 2, 0.9, (None, "y")), (2, 3, 0.8, ("c", "z"))]
    assert similar.with_neighbours(top.limit(0), catalogue, "k", ["rank"]).count() == 0


def test_scores_closer_than_single_precision(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 32)
    monkeypatch.setattr(similar, "PER_LIST", 8)
    monkeypatch.setattr(products, "TILE", 16)
    monkeypatch.setattr(products, "STRIP_BYTES", 5000)
    monkeypatch.setattr(products, "STREAMED", 2)
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(1, 6)), 150, axis=0) + r.permutation(150)[:, None] * 1e-8
    x = np.concatenate([x, r.normal(size=(100, 6)), 1e-6 * r.normal(size=(20, 6))])
    check(spark, list(range(270)), x, 5)
    check(spark, list(range(270)), x * 1e3, 5)
    huge = np.concatenate([x[:20], x[150:160] * 1e20])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(huge)], "id long, v array<double>")
    assert similar.top_similar(df, "id", "v", 3).count() == 90


def test_blocks_are_sent_by_strip_not_by_pair():
    for count in (1, 7, 50, 300, 3000):
        per, strips, parts = products.shape(count, 1 << 20, 36)
        assert per * strips >= count and strips * parts >= min(36, count)
        assert strips + parts <= max(13, count / 16)
        assert per << 20 <= products.STRIP_BYTES and count / parts <= products.STREAMED


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_pairs_above_a_score(spark, block):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(150, 3)), 1)
    x[:20] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    score = np.round(x @ x.T, 9)
    got = {(p.id, p.other): p.score for p in vectors.similar_pairs(df, "id", "v", 0.5, block).collect()}
    assert set(got) == {(i, j) for i in range(150) for j in range(150) if i != j and score[i, j] >= 0.5}
    assert all(abs(s - score[p]) < 2e-9 for p, s in got.items())


def test_density_clusters_find_the_links_once(spark):
    rows = spark.createDataFrame([(i, j, 0.9) for i in range(8) for j in range(8) if i != j], "k long, other long, score double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    points = spark.createDataFrame([(i,) for i in range(9)], "k long")
    got = {x.k: x.cluster for x in vectors.density_clusters(rows.mapInArrow(count, rows.schema), points, "k", 0.5, 5, 6).collect()}
    assert got == {**dict.fromkeys(range(8), 0), 8: -1} and seen.value == 56
