"""Density hierarchy against a plain top-down version, and its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.operators import density


def neighbour_lists(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:k]
        out += [(i, int(j), float(d[i, j]), r) for r, j in enumerate(order, 1)]
    return out


def plain(lists, n, min_size, min_samples):
    """Labels and probabilities by walking down from the longest edge of each tree."""
    core = {i: d for i, _, d, r in lists if r == min_samples - 1}
    edges = sorted({(max(d, core[i], core[j], density.LEAST), min(i, j), max(i, j)) for i, j, d, _ in lists if i in core and j in core})
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    tree = []
    for w, a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            up[x] = y
            tree.append((w, a, b))
    near = {i: set() for i in range(n)}
    for e in tree:
        near[e[1]].add(e)
        near[e[2]].add(e)

    def reach(start, without):
        seen, todo = {start}, [start]
        while todo:
            for e in near[todo.pop()]:
                for i in e[1:]:
                    if e not in without and i not in seen:
                        seen.add(i)
                        todo.append(i)
        return seen

    picked = []

    def walk(points, birth):
        """(stability, chosen clusters below or it, rows of the points) of a cluster that is born at a density."""
        gone, leave, own, top, inside = set(), {}, 0.0, 0.0, set(points)
        for e in sorted((e for e in tree if e[1] in points and e[2] in points), reverse=True):
            if e[1] not in inside:
                continue
            lam = 1 / e[0]
            gone.add(e)
            left, right = reach(e[1], gone) & inside, reach(e[2], gone) & inside
            top = lam
            small = [s for s in (left, right) if len(s) < min_size]
            if not small:
                own += (lam - birth) * len(inside)
                parts = [walk(left, lam), walk(right, lam)]
                best = sum(p[0] for p in parts)
                rows = {i: v for p in parts for i, v in p[2].items()}
                chosen = [c for p in parts for c in p[1]]
                leave |= {i: lam for i in inside}
                return (own, [(leave, top)], leave) if own >= best else (best, chosen, rows | leave)
            for s in small:
                own += (lam - birth) * len(s)
                leave |= {i: lam for i in s}
                inside -= s
        return own, [(leave, top)], leave

    trees = [t for t in {frozenset(reach(i, set())) for i in range(n)} if len(t) >= min_size]
    for t in trees:
        if len(trees) > 1:
            picked += walk(set(t), 0.0)[1]
        else:
            for e in sorted((e for e in tree), reverse=True):  # the whole is no cluster
                inside = reach(e[1], {f for f in tree if f > e})
                left, right = reach(e[1], {f for f in tree if f >= e}), reach(e[2], {f for f in tree if f >= e})
                if e[1] in inside and min(len(left), len(right)) >= min_size and inside == max((reach(i, {f for f in tree if f > e}) for i in inside), key=len):
                    if any(len(reach(i, {f for f in tree if f > e})) >= min_size for i in set(t) - inside):
                        continue
                    picked += walk(left, 1 / e[0])[1] + walk(right, 1 / e[0])[1]
                    break
    labels, probs = [-1] * n, [0.0] * n
    for leave, top in picked:
        for i, lam in leave.items():
            labels[i], probs[i] = min(leave), min(1.0, lam / top)
    return labels, probs


def blobs(seed, sizes, noise=0, apart=6.0):
    r = np.random.default_rng(seed)
    parts = [r.normal(r.uniform(-apart, apart, 3), r.uniform(0.1, 0.8), (n, 3)) for n in sizes]
    return np.concatenate([*parts, r.uniform(-apart, apart, (noise, 3))])


@pytest.mark.parametrize("seed, sizes, noise, edges", [(1, [30, 25, 40], 10, 1 << 14), (2, [60, 18, 18, 5], 30, 60)])
def test_hierarchy_equals_a_walk_down(spark, monkeypatch, seed, sizes, noise, edges):
    monkeypatch.setattr(density, "EDGES", edges)
    x = blobs(seed, sizes, noise)
    lists = neighbour_lists(x, 12)
    want = plain(lists, len(x), 8, 4)
    df = spark.createDataFrame(lists, "id long, other long, distance double, rank int").repartition(4)
    points = spark.createDataFrame([(i,) for i in range(len(x))], "id long")
    got = sorted(density.density_hierarchy(df, points, "id", 8, 4).collect())
    assert [r["cluster"] for r in got] == want[0]
    assert [r["probability"] for r in got] == pytest.approx(want[1], rel=1e-9)


def test_forest_equals_kruskal(spark):
    r = np.random.default_rng(5)
    edges = {tuple(sorted(map(int, r.choice(120, 2, replace=False)))): float(r.integers(1, 9)) for _ in range(300)}
    rows = sorted((w, a, b) for (a, b), w in edges.items())
    up = list(range(120))
    want = set()
    for w, a, b in rows:
        x, y = up[a], up[b]
        if x != y:
            want.add((a, b, w))
            up = [x if u == y else u for u in up]
    got = density.spanning_forest(spark.createDataFrame([(a, b, w) for w, a, b in rows], "a long, b long, w double").repartition(3))
    assert set(map(tuple, got.collect())) == want


def test_equal_points_few_points_and_none(spark):
    kind = "id long, other long, distance double, rank int"
    x = np.concatenate([np.zeros((20, 3)), np.ones((20, 3))])
    lists = neighbour_lists(x, 19)
    points = spark.createDataFrame([(i,) for i in range(41)], "id long")
    got = {r["id"]: (r["cluster"], r["probability"]) for r in density.density_hierarchy(spark.createDataFrame(lists, kind), points, "id", 8, 4).collect()}
    assert {got[i] for i in range(20)} == {(0, 1.0)} and {got[i] for i in range(20, 40)} == {(20, 1.0)} and got[40] == (-1, 0.0)
    empty = density.density_hierarchy(spark.createDataFrame([], kind), points, "id")
    assert {(r["cluster"], r["probability"]) for r in empty.collect()} == {(-1, 0.0)}
    assert density.density_hierarchy(spark.createDataFrame([], kind), points.limit(0), "id").count() == 0
