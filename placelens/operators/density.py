"""Hierarchical density clusters: mutual reachability, a spanning forest and the condensed tree of its merges.

The forest comes from Boruvka rounds.  Its edges are then merged in order of
length, in batches: within a batch, the components that its edges connect are
independent of each other and each is one task.  What a component hands on is
small: the points of one below the least size of a cluster, or the sums of the
cluster that it has become.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, discard
from .graph import connected_components

#: Smallest cluster, and the neighbour, the point itself counted, whose distance is the core distance.
MIN_SIZE, MIN_SAMPLES = 15, 5
#: Edges of a batch of merges, about.
EDGES = 1 << 14
#: Distances below this count as this, so that equal points have a density.
LEAST = 1e-9

_KIND = "kind string, point long, comp long, n long, cluster string, parent string, total double, top double, below double, own double, lam double, points array<long>"
_COLUMNS = [x.strip().split(" ")[0] for x in _KIND.split(",")]


def core_distances(neighbours: DataFrame, key: str, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(key, core): distance to the ``min_samples``-th nearest point, the point itself counted, from (key, other, distance, rank)."""
    return neighbours.where(F.col("rank") == min_samples - 1).select(key, F.col("distance").alias("core"))


def mutual_reachability(neighbours: DataFrame, key: str, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(a, b, w) of each pair of neighbours, a < b: the largest of their distance and both core distances."""
    core = core_distances(neighbours, key, min_samples)
    pairs = neighbours.select(F.least(key, "other").alias("a"), F.greatest(key, "other").alias("b"), "distance").distinct()
    a, b = (core.select(F.col(key).alias(x), F.col("core").alias(f"core_{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").groupBy("a", "b").agg(F.min(F.greatest("distance", "core_a", "core_b")).alias("w"))
    return near.select("a", "b", F.greatest("w", F.lit(LEAST)).alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of the minimum spanning forest; of equal weights the smaller ends come first.

    Boruvka: in each round every component takes its least edge to another one;
    the number of components at least halves.
    """
    live = cut(edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")).where("a <> b"), "forest-edges")
    forest = None
    while not live.isEmpty():
        each = F.struct("w", "a", "b", "x", "y").alias("e")
        ends = live.select(F.explode(F.array("x", "y")).alias("c"), each)
        chosen = ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        chosen = cut(chosen.select("a", "b", "w", "x", "y"), "least-edges")
        forest = chosen if forest is None else forest.union(chosen)
        roots = cut(connected_components(chosen, "x", "y"), "merged-components")
        x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "xy")
        rest = live.join(x, "x").join(y, "y").where("rx <> ry").select("a", "b", "w", F.col("rx").alias("x"), F.col("ry").alias("y"))
        rest = cut(rest, "forest-edges")
        discard(live, roots)
        live = rest
    return edges.select("a", "b", "w").limit(0) if forest is None else forest.select("a", "b", "w")


class _Component:
    """Points of a component below the least size, or the cluster that it is: sum of densities at which points leave it, the largest of them, and the best stability below it."""

    __slots__ = ("n", "cluster", "total", "top", "below", "points")

    def __init__(self, n: int, cluster: str | None, total: float, top: float, below: float, points: list[int]):
        self.n, self.cluster, self.total, self.top, self.below, self.points = n, cluster, total, top, below, points


def _row(kind: str, **values) -> dict:
    return dict.fromkeys(_COLUMNS) | {"kind": kind} | values


def merged(a: _Component, b: _Component, name: str, w: float, min_size: int) -> tuple[_Component, list[dict]]:
    """What two components become at distance ``w``, the points that leave a cluster there, and the clusters that end there."""
    lam, out = 1 / w, []
    if a.cluster and b.cluster:
        best = 0.0
        for x in (a, b):
            own = x.total - x.n * lam
            best += max(own, x.below)
            out.append(_row("cluster", cluster=x.cluster, parent=name, own=own, below=x.below, top=x.top, n=x.n))
        return _Component(a.n + b.n, name, (a.n + b.n) * lam, lam, best, []), out
    if a.cluster or b.cluster:
        large, small = (a, b) if a.cluster else (b, a)
        out = [_row("point", point=p, cluster=large.cluster, lam=lam) for p in small.points]
        return _Component(large.n + small.n, large.cluster, large.total + small.n * lam, large.top, large.below, []), out
    points = a.points + b.points
    if len(points) < min_size:
        return _Component(len(points), None, 0.0, 0.0, 0.0, points), out
    out = [_row("point", point=p, cluster=name, lam=lam) for p in points]
    return _Component(len(points), name, len(points) * lam, lam, 0.0, []), out


def _merge_all(min_size: int):
    """Merges along the edges of one group of components: all points and clusters that are settled, and the state of the whole."""

    def run(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        state: dict[int, _Component] = {}
        for x in nodes.itertuples(index=False):
            single = x.n is None or x.n != x.n
            state[x.node] = _Component(1, None, 0.0, 0.0, 0.0, [x.node]) if single else _Component(int(x.n), x.cluster, x.total, x.top, x.below, list(x.points))
        up: dict[int, int] = {}

        def root(n: int) -> int:
            while (p := up.get(n, n)) != n:
                up[n] = up.get(p, p)
                n = p
            return n

        out: list[dict] = []
        for e in edges.sort_values(["w", "a", "b"]).itertuples(index=False):
            x, y = root(e.x), root(e.y)
            low, high = min(x, y), max(x, y)
            state[low], rows = merged(state[x], state.pop(y) if y != low else state[y], f"{e.a}:{e.b}", e.w, min_size)
            state.pop(high, None)
            up[high] = low
            out += rows
        for comp, x in state.items():
            out.append(_row("state", comp=comp, n=x.n, cluster=x.cluster, total=x.total, top=x.top, below=x.below, points=x.points))
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


def condensed_tree(forest: DataFrame, min_size: int = MIN_SIZE) -> tuple[DataFrame, DataFrame]:
    """(point, cluster, lam) and (cluster, parent, own, below, top, n) of the condensed tree of a written forest.

    A cluster is born where components of less than ``min_size`` points make one
    of as many, and ends where two clusters meet; lam is the density, one over
    the distance, at which a point leaves it going up.  own is the stability,
    below the best one of the clusters inside, top the largest density.  The
    whole of a single tree is no cluster; of several trees each one's is.
    """
    count = forest.count()
    batches = max(1, -(-count // EDGES))
    ordered = forest.repartitionByRange(batches, "w", "a", "b") if batches > 1 else forest
    live = cut(ordered.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y"), F.spark_partition_id().alias("batch") if batches > 1 else F.lit(0).alias("batch")), "ordered-edges")
    states = points = clusters = None
    none = {"n": "long", "cluster": "string", "total": "double", "top": "double", "below": "double", "points": "array<long>"}
    for i in range(batches):
        own = live.where(F.col("batch") == i)
        roots = cut(connected_components(own, "x", "y"), "groups-of-batch")
        if states is None:
            nodes = roots.select("root", "node", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        else:
            nodes = roots.join(states, roots["node"] == states["comp"], "left").select("root", "node", *none)
        grouped = own.join(roots, own["x"] == roots["node"]).select(F.col("root").alias("of"), "a", "b", "w", "x", "y")
        done = cut(nodes.groupBy("root").cogroup(grouped.groupBy("of")).applyInPandas(_merge_all(min_size), _KIND), "merges")
        new = done.where("kind = 'state'").select("comp", *none)
        if states is not None:
            new = states.join(roots, states["comp"] == roots["node"], "left_anti").union(new)
        states = cut(new, "components")
        part = done.where("kind = 'point'").select("point", "cluster", "lam"), done.where("kind = 'cluster'").select("cluster", "parent", "own", "below", "top", "n")
        points, clusters = part if points is None else (points.union(part[0]), clusters.union(part[1]))
        if i + 1 < batches:
            x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "xy")
            rest = live.where(F.col("batch") > i).join(x, "x", "left").join(y, "y", "left")
            rest = cut(rest.select("a", "b", "w", F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"), "batch"), "ordered-edges")
            discard(live)
            live = rest
    tops = states.where("cluster is not null")
    alone = tops.limit(2).count() < 2
    ends = tops.select("cluster", F.lit(None).cast("string").alias("parent"), (F.lit(-1.0) if alone else F.col("total")).alias("own"), F.lit(float("inf")).alias("below") if alone else F.col("below"), "top", "n")
    return points, clusters.union(ends)


def _chosen(clusters: DataFrame) -> DataFrame:
    """(cluster, pick, top): the topmost ancestor, itself included, whose stability is at least that of what is inside; by doubling steps up."""
    good = F.col("own") >= F.col("below")
    steps = cut(clusters.select("cluster", F.col("parent").alias("up"), F.when(good, F.col("cluster")).alias("pick"), F.when(good, F.col("top")).alias("top")), "steps-up")
    while not steps.where("up is not null").isEmpty():
        above = steps.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("pick").alias("pick2"), F.col("top").alias("top2"))
        both = steps.join(above, "up", "left")
        higher = both.select("cluster", F.col("up2").alias("up"), F.coalesce("pick2", "pick").alias("pick"), F.when(F.col("pick2").isNotNull(), F.col("top2")).otherwise(F.col("top")).alias("top"))
        higher = cut(higher, "steps-up")
        discard(steps)
        steps = higher
    return steps.select("cluster", "pick", "top")


def density_hierarchy(neighbours: DataFrame, points: DataFrame, key: str, min_size: int = MIN_SIZE, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(key, cluster, probability) of each point, from its nearest neighbours (key, other, distance, rank from 1), keys being longs.

    Clusters are those of the condensed tree over mutual reachability whose
    stability is the largest; a cluster is named by its smallest key, noise is
    -1 with probability 0.  A point's probability is the density at which it
    leaves its cluster over the largest at which any does.  Neighbour lists
    bound the graph: clusters that no list connects are trees of their own.  An
    empty table gives an empty one; a point without enough neighbours is noise.
    """
    forest = cut(spanning_forest(mutual_reachability(neighbours, key, min_samples)), "forest")
    own = points.select(key).distinct()
    if forest.isEmpty():
        return own.select(key, F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("probability"))
    members, clusters = condensed_tree(forest, min_size)
    placed = members.join(_chosen(clusters), "cluster").where("pick is not null")
    names = placed.groupBy("pick").agg(F.min("point").alias("name"))
    placed = placed.join(names, "pick").select(F.col("point").alias(key), F.col("name"), F.least(F.lit(1.0), F.col("lam") / F.col("top")).alias("p"))
    return own.join(placed, key, "left").select(key, F.coalesce("name", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("p", F.lit(0.0)).alias("probability"))
