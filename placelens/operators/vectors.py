"""Vectors: centroids, exact top-k similarity, percentiles, spread, components and density clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .graph import connected_components
from .products import products
from .stats import medians

#: Rows of a block of the all-pairs product; a task holds a strip of blocks.
BLOCK = 2048
#: Centroids that may go to every task.
MOST_CENTROIDS = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), F.sqrt(dot(v, v))))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): mean of each group's vectors, scaled to length one."""
    parts = rows.select(group, F.posexplode(vector).alias("pos", "v")).groupBy(group, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    whole = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))
    return whole.select(group, unit(F.col("mean")).alias("centroid"))


def centroid_scores(rows: DataFrame, key: str, vector: str, means: DataFrame, group: str) -> DataFrame:
    """(key, group, score): each row against each of the few centroids; more than ``MOST_CENTROIDS`` are an error."""
    means = cut(means, "centroids")  # counted and used, but made once
    if means.limit(MOST_CENTROIDS + 1).count() > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    return rows.select(key, vector).crossJoin(F.broadcast(means)).select(key, group, dot(F.col(vector), F.col("centroid")).alias("score"))


def _products(rows: DataFrame, key: str, vector: str, block: int, k: int | None, least: float) -> DataFrame:
    """(key, other, score) of every pair of blocks: of each row the k largest products of at least ``least``, all of them without k.

    Rows are dealt into blocks by a written row number, whatever their keys.
    """
    own = cut(rows.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    n = max(1, -(-own.count() // block))
    own = own.select("k", "v", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("block"))
    kind = own.schema["k"].dataType.simpleString()

    def whole(table: pa.Table) -> pa.Table:
        ids, v = table.column("k").combine_chunks(), table.column("v").combine_chunks().flatten()
        columns = [ids, pa.array(np.zeros(len(ids), np.int32)), v, pa.array(np.full(len(ids), least))]
        return pa.table([table.column("block")[:1].combine_chunks(), *(pa.array([c], pa.list_(c.type)) for c in columns)], names=["block", "vid", "list", "v", "floor"])

    blocks = cut(own.groupBy("block").applyInArrow(whole, f"block int, vid array<{kind}>, list array<int>, v array<double>, floor array<double>"), "blocks-of-vectors")
    found = products(blocks, k, same=True).where(F.col("vid").isNotNull() & (F.col("score") >= least))
    return found.select(F.col("vid").alias(key), "other", "score")


def top_similar(rows: DataFrame, key: str, vector: str, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(key, other, score, rank): the k largest dot products of each row with the others, ties by id.

    Every pair of blocks is a matrix product in a task, which keeps only k
    candidates for each row, and the candidates of all tasks are ranked.  The
    work is that of all pairs: for some ten million rows, not for billions.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "other"))
    return _products(rows, key, vector, block, k, -np.inf).withColumn("rank", rank).where(F.col("rank") <= k)


def similar_pairs(rows: DataFrame, key: str, vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """(key, other, score), in both directions, of the pairs whose dot product is at least ``least``."""
    return _products(rows, key, vector, block, None, least)


def spread(scores: DataFrame, key: str) -> DataFrame:
    """Over rows of (key, group, score): median of the row maxima, their minimum, median of maximum less minimum."""
    each = cut(scores.groupBy(key).agg(F.max("score").alias("hi"), (F.max("score") - F.min("score")).alias("range")), "extremes")
    high = medians(each, [], "hi").select(F.round("median", 6).alias("median_max"))
    wide = medians(each, [], "range").select(F.round("median", 6).alias("median_range"))
    return high.crossJoin(each.agg(F.round(F.min("hi"), 6).alias("min_max"))).crossJoin(wide)  # three single rows


def control_check(scores: DataFrame, controls: DataFrame, key: str) -> DataFrame:
    """(control_max, median_max, passes): no text that has nothing to do with the corpus may score as high as its median does."""
    top = controls.agg(F.round(F.max("score"), 6).alias("control_max"))
    return top.crossJoin(spread(scores, key)).select("control_max", "median_max", (F.col("control_max") < F.col("median_max")).alias("passes"))


def top_entries(scores: Column, n: int) -> Column:
    """The n entries of a map with the largest values, ties by key."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("key")))
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: e["key"])


def shared_top(a: Column, b: Column) -> Column:
    """Entries of the first list that the second has too, in the first's order."""
    return F.array_intersect(a, b)


def principal_components(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, components): projection on the first k principal components."""
    frame = rows.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(frame)
    return model.transform(frame).select(key, vector_to_array("_p").alias("components"))


def density_clusters(similar: DataFrame, points: DataFrame, key: str, least: float, min_samples: int = 5, min_size: int = 15) -> DataFrame:
    """(key, cluster): density clusters of points, -1 for noise.

    ``similar`` (key, other, score) lists the pairs of points that may count,
    in both directions; pairs of at least ``least`` are links.  A point with
    ``min_samples`` links is a core.  Clusters are the components of linked
    cores, named by their smallest key; other points join the cluster of their
    most similar core; clusters below ``min_size`` are noise.
    """
    links = cut(similar.where(F.col("score") >= least).select(F.col(key).alias("a"), F.col("other").alias("b"), "score"), "links")  # read often, found once
    cores = links.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("a")
    ends = cores.withColumnRenamed("a", "b")
    inner = links.join(cores, "a", "left_semi").join(ends, "b", "left_semi")
    roots = connected_components(inner.select("a", "b")).withColumnRenamed("node", "b")
    own = roots.select(F.col("b").alias(key), "root")
    border = links.join(cores, "a", "left_anti").join(roots, "b")
    border = border.groupBy("a").agg(F.max_by("root", F.struct("score", (-F.col("b")).alias("b"))).alias("root")).withColumnRenamed("a", key)
    placed = own.unionByName(border)
    sizes = placed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    placed = placed.join(sizes.select("root"), "root")
    return points.select(key).join(placed, key, "left").select(key, F.coalesce("root", F.lit(-1)).alias("cluster"))
