"""Lift, ranks, quantiles, agreement, thresholds, correlation and permutation tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import cut


def lift(mentions: DataFrame) -> DataFrame:
    """(id, region, n, expected, lift) of mentions (site_id, region, id), one row for each site and id.

    expected spreads an id's sites over regions as all sites with mentions are
    spread; sites without mentions have no part in it.
    """
    base = mentions.select("site_id", "region").distinct().groupBy("region").agg(F.count("*").alias("base"))
    base = base.withColumn("total", F.sum("base").over(Window.partitionBy(F.lit(1))))
    counts = mentions.groupBy("id", "region").agg(F.count("*").alias("n"))
    counts = counts.withColumn("all", F.sum("n").over(Window.partitionBy("id"))).join(base, "region")
    expected = F.col("all") * F.col("base") / F.col("total")
    return counts.select("id", "region", "n", F.round(expected, 3).alias("expected"), F.round(F.col("n") / expected, 3).alias("lift"))


def top_region(lifts: DataFrame, floor: int = 3) -> DataFrame:
    """Region of the largest lift of each id among those with at least ``floor`` sites; ids without one are absent."""
    order = Window.partitionBy("id").orderBy(F.desc("lift"), "region")
    return lifts.where(F.col("n") >= floor).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def floor_quantile(values: Column, p: float) -> Column:
    """Element floor(n * p) of a sorted array, the last at most."""
    n = F.size(values)
    return F.get(values, F.least(n - 1, F.floor(n * F.lit(p)).cast("int")))


def running_counts(rows: DataFrame, keys: list[str], order: list[str], count: str) -> DataFrame:
    """Adds _upto and _all: sums of ``count`` over the rows of the same ``keys`` up to this one in ``order``, and over all of them.

    Rows are dealt by ranges of keys and order and written; sums of whole parts
    come from a table of one row for each part and key, so that a group of any
    size is spread over tasks.  Each combination of keys and order stands once.
    """
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum(count).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), before.alias("_before"), F.sum("_sum").over(whole).alias("_all"))
    met = dealt["_part"] == parts["_of_part"]
    for k in keys:
        met = met & dealt[k].eqNullSafe(parts[f"_of_{k}"])
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_own", F.sum(count).over(own)).join(parts, met)
    return out.select(*rows.columns, (F.col("_before") + F.col("_own")).alias("_upto"), "_all")


def quantiles(rows: DataFrame, key: str | list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Floor-index quantiles of each group, exact and without gathering a group: counts of values and running sums."""
    keys = [key] if isinstance(key, str) else key
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    counted = running_counts(own.groupBy(*keys, "_v").agg(F.count("*").alias("_c")), keys, ["_v"], "_c")
    at = {name: F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(p))) for name, p in ps.items()}
    picks = [F.min(F.when(F.col("_upto") > i, F.col("_v"))).alias(name) for name, i in at.items()]
    return counted.groupBy(*keys).agg(*picks, F.min("_v").alias("min"), F.max("_v").alias("max"), F.first("_all").alias("n"))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, n): true median of each group, the mean of the middle two; exact, and no group is gathered."""
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    counted = running_counts(own.groupBy(*keys, "_v").agg(F.count("*").alias("_c")), keys, ["_v"], "_c")
    low, high = (F.min(F.when(F.col("_upto") > i, F.col("_v"))) for i in (F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)))
    return counted.groupBy(*keys).agg(((low + high) / 2).alias("median"), F.first("_all").alias("n"))


def with_average_rank(rows: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``average_rank`` of a column without nulls as ``name``; groups of any size are spread over tasks."""
    by = by or []
    ranks = running_counts(rows.groupBy(*by, value).agg(F.count("*").alias("_c")), by, [value], "_c")
    ranks = ranks.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, value]], (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    met = rows[value] == ranks[f"_of_{value}"]
    for c in by:
        met = met & rows[c].eqNullSafe(ranks[f"_of_{c}"])
    return rows.join(ranks, met).select(*rows.columns, name)


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation of two columns, 0 where a side does not vary; rows with a null in either are left out."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*(by or []), x, y)
    ranked = with_average_rank(with_average_rank(rows, x, "_x", by), y, "_y", by)
    rho = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return ranked.groupBy(*(by or [])).agg(F.round(F.coalesce(rho, F.lit(0.0)), 4).alias("rho"), F.count("*").alias("n"))


def rank_share(rows: DataFrame, value: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Adds share: the place of a value among all, 0 to 1; equal values are told apart by ``tie``, which names a row."""
    out = running_counts(rows.withColumn("_one", F.lit(1)), by or [], [value, tie], "_one")
    share = F.coalesce(F.try_divide(F.col("_upto") - 1, F.col("_all") - 1), F.lit(0.0))
    return out.select(*rows.columns, share.alias("share"))


def at_thresholds(rows: DataFrame, thresholds: list[float], score: str = "score", correct: str = "correct") -> DataFrame:
    """(threshold, kept, right, precision, recall) of scored rows; precision is null where nothing is kept.

    Rows are first added up in the bands between thresholds, so only as many
    rows as there are bands meet the thresholds.
    """
    band = F.size(F.filter(F.array(*[F.lit(t) for t in sorted(thresholds)]), lambda t: t <= F.col(score)))
    bands = rows.groupBy(band.alias("band")).agg(F.count("*").alias("c"), F.sum(F.col(correct).cast("int")).alias("r"))
    cuts = rows.sparkSession.createDataFrame([(t, i + 1) for i, t in enumerate(sorted(thresholds))], "threshold double, place int")
    met = cuts.crossJoin(F.broadcast(bands))  # both have one row for each threshold at most
    kept = F.col("band") >= F.col("place")
    out = met.groupBy("threshold").agg(F.sum(F.when(kept, F.col("c")).otherwise(0)).alias("kept"), F.sum(F.when(kept, F.col("r")).otherwise(0)).alias("right"), F.sum("c").alias("n"))
    return out.select("threshold", "kept", "right", F.round(F.try_divide("right", "kept"), 4).alias("precision"), F.round(F.try_divide("right", "n"), 4).alias("recall"))


def permutation_p(rows: DataFrame, key: str, x: str, y: str, shuffles: int, seed: int) -> DataFrame:
    """(hits, p): two-sided permutation p of the Spearman correlation, (hits + 1) / (shuffles + 1).

    ``key`` names a row.  Rows are numbered once, and each shuffle is a
    permutation of the numbers that is computed row by row; the products of the
    ranks are added up by shuffle, so nothing is gathered and results do not
    depend on the partitioning.
    """
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y)
    ranked = with_average_rank(with_average_rank(own, x, "_x"), y, "_y")
    mean = ranked.agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    ranked = ranked.crossJoin(F.broadcast(mean)).select(F.col(key).alias("site_id"), (F.col("_x") - F.col("_mx")).alias("_a"), (F.col("_y") - F.col("_my")).alias("region"))
    placed = _placed(ranked)
    own = cut(ranked.select("site_id", "_a").join(placed, "site_id").select("_a", F.col("region").alias("_b"), "place", "sites"), "ranks")
    observed = own.agg(F.abs(F.sum(F.col("_a") * F.col("_b"))).alias("observed"))
    drawn = _dealt(own.select("_a", "place", "sites"), placed, shuffles, seed).groupBy("draw").agg(F.abs(F.sum(F.col("_a") * F.col("region"))).alias("d"))
    hit = F.count_if(F.col("d") >= F.col("observed") - 1e-6)
    return drawn.crossJoin(F.broadcast(observed)).agg(hit.alias("hits"), F.round((hit + 1) / F.lit(shuffles + 1), 6).alias("p"))


def head_agreement(tops: DataFrame, heads: DataFrame) -> DataFrame:
    """(hits, n): of the reference heads (id, region), how many are the top region of their id."""
    met = heads.withColumnRenamed("region", "head").join(tops.select("id", "region"), "id", "left")
    return met.agg(F.count_if(F.col("head") == F.col("region")).alias("hits"), F.count("*").alias("n"))


#: Fixed values of a deal: a prime, two multipliers below it and the number of rounds; products stay below 2^63, so SQL can compute the same.
PRIME, FIRST, SECOND, ROUNDS = 2**31 - 1, 48271, 69621, 32
#: Rows that a task deals at once, over as many draws as that takes.
DEALT_ROWS = 2**16


def _round_key(draw: int | np.ndarray, turn: int, seed: int) -> int | np.ndarray:
    own = (seed % PRIME * FIRST + draw) % PRIME
    own = (own * own + (turn + 1) * SECOND) % PRIME
    own = (own * own + 1) % PRIME
    return (own * own + draw) % PRIME


def dealt_places(places: np.ndarray, n: int, draw: int | np.ndarray, seed: int) -> np.ndarray:
    """Where each of ``places`` goes when the numbers below ``n`` are dealt anew: one permutation for each seed and draw, which are broadcast.

    A swap-or-not shuffle (Hoang, Morris and Rogaway, 2012): each round pairs x
    with (k - x) modulo n and swaps the pair or not, by a bit of the larger of
    both, so that each number is dealt by itself and none falls out of range.
    """
    out = places.astype(np.int64)
    for turn in range(ROUNDS):
        key = _round_key(draw, turn, seed)
        other = ((key * PRIME + key * SECOND % PRIME) % n - out) % n
        top = np.maximum(out, other)
        mixed = ((top % PRIME + top // PRIME) * FIRST + key) % PRIME
        mixed = (mixed * mixed + key) % PRIME
        mixed = mixed * mixed % PRIME
        out = np.where((mixed >> 15) & 1, other, out)
    return out


def _placed(sites: DataFrame) -> DataFrame:
    """(site_id, region, place, sites): sites numbered from 0 by id, written."""
    numbered = running_counts(sites.select("site_id", "region", F.lit(1).alias("_one")), [], ["site_id"], "_one")
    return cut(numbered.select("site_id", "region", (F.col("_upto") - 1).alias("place"), F.col("_all").alias("sites")), "places")


def _dealt(rows: DataFrame, placed: DataFrame, draws: int, seed: int) -> DataFrame:
    """``rows`` (any columns, place, sites) once for each draw, with draw and the region that their place is dealt."""
    others = [c for c in rows.columns if c not in ("place", "sites")]
    rows = rows.select(*others, "place", "sites")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places, n = batch.column("place").to_numpy(), batch.column("sites")[0].as_py()
                step = max(1, DEALT_ROWS // len(places))
                for low in range(0, draws, step):
                    own = np.arange(low, min(low + step, draws))
                    again = pa.array(np.tile(np.arange(len(places)), len(own)))
                    made = [pa.array(dealt_places(places[None, :], n, own[:, None], seed).ravel()), pa.array(np.repeat(own, len(places)))]
                    yield pa.RecordBatch.from_arrays([*(x.take(again) for x in batch.columns[: len(others)]), *made], [*others, "place", "draw"])

    fields = [*rows.schema.fields[: len(others)], StructField("place", LongType()), StructField("draw", LongType())]
    # Spark takes what a task makes to be as small as what it reads, and would broadcast all draws
    moved = rows.mapInArrow(run, StructType(fields)).hint("merge")
    return moved.join(placed.select("place", "region"), "place").select("draw", *others, "region")


def shuffled_regions(sites: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, site_id, region): the regions of the sites dealt anew for each draw.

    Sites are numbered once; each draw is a permutation of the numbers that is
    computed row by row, so nothing is sorted for a draw.
    """
    placed = _placed(sites)
    return _dealt(placed.select("site_id", "place", "sites"), placed, draws, seed)


def null_hits(mentions: DataFrame, heads: DataFrame, draws: int, seed: int, floor: int = 3) -> DataFrame:
    """(draw, hits) of the head agreement with shuffled regions.

    Dealing keeps how many sites a region has, so only sites of the heads' ids
    are counted anew; lifts are rounded as in ``lift``.
    """
    placed = _placed(mentions.select("site_id", "region").distinct())
    base = placed.groupBy("region").agg(F.count("*").alias("base"), F.first("sites").alias("total"))
    own = mentions.join(F.broadcast(heads.select("id").distinct()), "id", "left_semi").select("site_id", "id")
    own = cut(own.join(placed, "site_id").select("id", "place", "sites"), "sites-of-heads")
    counts = _dealt(own, placed, draws, seed).groupBy("draw", "id", "region").agg(F.count("*").alias("n"))
    counts = counts.join(own.groupBy("id").agg(F.count("*").alias("all")), "id").join(base, "region").where(F.col("n") >= floor)
    order = Window.partitionBy("draw", "id").orderBy(F.desc(F.round(F.col("n") / (F.col("all") * F.col("base") / F.col("total")), 3)), "region")
    tops = counts.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("draw", "id", "region")
    hits = tops.join(heads.withColumnRenamed("region", "head"), "id").groupBy("draw").agg(F.count_if(F.col("region") == F.col("head")).alias("hits"))
    return mentions.sparkSession.range(draws).select(F.col("id").alias("draw")).join(hits, "draw", "left").na.fill(0, ["hits"])


def null_summary(hits: DataFrame, observed: DataFrame) -> DataFrame:
    """(trials, observed, mean, p95, max, p_value, pass) of the hits of each draw against the one row of ``observed`` (hits).

    p95 is the element int(.95 n) of the sorted hits; a pass lies above it.
    """
    met = hits.crossJoin(F.broadcast(observed.select(F.col("hits").alias("observed"))))
    drawn = F.array_sort(F.collect_list("hits"))  # one number for each draw
    out = met.groupBy("observed").agg(
        F.count("*").alias("trials"), F.round(F.avg("hits"), 3).alias("mean"), floor_quantile(drawn, 0.95).alias("p95"), F.max("hits").alias("max"),
        F.round((F.count_if(F.col("hits") >= F.col("observed")) + 1) / (F.count("*") + 1), 4).alias("p_value"),
    )
    return out.select("trials", "observed", "mean", "p95", "max", "p_value", (F.col("observed") > F.col("p95")).alias("pass"))
