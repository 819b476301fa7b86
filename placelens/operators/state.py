"""Incremental work: what of an earlier snapshot still holds, and caches addressed by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.text import content_key
from ..sources.scans import optional
from ..sources.shared import cut, discard

#: A site that has moved this far or farther is measured anew.
MOVED_M = 1.0


def reuse_plan(sites: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Sites with what can be taken over from the snapshot, and todo_elevation and todo_river where it cannot.

    Both have site_id, lon, lat; the snapshot also elevation_m,
    river_distance_m, river_name, river_note.  A river measurement holds if
    there is a distance or a note that there is none.
    """
    old = snapshot.select("site_id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "elevation_m", "river_distance_m", "river_name", "river_note")
    both = sites.join(old, "site_id", "left")
    stays = F.coalesce(haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) < MOVED_M, F.lit(False))
    elevation = stays & F.col("elevation_m").isNotNull()
    river = stays & (F.col("river_distance_m").isNotNull() | F.col("river_note").isNotNull())
    kept = {"elevation_m": F.when(elevation, F.col("elevation_m"))} | {c: F.when(river, F.col(c)) for c in ("river_distance_m", "river_name", "river_note")}
    return both.withColumns(kept | {"todo_elevation": ~elevation, "todo_river": ~river}).drop("_lon", "_lat")


def merged_measures(plan: DataFrame, computed: DataFrame, todo: str, columns: list[str]) -> DataFrame:
    """Taken-over rows and newly computed ones, with how: reused or computed."""
    reused = plan.where(~F.col(todo)).select("site_id", *columns, F.lit("reused").alias("how"))
    return reused.unionByName(computed.select("site_id", *columns, F.lit("computed").alias("how")))


def unseen(texts: DataFrame, text: str, cache: DataFrame, model: str) -> DataFrame:
    """(key, text) of the distinct texts that the cache (key, ...) lacks."""
    keyed = texts.select(content_key(model, F.col(text)).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def append_new(fresh: DataFrame, path: str) -> int:
    """Appends rows (key, ...) to the Parquet cache at ``path``, without those that it has; returns how many.

    Spark's committer shows a batch whole or not at all, so a run that stops
    is taken up where it stopped.
    """
    known = optional(fresh.sparkSession, path, fresh.schema)
    own = cut(fresh.dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti"), "fresh")
    n = own.count()
    if n:
        own.select(*fresh.columns).write.mode("append").parquet(path)
    discard(own)
    return n


def articles_to_fetch(sites: DataFrame, stored: DataFrame) -> DataFrame:
    """(title, n_sites): each title once that a site (site_id, title) has and that is not stored for it.

    ``stored`` (site_id, requested_title, ...): what was fetched for a site
    under another title is stale and does not count.
    """
    fresh = stored.select("site_id", F.col("requested_title").alias("title"))
    todo = sites.where("title is not null").join(fresh, ["site_id", "title"], "left_anti")
    return todo.groupBy("title").agg(F.count("*").alias("n_sites"))


def articles_of(sites: DataFrame, stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """(site_id, title, revision, text, how): stored or fetched text of each site; sites whose article is missing are left out.

    ``fetched`` (title, revision, text) has one row for each title; a row
    without a revision is no article.
    """
    own = sites.where("title is not null").select("site_id", "title")
    old = stored.select("site_id", F.col("requested_title").alias("title"), "revision", "text").where("revision is not null")
    kept = own.join(old, ["site_id", "title"]).withColumn("how", F.lit("cached"))
    rest = own.join(old.select("site_id", "title"), ["site_id", "title"], "left_anti")
    new = rest.join(fetched.where("revision is not null").select("title", "revision", "text"), "title").withColumn("how", F.lit("fetched"))
    return kept.unionByName(new).select("site_id", "title", "revision", "text", "how")


def same_corpus(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """(group, reuse): whether the fingerprint and the number of texts of ``fingerprint`` are those of the manifest before; a null group is one too."""
    old = before.select(F.col(group).alias("_g"), F.col("n").alias("_n"), F.col("fingerprint").alias("_f"))
    same = F.coalesce((F.col("n") == F.col("_n")) & (F.col("fingerprint") == F.col("_f")), F.lit(False))
    return after.join(old, after[group].eqNullSafe(old["_g"]), "left").select(group, same.alias("reuse"))


def last_written(shards: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the one of the last shard."""
    last = F.max_by(F.struct(*shards.columns), F.col(order)).alias("_last")
    return shards.groupBy(key).agg(last).select("_last.*")


def fingerprint(texts: DataFrame, group: str, key: str, text: str, prefix: str, block: int = 1000) -> DataFrame:
    """(group, n, fingerprint): SHA-256 over a prefix and what stands for all texts of a group in order of an integer key.

    The digests of ``block`` neighbouring keys are digested together, the
    digests of ``block`` such blocks again, and those of a group at last, so
    that a list has one entry for a million keys.
    """
    level = texts.select(group, F.col(key).alias("_k"), F.lit(1).alias("n"), F.sha2(F.col(text), 256).alias("_d"))

    def joined():
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_d"))), lambda x: x["_d"]), "")

    for _ in range(2):
        level = level.groupBy(group, F.floor(F.col("_k") / block).alias("_b")).agg(F.sum("n").alias("n"), F.sha2(joined(), 256).alias("_d")).withColumnRenamed("_b", "_k")
    return level.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(F.concat(F.lit(prefix), joined()), 256).alias("fingerprint"))
