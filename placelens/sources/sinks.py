"""Sinks: partitioned documents, indexes, feature collections, state files, star-schema files and content stamps."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import running_counts


def write_partitions(rows: DataFrame, path: str, key: str, without: tuple[str, ...] = ()) -> None:
    """JSON documents by ``key``; a row without key is an error, partitions of an earlier run go."""
    if not rows.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"rows without {key}")
    rows.drop(*without).repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def write_neighbours(rows: DataFrame, path: str, key: str, partition: str, similar: str) -> DataFrame:
    """Lists of neighbours by ``partition``, only of rows that have some; returns how many rows each partition has."""
    own = rows.where(F.size(similar) > 0).select(key, partition, similar)
    write_partitions(own, path, partition)
    return own.groupBy(partition).agg(F.count("*").alias("n"))


def index_of(rows: DataFrame, aliases: DataFrame, key: str, partition: str) -> DataFrame:
    """(id, partition, target): where each id is, and each alias by way of the id that it leads to."""
    own = rows.select(F.col(key).alias("id"), partition, F.col(key).alias("target"))
    led = aliases.join(own.select(F.col("id").alias("site_id"), partition), "site_id").select(F.col("alias").alias("id"), partition, F.col("site_id").alias("target"))
    return own.union(led)


def counts_of(index: DataFrame, partition: str) -> DataFrame:
    """(partition, n, n_aliases) of an index."""
    own = F.col("id") == F.col("target")
    return index.groupBy(partition).agg(F.count_if(own).alias("n"), F.count_if(~own).alias("n_aliases"))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, gzip): size of each file below a folder, and compressed; a file is one row in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"file": x["path"], "bytes": x["length"], "gzip": x["content"].map(lambda c: len(gzip.compress(c)))})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "content").mapInPandas(run, "file string, bytes long, gzip long")


def features(rows: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """(feature): a GeoJSON point for each row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_collection(rows: DataFrame, path: str, key: str, lon: str, lat: str, properties: list[str], attribution: str) -> None:
    """A GeoJSON collection in order of ``key``, as text files that give the document when joined in order of their names.

    Tasks write ranges of the key; the head, the tail and the comma before all
    features but the first are lines of their own range.  Keys stand once and
    are not null; an empty table gives an empty collection.
    """
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    made = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))
    first = F.broadcast(rows.agg(F.min(key).alias("_first")))
    body = rows.select(F.lit(1).alias("_place"), F.col(key).alias("_key"), made.alias("_made")).join(first)
    body = body.select("_place", "_key", F.when(F.col("_key") == F.col("_first"), F.col("_made")).otherwise(F.concat(F.lit(","), "_made")).alias("value"))
    head = json.dumps({"type": "FeatureCollection", "attribution": attribution}, ensure_ascii=False)[:-1] + ', "features": ['
    ends = rows.sparkSession.createDataFrame([(0, head), (2, "]}")], "_place int, value string")
    lines = body.unionByName(ends, allowMissingColumns=True).repartitionByRange("_place", "_key").sortWithinPartitions("_place", "_key")
    lines.select("value").write.mode("overwrite").text(path)


def write_state(rows: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """JSON lines in order of ``key``, in ranges of the key: ``files`` of them, else as many as Spark takes for the size."""
    ranged = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").json(path)


#: Columns of the star schema's tables.
STAR = {
    "fact_events": ("v", "ts", "project", "loop_id", "event"),
    "fact_loops": ("project", "loop_id", "started_at", "ended_at", "goal", "scaffold_version", "agent", "outcome", "n_failures", "n_commits", "n_test_runs", "last_tests_passed", "last_tests_failed"),
    "fact_failures": ("ts", "project", "loop_id", "code", "severity", "detected_stage", "introduced_stage", "summary", "resolution", "harness_ref"),
    "dim_failure_taxonomy": ("code", "category", "category_name", "name", "definition"),
    "view_two_strike": ("code", "total", "needs_hc", "has_hc_ref"),
}
BOM = "\ufeff"


def write_star(tables: dict[str, DataFrame], folder: str) -> None:
    """CSV tables with a byte order mark before the header; the columns of ``STAR`` come first, missing ones are empty, others follow by name."""
    for name, df in tables.items():
        first = STAR.get(name, ())
        columns = [*first, *sorted(set(df.columns) - set(first))]
        own = df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
        own.withColumnRenamed(columns[0], BOM + columns[0]).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def content_stamps(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, sha256) of each wanted path over its text with CRLF read as LF; a missing file has null.

    ``files`` is a binaryFile table (path, content), ``wanted`` has path.
    """
    own = files.select("path", F.sha2(F.encode(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n"), "ISO-8859-1"), 256).alias("sha256"))
    return wanted.join(own, "path", "left")


def stamp(stamps: DataFrame, block: int = 1000) -> DataFrame:
    """(n, stamp): one stamp over ``path|hash`` lines in order of the path; a missing file counts as missing.

    Up to ``block`` lines are digested as they are; more are digested by runs
    of so many, and the runs again, so that no list grows with the files.
    """
    line = F.concat_ws("|", "path", F.coalesce("sha256", F.lit("missing")))
    level = running_counts(stamps.select("path", line.alias("_d"), F.lit(1).alias("_one")), [], ["path"], "_one").select((F.col("_upto") - 1).alias("_k"), "_d", "_all")

    def joined():
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_d"))), lambda x: x["_d"]), "\n")

    n = level.agg(F.max("_all")).first()[0] or 0
    size = n
    while size > block:
        level = level.groupBy(F.floor(F.col("_k") / block).alias("_b")).agg(F.sha2(joined(), 256).alias("_d")).withColumnRenamed("_b", "_k")
        size = -(-size // block)
    return level.agg(F.lit(n).cast("long").alias("n"), F.sha2(joined(), 256).alias("stamp"))


def report(rows: DataFrame, **metrics: Column) -> DataFrame:
    """One row of metrics in one pass."""
    return rows.agg(*[c.alias(name) for name, c in metrics.items()])


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side."""
    return reduce(DataFrame.unionByName, [x.exceptAll(y).withColumn("side", F.lit(s)) for x, y, s in ((a, b, "left"), (b, a, "right"))])
