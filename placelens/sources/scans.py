"""Scans: JSON documents with facts from their paths, line logs, archives, and optional tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut

#: Elements of a map extract: nodes carry lat and lon, ways and relations a centre.
ELEMENTS = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"


def elements(spark: SparkSession, glob: str) -> DataFrame:
    """Elements of all extracts, with the two-digit area code of the file name (null for a national file) and an ordinal for scan order.

    Files of single areas and a national file together are an error.
    """
    files = spark.read.schema(ELEMENTS).option("multiLine", True).json(glob).withColumn("file", F.input_file_name())
    code = F.nullif(F.regexp_extract("file", r"/(\d{2})\.json$", 1), F.lit(""))
    kinds = [x[0] for x in files.select(code.isNull()).distinct().collect()]  # one or two rows
    if len(kinds) > 1:
        raise ValueError("national and area files are mixed")
    rows = files.select("file", code.alias("area"), F.posexplode("elements").alias("place", "e"))
    e = F.col("e")
    return rows.select("file", "place", "area", e["type"].alias("type"), e["id"].alias("id"), F.coalesce(e["lat"], e["center"]["lat"]).alias("lat"), F.coalesce(e["lon"], e["center"]["lon"]).alias("lon"), e["tags"].alias("tags"))


def partition_documents(spark: SparkSession, folder: str, schema: T.StructType, field: str) -> DataFrame:
    """Records of the documents ``NN.json`` of a folder, one row for each element of ``field``."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/[0-9][0-9].json").select(F.explode(field).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record for each line, cut at the line feed only: other separators may occur in values."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with line numbers as in the file; empty lines are left out.

    Large files are read in splits.  A line's number is its place in its split
    and the lines of the splits before it, one sum for each split of a file.
    Lines end at the line feed only.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()), "lines-of-splits")
    splits = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    return rows.join(splits, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value").where(F.btrim("value") != "")


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of the schema if the path does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def distinct_requests(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, keys): sorted distinct keys in lists of at most ``size``, for batched look-ups."""
    keys = rows.select(key).distinct()
    n = max(1, -(-keys.count() // size))
    dealt = keys.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return dealt.withColumn("batch", F.floor((place - 1) / size)).groupBy("part", "batch").agg(F.array_sort(F.collect_list(key)).alias("keys")).select(F.concat_ws("-", "part", "batch").alias("batch"), "keys")


def valid_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """Adds valid: the body is JSON with results.bindings, whatever its status said."""
    return responses.withColumn("valid", F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.results.bindings", "variant").isNotNull(), F.lit(False)))


def newest_links(page: DataFrame, html: str, pattern: str) -> DataFrame:
    """(file, code) of the newest version of each code among the links of a page; the pattern has the groups file, version, code."""
    hits = page.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), 0)).alias("hit"))
    part = lambda i: F.regexp_extract("hit", pattern, i)
    return hits.select(part(1).alias("file"), part(2).alias("version"), part(3).alias("code")).groupBy("code").agg(F.max_by("file", F.struct("version", "file")).alias("file"))
