"""Registration of queries, and the shapes of the library's tables over the driver's tables.

Sites are customers on a patch of map, items are suppliers near some of them,
mentions are the brands of an order, articles are documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import FIRST, PRIME, ROUNDS, SECOND

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def deal_sql(places: str, draws: int, seed: int) -> str:
    """SQL of the table ``dealt`` (draw, place, dealt_to), as ``stats.dealt_places`` deals; ``places`` selects place and n."""
    p, first, second, rounds = PRIME, FIRST, SECOND, ROUNDS
    other = f"((k * {p} + k * {second} % {p}) % n - spot + n) % n"
    mixed = f"((greatest(spot, {other}) % {p} + greatest(spot, {other}) // {p}) * {first} + k) % {p}"
    square = f"(({mixed}) * ({mixed}) + k) % {p}"
    bit = f"(({square}) * ({square}) % {p}) // 32768 % 2"
    return f"""seeds AS (SELECT draw, turn, ({seed % p * first} + draw) % {p} AS a FROM range({draws}) d(draw), range({rounds}) r(turn)),
squared AS (SELECT draw, turn, (a * a + (turn + 1) * {second}) % {p} AS a FROM seeds), again AS (SELECT draw, turn, (a * a + 1) % {p} AS a FROM squared),
round_keys AS (SELECT draw, list((a * a + draw) % {p} ORDER BY turn) AS ks FROM again GROUP BY draw),
dealt AS (SELECT draw, place, list_reduce(ks, lambda spot, k: CASE WHEN {bit} = 1 THEN {other} ELSE spot END, place) AS dealt_to FROM ({places}), round_keys)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _point(key: Column) -> tuple[Column, Column]:
    return 139 + F.pmod(key * 7919, F.lit(997)) / 10000, 35 + F.pmod(key * 104729, F.lit(1009)) / 10000


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _point(F.col("c_custkey"))
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("site_id"), lon.alias("lon"), lat.alias("lat"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("region"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _point(F.col("s_suppkey") * 15)
    label = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("s_suppkey") % 5).cast("int") + 1)
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("Q"), F.col("s_suppkey")).alias("qid"), (lon + F.col("s_suppkey") % 7 * 3e-4).alias("item_lon"), (lat + F.col("s_suppkey") % 5 * 3e-4).alias("item_lat"), label.alias("label"), F.col("s_nationkey").alias("item_region")
    )


SITES = "sites AS (SELECT c_custkey AS site_id, 139 + ((c_custkey * 7919) % 997) / 1e4 AS lon, 35 + ((c_custkey * 104729) % 1009) / 1e4 AS lat, c_mktsegment AS name, c_nationkey AS region FROM customer)"
ITEMS = (
    "items AS (SELECT 'Q' || s_suppkey AS qid, 139 + ((s_suppkey * 15 * 7919) % 997) / 1e4 + (s_suppkey % 7) * 3e-4 AS item_lon, 35 + ((s_suppkey * 15 * 104729) % 1009) / 1e4 + (s_suppkey % 5) * 3e-4 AS item_lat, "
    f"list_extract({list(SEGMENTS)}, CAST(s_suppkey % 5 AS INT) + 1) AS label, s_nationkey AS item_region FROM supplier)"
)


def distance_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def score_sql(d: str) -> str:
    return f"CASE WHEN {d} <= 50 THEN 1e0 WHEN {d} <= 150 THEN 1e0 - 3e-1 * ({d} - 50) / 100 WHEN {d} <= 500 THEN 7e-1 * (1e0 - ({d} - 150) / 350) ELSE 0e0 END"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, region, ids): each order with its distinct brands, in the customer's nation."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sets = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("ids"))
    own = sets.join(orders, sets["l_orderkey"] == orders["o_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"])
    return own.select(F.col("l_orderkey").alias("site_id"), F.col("c_nationkey").alias("region"), "ids")


def mention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select("site_id", "region", F.explode("ids").alias("id"))


MENTIONS = "mentions AS (SELECT DISTINCT l_orderkey AS site_id, c_nationkey AS region, p_brand AS id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
COUNTS = "counts AS (SELECT id, count(*) AS n FROM mentions GROUP BY id)"
PAIRS = "pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS w FROM mentions x JOIN mentions y ON x.site_id = y.site_id AND x.id < y.id GROUP BY ALL)"

#: Pairs of brands with a stated type, as a frozen reference table would state them.
LABELS = (
    ("Brand#1", "Brand#10", "identity"), ("Brand#10", "Brand#11", "identity"), ("Brand#2", "Brand#3", "identity"),
    ("Brand#4", "Brand#5", "kin"), ("Brand#6", "Brand#7", "kin"), ("Brand#8", "Brand#9", "partof"), ("Brand#12", "Brand#13", "other"), ("Brand#14", "Brand#15", "other"),
)
LABELS_SQL = "labels_of(a, b, type) AS (VALUES " + ", ".join(map(str, LABELS)) + ")"
TYPED = f"{MENTIONS}, {COUNTS}, {PAIRS}, {LABELS_SQL}, typed AS (SELECT a, b, w, coalesce(type, 'unlabeled') AS type FROM pairs LEFT JOIN labels_of USING (a, b))"


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "a string, b string, type string")
