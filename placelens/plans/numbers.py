"""Quantiles, thresholds, ranks, correlation and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density, similar, stats, vectors
from ..sources.shared import cut
from .base import deal_sql, query, table

_PS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("WITH l AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, " + ", ".join(f"v[least(len(v) - 1, CAST(floor(len(v) * {p}::DOUBLE) AS BIGINT)) + 1] AS {k}" for k, p in _PS.items()) + ", v[1] AS min, v[len(v)] AS max, len(v) AS n FROM l")
def a10_floor_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", _PS)


@query("WITH l AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1) SELECT o_orderpriority, v[len(v) // 2 + 1] AS upper_median FROM l")
def a11_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantiles(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", {"upper_median": 0.5}).select("o_orderpriority", "upper_median")


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def a12_true_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_quantity")
    return stats.medians(own, ["day"], "l_quantity").select("day", "median")


@query("SELECT event_type, count(*) FILTER (abs(value - 10) <= 1) AS within_1, count(*) FILTER (abs(value - 10) <= 5) AS within_5, count(*) FILTER (abs(value - 10) <= 10) AS within_10, round(max(abs(value - 10)), 4) AS most FROM events GROUP BY 1")
def a13_tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.col("value") - 10)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(d <= t).alias(f"within_{t}") for t in (1, 5, 10)], F.round(F.max(d), 4).alias("most"))


@query("SELECT count(*) AS known, count(*) FILTER (quality = toxic) AS agree, count(*) FILTER (quality <> toxic) AS disagree, round(CAST(count(*) FILTER (quality = toxic) AS DOUBLE) / count(*), 4) AS rate FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def a14_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    same = F.col("quality") == F.col("toxic")
    return own.agg(F.count("*").alias("known"), F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"), F.round(F.try_divide(F.count_if(same), F.count("*")), 4).alias("rate"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND quality <> toxic ORDER BY doc_id LIMIT 25")
def a14_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first examples of disagreement, by id."""
    return table(spark, sf_dir, "labels").where("quality <> toxic").select("doc_id", "quality", "toxic").orderBy("doc_id").limit(25)


_CUTS = [round(0.50 + 0.02 * i, 2) for i in range(21)]


@query(
    f"WITH s AS (SELECT quality = 1 AS correct, (doc_id * 37 % 101) / 1e2 AS score FROM labels WHERE ('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 2))::INT % 2 = 0), t AS (SELECT unnest({_CUTS}::DOUBLE[]) AS threshold) "
    "SELECT threshold, count(*) FILTER (score >= threshold) AS kept, count(*) FILTER (score >= threshold AND correct) AS right, round(CAST(count(*) FILTER (score >= threshold AND correct) AS DOUBLE) / nullif(count(*) FILTER (score >= threshold), 0), 4) AS precision, round(CAST(count(*) FILTER (score >= threshold AND correct) AS DOUBLE) / count(*), 4) AS recall FROM s, t GROUP BY threshold"
)
def a15_a16_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import parity_half

    own = table(spark, sf_dir, "labels").where(parity_half(F.col("doc_id")) == "calibration")
    own = own.select((F.col("quality") == 1).alias("correct"), (F.col("doc_id") * 37 % 101 / 100).alias("score"))
    return stats.at_thresholds(own, _CUTS)


@query("WITH s AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, round((row_number() OVER (ORDER BY n, doc_id) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE), 9) AS share FROM s")
def w7_rank_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each document among all by length, 0 to 1."""
    own = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"))
    return stats.rank_share(own, "n", "doc_id").select("doc_id", F.round("share", 9).alias("share"))


_RANKS = "r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2e0 AS ry FROM t)"


@query(f"WITH t AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), {_RANKS} SELECT g AS l_returnflag, round(coalesce(corr(rx, ry), 0), 4) AS rho, count(*) AS n FROM r GROUP BY g")
def m14_w9_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


_RANKED = """t AS (SELECT c_nationkey AS k, avg(c_acctbal) AS x, count(*) AS y FROM customer GROUP BY 1 HAVING avg(c_acctbal) IS NOT NULL),
ranks AS (SELECT k, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry FROM t),
own AS (SELECT row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n, rx - avg(rx) OVER () AS a, ry - avg(ry) OVER () AS b FROM ranks),
seen AS (SELECT abs(sum(a * b)) AS observed FROM own)"""


@query(
    f"WITH {_RANKED}, {deal_sql('SELECT place, n FROM own', 2000, 20260908)}, d AS (SELECT draw, abs(sum(x.a * y.b)) AS d FROM own x JOIN dealt USING (place) JOIN own y ON y.place = dealt.dealt_to GROUP BY draw) "
    "SELECT count(*) FILTER (d >= observed - 1e-6) AS hits, round((count(*) FILTER (d >= observed - 1e-6) + 1) / 2001e0, 6) AS p FROM d, seen"
)
def m15_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x"), F.count("*").alias("y"))
    return stats.permutation_p(rows, "c_nationkey", "x", "y", 2000, 20260908)


_LONG = "long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_CENTROIDS = f"{_LONG}, m AS (SELECT label, pos, avg(v) AS m FROM long GROUP BY ALL), c AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM m), scores AS (SELECT vec_id, c.label, sum(v * m) AS score FROM long JOIN c USING (pos) GROUP BY ALL)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    return vectors.centroid_scores(own, "vec_id", "embedding", vectors.centroids(own, "label", "embedding"), "label")


@query(f"WITH {_CENTROIDS} SELECT label, pos - 1 AS pos, round(m, 6) AS m FROM c")
def a18_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), F.round("m", 6).alias("m"))


@query(f"WITH {_CENTROIDS} SELECT vec_id, label, round(score, 6) AS score FROM scores")
def m5_centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_CENTROIDS}, e AS (SELECT vec_id, max(score) AS hi, min(score) AS lo FROM scores GROUP BY 1) SELECT round(median(hi), 6) AS median_max, round(min(hi), 6) AS min_max, round(median(hi - lo), 6) AS median_range FROM e")
def a19_m6_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.spread(scores(spark, sf_dir), "vec_id")


@query(f"WITH {_CENTROIDS}, e AS (SELECT vec_id, max(score) AS hi FROM scores GROUP BY 1), k AS (SELECT round(max(score), 6) AS control_max FROM scores WHERE vec_id % 50 = 0) SELECT control_max, round(median(hi), 6) AS median_max, control_max < round(median(hi), 6) AS passes FROM e, k GROUP BY control_max")
def m6_control_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scores(spark, sf_dir)
    return vectors.control_check(own, own.where("vec_id % 50 = 0"), "vec_id")


@query(f"WITH {_CENTROIDS}, p AS (SELECT vec_id, label, round(score, 9) AS score FROM scores), r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n FROM p) SELECT vec_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY n) AS top FROM r WHERE n <= 3 GROUP BY 1")
def w8_top_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scores(spark, sf_dir).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.round("score", 9)))).alias("s"))
    return own.select("vec_id", F.array_join(F.transform(vectors.top_entries(F.col("s"), 3), lambda x: x.cast("string")), ",").alias("top"))


_SIMILAR = f"WITH {_LONG}, dots AS (SELECT x.vec_id, y.vec_id AS other, round(sum(x.v * y.v), 9) AS score FROM long x JOIN long y ON x.pos = y.pos AND x.vec_id <> y.vec_id GROUP BY ALL), top AS (SELECT vec_id, other, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rank FROM dots QUALIFY rank <= 20)"


@query(f"{_SIMILAR} SELECT vec_id, other, score, rank FROM top")
def m4_w6_top_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.top_similar(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20)


@query(f"{_SIMILAR} SELECT vec_id, count(*) FILTER (a.label = b.label AND a.label <> -1) AS same_cluster, string_agg(CAST(other AS VARCHAR), ',' ORDER BY rank) AS others FROM top JOIN embeddings a USING (vec_id) JOIN embeddings b ON b.vec_id = other GROUP BY 1")
def j14_q2_similar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each row with how many share its cluster; noise never does."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = similar.top_similar(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20)
    both = top.join(own, "vec_id").join(own.toDF("other", "label_of_other"), "other")
    same = (F.col("label") == F.col("label_of_other")) & (F.col("label") != -1)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"].cast("string")), ",")
    return both.groupBy("vec_id").agg(F.count_if(same).alias("same_cluster"), listed.alias("others"))


@query(f"{_SIMILAR} SELECT vec_id, coalesce(string_agg(other || ':' || coalesce(lang, '-') || ':' || coalesce(source, '-'), ',' ORDER BY rank) FILTER (doc_id IS NOT NULL), '') AS named, count(*) FILTER (doc_id IS NULL) AS missing FROM top LEFT JOIN (SELECT * FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) d ON doc_id = other GROUP BY 1")
def j14_neighbour_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each row with language and source of their document, and how many have none with a text and a source."""
    top = similar.top_similar(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20)
    documents = table(spark, sf_dir, "documents").where("text is not null and source is not null").withColumnRenamed("doc_id", "vec_id")
    one = lambda x: F.concat_ws(":", x["other"].cast("string"), F.coalesce(x["named"]["lang"], F.lit("-")), F.coalesce(x["named"]["source"], F.lit("-")))
    out = similar.with_neighbours(top, documents, "vec_id", ["lang", "source"])
    return out.select("vec_id", F.array_join(F.transform("similar", one), ",").alias("named"), "missing")


@query(f"{_SIMILAR}, sc AS (SELECT l.vec_id, c.label, round(sum(v * m), 9) AS score FROM long l JOIN (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM (SELECT label, pos, avg(v) AS m FROM long GROUP BY ALL)) c USING (pos) GROUP BY ALL), t3 AS (SELECT vec_id, list(label ORDER BY score DESC, label)[1:3] AS t FROM sc GROUP BY 1) SELECT top.vec_id, rank, other, array_to_string(list_filter(x.t, lambda k: list_contains(y.t, k)), ',') AS shared FROM top JOIN t3 x USING (vec_id) JOIN t3 y ON y.vec_id = other")
def q2_w13_shared_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each neighbour the entries that are among the first three of both, in the row's own order."""
    own = scores(spark, sf_dir).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.round("score", 9)))).alias("s"))
    own = own.select("vec_id", vectors.top_entries(F.col("s"), 3).alias("t"))
    top = similar.top_similar(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20)
    both = top.join(own, "vec_id").join(own.toDF("other", "t_other"), "other")
    shared = F.transform(vectors.shared_top(F.col("t"), F.col("t_other")), lambda x: x.cast("string"))
    return both.select("vec_id", "rank", "other", F.array_join(shared, ",").alias("shared"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def a20_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query()
def m10_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.principal_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 2)
    return out.select("vec_id", F.round(F.get("components", 0), 6).alias("x"), F.round(F.get("components", 1), 6).alias("y"))


_CLUSTERS = f"""{_SIMILAR.replace("WITH ", "WITH RECURSIVE ", 1)}, links AS (SELECT vec_id AS a, other AS b, score FROM dots WHERE score >= 5e-1), cores AS (SELECT a FROM links GROUP BY a HAVING count(*) >= 5),
inside AS (SELECT a, b FROM links WHERE a IN (SELECT a FROM cores) AND b IN (SELECT a FROM cores)), reach(node, other) AS (SELECT a, b FROM inside UNION SELECT node, inside.b FROM reach JOIN inside ON reach.other = inside.a),
roots AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node),
border AS (SELECT links.a AS node, root FROM links JOIN roots ON links.b = node WHERE links.a NOT IN (SELECT a FROM cores) QUALIFY row_number() OVER (PARTITION BY links.a ORDER BY score DESC, links.b) = 1),
placed AS (SELECT * FROM roots UNION ALL SELECT * FROM border), large AS (SELECT root FROM placed GROUP BY root HAVING count(*) >= 15)"""


@query(f"{_CLUSTERS} SELECT vec_id, coalesce(large.root, -1) AS cluster FROM embeddings LEFT JOIN placed ON node = vec_id LEFT JOIN large USING (root)")
def m12_density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    similar = vectors.similar_pairs(own, "vec_id", "embedding", 0.5)
    return vectors.density_clusters(similar, own, "vec_id", 0.5)


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of vectors of length one with their distances."""
    near = similar.top_similar(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20)
    return near.withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))))


@query(f"{_SIMILAR} SELECT vec_id, round(sqrt(greatest(0, 2 - 2 * score)), 6) AS core FROM top WHERE rank = 4")
def m12_core_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the fifth nearest vector, the vector itself counted."""
    return density.core_distances(_neighbours(spark, sf_dir), "vec_id").select("vec_id", F.round("core", 6).alias("core"))


@query()
def m12_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and probability of each vector from the condensed tree over mutual reachability."""
    near = cut(_neighbours(spark, sf_dir), "neighbours")
    found = density.density_hierarchy(near, table(spark, sf_dir, "embeddings"), "vec_id")
    return found.select("vec_id", "cluster", F.round("probability", 6).alias("probability"))


@query("WITH e AS (SELECT event_id, value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events) SELECT event_id, CAST(least(greatest(floor((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 5), 0), 4) AS INT) AS bin FROM e")
def g26_g27_q5_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values scaled to 0..1 between the extremes and binned in five."""
    own = table(spark, sf_dir, "events").select("event_id", "value")
    ends = own.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    t = F.floor((F.col("value") - F.col("lo")) / span * 5)
    return own.crossJoin(F.broadcast(ends)).select("event_id", F.least(F.greatest(t, F.lit(0)), F.lit(4)).cast("int").alias("bin"))


@query("SELECT vec_id, greatest(1, CAST(round((1 - (vec_id % 101) / 1e2) * 100) AS INT)) AS upper FROM embeddings")
def g25_upper_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("vec_id") % 101 / 100
    return table(spark, sf_dir, "embeddings").select("vec_id", F.greatest(F.lit(1), F.round((1 - share) * 100).cast("int")).alias("upper"))
