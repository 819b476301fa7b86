"""Article, classification, state and event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import articles, classify, eventlog, state
from .base import SITES, distance_sql, query, sites, table

_CORPUS = "corpus AS (SELECT doc_id, text, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty' WHEN doc_id % 11 = 0 THEN 'no_revision' WHEN length(trim(text, ' ')) < 120 THEN 'short' END AS reason FROM documents)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("revision"))
    return articles.with_rejects(own, "text", "revision")


@query(f"WITH {_CORPUS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM corpus GROUP BY 1")
def s16_corpus_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_CORPUS} SELECT doc_id, sha256(left(text, 800)) AS text_sha, length(text) > 800 AS truncated FROM corpus WHERE reason IS NULL")
def m3_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus(spark, sf_dir).where("reason is null").select("doc_id", articles.truncated(F.col("text")).alias("t"))
    return own.select("doc_id", F.sha2("t.text", 256).alias("text_sha"), "t.truncated")


@query()
def m1_m2_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of page texts, with headings written between equal signs; those about history or features are used."""
    marked = F.regexp_replace(F.regexp_replace("html", r"(?s)<h([1-3])>(.*?)</h\1>", "\n== $2 ==\n"), "<[^>]*>", "")
    own = table(spark, sf_dir, "pages").select("page_id", articles.sections(marked).alias("s"))
    used = articles.selected(F.col("s"), ["the", "de"], ["###"])
    return own.select("page_id", F.size("s").alias("n_sections"), F.size(used).alias("n_used"), F.sha2(F.array_join(F.transform(used, lambda x: x["body"]), "\n"), 256).alias("text_sha"))


@query("WITH d AS (SELECT md5(text) AS article, doc_id, doc_id % 3 AS revision FROM documents WHERE text IS NOT NULL), g AS (SELECT article, arg_max(doc_id, revision * 1000000000 + doc_id) AS speaker, count(*) AS n_members, count(DISTINCT revision) > 1 AS mismatch FROM d GROUP BY article) SELECT * FROM g")
def a17_a25_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("article"), "doc_id", (F.col("doc_id") % 3).alias("revision"), "text")
    out = articles.by_article(own, "article", "doc_id", "revision", "text")
    return out.select("article", "speaker", "n_members", "mismatch")


_TITLE = "'small ' || CASE WHEN p_size % 2 = 0 THEN 'red ring' ELSE 'blue bolt' END || ' (x)'"


@query(f"WITH p AS (SELECT p_brand || p_size % 2 AS article, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN p_name || ' gate' WHEN p_partkey % 5 = 2 THEN 'small ' || p_name ELSE p_name END AS name, {_TITLE} AS title FROM part) SELECT article, p_partkey AS representative FROM p QUALIFY row_number() OVER (PARTITION BY article ORDER BY CASE WHEN name = replace(title, ' (x)', '') THEN 0 ELSE 1 END, CASE WHEN name <> '' AND position(name IN title) > 0 THEN 0 ELSE 1 END, CASE WHEN name = '' THEN 1000000 ELSE length(name) END, p_partkey) = 1")
def w10_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    name = F.when(k == 0, "").when(k == 1, F.concat(n, F.lit(" gate"))).when(k == 2, F.concat(F.lit("small "), n)).otherwise(n)
    title = F.concat(F.lit("small "), F.when(F.col("p_size") % 2 == 0, "red ring").otherwise("blue bolt"), F.lit(" (x)"))
    own = table(spark, sf_dir, "part").select(F.concat("p_brand", (F.col("p_size") % 2).cast("string")).alias("article"), "p_partkey", name.alias("name"), title.alias("title"))
    return articles.representative(own, "article", "p_partkey", "name", "title")


@query("WITH d AS (SELECT md5(text) AS article, doc_id FROM documents WHERE text IS NOT NULL), g AS (SELECT article, min(doc_id) AS representative FROM d GROUP BY 1) SELECT doc_id, representative FROM d JOIN g USING (article)")
def m13_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an article's representative has goes to all members."""
    own = table(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("article"), "doc_id")
    return own.join(own.groupBy("article").agg(F.min("doc_id").alias("representative")), "article").select("doc_id", "representative")


@query("SELECT DISTINCT sha256('m1|' || text) AS key FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def m8_unseen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").where("text is not null")
    cache = state.unseen(own.where("doc_id % 2 = 0"), "text", spark.createDataFrame([], "key string"), "m1")
    return state.unseen(own, "text", cache, "m1").select("key")


@query(
    "WITH b AS (SELECT lang, doc_id // 1000 AS block, count(*) AS n, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS d FROM documents WHERE text IS NOT NULL GROUP BY ALL), "
    "c AS (SELECT lang, block // 1000 AS block, sum(n) AS n, sha256(string_agg(d, '' ORDER BY block)) AS d FROM b GROUP BY lang, block // 1000) "
    "SELECT lang, CAST(sum(n) AS BIGINT) AS n, sha256('m1' || string_agg(d, '' ORDER BY block)) AS fingerprint FROM c GROUP BY lang"
)
def m9_g24_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").where("text is not null").select("lang", "doc_id", "text")
    return state.fingerprint(own, "lang", "doc_id", "text", "m1")


@query("SELECT source, NOT bool_or(contains(text, '@')) AS reuse FROM documents WHERE text IS NOT NULL GROUP BY source")
def m9_same_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose texts are what the manifest says after addresses have been broken up, and need no new vectors."""
    own = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", "text")
    broken = own.withColumn("text", F.replace("text", F.lit("@"), F.lit(" at ")))
    before, after = (state.fingerprint(x, "source", "doc_id", "text", "m1") for x in (own, broken))
    return state.same_corpus(before, after, "source")


@query("SELECT lang, min(length(text)) AS least, max(length(text)) AS most, list_sort(list(length(text)))[count(*) // 2 + 1] AS middle FROM documents WHERE text IS NOT NULL GROUP BY lang")
def a23_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stats import quantiles

    own = table(spark, sf_dir, "documents").where("text is not null").select("lang", F.length("text").cast("long").alias("n"))
    return quantiles(own, "lang", "n", {"middle": 0.5}).select("lang", F.col("min").alias("least"), F.col("max").alias("most"), "middle")


#: A rule book over the words of parts: materials decide before shapes.
BOOK = classify.RuleBook(
    members=(("red", "warm"), ("green", "cool"), ("blue", "cool"), ("small", "size"), ("large", "size")),
    names=(("ring", "round"), ("bolt", "long"), ("widget", "odd"), ("gear", "round")),
    excluded=(("blue ring", "round"),),
    turns=("cool", "icy"),
    companions=("blue",),
    weak=("size",),
)
_CLASS = """p AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS m, p_type FROM part),
f AS (SELECT *, CASE WHEN contains(p_type, 'ring') THEN 'round' WHEN contains(p_type, 'bolt') THEN 'long' END AS s, CASE WHEN contains(m, 'red') THEN 'warm' WHEN contains(m, 'blue') THEN 'icy' WHEN contains(m, 'green') THEN 'cool' WHEN contains(m, 'small') OR contains(m, 'large') THEN 'size' END AS d,
CASE WHEN contains(p_name, 'blue ring') THEN NULL WHEN contains(p_name, 'ring') THEN 'round' WHEN contains(p_name, 'bolt') THEN 'long' WHEN contains(p_name, 'widget') THEN 'odd' WHEN contains(p_name, 'gear') THEN 'round' END AS n FROM p)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.array(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("members"), F.array("p_type").alias("groups"))


@query(f"WITH {_CLASS} SELECT p_partkey, coalesce(s, d, n, 'unknown') AS label, CASE WHEN s IS NOT NULL THEN 'structured' WHEN d IS NOT NULL THEN 'deity' WHEN n IS NOT NULL THEN 'name' ELSE 'none' END AS basis, CAST(CASE WHEN s IS NOT NULL THEN 0.95 WHEN d = 'size' THEN 0.65 WHEN d = 'cool' THEN 0.7 WHEN d IS NOT NULL THEN 0.92 WHEN n IS NOT NULL THEN 0.75 ELSE 0 END AS DOUBLE) AS confidence FROM f")
def c1_c5_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(parts(spark, sf_dir), book=BOOK).select("p_partkey", "label", "basis", "confidence")


@query(f"WITH {_CLASS} SELECT p_partkey, d AS by_members, n AS by_name, CASE WHEN d = n THEN 'agree' WHEN d <> n THEN 'disagree' END AS signal FROM f")
def c6_two_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.two_signals(parts(spark, sf_dir), book=BOOK).select("p_partkey", "by_members", "by_name", "signal")


_REUSE = f"""{SITES}, snap AS (SELECT site_id, lon + CASE WHEN site_id % 5 = 0 THEN 1e-3 ELSE 0 END AS slon, lat AS slat, CASE WHEN site_id % 7 <> 0 THEN site_id * 1e0 END AS e, CASE WHEN site_id % 3 <> 0 THEN site_id * 2e0 END AS r, CASE WHEN site_id % 6 = 0 THEN 'none near' END AS note FROM sites WHERE site_id % 11 <> 0),
plan AS (SELECT site_id, e, r, note, coalesce({distance_sql("lon", "lat", "slon", "slat")} < 1, false) AS stays FROM sites LEFT JOIN snap USING (site_id))"""


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, k = sites(spark, sf_dir), F.col("site_id")
    old = own.where(k % 11 != 0).select(
        "site_id", (F.col("lon") + F.when(k % 5 == 0, 1e-3).otherwise(0.0)).alias("lon"), "lat", F.when(k % 7 != 0, k.cast("double")).alias("elevation_m"),
        F.when(k % 3 != 0, k * 2.0).alias("river_distance_m"), F.lit(None).cast("string").alias("river_name"), F.when(k % 6 == 0, "none near").alias("river_note"),
    )
    return state.reuse_plan(own, old)


@query(f"WITH {_REUSE} SELECT site_id, CASE WHEN stays THEN e END AS elevation_m, CASE WHEN stays AND (r IS NOT NULL OR note IS NOT NULL) THEN r END AS river_distance_m, NOT (stays AND e IS NOT NULL) AS todo_elevation, NOT (stays AND (r IS NOT NULL OR note IS NOT NULL)) AS todo_river FROM plan")
def e1_reuse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).select("site_id", "elevation_m", "river_distance_m", "todo_elevation", "todo_river")


@query(f"WITH {_REUSE} SELECT site_id, CASE WHEN stays AND e IS NOT NULL THEN e ELSE -site_id END AS elevation_m, CASE WHEN stays AND e IS NOT NULL THEN 'reused' ELSE 'computed' END AS how FROM plan")
def e2_merged_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = plan(spark, sf_dir)
    anew = own.where("todo_elevation").select("site_id", (-F.col("site_id")).cast("double").alias("elevation_m"))
    return state.merged_measures(own, anew, "todo_elevation", ["elevation_m"])


_LOG = """log AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, ts, CASE WHEN event_type = 'error' THEN 'correction' ELSE event_type END AS event, CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 AS k FROM events),
aimed AS (SELECT *, CASE WHEN event = 'correction' THEN line - k END AS target FROM log),
c AS (SELECT a.file, a.line, a.target, CASE WHEN b.line IS NULL THEN 'no earlier line' WHEN b.event = 'correction' THEN 'corrects a correction' END AS r FROM aimed a LEFT JOIN aimed b ON a.file = b.file AND a.target = b.line AND b.line < a.line WHERE a.event = 'correction'),
wrong AS (SELECT file, line, target, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY file, target, r IS NULL ORDER BY line) > 1 THEN 'corrected before' END) AS reason FROM c),
stay AS (SELECT * FROM aimed WHERE event <> 'correction' AND NOT EXISTS (SELECT 1 FROM wrong w WHERE w.reason IS NULL AND w.file = aimed.file AND w.target = aimed.line))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a file of lines; errors correct a line some lines above."""
    own = table(spark, sf_dir, "events")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    event = F.when(F.col("event_type") == "error", "correction").otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("long") % 9
    own = own.select("event_id", F.col("user_id").alias("file"), line.cast("long").alias("line"), "ts", event.alias("event"), k.alias("k"))
    return own.withColumn("target", F.when(F.col("event") == "correction", F.col("line") - F.col("k")))


@query(f"WITH {_LOG} SELECT file, line, event FROM stay")
def e5_effective_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.corrected(log(spark, sf_dir), "file", "line", "event", "target")[0].select("file", "line", "event")


@query(f"WITH {_LOG} SELECT file, line, reason FROM wrong WHERE reason IS NOT NULL")
def e5_wrong_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.corrected(log(spark, sf_dir), "file", "line", "event", "target")[1]


@query("WITH o AS (SELECT user_id AS file, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT file, event_id, value FROM o WHERE value < before")
def w15_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_id", "value")
    return eventlog.out_of_order(own, "file", "event_id", "value")


#: Clicks begin a loop, views are failures, sign-ups end it; users of some numbers break the rules of names, projects and time.
_FILES = f"""{_LOG}, full_log AS (SELECT file, line, CASE event WHEN 'click' THEN 'loop_start' WHEN 'view' THEN 'failure' WHEN 'signup' THEN 'loop_end' ELSE event END AS event, CASE WHEN file % 7 = 0 THEN -line ELSE line END AS ts,
CASE WHEN file % 5 = 0 THEN 'other' ELSE 'f' || file END AS loop_id, CASE WHEN file % 11 = 0 AND line % 4 = 1 THEN 'f' || file WHEN file % 3 = 0 THEN 'p' || line % 2 ELSE 'p' END AS project, CASE WHEN file % 2 = 0 THEN '1.1' WHEN line % 5 = 0 THEN '1.10' ELSE '1' END AS v, (file % 2 = 1 AND line % 5 = 0) AS strict, CASE WHEN event = 'signup' THEN k END AS declared FROM aimed),
left_log AS (SELECT full_log.* FROM full_log JOIN stay USING (file, line)),
whole AS (SELECT file, arg_min(event, line) AS first, min(line) FILTER (event = 'loop_end') AS ended, arg_min(declared, line) FILTER (event = 'loop_end') AS declared, count(*) FILTER (event = 'loop_end') AS ends, count(*) FILTER (event = 'failure') AS failures, count(DISTINCT project) AS projects, bool_or(strict) AS strict, count(*) FILTER (strict AND project = loop_id) AS polluted, count(*) FILTER (NOT strict AND project = loop_id) AS old_polluted FROM left_log GROUP BY file),
behind AS (SELECT l.file, l.event, count(*) AS n FROM left_log l JOIN whole USING (file) WHERE line > ended GROUP BY ALL),
voided AS (SELECT file, event, count(*) AS v FROM full_log WHERE event <> 'correction' AND NOT EXISTS (SELECT 1 FROM left_log l WHERE l.file = full_log.file AND l.line = full_log.line) GROUP BY ALL),
faults AS (SELECT file, 'several projects' AS violation FROM whole WHERE projects > 1 AND strict UNION ALL SELECT file, 'project is the loop id' FROM whole WHERE polluted > 0 UNION ALL SELECT file, 'does not begin with loop_start' FROM whole WHERE first <> 'loop_start' UNION ALL SELECT file, 'several ends' FROM whole WHERE ends > 1
UNION ALL SELECT file, 'declares another number of failures' FROM whole WHERE declared <> failures UNION ALL SELECT DISTINCT file, 'loop id differs from the file name' FROM full_log WHERE loop_id <> 'f' || file
UNION ALL SELECT DISTINCT file, 'not in order of time' FROM (SELECT file, ts < lag(ts) OVER (PARTITION BY file ORDER BY line) AS late FROM full_log) WHERE late UNION ALL SELECT DISTINCT file, 'no record is left' FROM full_log WHERE file NOT IN (SELECT file FROM whole)
UNION ALL SELECT DISTINCT file, 'records after the end' FROM behind LEFT JOIN voided USING (file, event) WHERE n > coalesce(v, 0))"""


def files_of(own: DataFrame) -> DataFrame:
    """The rows of ``log`` as files of loops."""
    f, line, e = F.col("file"), F.col("line"), F.col("event")
    shape = {
        "event": F.when(e == "click", "loop_start").when(e == "view", "failure").when(e == "signup", "loop_end").otherwise(e), "ts": F.when(f % 7 == 0, -line).otherwise(line), "loop_id": F.when(f % 5 == 0, F.lit("other")).otherwise(F.concat(F.lit("f"), f)),
        "project": F.when((f % 11 == 0) & (line % 4 == 1), F.concat(F.lit("f"), f)).when(f % 3 == 0, F.concat(F.lit("p"), line % 2)).otherwise("p"), "v": F.when(f % 2 == 0, "1.1").when(line % 5 == 0, "1.10").otherwise("1"),
        "failure_count": F.when(e == "signup", F.col("k")), "file": F.concat(F.lit("logs/f"), f, F.lit(".jsonl")),
    }
    return own.withColumns(shape)


@query(f"WITH {_FILES} SELECT 'logs/f' || file || '.jsonl' AS file, violation FROM faults")
def e6_file_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = log(spark, sf_dir)
    stay, _ = eventlog.corrected(own, "file", "line", "event", "target")
    return eventlog.file_violations(files_of(own), files_of(stay))


@query(f"WITH {_FILES} SELECT 'logs/f' || file || '.jsonl' AS file, 'project is the loop id' AS warning, old_polluted AS n FROM whole WHERE old_polluted > 0 UNION ALL SELECT 'logs/f' || file || '.jsonl', 'several projects', projects FROM whole WHERE projects > 1 AND NOT strict")
def e6_file_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay, _ = eventlog.corrected(log(spark, sf_dir), "file", "line", "event", "target")
    return eventlog.file_warnings(files_of(stay))


@query()
def e7_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of each file is a batch of records that is held against the earlier half."""
    own = files_of(log(spark, sf_dir)).drop("loop_id", "failure_count")
    own = own.withColumn("half", F.ceil(F.max("line").over(Window.partitionBy("file")) / 2))
    return eventlog.admitted(own.where("line <= half"), own.where("line > half").withColumn("seq", F.col("line")))


@query(f"WITH {_LOG}, t AS (SELECT 0 AS code, 'zero' AS name UNION ALL SELECT 1, 'one') SELECT k AS code, count(*) AS n, coalesce(any_value(name), '?') AS name FROM stay LEFT JOIN t ON k = t.code WHERE event = 'view' GROUP BY k")
def e8_failures_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay, _ = eventlog.corrected(log(spark, sf_dir), "file", "line", "event", "target")
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "code long, name string")
    return eventlog.failures_by_code(stay.where("event = 'view'"), "k", names)


@query(f"WITH {_LOG} SELECT file, arg_max(line, line) AS last_line, arg_max(k, line) AS last_k FROM stay WHERE event = 'purchase' GROUP BY file")
def e8_last_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay, _ = eventlog.corrected(log(spark, sf_dir), "file", "line", "event", "target")
    return eventlog.last_of(stay, "file", "line", "event", "purchase", ["line", "k"]).withColumnsRenamed({"line": "last_line", "k": "last_k"})


@query(f"WITH {_LOG} SELECT file, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) FILTER (event = 'click') AS n_click, count(*) FILTER (event = 'purchase') AS n_purchase, count(*) FILTER (event = 'view') AS n_view, arg_max(event, line) AS last FROM stay GROUP BY file")
def a21_e8_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay, _ = eventlog.corrected(log(spark, sf_dir), "file", "line", "event", "target")
    out = eventlog.rollup_by(stay, "file", "line", "event", ["click", "purchase", "view"], "ts")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started", "ended")})


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS code, count(*) AS n, count(*) >= 2 AS needs_rule, bool_or(event_id % 5 = 0) AS has_rule FROM events WHERE event_type = 'error' GROUP BY 1")
def a22_two_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").where("event_type = 'error'")
    own = own.select(F.get_json_object("props", "$.k").cast("int").alias("code"), F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("ref"))
    return eventlog.two_strikes(own, "code", "ref")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'missing project' WHEN event_id % 4 = 1 THEN 'value of data.result' WHEN event_id % 4 = 2 THEN 'unknown failure code' ELSE '' END AS violations FROM events")
def e4_validated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    head = F.concat(F.lit('{"v": "1", "ts": "2024-01-01", '), F.when(k % 4 != 0, F.lit('"project": "p", ')).otherwise(""), F.lit('"loop_id": "l", '))
    data = (
        F.when(k % 4 == 1, F.lit('"event": "stage_end", "data": {"stage": 1, "stage_name": "s", "result": "maybe"}}'))
        .when(k % 4 == 2, F.lit('"event": "failure", "data": {"code": "F9", "severity": "x", "detected_stage": 2, "summary": "s", "resolution": "r"}}'))
        .otherwise(F.lit('"event": "test_run", "data": {"command": "c", "passed": 3, "failed": 0}}'))
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(head, data).alias("value"))
    out = eventlog.violations(eventlog.lines(rows), ["F1"])
    return out.select("event_id", F.array_join("violations", ", ").alias("violations"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS line, len(string_split(t, chr(10))) AS n FROM shaped)"
_SHAPED = "shaped AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || chr(13) WHEN doc_id % 9 = 1 THEN 'при' || chr(10) || text WHEN doc_id % 9 = 2 THEN '한' || chr(13) || chr(10) || text WHEN doc_id % 9 = 3 THEN 'a' || chr(13) || 'b hygiene-allow при' || chr(10) || text ELSE text END AS t FROM documents)"


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which some hold what does not belong there."""
    k, t = F.col("doc_id") % 9, F.col("text")
    text = F.when(k == 0, F.concat(t, F.lit("\r"))).when(k == 1, F.concat(F.lit("при\n"), t)).when(k == 2, F.concat(F.lit("한\r\n"), t)).when(k == 3, F.concat(F.lit("a\rb hygiene-allow при\n"), t)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(
    f"WITH {_SHAPED}, {_LINES}, f AS (SELECT doc_id, line, NOT contains(l, 'hygiene-allow') AND regexp_matches(l, '[\\x{{0400}}-\\x{{052F}}]') AS cyrillic, NOT contains(l, 'hygiene-allow') AND regexp_matches(l, '[\\x{{AC00}}-\\x{{D7AF}}\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}}]') AS hangul, "
    "NOT contains(l, 'hygiene-allow') AND regexp_matches(l, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') AS control, position(chr(13) IN l) BETWEEN 1 AND length(l) - 1 OR (line = n AND ends_with(l, chr(13))) AS stray_cr FROM lines) SELECT * FROM f WHERE cyrillic OR hangul OR control OR stray_cr"
)
def e9_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.hygiene(shaped(spark, sf_dir), "doc_id", "text").withColumn("line", F.col("line").cast("long"))


_ADDED = "added AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN chr(10) || '-----BEGIN EC PRIVATE KEY-----' WHEN 1 THEN chr(10) || 'x = eval (y)' WHEN 2 THEN chr(10) || 'cursor.execute(\"a %s b\" % c)' WHEN 3 THEN chr(10) || 'Token = ''short'' ' WHEN 4 THEN chr(10) || 'api_key: ''long enough'' ' ELSE '' END AS t FROM documents)"


@query(
    f"WITH {_ADDED}, lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM added) "
    + " UNION ALL ".join(
        f"SELECT doc_id, line, '{level}' AS level, '{name}' AS finding FROM lines WHERE regexp_matches(l, '{pattern}')"
        for level, name, pattern in (
            ("block", "private key", "-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----"), ("block", "access key", "AKIA[0-9A-Z]{16}"), ("block", "written credential", "(?i)\\b(api[_-]?key|secret|token|password|passwd)\\b\\s*[=:]\\s*[''\"][^''\"]{8,}[''\"]"),
            ("warn", "evaluates text", "\\beval\\s*\\("), ("warn", "joins text into a statement", "(?i)(execute|cursor\\.execute)\\s*\\(\\s*[\"''].*%s.*[\"'']\\s*%"),
        )
    )
)
def e10_secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = [(0, "\n-----BEGIN EC PRIVATE KEY-----"), (1, "\nx = eval (y)"), (2, '\ncursor.execute("a %s b" % c)'), (3, "\nToken = 'short' "), (4, "\napi_key: 'long enough' "), (5, "")]
    end = F.coalesce(*[F.when(F.col("doc_id") % 6 == k, F.lit(x)) for k, x in more])
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), end).alias("text"))
    return eventlog.secret_lines(own, "doc_id", "text").withColumn("line", F.col("line").cast("long"))


@query("WITH declared AS (SELECT DISTINCT p_brand AS gate FROM part), covered AS (SELECT DISTINCT p_brand AS gate FROM part WHERE p_partkey % 40 < 10) SELECT gate FROM declared EXCEPT SELECT gate FROM covered")
def e11_uncovered_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part")
    return own.select(F.col("p_brand").alias("gate")).distinct().exceptAll(own.where("p_partkey % 40 < 10").select(F.col("p_brand").alias("gate")).distinct())


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS file, CAST(sum(l_linenumber + l_quantity) AS BIGINT) AS changed FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') NOT LIKE '%-12-__' AND strftime(l_shipdate, '%Y-%m-%d') NOT LIKE '1995-%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def a24_largest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of changed lines by file, the five largest, without exempt files."""
    own = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("file"), "l_linenumber", "l_quantity")
    return eventlog.largest_changes(own, "file", F.col("l_linenumber") + F.col("l_quantity"), ("*-12-??", "1995-*"))


@query("WITH s AS (SELECT doc_id AS site_id, CASE WHEN doc_id % 7 > 0 THEN source || '/' || lang END AS title FROM documents), o AS (SELECT doc_id AS site_id, source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE lang END AS title FROM documents WHERE doc_id % 2 = 0) SELECT title, count(*) AS n_sites FROM s WHERE title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.site_id = s.site_id AND o.title = s.title) GROUP BY title")
def s4_articles_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.articles_to_fetch(*article_tables(spark, sf_dir)[:2])


def article_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites with titles, articles stored for every other site of which some are stale, and articles as fetched of which some are missing."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    sites_of = d.select(k.alias("site_id"), F.when(k % 7 > 0, F.concat_ws("/", "source", "lang")).alias("title"))
    stored = d.where(k % 2 == 0).select(k.alias("site_id"), F.concat_ws("/", "source", F.when(k % 5 == 0, F.lit("old")).otherwise(F.col("lang"))).alias("requested_title"), k.alias("revision"), F.md5("text").alias("text"))
    fetched = d.groupBy(F.concat_ws("/", "source", "lang").alias("title")).agg(F.min("doc_id").alias("revision")).withColumn("text", F.concat(F.lit("new "), "title"))
    return sites_of, stored, fetched.withColumn("revision", F.when(F.col("revision") % 3 > 0, F.col("revision")))


@query("WITH s AS (SELECT doc_id AS site_id, source || '/' || lang AS title FROM documents WHERE doc_id % 7 > 0), o AS (SELECT doc_id AS site_id, source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE lang END AS title, doc_id AS revision, md5(text) AS text FROM documents WHERE doc_id % 2 = 0), f AS (SELECT source || '/' || lang AS title, min(doc_id) AS revision FROM documents GROUP BY 1) SELECT s.site_id, title, coalesce(o.revision, f.revision) AS revision, CASE WHEN o.revision IS NULL THEN 'new ' || title ELSE o.text END AS text, CASE WHEN o.revision IS NULL THEN 'fetched' ELSE 'cached' END AS how FROM s LEFT JOIN o USING (site_id, title) LEFT JOIN f USING (title) WHERE o.revision IS NOT NULL OR f.revision % 3 > 0")
def s4_articles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.articles_of(*article_tables(spark, sf_dir))


@query("SELECT s.region AS region, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM (SELECT c_nationkey AS region FROM customer) s GROUP BY 1")
def q7_report_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sites(spark, sf_dir).groupBy("region").agg(F.count("*").alias("n"))
    return own.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


