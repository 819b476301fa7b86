"""An append-only event log: validation, corrections and rollups."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .stats import running_counts

#: Fields of an envelope; fields and types of each event; closed lists of values.
ENVELOPE = ("v", "ts", "project", "loop_id", "event", "data")
FIELDS = {
    "loop_start": {"goal": "string", "spec_refs": "array", "scaffold_version": "string", "agent": "string"},
    "stage_end": {"stage": "int", "stage_name": "string", "result": "string"},
    "test_run": {"command": "string", "passed": "int", "failed": "int"},
    "failure": {"code": "string", "severity": "string", "detected_stage": "int", "summary": "string", "resolution": "string"},
    "escalation": {"reason": "string", "question": "string"},
    "commit": {"sha": "string", "kind": "string"},
    "loop_end": {"outcome": "string", "failure_count": "int", "summary": "string"},
    "correction": {"supersedes": "int", "reason": "string"},
}
VALUES = {
    ("stage_end", "result"): ("pass", "fail", "skip"),
    ("loop_end", "outcome"): ("success", "partial", "aborted"),
    ("commit", "kind"): ("feat", "fix", "test", "docs", "refactor", "chore", "data", "spec"),
}


def lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds the envelope's fields as text and data as a variant; a line that is no JSON gives null everywhere."""
    parsed = df.withColumn("_j", F.try_parse_json(value))
    get = lambda name, kind: F.try_variant_get("_j", f"$.{name}", kind)
    fields = {f: get(f, "string") for f in ENVELOPE[:-1]}
    return parsed.withColumns(fields | {"data": get("data", "variant")}).drop("_j")


def _kind(x: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(x), r"^([A-Z]+)", 1)


def violations(rows: DataFrame, codes: list[str]) -> DataFrame:
    """Adds violations, an array of texts, to rows of ``lines``; empty for a valid record.

    ``codes``: the known failure codes.
    """
    missing = [F.when(F.col(f).isNull() if f != "data" else F.col("data").isNull(), F.lit(f"missing {f}")) for f in ENVELOPE]
    checks: list[Column] = [F.when(~F.col("event").isin(*FIELDS), F.concat(F.lit("unknown event "), F.col("event")))]
    names = {"string": ("STRING",), "int": ("BIGINT",), "array": ("ARRAY",)}
    for event, fields in FIELDS.items():
        for name, kind in fields.items():
            value = F.try_variant_get("data", f"$.{name}", "variant")
            here = F.col("event") == event
            checks.append(F.when(here & value.isNull(), F.lit(f"missing data.{name}")))
            checks.append(F.when(here & value.isNotNull() & ~_kind(value).isin(*names[kind]), F.lit(f"type of data.{name}")))
            if (event, name) in VALUES:
                text = F.try_variant_get("data", f"$.{name}", "string")
                checks.append(F.when(here & text.isNotNull() & ~text.isin(*VALUES[event, name]), F.lit(f"value of data.{name}")))
    field = lambda name: F.try_variant_get("data", f"$.{name}", "string")
    failure = F.col("event") == "failure"
    checks.append(F.when(failure & ~field("code").isin(*codes), F.lit("unknown failure code")))
    checks.append(F.when(failure & (field("resolution") == "harness_fix") & (F.coalesce(field("harness_ref"), F.lit("")) == ""), F.lit("missing data.harness_ref")))
    early, late = F.array_compact(F.array(*missing)), F.array_compact(F.array(*checks))
    return rows.withColumn("violations", F.when(F.size(early) > 0, early).otherwise(late))


def corrected(events: DataFrame, file: str, line: str, event: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay after corrections, and the corrections that are wrong with the reason.

    A correction names an earlier line of its file that is no correction and
    has not been corrected before; the first valid one by line voids it.
    """
    wrong = events.where(F.col(event) == "correction").select(F.col(file).alias("_f"), F.col(line).alias("_l"), F.col(target).alias("_t"))
    aims = events.select(F.col(file).alias("_af"), F.col(line).alias("_al"), F.col(event).alias("_ae"))
    met = wrong.join(aims, (wrong["_f"] == aims["_af"]) & (wrong["_t"] == aims["_al"]) & (wrong["_t"] < wrong["_l"]), "left")
    reason = F.when(F.col("_al").isNull(), "no earlier line").when(F.col("_ae") == "correction", "corrects a correction")
    met = met.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("_f", "_t", F.col("reason").isNull()).orderBy("_l"))
    met = met.withColumn("reason", F.coalesce("reason", F.when(place > 1, "corrected before")))
    voided = met.where("reason is null").select(F.col("_f").alias(file), F.col("_t").alias(line))
    stay = events.where(F.col(event) != "correction").join(voided, [file, line], "left_anti")
    return stay, met.where("reason is not null").select(F.col("_f").alias(file), F.col("_l").alias(line), "reason")


def out_of_order(events: DataFrame, file: str, line: str, ts: str) -> DataFrame:
    """Lines whose time is before that of the line above."""
    before = F.lag(ts).over(Window.partitionBy(file).orderBy(line))
    return events.withColumn("_before", before).where(F.col(ts) < F.col("_before")).drop("_before")


def _strict(v: Column) -> Column:
    """Whether a version such as 1.10 is 1.2 or later; null and what is no list of numbers are not."""
    parts = F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))
    return F.coalesce(~F.exists(parts, lambda x: x.isNull()) & (parts >= F.array(F.lit(1), F.lit(2))), F.lit(False))


def file_warnings(effective: DataFrame) -> DataFrame:
    """(file, warning, n): files of old versions that break the rules of the project; n counts the lines that name the loop id, or the projects."""
    own = effective.groupBy("file").agg(F.count_if((F.col("project") == F.col("loop_id")) & ~_strict(F.col("v"))).alias("polluted"), F.count_distinct("project").alias("projects"), F.bool_or(_strict(F.col("v"))).alias("strict"))
    found = [F.when(F.col("polluted") > 0, F.struct(F.lit("project is the loop id").alias("warning"), F.col("polluted").alias("n"))), F.when((F.col("projects") > 1) & ~F.col("strict"), F.struct(F.lit("several projects").alias("warning"), F.col("projects").alias("n")))]
    return own.select("file", F.explode(F.array_compact(F.array(*found))).alias("_w")).select("file", "_w.*")


def file_violations(events: DataFrame, effective: DataFrame) -> DataFrame:
    """(file, violation) of whole files of events.

    ``events`` (file, line, event, ts, loop_id, project, failure_count, v) holds
    all lines, ``effective`` those that stay after corrections.  What stands
    after the first end may only replace a voided line of the same kind, one
    for one.  Rules of the project bind records of version 1.2 and later; older
    ones are for ``file_warnings``.
    """
    stem = F.regexp_replace(F.element_at(F.split(F.col("file").cast("string"), "/"), -1), r"\.[^.]*$", "")
    named = events.where(F.col("loop_id") != stem).select("file", F.lit("loop id differs from the file name").alias("violation")).distinct()
    late = out_of_order(events, "file", "line", "ts").select("file", F.lit("not in order of time").alias("violation")).distinct()
    none = events.select("file").distinct().join(effective.select("file").distinct(), "file", "left_anti").select("file", F.lit("no record is left").alias("violation"))
    first = F.min_by("event", "line")
    ended = F.min(F.when(F.col("event") == "loop_end", F.col("line")))
    declared = F.min_by("failure_count", F.when(F.col("event") == "loop_end", F.col("line")))
    ends, failures = (F.count_if(F.col("event") == x) for x in ("loop_end", "failure"))
    own = effective.groupBy("file").agg(first.alias("first"), ended.alias("ended"), declared.alias("declared"), ends.alias("ends"), failures.alias("failures"), ((F.count_distinct("project") > 1) & F.bool_or(_strict(F.col("v")))).alias("mixed"), F.bool_or((F.col("project") == F.col("loop_id")) & _strict(F.col("v"))).alias("polluted"))
    after = effective.join(own.select("file", "ended"), "file").where("line > ended").groupBy("file", "event").agg(F.count("*").alias("n"))
    voided = events.where("event <> 'correction'").join(effective.select("file", "line"), ["file", "line"], "left_anti").groupBy("file", "event").agg(F.count("*").alias("voided"))
    after = after.join(voided, ["file", "event"], "left").where("n > coalesce(voided, 0)").select("file", F.lit("records after the end").alias("violation")).distinct()
    checks = {"several projects": F.col("mixed"), "project is the loop id": F.col("polluted"), "does not begin with loop_start": F.col("first") != "loop_start", "several ends": F.col("ends") > 1, "declares another number of failures": F.col("declared") != F.col("failures")}
    whole = own.select("file", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))).alias("violation"))
    return whole.union(named).union(late).union(none).union(after)


class _File:
    """What the guards know of one file: sums over its log, the first records that stay, and the records admitted so far."""

    def __init__(self, row: dict):
        self.lines, self.left, self.ends, self.ended = row["lines"] or 0, row["kept"] or 0, row["ends"] or 0, row["ended"]
        self.old, self.voided, self.behind = self.lines, dict(row["voided"] or ()), dict(row["behind"] or ())
        self.first: deque[tuple[int, str | None]] = deque()
        self.early: dict[int, int] = {}  # wrong corrections of the log that name a line still to come, by that line
        self.own: dict[int, str] = {}
        self.gone: set[int] = set()

    def refusal(self, row: dict) -> str | None:
        event = row["event"]
        if event == "correction":
            aimed = self.aimed(row)
            if aimed is None:
                return "no record to correct"
            return "voids the start of other records" if aimed == "loop_start" and self.left > 1 else None
        while self.first and self.first[0][0] in self.gone:
            self.first.popleft()
        project = self.first[0][1] if self.first else None
        if project is not None and row["project"] != project:
            return "another project"
        if self.ends and self.voided.get(event, 0) <= self.behind.get(event, 0):
            return "after the end"
        return None

    def aimed(self, row: dict) -> str | None:
        target = row["target"]
        if target is None or target in self.gone:
            return None
        return row["known"] if target <= self.old else self.own.get(target)

    def admit(self, row: dict) -> int:
        event, aimed = row["event"], self.aimed(row) if row["event"] == "correction" else None
        self.lines += 1
        if self.ended is not None:
            self.behind[event] = self.behind.get(event, 0) + 1
        if self.lines in self.early:
            self.voided[event] = self.voided.get(event, 0) + self.early[self.lines]
        if event == "correction":
            self.left -= 1
            self.ends -= aimed == "loop_end"
            self.gone.add(row["target"])
            self.voided[aimed] = self.voided.get(aimed, 0) + 1
            return self.lines
        self.left += 1
        self.own[self.lines] = event
        self.first.append((self.lines, row["project"]))
        if event == "loop_end":
            self.ends, self.ended, self.behind = self.ends + 1, self.lines, {}
        return self.lines


def admitted(log: DataFrame, batch: DataFrame) -> DataFrame:
    """(file, seq, event, line, reason): each record of ``batch`` with the line that it gets in its file, or why it is refused.

    ``log`` (file, line, event, target, project) holds the lines written so far,
    ``batch`` (file, seq, event, target, project) records that are valid by
    themselves, taken in order of seq, a whole number, and where seq is equal of
    event, target and project; each sees those admitted before it.  Refused are
    a correction of what is no record or voided already, or of the start of a
    file that holds other records; a record of another project than that of the
    first record that stays; and after the end all but corrections and, one
    for one, records of the kind of a voided one.  A record without file or
    event is refused.  An empty batch gives an empty table, a file without log
    begins with line 1.

    The log only goes into sums by file, which combine early, and into joins on
    (file, line); a task streams the records of a file in order and keeps of
    them their events and of the log as many first records as the batch has
    corrections, so what it holds grows with the batch, not with the log.
    """
    # written once: each is read often, and a task would hold the sorts of all that comes before it
    named = cut(batch.select("file", F.col("seq").cast("long").alias("seq"), "event", F.col("target").cast("long").alias("target"), "project"), "batch")
    whole = named.where("file is not null and event is not null")
    files = whole.groupBy("file").agg((F.count_if(F.col("event") == "correction") + 1).alias("most"), F.count("*").alias("size"))
    own = log.select("file", F.col("line").cast("long").alias("line"), "event", F.col("target").cast("long").alias("target"), "project").join(files.select("file"), "file", "left_semi")
    own = cut(own, "log-of-batch")
    kept = cut(corrected(own, "file", "line", "event", "target")[0].select("file", "line", "event", "project"), "kept-lines")
    sums = own.groupBy("file").agg(F.max("line").alias("lines"), F.max(F.when(F.col("event") == "loop_end", F.col("line"))).alias("ended"))
    left = kept.groupBy("file").agg(F.count("*").alias("kept"), F.count_if(F.col("event") == "loop_end").alias("ends"))
    voids = own.where("event = 'correction'").select("file", F.col("target").alias("line")).join(own.where("event is not null").select("file", "line", "event"), ["file", "line"])
    later = own.where("event is not null").join(sums.select("file", "ended"), "file").where("line > ended")

    def by_event(rows: DataFrame, name: str) -> DataFrame:
        # one entry for each kind of event, of which there are few
        return rows.groupBy("file", "event").agg(F.count("*").alias("n")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("event", "n"))).alias(name))

    states = files.select("file")
    for part in (sums, left, by_event(voids, "voided"), by_event(later, "behind")):
        states = states.unionByName(part, allowMissingColumns=True)
    states = states.groupBy("file").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("lines", "ended", "kept", "ends", "voided", "behind")])
    firsts = running_counts(kept.withColumn("_one", F.lit(1)), ["file"], ["line"], "_one").join(files, "file").where("_upto <= most")
    aimed = kept.select("file", F.col("line").alias("target"), F.col("event").alias("known"))
    early = own.where("event = 'correction'").join(sums.select("file", "lines"), "file").join(files, "file").where("target > lines and target <= lines + size").groupBy("file", F.col("target").alias("seq")).agg(F.count("*").alias("kept"))
    records = whole.join(aimed, ["file", "target"], "left")
    stream = (
        states.withColumn("phase", F.lit(0))
        .unionByName(firsts.select("file", F.lit(1).alias("phase"), F.col("line").alias("seq"), "project"), allowMissingColumns=True)
        .unionByName(early.withColumn("phase", F.lit(2)), allowMissingColumns=True)
        .unionByName(records.withColumn("phase", F.lit(3)), allowMissingColumns=True)
    )
    columns = ["file", "phase", "seq", "event", "target", "project", "known", "lines", "kept", "ends", "ended", "voided", "behind"]
    stream = stream.select(*columns).repartition("file").sortWithinPartitions("file", "phase", "seq", "event", "target", "project")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out_schema = None, None
        for part in batches:
            out_schema = out_schema or pa.schema([part.schema.field("file"), ("seq", pa.int64()), ("event", pa.string()), ("line", pa.int64()), ("reason", pa.string())])
            out = []
            for row in part.to_pylist():
                if row["phase"] == 0:
                    state = _File(row)
                elif row["phase"] == 1:
                    state.first.append((row["seq"], row["project"]))
                elif row["phase"] == 2:
                    state.early[row["seq"]] = row["kept"]
                else:
                    reason = state.refusal(row)
                    out.append({"file": row["file"], "seq": row["seq"], "event": row["event"], "line": None if reason else state.admit(row), "reason": reason})
            yield pa.RecordBatch.from_pylist(out, out_schema)

    schema = f"file {stream.schema['file'].dataType.simpleString()}, seq long, event string, line long, reason string"
    nameless = named.where("file is null or event is null").select("file", "seq", "event", F.lit(None).cast("long").alias("line"), F.lit("no file or event").alias("reason"))
    return stream.mapInArrow(run, schema).unionByName(nameless)


def rollup_by(events: DataFrame, group: str, line: str, event: str, kinds: list[str], ts: str) -> DataFrame:
    """One row for each group: first and last time, a count of each kind, and the last kind by line."""
    counts = [F.count_if(F.col(event) == k).alias(f"n_{k}") for k in kinds]
    return events.groupBy(group).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), *counts, F.max_by(event, line).alias("last"))


def last_of(events: DataFrame, group: str, line: str, event: str, kind: str, columns: list[str]) -> DataFrame:
    """(group, columns) of the last row of a kind in each group, as of the last test run."""
    own = events.where(F.col(event) == kind)
    return own.groupBy(group).agg(F.max_by(F.struct(*columns), line).alias("_last")).select(group, "_last.*")


def failures_by_code(failures: DataFrame, code: str, taxonomy: DataFrame) -> DataFrame:
    """(code, n, name): failures of each code with its name in the taxonomy (code, name), ? for an unknown one."""
    counts = failures.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))
    return counts.join(taxonomy, "code", "left").select("code", "n", F.coalesce("name", F.lit("?")).alias("name"))


def two_strikes(failures: DataFrame, code: str, ref: str) -> DataFrame:
    """(code, n, needs_rule, has_rule): codes that failed twice need a rule."""
    return failures.groupBy(code).agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("needs_rule"), F.coalesce(F.bool_or(F.col(ref).isNotNull()), F.lit(False)).alias("has_rule"))


#: Characters that do not belong into the texts, and what blocks or warns in added lines.
CYRILLIC, HANGUL, CONTROL = r"[\u0400-\u052F]", r"[\uAC00-\uD7AF\u1100-\u11FF\u3130-\u318F]", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
BLOCKED_LINES = {
    "private key": r"-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
    "access key": r"AKIA[0-9A-Z]{16}",
    "written credential": r"(?i)\b(api[_-]?key|secret|token|password|passwd)\b\s*[=:]\s*['\"][^'\"]{8,}['\"]",
}
WARNED_LINES = {
    "evaluates text": r"\beval\s*\(",
    "joins text into a statement": r"(?i)(execute|cursor\.execute)\s*\(\s*[\"'].*%s.*[\"']\s*%",
}


def hygiene(rows: DataFrame, key: str, text: str, allow: str = "hygiene-allow") -> DataFrame:
    """(key, line, cyrillic, hangul, control, stray_cr) of the lines that hold such characters.

    A line with the allow mark is only looked at for a carriage return without
    a line feed behind it.
    """
    parts = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"), F.size(F.split(text, "\n")).alias("n"))
    plain = ~F.contains("value", F.lit(allow))
    stray = F.col("value").rlike(r"(?s)\r.") | ((F.col("line") == F.col("n") - 1) & F.col("value").endswith("\r"))
    found = {name: plain & F.col("value").rlike(p) for name, p in (("cyrillic", CYRILLIC), ("hangul", HANGUL), ("control", CONTROL))} | {"stray_cr": stray}
    return parts.withColumns(found).where("cyrillic or hangul or control or stray_cr").select(key, (F.col("line") + 1).alias("line"), *found)


def secret_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, finding): lines that hold a key or credential (block) or look unsafe (warn), one row for each finding."""
    parts = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    found = [F.when(F.col("value").rlike(p), F.struct(F.lit(level).alias("level"), F.lit(name).alias("finding"))) for level, table in (("block", BLOCKED_LINES), ("warn", WARNED_LINES)) for name, p in table.items()]
    return parts.select(key, (F.col("line") + 1).alias("line"), F.explode(F.array_compact(F.array(*found))).alias("_f")).select(key, "line", "_f.*")


def largest_changes(rows: DataFrame, path: str, changed: Column, exempt: tuple[str, ...], k: int = 5) -> DataFrame:
    """(path, changed): the k files with the most changed lines, without those whose path fits one of the globs (* and ?)."""
    pattern = "|".join("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) for glob in exempt)
    own = rows.where(~F.col(path).rlike(f"(?s)^(?:{pattern})$")) if exempt else rows
    return own.groupBy(path).agg(F.sum(changed).cast("long").alias("changed")).orderBy(F.desc("changed"), path).limit(k)
