"""Articles: sections, selection, truncation, rejects and grouping of members by article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_title

#: Shortest article, characters kept, title of what stands before the first heading.
LEAST, MOST, LEAD = 120, 800, "(導入)"
#: A heading on a line of its own, between equal runs of the sign.
HEADING = r"(?m)^(=+)\s*(.+?)\s*\1\s*$"


def sections(text: Column, heading: str = HEADING) -> Column:
    """Array of (title, body): what stands before the first heading and after each; empty bodies are dropped."""
    titles = F.concat(F.array(F.lit(LEAD)), F.regexp_extract_all(text, F.lit(heading), 2))
    bodies = F.transform(F.split(text, heading), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    both = F.transform(titles, lambda t, i: F.struct(t.alias("title"), F.get(bodies, i).alias("body")))
    return F.filter(both, lambda s: F.coalesce(s["body"], F.lit("")) != "")


def selected(own: Column, keep: list[str], drop: list[str]) -> Column:
    """Sections to use: none of ``drop``, and the lead or one of ``keep``; if that leaves none, all not dropped."""
    named = lambda s, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s["title"], w))
    rest = F.filter(own, lambda s: ~named(s, drop))
    wanted = F.filter(rest, lambda s: (s["title"] == LEAD) | named(s, keep))
    return F.when(F.size(wanted) > 0, wanted).otherwise(rest)


def truncated(text: Column, most: int = MOST) -> Column:
    """struct(text, truncated) by code points."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"))


def with_rejects(rows: DataFrame, text: str, revision: str, least: int = LEAST) -> DataFrame:
    """Adds reason: empty, no_revision or short, the first that holds, else null."""
    own = F.btrim(F.coalesce(F.col(text), F.lit("")))
    reason = F.when(own == "", "empty").when(F.col(revision).isNull(), "no_revision").when(F.length(own) < least, "short")
    return rows.withColumn("reason", reason)


def by_article(rows: DataFrame, article: str, key: str, revision: str, text: str) -> DataFrame:
    """One row for each article: the document of the largest (revision, key) speaks for it; n_members; mismatch if its rows differ.

    The members themselves stay rows of their own, as an article may have any number of them.
    """
    version = F.struct(F.col(revision), F.sha2(F.col(text), 256))
    return rows.groupBy(article).agg(F.max_by(key, F.struct(revision, key)).alias("speaker"), F.count("*").alias("n_members"), (F.count_distinct(version) > 1).alias("mismatch"))


def representative(members: DataFrame, article: str, key: str, name: str, title: str) -> DataFrame:
    """(article, representative): the member whose name equals the base title, else whose name lies in the title, else the shortest, else the smallest id.

    An empty or null name lies in no title and counts as the longest.
    """
    n, t = F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(title), F.lit(""))
    other, outside = n != F.btrim(base_title(t)), (n == "") | ~F.contains(t, n)
    order = F.struct(other.alias("x"), outside.alias("y"), F.when(n == "", F.lit(10**6)).otherwise(F.length(n)).alias("z"), F.col(key).alias("k"))
    return members.groupBy(article).agg(F.min_by(key, order).alias("representative"))
