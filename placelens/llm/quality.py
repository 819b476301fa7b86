"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols, and frequent words of the four languages of the corpus.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the be to of and that have with a in is it for on as are was by this or "
    "der die das und ist nicht ein eine mit für auf im den von zu sich des als "
    "le la les de des du et est un une dans que qui pour pas sur avec au "
    "el los las y en es por con una para se como lo más del"
).split()

#: Words of the windows that are looked for again in the same text.
SPAN = 8
#: White space between words, as a pattern and as characters.
SPACE, SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"

#: name: (ratio in SQL over the measures below, least, most); null leaves a side open.  All must hold for a text to be kept.
THRESHOLDS: dict[str, tuple[str, float | None, float | None]] = {
    "word length": ("word_chars / n_words", 2.0, 20.0),
    "symbols": ("n_symbols / n_words", None, 0.3),
    "exclamations": ("n_exclaims / n_words", None, 0.5),
    "stop words": ("n_stop_words", 2.0, None),
    "repeated lines": ("n_dup_lines / n_lines", None, 0.5),
    "line length": ("n_words / n_lines", 2.0, None),
}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts of each whole text, by expressions only; a null text has no words and one empty line.

    Returns ``id_col``, the columns named in ``keep``, n_words, word_chars,
    n_symbols, n_exclaims, n_stop_words (distinct ones), n_lines (with a
    word), n_dup_lines and n_repeat_words.  A text stays one row however long;
    its words and lines are arrays of that row.  An empty table gives none.
    Names in ``keep`` should differ from those of the measures; ``kept_rows``
    takes any.
    """
    kept = [F.col(c) for c in dict.fromkeys([id_col, *(keep or [])])]
    own = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(kept)], F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    k = [f"k{i}" for i in range(len(kept))]
    bare = F.translate("x", SPACES, "")
    lines = F.filter(F.split("x", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = own.select(
        *k,
        F.array_remove(F.split("x", SPACE), "").alias("w"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("x") - F.length(F.translate("x", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("x") - F.length(F.translate("x", "!", ""))).cast("long").alias("n_exclaims"),
        lines.alias("l"),
    )
    places = F.when(F.size("w") >= SPAN, F.sequence(F.lit(1), F.size("w") - SPAN + 1)).otherwise(F.array().cast("array<int>"))
    counts = ["word_chars", "n_symbols", "n_exclaims"]
    own = own.select(
        *k,
        *counts,
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.size(F.array_intersect("w", F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        places.alias("i"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    counts += ["n_words", "n_stop_words", "n_lines", "n_dup_lines"]
    # hashes of the windows only tell which texts may have a window twice
    own = own.select(*k, *counts, "w", "i", F.transform("i", lambda i: F.xxhash64(F.slice("h", i, SPAN))).alias("g"))
    again = F.size(F.array_distinct("g")) < F.size("g")
    windows = F.transform("i", lambda i: F.struct(F.array_join(F.slice("w", i, SPAN), " ").alias("words"), i.alias("at")))
    own = own.select(*k, *counts, F.when(again, F.array_sort(windows)).alias("s"))
    same = lambda x, i: F.coalesce(F.get("s", i)["words"] == x["words"], F.lit(False))
    twice = F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    # a filter on the result can't be moved below the row number, and so doesn't copy all of these expressions into itself
    own = own.select(*k, *counts, F.array_sort(F.transform(twice, lambda x: x["at"])).alias("p"), F.monotonically_increasing_id().alias("row"))
    covered = F.transform("p", lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get("p", i + 1) - x, F.lit(SPAN))))
    total = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return own.select(*[F.col(a).alias(c) for a, c in zip(k, dict.fromkeys([id_col, *(keep or [])]))], *counts, F.when(F.col("row") >= 0, total).alias("n_repeat_words"))


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of the words in windows that repeat."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def failed_rules(thresholds: dict[str, tuple[str, float | None, float | None]] | None = None) -> Column:
    """Array of the names of the rules that a row of ``measures`` breaks; a ratio over zero breaks none."""
    checks = []
    for name, (ratio, least, most) in (thresholds or THRESHOLDS).items():
        x = F.expr(ratio if "/" not in ratio else "try_divide({}, {})".format(*ratio.split(" / ")))
        bad = F.lit(False)
        if least is not None:
            bad = bad | (x < least)
        if most is not None:
            bad = bad | (x > most)
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*checks))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``measures`` with base_failed, failed_rules and kept.

    kept is false if the base rule or any threshold fails.  One row for each
    row of ``docs``; null and empty texts fail the base rule; ties and repeated
    rows have no part in it; other columns are ignored unless in ``keep``.
    """
    out = measures(docs, id_col, text_col, keep).withColumn("base_failed", base_failed()).withColumn("failed_rules", failed_rules())
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns under any name; repeated rows stay repeated, null and empty texts go."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = (names[docs.columns.index(c)] for c in (id_col, text_col))
    judged = quality(docs.toDF(*names), id_at, text_at, keep=names)
    return judged.where("kept").select(*names).toDF(*docs.columns)
