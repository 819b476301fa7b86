"""Personal data by patterns, checksums and context, in expressions only.

Patterns propose spans, validators (digit counts, Luhn, mod 97, number ranges)
confirm them, and words around a span raise or lower its score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_sums


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.split(F.reverse(digits), "")
    one = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.filter(reverse, lambda x: x != ""), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number with its country and check digits, in one piece or in groups of four, leaves 1 modulo 97."""
    own = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(own, 5, 100), F.substring(own, 1, 4))
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("string")).otherwise((F.ascii(x) - 55).cast("string"))
    step = lambda a, x: F.when(F.length(x) == 2, (a * 100 + x.try_cast("int")) % 97).otherwise((a * 10 + x.try_cast("int")) % 97)
    letters = F.filter(F.split(moved, ""), lambda x: x != "")
    return (F.length(own) >= 15) & (F.aggregate(F.transform(letters, value), F.lit(0), step) == 1)


def _between(x: Column, least: int, most: int) -> Column:
    return (F.length(x) >= least) & (F.length(x) <= most)


@dataclass(frozen=True)
class Kind:
    """pattern: proposes; needs: a cheap sign that a text may hold it; valid: confirms.

    score: what a confirmed span is worth alone, in hundredths; ``words`` near
    it add ``STEP``, ``against`` near it take ``STEP`` off.  Spans of a score
    below ``least`` are not reported.
    """

    name: str
    pattern: str
    needs: str
    valid: object
    score: int
    words: str = ""
    against: str = ""
    least: int = 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What a word near a span adds to its score or takes off; characters before and after a span, up to the next match of its kind, that are searched for them.
STEP, BEFORE, AFTER = 30, 40, 20
#: Score from which the kinds that the method adds are reported: each of them stays below it alone, so that context decides.
LEAST = 50


def _words(*names: str) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(names)})(?![\p{{L}}\p{{N}}])"


#: The base kinds, reported whenever they are valid.  A match can only start where a run of its first class does, or where the last match ended.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, 70, _words("e-?mail", "mail", "contact", "kontakt", "correo", "courriel", "write to"), _words("example", "noreply", "no-reply")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", lambda x: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 60, _words("ip", "ipv4", "address", "adresse", "dirección", "host", "login"), _words("version", "release", "firmware", "build")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", lambda x: _between(_digits(x), 14, 19) & luhn(_digits(x)), 60, _words("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta"), _words("order", "invoice", "tracking", "part", "serial", "isbn", "ean", "item")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda x: _between(_digits(x), 10, 15), 70, _words("phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "handy", "téléphone", "teléfono", "móvil"), _words("order", "part", "serial")),
)
#: Kinds that the method adds.
ADDED = (
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[0-9]{1,3})?)\b", "", mod97, 40, _words("iban", "account", "bank", "bic", "konto", "compte", "cuenta"), _words("order", "part", "serial", "sample"), LEAST),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", None, 30, _words("ssn", "social security", "sozialversicherung", "sécurité sociale", "seguridad social"), _words("order", "part", "serial", "isbn"), LEAST),
    Kind("local", r"(?<![0-9(+-])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", "", None, 30, _words("phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "handy", "téléphone", "teléfono", "móvil"), _words("order", "part", "serial"), LEAST),
)


def _with_gaps(i: int) -> Column:
    return F.transform(f"m{i}", lambda x, j: F.length(x) + F.length(F.get(f"s{i}", j))).alias(f"g{i}")


def _confirmed(i: int, kind: Kind) -> Column:
    """Spans of a kind from its matches m, their ends g, and what stands before, between and after them, s."""

    def span(x: Column, j: Column) -> Column:
        end = F.get(f"g{i}", j)
        near = F.concat(F.right(F.get(f"s{i}", j), F.lit(BEFORE)), F.lit("\n"), F.left(F.get(f"s{i}", j + 1), F.lit(AFTER)))
        return F.struct((end - F.length(x)).alias("start"), F.lit(i).alias("order"), F.lit(kind.name).alias("kind"), end.alias("end"), x.alias("value"), score(near).alias("score"))

    def score(near: Column) -> Column:
        adds = [F.when(near.rlike(words), F.lit(sign * STEP)).otherwise(0) for words, sign in ((kind.words, 1), (kind.against, -1)) if words]
        return F.least(F.lit(100), sum(adds, F.lit(kind.score)))

    spans = F.transform(f"m{i}", span)
    if kind.valid is not None:
        spans = F.filter(spans, lambda s: kind.valid(s["value"]))
    return F.filter(spans, lambda s: s["score"] >= kind.least) if kind.least else spans


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = BASE + ADDED, keep: list[str] | None = None) -> DataFrame:
    """``id_col``, the columns in ``keep`` and spans: array of (start, order, kind, end, value, score), by start and kind.

    Offsets are code points, end exclusive; score is in hundredths.  Matches of
    a kind are leftmost and do not overlap; a match that fails its validator is
    dropped and what it covered is not searched again.  Base kinds are listed
    whatever their score, added ones from their least score on.

    A null or empty text has no spans.  One row for each row of ``docs``, also
    for null ids and repeated rows; an empty table gives an empty one.  Other
    columns are ignored, whatever their names, unless in ``keep``; a kept
    column named spans would stand beside the result and is an error.  Texts of
    any length are searched whole, in the memory of one row.
    """
    if "spans" in (keep or []):
        raise ValueError("a kept column may not be named spans")
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    k = [f"k{i}" for i in range(len(names))]
    number = F.col("x").rlike("[0-9]")
    own = own.select(*k, "x", number.alias("digit"))
    none = F.array().cast("array<string>")
    columns = []
    for i, kind in enumerate(kinds):
        may = (F.col("digit") if kind.name != "email" else F.lit(True)) & (F.instr("x", kind.needs) > 0 if kind.needs else F.lit(True))
        columns.append(F.when(may, F.regexp_extract_all("x", F.lit(kind.pattern), 0)).otherwise(none).alias(f"m{i}"))
    own = own.select(*k, "x", *columns)
    # a span starts after all gaps up to its own and all matches before it
    gaps = [F.when(F.size(f"m{i}") > 0, F.split("x", kind.pattern)).otherwise(none).alias(f"s{i}") for i, kind in enumerate(kinds)]
    m = [f"m{i}" for i in range(len(kinds))]
    own = own.select(*k, *m, *gaps)
    own = own.select(*k, *m, *[f"s{i}" for i in range(len(kinds))], *map(_with_gaps, range(len(kinds))))
    own = running_sums(own, [f"g{i}" for i in range(len(kinds))])
    parts = [_confirmed(i, kind) for i, kind in enumerate(kinds)]
    return own.select(*[F.col(a).alias(c) for a, c in zip(k, names)], F.array_sort(F.concat(*parts)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the text with each span replaced by its kind in brackets; of overlapping spans the first stays.

    A null text stays null, an empty one empty; one row for each row, repeated
    ones too, and none for an empty table.  Other columns are ignored.
    """
    spans = find_pii(docs, id_col, text_col, keep=[text_col])
    first = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")),
        ).otherwise(a),
        lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, F.lit(2147483647))),
    )
    return spans.select(id_col, first.alias(text_col))
