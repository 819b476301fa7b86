"""Secret scans with corpus-wide ownership.

Candidates of the whole corpus are hashed and counted by the distinct
repositories and owners that hold them.  A string that several owners, or many
repositories, hold is a copied example; one that a single owner holds in few
places looks live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .batches import slices, texts

#: Kinds of spans; the first three are always listed, the others only where the corpus says that they are live.
KINDS = ("assign", "access", "hex", "known", "token", "key")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Keys whose issuer marks them with a prefix, and what follows the header of a private key.
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----\s+[A-Za-z0-9+/=]{16,})")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_KEY = re.compile(r"(?<![A-Za-z0-9])[a-z0-9]{20,64}(?![A-Za-z0-9])")
#: Bits a character that a token, and a key of small letters and digits, must have; a key's least number of digits.
ENTROPY, KEY_ENTROPY, KEY_DIGITS = 3.5, 3.0, 4
#: A string that more owners, or more repositories, hold is a copied example.
OWNERS, REPOSITORIES = 1, 3


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) of the base kinds; leftmost matches that do not overlap within a kind."""
    lower = text.lower()
    out = []
    if "passw" in lower or "secret" in lower or "token" in lower or "api" in lower:
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return out


def entropy(x: str) -> float:
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())


def more_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidates of the other kinds that overlap neither a base span nor each other; kinds listed first go first."""
    out = [("known", m.start(), m.end(), m[0]) for m in _KNOWN.finditer(text)]
    for m in _TOKEN.finditer(text):
        x = m[0]
        if any(map(str.isdigit, x)) and any(map(str.isupper, x)) and any(map(str.islower, x)) and entropy(x) >= ENTROPY:
            out.append(("token", m.start(), m.end(), x))
    for m in _KEY.finditer(text):
        x = m[0]
        digits = sum(map(str.isdigit, x))
        if KEY_DIGITS <= digits <= len(x) - KEY_DIGITS and entropy(x) >= KEY_ENTROPY:
            out.append(("key", m.start(), m.end(), x))
    if not out:
        return out
    taken = sorted((a, b) for _, a, b, _ in base)
    # the ends of base spans up to each one, so that one look-up tells whether any of them reaches into a place
    ends = list(accumulate((b for _, b in taken), max))
    starts = [a for a, _ in taken]
    free, last = [], 0
    for x in sorted(out, key=lambda x: (x[1], KINDS.index(x[0]))):
        before = bisect_left(starts, x[2])
        if x[1] >= last and (before == 0 or ends[before - 1] <= x[1]):
            free.append(x)
            last = x[2]
    return free


_FIELDS = [("start", pa.int64()), ("order", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("secret", pa.string())]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """``id_col`` and spans: array of (start, order, kind, end, secret, n_repositories, n_owners, verdict), by start and kind.

    Candidates of the whole corpus are counted by the owners, and by the
    repositories of owners, that hold them.  verdict is live for a string that
    at most ``owners`` owners and ``repositories`` repositories hold, else
    example.  Spans of the base kinds (assign, access, hex) are always listed,
    with their verdict; those of the other kinds only if they are live.
    secret is the SHA-256 of the string, never the string.

    ``repository`` and ``owner`` are columns of ``docs`` (default: the id and
    the source of a document); a null one counts as one more of its own.  A
    null or empty text has no spans.  One row for each row of ``docs``, also
    for repeated rows and null ids; an empty table gives an empty one; other
    columns are ignored, whatever their names.  A task holds about a megabyte
    of texts, or one longer text.
    """
    repository = F.col(id_col) if repository is None else repository
    owner = F.col("source") if owner is None else owner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in texts(part.column("text")):
                    base = base_spans(text)
                    found = sorted((s, KINDS.index(kind), kind, e, hashlib.sha256(x.encode()).hexdigest()) for kind, s, e, x in [*base, *more_spans(text, base)])
                    rows.append([dict(zip(("start", "order", "kind", "end", "secret"), x)) for x in found])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("repository"), part.column("owner"), pa.array(rows, pa.list_(pa.struct(_FIELDS)))], ["id", "repository", "owner", "found"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(repository.cast("string"), F.lit("?")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("?")).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, repository string, owner string, found array<struct<start:long,order:int,kind:string,end:long,secret:string>>")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    held = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("found", lambda x: x["secret"]))).alias("secret")).distinct()
    counts = held.groupBy("secret", "owner").agg(F.count("*").alias("n")).groupBy("secret").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    # written apart, so that the join with a string of many spans can be split
    counts = cut(counts, "owners-of-secrets")
    spans = found.select("row", F.explode("found").alias("s")).select("row", "s.*").join(counts, "secret")
    live = (F.col("n_owners") <= owners) & (F.col("n_repositories") <= repositories)
    spans = spans.withColumn("verdict", F.when(live, "live").otherwise("example")).where(live | F.col("kind").isin(*KINDS[:3]))
    span = F.struct("start", "order", "kind", "end", "secret", "n_repositories", "n_owners", "verdict")
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = found.select("row", "id").join(spans, "row", "left")
    nothing = F.array().cast(spans.schema["spans"].dataType)
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", nothing).alias("spans"))
