"""Text expressions: normalised names, similarities, keys and parsers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise(x: str | None) -> str:
    """NFKC, white space runs to one space, no space at the ends; null is empty."""
    return " ".join(re.split(r"\s+", unicodedata.normalize("NFKC", x or ""))).strip()


@F.pandas_udf(T.StringType())
def normalised(x: pd.Series) -> pd.Series:
    return x.map(normalise, na_action=None)


def plain_normalised(x: Column) -> Column:
    """``normalised``; texts of ASCII alone never leave the JVM."""
    own = F.coalesce(x, F.lit(""))
    plain = F.octet_length(own) == F.length(own)
    return F.when(plain, F.btrim(F.regexp_replace(own, r"\s+", " "))).otherwise(normalised(F.when(~plain, own)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_normalised(x: pd.Series) -> pd.Series:
    return x.map(lambda names: names if names is None else [normalise(y) for y in names])


def all_normalised(x: Column) -> Column:
    """``plain_normalised`` of each element of an array; a null array is empty."""
    own = F.coalesce(x, F.array().cast("array<string>"))
    plain = F.forall(own, lambda y: F.octet_length(F.coalesce(y, F.lit(""))) == F.length(F.coalesce(y, F.lit(""))))
    by_jvm = F.transform(own, lambda y: F.btrim(F.regexp_replace(F.coalesce(y, F.lit("")), r"\s+", " ")))
    return F.when(plain, by_jvm).otherwise(_all_normalised(F.when(~plain, own)))


def name_key(x: Column) -> Column:
    return F.replace(plain_normalised(x), F.lit(" "), F.lit(""))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity(a: str | None, b: str | None) -> float:
    """2 * LCS / (sum of lengths) of the normalised names; both empty is 1, one empty is 0."""
    a, b = normalise(a), normalise(b)
    if not a or not b:
        return 1.0 if a == b else 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def _best_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Largest similarity between two lists of names; null and empty names don't count, a list without others gives 0."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for left, right in zip(a, b):
        best = 0.0
        for x in filter(None, left if left is not None else ()):
            for y in filter(None, right if right is not None else ()):
                if (x, y) not in known:
                    known[x, y] = similarity(x, y)
                best = max(best, known[x, y])
        out.append(best)
    return pd.Series(out)


def best_similarity(a: Column | str, b: Column | str) -> Column:
    """``_best_similarity``; lists that share a name, or lack one, are settled without leaving the JVM."""
    a, b = (F.filter(x, lambda y: F.coalesce(y, F.lit("")) != "") for x in (a, b))
    open_ = (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    found = _best_similarity(F.when(open_, a), F.when(open_, b))
    return F.when(F.coalesce(open_, F.lit(False)), found).when(F.coalesce(F.arrays_overlap(a, b), F.lit(False)), 1.0).otherwise(0.0)


#: Words for parts of a site at the end of a name.
PART_WORDS = (
    "随神門", "随身門", "神門", "楼門", "中門", "手水舎", "拝殿", "本殿", "幣殿", "社務所",
    "神楽殿", "神輿庫", "鳥居", "授与所", "参集殿", "絵馬殿", "宝物殿", "神饌所", "祓所",
    "回廊", "狛犬",
)


def part_suffix(name: Column, words: tuple[str, ...] = PART_WORDS) -> Column:
    """The longest of the words that the name key ends with, else null."""
    pattern = "(" + "|".join(sorted(words, key=len, reverse=True)) + ")$"
    return F.nullif(F.regexp_extract(name_key(name), pattern, 1), F.lit(""))


def host_path(url: Column) -> Column:
    """Lower-cased host without www. and the path without slashes at its end; null where there is no host."""
    full = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("//"), url))
    rest = F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 0)
    host = F.regexp_replace(F.lower(F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when((rest != "") & (host != ""), F.concat(host, path))


def numeric_prefix(x: Column) -> Column:
    return F.regexp_extract(x, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def wkt_point(x: Column) -> Column:
    """struct(lon, lat) of ``Point(lon lat)``, else null."""
    pattern = r"^Point\((-?[0-9.]+) (-?[0-9.]+)\)$"
    lon, lat = (F.regexp_extract(x, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def year_range(value: Column, precision: Column) -> Column:
    """struct(year_min, year_max) of a time value: a year, decade or century by precision 9 and more, 8 or 7, else null."""
    sign, digits = F.regexp_extract(value, r"^([+-])(\d+)-", 1), F.regexp_extract(value, r"^([+-])(\d+)-", 2)
    year = digits.try_cast("int") * F.when(sign == "-", -1).otherwise(1)
    step = F.when(precision >= 9, 1).when(precision == 8, 10).when(precision == 7, 100)
    low = (F.floor(year / step) * step).cast("int")
    return F.when(low.isNotNull(), F.struct(low.alias("year_min"), (low + step - 1).cast("int").alias("year_max")))


def entity_id(uri: Column) -> Column:
    """Last segment of an entity's address."""
    return F.element_at(F.split(uri, "/"), -1)


def entity_number(qid: Column) -> Column:
    """Number of an id like Q12, 10**12 if it has none."""
    return F.coalesce(F.substring(qid, 2, 30).try_cast("long"), F.lit(10**12).cast("long"))


def page_title(url: Column) -> Column:
    """Title in an article's address: last segment, decoded, underscores as spaces."""
    last = F.element_at(F.split(url, "/"), -1)
    return F.replace(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


def base_title(title: Column) -> Column:
    return F.split_part(title, F.lit(" ("), F.lit(1))


def parity_half(key: Column) -> Column:
    """calibration or holdout by the first byte of a SHA-256."""
    first = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int")
    return F.when(first % 2 == 0, "calibration").otherwise("holdout")


def content_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}|"), text), 256)


def area_code(x: Column) -> Column:
    """Two digits of ``JP-nn`` with nn from 01 to 47; anything else fails."""
    code = F.regexp_extract(x, r"^JP-(\d{2})$", 1)
    known = code.try_cast("int").between(1, 47)
    return F.when(known, code).otherwise(F.raise_error(F.concat(F.lit("unknown area "), F.coalesce(x, F.lit("null")))))
