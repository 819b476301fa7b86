"""Rows in and rows out: rejects with reasons, rights, folds and guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds (west, south, east, north), rights codes, those that may be used, those that ask for a credit.
BOUNDS = (122.0, 20.2, 154.1, 45.8)
RIGHTS_CODES = (
    "edu", "noncom", "com", "cc0", "pdm", "ccby", "ccbysa", "ccbynd", "ccbync", "ccbyncsa", "ccbyncnd",
    "incr", "incr_edu", "nocr_cont", "nocr_other", "uneval", "undet", "others",
)
USABLE = ("cc0", "pdm", "ccby")
CREDITED = ("ccby", "ccbysa", "ccbynd", "ccbync", "ccbyncsa", "ccbyncnd")


def or_missing(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def first_reason(**reasons: Column) -> Column:
    """Name of the first condition that holds, else null; an unknown condition does not hold."""
    cases = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons.items()]
    return F.coalesce(*cases)


def surrogate_id(prefix: str, kind: Column, number: Column) -> Column:
    letter = F.when(kind == "node", "n").when(kind == "way", "w").when(kind == "relation", "r")
    return F.concat(F.lit(prefix), letter, number.cast("string"))


def with_reject_reason(rows: DataFrame, key: str, order: list[str], bounds: tuple[float, float, float, float] = BOUNDS) -> DataFrame:
    """Adds ``reason``: no_coordinates, outside_bounds or duplicate_id (only among rows not rejected before), else null."""
    west, south, east, north = bounds
    early = first_reason(
        no_coordinates=F.col("lon").isNull() | F.col("lat").isNull(),
        outside_bounds=~(F.col("lon").between(west, east) & F.col("lat").between(south, north)),
    )
    rows = rows.withColumn("reason", early)
    place = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy(*order))
    return rows.withColumn("reason", F.coalesce("reason", F.when(place > 1, "duplicate_id")))


def with_rights(rows: DataFrame, code: str, allow: tuple[str, ...] = USABLE) -> DataFrame:
    """Adds code_known, usable and credit; everything that is not a known, allowed code is denied."""
    own = F.nullif(F.btrim(F.col(code)), F.lit(""))
    known = F.coalesce(own.isin(*RIGHTS_CODES), F.lit(False))
    return rows.withColumns(
        {"code_known": known, "usable": known & F.coalesce(own.isin(*allow), F.lit(False)), "credit": known & F.coalesce(own.isin(*CREDITED), F.lit(False))}
    )


def fold(rows: DataFrame, key: str, first: dict[str, str] | None = None, sets: dict[str, str] | None = None, ordinal: str = "ordinal") -> DataFrame:
    """One row for each key: the first non-null value by ``ordinal`` of some columns, the sorted distinct values of others."""
    agg = [F.min_by(source, F.when(F.col(source).isNotNull(), F.col(ordinal))).alias(name) for name, source in (first or {}).items()]
    agg += [F.array_sort(F.collect_set(source)).alias(name) for name, source in (sets or {}).items()]
    return rows.groupBy(key).agg(*agg)


def attach(core: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """Left joins of side tables with one row for each key; keys that the core lacks are ignored."""
    return reduce(lambda a, b: a.join(b, key, "left"), sides, core)


def approved(table: DataFrame, status: str, wanted: str = "approved_frozen") -> DataFrame:
    """The table, or an error if any row has another status or there is none."""
    found = [x[0] for x in table.select(status).distinct().limit(2).collect()]
    if found != [wanted]:
        raise ValueError(f"reference table is not {wanted}: {found}")
    return table.drop(status)


def capped(value: Column, most: float, reason: str) -> tuple[Column, Column]:
    """The value, null beyond ``most``, and the reason where it is null for that."""
    over = value > most
    return F.when(~over, value), F.when(over, F.lit(reason))


def changes(before: DataFrame, after: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Keys whose value differs between two tables; missing counts as 0."""
    both = before.withColumnRenamed(value, "n_before").join(after.withColumnRenamed(value, "n_after"), key, "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("delta", F.col("n_after") - F.col("n_before")).where("delta <> 0")


def searched(rows: DataFrame, name: str, wanted: str) -> DataFrame:
    """Rows whose name holds what is wanted, without the space around it; nothing wanted keeps all."""
    return rows.where(F.contains(name, F.lit(wanted.strip()))) if wanted.strip() else rows


def valid_id(x: Column, prefix: str = "jinja_") -> Column:
    """Whether an id is the prefix, a letter of n, w, r and digits; null is not."""
    return F.coalesce(x.rlike(rf"^{prefix}[nwr]\d+\z"), F.lit(False))


def valid_partition(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\d{2}\z"), F.lit(False))


#: Shapes that mean a vector or a text in a published document, and fields that are looked at more closely.
VECTOR_LEAST, TEXT_LEAST, NAMED_LEAST = 32, 300, 120
SUSPICIOUS = ("text", "extract", "body", "embedding", "vector", "vec", "embeddings")


def leaks(rows: DataFrame, key: str) -> DataFrame:
    """(key, path, kind): columns, with the fields and elements inside them, that hold a long list of numbers (vector) or a long string (text).

    A suspicious field may hold no list at all and only short strings.  The
    schema tells where to look, so each place is one expression.
    """

    def walk(value: Column, kind: T.DataType, path: str, name: str) -> list[tuple[str, Column, str]]:
        if isinstance(kind, T.StringType):
            return [(path, F.length(value) >= (NAMED_LEAST if name in SUSPICIOUS else TEXT_LEAST), "text")]
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(value[f.name], f.dataType, f"{path}.{f.name}", f.name)]
        if isinstance(kind, T.MapType):
            return walk(F.map_values(value), T.ArrayType(kind.valueType), path, "")
        if isinstance(kind, T.ArrayType):
            own = [(path, value.isNotNull(), "vector")] if name in SUSPICIOUS else []
            if isinstance(kind.elementType, T.NumericType):
                return own or [(path, F.size(value) >= VECTOR_LEAST, "vector")]
            inner = kind.elementType
            found = walk(F.lit(None).cast(inner), inner, f"{path}[]", name)
            inside = lambda i: lambda v: F.coalesce(walk(v, inner, f"{path}[]", name)[i][1], F.lit(False))
            return own + [(p, F.exists(value, inside(i)), k) for i, (p, _, k) in enumerate(found)]
        return []

    places = [x for f in rows.schema.fields if f.name != key for x in walk(F.col(f.name), f.dataType, f.name, f.name)]
    hits = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"))) for p, bad, k in places]))
    return rows.select(key, F.explode(hits).alias("_h")).select(key, "_h.*") if places else rows.select(key, F.lit("").alias("path"), F.lit("").alias("kind")).limit(0)
