"""Running sums of integer arrays in expressions, in two levels so that long arrays stay cheap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128


def running_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces each array of int by the array of its running sums.

    An array of n costs about n * BLOCK / 2 + (n / BLOCK) ** 2 / 2 additions.
    """
    rest = [c for c in df.columns if c not in columns]

    def total(part):
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blocks(c: str):
        last = F.floor((F.size(c) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(c, b * BLOCK + 1, BLOCK)))
        return F.when(F.size(c) > 0, sums).otherwise(F.array().cast("array<int>")).alias(f"{c}_blocks")

    def before(c: str):
        return F.transform(f"{c}_blocks", lambda x, b: total(F.slice(f"{c}_blocks", 1, b))).alias(f"{c}_before")

    def sums(c: str):
        own = lambda i: total(F.slice(c, i - i % BLOCK + 1, i % BLOCK + 1))
        return F.transform(c, lambda x, i: F.get(f"{c}_before", F.floor(i / BLOCK).cast("int")) + own(i)).alias(c)

    df = df.select(*rest, *columns, *map(blocks, columns))
    df = df.select(*rest, *columns, *map(before, columns))
    return df.select(*rest, *map(sums, columns))
