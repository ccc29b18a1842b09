"""Safe display, short names, columns at a place and gates on frozen ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators import checks

#: Characters of a text that are shown.
SHOWN = 300


def escaped(x: Column, limit: int = SHOWN) -> Column:
    r"""The first `limit` characters; control, format, unassigned and line characters and spaces other than ' ' as \uXXXX (or \UXXXXXXXX), and how many are left out."""
    head = F.substring(x, 1, limit)

    def shown(c: Column) -> Column:
        u = F.lower(F.hex(F.encode(c, "UTF-32")))
        short = F.concat(F.lit("\\u"), F.substring(u, 5, 4))
        return F.when(c.rlike(r"^[\p{C}\p{Zl}\p{Zp}\p{Zs}]$") & (c != " "), F.when(F.substring(u, 1, 4) == "0000", short).otherwise(F.concat(F.lit("\\U"), u))).otherwise(c)

    rest = F.length(x) - limit  # fixed value: the words that stand for what is not shown
    text = F.array_join(F.transform(F.split(head, ""), shown), "")
    return F.concat(text, F.when(rest > 0, F.concat(F.lit(" ... ["), rest.cast("string"), F.lit(" more characters not shown]"))).otherwise(""))


def slug(x: Column) -> Column:
    """Lower-case letters and digits, anything else as one '_', none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def inserted(df: DataFrame, place: int, name: str, value: Column) -> DataFrame:
    """`df` with a new column at `place`, from 0."""
    return df.select(*df.columns[:place], value.alias(name), *df.columns[place:])


def gate(name: str, frozen: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(gate, status): PASS if both hold the same ids, by the digests of all ids."""
    a, b = (checks.digest(df, key).select(F.col("sha256").alias(c)) for df, c in ((frozen, "a"), (current, "b")))
    return a.crossJoin(F.broadcast(b)).select(F.lit(name).alias("gate"), F.when(F.col("a") == F.col("b"), "PASS").otherwise("FAIL").alias("status"))  # a row each
