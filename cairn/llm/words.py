"""Word expressions shared by the operators, all as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text, unchanged; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def count_words(text: Column) -> Column:
    """How many words a text has, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns: those given, behind as many underscores as keep them from clashing with ``df``'s."""
    taken = {c.lower() for c in df.columns}
    lead = ""
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with those of its columns that are in ``names`` under free names, and what names them back."""
    clashing = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    free = free_names(df, *[f"_aside_{k}" for k in range(len(clashing))])
    return df.withColumnsRenamed(dict(zip(clashing, free, strict=True))), lambda out: out.withColumnsRenamed(dict(zip(free, clashing, strict=True)))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, UPPER.lower())


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that later filters don't compute again.

    Spark moves a filter below the projection whose columns it reads by repeating their expressions, at
    worst once per array element. Nothing is moved below a generator, so the columns come out of
    one, over an array of one element.
    """
    (one,) = free_names(df, "_one")
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias(one)
    return df.select("*", made).select(*df.columns, *[F.col(one)[k].alias(k) for k in columns])
