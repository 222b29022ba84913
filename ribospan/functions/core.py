"""Small Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: str | Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it inside ``body``.

    A derived column used inside a lambda would otherwise be inlined there and
    evaluated again for every array element.
    """
    return F.element_at(F.transform(F.array(col(value)), body), 1)


def positions(n: Column) -> Column:
    """``[1..n]``, empty when ``n < 1`` (``sequence`` alone would count down)."""
    return F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), F.greatest(n, F.lit(0)))


def char_at(text: Column, pos: Column) -> Column:
    return F.substr(text, pos, F.lit(1))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def string_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated exactly once per row.

    A filter on a plain derived column is pushed below it with the whole expression
    repeated for each use; generated columns stay where they are.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
