"""Vector expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    norm = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def argmax(a: Column) -> Column:
    """Place of the greatest component from 0, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def clamped_class(a: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.least(argmax(a), F.lit(len(names) - 1)) + 1)


def merged(left: Column, right: Column) -> Column:
    """Maps put together; of equal keys the right one's value stays (session: LAST_WIN)."""
    return F.map_concat(left, right)


def one_hot(hot: Column, rest: list[Column], width: int = 32) -> Column:
    """A vector with 1 at `hot`, then `rest` from place 10 on, zeros elsewhere."""
    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == hot).cast("float")), F.array(*(r.cast("float") for r in rest)), F.array_repeat(F.lit(0.0).cast("float"), width - 10 - len(rest)))
