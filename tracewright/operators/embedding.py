"""Deterministic hashing embedder, the default where no model is given, and its use on snapshots.

A model is any function from a column of texts to a column of vectors (a pandas UDF fits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text, vectors

WIDTH = 64


def hashed(body: Column, width: int = WIDTH) -> Column:
    """Signed term counts by hash, scaled to length 1; the zero vector for a text without terms."""
    terms = F.transform(text.analyzed(body), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(width)).alias("i"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.array(terms), lambda ts: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.filter(ts, lambda t: t["i"] == i), F.lit(0.0), lambda a, t: a + t["s"])))[0]
    unit = lambda v: F.transform(v, lambda x: (x / F.greatest(F.sqrt(vectors.squared_norm(v)), F.lit(1e-12))).cast("float"))
    return F.transform(F.array(raw), unit)[0]


def embedded(rows: DataFrame, column: str = "content", model=hashed) -> DataFrame:
    return rows.withColumn("embedding", model(F.col(column)))
