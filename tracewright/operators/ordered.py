"""Order inside a key whose rows may be a third of all: range partitions and what they hand on.

Rows are cut into range partitions by key and order, so a hot key lies over many of them and none holds more than
about its share. Sums and last values of the partitions, a row a key and partition, carry over to the next ones; nothing
else meets. So running sums, predecessors and quantiles of a key are exact without one task seeing all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.inverted import small
from tracewright.sources.files import written

PART = "__part"


def parted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows in range partitions by keys and order, written, with the partition's number. Partitions are cut at keys
    and order together, so rows that agree in both stay together."""
    return written(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))


def carried(rows: DataFrame, borders: DataFrame, keys: list[str]) -> DataFrame:
    """rows + the columns of borders (a row a key and partition; null keys are keys)."""
    names = {k: f"__of_{k}" for k in (*keys, PART)}
    of = small(written(borders.withColumnsRenamed(names)))
    same = [rows[k].eqNullSafe(of[n]) for k, n in names.items()]
    return rows.join(of, same, "left").drop(*names.values())


def inside(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, PART).orderBy(*order)


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """parted rows + the sum of value over the key's rows up to this one."""
    own = rows.withColumn("__v", value)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    borders = own.groupBy(*keys, PART).agg(F.sum("__v").alias("__sum"))
    offsets = borders.select(*keys, PART, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    near = F.sum("__v").over(inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return carried(own.withColumn("__near", near), offsets, keys).withColumn(name, F.col("__offset") + F.col("__near")).drop("__v", "__near", "__offset")


def previous(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """parted rows + column of the key's row before this one (null for its first)."""
    w = inside(keys, order)
    last = rows.groupBy(*keys, PART).agg(F.max(F.struct(*order, column)).alias("__row"))
    handed = last.select(*keys, PART, F.lag(F.col("__row")[column]).over(Window.partitionBy(*keys).orderBy(PART)).alias("__handed"))
    own = rows.withColumn("__lag", F.lag(column).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    return carried(own, handed, keys).withColumn(name, F.when(F.col("__first"), F.col("__handed")).otherwise(F.col("__lag"))).drop("__lag", "__first", "__handed")


def quantiles(rows: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, the quantile of each share by linear interpolation between the two values next to it;
    null values don't count. Values are counted first, so that only distinct ones are ordered; then the two values are
    taken from the partitions that hold their ranks."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__x")).agg(F.count("*").alias("__n"))
    parts = parted(counts, keys, ["__x"])
    totals = small(written(parts.groupBy(*keys).agg(F.sum("__n").alias("__total")).withColumnsRenamed({k: f"__of_{k}" for k in keys})))
    ranked = running(parts, keys, ["__x"], F.col("__n"), "__upto")
    ranked = ranked.join(totals, [ranked[k].eqNullSafe(totals[f"__of_{k}"]) for k in keys])
    out, before = [], F.col("__upto") - F.col("__n")
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("__total") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda rank: (before <= rank) & (rank < F.col("__upto"))
        a, b = F.max(F.when(holds(low), F.col("__x").cast("double"))), F.max(F.when(holds(high), F.col("__x").cast("double")))
        out.append((a + (b - a) * F.max(at - low)).alias(name))
    return ranked.groupBy(*keys).agg(*out)
