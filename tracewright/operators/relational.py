"""Joins, upserts, samples and counts over artifact and metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows of both, the last by `order` for each key."""
    return latest_by_key(old.unionByName(new), keys, order)


def latest_by_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def latest(rows: DataFrame, order: list[Column], where: Column | None = None) -> DataFrame:
    return (rows if where is None else rows.where(where)).orderBy(*order).limit(1)


def changed(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """What differs: key, change (ADDED, REMOVED, MODIFIED)."""
    a, b = old.select(key, F.col(digest).alias("__old")), new.select(key, F.col(digest).alias("__new"))
    both = a.withColumn("__in_old", F.lit(True)).join(b.withColumn("__in_new", F.lit(True)), key, "full_outer")
    kind = F.when(F.col("__in_old").isNull(), "ADDED").when(F.col("__in_new").isNull(), "REMOVED").when(~F.col("__old").eqNullSafe(F.col("__new")), "MODIFIED")
    return both.select(key, kind.alias("change")).where("change is not null")


def unseen(new: DataFrame, seen: DataFrame, key: str = "etag", order: list[str] | None = None) -> DataFrame:
    """New rows whose key isn't among the seen, one for each key: the first by `order` (null: by all other
    columns, in theirs). Rows without a key are left out."""
    order = order or [c for c in new.columns if c != key]
    fresh = new.where(F.col(key).isNotNull()).join(seen.select(key).distinct(), key, "left_anti")
    first = F.min_by(F.struct(*new.columns), F.struct(*order) if order else F.lit(0))
    return fresh.groupBy(F.col(key).alias("__key")).agg(first.alias("__row")).select("__row.*")


def first_lookup(rows: DataFrame, table: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """rows + value: the table's first for the key, "" where it has none."""
    w = Window.partitionBy(key).orderBy(*order)
    first = table.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select(key, value)
    return rows.join(first, key, "left").withColumn(value, F.coalesce(value, F.lit("")))


def stratified(events: DataFrame, cap: int) -> DataFrame:
    """All errors up to the cap, then for each service the first events within an equal share of what
    is left. The sample is the feature; rows go by ts, event_id."""
    from tracewright.operators.windows import is_error

    marked = events.withColumn("__error", is_error(F.col("severity")))
    errors = marked.where("__error").orderBy("ts", "event_id").limit(cap)
    counts = marked.agg(F.sum(F.col("__error").cast("long")).alias("errors"), F.count_distinct("service").alias("services")).first()
    quota = max(0, cap - min(cap, counts["errors"] or 0)) // max(1, counts["services"] or 1)
    w = Window.partitionBy("service").orderBy("ts", "event_id")
    rest = marked.where("not __error").withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= quota).drop("__rank")
    return errors.unionByName(rest).drop("__error")


def dominant(rows: DataFrame, key: str, value: str, order: str, unknown: str = "UNKNOWN") -> DataFrame:
    """For each key the first value that is known, else the first."""
    rank = F.struct((F.col(value) == unknown).alias("u"), F.col(order).alias("o"))
    return rows.groupBy(key).agg(F.min_by(value, rank).alias(value))


def counts_of(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """+ sequential number from 1 in each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def artifact_filter(rows: DataFrame, **terms) -> DataFrame:
    """Equality on every given column; null matches nothing."""
    for name, value in terms.items():
        rows = rows.where(F.col(name) == value)
    return rows


def search(rows: DataFrame, columns: list[str], text: str, most: int = 50, order: list[str] | None = None) -> DataFrame:
    """Rows that hold the text in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return rows.where(hit).orderBy(*(order or columns)).limit(most)
