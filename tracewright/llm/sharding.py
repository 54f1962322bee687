"""Sharding along a Hilbert curve, with DataFrame functions only.

Source, language, length and document number are quantised to 2^BITS cells each, all by rank, so that every
cell holds about as many documents as another wherever values allow it; the cells' index on the Hilbert
curve orders the documents, and runs of equal length become shards, so that a shard's ranges in every dimension
stay narrow and files can be skipped by any of them. Cells are given by at most 2^BITS - 1 first values each, so
placing a row is a comparison and no join. The order is a range sort over the cluster; a row's number is its
place in its partition plus the rows of those before. Cuts by rank are within 1/10000 of all rows.

Law: rows. Shard sizes differ by one row at most, whatever the groups; equal texts of one source and
language lie side by side only as far as their other dimensions agree. Defined results: null text
counts as empty (size 1, crc 0); null source, language or doc_id sort first; repeated rows are
interchangeable (a random number parts them, so another deal of the input's partitions may number them otherwise); an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table, whole

SHARDS, BITS = 16, 4


def hilbert(df: DataFrame, axes: list[str], out: str, bits: int = BITS) -> DataFrame:
    """+ out: index on the Hilbert curve of the cells in `axes` (0 .. 2^bits - 1), by the transform of
    axes to transposed index (Skilling, 2004). One projection for each step, so that no expression is
    evaluated twice."""
    keep = [c for c in df.columns if c not in axes]
    x = [F.col(a).cast("int") for a in axes]
    names = [f"__x{i}" for i in range(len(axes))]
    df = df.select(*keep, *(c.alias(n) for c, n in zip(x, names, strict=True)))

    def step(df: DataFrame, new: dict[str, Column]) -> DataFrame:
        return df.select(*keep, *(new.get(n, F.col(n)).alias(n) for n in names))

    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for n in names:
            first, mine = F.col(names[0]), F.col(n)
            isset = mine.bitwiseAND(q) != 0
            swap = F.when(isset, 0).otherwise(first.bitwiseXOR(mine).bitwiseAND(low))
            new = {names[0]: F.when(isset, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))}
            if n != names[0]:
                new[n] = mine.bitwiseXOR(swap)
            df = step(df, new)
    for a, n in zip(names, names[1:], strict=False):
        df = step(df, {n: F.col(n).bitwiseXOR(F.col(a))})
    last = F.col(names[-1])
    turn = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(last.bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0) for b in range(bits - 1, 0, -1)], F.lit(0))
    df = df.withColumn("__turn", turn).select(*keep, *(F.col(n).bitwiseXOR(F.col("__turn")).alias(n) for n in names))
    digits = [F.shiftleft(F.shiftright(F.col(n), b).bitwiseAND(1).cast("long"), b * len(names) + len(names) - 1 - i) for i, n in enumerate(names) for b in range(bits)]
    return df.select(*keep, reduce(lambda a, b: a + b, digits).alias(out))


#: Ranks of numbers are cut within 1 / ACCURACY of all rows.
ACCURACY = 10_000


def number_cuts(rows: DataFrame, columns: list[str]) -> list[list]:
    """For each column of numbers, the first values of its cells but the first, by rank; none for no values."""
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    return [list(found or []) for found in rows.agg(*(F.percentile_approx(c, shares, ACCURACY) for c in columns)).first()]


def text_cuts(rows: DataFrame, column: str) -> list[str]:
    """The first values of the cells but the first of a column of strings, which may be as many as domains: its
    values are counted, range sorted, and ranked by the rows of their partition and of those before."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__c"))
    counts = counts.repartitionByRange(partitions(rows.sparkSession), column).withColumn("__part", F.spark_partition_id())
    counts = materialize(counts, "shard-values")
    parts = counts.groupBy("__part").agg(F.sum("__c").alias("__own"))
    earlier = F.coalesce(F.sum("__own").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", earlier.alias("__before"), F.sum("__own").over(Window.partitionBy()).alias("__total"))
    near = F.coalesce(F.sum("__c").over(Window.partitionBy("__part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("__near", near).join(F.broadcast(parts), "__part")  # a row for each range partition
    cell = F.expr(f"((__before + __near) * {1 << BITS}) div __total")
    first = placed.groupBy(cell.alias("__cell")).agg(F.min(column).alias("__first")).where("__cell > 0").orderBy("__cell")
    return [r["__first"] for r in first.collect()]  # at most 2^BITS - 1


def cell(rows: DataFrame, column: str, cuts: list) -> Column:
    """Cell of a value: how many of the cuts it has reached; null: 0. Over a literal array, as a long sum of
    conditions makes the optimizer slow."""
    if not cuts:
        return F.pmod(F.col("size"), F.lit(1)).cast("int")  # 0, but no literal that the steps of the curve would take in
    array = F.array(*map(F.lit, cuts)).cast(f"array<{rows.schema[column].dataType.simpleString()}>")
    return F.size(F.filter(array, lambda c: c <= F.col(column)))


def placed(docs: DataFrame, shards: int, carried: list[str]) -> DataFrame:
    """hilbert_shards() with the columns `carried` of docs, as structs in __row; they move once, in the range sort."""
    text = whole(F.col("text"))
    extra = [F.struct(*(F.col(f"`{c}`") for c in carried)).alias("__row")] if carried else []
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), *extra)
    rows = materialize(rows, "shard-rows")
    sizes, ids = number_cuts(rows, ["size", "doc_id"])
    cuts = {"source": text_cuts(rows, "source"), "lang": text_cuts(rows, "lang"), "size": sizes, "doc_id": ids}
    rows = rows.withColumns({f"__a{i}": cell(rows, c, found) for i, (c, found) in enumerate(cuts.items())})
    rows = hilbert(rows, ["__a0", "__a1", "__a2", "__a3"], "curve")
    order = ["curve", "doc_id", "text_crc32", "size"]
    # rows alike in all of these may be many; any order among them will do, so a random number parts them
    order.append("__any")
    rows = rows.withColumn("__any", F.rand(5))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(rows, "shard-sorted").withColumn("__part", F.shiftright("__at", 33))
    counts = rows.groupBy("__part").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__total"))
    rank = F.col("__before") + F.col("__at") - F.shiftleft(F.col("__part"), 33)
    rows = rows.join(F.broadcast(counts), "__part")  # a row for each range partition
    rows = rows.withColumn("__rank", rank).withColumn("shard", F.expr(f"(__rank * {shards}) div __total").cast("int"))
    slot = F.col("__rank") - F.expr(f"(cast(shard as bigint) * __total + {shards - 1}) div {shards}")
    return rows.select(*(["__row"] if carried else []), "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "lang", "source", "curve")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, lang, source, curve: every document's
    place. docs: doc_id, text, lang, source."""
    return placed(docs, shards, [])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents with all their columns (one named shard or slot gives way) into a folder for
    each shard. The range sort's partitions are runs of the curve, so each is a file or two, in curve
    order, of narrow ranges in every dimension; a shard of any size is written by many tasks."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = placed(docs, shards, columns)
    rows.select(*(F.col(f"__row.`{c}`").alias(c) for c in columns), "slot", "shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir):
    return hilbert_shards(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
