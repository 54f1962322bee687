"""Inverted file of vectors: coarse cells by k-means over Spark, blocks by cell, queries routed to few cells.

Cells come from spherical k-means over at most SAMPLED rows a cell, drawn by hash; each round adds up
unit vectors where they lie, so the driver sees only the cells' sums. Every row is indexed. A cell's vectors are dealt to
blocks of about BLOCK, so a cell with a third of all rows is many blocks; a query meets the blocks of the cells it
probes by an equi-join, in groups of ASKED queries, and a task multiplies one group with one block.

Vectors that are null, zero, not finite or of another length than most take no part; probing every cell is exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import vectors
from tracewright.operators.inverted import small
from tracewright.session import ship
from tracewright.sources.files import written

SAMPLED, ROUNDS, BLOCK, ASKED = 256, 8, 1024, 256
MOST_CELLS = 1 << 15


@dataclass
class Cells:
    centres: np.ndarray
    #: cell, ids, flat (their unit vectors, one after the other).
    blocks: DataFrame


def usable(rows: DataFrame, length: int | None = None) -> tuple[DataFrame, int]:
    """(doc_id, unit vector of doubles) of rows(doc_id, embedding) that take part; their length."""
    wide = rows.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    norm = F.sqrt(vectors.squared_norm(F.col("embedding")))
    sound = wide.where(F.size("embedding") > 0).where(F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    sound = sound.withColumn("__n", norm).where((F.col("__n") > 0) & (F.col("__n") < float("inf")))
    if length is None:
        most = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        length = most["d"] if most else 0
    return sound.where(F.size("embedding") == length).select("doc_id", F.expr("transform(embedding, v -> v / __n)").alias("unit")), length


def matrix(column, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, max(1, length))


def nearest_cells(unit: np.ndarray, centres: np.ndarray, most: int = 1) -> np.ndarray:
    """The cells of greatest cosine, best first, ties to the lower number."""
    out = [np.argsort(-(unit[i : i + 1024] @ centres.T), axis=1, kind="stable")[:, :most] for i in range(0, len(unit), 1024)]
    return np.concatenate(out) if out else np.zeros((0, most), np.int64)


def train(rows: DataFrame, length: int, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of rows(doc_id, unit): from the first vectors by hash, moved `rounds` times; empty cells stay."""
    first = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cells).collect()
    centres = np.array([r["unit"] for r in first], np.float64).reshape(len(first), length)

    def work(batches, centres):
        import pyarrow as pa

        sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = matrix(batch.column("unit"), length)
            at = nearest_cells(x, centres)[:, 0]
            np.add.at(sums, at, x)
            np.add.at(counts, at, 1)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(list(sums[full]), pa.list_(pa.float64()))], ["cell", "sums"])

    for _ in range(rounds):
        parts = rows.select("unit").mapInArrow(lambda b, c=centres: work(b, c), "cell int, sums array<double>")
        moved = parts.select("cell", F.posexplode("sums").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x")).collect()
        total = np.zeros_like(centres)
        for r in moved:
            total[r["cell"], r["i"]] = r["x"]
        norm = np.linalg.norm(total, axis=1)
        centres = np.where(norm[:, None] > 1e-12, total / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def build(vecs: DataFrame, cells: int | None = None, rounds: int = ROUNDS) -> Cells:
    """An index over vecs(doc_id, embedding), of about the square root of their number of cells if none is given."""
    ship(vecs.sparkSession)
    rows, length = usable(vecs)
    rows = written(rows)
    n = rows.count()
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    share = cells * SAMPLED / max(1, n)
    sample = rows if share >= 1 else written(rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))))
    centres = train(sample, length, cells, rounds) if n else np.zeros((1, 1))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            at = nearest_cells(matrix(batch.column("unit"), length), centres)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "cell"])

    dealt = written(rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, unit array<double>, cell int"))
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("__blocks"))  # a row a cell
    parts = dealt.join(F.broadcast(sizes), "cell").withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.col("__blocks")))
    packed = parts.groupBy("cell", "__part").agg(F.collect_list("doc_id").alias("ids"), F.flatten(F.collect_list("unit")).alias("flat")).drop("__part")
    return Cells(centres, written(packed))


def nearest(index: Cells, queries: DataFrame, k: int, probes: int | None = None, floor: float = 0.5) -> DataFrame:
    """query_id, doc_id, score (cosine, six digits) of at most k rows a query and block: the candidates for
    a top k over queries(query_id, embedding). Without `probes` every cell is asked."""
    ship(queries.sparkSession)
    width = index.centres.shape[1]
    most = min(probes or len(index.centres), len(index.centres))
    asked, _ = usable(queries.select(F.col("query_id").alias("doc_id"), "embedding"), width)
    centres = index.centres
    kind = queries.schema["query_id"].dataType.simpleString()

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            near = nearest_cells(matrix(batch.column("unit"), width), centres, most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    routed = asked.mapInArrow(route, f"doc_id {kind}, unit array<double>, cells array<int>")
    groups = max(1, -(-queries.count() // ASKED))
    each = routed.select(F.explode("cells").alias("cell"), F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("__group"), F.col("doc_id").alias("query_id"), "unit")
    packed = each.groupBy("cell", "__group").agg(F.collect_list("query_id").alias("query_ids"), F.flatten(F.collect_list("unit")).alias("asked")).drop("__group")
    met = index.blocks.join(small(written(packed), 2000), "cell").select("ids", "flat", "query_ids", "asked")
    ids = index.blocks.schema["ids"].dataType.elementType.simpleString()

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                of, asking = batch.column("ids")[i].values, batch.column("query_ids")[i].values
                x = batch.column("flat")[i].values.to_numpy().reshape(-1, width)
                q = batch.column("asked")[i].values.to_numpy().reshape(-1, width)
                score = np.round(q @ x.T, 6)
                row, at = np.nonzero(score >= floor)
                if len(of) > k:  # of each query the k best and what ties with the last of them
                    least = np.partition(score, len(of) - k, axis=1)[:, len(of) - k]
                    keep = score[row, at] >= least[row]
                    row, at = row[keep], at[keep]
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(row)), of.take(pa.array(at)), pa.array(score[row, at])], ["query_id", "doc_id", "score"])

    return met.mapInArrow(work, f"query_id {kind}, doc_id {ids}, score double")
