"""Isolation forests over window features, as tables: trained, saved, loaded and scored apart.

A tree grows from at most SUBSAMPLE rows, drawn by hash over all rows of its group, so a task sees no more
than the samples of LOT trees; a forest is a row of flat arrays a tree. Rows of a group are scored in chunks of about CHUNK, each beside a
copy of the group's trees, so a group with a third of all rows is many tasks.

Defined results: measures that are null or NaN count as 0; groups of under LEAST rows get no trees and no scores; rows
alike get the same score; a null group is a group."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.inverted import small
from tracewright.session import ship
from tracewright.sources.files import written

TREES, SUBSAMPLE, LEAST, CHUNK = 200, 256, 2, 50_000
#: Trees that a task grows one after the other.
LOT = 25
#: Rows drawn for a tree before the first SUBSAMPLE by hash are taken, as a share of SUBSAMPLE.
MARGIN = 1.3
FLAT = "tree int, size long, feature array<int>, cut array<double>, low array<int>, high array<int>, value array<double>"


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def with_size(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows + __n, the rows of the group."""
    names = {g: f"__of_{g}" for g in group}
    sizes = small(written(rows.groupBy(*group).agg(F.count("*").alias("__n")).withColumnsRenamed(names)))
    return rows.join(sizes, [rows[g].eqNullSafe(sizes[of]) for g, of in names.items()]).drop(*names.values())


def sampled(rows: DataFrame, group: list[str], measures: list[str], order: list[str], trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """group, tree, measures: at most `subsample` rows a tree. A row of a large group is drawn for one tree or none; one of
    a small group for as many as it takes to fill them; one of a group of few, for all. Draws hang on the order columns and
    measures alone, so that reruns agree."""
    number = rows.select(*group, F.xxhash64(*order, *measures).alias("__row"), *(F.coalesce(F.nanvl(F.col(m).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(m) for m in measures))
    spread = F.lit(MARGIN * subsample * trees)
    copies = F.when(F.col("__n") <= subsample, trees).otherwise(F.least(F.lit(trees), F.ceil(spread / F.col("__n")))).cast("int")
    chance = F.pmod(F.xxhash64("__row", F.lit("draw")), F.lit(1 << 40)) < F.lit(float(1 << 40)) * spread / F.col("__n")
    drawn = with_size(number, group).where((F.col("__n") >= LEAST) & chance)
    first = F.pmod(F.xxhash64("__row", F.lit("tree")), F.lit(trees)).cast("int")
    dealt = drawn.withColumn("__first", first).withColumn("__j", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("tree", F.pmod(F.col("__first") + F.col("__j"), F.lit(trees)).cast("int"))
    order = Window.partitionBy(*group, "tree").orderBy(F.xxhash64("__row", "tree"), "__row")
    return dealt.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= subsample).select(*group, "tree", *measures)


def grown(x: np.ndarray, seed: list[int]) -> dict[str, list]:
    """A tree of rows, as flat arrays: feature (-1 at a leaf), cut, numbers of the lower and higher child, and at a
    leaf the length of the path there. It grows level by level, all nodes of a level at once."""
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T[::-1])]
    deepest = int(np.ceil(np.log2(max(2, len(x)))))
    out: dict[str, list] = {"feature": [], "cut": [], "low": [], "high": [], "value": []}
    at = np.zeros(len(x), np.int64)  # a row's node among those of its level; rows of a node side by side
    depth = 0
    while len(x):
        nodes, start, count = np.unique(at, return_index=True, return_counts=True)
        least, most = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
        turn = np.where(most > least, rng.random(least.shape), -1.0)
        feature, row = turn.argmax(axis=1), np.arange(len(nodes))
        split = (turn.max(axis=1) >= 0) & (depth < deepest)
        low, high = least[row, feature], most[row, feature]
        cut = low + (high - low) * rng.random(len(nodes))
        cut = np.where(cut > low, cut, high)
        child = len(out["feature"]) + len(nodes) + 2 * np.cumsum(split) - 2
        out["feature"] += np.where(split, feature, -1).tolist()
        out["cut"] += np.where(split, cut, 0.0).tolist()
        out["low"] += np.where(split, child, -1).tolist()
        out["high"] += np.where(split, child + 1, -1).tolist()
        out["value"] += [0.0 if s else float(depth + path_norm(c)) for s, c in zip(split.tolist(), count.tolist(), strict=True)]
        of = np.repeat(row, count)
        goes = split[of]
        x, of = x[goes], of[goes]
        at = 2 * of + (x[np.arange(len(x)), feature[of]] >= cut[of])
        order = np.argsort(at, kind="stable")
        x, at, depth = x[order], at[order], depth + 1
    return out


def train(rows: DataFrame, group: list[str], measures: list[str], order: list[str], trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """A forest for each group: group, FLAT, written."""
    ship(rows.sparkSession)
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    flat = [c.split()[0] for c in FLAT.split(", ")]

    def grow(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        out, name = [], zlib.crc32("|".join(str(k) for k in key[:-1]).encode())
        for tree, mine in batch.groupby("tree"):
            x = np.nan_to_num(mine[measures].to_numpy(dtype=np.float64))
            out.append({**dict(zip(group, key, strict=False)), "tree": int(tree), "size": len(x), **grown(x, [int(tree), name])})
        return pd.DataFrame(out)[[*group, *flat]]

    lots = sampled(rows, group, measures, order, trees, subsample).withColumn("__lot", F.floor(F.col("tree") / LOT))
    return written(lots.groupBy(*group, "__lot").applyInPandas(grow, f"{kinds}, {FLAT}"))


def save(forest: DataFrame, path: str) -> None:
    forest.write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def depths(tree: dict, x: np.ndarray) -> np.ndarray:
    """Path length of each row in a tree of flat arrays."""
    feature, cut, low, high, value = (np.asarray(tree[n]) for n in ("feature", "cut", "low", "high", "value"))
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        here = at[rows]
        under = x[rows, feature[here]] < cut[here]
        at[rows] = np.where(under, low[here], high[here])
    return value[at]


def score(forest: DataFrame, rows: DataFrame, group: list[str], measures: list[str], order: list[str]) -> DataFrame:
    """group, order columns, score of every row whose group has trees: 2^(-mean of depth / norm), near 1 for outliers,
    about 0.5 for the rest."""
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    spec = ", ".join(f"`{c}` {kinds[c]}" for c in group + order) + ", score double"
    sized = with_size(rows.select(*group, *order, *measures), group).withColumn("__chunks", F.ceil(F.col("__n") / CHUNK).cast("int"))
    dealt = sized.withColumn("__chunk", F.pmod(F.xxhash64(*order, *measures), F.col("__chunks")).cast("int"))
    chunks = written(dealt.groupBy(*group).agg(F.max("__chunks").alias("__chunks"))).withColumnsRenamed({g: f"__of_{g}" for g in group})
    copies = forest.join(small(chunks), [forest[g].eqNullSafe(chunks[f"__of_{g}"]) for g in group])
    copies = copies.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))

    def scored_chunk(mine: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(trees):
            return mine.iloc[:0][group + order].assign(score=pd.Series(dtype=float))
        x = np.nan_to_num(mine[measures].to_numpy(dtype=np.float64))
        mean = np.mean([depths(t, x) / max(path_norm(t["size"]), 1e-9) for t in trees.sort_values("tree").to_dict("records")], axis=0)
        return mine[group + order].assign(score=2.0**-mean)

    return dealt.groupBy(*group, "__chunk").cogroup(copies.groupBy(*group, "__chunk")).applyInPandas(scored_chunk, spec)


def scored(rows: DataFrame, group: list[str], measures: list[str], order: list[str], trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """group, order columns, score: a forest trained on the rows and asked for them."""
    rows = written(rows.select(*group, *order, *measures))
    return score(train(rows, group, measures, order, trees, subsample), rows, group, measures, order)


def top(scores: DataFrame, k: int, ties: list[str]) -> DataFrame:
    """The k highest scores, highest first."""
    return scores.orderBy(F.col("score").desc(), *ties).limit(k)
