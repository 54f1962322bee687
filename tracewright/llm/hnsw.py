"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards by a hash of their id, so that a hot vector spreads over all shards and a
shard's size is bounded. Each shard's task collapses equal vectors, builds its graph (Malkov and
Yashunin, 2018) and returns it as flat arrays: one row for each shard, written to the shared folder.
Queries go to every shard in blocks; a shard's hits are scored by the cosine in double precision on
the original vectors; results of the shards are merged by rank.

Defined results: vectors that are null, empty, zero, of another length than most of the shard's, or
hold null or non-finite components take no part; repeated vec_ids count once for each different vector;
a query gets fewer rows if there are fewer candidates; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import ship

from .common import materialize, table

NEIGHBOURS, BUILD_BREADTH, SEARCH_BREADTH = 16, 80, 160
#: Vectors to a shard and queries to a block, about.
SHARD, QUERIES = 6000, 1000
INDEX = "shard int, ids binary, starts binary, members binary, vectors binary, width int, entry int, levels int, nodes binary, ends binary, links binary"


class Graph:
    """Flat arrays: for each level, the nodes on it and NEIGHBOURS (level 0: twice that) links each,
    -1 where there are fewer."""

    def __init__(self, unit: np.ndarray):
        self.unit, self.entry = unit, 0
        self.links: list[np.ndarray] = []
        self.slot: list[np.ndarray | None] = []  # row of a node in its level's links; level 0: itself

    def near(self, level: int, node: int) -> np.ndarray:
        row = node if level == 0 else self.slot[level][node]
        n = self.links[level][row]
        return n[n >= 0]

    def search(self, q: np.ndarray, starts: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The nearest found by a best-first walk over one level, as (cosine, node)."""
        seen = np.zeros(len(self.unit), bool)
        seen[[n for _, n in starts]] = True
        todo = [(-s, n) for s, n in starts]
        heapq.heapify(todo)
        best = list(starts)
        heapq.heapify(best)
        while todo:
            s, node = heapq.heappop(todo)
            if len(best) >= breadth and -s < best[0][0]:
                break
            new = self.near(level, node)
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            for s, n in zip((self.unit[new] @ q).tolist(), new.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (s, n))
                    heapq.heappush(todo, (-s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                    heapq.heappush(todo, (-s, n))
        return best

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        """Greedy walk from the top level down to above `to`."""
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for level in range(len(self.links) - 1, to, -1):
            at = [max(self.search(q, at, 1, level))]
        return at

    def chosen(self, node_vector: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in many directions: one that is nearer to a chosen one than to the node is left
        for later; those left fill free places."""
        found = sorted(found, key=lambda x: (-x[0], x[1]))
        ids = np.array([n for _, n in found])
        if len(ids) <= most // 2:
            return ids.tolist()
        among = self.unit[ids] @ self.unit[ids].T
        nearest = np.full(len(ids), -np.inf, np.float32)
        out, left = [], []
        for i, (s, n) in enumerate(found):
            if nearest[i] <= s and len(out) < most:
                out.append(n)
                np.maximum(nearest, among[i], out=nearest)
            else:
                left.append(n)
        return out + left[: max(0, most * 3 // 4 - len(out))]

    def build(self, seed: int = 11) -> Graph:
        n = len(self.unit)
        tall = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(NEIGHBOURS)).astype(int)
        for level in range(int(tall.max()) + 1):
            there = np.flatnonzero(tall >= level)
            slot = None
            if level:
                slot = np.full(n, -1, np.int32)
                slot[there] = np.arange(len(there))
            self.slot.append(slot)
            self.links.append(np.full((len(there), NEIGHBOURS * (1 if level else 2)), -1, np.int32))
        held, self.links, top = self.links, [], -1
        for node in range(n):
            q, mine = self.unit[node], int(tall[node])
            if top >= 0:
                at = self.descend(q, min(mine, top))
                for level in range(min(mine, top), -1, -1):
                    at = self.search(q, at, BUILD_BREADTH, level)
                    self.connect(level, node, q, at)
            if mine > top:
                self.links, self.entry, top = held[: mine + 1], node, mine
        self.links = held
        return self

    def connect(self, level: int, node: int, q: np.ndarray, found: list[tuple[float, int]]) -> None:
        links, slot = self.links[level], self.slot[level]
        mine = self.chosen(q, found, NEIGHBOURS)
        links[node if slot is None else slot[node], : len(mine)] = mine
        for other in mine:
            row = links[other if slot is None else slot[other]]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
                continue
            v = self.unit[other]
            all_of = np.append(row, node)
            keep = self.chosen(v, list(zip((self.unit[all_of] @ v).tolist(), all_of.tolist(), strict=True)), len(row))
            row[:] = -1
            row[: len(keep)] = keep


def usable(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors): of the most common length."""
    size = pd.Series([len(v) if v is not None else 0 for v in vectors])
    lengths = size[size > 0]
    if lengths.empty:
        return np.zeros(0, np.int64), np.zeros((0, 1), np.float64)
    at = np.flatnonzero(size == lengths.mode().iloc[0])
    x = np.array([[np.nan if c is None else c for c in vectors[i]] for i in at], dtype=np.float64)
    good = np.isfinite(x).all(axis=1) & (np.abs(x) > 0).any(axis=1)
    return at[good], x[good]


def build_shard(batch: pd.DataFrame) -> pd.DataFrame:
    at, x = usable(batch["embedding"].tolist())
    if not len(at):
        return pd.DataFrame(columns=[c.split()[0] for c in INDEX.split(", ")])
    ids = batch["vec_id"].to_numpy()[at].astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    distinct, inverse = np.unique(x, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    members = np.argsort(inverse, kind="stable")  # by vector, then id
    starts = np.searchsorted(inverse[members], np.arange(len(distinct) + 1))
    shuffle = np.random.default_rng(5).permutation(len(distinct))  # inserting in sorted order makes poor graphs
    place = np.empty_like(shuffle)
    place[shuffle] = np.arange(len(distinct))
    distinct = distinct[shuffle]
    starts_of = np.stack([starts[:-1], starts[1:]], axis=1)[shuffle]
    scaled = distinct / np.abs(distinct).max(axis=1)[:, None]
    graph = Graph((scaled / np.linalg.norm(scaled, axis=1)[:, None]).astype(np.float32)).build()
    nodes = np.concatenate([np.zeros(0, np.int32)] + [np.flatnonzero(s >= 0)[np.argsort(s[s >= 0])].astype(np.int32) for s in graph.slot[1:]])
    ends = np.cumsum([len(x) for x in graph.links], dtype=np.int64)
    return pd.DataFrame([{
        "shard": int(batch["shard"].iloc[0]), "ids": ids[members].tobytes(), "starts": starts_of.astype(np.int64).tobytes(), "members": b"", "vectors": distinct.tobytes(), "width": distinct.shape[1],
        "entry": int(graph.entry), "levels": len(graph.links), "nodes": nodes.tobytes(), "ends": ends.tobytes(), "links": b"".join(x.tobytes() for x in graph.links),
    }])


class Index:
    """A shard's graph, read back from its flat arrays."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.starts = np.frombuffer(row["starts"], np.int64).reshape(-1, 2)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["width"])
        scaled = self.x / np.abs(self.x).max(axis=1)[:, None]
        self.norms = np.linalg.norm(scaled, axis=1)
        self.scaled = scaled
        self.graph = Graph((scaled / self.norms[:, None]).astype(np.float32))
        self.graph.entry = row["entry"]
        nodes, ends = np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["ends"], np.int64)
        links, at, up = np.frombuffer(row["links"], np.int32), 0, 0
        for level in range(row["levels"]):
            count = int(ends[level] - (ends[level - 1] if level else 0))
            width = NEIGHBOURS * (1 if level else 2)
            self.graph.links.append(links[at : at + count * width].reshape(count, width))
            at += count * width
            slot = None
            if level:
                slot = np.full(len(self.x), -1, np.int32)
                slot[nodes[up : up + count]] = np.arange(count)
                up += count
            self.graph.slot.append(slot)

    def nearest(self, vec_id: int, q: np.ndarray, k: int, breadth: int = SEARCH_BREADTH) -> list[tuple[int, float]]:
        """At most k (vec_id, cosine), without vec_id itself, nearest first, then smaller ids."""
        if len(q) != self.x.shape[1]:
            return []
        q = q / np.abs(q).max()
        q = q / np.linalg.norm(q)
        unit = q.astype(np.float32)
        found = self.graph.search(unit, self.graph.descend(unit, 0), breadth, 0)
        nodes = np.array([n for _, n in found])
        cos = (self.scaled[nodes] @ q) / self.norms[nodes]
        out = []
        for node, s in zip(nodes.tolist(), cos.tolist(), strict=True):
            start, end = self.starts[node]
            mine = self.ids[start : min(end, start + k + 1)]  # a vector's ids rise
            out += [(-min(1.0, max(-1.0, s)), int(i)) for i in mine if i != vec_id]
        out.sort()
        return [(i, -s) for s, i in out[:k]]


def search_shard(key, index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(index) and len(queries):
        shard = Index(index.iloc[0].to_dict())
        at, x = usable(queries["embedding"].tolist())
        for vec_id, q in zip(queries["vec_id"].to_numpy()[at].tolist(), x, strict=True):
            out += [(int(vec_id), i, s) for i, s in shard.nearest(int(vec_id), q, k)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def build_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row of flat arrays for each shard of about `shard` vectors."""
    ship(vectors.sparkSession)
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return materialize(rows.groupBy("shard").applyInPandas(build_shard, INDEX), "hnsw")


def nearest(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (vec_id, embedding) in the index."""
    count = queries.count()
    blocks = max(1, -(-count // QUERIES))
    last = index.agg(F.max("shard")).first()[0]
    asked = queries.where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last)))) if last is not None else asked.withColumn("shard", F.lit(0)).limit(0)
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = spread.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(lambda key, a, b: search_shard(key, a, b, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(build_index(vectors), vectors.where("vec_id % 50 = 0"), 5)
