"""Log templates by similarity of masked tokens (Drain).

Messages that share their first DEPTH masked tokens form a bucket; clusters never cross buckets. Equal
masked messages are counted first, so each distinct one comes once, with its first place and its count; a
hot template is one row. A hot bucket of distinct messages is settled in rounds over many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators.inverted import small
from tracewright.session import ship
from tracewright.sources.files import written

SIMILAR, DEPTH = 0.5, 4
#: Distinct messages of a bucket that are settled one by one in a round, and later ones that a task asks for.
HEAD, CHUNK = 2000, 20_000
WILDCARD = "<*>"


def similarity(template: list[str], tokens: list[str]) -> float:
    """Share of places that agree; a wildcard or a missing place agrees."""
    longest = max(len(template), len(tokens))
    if not template or not tokens:
        return float(longest == 0)
    same = sum(a == b or WILDCARD in (a, b) for a, b in zip(template, tokens, strict=False))
    return (same + longest - min(len(template), len(tokens))) / longest


def generalized(template: list[str], tokens: list[str]) -> list[str]:
    """The template with a wildcard wherever the tokens differ."""
    longest = max(len(template), len(tokens))
    at = lambda x, i: x[i] if i < len(x) else None
    return [template[i] if i < len(template) and at(tokens, i) == template[i] else WILDCARD for i in range(longest)]


class Leaders:
    """Templates in order of arrival, asked for many messages at once."""

    def __init__(self, templates: list[list[str]]):
        self.number: dict[str, int] = {WILDCARD: 1}
        self.templates = [self.coded(t) for t in templates]

    def coded(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.number.setdefault(t, len(self.number) + 1) for t in tokens], np.int64)

    def first(self, messages: list[list[str]], similar: float) -> np.ndarray:
        """Number of the first template that is similar enough, -1 where none is."""
        coded = [self.coded(m) for m in messages]
        length = np.array([len(c) for c in coded])
        table = np.zeros((len(coded), max(1, length.max(initial=0))), np.int64)
        for row, c in zip(table, coded, strict=True):
            row[: len(c)] = c
        out, left = np.full(len(coded), -1), np.arange(len(coded))
        for k, t in enumerate(self.templates):
            mine, n = table[left, : len(t)], length[left]
            here = t[: mine.shape[1]]
            same = (((mine == here) | (mine == 1) | (here == 1)) & (mine > 0)).sum(axis=1)
            longest, shortest = np.maximum(n, len(t)), np.minimum(n, len(t))
            share = np.where(shortest > 0, (same + longest - shortest) / np.maximum(longest, 1), longest == 0)
            hit = share >= similar
            out[left[hit]] = k
            left = left[~hit]
            if not len(left):
                break
        return out


def in_turn(batch: pd.DataFrame, similar: float, generalize: bool) -> list[list]:
    """[template now, first message, its place, count] of each cluster, by first fit in order of place."""
    found: list[list] = []
    for tokens, place, n in batch.sort_values("place")[["tokens", "place", "n"]].itertuples(index=False):
        tokens = list(tokens)
        hit = next((c for c in found if similarity(c[0], tokens) >= similar), None)
        if hit is None:
            found.append([tokens, tokens, place, n])
        else:
            hit[3] += n
            if generalize:
                hit[0] = generalized(hit[0], tokens)
    return found


def clusters(messages: DataFrame, similar: float = SIMILAR, depth: int = DEPTH, generalize: bool = False) -> DataFrame:
    """messages: message, seq (order of arrival) -> cluster_id (by content), template, match_count.

    A message joins the first cluster of its bucket, in order of arrival, that is similar enough;
    templates stay as first seen unless generalize. Blank messages have none.

    Rounds keep a hot bucket out of one task: the first HEAD messages of each bucket are settled in turn;
    what they found is asked, in chunks of about CHUNK, for the bucket's later messages; those that fit none go to the
    next round. No earlier cluster fits a message that is left, so this is the rule of one by one. If
    templates change as messages join (generalize), their order decides each step, and a bucket is one task."""
    ship(messages.sparkSession)
    rows = messages.select(text.masked_tokens(F.col("message")).alias("tokens"), "seq").where("tokens is not null")
    rows = rows.groupBy("tokens").agg(F.min("seq").alias("seq"), F.count("*").alias("n")).withColumn("bucket", F.to_json(F.slice("tokens", 1, depth))).withColumn("key", F.to_json("tokens"))

    def settle(batch: pd.DataFrame) -> pd.DataFrame:
        found = in_turn(batch, similar, generalize)
        return pd.DataFrame({"bucket": batch["bucket"].iloc[0], "place": [c[2] for c in found], "first": [c[1] for c in found], "template": [c[0] for c in found], "n": [c[3] for c in found]})

    spec = "bucket string, place int, first array<string>, template array<string>, n long"
    if generalize:
        found = placed(rows).groupBy("bucket").applyInPandas(settle, spec)
    else:
        found = in_rounds(written(rows), settle, spec, similar)
    named = found.groupBy("bucket", "first", "template").agg(F.sum("n").alias("match_count"))
    return named.select(F.substring(F.sha2(F.array_join("first", " "), 256), 1, 16).alias("cluster_id"), F.array_join("template", " ").alias("template"), "match_count")


def placed(rows: DataFrame) -> DataFrame:
    """rows without seq (of any type that has an order), with their place in the bucket."""
    return rows.select("bucket", "tokens", "n", "key", F.row_number().over(Window.partitionBy("bucket").orderBy("seq", "key")).alias("place"))


def in_rounds(left: DataFrame, settle, spec: str, similar: float) -> DataFrame:
    def ask(mine: pd.DataFrame, led: pd.DataFrame) -> pd.DataFrame:
        led = led.sort_values("place")
        at = Leaders([list(t) for t in led["first"]]).first([list(t) for t in mine["tokens"]], similar) if len(mine) else []
        return mine[["bucket", "key", "n"]].assign(first=[led["first"].iloc[k] if k >= 0 else None for k in at])

    at, found = F.struct("seq", "key"), None
    while True:
        head = placed(left).where(F.col("place") <= HEAD)
        led = written(head.groupBy("bucket").applyInPandas(settle, spec))
        found = led if found is None else found.unionByName(led)
        hot = small(written(left.groupBy("bucket").agg(F.count("*").alias("__size")).where(F.col("__size") > HEAD)))
        if hot.isEmpty():
            return found
        last = head.join(hot, "bucket").where(F.col("place") == HEAD).select("bucket", "key", "__size")
        ends = small(written(left.join(small(written(last)), ["bucket", "key"]).select("bucket", "__size", at.alias("__end"))))
        later = left.join(ends, "bucket").where(at > F.col("__end"))
        chunks = F.ceil(F.col("__size") / CHUNK).cast("int")
        later = written(later.withColumn("__chunk", F.pmod(F.xxhash64("key"), chunks).cast("int")).drop("__size", "__end"))
        asked = led.join(hot, "bucket").withColumn("__chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("__size")
        told = written(later.drop("seq").groupBy("bucket", "__chunk").cogroup(asked.groupBy("bucket", "__chunk")).applyInPandas(ask, "bucket string, key string, n long, first array<string>"))
        found = found.unionByName(told.where("first is not null").select("bucket", F.lit(0).alias("place"), "first", F.col("first").alias("template"), "n"))
        left = written(later.drop("__chunk").join(told.where("first is null").select("bucket", "key"), ["bucket", "key"], "left_semi"))


def stream_rows(rows: Iterator) -> list[list[str]]:
    return [str(r).split() for r in rows]
