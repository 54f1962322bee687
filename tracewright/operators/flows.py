"""Flow candidates from call chains and topics: steps, overlap, confidence, complexity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import retrieval
from tracewright.operators.inverted import small
from tracewright.sources.files import written

OVERLAP = 0.7


def http_candidates(chains: DataFrame) -> DataFrame:
    """chains(path of services) of two and more -> flow_id, services, n_steps."""
    services = F.transform("path", lambda s: s.cast("string"))
    return chains.where(F.size("path") >= 2).select(F.concat(F.lit("http-"), F.substring(F.sha2(F.array_join(services, ">"), 256), 1, 16)).alias("flow_id"), services.alias("services"), F.size("path").alias("n_steps"), F.lit(False).alias("is_async"))


def topic_candidates(topics: DataFrame) -> DataFrame:
    """One flow for each topic with both sides: producers, then consumers."""
    both = topics.where((F.size("producers") > 0) & (F.size("consumers") > 0))
    return both.select(F.concat(F.lit("kafka-"), F.col("topic")).alias("flow_id"), F.concat("producers", "consumers").alias("services"), (F.size("producers") + F.size("consumers")).alias("n_steps"), F.lit(True).alias("is_async"))


def steps(flows: DataFrame) -> DataFrame:
    """flow_id, step, service, kind: an endpoint first, then client calls."""
    rows = flows.select("flow_id", "is_async", F.posexplode("services").alias("__p", "service"))
    kind = F.when(F.col("is_async"), F.when(F.col("__p") == 0, "KAFKA_PRODUCE").otherwise("KAFKA_CONSUME")).when(F.col("__p") == 0, "HTTP_ENDPOINT").otherwise("HTTP_CLIENT_CALL")
    return rows.select("flow_id", (F.col("__p") + 1).alias("step"), "service", kind.alias("kind"))


def evidence_query(flows: DataFrame) -> DataFrame:
    """One query for each flow, of all its services, and how many documents it asks for."""
    return flows.select(F.col("flow_id").alias("query_id"), F.array_join(F.array_distinct("services"), " ").alias("query"), F.greatest(F.lit(10), 3 * F.col("n_steps")).alias("top_k"))


def evidence(asked: DataFrame, lists: Callable[[DataFrame, int], DataFrame], words: DataFrame) -> DataFrame:
    """(flow_id, kind, rank, doc_id): what a retrieval finds for each flow's query (evidence_query), as CODE where one of
    the code's lists (1, 3) holds it, else as LOG. lists(queries, k): ranked lists for k results; flows that ask for
    equally many are asked together, so there is a retrieval for each length of chain."""
    found = None
    for k in sorted(r["top_k"] for r in asked.select("top_k").distinct().collect()):  # as many as lengths of chains
        mine = asked.where(F.col("top_k") == k)
        ranked = lists(mine, k)
        code = ranked.where(F.col("list_no").isin(1, 3)).select("query_id", "doc_id", F.lit("CODE").alias("kind")).distinct()
        part = retrieval.retrieved(ranked, words, mine, k).join(code, ["query_id", "doc_id"], "left")
        part = part.select(F.col("query_id").alias("flow_id"), F.coalesce("kind", F.lit("LOG")).alias("kind"), "rank", "doc_id")
        found = part if found is None else found.unionByName(part)
    return found


def evidence_counts(found: DataFrame) -> DataFrame:
    """(flow_id, snippets, logs): what confidence counts of the evidence."""
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return found.groupBy("flow_id").agg(of("CODE").alias("snippets"), of("LOG").alias("logs"))


def confidence(snippets: Column, logs: Column, sequences: Column, paths: Column) -> Column:
    parts = F.least(F.lit(0.4), snippets * 0.1) + F.least(F.lit(0.2), logs * 0.05) + F.least(F.lit(0.3), sequences * 0.15) + F.when(paths, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), parts), 6)


def complexity(services: Column, is_async: Column, is_reactive: Column) -> Column:
    n = F.size(F.array_distinct(services))
    return F.when((n >= 5) | (is_reactive & is_async), "VERY_HIGH").when((n >= 3) | is_async, "HIGH").when(n >= 2, "MEDIUM").otherwise("LOW")


def overlapping_pairs(flows: DataFrame, ratio: float = OVERLAP) -> DataFrame:
    """(a, b, shared) of flows a < b that share at least the ratio of the smaller one's services.

    A flow's services are put in order from the rarest. Whoever shares ratio * n of the smaller flow's n services shares
    one of its first n - ceil(ratio * n) + 1, so the smaller flow asks by those alone, and a service of nearly
    all flows, last in order, makes no pairs of its own. A pair counts where its first such service is met."""
    return candidate_pairs(flows, ratio).where(F.col("shared") >= ratio * F.col("na")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")


def candidate_pairs(flows: DataFrame, ratio: float = OVERLAP) -> DataFrame:
    """(a, na, b, shared): each pair that meets on a prefix, once; a has no more services than b."""
    at = flows.select("flow_id", F.explode(F.array_distinct("services")).alias("service"))
    often = small(written(at.groupBy("service").agg(F.count("*").alias("often"))))
    order = F.transform(F.array_sort(F.collect_list(F.struct("often", "service"))), lambda x: x["service"])
    rows = written(at.join(often, "service").groupBy("flow_id").agg(order.alias("s")).withColumn("n", F.size("s")))
    first = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * ratio - 1e-9) + 1).cast("int"))
    asks = rows.select(F.col("flow_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), first.alias("pa")).withColumn("service", F.explode("pa"))
    holds = rows.select(F.col("flow_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.explode("s").alias("service"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = asks.join(holds, "service").where(smaller & (F.col("a") != F.col("b"))).where(F.get(F.array_intersect("pa", "sb"), 0) == F.col("service"))
    return pairs.select("a", "na", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"))


def merged(flows: DataFrame, ratio: float = OVERLAP) -> DataFrame:
    """Greedy: in order of flow_id a flow stays unless it overlaps one that stayed; without services it
    goes. In rounds: of the undecided, those without an undecided smaller neighbour stay and their
    neighbours go, which is the same as one by one; rounds follow the longest chain of neighbours."""
    pairs = written(overlapping_pairs(flows, ratio).select("a", "b"))
    open_ = written(flows.where(F.size("services") > 0).select("flow_id").distinct())
    stayed = []
    while not open_.isEmpty():
        first = written(open_.join(pairs.select(F.col("b").alias("flow_id")), "flow_id", "left_anti"))
        gone = pairs.join(first.select(F.col("flow_id").alias("a")), "a", "left_semi").select(F.col("b").alias("flow_id"))
        open_ = written(open_.join(first.unionByName(gone), "flow_id", "left_anti"))
        a, b = open_.select(F.col("flow_id").alias("a")), open_.select(F.col("flow_id").alias("b"))
        pairs = written(pairs.join(a, "a", "left_semi").join(b, "b", "left_semi"))
        stayed.append(first)
    return reduce(lambda x, y: x.unionByName(y), stayed, flows.select("flow_id").limit(0))


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Fixed-size lists of a driver-side iterator."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
