"""Hybrid retrieval: BM25, cosine neighbours, graph context, rank fusion, reranking, metrics.

Queries are a table, so all are answered in one plan. Every ranked list has the columns query_id,
list_no, rank, doc_id, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text, vectors
from tracewright.operators import cells, inverted
from tracewright.sources.files import written

RRF_K = 60
#: How much deeper than the final k lists and fusion go.
LIST_DEPTH, FUSED_DEPTH = 3, 2


def ranked(scored: DataFrame, k: int, list_no: int = 0, ties: str = "doc_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.lit(list_no).alias("list_no"), "rank", "doc_id", "score")


def bm25(index: inverted.Index, queries: DataFrame, k: int, list_no: int = 0) -> DataFrame:
    """Top k of each query (query_id, query) over texts that were analysed once."""
    return ranked(inverted.scores(index, queries, k), k, list_no)


def bm25_fields(docs: DataFrame, queries: DataFrame, fields: list[str], k: int, list_no: int = 0) -> DataFrame:
    """The best field of each document counts."""
    each = reduce(lambda a, b: a.unionByName(b), [bm25(inverted.build(docs, f), queries, LIST_DEPTH * k) for f in fields])
    return ranked(each.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k, list_no)


#: Queries that are held beside each row at a time, and blocks of them that are broadcast at most.
QUERY_BLOCK, BROADCAST_BLOCKS = 1000, 4


def vector_topk(vecs: DataFrame, queries: DataFrame, k: int, floor: float = 0.5, list_no: int = 0, where: Column | None = None) -> DataFrame:
    """vecs: doc_id, embedding [, metadata]; queries: query_id, embedding. A stated set of queries
    against all rows: queries are packed in blocks of a bounded size, each asked as one array beside
    each row; few blocks are broadcast, so that the rows stay where they are."""
    rows = (vecs if where is None else vecs.where(where)).select("doc_id", "embedding")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("__b").agg(F.collect_list(F.struct("query_id", F.col("embedding").alias("q"))).alias("qs"))
    rows = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = rows.join(F.broadcast(asked) if blocks <= BROADCAST_BLOCKS else asked, "__b").select("doc_id", "embedding", F.explode("qs").alias("q"))
    scored = pairs.select(F.col("q.query_id").alias("query_id"), "doc_id", F.round(vectors.cosine(F.col("embedding"), F.col("q.q")), 6).alias("score"))
    return ranked(scored.where(F.col("score") >= floor), k, list_no)


def vector_list(index: cells.Cells, queries: DataFrame, k: int, floor: float = 0.5, list_no: int = 0, probes: int | None = None) -> DataFrame:
    """Top k of each query (query_id, embedding) in the cells that it probes."""
    return ranked(cells.nearest(index, queries, k, probes, floor), k, list_no)


def rrf(lists: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """(query_id, rank, doc_id, score): sums of 1 / (constant + rank) over the lists."""
    fused = lists.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return ranked(fused.withColumn("score", F.round("score", 9)), k).drop("list_no")


def fusion_key(content: Column, content_hash: Column) -> Column:
    """What makes two results one: the content hash, else the first 100 characters."""
    return F.coalesce(F.when(F.trim(content_hash) != "", content_hash), F.substring(content, 1, 100))


def overlap(query: Column, body: Column) -> Column:
    """Default reranker: share of the query's terms that the body holds."""
    q = F.array_distinct(text.analyzed(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, text.analyzed(body))) / F.size(q))


def held(query: Column, words: Column) -> Column:
    """The same over a document's words as an index keeps them."""
    q = F.array_distinct(text.analyzed(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, words)) / F.size(q))


def rerank(fused: DataFrame, docs: DataFrame, queries: DataFrame, k: int, scorer=overlap) -> DataFrame:
    """Top k by the scorer (a column function; a pandas UDF fits), ties in fused order. Without a scorer
    the fused order stays."""
    if scorer is None:
        return fused.where(F.col("rank") <= k)
    body = fused.join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    scored = body.select("query_id", "doc_id", F.col("rank").alias("__fused"), F.round(scorer(F.col("query"), F.col("text")), 6).alias("score"))
    return ranked(scored, k, ties="__fused").drop("list_no")


def hybrid(lists: list[DataFrame], docs: DataFrame, queries: DataFrame, k: int, scorer=overlap) -> DataFrame:
    """Ranked lists -> fused to 2k -> reranked to k."""
    return rerank(rrf(reduce(lambda a, b: a.unionByName(b), lists), FUSED_DEPTH * k), docs, queries, k, scorer)


def five_lists(queries: DataFrame, code: inverted.Index, logs: inverted.Index, code_cells: cells.Cells, log_cells: cells.Cells, context: DataFrame, k: int, floor: float = 0.5, probes: int | None = None, kind: str = "BOTH") -> DataFrame:
    """The ranked lists of a retrieval, LIST_DEPTH * k deep: vectors and BM25 of code and of logs (numbers 1 to 4) and
    the graph's context documents (5; context: query_id, doc_id, score). queries: query_id, query,
    embedding. As CODE no logs are asked, as LOGS no code."""
    deep = LIST_DEPTH * k
    asked = queries.select("query_id", "embedding").where("embedding is not null")
    of_code = [vector_list(code_cells, asked, deep, floor, 1, probes), bm25(code, queries, deep, 3)] if kind != "LOGS" else []
    of_logs = [vector_list(log_cells, asked, deep, floor, 2, probes), bm25(logs, queries, deep, 4)] if kind != "CODE" else []
    return written(reduce(lambda a, b: a.unionByName(b), scope(kind, of_code, of_logs) + [ranked(context, deep, 5)]))


def retrieved(lists: DataFrame, words: DataFrame, queries: DataFrame, k: int, scorer=held) -> DataFrame:
    """Lists fused to 2k and reranked to k, with what the query's lists held: query_id, rank, doc_id, score,
    n_vector, n_bm25, n_graph, n_fused, n_found. words: doc_id, words."""
    fused = rrf(lists, FUSED_DEPTH * k)
    found = rerank(inverted.small(written(fused)), words.select("doc_id", F.col("words").alias("text")), queries, k, scorer)
    in_list = lambda *n: F.count(F.when(F.col("list_no").isin(*n), 1))
    counts = lists.groupBy("query_id").agg(in_list(1, 2).alias("n_vector"), in_list(3, 4).alias("n_bm25"), in_list(5).alias("n_graph"), F.count_distinct("doc_id").alias("n_fused"))
    return found.join(counts, "query_id").withColumn("n_found", F.count("*").over(Window.partitionBy("query_id")))


def scope(kind: str, code: list[DataFrame], logs: list[DataFrame]) -> list[DataFrame]:
    """Lists of CODE, LOGS or BOTH."""
    return {"CODE": code, "LOGS": logs, "BOTH": code + logs}[kind]


def graph_documents(neighbors: DataFrame, endpoints: DataFrame, methods: DataFrame) -> DataFrame:
    """Context of each service (service, score, content): its neighbourhood, endpoints, complex methods."""
    def doc(rows, column, title, score):
        listed = F.array_join(F.sort_array(F.collect_set(column)), ", ")
        return rows.groupBy("service").agg(listed.alias("__l")).select("service", F.lit(score).alias("score"), F.concat(F.lit(title), F.col("__l")).alias("content"))

    complex_ones = methods.where(F.col("complexity").isin("BRANCHING", "COMPLEX"))
    return doc(neighbors, "neighbor", "Neighbors: ", 1.0).union(doc(endpoints, "path", "Endpoints: ", 0.9)).union(doc(complex_ones, "method", "Complex methods: ", 0.7))


def metrics(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall, F1, MRR, NDCG@k of each query. found: query_id, rank, doc_id; relevant:
    query_id, doc_id."""
    rel = relevant.select("query_id", "doc_id").distinct().withColumn("__rel", F.lit(1))
    wanted = rel.groupBy("query_id").agg(F.count("*").alias("__wanted"))
    hits = found.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"], "left").withColumn("__rel", F.coalesce("__rel", F.lit(0)))
    each = hits.groupBy("query_id").agg(
        F.count("*").alias("__n"), F.sum("__rel").alias("__hit"), F.min(F.when(F.col("__rel") == 1, F.col("rank"))).alias("__first"), F.sum(F.col("__rel") / F.log2(F.col("rank") + 1)).alias("__dcg"),
    ).join(wanted, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("__wanted"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    p, r = F.col("__hit") / F.col("__n"), F.coalesce(F.col("__hit") / F.col("__wanted"), F.lit(0.0))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return each.select("query_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(F.coalesce(1 / F.col("__first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("__dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))


def embedding_quality(vecs: DataFrame) -> DataFrame:
    """(label, n, cohesion, separation, silhouette): mean cosine of pairs within the label and mean
    distance to other labels' vectors.

    Means over all pairs come from sums of unit vectors: the pairs' cosines add up to the dot product
    of the sums, so cost is linear and no pair is ever made."""
    unit = vecs.select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "x"), F.sqrt(vectors.squared_norm(F.col("embedding"))).alias("norm"))
    sums = unit.withColumn("x", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0)).groupBy("label", "i").agg(F.sum("x").alias("s"))
    n = vecs.groupBy("label").agg(F.count("*").alias("n"), F.sum((vectors.squared_norm(F.col("embedding")) > 0).cast("long")).alias("ones"))
    every = sums.groupBy("i").agg(F.sum("s").alias("t"))
    mixed = sums.join(every, "i").groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("own"), F.sum(F.col("s") * (F.col("t") - F.col("s"))).alias("other"))
    total = F.lit(vecs.count())
    rows = mixed.join(n, "label")
    cohesion = F.when(F.col("n") >= 2, (F.col("own") - F.col("ones")) / (F.col("n") * (F.col("n") - 1)))
    separation = 1 - F.col("other") / (F.col("n") * (total - F.col("n")))
    rows = rows.withColumn("c", cohesion).withColumn("b", separation).withColumn("a", 1 - F.col("c"))
    return rows.select("label", "n", F.round("c", 6).alias("cohesion"), F.round("b", 6).alias("separation"), F.round((F.col("b") - F.col("a")) / F.greatest("a", "b"), 6).alias("silhouette"))
