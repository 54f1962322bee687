"""Queries of hybrid retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import cells, flows, graph, inverted, retrieval
from tracewright.plans import graph_queries
from tracewright.plans.adapters import frame, sql
from tracewright.sources.files import file_system, written

K = 10
FLOOR = 0.2
_built: dict[tuple, object] = {}


def once(spark, sf: str, table: str, name: str, make):
    """What `make` has written of a table, while the session lasts and the table's files stay as they are."""
    fs, place, _ = file_system(spark, f"{sf}/{table}.parquet")
    files = fs.listStatus(place)
    seen = tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    key = (spark.sparkContext.applicationId, name, seen)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def index(spark, sf) -> inverted.Index:
    """The index that the queries over all documents share."""
    return once(spark, sf, "documents", "all", lambda: inverted.build(frame(spark, sf, "docs")))
DOCS = f"{sql('docs')}, {sql('q')}"
#: Terms of texts and queries, then the two ranked lists of 3k that the hybrid query fuses.
TERMS = f"""t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '{text.NOT_TERM}'), lambda x: x <> '') l from docs), tt as (select doc_id, len(l) dl, unnest(l) term from t), tf as (select doc_id, dl, term, count(*) tf from tt group by all),
qt as (select distinct query_id, unnest(list_filter(regexp_split_to_array(lower(query), '{text.NOT_TERM}'), lambda x: x <> '')) term from q), df as (select term, count(*) df from tf group by all), tot as (select count(*) n, avg(len(l)) a from t where len(l) > 0)"""
BM25 = f"""sc as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {inverted.K1 + 1} / (tf + {inverted.K1} * (1 - {inverted.B} + {inverted.B} * dl / a))), 6) score from qt join tf using (term) join df using (term), tot group by all)"""


def top(source: str, k: int | str, name: str) -> str:
    return f"{name} as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from {source} qualify rank <= {k})"


def bm25(k):
    return lambda spark, sf: retrieval.bm25(index(spark, sf), frame(spark, sf, "q"), k).drop("list_no")


def lists(spark, sf):
    """BM25, and documents by how many of the query's terms they hold."""
    of = inverted.ask(index(spark, sf), frame(spark, sf, "q"))
    return retrieval.ranked(inverted.best(of, 3 * K), 3 * K, 1), retrieval.ranked(inverted.best(of, 3 * K, counted=True), 3 * K, 2)


LISTS = f"with {DOCS}, {TERMS}, {BM25}, {top('sc', 3 * K, 'l1')}, co as (select query_id, doc_id, cast(count(*) as double) score from qt join (select distinct doc_id, term from tf) using (term) group by all), {top('co', 3 * K, 'l2')}, fu as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) score from (select * from l1 union all select * from l2) group by all)"


def fused(spark, sf):
    a, b = lists(spark, sf)
    return retrieval.rrf(a.unionByName(b), K)


def hybrid(spark, sf):
    a, b = lists(spark, sf)
    fused = inverted.small(written(retrieval.rrf(a.unionByName(b), 2 * K)))
    words = index(spark, sf).docs.select("doc_id", F.col("words").alias("text"))
    return retrieval.rerank(fused, words, frame(spark, sf, "q"), K, retrieval.held)


HYBRID = f"""{LISTS}, {top('fu', 2 * K, 'f2')}, qs as (select query_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '{text.NOT_TERM}'), lambda x: x <> '')) ql from q),
re as (select query_id, doc_id, f2.rank fr, case when len(ql) = 0 then 0.0 else round(len(list_intersect(ql, l)) / len(ql), 6) end score from f2 join qs using (query_id) join t using (doc_id))
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, fr) as rank from re qualify rank <= {K}"""


def metrics(spark, sf):
    """Relevant: good documents among the 3k that BM25 pools for the query."""
    pool = written(retrieval.bm25(index(spark, sf), frame(spark, sf, "q"), 3 * K))
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    return retrieval.metrics(pool, pool.join(good, "doc_id", "left_semi"), K)


METRICS = f"""with {DOCS}, {TERMS}, {BM25}, {top('sc', 3 * K, 'l1')}, j as (select l1.*, cast(doc_id in (select doc_id from labels where quality = 1) as int) r from l1),
g as (select query_id, count(*) filter (rank <= {K}) n, sum(r) filter (rank <= {K}) h, sum(r) wanted, min(case when r = 1 and rank <= {K} then rank end) f, sum(r / log2(rank + 1)) filter (rank <= {K}) dcg from j group by all),
w as (select *, h / n p, case when wanted > 0 then h / wanted else 0.0 end rc, (select sum(1 / log2(i + 1)) from range(1, 1 + cast(greatest(least(wanted, {K}), 1) as bigint)) x(i)) ideal from g)
select query_id, round(p, 6) as precision, round(rc, 6) recall, round(case when p + rc = 0 then 0.0 else 2 * p * rc / (p + rc) end, 6) f1, round(coalesce(1 / f, 0.0), 6) mrr, round(case when wanted > 0 then dcg / ideal else 0.0 end, 6) ndcg from w"""


#: Even documents and vectors stand for code, odd ones for logs; a query's vector is that of its number, its service
#: the nation of its number, whose context documents get the numbers below zero.
CODE_SQL = "regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
STOP = ", ".join(f"'{w}'" for w in text.CODE_STOP_WORDS)


def asked(spark, sf):
    vec = frame(spark, sf, "vec").select(F.col("doc_id").alias("query_id"), "embedding")
    return written(frame(spark, sf, "q").join(vec, "query_id", "left"))


def context(spark, sf):
    """(doc_id below zero, service, score, content) of every service's context documents."""
    docs = graph_queries.context_documents(spark, sf)
    keys = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey", "n_name as service")
    kind = F.when(F.col("score") == 1.0, 1).when(F.col("score") == 0.9, 2).otherwise(3)
    return docs.join(keys, "service").withColumn("doc_id", -(F.col("n_nationkey").cast("long") * 3 + kind))


def five(spark, sf, probes=None):
    half = lambda name, rest: frame(spark, sf, name).where(F.col("doc_id") % 2 == rest)
    code = once(spark, sf, "documents", "code", lambda: inverted.build(half("docs", 0), code=True))
    logs = once(spark, sf, "documents", "logs", lambda: inverted.build(half("docs", 1)))
    code_cells = once(spark, sf, "embeddings", "code-cells", lambda: cells.build(half("vec", 0)))
    log_cells = once(spark, sf, "embeddings", "log-cells", lambda: cells.build(half("vec", 1)))
    queries, near = asked(spark, sf), written(context(spark, sf))
    of_query = queries.select("query_id", (F.col("query_id") % 25).alias("n")).join(near, F.col("n") == F.col("n_nationkey")).select("query_id", "doc_id", "score")
    found = retrieval.five_lists(queries, code, logs, code_cells, log_cells, of_query, K, FLOOR, probes)
    words = index(spark, sf).docs.select("doc_id", "words").unionByName(near.select("doc_id", text.analyzed(F.col("content")).alias("words")))
    return retrieval.retrieved(found, words, queries, K)


def flow_evidence(spark, sf):
    """Code and log documents for every chain of up to three calls, by the words of its services."""
    rows = graph_queries.candidates(spark, sf).select(F.array_join("services", ">").alias("flow_id"), "services", "n_steps")
    half = lambda rest: frame(spark, sf, "docs").where(F.col("doc_id") % 2 == rest)
    code = once(spark, sf, "documents", "code", lambda: inverted.build(half(0), code=True))
    logs = once(spark, sf, "documents", "logs", lambda: inverted.build(half(1)))
    lists = lambda q, k: written(retrieval.bm25(code, q, 3 * k, 3).unionByName(retrieval.bm25(logs, q, 3 * k, 4)))
    asked = written(flows.evidence_query(rows))
    return flows.evidence(asked, lists, inverted.held(index(spark, sf), asked))


def bm25_of(name: str, terms: str, where: str, deep: str = str(3 * K), queries: str = "") -> str:
    return f"""{name}t as (select doc_id, {terms} l from docs where {where}), {name}f as (select doc_id, len(l) dl, term, count(*) tf from (select doc_id, l, unnest(l) term from {name}t) group by all),
{name}d as (select term, count(*) df from {name}f group by all), {name}n as (select count(*) n, avg(len(l)) a from {name}t where len(l) > 0),
{name}q as (select distinct query_id, unnest({terms.replace("text", "query")}) term from q),
{name}s as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {inverted.K1 + 1} / (tf + {inverted.K1} * (1 - {inverted.B} + {inverted.B} * dl / a))), 6) score from {name}q join {name}f using (term) join {name}d using (term), {name}n group by all), {top(f"{name}s{queries}", deep, f"{name}l")}"""


PLAIN = f"list_filter(regexp_split_to_array(lower(text), '{text.NOT_TERM}'), lambda x: x <> '')"
CODED = f"list_filter(regexp_split_to_array(lower({CODE_SQL}), '{text.NOT_TERM}'), lambda x: x <> '' and x not in ({STOP}))"
FIVE = f"""with {DOCS}, {sql('vec')}, {bm25_of('k', CODED, 'doc_id % 2 = 0')}, {bm25_of('g', PLAIN, 'doc_id % 2 = 1')},
vs as (select query_id, v.doc_id, v.doc_id % 2 r, round(list_cosine_similarity(cast(v.embedding as double[]), cast(e.embedding as double[])), 6) score from q join vec e on e.doc_id = query_id, vec v),
{top(f"(select * from vs where r = 0 and score >= {FLOOR})", 3 * K, 'v0')}, {top(f"(select * from vs where r = 1 and score >= {FLOOR})", 3 * K, 'v1')},
{graph_queries.CONTEXT_TABLES}, cx as (select -(n_nationkey * 3 + case score when 1.0 then 1 when 0.9 then 2 else 3 end) doc_id, n_nationkey, score, c from d join nation on n_name = service),
cs as (select query_id, cx.doc_id, cast(score as double) score from q join cx on query_id % 25 = n_nationkey), {top('cs', 3 * K, 'cl')},
al as (select 1 n, * from v0 union all select 2, * from v1 union all select 3, * from kl union all select 4, * from gl union all select 5, * from cl),
fu as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) score from al group by all), {top('fu', 2 * K, 'f2')},
bd as (select doc_id, {PLAIN} l from docs union all select doc_id, {PLAIN.replace("text", "c")} from cx),
qs as (select query_id, list_distinct({PLAIN.replace("text", "query")}) ql from q),
re as (select query_id, doc_id, f2.rank fr, case when len(ql) = 0 then 0.0 else round(len(list_intersect(ql, l)) / len(ql), 6) end score from f2 join qs using (query_id) join bd using (doc_id)),
fin as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, fr) as rank from re qualify rank <= {K}),
co as (select query_id, count(*) filter (n <= 2) n_vector, count(*) filter (n in (3, 4)) n_bm25, count(*) filter (n = 5) n_graph, count(distinct doc_id) n_fused from al group by all)
select fin.*, n_vector, n_bm25, n_graph, n_fused, count(*) over (partition by query_id) n_found from fin join co using (query_id)"""


PER_QUERY = " join q using (query_id)"
EVIDENCE = f"""{graph_queries.walks(3)}, {sql('docs')}, q as (select path query_id, replace(path, '>', ' ') query, greatest(10, 3 * (hops + 1)) top_k from w), {bm25_of('k', CODED, 'doc_id % 2 = 0', '3 * top_k', PER_QUERY)}, {bm25_of('h', PLAIN, 'doc_id % 2 = 1', '3 * top_k', PER_QUERY)},
fu as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) score from (select * from kl union all select * from hl) group by all), {top('fu' + PER_QUERY, '2 * top_k', 'f2')},
qs as (select query_id, top_k, list_distinct({PLAIN.replace("text", "query")}) ql from q), bd as (select doc_id, {PLAIN} l from docs),
re as (select query_id, doc_id, top_k, f2.rank fr, case when len(ql) = 0 then 0.0 else round(len(list_intersect(ql, l)) / len(ql), 6) end score from f2 join qs using (query_id) join bd using (doc_id))
select query_id flow_id, case when doc_id % 2 = 0 then 'CODE' else 'LOG' end kind, cast(row_number() over (partition by query_id order by score desc, fr) as integer) as rank, doc_id from re qualify rank <= top_k"""


def routed(spark, sf):
    """The query of vector_topk through the inverted file, every cell asked."""
    of = once(spark, sf, "embeddings", "all-cells", lambda: cells.build(frame(spark, sf, "vec")))
    return retrieval.vector_list(of, firsts(spark, sf), 5, FLOOR).drop("list_no")


def firsts(spark, sf):
    """One query vector for each label: that of its least id."""
    return frame(spark, sf, "vec").groupBy("label").agg(F.min_by("embedding", "doc_id").alias("embedding")).select(F.col("label").alias("query_id"), "embedding")


def neighbours(floor, label=None):
    def run(spark, sf):
        where = None if label is None else F.col("label") == label
        return retrieval.vector_topk(frame(spark, sf, "vec"), firsts(spark, sf), 5, floor, where=where).drop("list_no")

    return run


NEAR = f"with {sql('vec')}, fi as (select label query_id, arg_min(embedding, doc_id) e from vec group by all), sc as (select query_id, doc_id, round(list_cosine_similarity(cast(embedding as double[]), cast(e as double[])), 6) score from vec, fi where {{}})"


def links(spark, sf):
    v = frame(spark, sf, "vec").select(F.col("doc_id").alias("id"), "embedding")
    return graph.link_scores(v, 0.3).select("a", "b", F.round("score", 6).alias("score"))


def classes(spark, sf):
    v = frame(spark, sf, "vec").select(F.col("doc_id").alias("id"), "embedding")
    return graph.classified(v).select("id", "pattern", F.round("confidence", 6).alias("confidence"))


NAMES = ", ".join(f"'{p}'" for p in graph.PATTERNS)


def quality(spark, sf):
    return retrieval.embedding_quality(frame(spark, sf, "vec"))


QUALITY = f"""with {sql("vec")}, p as (select x.label a, y.label b, x.doc_id <> y.doc_id d, list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])) c from vec x, vec y),
g as (select a as label, avg(case when a = b and d then c end) co, 1 - avg(case when a <> b then c end) se from p group by all), n as (select label, count(*) n from vec group by all)
select label, n, round(co, 6) cohesion, round(se, 6) separation, round((se - (1 - co)) / greatest(se, 1 - co), 6) silhouette from g join n using (label)"""


def deduplicated(spark, sf):
    """Documents by fusion key: how many results each key stands for."""
    d = frame(spark, sf, "docs")
    key = retrieval.fusion_key(F.col("text"), F.lit(None).cast("string"))
    return d.groupBy(F.sha2(key, 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


QUERIES = {
    "bm25_topk": (bm25(K), f"with {DOCS}, {TERMS}, {BM25}, {top('sc', K, 'l1')} select query_id, rank, doc_id, score from l1"),
    "vector_topk": (neighbours(0.2), f"{NEAR.format('true')}, {top('(select * from sc where score >= 0.2)', 5, 'l')} select query_id, rank, doc_id, score from l"),
    "vector_topk_filtered": (neighbours(0.2, 3), f"{NEAR.format('label = 3')}, {top('(select * from sc where score >= 0.2)', 5, 'l')} select query_id, rank, doc_id, score from l"),
    "vector_topk_routed": (routed, f"{NEAR.format('true')}, {top(f'(select * from sc where score >= {FLOOR})', 5, 'l')} select query_id, rank, doc_id, score from l"),
    "hybrid_five_lists": (five, FIVE),
    "flow_evidence": (flow_evidence, EVIDENCE),
    "rrf_fusion": (fused, f"{LISTS}, {top('fu', K, 'f')} select query_id, rank, doc_id, score from f"),
    "hybrid_retrieve": (hybrid, HYBRID),
    "retrieval_metrics": (metrics, METRICS),
    "link_scores": (links, f"with {sql('vec')}, p as (select x.doc_id a, y.doc_id b, list_dot_product(cast(x.embedding as double[]), cast(y.embedding as double[])) s from vec x, vec y where x.doc_id < y.doc_id) select a, b, round(s, 6) score from p where s > 0.3"),
    "argmax_classes": (classes, f"with {sql('vec')} select doc_id id, [{NAMES}][least(list_position(embedding, list_max(embedding)), {len(graph.PATTERNS)})] pattern, round(cast(list_max(embedding) as double), 6) confidence from vec"),
    "embedding_quality": (quality, QUALITY),
    "fusion_keys": (deduplicated, f"with {sql('docs')} select sha256(substring(text, 1, 100)) as key, count(*) n, min(doc_id) as first from docs group by all"),
}
