"""Ranking, fusion, metrics, embeddings, narratives, reports, metadata tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import text, vectors
from tracewright.operators import cells, embedding, evaluation, flows, inverted, relational, report, retrieval
from tracewright.sources.files import written


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red apple red"), (2, "green apple"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red red")], "query_id long, query string")
    got = retrieval.bm25(inverted.build(docs), q, 5).collect()
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert [(r["doc_id"], r["rank"]) for r in got] == [(1, 1)]
    assert got[0]["score"] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5)), abs=1e-6)


def full_bm25(docs, queries, k):
    words = {i: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w] for i, t in docs}
    sizes = [len(w) for w in words.values() if w]
    mean, n, df = sum(sizes) / len(sizes), len(sizes), Counter(w for ws in words.values() for w in set(ws))
    out = []
    for number, q in queries:
        scores = {}
        for i, ws in words.items():
            count = Counter(ws)
            hit = [w for w in set(re.split(r"\W+", q.lower())) if count[w]]
            if hit:
                scores[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * count[w] * 2.2 / (count[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in hit), 6)
        out += [(number, rank, i, scores[i]) for rank, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "shard"), [(128, 1 << 16), (4, 60)])
def test_bm25_leaves_out_blocks_and_stays_whole(spark, monkeypatch, block, shard):
    monkeypatch.setattr(inverted, "BLOCK", block)
    monkeypatch.setattr(inverted, "SHARD", shard)
    rng = random.Random(block)
    rows = [(i, " ".join(["the"] * rng.randint(1, 6) + rng.choices(["a", "b", "c", "rare", *"defghijk"], [9, 7, 5, 0.3, *[1] * 8], k=rng.randint(1, 30)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "the the the rare rare"), (903, "the the the rare rare")]
    queries = [(1, "the rare"), (2, "the a b"), (3, "none"), (4, "the"), (5, "rare rare the c")]
    index = inverted.build(spark.createDataFrame(rows, "doc_id long, text string"))
    q = spark.createDataFrame(queries, "query_id long, query string")
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in retrieval.bm25(index, q, 5).collect()) == full_bm25(rows, queries, 5)
    terms = inverted.asked(index, q)
    read, all_of = inverted.met(index, terms, 5), index.blocks.join(terms, "term")
    if block == 4:
        assert read.count() < 0.9 * all_of.count()
        assert read.where("query_id = 4").count() < 0.3 * all_of.where("query_id = 4").count()
        assert index.blocks.where("term = 'the'").select("shard").distinct().count() > 1
        assert index.blocks.selectExpr("max(size(postings)) m").first()["m"] <= 4


@pytest.mark.parametrize("repeated", [False, True])
def test_bm25_where_the_documents_lie(spark, monkeypatch, repeated):
    """Scans, meeting postings and blocks give the same; a scan hands on k rows a query and task, not every document met."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", *"abcdefghijk"], [9, *range(1, 12)], k=rng.randint(0, 25)))) for i in range(800)] + [(901, None), (902, "the a b"), (903, "the a b")]
    queries = [(1, "the a b c"), (2, "k"), (3, "none"), (4, "the i j k the"), (5, ""), (None, "a the")]
    q = spark.createDataFrame(queries, "query_id int, query string")
    if repeated:
        rows += [(7, "a a the"), (None, "k k k k")]
    index = inverted.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert index.keyed is not repeated
    top = lambda scored: sorted(map(str, retrieval.ranked(scored, 6).collect()))
    blocks, scored = top(inverted.by_blocks(index, q, 6)), inverted.scores(index, q, 6)
    assert top(scored) == blocks and len(blocks) == 24
    if not repeated:
        assert top(scored) == sorted(map(str, spark.createDataFrame([(i, 0, r, d, s) for i, r, d, s in full_bm25(rows, [x for x in queries if x[0]], 6) + [(None, *x[1:]) for x in full_bm25(rows, queries[-1:], 6)]], "query_id int, list_no int, rank int, doc_id long, score double").collect()))
        assert scored.count() <= 6 * 5 * scored.rdd.getNumPartitions()
    of = inverted.ask(index, q)
    counts = top(inverted.best(of, 6, counted=True))
    assert counts == top(inverted.shared_blocks(index, q))
    monkeypatch.setattr(inverted, "DEAR", 0)
    assert inverted.best(of, 6).count() > 1000 and top(inverted.best(of, 6)) == blocks and top(inverted.best(of, 6, counted=True)) == counts
    monkeypatch.setattr(inverted, "DEAR", 8)
    monkeypatch.setattr(inverted, "TOGETHER", 2)
    assert top(inverted.best(of, 6)) == blocks
    monkeypatch.setattr(inverted, "MOST_TERMS", 3)
    assert inverted.ask(index, q).slim is None and top(inverted.scores(index, q, 6)) == blocks


def test_terms_keep_their_marks(spark):
    got = spark.range(1).select(text.analyzed(F.lit("हिन्दी भाषा, cafe\u0301 don-t")).alias("t")).first()["t"]
    assert got == ["हिन्दी", "भाषा", "cafe\u0301", "don", "t"]


def clustered(n, d, seed, centres=12, spread=0.25):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return [(i, (c[0 if i % 3 == 0 else rng.integers(centres)] + spread * rng.normal(size=d)).tolist()) for i in range(n)]


def test_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 50)
    monkeypatch.setattr(cells, "ASKED", 7)
    rows = clustered(900, 8, 2)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0] * 9), (1005, [None] * 8)]
    v = spark.createDataFrame(rows + odd, "doc_id long, embedding array<float>")
    q = v.where("doc_id % 30 = 0 or doc_id in (1002, 1004)").withColumnRenamed("doc_id", "query_id")
    index = cells.build(v, 30)
    assert index.blocks.selectExpr("sum(size(ids)) n").first()["n"] == 900
    assert index.blocks.selectExpr("max(size(ids)) n").first()["n"] < 150  # a third of all is in one cluster
    exact = {(r["query_id"], r["doc_id"], r["score"]) for r in retrieval.vector_topk(v.where("doc_id < 1000"), q.where("query_id < 1000"), 10, 0.2).collect()}
    assert {(r["query_id"], r["doc_id"], r["score"]) for r in retrieval.vector_list(index, q, 10, 0.2).collect()} == exact and len(exact) == 300
    few = {(r["query_id"], r["doc_id"], r["score"]) for r in retrieval.vector_list(index, q, 10, 0.2, probes=6).collect()}
    assert len(few & exact) >= 0.9 * len(exact)
    assert retrieval.vector_list(cells.build(v.limit(0)), q, 10).count() == 0


def test_five_lists(spark):
    docs = spark.createDataFrame([(i, f"word{i} orderService common") for i in range(8)], "doc_id long, text string")
    vecs = spark.createDataFrame([(i, [math.cos(i / 4), math.sin(i / 4)]) for i in range(8)], "doc_id long, embedding array<double>")
    half = lambda df, rest: df.where(F.col("doc_id") % 2 == rest)
    queries = spark.createDataFrame([(1, "order word2", [1.0, 0.0]), (2, "word3", None)], "query_id long, query string, embedding array<double>")
    context = spark.createDataFrame([(1, -1, 1.0), (1, -2, 0.9)], "query_id long, doc_id long, score double")
    parts = (inverted.build(half(docs, 0), code=True), inverted.build(half(docs, 1)), cells.build(half(vecs, 0)), cells.build(half(vecs, 1)))
    lists = retrieval.five_lists(queries, *parts, context, 2)
    by = {(r["query_id"], r["list_no"]): r["n"] for r in lists.groupBy("query_id", "list_no").agg(F.count("*").alias("n")).collect()}
    assert by == {(1, 1): 3, (1, 2): 2, (1, 3): 4, (1, 5): 2, (2, 4): 1}
    words = docs.select("doc_id", text.analyzed(F.col("text"), True).alias("words")).union(spark.createDataFrame([(-1, ["order"]), (-2, ["x"])], "doc_id long, words array<string>"))
    found = [tuple(r) for r in retrieval.retrieved(lists, words, queries, 2).select("query_id", "rank", "doc_id", "score", "n_vector", "n_bm25", "n_graph", "n_fused", "n_found").orderBy("query_id", "rank").collect()]
    assert found[0][:4] == (1, 1, 2, 1.0) and found[0][4:] == (5, 4, 2, 8, 2) and found[-1] == (2, 1, 3, 1.0, 0, 1, 0, 1, 1)
    code_only = retrieval.five_lists(queries, *parts, context, 2, kind="CODE")
    assert {r["list_no"] for r in code_only.select("list_no").distinct().collect()} == {1, 3, 5}


def test_best_field_counts(spark):
    docs = spark.createDataFrame([(1, "x", "rare words"), (2, "rare", "x")], "doc_id long, title string, body string")
    q = spark.createDataFrame([(1, "rare")], "query_id long, query string")
    assert {r["doc_id"] for r in retrieval.bm25_fields(docs, q, ["title", "body"], 5).collect()} == {1, 2}


def test_code_analyzer(spark):
    got = spark.range(1).select(text.analyzed(F.lit("public class OrderService returns newOrder"), code=True).alias("t")).first()["t"]
    assert got == ["order", "service", "returns", "order"]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, list_no int, rank int, doc_id long, score double")


def test_rrf(spark):
    got = retrieval.rrf(ranked(spark, [(1, 0, 1, 10, 0.0), (1, 0, 2, 11, 0.0), (1, 1, 1, 11, 0.0)]), 5).collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(11, 1), (10, 2)]
    assert got[1]["score"] == pytest.approx(1 / 61, abs=1e-8) and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)


def test_rerank_and_fallback(spark):
    docs = spark.createDataFrame([(10, "nothing"), (11, "red apple")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red")], "query_id long, query string")
    fused = spark.createDataFrame([(1, 1, 10, 0.5), (1, 2, 11, 0.4)], "query_id long, rank int, doc_id long, score double")
    assert [r["doc_id"] for r in retrieval.rerank(fused, docs, q, 2).orderBy("rank").collect()] == [11, 10]
    assert [r["doc_id"] for r in retrieval.rerank(fused, docs, q, 1, scorer=None).collect()] == [10]


def judged(spark, found, relevant, k):
    f = spark.createDataFrame([(1, i, d) for i, d in enumerate(found, 1)], "query_id long, rank int, doc_id long")
    return retrieval.metrics(f, spark.createDataFrame([(1, d) for d in relevant], "query_id long, doc_id long"), k).first()


def test_retrieval_metrics(spark):
    got = judged(spark, [1, 2, 3, 4, 5], [1, 2, 3, *range(20, 27)], 5)
    assert (got["precision"], got["recall"], got["f1"]) == (0.6, 0.3, 0.4)
    assert judged(spark, [9, 8, 1], [1], 3)["mrr"] == pytest.approx(1 / 3, abs=1e-6)
    assert judged(spark, [1, 2], [1, 2], 2)["ndcg"] == 1.0
    assert tuple(judged(spark, [5], [1], 1))[1:] == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_vector_topk_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(40)], "doc_id long, embedding array<double>")
    q = v.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, retrieval.vector_topk(v, q, 3, 0.5).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    monkeypatch.setattr(retrieval, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, retrieval.vector_topk(v, q, 3, 0.5).collect())) == want and len(want) == 12


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z"))).first()
    assert got[0] == pytest.approx(math.sqrt(0.5)) and got[1] == 0


def test_embedding_quality_equals_pairs(spark):
    import itertools

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(15)]
    got = {r["label"]: r for r in retrieval.embedding_quality(spark.createDataFrame(rows, "doc_id long, embedding array<double>, label int")).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    for label in range(3):
        own, rest = [e for _, e, g in rows if g == label], [e for _, e, g in rows if g != label]
        c = [cos(a, b) for a, b in itertools.combinations(own, 2)]
        d = [1 - cos(a, b) for a in own for b in rest]
        assert got[label]["cohesion"] == pytest.approx(sum(c) / len(c), abs=1e-6)
        assert got[label]["separation"] == pytest.approx(sum(d) / len(d), abs=1e-6)


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("red apple",), ("apple RED",), ("",)], "content string")
    a, b, z = (r["embedding"] for r in embedding.embedded(df).collect())
    assert a == b and len(a) == 64 and sum(x * x for x in a) == pytest.approx(1, abs=1e-5) and not any(z)


def test_narrative_scores(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    story = F.lit("# A\n## B\n### C\n# D\nTherefore a calls b, because then it finally ends")
    assert value(text.coherence(story)) == 1.0
    assert value(evaluation.completeness(F.lit("a and b"), F.array(F.lit("a"), F.lit("c")))) == 0.5
    assert value(evaluation.completeness(F.lit(""), F.array().cast("array<string>"))) == 1.0
    assert value(text.judge_score(F.lit('```json\n{"score": 0.8}\n```'))) == 0.8 and value(text.judge_score(F.lit("none"))) == 0.5
    assert value(text.slug(F.lit("Order Flow: #1!"))) == "order-flow-1"
    assert value(text.database_name(F.lit("jdbc:postgresql://h:5432/orders?ssl=1"))) == "orders"
    names = {"jdbc:sqlserver://h/a;b=1": "a;b=1", "redis://h:6379": "h:6379", "mem:h": "h", "": "unknown", "jdbc:h2:mem:test": "h2:mem:test", "x/": "unknown"}
    assert {u: value(text.database_name(F.lit(u))) for u in names} == names
    assert value(F.array_join(text.analyzed(F.lit("Größe der Straße, 2x été")), " ")) == "größe der straße 2x été"
    assert value(text.truncated(F.lit("abcdef"), 3, dots=True)) == "abc..."


@pytest.mark.parametrize("calls, level", [("x.get()", "NONE"), ("m.map(a).filter(b)", "LINEAR"), ("m.map(a).onErrorResume(b)", "BRANCHING"), ("m.zipWith(a).switchMap(b)", "COMPLEX"), ("m" + ".map(a)" * 6, "COMPLEX")])
def test_reactive_complexity(spark, calls, level):
    assert spark.range(1).select(text.reactive_complexity(text.calls(F.lit(calls))).alias("x")).first()["x"] == level


def test_passages(spark):
    none = F.lit(None).cast("string")
    got = spark.range(1).select(text.log_passage(F.lit("s"), F.lit("ERROR"), F.lit("t"), F.lit("E"), F.lit("m"), F.lit("l")), text.log_passage(F.lit("s"), F.lit("INFO"), F.lit("t"), none, none, none)).first()
    assert tuple(got) == ("passage: [s] ERROR: t | exception: E - m | logger: l", "passage: [s] INFO: t")
    code = spark.range(1).select(text.code_passage(F.lit("METHOD"), F.lit("p.A"), F.lit("run"), F.array(F.lit("Get")), F.lit("body"))).first()[0]
    assert code == "// METHOD: p.A.run\n// Annotations: Get\nbody"


def test_metadata_tables(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("n", None, 1)], "path string, hash string, seq int")
    new = spark.createDataFrame([("a", "1", 2), ("b", "3", 2), ("c", "4", 2)], "path string, hash string, seq int")
    assert {tuple(r) for r in relational.changed(old, new).collect()} == {("b", "MODIFIED"), ("c", "ADDED"), ("n", "REMOVED")}
    assert [r["path"] for r in relational.unseen(new, old, "path").collect()] == ["c"]
    batch = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3), (None, 4), ("z", 5)], "etag string, at int")
    seen = spark.createDataFrame([("z",)], "etag string")
    assert sorted(tuple(r) for r in relational.unseen(batch, seen).collect()) == [("x", 1), ("y", 3)]
    assert {r["path"]: r["hash"] for r in relational.upsert(old, new, ["path"], F.col("seq")).collect()} == {"a": "1", "b": "3", "c": "4", "n": None}
    assert relational.latest(new, [F.col("path").desc()], F.col("seq") == 2).first()["path"] == "c"
    table = spark.createDataFrame([("t", "late", 2), ("t", "early", 1)], "k string, v string, o int")
    assert [r["v"] for r in relational.first_lookup(spark.createDataFrame([("t",), ("u",)], "k string"), table, "k", "v", ["o"]).orderBy("k").collect()] == ["early", ""]
    kinds = spark.createDataFrame([("f", "UNKNOWN", 1), ("f", "APP", 2), ("g", "UNKNOWN", 1)], "folder string, kind string, pos int")
    assert {r["folder"]: r["kind"] for r in relational.dominant(kinds, "folder", "kind", "pos").collect()} == {"f": "APP", "g": "UNKNOWN"}


def test_stratified_sample(spark):
    rows = [(i, i, "ab"[i % 2], "ERROR" if i % 10 == 0 else "INFO") for i in range(100)]
    got = relational.stratified(spark.createDataFrame(rows, "event_id long, ts long, service string, severity string"), 30).collect()
    assert sum(r["severity"] == "ERROR" for r in got) == 10 and len(got) == 30


def test_reports(spark):
    risks = spark.createDataFrame([(1, "HIGH", "DATA", "a"), (2, "HIGH", "BUILD", "b"), (3, "CRITICAL", "DATA", "a")], "risk_id long, severity string, category string, service string")
    assert {tuple(r) for r in report.risk_matrix(risks).collect()} == {("severity", "HIGH", 2), ("severity", "CRITICAL", 1), ("category", "DATA", 2), ("category", "BUILD", 1)}
    assert tuple(report.summary(risks).first()) == (3, 2, 1, 2)
    assert [r["risk_id"] for r in report.findings(risks, 2).collect()] == [3, 1]
    flows = spark.createDataFrame([("f1", ["a", "b"]), ("f2", ["c"])], "flow_id string, services array<string>")

    def model(prompt):
        if "f2" in prompt and "risks" in prompt:
            raise ValueError("model down")
        return f"answer to {prompt}"

    stages = report.synthesized(flows, model).collect()
    assert sum(r["flow_id"] == "f1" for r in stages) == 6 and [r["error"] for r in stages if r["flow_id"] == "f2"] == [None, None, "model down"]
    page = report.markdown(report.summary(risks), report.risk_matrix(risks), spark.createDataFrame(stages, "flow_id string, stage string, n int, answer string, error string"))
    assert "risks: 3" in page and "- severity HIGH: 2" in page and "- f1: answer" in page


def test_evidence_of_flows(spark):
    docs = spark.createDataFrame([(i, f"svc{i % 4} handles orders") for i in range(12)] + [(20, "nothing"), (21, "else")], "doc_id long, text string")
    half = lambda rest: docs.where(F.col("doc_id") % 2 == rest)
    code, logs = inverted.build(half(0), code=True), inverted.build(half(1))
    asked = flows.evidence_query(spark.createDataFrame([("f", ["svc0", "svc1"], 2), ("long", ["svc2", "svc3", "svc2", "svc1"], 4), ("none", ["x9"], 1)], "flow_id string, services array<string>, n_steps int"))
    assert {r["query_id"]: r["top_k"] for r in asked.collect()} == {"f": 10, "long": 12, "none": 10}
    lists = lambda q, k: written(retrieval.bm25(code, q, 3 * k, 3).unionByName(retrieval.bm25(logs, q, 3 * k, 4)))
    words = docs.select("doc_id", text.analyzed(F.col("text")).alias("words"))
    found = flows.evidence(written(asked), lists, words)
    got = {}
    for r in found.collect():
        got.setdefault(r["flow_id"], {}).setdefault(r["kind"], set()).add(r["doc_id"])
    assert got == {"f": {"CODE": {0, 4, 8}, "LOG": {1, 5, 9}}, "long": {"CODE": {2, 6, 10}, "LOG": {1, 3, 5, 7, 9, 11}}}
    assert {tuple(r) for r in flows.evidence_counts(found).collect()} == {("f", 3, 3), ("long", 3, 6)}


def test_lists_and_evidence_make_no_postings_of_all_terms(spark):
    docs = spark.createDataFrame([(i, f"svc{i % 5} calls svc{(i + 1) % 5} word{i}") for i in range(40)], "doc_id long, text string")
    vecs = spark.createDataFrame([(i, [1.0, float(i % 7)]) for i in range(40)], "doc_id long, embedding array<double>")
    half = lambda df, rest: df.where(F.col("doc_id") % 2 == rest)
    code, logs, every = inverted.build(half(docs, 0), code=True), inverted.build(half(docs, 1)), inverted.build(docs)
    queries = spark.createDataFrame([(1, "svc1 svc2", [1.0, 2.0])], "query_id long, query string, embedding array<double>")
    context = spark.createDataFrame([(1, -1, 1.0)], "query_id long, doc_id long, score double")
    assert retrieval.five_lists(queries, code, logs, cells.build(half(vecs, 0)), cells.build(half(vecs, 1)), context, 2).count() > 12
    asked = written(flows.evidence_query(spark.createDataFrame([("f", ["svc0", "svc1"], 2), ("g", ["svc2", "svc4", "svc1"], 4)], "flow_id string, services array<string>, n_steps int")))
    lists = lambda q, k: written(retrieval.bm25(code, q, 3 * k, 3).unionByName(retrieval.bm25(logs, q, 3 * k, 4)))
    words = inverted.held(every, asked)
    assert words.count() == 40 and {w for r in words.collect() for w in r["words"]} == {"svc0", "svc1", "svc2", "svc4"}
    found, whole = (sorted(map(tuple, flows.evidence(asked, lists, w).collect())) for w in (words, every.docs))
    assert found == whole and len(found) == 22
    assert not any("blocks" in vars(i) or "terms" in vars(i) for i in (code, logs, every))
