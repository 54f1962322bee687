"""Graph walks, topics, features, flows: small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import vectors
from tracewright.operators import flows, graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_entry_points(spark):
    assert [r["id"] for r in graph.entry_points(nodes(spark, [1, 2, 3, 3]), edges(spark, [(1, 2), (5, 4)])).orderBy("id").collect()] == [1, 3]


def test_chains_use_an_edge_once(spark):
    got = sorted(tuple(r["path"]) for r in graph.call_chains(nodes(spark, [0]), edges(spark, [(0, 1), (1, 0), (1, 2)]), 5).collect())
    assert got == [(0, 1), (0, 1, 0), (0, 1, 2)]


def test_chain_depth_is_clamped(spark):
    line = edges(spark, [(i, i + 1) for i in range(15)])
    assert graph.call_chains(nodes(spark, [0]), line, 99).count() == 10
    assert graph.call_chains(nodes(spark, [0]), line, 0).count() == 1


def related(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, relation string")


def labels(spark, ids):
    return spark.createDataFrame([(i, f"L{i}") for i in ids], "id long, label string")


def test_neighborhood(spark):
    e = related(spark, [(0, 1, "A"), (2, 1, "B"), (2, 3, "C"), (0, 4, "D"), (4, 0, "E")])
    got = {tuple(r) for r in graph.neighborhood(nodes(spark, [0]), e, labels(spark, [1, 2]), 2).collect()}
    assert got == {(0, 1, "A", "L1"), (0, 2, "B", "L2"), (0, 4, "D", None), (0, 4, "E", None)}


def test_shortest_chains(spark):
    rng = random.Random(4)
    e = [(rng.randrange(40), rng.randrange(40), rng.choice("XYZ")) for _ in range(90)] + [(50, 51, "Q"), (51, 50, "Q"), (0, 0, "Q")] + [(100 + i, 101 + i, "R") for i in range(14)]
    starts = [0, 1, 2, 50, 77, 100]
    want = {}
    for s in starts:
        depth, front, by = {s: 0}, [s], {}
        for hop in range(1, 11):
            reached = {}
            for a, b, r in e:
                if a in front and b not in depth:
                    reached[b] = min(reached.get(b, (a, r)), (a, r))
            by |= reached
            depth |= dict.fromkeys(reached, hop)
            front = list(reached)
        for t in depth:
            path, relations, at = [t], [], t
            while at != s:
                at, r = by[at]
                path, relations = [at, *path], [r, *relations]
            if t != s:
                want[s, t] = (depth[t], path, relations)
    known = labels(spark, range(60))
    got = graph.shortest_chains(nodes(spark, [*starts, 0]), related(spark, e), known).collect()
    assert {(r["source"], r["target"]): (r["depth"], [n["id"] for n in r["nodes"] if n["id"] is not None], r["relations"]) for r in got if r["source"] != 100} == {k: v for k, v in want.items() if k[0] != 100}
    far = {r["target"]: (r["depth"], len(r["nodes"]), len(r["relations"])) for r in got if r["source"] == 100}
    assert far == {100 + i: (i, i + 1, i) for i in range(1, 11)} and len(got) == len(want)
    assert all(n["label"] == (f"L{n['id']}" if n["id"] < 60 else None) for r in got for n in r["nodes"])
    one = graph.shortest_chains(nodes(spark, [0, 1]), related(spark, e), known, nodes(spark, [3, 0])).collect()
    assert {(r["source"], r["target"]) for r in one} == {k for k in want if k[0] in (0, 1) and k[1] in (3, 0)}


def test_chains_are_joined_once_a_depth(spark):
    """A path of ten hops took ten joins of all chains; now the last depth alone is still to be joined at the end."""
    found = graph.shortest_chains(nodes(spark, [0, 5]), related(spark, [(i, i + 1, "A") for i in range(12)]), labels(spark, range(13)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2 and found.count() == 17
    assert max(len(r["nodes"]) for r in found.collect()) == 11
    ends = graph.shortest_chains(nodes(spark, [0, 5]), related(spark, [(i, i + 1, "A") for i in range(12)]), labels(spark, range(13)), nodes(spark, [7, 40]))
    assert sorted((r["source"], r["target"], r["depth"], [n["id"] for n in r["nodes"]]) for r in ends.collect()) == [(0, 7, 7, list(range(8))), (5, 7, 2, [5, 6, 7])]


def test_chains_of_any_length(spark, tmp_path):
    """The query stopped after ten hops and gave no chain to what lies farther."""
    import duckdb

    from tracewright.plans import graph_queries

    long = graph.shortest_chains(nodes(spark, [0, 9]), related(spark, [(i, i + 1, "A") for i in range(14)] + [(14, 3, "B")]), labels(spark, range(15)), most=None).collect()
    assert sorted((r["source"], r["target"], r["depth"]) for r in long) == [(0, i, i) for i in range(1, 15)] + [(9, i, i + 6 - 3 if i < 9 else i - 9) for i in range(3, 15) if i != 9]
    spark.range(234).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    query, text = graph_queries.QUERIES["shortest_chain"]
    got = sorted(map(tuple, query(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view supplier as from '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == sorted(con.sql(text).fetchall())
    to, called = {i: {(2 * i + 1) % 234, (6 * i + 3) % 234} - {i} for i in range(234)}, set()
    for i in to:
        called |= to[i]
    want = {}
    for s in set(range(0, 234, 3)) - called:
        seen, front = {s: 0}, [s]
        for at in front:
            for n in to[at] - set(seen):
                seen[n] = seen[at] + 1
                front.append(n)
        want |= {(s, n): d for n, d in seen.items() if d}
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want) and max(want.values()) == 12


def test_chains_in_tasks_equal_joins(spark):
    """Held graphs and joins give the same chains: relations without a name, unknown nodes, targets, nodes twice, text as ids."""
    rng = random.Random(9)
    e = [(rng.randrange(30), rng.randrange(30), rng.choice(["X", "Y", None])) for _ in range(45)] + [(3, None, "X"), (None, 3, "X")] + [(40 + i, 41 + i, "Z") for i in range(11)]
    starts, known, ends = nodes(spark, [0, 1, 2, 2, 40, 99, None]), labels(spark, [*range(20), 45]), nodes(spark, [4, 5, 47, 51, 98])
    rows = lambda **how: sorted((r["source"], r["target"], r["depth"], [(n["id"], n["label"]) for n in r["nodes"]], r["relations"]) for r in graph.shortest_chains(starts, related(spark, e), how.pop("known", known), **how).collect())
    whole = rows(most=None)
    assert whole == rows(most=None, held=0) and max(r[2] for r in whole) == 11
    assert rows(targets=ends, most=None) == rows(targets=ends, most=None, held=0) == [r for r in whole if r[1] in (4, 5, 47, 51, 98)]
    assert len(rows(known=known.union(labels(spark, [45])), most=6)) == sum(1 + (r[0] == 40 and r[1] >= 45) for r in whole if r[2] <= 6)
    text = lambda df, *names: df.select(*(F.concat(F.lit("n"), n).alias(n) if n in names else F.col(n) for n in df.columns))
    named = [graph.shortest_chains(text(starts, "id"), text(related(spark, e), "src", "dst"), text(known, "id"), held=h).select("source", "target", "nodes", "relations").collect() for h in (0, 99)]
    assert sorted(map(str, named[0])) == sorted(map(str, named[1])) and len(named[0]) == len([r for r in whole if r[2] <= 10])
    assert rows(most=0) == [] == graph.shortest_chains(starts, related(spark, e).limit(0), known).collect()


def test_search_ends_with_its_frontier(spark):
    trees, depth = graph.shortest_trees(nodes(spark, [1]), related(spark, [(1, 2, "A"), (2, 3, "A"), (3, 1, "A")]))
    assert depth == 2 and trees.count() == 3


def test_shortest_paths(spark):
    got = {r["id"]: r["depth"] for r in graph.shortest_paths(F.lit(0).cast("long"), edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (9, 0), (3, 0)])).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}


def test_degrees_and_indexes(spark):
    n, e = nodes(spark, [7, 3, 5, 9]), edges(spark, [(3, 5), (5, 3), (3, 8)])
    assert {r["id"]: r["degree"] for r in graph.degrees(n, e).collect()} == {3: 3, 5: 2, 7: 0, 9: 0}
    assert {r["id"]: r["idx"] for r in graph.dense_index(n).collect()} == {3: 0, 5: 1, 7: 2, 9: 3}
    assert sorted(map(tuple, graph.edge_index(n, e).collect())) == [(0, 1), (1, 0)]


def test_node_features(spark):
    n = spark.createDataFrame([(1, "kafkatopic", True, "BRANCHING"), (2, None, None, None)], "id long, type string, is_reactive boolean, complexity string")
    got = {r["id"]: r["features"] for r in graph.node_features(n, edges(spark, [(1, 2)])).collect()}
    assert len(got[1]) == 32 and got[1][4] == 1 and got[1][10] == 1 and got[1][11] == 1 and got[1][12] == 2 and sum(got[1]) == 5
    assert got[2][0] == 1 and got[2][10:] == [1.0] + [0.0] * 21


def test_node_types_stand_at_their_places(spark):
    order = ["Service", "Class", "Method", "Endpoint", "KafkaTopic", "Database", "Ingress", "ConfigMap", "LogTemplate", "AnomalyEpisode"]
    rows = [(i, t, False, "NONE") for i, t in enumerate([*order, "unheard of", " "])]
    got = {r["id"]: r["features"] for r in graph.node_features(spark.createDataFrame(rows, "id long, type string, is_reactive boolean, complexity string"), edges(spark, [(0, 1)])).collect()}
    assert [list(got[i][:10]).index(1) for i in range(12)] == [*range(10), 0, 0]


def test_config_references_are_uses(spark):
    n = spark.createDataFrame([(1, "Service"), (2, "ConfigMap")], "id long, label string")
    e = spark.createDataFrame([(1, 2, "CONFIG_REF"), (1, 9, "HTTP_CALL")], "src long, dst long, type string")
    assert [r["relation"] for r in graph.resolved_edges(e, n).collect()] == ["USES_CONFIG"]


def test_topics(spark):
    p = spark.createDataFrame([("t", "b"), ("t", "a"), ("u", "a")], "topic string, service string")
    c = spark.createDataFrame([("t", "c")], "topic string, service string")
    got = {r["topic"]: (r["producers"], r["consumers"]) for r in graph.topic_connections(p, c).collect()}
    assert got == {"t": (["a", "b"], ["c"]), "u": (["a"], [])}
    assert [r["flow_id"] for r in flows.topic_candidates(graph.topic_connections(p, c)).collect()] == ["kafka-t"]


def test_graph_build(spark):
    n = spark.createDataFrame([("svc:a", "Service", "a"), ("svc:b", "Service", "b"), ("svc:b", "Service", "b")], "id string, label string, name string")
    e = spark.createDataFrame([("svc:a", "svc:b", "HTTP_CALL"), ("topic:t", "svc:b", "KAFKA_CONSUME"), ("svc:a", "db:d", "DATABASE_CONNECT"), ("svc:a", "host:x", "HTTP_CALL")], "src string, dst string, type string")
    c = spark.createDataFrame([("a", "p.A", "A", ["B"]), ("b", "p.B", "B", [])], "service_name string, fqn string, simple_name string, field_types array<string>")
    found_nodes, found_edges = graph.build_graph(n, e, c)
    assert {r["id"]: r["label"] for r in found_nodes.collect()} == {"svc:a": "Service", "svc:b": "Service", "topic:t": "KafkaTopic", "db:d": "Database", "class:p.A": "Class", "class:p.B": "Class"}
    assert {tuple(r) for r in found_edges.collect()} == {
        ("svc:a", "svc:b", "CALLS_HTTP"), ("svc:b", "topic:t", "CONSUMES_FROM"), ("svc:a", "db:d", "CONNECTS_TO"), ("svc:a", "class:p.A", "CONTAINS_CLASS"), ("svc:b", "class:p.B", "CONTAINS_CLASS"), ("class:p.A", "class:p.B", "INJECTS"),
    }


def test_links_exceed_the_threshold(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7, 0.0]), (3, [0.9, 0.9]), (4, [0.0, 1.0])], "id long, embedding array<double>")
    assert {(r["a"], r["b"]) for r in graph.link_scores(v, 0.7, block=2).collect()} == {(1, 3), (3, 4)}


def test_argmax_and_classes(spark):
    v = spark.createDataFrame([(1, [0.1, 0.9, 0.9]), (2, [0.0] * 9 + [1.0])], "id long, embedding array<double>")
    assert {r["id"]: r["pattern"] for r in graph.classified(v).collect()} == {1: "ORCHESTRATOR", 2: "MIDDLEWARE"}
    assert v.select(vectors.argmax(F.col("embedding")).alias("a")).first()["a"] == 1


@pytest.mark.parametrize("services, is_async, reactive, level", [(list("abcde"), False, False, "VERY_HIGH"), (["a"], True, True, "VERY_HIGH"), (list("abc"), False, True, "HIGH"), (list("ab"), False, False, "MEDIUM"), (list("aa"), False, False, "LOW")])
def test_flow_complexity(spark, services, is_async, reactive, level):
    df = spark.createDataFrame([(services, is_async, reactive)], "s array<string>, a boolean, r boolean")
    assert df.select(flows.complexity(F.col("s"), F.col("a"), F.col("r")).alias("x")).first()["x"] == level


@pytest.mark.parametrize("given, score", [((0, 0, 0, False), 0), ((4, 0, 0, False), 0.4), ((90, 0, 0, False), 0.4), ((90, 90, 90, True), 1.0), ((1, 2, 1, True), 0.45)])
def test_flow_confidence(spark, given, score):
    assert spark.range(1).select(flows.confidence(*map(F.lit, given)).alias("x")).first()["x"] == pytest.approx(score)


def test_steps(spark):
    f = spark.createDataFrame([("h", ["a", "b"], False), ("k", ["a", "b"], True)], "flow_id string, services array<string>, is_async boolean")
    assert [tuple(r) for r in flows.steps(f).orderBy("flow_id", "step").collect()] == [("h", 1, "a", "HTTP_ENDPOINT"), ("h", 2, "b", "HTTP_CLIENT_CALL"), ("k", 1, "a", "KAFKA_PRODUCE"), ("k", 2, "b", "KAFKA_CONSUME")]


def test_greedy_merge_equals_one_by_one(spark):
    import random

    rng = random.Random(1)
    rows = [(f"f{i:03}", rng.sample("abcdefghij", rng.randint(0, 5))) for i in range(80)]
    got = {r["flow_id"] for r in flows.merged(spark.createDataFrame(rows, "flow_id string, services array<string>")).collect()}
    stayed = []
    for name, s in sorted(rows):
        if s and all(len(set(s) & set(t)) < 0.7 * min(len(s), len(t)) for _, t in stayed):
            stayed.append((name, s))
    assert got == {n for n, _ in stayed}


def test_evidence_query(spark):
    f = spark.createDataFrame([("h", ["a", "b", "a"], 3), ("g", ["a"] * 5, 5)], "flow_id string, services array<string>, n_steps int")
    assert {r["query_id"]: (r["query"], r["top_k"]) for r in flows.evidence_query(f).collect()} == {"h": ("a b", 10), "g": ("a", 15)}


def test_overlaps_by_prefixes(spark):
    rng = random.Random(9)
    rows = [(f"f{i:03}", ["gateway"] + [f"s{rng.randrange(400)}" for _ in range(rng.randint(1, 9))]) for i in range(300)]
    rows += [(f"g{i}", [*rows[i][1][:-1], "extra", "extra"]) for i in range(40)] + [("none", []), ("only", ["gateway"]), ("same", rows[5][1])]
    df = spark.createDataFrame(rows, "flow_id string, services array<string>")
    want = []
    for i, (a, x) in enumerate(sorted(rows)):
        for b, y in sorted(rows)[i + 1 :]:
            x1, y1 = set(x), set(y)
            if x1 and y1 and len(x1 & y1) >= flows.OVERLAP * min(len(x1), len(y1)):
                want.append((a, b, len(x1 & y1)))
    assert sorted(map(tuple, flows.overlapping_pairs(df).collect())) == sorted(want) and len(want) > 340
    # every flow has the gateway: over 58,000 pairs share it, few of them are made
    assert flows.candidate_pairs(df).count() < 4000


def test_links_of_block_pairs(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    want = {(i, j) for i, x in rows for j, y in rows if i < j and sum(p * q for p, q in zip(x, y, strict=True)) > 0.7}
    assert {(r["a"], r["b"]) for r in graph.link_scores(v, 0.7, block=13).collect()} == want


def test_links_by_products_of_blocks(spark):
    """No pair passes the JVM row by row, and odd vectors score as they did one by one."""
    rng = random.Random(5)
    odd = [(100, None), (101, [1.0, None, 2.0, 1.0]), (102, [2.0]), (103, []), (104, [float("inf"), 1.0, 0.0, 1.0]), (105, [float("nan"), 0.0, 0.0, 0.0]), (106, [1.0, 5.0]), (None, [9.0] * 4), (107, [0.7, 0.0, 0.0, 0.0]), (108, [1.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + odd, "id long, embedding array<double>")
    a, b = v.toDF("a", "va"), v.toDF("b", "vb")
    dots = a.join(b, F.col("a") < F.col("b")).withColumn("score", vectors.dot(F.col("va"), F.col("vb")))
    want = sorted(str(tuple(r)) for r in dots.where("score > 0.7").select("a", "b", "score").collect())
    found = graph.link_scores(v, 0.7, block=7)
    assert sorted(str(tuple(r)) for r in found.collect()) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
