"""Queries over the call graph, topics and the code hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import flows, graph, projections, relational, retrieval
from tracewright.plans.adapters import EDGES_SQL, TOPICS_SQL, edges, frame, sql, topics

GE = f"with recursive {EDGES_SQL}, {sql('gn')}"
STARTS = "st as (select id from gn where has_endpoint and id not in (select dst from ge))"


def entries(spark, sf):
    return graph.entry_points(frame(spark, sf, "gn").where("has_endpoint"), edges(spark, sf))


def uncalled(spark, sf):
    return graph.entry_points(frame(spark, sf, "gn"), edges(spark, sf))


def chains(depth):
    def run(spark, sf):
        return graph.call_chains(uncalled(spark, sf), edges(spark, sf), depth).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "hops")

    return run


def walks(depth: int) -> str:
    return f"""{GE}, w as (select src at_, dst, cast(src as varchar) || '>' || dst path, '|' || src || '>' || dst || '|' used, 1 hops from ge where src in (select id from gn where id not in (select dst from ge))
union all select w.at_, ge.dst, w.path || '>' || ge.dst, w.used || ge.src || '>' || ge.dst || '|', w.hops + 1 from w join ge on w.dst = ge.src where w.hops < {depth} and not contains(w.used, '|' || ge.src || '>' || ge.dst || '|'))"""


def related(spark, sf):
    """The call graph's edges with the relation of their kind, and its nodes with their label."""
    typed = edges(spark, sf).selectExpr("src", "dst", f"{EDGE_KIND} as type")
    nodes = frame(spark, sf, "gn").selectExpr("id", "type as label")
    return graph.resolved_edges(typed, nodes).select("src", "dst", "relation"), nodes


EDGE_KIND = "case when src % 2 = 0 then 'HTTP_CALL' when src % 3 = 0 then 'KAFKA_PRODUCE' when src % 5 = 0 then 'CONFIG_REF' else 'OTHER' end"
RELATED = "re as (select src, dst, case when src % 2 = 0 then 'CALLS_HTTP' when src % 3 = 0 then 'PRODUCES_TO' when src % 5 = 0 then 'USES_CONFIG' else 'OTHER' end relation from ge where src in (select id from gn) and dst in (select id from gn))"


def neighborhood(spark, sf):
    of, nodes = related(spark, sf)
    return graph.neighborhood(nodes.select("id"), of, nodes, 2)


NEIGHBORS = f"""{GE}, {RELATED}, un as (select src, dst, relation, src || '-' || dst || '-' || relation e from re union all select dst, src, relation, src || '-' || dst || '-' || relation from re),
one as (select src id, dst n, relation, e from un), two as (select one.id, un.dst n, un.relation from one join un on one.n = un.src and one.e <> un.e)
select distinct x.id, n neighbor, relation, type as label from (select id, n, relation from one union all select id, n, relation from two) x join gn on gn.id = n where x.id <> n"""


def topology_documents(spark, sf):
    of, nodes = related(spark, sf)
    named = nodes.select("id", "label", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    return projections.topology_documents(named, of, "s1", F.lit("2024-01-01").cast("timestamp"))


TOPOLOGY = f"""{GE}, {RELATED} select 's1' snapshot_id, 'n' || id service_name, 'topology/node/' || id file_path, 'topology-node' artifact_type, cast(to_json({{'id': id, 'label': type, 'name': 'n' || id}}) as varchar) as content, '2024-01-01T00:00:00.000000Z' indexed_at from gn
union all select 's1', cast(src as varchar), 'topology/edge/' || src || '-' || dst, 'topology-edge', cast(to_json({{'src': src, 'dst': dst, 'relation': relation}}) as varchar), '2024-01-01T00:00:00.000000Z' from re"""


def chain(spark, sf):
    """From every node that exposes an endpoint and that nobody calls, to all that it reaches in any number of hops."""
    of, nodes = related(spark, sf)
    found = graph.shortest_chains(entries(spark, sf), of, nodes, most=None)
    path = F.array_join(F.transform("nodes", lambda n: F.concat_ws(":", n["label"], n["id"].cast("string"))), ">")
    return found.select("source", "target", "depth", path.alias("path"), F.array_join("relations", ">").alias("relations"))


CHAIN = f"""{GE}, {STARTS}, {RELATED}, m(source, id, depth) using key (source, id) as (select id, id, 0 from st union select m.source, re.dst, m.depth + 1 from m join re on m.id = re.src where not exists (from recurring.m v where v.source = m.source and v.id = re.dst)),
b as (select m.source, m.id, min({{'p': re.src, 'r': re.relation}}) x from m join re on re.dst = m.id join m u on u.source = m.source and u.id = re.src and u.depth = m.depth - 1 group by all),
w as (select source, m.id target, m.id at_, depth, type || ':' || m.id path, '' relations from m join gn on gn.id = m.id where depth > 0
union all select w.source, w.target, x.p, w.depth, type || ':' || x.p || '>' || path, x.r || case when relations = '' then '' else '>' end || relations from w join b on b.source = w.source and b.id = w.at_ join gn on gn.id = x.p)
select source, target, cast(depth as int) depth, path, relations from w where at_ = source"""


def shortest(spark, sf):
    return graph.shortest_paths(F.lit(0).cast("long"), edges(spark, sf), 10)


SHORTEST = f"{GE}, r as (select cast(0 as bigint) id, 0 depth union select ge.dst, r.depth + 1 from r join ge on r.id = ge.src where r.depth < 10) select id, cast(min(depth) as int) depth from r group by id"


def degree(spark, sf):
    return graph.degrees(frame(spark, sf, "gn").select("id"), edges(spark, sf))


def index(spark, sf):
    return graph.edge_index(frame(spark, sf, "gn"), edges(spark, sf))


def features(spark, sf):
    out = graph.node_features(frame(spark, sf, "gn"), edges(spark, sf))
    return out.select("id", F.array_join(F.transform("features", lambda x: x.cast("int").cast("string")), ",").alias("features"))


FEATURES = f"""{GE}, dg as (select id, count(*) d from (select src id from ge union all select dst from ge) group by all),
f as (select gn.id, list_transform(range(10), lambda i: case when i = case type when 'Service' then 0 when 'KafkaTopic' then 4 when 'Class' then 1 when 'AnomalyEpisode' then 9 else 2 end then 1 else 0 end) h, coalesce(d, 0) d, cast(is_reactive as int) r, case complexity when 'LINEAR' then 1 when 'BRANCHING' then 2 when 'COMPLEX' then 3 else 0 end c from gn left join dg on gn.id = dg.id)
select id, array_to_string(list_transform(h || [d, r, c] || list_transform(range(19), lambda i: 0), lambda x: cast(x as varchar)), ',') features from f"""


def connections(spark, sf):
    return graph.topic_connections(topics(spark, sf, "A"), topics(spark, sf, "R"))


def joined(df):
    return df.select("topic", F.array_join("producers", ",").alias("producers"), F.array_join("consumers", ",").alias("consumers"))


CONNECTIONS = f"with {TOPICS_SQL}, c as (select coalesce(p.topic, r.topic) topic, coalesce(p.l, '') producers, coalesce(r.l, '') consumers, coalesce(p.n, 0) + coalesce(r.n, 0) n, p.n pn, r.n rn from (select topic, string_agg(service, ',' order by service) l, count(*) n from tp where f = 'A' group by all) p full join (select topic, string_agg(service, ',' order by service) l, count(*) n from tp where f = 'R' group by all) r on p.topic = r.topic)"


def topic_flows(spark, sf):
    return flows.topic_candidates(connections(spark, sf)).select("flow_id", F.array_join("services", ",").alias("services"), F.col("n_steps").cast("long").alias("n_steps"))


def code_tables(spark, sf):
    """Nations as services, suppliers as classes, parts that they delivered as methods."""
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    services = read("nation").selectExpr("n_nationkey", "n_name as service")
    classes = read("supplier").join(F.broadcast(services), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("service", "s_suppkey", "s_name as class")
    methods = read("lineitem").select("l_suppkey", "l_partkey").distinct().join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = "case when p_size < 20 then 'NONE' when p_size < 35 then 'LINEAR' when p_size < 45 then 'BRANCHING' else 'COMPLEX' end"
    methods = methods.join(classes, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr("class", "p_name as method", "'/' || lower(p_type) as path", f"{kind} as complexity")
    return services.select("service"), classes.select("service", "class"), methods


CODE = "cd as (select n_name service, s_name class, p_name method, '/' || lower(p_type) path, case when p_size < 20 then 'NONE' when p_size < 35 then 'LINEAR' when p_size < 45 then 'BRANCHING' else 'COMPLEX' end complexity from nation join supplier on s_nationkey = n_nationkey join (select distinct l_suppkey, l_partkey from lineitem) on l_suppkey = s_suppkey join part on l_partkey = p_partkey)"


def endpoints(spark, sf):
    return graph.hierarchy(*code_tables(spark, sf)).select("service", "path").distinct()


def search(spark, sf):
    found = graph.hierarchy(*code_tables(spark, sf)).select("service", "class", "method").distinct()
    return relational.search(found, ["service", "class", "method"], "RED", 50, ["service", "class", "method"])


def complex_methods(spark, sf):
    rows = graph.hierarchy(*code_tables(spark, sf)).where(F.col("complexity").isin("BRANCHING", "COMPLEX"))
    return rows.select("service", "class", "method", "complexity")


def candidates(spark, sf):
    return flows.http_candidates(graph.call_chains(uncalled(spark, sf), edges(spark, sf), 3))


def complexity(spark, sf):
    rows = candidates(spark, sf)
    reactive = F.exists("services", lambda s: s.cast("long") % 2 == 0)
    return rows.select(F.array_join("services", ">").alias("path"), flows.complexity(F.col("services"), F.col("is_async"), reactive).alias("complexity"))


def confidence(spark, sf):
    rows = candidates(spark, sf).select(F.array_join("services", ">").alias("path"), F.get("services", 0).cast("long").alias("a"), "n_steps")
    return rows.select("path", flows.confidence(F.col("a") % 6, F.col("n_steps"), F.col("a") % 3, F.lit(True)).alias("confidence"))


def overlaps(spark, sf):
    rows = candidates(spark, sf).select(F.array_join("services", ">").alias("flow_id"), "services")
    return flows.overlapping_pairs(rows)


OVERLAPS = f"""{walks(3)}, sv as (select path, unnest(list_distinct(string_split(path, '>'))) s from w), z as (select path, count(*) n from sv group by all),
p as (select x.path a, y.path b, count(*) shared from sv x join sv y on x.s = y.s and x.path < y.path group by all)
select a, b, shared from p join z za on za.path = a join z zb on zb.path = b where shared >= 0.7 * least(za.n, zb.n)"""


def merged(spark, sf):
    return flows.merged(candidates(spark, sf))


#: One by one, in order of flow_id: a flow is kept unless a kept one overlaps it.
MERGED = f"""{walks(3)}, fl as (select 'http-' || substring(sha256(path), 1, 16) id, list_distinct(string_split(path, '>')) s from w), o as (select id, row_number() over (order by id) i from fl),
sv as (select id, len(s) n, unnest(s) x from fl), pr as (select x.id a, y.id b from sv x join sv y on x.x = y.x and x.id < y.id group by x.id, y.id, x.n, y.n having count(*) >= 0.7 * least(x.n, y.n)),
nb as (select o.i, o.id, list(pr.a) filter (pr.a is not null) smaller from o left join pr on pr.b = o.id group by all),
g as (select cast(0 as bigint) i, cast([] as varchar[]) kept union all select g.i + 1, case when list_has_any(g.kept, coalesce(nb.smaller, [])) then g.kept else list_append(g.kept, nb.id) end from g join nb on nb.i = g.i + 1)
select unnest(kept) flow_id from g where i = (select max(i) from o)"""


def flow_steps(spark, sf):
    rows = candidates(spark, sf).select(F.array_join("services", ">").alias("flow_id"), "services", "is_async")
    return flows.steps(rows).select("flow_id", F.col("step").cast("long").alias("step"), "service", "kind")


STEPS = f"{walks(3)}, s as (select path, string_split(path, '>') l from w) select path flow_id, i step, l[i] service, case when i = 1 then 'HTTP_ENDPOINT' else 'HTTP_CLIENT_CALL' end kind from s, unnest(range(1, len(l) + 1)) r(i)"


def evidence(spark, sf):
    rows = candidates(spark, sf).select(F.array_join("services", ">").alias("flow_id"), "services", "n_steps")
    return flows.evidence_query(rows).select("query_id", F.col("top_k").cast("long").alias("top_k"))


def resolved(spark, sf):
    """Call edges whose ends are known nodes of a label, as relations."""
    nodes = frame(spark, sf, "gn").selectExpr("id", "type as label").where("label <> 'KafkaTopic'")
    typed = edges(spark, sf).selectExpr("src", "dst", "case when src % 2 = 0 then 'HTTP_CALL' when src % 3 = 0 then 'KAFKA_PRODUCE' when src % 5 = 0 then 'CONFIG_REF' else 'OTHER' end as type")
    return graph.resolved_edges(typed, nodes).select("src", "dst", "src_label", "dst_label", "relation")


RESOLVED = f"""{GE} select src, dst, a.type src_label, b.type dst_label, case when src % 2 = 0 then 'CALLS_HTTP' when src % 3 = 0 then 'PRODUCES_TO' when src % 5 = 0 then 'USES_CONFIG' else 'OTHER' end relation
from ge join gn a on src = a.id and a.type <> 'KafkaTopic' join gn b on dst = b.id and b.type <> 'KafkaTopic'"""


def context_documents(spark, sf):
    """Context documents of each service: classes as neighbours, paths as endpoints, complex methods."""
    services, classes, methods = code_tables(spark, sf)
    rows = graph.hierarchy(services, classes, methods)
    return retrieval.graph_documents(classes.selectExpr("service", "class as neighbor"), rows.select("service", "path"), rows.select("service", "method", "complexity"))


def context(spark, sf):
    return context_documents(spark, sf).select("service", "score", F.sha2("content", 256).alias("content_hash"))


CONTEXT_TABLES = f"""{CODE}, n as (select distinct n_name service, s_name x from nation join supplier on s_nationkey = n_nationkey), e as (select distinct service, path x from cd), m as (select distinct service, method x from cd where complexity in ('BRANCHING', 'COMPLEX')),
d as (select service, 1.0 score, 'Neighbors: ' || string_agg(x, ', ' order by x) c from n group by all union all select service, 0.9, 'Endpoints: ' || string_agg(x, ', ' order by x) from e group by all union all select service, 0.7, 'Complex methods: ' || string_agg(x, ', ' order by x) from m group by all)"""
CONTEXT = f"with {CONTEXT_TABLES} select service, cast(score as double) score, sha256(c) content_hash from d"


QUERIES = {
    "flow_steps": (flow_steps, STEPS),
    "evidence_queries": (evidence, f"{walks(3)}, s as (select path, string_split(path, '>') l from w) select path query_id, greatest(10, 3 * len(l)) top_k from s"),
    "resolved_edges": (resolved, RESOLVED),
    "topology_documents": (topology_documents, TOPOLOGY),
    "graph_context_documents": (context, CONTEXT),
    "entry_points": (entries, f"{GE}, {STARTS} select id from st"),
    "call_chains_3": (chains(3), f"{walks(3)} select path, cast(hops as int) hops from w"),
    "call_chains_5": (chains(5), f"{walks(5)} select path, cast(hops as int) hops from w"),
    "neighborhood_2hop": (neighborhood, NEIGHBORS),
    "shortest_paths": (shortest, SHORTEST),
    "shortest_chain": (chain, CHAIN),
    "node_degree": (degree, f"{GE} select gn.id, coalesce(n, 0) degree from gn left join (select id, count(*) n from (select src id from ge union all select dst from ge) group by all) d on gn.id = d.id"),
    "edge_index": (index, f"{GE}, ix as (select id, row_number() over (order by id) - 1 i from gn) select a.i src_idx, b.i dst_idx from ge join ix a on src = a.id join ix b on dst = b.id"),
    "graph_node_features": (features, FEATURES),
    "topic_connections": (lambda s, d: joined(connections(s, d)), f"{CONNECTIONS} select topic, producers, consumers from c"),
    "topic_flows": (topic_flows, f"{CONNECTIONS} select 'kafka-' || topic flow_id, producers || ',' || consumers services, n n_steps from c where pn is not null and rn is not null"),
    "service_endpoints": (endpoints, f"with {CODE} select distinct service, path from cd"),
    "endpoint_search": (search, f"with {CODE} select distinct service, class, method from cd where lower(service) like '%red%' or lower(class) like '%red%' or lower(method) like '%red%' order by 1, 2, 3 limit 50"),
    "complex_methods": (complex_methods, f"with {CODE} select service, class, method, complexity from cd where complexity in ('BRANCHING', 'COMPLEX')"),
    "flow_complexity": (complexity, f"{walks(3)}, f as (select path, list_distinct(string_split(path, '>')) s from w) select path, case when len(s) >= 5 then 'VERY_HIGH' when len(s) >= 3 then 'HIGH' when len(s) >= 2 then 'MEDIUM' else 'LOW' end complexity from f"),
    "flow_confidence": (confidence, f"{walks(3)} select path, round(least(1.0, least(0.4, (at_ % 6) * 0.1) + least(0.2, (hops + 1) * 0.05) + least(0.3, (at_ % 3) * 0.15) + 0.1), 6) confidence from w"),
    "flow_overlap_pairs": (overlaps, OVERLAPS),
    "flow_merge_greedy": (merged, MERGED),
}
