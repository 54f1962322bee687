"""Property-graph operators over node and edge tables.

edges: (src, dst); nodes: (id, ...). Walks are unrolled joins on the edge's source, with the path's
edges carried along, so each hop is one shuffle join and no path uses an edge twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text, vectors
from tracewright.operators import names
from tracewright.session import ship
from tracewright.sources.files import written

#: Node types in one-hot order (fixed values).
NODE_TYPES = ("Service", "Class", "Method", "Endpoint", "KafkaTopic", "Database", "Ingress", "ConfigMap", "LogTemplate", "AnomalyEpisode")
#: Interaction patterns in class order (fixed values).
PATTERNS = ("GATEWAY", "ORCHESTRATOR", "WORKER", "DATA_STORE_CONNECTOR", "EVENT_PRODUCER", "EVENT_CONSUMER", "MIDDLEWARE")
#: Relations of topology edge types (fixed values).
RELATIONS = {"HTTP_CALL": "CALLS_HTTP", "KAFKA_PRODUCE": "PRODUCES_TO", "KAFKA_CONSUME": "CONSUMES_FROM", "DATABASE_CONNECT": "CONNECTS_TO", "CONFIG_REF": "USES_CONFIG", "INGRESS_ROUTE": "INGRESS_ROUTE", "SERVICE_DEPENDENCY": "SERVICE_DEPENDENCY"}
LINK_THRESHOLD = 0.7
#: Edges of a graph that a task may hold whole.
HELD_EDGES = 1_000_000


def entry_points(endpoints: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) that expose an endpoint and that nobody calls."""
    return endpoints.select("id").distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def call_chains(starts: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(path, hops) of every walk of 1 .. depth edges from the starts (id), edges used once at most."""
    depth = min(10, max(1, depth))
    mark = F.concat(F.col("src").cast("string"), F.lit(">"), F.col("dst").cast("string"))
    e = edges.select("src", "dst", mark.alias("edge"))
    walk = starts.select(F.col("id").alias("at"), F.array(F.col("id")).alias("path"), F.array().cast("array<string>").alias("used"))
    found = None
    for hop in range(1, depth + 1):
        walk = walk.join(e, F.col("at") == F.col("src")).where(~F.array_contains("used", F.col("edge"))).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array("edge")).alias("used"))
        part = walk.select("path", F.lit(hop).alias("hops"))
        found = part if found is None else found.unionByName(part)
    return found


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()


def neighborhood(starts: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 2) -> DataFrame:
    """(id, neighbor, relation, label) within so many undirected hops by walks that use no edge twice: the
    relation of the walk's last edge and the neighbor's label; not itself. edges: src, dst, relation;
    nodes: id, label."""
    mark = F.concat_ws("-", "src", "dst", "relation")
    both = edges.select("src", "dst", "relation", mark.alias("e")).union(edges.select(F.col("dst"), F.col("src"), "relation", mark))
    walk = starts.select("id", F.col("id").alias("at"), F.array().cast("array<string>").alias("used"))
    found = None
    for _ in range(hops):
        reached = walk.join(both, F.col("at") == F.col("src")).where(~F.array_contains("used", F.col("e")))
        part = reached.select("id", F.col("dst").alias("neighbor"), "relation")
        walk = reached.select("id", F.col("dst").alias("at"), F.concat("used", F.array("e")).alias("used"))
        found = part if found is None else found.union(part)
    labels = nodes.select(F.col("id").alias("neighbor"), "label")
    return found.where("id <> neighbor").distinct().join(labels, "neighbor", "left").select("id", "neighbor", "relation", "label")


def shortest_layers(starts: DataFrame, edges: DataFrame, most: int | None = 10) -> list[DataFrame]:
    """(source, id, parent, relation, depth) by depth, each a written table: a search from all starts at once. Each round joins the
    frontier with the edges, keeps for each new node the least (parent, relation), drops what was visited and writes the rest; it
    ends when nothing is new. What was visited is written together every eight rounds, so plans stay short over long chains."""
    steps = written(edges.groupBy("src", "dst").agg(F.min("relation").alias("relation")))
    kind = edges.schema["src"].dataType
    front = written(starts.select(F.col("id").alias("source"), "id", F.lit(None).cast(kind).alias("parent"), F.lit(None).cast("string").alias("relation"), F.lit(0).alias("depth")).distinct())
    layers, seen = [front], front.select("source", "id")
    while most is None or len(layers) <= most:
        reached = front.select("source", F.col("id").alias("src")).join(steps, "src")
        best = reached.groupBy("source", F.col("dst").alias("id")).agg(F.min(F.struct("src", "relation")).alias("by"))
        new = best.join(seen, ["source", "id"], "left_anti")
        front = written(new.select("source", "id", F.col("by.src").alias("parent"), "by.relation", F.lit(len(layers)).alias("depth")))
        if front.isEmpty():
            break
        layers.append(front)
        seen = seen.union(front.select("source", "id"))
        if len(layers) % 8 == 0:
            seen = written(seen)
    return layers


def shortest_trees(starts: DataFrame, edges: DataFrame, most: int | None = 10) -> tuple[DataFrame, int]:
    """(source, id, parent, relation, depth) of every node within `most` hops (None: any number) of each start (id), and the depth
    reached. A lost executor costs one round."""
    layers = shortest_layers(starts, edges, most)
    return reduce(DataFrame.unionByName, layers), len(layers) - 1


def held_graph(steps: DataFrame, nodes: DataFrame, wanted: DataFrame | None):
    """The graph as sorted arrays: ids, labels, relations, whether a node is wanted; each edge's ends and relation as places in
    them (-1: none), where each node's edges begin, and the bytes of the longest value. None if a node has two rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    labels = nodes.groupBy("id").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    rows = steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct().join(labels, "id", "left")
    rows = rows.withColumn("wanted", F.lit(True)) if wanted is None else rows.join(wanted.withColumn("wanted", F.lit(True)), "id", "left")
    table, pairs = (t.combine_chunks() for t in (rows.orderBy("id").toArrow(), steps.orderBy("src", "dst").toArrow()))
    whole = lambda t, c: pa.concat_arrays(t[c].chunks) if t[c].chunks else pa.array([], t[c].type)
    if pc.any(pc.greater(table["n"], 1)).as_py():
        return None
    ids, label, relation = whole(table, "id"), whole(table, "label"), whole(pairs, "relation").dictionary_encode()
    src, dst = (pc.index_in(whole(pairs, c), value_set=ids).to_numpy() for c in ("src", "dst"))
    widest = max((pc.max(pc.binary_length(a)).as_py() or 0 for a in (ids, label, relation.dictionary) if pa.types.is_string(a.type)), default=0)
    by, ends = relation.indices.fill_null(-1).to_numpy(), whole(table, "wanted").fill_null(False).to_numpy(zero_copy_only=False)
    return ids, label, relation.dictionary, ends, src, dst, by, np.searchsorted(src, np.arange(len(ids) + 1)), widest


def chains_in_tasks(starts: DataFrame, graph, most: int | None, schema: str) -> DataFrame:
    """Chains from a held graph: each task searches from its starts, one after the other, and follows the parents back for
    as many targets at a time as fit some megabytes. Nothing is shuffled but the starts."""
    spark = starts.sparkSession
    ship(spark)
    starts = written(starts.select("id").where("id is not null").distinct())
    held = spark.sparkContext.broadcast(graph)

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, labels, names_, ends, src, dst, by, begin, widest = held.value
        room = (4 << 20) // (16 + widest)
        seen, last = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)  # last: the edge by which a node was reached

        def search(start):  # nodes in order of depth, and their depths
            front, found = np.array([start]), []
            seen[start] = True
            while len(front) and (most is None or len(found) < most):
                width = begin[front + 1] - begin[front]
                edge = np.repeat(begin[front] - np.cumsum(width) + width, width) + np.arange(width.sum())
                edge = edge[~seen[dst[edge]]]  # in order of src: the first to reach a node is its least predecessor
                front, first = np.unique(dst[edge], return_index=True)
                last[front], seen[front] = edge[first], True
                found.append(front)
            reached = np.concatenate([front[:0], *found])
            seen[reached] = seen[start] = False
            return reached, np.repeat(np.arange(1, len(found) + 1), [len(f) for f in found])

        def rows(start, at, depth):
            top, end = np.cumsum(depth + 1), np.cumsum(depth)
            chain, relation, source = np.empty(top[-1], np.int64), np.empty(end[-1], np.int64), np.full(len(at), start)
            target, at = at, at.copy()
            for hop in range(depth[-1] + 1):
                k, more = np.searchsorted(depth, [hop, hop + 1])
                chain[top[k:] - 1 - hop] = at[k:]
                edge = last[at[more:]]
                relation[end[more:] - 1 - hop] = by[edge]
                at[more:] = src[edge]
            known = relation >= 0
            upto = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], end])]
            node = pa.StructArray.from_arrays([ids.take(pa.array(chain)), labels.take(pa.array(chain))], ["id", "label"])
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in ((np.concatenate([[0], top]), node), (upto, names_.take(pa.array(relation[known]))))]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(source)), ids.take(pa.array(target)), pa.array(depth, pa.int32()), *lists], ["source", "target", "depth", "nodes", "relations"])

        for batch in batches:
            for start in pc.index_in(batch.column(0), value_set=ids).drop_null().to_pylist():
                reached, depth = search(start)
                reached, depth = reached[ends[reached]], depth[ends[reached]]
                cells, done = np.cumsum(depth + 1), 0
                while done < len(reached):
                    upto = max(done + 1, int(np.searchsorted(cells, (cells[done - 1] if done else 0) + room, "right")))
                    yield rows(start, reached[done:upto], depth[done:upto])
                    done = upto

    tasks = min(2000, max(spark.sparkContext.defaultParallelism, -(-starts.count() // 16)))
    return starts.repartition(tasks).mapInArrow(work, schema)


def shortest_chains(starts: DataFrame, edges: DataFrame, nodes: DataFrame, targets: DataFrame | None = None, most: int | None = 10, held: int = HELD_EDGES) -> DataFrame:
    """(source, target, depth, nodes, relations): a shortest directed chain of at most `most` hops (None: of any length) from each
    start to each target (id; without targets: to all that it reaches), its nodes as (id, label) and its edges' relations in order. Of equal
    chains, each node's least predecessor counts. A graph of up to `held` edges is searched whole in each task. In a larger one
    chains grow by depth: each node's is its parent's with one step more, so a chain is moved once for each depth's join with
    the next, not once a hop. With targets, what leads to none is dropped first."""
    edges = written(edges.groupBy("src", "dst").agg(F.min("relation").alias("relation")).where("src is not null and dst is not null"))
    wanted = None if targets is None else targets.select("id").distinct()
    kinds = {edges.schema["src"].dataType, edges.schema["dst"].dataType, *(t.schema["id"].dataType for t in (starts, nodes, targets) if t is not None)}
    kind = edges.schema["src"].dataType.simpleString()
    if len(kinds) == 1 and kind in ("int", "bigint", "string") and edges.count() <= held:
        arrays = held_graph(edges, nodes, wanted)
        if arrays is not None:
            return chains_in_tasks(starts, arrays, most, f"source {kind}, target {kind}, depth int, nodes array<struct<id:{kind},label:string>>, relations array<string>")
    layers = [layer.select("source", "id", "parent", "relation") for layer in shortest_layers(starts, edges, most)]
    deepest = len(layers) - 1
    if wanted is not None:
        for d in range(deepest, 0, -1):
            ends = layers[d].join(wanted, "id", "left_semi").select("source", "id")
            below = layers[d + 1].select("source", F.col("parent").alias("id")) if d < deepest else ends.limit(0)
            layers[d] = written(layers[d].join(ends.union(below).distinct(), ["source", "id"], "left_semi"))
    labels = nodes.select("id", "label")
    node = F.array(F.struct("id", "label"))
    front = layers[0].join(labels, "id", "left").select("source", F.col("id").alias("target"), node.alias("nodes"), F.array().cast("array<string>").alias("relations"))
    found = front.select("source", "target", F.lit(0).alias("depth"), "nodes", "relations").limit(0)
    for d in range(1, deepest + 1):
        before = front.select("source", F.col("target").alias("parent"), F.col("nodes").alias("__nodes"), "relations")
        longer = layers[d].join(labels, "id", "left").join(before, ["source", "parent"])
        front = longer.select("source", F.col("id").alias("target"), F.concat("__nodes", node).alias("nodes"), F.concat("relations", F.when(F.col("relation").isNotNull(), F.array("relation")).otherwise(F.array().cast("array<string>"))).alias("relations"))
        if d < deepest:
            front = written(front)
        found = found.unionByName(front.withColumn("depth", F.lit(d)))
    return found if wanted is None else found.join(wanted.withColumnRenamed("id", "target"), "target", "left_semi").select(*found.columns)


def shortest_paths(source: Column, edges: DataFrame, most: int = 10) -> DataFrame:
    """(id, depth) of what is reached from the source within `most` hops. One plan: each hop's distinct
    frontier (at most all nodes) meets the edges, whose exchange all hops share; least depths at the end."""
    edges = edges.select("src", "dst").distinct()
    front = edges.sparkSession.range(0, 1, 1, 1).select(source.alias("id"))
    found = front.select("id", F.lit(0).alias("depth"))
    for depth in range(1, most + 1):
        front = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        found = found.unionByName(front.select("id", F.lit(depth).alias("depth")))
    return found.groupBy("id").agg(F.min("depth").alias("depth"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes + degree in both directions, 0 without edges."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def dense_index(nodes: DataFrame) -> DataFrame:
    """nodes + idx from 0 in order of id: counts of range partitions give each its offset, so that no
    task sees all nodes."""
    parts = written(nodes.repartitionByRange("id").sortWithinPartitions("id").withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("__part").agg(F.count("*").alias("__c")).select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    return parts.join(offsets, "__part").withColumn("idx", F.col("__before") + F.col("__at") - F.shiftleft(F.col("__part"), 33)).drop("__at", "__part", "__before")


def edge_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_idx, dst_idx); edges with an unknown end are left out."""
    idx = dense_index(nodes.select("id"))
    a, b = idx.select(F.col("id").alias("src"), F.col("idx").alias("src_idx")), idx.select(F.col("id").alias("dst"), F.col("idx").alias("dst_idx"))
    return edges.join(a, "src").join(b, "dst").select("src_idx", "dst_idx")


def node_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, features of 32): type one-hot, degree, isReactive, complexity ordinal. nodes: id, type,
    is_reactive, complexity."""
    hot = F.greatest(F.array_position(F.array(*(F.lit(t.lower()) for t in NODE_TYPES)), F.lower(F.coalesce("type", F.lit("")))) - 1, F.lit(0))
    rest = [F.col("degree"), F.coalesce(F.col("is_reactive"), F.lit(False)).cast("int"), text.complexity_ordinal(F.col("complexity"))]
    return degrees(nodes, edges).select("id", vectors.one_hot(hot, rest).alias("features"))


def topic_connections(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(topic, producers, consumers): sorted distinct services of each side, each side aggregated before
    they meet; topics without consumers stay."""
    p = producers.groupBy("topic").agg(F.sort_array(F.collect_set("service")).alias("producers"))
    c = consumers.groupBy("topic").agg(F.sort_array(F.collect_set("service")).alias("consumers"))
    return p.join(c, "topic", "full_outer").select("topic", *(F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in ("producers", "consumers")))


def hierarchy(services: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """service, class, method rows by two equi-joins: classes(service, class), methods(class, method, ...)."""
    return services.join(classes, "service").join(methods, "class")


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are known, with their relation. nodes: id, label."""
    relation = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    a, b = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label")), nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(a, "src").join(b, "dst").withColumn("relation", F.coalesce(F.element_at(relation, F.col("type")), F.col("type")))


def build_graph(nodes: DataFrame, edges: DataFrame, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Graph tables of a topology: consumption runs service to topic; topics and databases that only
    edges name become nodes; classes (service_name, fqn, simple_name, field_types) hang on their
    service and inject each other by field type; keys are distinct, the last properties win. Classes as parsed (with
    imports and fields) inject what the names of their fields' types mean, not what bears an equal simple name."""
    swap = F.col("type") == "KAFKA_CONSUME"
    e = edges.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"), "type")
    ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    label = F.when(F.col("id").startswith("topic:"), "KafkaTopic").when(F.col("id").rlike("^(db|redis):"), "Database")
    named = ends.join(nodes.select("id"), "id", "left_anti").select("id", label.alias("label"), F.substring_index("id", ":", -1).alias("name")).where("label is not null")
    all_nodes = nodes.select("id", "label", "name").union(named)
    out = resolved_edges(e, all_nodes).select("src", "dst", "relation")
    if classes is not None:
        fqn = F.concat(F.lit("class:"), F.col("fqn"))
        all_nodes = all_nodes.union(classes.select(fqn, F.lit("Class"), F.col("simple_name")))
        holds = classes.select(F.concat(F.lit("svc:"), F.col("service_name")).alias("src"), fqn.alias("dst"), F.lit("CONTAINS_CLASS"))
        if "imports" in classes.columns:
            uses = names.injections(classes).withColumnsRenamed({"src": "fqn", "dst": "to"})
        else:
            fields = classes.select("fqn", F.explode("field_types").alias("simple_name"))
            uses = fields.join(classes.select(F.col("fqn").alias("to"), "simple_name"), "simple_name")
        injects = uses.select(F.concat(F.lit("class:"), "fqn"), F.concat(F.lit("class:"), "to"), F.lit("INJECTS"))
        out = out.union(holds).union(injects)
    last = all_nodes.groupBy("id", "label").agg(F.max("name").alias("name"))
    return last, out.distinct()


def link_scores(vecs: DataFrame, threshold: float = LINK_THRESHOLD, block: int = 4096) -> DataFrame:
    """(a, b, score) of pairs a < b whose dot product (over the shorter length) exceeds the threshold: all pairs are
    asked for, so rows are packed in blocks, each pair of blocks is met once by an equi-join, and a task multiplies one
    with the other in strips. What comes near the threshold is added up anew in order of the components, so scores
    don't hang on how a product of matrices adds. Rows without a vector, and pairs that meet a null component, score nothing."""
    ship(vecs.sparkSession)
    blocks = max(1, -(-vecs.count() // block))
    kind, element = vecs.schema["id"].dataType.simpleString(), "float" if "float" in vecs.schema["embedding"].dataType.simpleString() else "double"
    wide = vecs.where("embedding is not null").select("id", F.col("embedding").cast(f"array<{element}>").alias("e"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("k"))
    null_at = F.array_position(F.transform("e", lambda x: x.isNull()), True)
    each = wide.select("k", F.struct("id", F.size("e").alias("size"), F.when(null_at > 0, null_at - 1).otherwise(F.size("e")).cast("int").alias("sound"), F.transform("e", lambda x: F.coalesce(x, F.lit(0.0).cast(element))).alias("e")).alias("r"))
    packed = written(each.groupBy("k").agg(F.collect_list("r").alias("r")).select("k", F.col("r.id").alias("ids"), F.col("r.size").alias("sizes"), F.col("r.sound").alias("sound"), F.flatten("r.e").alias("flat")))
    side = lambda i, j, to: packed.select(i.alias("i"), j.alias("j"), F.struct("ids", "sizes", "sound", "flat").alias(to)).repartition(min(2000, blocks * (blocks + 1) // 2), "i", "j")
    left = side(F.col("k"), F.explode(F.sequence(F.col("k"), F.lit(blocks - 1))), "left")
    right = side(F.explode(F.sequence(F.lit(0), F.col("k"))), F.col("k"), "right").hint("merge")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def opened(side, at):  # ids, and (size, sound, places, matrix) of the rows alike in both
            row = {n: side.field(n)[at].values for n in ("ids", "sizes", "sound", "flat")}
            sizes, sound, flat = (row[n].to_numpy() for n in ("sizes", "sound", "flat"))
            starts = np.cumsum(sizes) - sizes
            groups = []
            for size, whole in {(int(x), int(y)) for x, y in zip(sizes, sound)}:
                places = np.flatnonzero((sizes == size) & (sound == whole))
                groups.append((size, whole, places, flat[starts[places][:, None] + np.arange(size)].astype(np.float64)))
            return row["ids"], groups

        def products(groups, others, same):
            for size, whole, at, x in groups:
                for other, other_whole, other_at, y in others:
                    n = min(size, other)
                    if n > min(whole, other_whole):
                        continue
                    y, reach = y[:, :n], np.sqrt((y[:, :n] ** 2).sum(1)).max()
                    for strip in range(0, len(at), 256):
                        part, mine = x[strip : strip + 256, :n], at[strip : strip + 256]
                        slack = 1e-12 * reach * np.sqrt((part**2).sum(1)).max()
                        near = ~(part @ y.T <= threshold - slack)
                        if same:
                            near &= mine[:, None] < other_at[None, :]
                        p, q = np.nonzero(near)
                        score = np.zeros(len(p))
                        for c in range(n):
                            score += part[p, c] * y[q, c]
                        keep = ~(score <= threshold)
                        yield mine[p[keep]], other_at[q[keep]], score[keep]

        with np.errstate(all="ignore"):
            for batch in batches:
                for r in range(batch.num_rows):
                    (a, mine), (b, others) = opened(batch.column("left"), r), opened(batch.column("right"), r)
                    for p, q, score in products(mine, others, batch.column("i")[r].as_py() == batch.column("j")[r].as_py()):
                        yield pa.RecordBatch.from_arrays([a.take(pa.array(p)), b.take(pa.array(q)), pa.array(score)], ["a", "b", "score"])

    pairs = left.join(right, ["i", "j"]).mapInArrow(work, f"a {kind}, b {kind}, score double").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def classified(vecs: DataFrame) -> DataFrame:
    """(id, pattern, confidence): the class of the greatest component, clamped to the known patterns."""
    e = F.col("embedding")
    return vecs.select("id", vectors.clamped_class(e, PATTERNS).alias("pattern"), F.array_max(e).cast("double").alias("confidence"))
