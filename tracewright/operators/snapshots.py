"""Whole stages of the pipeline, put together from operators: log parsing, topology, code, embeddings,
snapshots and their refresh, blob ingestion, anomaly detection, graph tensors, evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import logs, text
from tracewright.operators import anomaly, code, drain, embedding, graph, relational, windows
from tracewright.sources import files, manifests
from tracewright.sources.tracking import Tracker

FILE_TYPES = ("JAVA_SOURCE", "YAML_CONFIG", "PROPERTIES_CONFIG", "K8S_MANIFEST", "ISTIO_MANIFEST", "HELM_CHART", "DOCKERFILE", "BUILD_FILE", "OTHER")
MEASURES = ("error_rate", "unique_template_ratio", "event_rate", "p99_latency", "burst_score", "new_template_rate", "trace_span_ratio", "exception_rate")
THRESHOLD = 0.65


def parsed_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(path, line_no, line) -> events and the count of lines that no shape fits.

    An event's id is a hash of its place; stack lines after it, up to the next event, name its
    exception."""
    p = logs.parsed_line(F.col("line"))
    rows = lines.where(F.trim("line") != "").withColumn("p", p).withColumn("t", logs.trace_context(F.col("line"))).withColumn("x", logs.last_exception(F.col("line")))
    events = rows.where("p is not null").select(
        F.substring(F.sha2(F.concat_ws(":", "path", "line_no"), 256), 1, 16).alias("event_id"), "path", "line_no", logs.service_of_log_path(F.col("path")).alias("service"), logs.instant(F.col("p.ts_text")).alias("ts"), "p.severity", "p.source",
        F.col("p.message").alias("message"), F.col("p.logger").alias("logger"), F.col("p.thread").alias("thread"), F.col("t.trace_id").alias("trace_id"), F.col("t.span_id").alias("span_id"), F.array_join(text.masked_tokens(F.col("p.message")), " ").alias("template"),
    )
    failed = rows.where("p is null").agg(F.count("*").alias("failed"))
    return events.withColumn("template_id", text.content_hash(F.col("template"))), failed


def parse_logs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, templates, counts of lines that failed) of every log below the folder."""
    events, failed = parsed_lines(files.log_lines(spark, folder))
    messages = events.select("message", F.struct("path", "line_no").alias("seq"))
    return events, drain.clusters(messages), failed


def topology(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all manifests and service configurations below the folder, as graph tables."""
    nodes = manifests.topology_nodes(spark, folder).select("id", "label", "name")
    edges = manifests.mesh(spark, folder).unionByName(manifests.service_edges(spark, folder)).select("src", "dst", "type")
    return graph.build_graph(nodes, edges)


def parse_code(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(classes, chunks) of every source but tests; service by path."""
    classes = code.parsed(files.java_sources(spark, folder)).withColumn("service_name", logs.service_of_source_path(F.col("file_path")))
    return classes, code.chunks(classes)


def embedded_logs(events: DataFrame, cap: int = 50_000, model=embedding.hashed) -> DataFrame:
    """A stratified sample of events with passages and vectors."""
    rows = relational.stratified(events, cap)
    none = F.lit(None).cast("string")
    return embedding.embedded(rows.withColumn("content", text.log_passage(F.col("service"), F.col("severity"), F.col("template"), none, none, F.col("logger"))), "content", model)


def embedded_code(chunks: DataFrame, model=embedding.hashed) -> DataFrame:
    body = text.code_passage(F.col("chunk_type"), F.col("fqn"), F.col("method_name"), F.col("annotations"), F.col("content"))
    return embedding.embedded(chunks.withColumn("passage", body), "passage", model)


def classified_tree(tree: DataFrame) -> DataFrame:
    """tree(path, hash, length) + file_type, service, module."""
    return tree.withColumns({"file_type": logs.file_type(F.col("path")), "service": logs.module_service(F.col("path")), "module": logs.module(F.col("path"))})


def snapshot_summary(tree: DataFrame) -> DataFrame:
    """Counts by file type, 0 where there is none."""
    return windows.zero_filled(classified_tree(tree), "file_type", FILE_TYPES)


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the new tree that were added or changed; removed paths are in `relational.changed`."""
    moved = relational.changed(old, new).where("change <> 'REMOVED'")
    return classified_tree(new.join(moved, "path"))


def ingest_blobs(blobs: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """blobs(path, content) -> (files of archives not seen before, batch counts). The etag is the
    content's hash."""
    fresh = relational.unseen(blobs.withColumn("etag", F.sha2("content", 256)), seen)
    entries = files.expanded(fresh).withColumn("log_type", logs.log_type(F.substring_index("path", "/", -1)))
    totals = entries.groupBy("archive").agg(F.count("path").alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("bytes"), F.max("error").alias("error"))
    kinds = relational.dominant(entries.where("path is not null"), "archive", "log_type", "path")
    return entries, totals.join(kinds, "archive", "left")


def detect_anomalies(events: DataFrame, seconds: int = windows.FIVE_MINUTES, threshold: float = THRESHOLD, gap: int = 600) -> DataFrame:
    """Episodes of windows whose isolation score reaches the threshold."""
    rows = windows.features(events, seconds)
    scores = anomaly.scored(rows, ["service"], list(MEASURES), ["window_start", "window_end"])
    return windows.episodes(scores, threshold, gap)


def propagated(features: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, features): mean of a node's own and its neighbours' features, so often: the aggregation of a
    graph convolution. Neighbours are summed dimension by dimension with partial sums."""
    both = graph.undirected(edges)
    for _ in range(rounds):
        near = features.select(F.col("id").alias("dst"), F.posexplode("features").alias("i", "x")).join(both, "dst").select(F.col("src").alias("id"), "i", "x")
        own = features.select("id", F.posexplode("features").alias("i", "x"))
        means = own.unionByName(near).groupBy("id", "i").agg(F.avg("x").alias("x"))
        packed = means.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        features = packed.select("id", F.transform("v", lambda e: e["x"]).alias("features"))
    return features


def linear(features: DataFrame, weights: np.ndarray, relu: bool = False) -> DataFrame:
    """features times a weight matrix (inputs x outputs), as column expressions."""
    cols = [reduce(lambda a, b: a + b, [F.get("features", i) * float(w) for i, w in enumerate(row)]) for row in weights.T]
    out = F.array(*(F.greatest(c, F.lit(0.0)) if relu else c for c in cols))
    return features.select("id", out.alias("embedding"))


def graph_tensors(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes the tensors of a graph as JSON lines: nodes(idx, features), edges(src_idx, dst_idx)."""
    rows = graph.node_features(nodes, edges).join(graph.dense_index(nodes.select("id")), "id")
    rows.select("idx", "features").write.json(f"{path}/nodes")
    graph.edge_index(nodes, edges).withColumn("features", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).write.json(f"{path}/edges")


def tracked_anomaly_training(tracker: Tracker, run: str, features: DataFrame, path: str, trees: int = anomaly.TREES, subsample: int = anomaly.SUBSAMPLE) -> dict:
    """Trains forests on all windows and saves them at path, under a tracked run: its parameters, the artifact's
    place, its sample count and mean score."""
    group, order = ["service"], ["window_start"]
    rows = files.written(features.select(*group, *order, *MEASURES))

    def train() -> dict:
        anomaly.save(anomaly.train(rows, group, list(MEASURES), order, trees, subsample), path)
        forest = anomaly.load(rows.sparkSession, path)
        got = anomaly.score(forest, rows, group, list(MEASURES), order).agg(F.count("*").alias("n"), F.avg("score").alias("mean")).first()
        return {"samples": got["n"], "mean_score": got["mean"]}

    tracker.log("anomaly", run, "artifact", {"forest": path})
    return tracker.tracked("anomaly", run, {"trees": trees, "subsample": subsample}, train)


def tracked_graph_inference(tracker: Tracker, run: str, vectors: DataFrame, threshold: float = graph.LINK_THRESHOLD) -> dict:
    """Predicts links and classes under a tracked run: their counts."""
    return tracker.tracked("graph", run, {"threshold": threshold}, lambda: {"links": graph.link_scores(vectors, threshold).count(), "nodes": graph.classified(vectors).count()})
