"""What is indexed of events and of a topology, and events read back from documents.

Defined results: a field that is absent or null reads as its default: '' for names, templates and messages,
INFO for the severity, the batch asked for where a document names none, null for times, traces and spans; a time
that can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
# fixed values: fields of indexed events, and kinds and paths of topology documents
EVENT_FIELDS = ("batch_id", "service_name", "log_type", "timestamp", "template_id", "message", "trace_id", "span_id", "severity", "indexed_at")
NODE_KIND, EDGE_KIND = "topology-node", "topology-edge"
NODE_PATH, EDGE_PATH = "topology/node/", "topology/edge/"


def iso(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), ISO)


def some(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """A column as text, or what stands for it where it is absent or null."""
    has = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    return has if default is None else F.coalesce(has, default)


def not_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def event_documents(events: DataFrame, batch: str, indexed_at: Column | None = None) -> DataFrame:
    """EVENT_FIELDS of events (service, source, ts, template_id, message, trace_id, span_id, severity)."""
    blank = F.lit("")
    values = {
        "batch_id": F.lit(batch), "service_name": some(events, "service", blank), "log_type": some(events, "source", blank), "timestamp": iso(F.col("ts")), "template_id": some(events, "template_id", blank),
        "message": some(events, "message", blank), "trace_id": some(events, "trace_id", blank), "span_id": some(events, "span_id", blank), "severity": some(events, "severity", blank), "indexed_at": iso(F.current_timestamp() if indexed_at is None else indexed_at),
    }
    return events.select(*(values[f].alias(f) for f in EVENT_FIELDS))


def document_events(docs: DataFrame, batch: str) -> DataFrame:
    """Events of documents that may lack any field: batch_id, service, ts, severity, template_id, message,
    trace_id, span_id, source."""
    blank = F.lit("")
    return docs.select(
        F.coalesce(not_blank(some(docs, "batch_id")), F.lit(batch)).alias("batch_id"), some(docs, "service_name", blank).alias("service"), F.try_to_timestamp(some(docs, "timestamp")).alias("ts"), some(docs, "severity", F.lit("INFO")).alias("severity"),
        some(docs, "template_id", blank).alias("template_id"), some(docs, "message", blank).alias("message"), not_blank(some(docs, "trace_id")).alias("trace_id"), not_blank(some(docs, "span_id")).alias("span_id"), F.lit("APP").alias("source"),
    )


def topology_documents(nodes: DataFrame, edges: DataFrame, snapshot: str, indexed_at: Column | None = None) -> DataFrame:
    """snapshot_id, service_name, file_path, artifact_type, content (JSON of the row), indexed_at of nodes(id,
    name, ...) and edges(src, dst, ...)."""
    now = iso(F.current_timestamp() if indexed_at is None else indexed_at)

    def documents(rows: DataFrame, service: str, path: Column, kind: str) -> DataFrame:
        return rows.select(F.lit(snapshot).alias("snapshot_id"), F.col(service).cast("string").alias("service_name"), path.alias("file_path"), F.lit(kind).alias("artifact_type"), F.to_json(F.struct(*(F.col(c) for c in rows.columns))).alias("content"), now.alias("indexed_at"))

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    of_nodes = documents(nodes, "name", F.concat(F.lit(NODE_PATH), text("id")), NODE_KIND)
    return of_nodes.unionByName(documents(edges, "src", F.concat(F.lit(EDGE_PATH), text("src"), F.lit("-"), text("dst")), EDGE_KIND))
