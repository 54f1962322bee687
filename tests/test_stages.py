"""Whole stages on small folders, and the registry."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import projections, snapshots
from tracewright.plans import catalogue
from tracewright.sources import files
from tracewright.sources.tracking import Tracker

LOG = """2024-01-15 10:30:45.100 INFO [main] com.acme.App - Connected to 10.0.0.1 on port 1
2024-01-15 10:30:46.100 INFO [main] com.acme.App - Connected to 10.0.0.2 on port 2
2024-01-15 10:30:47.100 ERROR [main] com.acme.App - Lost connection
java.lang.RuntimeException: boom
  at com.acme.App.run(App.java:3)

junk
"""


def test_parse_logs(spark, tmp_path):
    (tmp_path / "order-service").mkdir()
    (tmp_path / "order-service/app.log").write_text(LOG)
    events, templates, failed = snapshots.parse_logs(spark, str(tmp_path))
    rows = events.orderBy("line_no").collect()
    assert [r["severity"] for r in rows] == ["INFO", "INFO", "ERROR"] and {r["service"] for r in rows} == {"order-service"}
    assert rows[0]["template"] == "Connected to <IP> on port <NUM>" and rows[0]["template_id"] == rows[1]["template_id"] and rows[0]["event_id"] != rows[1]["event_id"]
    assert {r["template"]: r["match_count"] for r in templates.collect()} == {"Connected to <IP> on port <NUM>": 2, "Lost connection": 1}
    assert failed.first()["failed"] == 3
    vectors = snapshots.embedded_logs(events, 10).collect()
    assert len(vectors) == 3 and vectors[0]["content"].startswith("passage: [order-service]")


def test_code_and_topology(spark, tmp_path):
    pytest.importorskip("yaml")
    src = tmp_path / "services/pay/src/main"
    src.mkdir(parents=True)
    (src / "A.java").write_text("package p;\nclass A { B b; void run() { x.map(y); } }")
    (src / "application.yml").write_text("kafka: {producers: {t: {}}}")
    (tmp_path / "d.yaml").write_text("kind: Service\nmetadata: {name: pay}\nspec: {ports: [{port: 80}]}")
    classes, chunks = snapshots.parse_code(spark, str(tmp_path))
    assert classes.first()["service_name"] == "pay" and snapshots.embedded_code(chunks).count() == 2
    nodes, edges = snapshots.topology(spark, str(tmp_path))
    assert {r["id"] for r in nodes.collect()} == {"svc:pay", "topic:t"} and [tuple(r) for r in edges.collect()] == [("svc:pay", "topic:t", "PRODUCES_TO")]


def test_snapshot_refresh(spark):
    old = spark.createDataFrame([("services/a/src/main/A.java", "1", 1), ("x.md", "1", 1)], "path string, hash string, length int")
    new = spark.createDataFrame([("services/a/src/main/A.java", "2", 1), ("pom.xml", "1", 1)], "path string, hash string, length int")
    assert {(r["path"], r["change"], r["file_type"], r["service"], r["module"]) for r in snapshots.refresh(old, new).collect()} == {("services/a/src/main/A.java", "MODIFIED", "JAVA_SOURCE", "a", "main"), ("pom.xml", "ADDED", "BUILD_FILE", "", "")}
    counts = {r["file_type"]: r["n"] for r in snapshots.snapshot_summary(new).collect()}
    assert counts["JAVA_SOURCE"] == 1 and counts["BUILD_FILE"] == 1 and counts["DOCKERFILE"] == 0 and len(counts) == 9


def test_checkout(spark, tmp_path):
    import subprocess

    source = tmp_path / "source"
    source.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(source), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (source / "pom.xml").write_text("<x/>")
    git("add", ".")
    git("commit", "-qm", "first")
    assert len(files.checkout(f"file://{source}", str(tmp_path / "copy"))) == 40
    assert [r["path"] for r in files.snapshot(spark, str(tmp_path / "copy")).collect()] == ["pom.xml"]


def test_blob_ingestion(spark):
    blobs = spark.createDataFrame([("a/app.log", bytearray(b"hello")), ("b/x.bin", bytearray(b"seen"))], "path string, content binary")
    seen = blobs.where("path = 'b/x.bin'").select(F.sha2("content", 256).alias("etag"))
    entries, totals = snapshots.ingest_blobs(blobs, seen)
    assert [(r["archive"], r["files"], r["bytes"], r["log_type"]) for r in totals.collect()] == [("a/app.log", 1, 5, "APP")] and entries.count() == 1


def test_anomaly_detection_and_tracking(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=30 * i), "s", "ERROR" if 1000 <= i < 1010 else "INFO", f"t{i % 3}", None, None) for i in range(2000)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, service string, severity string, template_id string, trace_id string, exception_class string")
    got = snapshots.detect_anomalies(events, threshold=0.6).collect()
    assert any(r["start_time"] <= start + timedelta(seconds=30 * 1000) < r["end_time"] for r in got)
    metrics = snapshots.tracked_anomaly_training(Tracker(spark, str(tmp_path / "t")), "r", snapshots.windows.features(events), str(tmp_path / "forest"), trees=20)
    assert metrics["samples"] == 200 and snapshots.anomaly.load(spark, str(tmp_path / "forest")).count() == 20


def test_graph_convolution_and_tensors(spark, tmp_path):
    f = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 3.0])], "id long, features array<double>")
    e = spark.createDataFrame([(0, 1)], "src long, dst long")
    got = {r["id"]: r["features"] for r in snapshots.propagated(f, e, 1).collect()}
    assert got == {0: [0.5, 0.5], 1: [0.5, 0.5], 2: [3.0, 3.0]}
    out = {r["id"]: r["embedding"] for r in snapshots.linear(f, np.array([[1.0, -1.0], [2.0, 0.0]]), relu=True).collect()}
    assert out == {0: [1.0, 0.0], 1: [2.0, 0.0], 2: [9.0, 0.0]}
    n = spark.createDataFrame([(5, "Service", True, "NONE"), (7, "Class", False, "COMPLEX")], "id long, type string, is_reactive boolean, complexity string")
    snapshots.graph_tensors(n, spark.createDataFrame([(5, 7)], "src long, dst long"), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/nodes")).count() == 2 and spark.read.json(str(tmp_path / "g/edges")).first()["src_idx"] == 0


def test_registry():
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60 and len(sql) >= len(queries) - 8


def test_entry_imports_without_the_training_data_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tracewright", tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import re, __spark_entry__ as e; q = e.queries(); assert q and not any(re.match(r'op[0-9]|pipeline', n) for n in q) and e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0, said.stderr


def test_scan_filters_reach_the_files(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 as k", "id as unused").write.parquet(str(tmp_path / "t"))
    plan = files.scan(spark, str(tmp_path / "t"), k=1).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,1)" in plan and "unused" not in plan.split("ReadSchema")[1]


def test_documents_and_events(spark):
    at = datetime(2024, 1, 15, 10, 30, 45, 123000)
    events = spark.createDataFrame([("svc", "ISTIO", at, "t", "m", "tr", None, "ERROR"), (None, "APP", None, None, None, None, None, None)], "service string, source string, ts timestamp, template_id string, message string, trace_id string, span_id string, severity string")
    docs = projections.event_documents(events, "b", F.lit("2024-01-01").cast("timestamp"))
    assert tuple(docs.columns) == projections.EVENT_FIELDS
    assert {tuple(r) for r in docs.collect()} == {
        ("b", "svc", "ISTIO", "2024-01-15T10:30:45.123000Z", "t", "m", "tr", "", "ERROR", "2024-01-01T00:00:00.000000Z"), ("b", "", "APP", None, "", "", "", "", "", "2024-01-01T00:00:00.000000Z"),
    }
    back = projections.document_events(docs, "other").where("service = 'svc'").first().asDict()
    assert back == {"batch_id": "b", "service": "svc", "ts": at, "severity": "ERROR", "template_id": "t", "message": "m", "trace_id": "tr", "span_id": None, "source": "APP"}
    bare = spark.createDataFrame([(" ", "no time"), (None, "2024-01-15T10:30:45.123Z")], "batch_id string, timestamp string")
    assert [tuple(r)[:4] for r in projections.document_events(bare, "mine").orderBy("ts").collect()] == [("mine", "", None, "INFO"), ("mine", "", at, "INFO")]


def test_topology_documents(spark):
    nodes = spark.createDataFrame([("svc:a", "Service", "a")], "id string, label string, name string")
    edges = spark.createDataFrame([("svc:a", "db:x", "DATABASE_CONNECT")], "src string, dst string, type string")
    got = {tuple(r)[:5] for r in projections.topology_documents(nodes, edges, "s").collect()}
    assert got == {("s", "a", "topology/node/svc:a", "topology-node", '{"id":"svc:a","label":"Service","name":"a"}'), ("s", "svc:a", "topology/edge/svc:a-db:x", "topology-edge", '{"src":"svc:a","dst":"db:x","type":"DATABASE_CONNECT"}')}
