"""Files, archives, manifests, Java sources, sinks, tracking, streams."""

import gzip
import io
import json
import tarfile
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import code
from tracewright.sources import files, manifests, tracking
from tracewright.streaming import events

JAVA = """package com.acme.pay;

import jakarta.inject.Inject;
import reactor.core.publisher.Mono;

/** A class { with a brace. */
@Controller("/pay")
public class PayController implements Closeable, Comparable<Pay> {
    @Inject
    private final OrderService orders;
    private int n = 3;
    String text = "a } brace";

    public PayController(OrderService orders) { this.orders = orders; }

    @Get("/{id}")
    public Mono<Pay> find(String id) {
        return orders.load(id).map(this::convert).onErrorResume(e -> Mono.empty());
    }

    @Post
    @KafkaListener(groupId = "g")
    void save(Pay pay) throws IOException { if (pay != null) { orders.save(pay); } }
}
"""


def parsed(spark, source=JAVA):
    return code.parsed(spark.createDataFrame([("services/pay/src/main/java/PayController.java", source)], "path string, value string"))


def test_java_classes(spark):
    c = parsed(spark).first()
    assert (c["fqn"], c["kind"], c["annotations"], c["interfaces"]) == ("com.acme.pay.PayController", "class", ["Controller"], ["Closeable", "Comparable<Pay>"])
    assert {f["name"]: f["injected"] for f in c["fields"]} == {"orders": True, "n": False, "text": False}
    m = {x["name"]: x for x in c["methods"]}
    assert set(m) == {"find", "save"} | ({"PayController"} & set(m))
    assert m["find"]["http_methods"] == ["GET"] and m["find"]["path"] == "/{id}" and m["find"]["return_type"] == "Mono<Pay>"
    assert m["save"]["annotations"] == ["Post", "KafkaListener"] and m["save"]["path"] == "/" and m["find"]["line_start"] < m["save"]["line_start"]


def test_java_chunks_and_features(spark):
    c = parsed(spark)
    got = code.chunks(c).collect()
    assert {r["chunk_type"] for r in got} == {"CLASS_SIGNATURE", "METHOD"} and len(got) >= 3
    assert {r["method_name"]: r["reactive_complexity"] for r in got}["find"] == "BRANCHING"
    assert all(len(r["content_hash"]) == 16 for r in got)
    f = code.migration_features(c, F.array_repeat(F.lit(0.0).cast("float"), 1024)).first()["features"]
    assert len(f) == 1088 and f[1024 + 2] == 1 and f[1024 + 4] == 1 and f[1024 + 5] == 2 and f[1024 + 6] == 1 and f[1024 + 7] == 2 and f[1024 + 9] == 2
    assert tuple(code.class_difficulty(c).first())[1:] == ("BRANCHING", "MEDIUM", 0.5)


def test_annotations(spark):
    df = spark.createDataFrame([(["io.x.Get"], ["Inject"], ["a.KafkaListener"])], "a array<string>, b array<string>, c array<string>")
    assert df.select(code.is_endpoint(F.col("a")), code.is_injection(F.col("b")), code.is_handler(F.col("c")), code.is_endpoint(F.col("b"))).first()[0:4] == (True, True, True, False)


def test_long_methods_are_split():
    body = "\n".join(f"call{i}(a, b, c);" for i in range(400))
    parts = code.split_lines(body, 512)
    assert len(parts) > 1 and "\n".join(p[0] for p in parts) == body
    assert all(len([t for t in __import__("re").split(r"[\s{}();,.<>]+", p[0]) if t]) <= 512 for p in parts)
    assert code.split_lines("a\nb\nc", 2, overlap=1) == [("a\nb", 1, 2), ("b\nc", 2, 3)]


def test_difficulty_model(spark):
    rows = [([float(i % 3), 1.0], float(i % 3)) for i in range(60)]
    model = code.difficulty_model(spark.createDataFrame(rows, "features array<double>, label double"), 3)
    assert len(model.models) == 3


def test_log_and_java_scans(spark, tmp_path):
    (tmp_path / "a/src/test").mkdir(parents=True)
    (tmp_path / "a/x.log").write_text("one\ntwo")
    (tmp_path / "a/A.java").write_text("class A {}")
    (tmp_path / "a/src/test/B.java").write_text("class B {}")
    assert [(r["line_no"], r["line"]) for r in files.log_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "one"), (1, "two")]
    assert [r["value"] for r in files.java_sources(spark, str(tmp_path)).collect()] == ["class A {}"]
    tree = files.snapshot(spark, str(tmp_path)).collect()
    assert {r["path"] for r in tree} == {"a/x.log", "a/A.java", "a/src/test/B.java"}


def packed(kind):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("d/a.log", "hello")
    elif kind == "evil":
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("../../etc/x", "hello")
    elif kind == "bomb":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("big", b"0" * 5_000_000)
    elif kind == "tar":
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            info = tarfile.TarInfo("d/" + "long" * 40 + ".log")
            info.size = 5
            t.addfile(info, io.BytesIO(b"hello"))
    else:
        out.write(gzip.compress(b"hello"))
    return out.getvalue()


def test_archives(spark, tmp_path):
    for name, kind in (("a.zip", "zip"), ("e.zip", "evil"), ("b.zip", "bomb"), ("t.tar.gz", "tar"), ("g.log.gz", "gz")):
        (tmp_path / name).write_bytes(packed(kind))
    (tmp_path / "plain.txt").write_text("hello")
    got = {r["archive"].rsplit("/", 1)[1]: r for r in files.expanded(files.objects(spark, str(tmp_path))).collect()}
    assert all(bytes(got[n]["content"]) == b"hello" for n in ("a.zip", "t.tar.gz", "g.log.gz", "plain.txt"))
    assert got["g.log.gz"]["path"] == "g.log" and "leaves" in got["e.zip"]["error"] and "limits" in got["b.zip"]["error"]


def test_manifests(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "services/order/src").mkdir(parents=True)
    (tmp_path / "k8s.yaml").write_text("""
kind: Deployment
metadata: {name: order, labels: {app: order}}
spec: {replicas: 3, template: {spec: {containers: [{image: "o:1", ports: [{containerPort: 8080}], env: [{name: X}]}]}}}
---
kind: Ingress
metadata: {name: edge, namespace: web}
spec: {rules: [{host: h, http: {paths: [{path: /p, backend: {service: {name: order}}}]}}]}
---
kind: ConfigMap
metadata: {name: cm}
data: {k: v}
---
kind: Secret
metadata: {name: s}
""")
    (tmp_path / "mesh.yml").write_text("""
kind: VirtualService
metadata: {name: vs}
spec: {http: [{route: [{destination: {host: a}, weight: 90}, {destination: {host: b}}]}]}
---
kind: DestinationRule
metadata: {name: dr}
spec: {host: a}
---
kind: Gateway
metadata: {name: gw}
spec: {servers: [{port: {number: 443}, hosts: [x, y]}]}
""")
    (tmp_path / "broken.yaml").write_text("a: [")
    (tmp_path / "services/order/src/application.yml").write_text("""
micronaut: {http: {services: {pay: {url: "http://pay"}}}}
kafka: {consumers: {t1: {}}, producers: {t2: {}}}
datasources: {default: {url: "jdbc:postgresql://h/orders?x=1"}}
redis: {uri: "redis://r"}
""")
    nodes = {r["id"]: r for r in manifests.topology_nodes(spark, str(tmp_path)).collect()}
    assert set(nodes) == {"svc:order", "ingress:edge", "configmap:cm"} and nodes["svc:order"]["replicas"] == 3 and nodes["svc:order"]["ports"] == [8080]
    assert nodes["ingress:edge"]["routes"] == ["h/p>order"] and nodes["configmap:cm"]["data"] == {"k": "v"}
    mesh = {(r["src"], r["dst"], r["metadata"].get("weight")) for r in manifests.mesh(spark, str(tmp_path)).collect()}
    assert mesh == {("vs:vs", "svc:a", "90"), ("vs:vs", "svc:b", "100"), ("dr:dr", "svc:a", None), ("gw:gw", "host:x", None), ("gw:gw", "host:y", None)}
    found = {(r["src"], r["dst"], r["type"]) for r in manifests.service_edges(spark, str(tmp_path)).collect()}
    assert found == {("svc:order", "svc:pay", "HTTP_CALL"), ("topic:t1", "svc:order", "KAFKA_CONSUME"), ("svc:order", "topic:t2", "KAFKA_PRODUCE"), ("svc:order", "db:orders", "DATABASE_CONNECT"), ("svc:order", "redis:redis://r", "DATABASE_CONNECT")}


def test_merge_delete_and_objects(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, seq int")
    files.merge(rows(("a", 1, 1), ("b", 1, 1)), path, ["k"], "seq")
    files.merge(rows(("b", 2, 2), ("c", 2, 2)), path, ["k"], "seq")
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 2, "c": 2}
    assert [r["k"] for r in files.scan(spark, path, ["k"], v=2).collect()] == ["b", "c"]
    files.copy(spark, path, str(tmp_path / "u"))
    assert files.exists(spark, str(tmp_path / "u")) and files.delete(spark, path) and not files.exists(spark, path)
    files.append(rows(("x", 1, 1), ("y", 2, 1)), str(tmp_path / "p"), ["v"])
    files.delete_partitions(rows(("z", 1, 1)), str(tmp_path / "p"), ["v"])
    assert {r["k"] for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"z", "y"}
    with pytest.raises(ValueError, match="keys repeat"):
        files.asserted_unique(rows(("a", 1, 1), ("a", 2, 2)), ["k"]).collect()
    (tmp_path / "j.json").write_text(json.dumps({"a": [1]}, indent=1))
    assert files.json_objects(spark, str(tmp_path / "j.json")).first()["a"] == [1]


def test_tracking(spark, tmp_path):
    t = tracking.Tracker(spark, str(tmp_path / "runs"))
    assert t.tracked("e", "r1", {"trees": 200}, lambda: {"score": 0.5}) == {"score": 0.5}
    with pytest.raises(ZeroDivisionError):
        t.tracked("e", "r2", {}, lambda: 1 / 0)
    got = {(r["run"], r["name"]): r["value"] for r in t.runs("e").collect()}
    assert got["r1", "status"] == "FINISHED" and got["r2", "status"] == "FAILED" and got["r1", "score"] == "0.5"
    tracking.save_arrays(str(tmp_path / "m.npz"), w=np.arange(3))
    assert tracking.load_arrays(str(tmp_path / "m.npz"))["w"].tolist() == [0, 1, 2]


def test_stage_runner():
    seen, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError

    state = tracking.run_stages({"c": (["b"], lambda: seen.append("c")), "a": ([], lambda: seen.append("a")), "b": (["a"], flaky), "d": ([], lambda: 1 / 0), "e": (["d"], lambda: seen.append("e"))})
    assert state == {"a": "SUCCEEDED", "b": "SUCCEEDED", "c": "SUCCEEDED", "d": "FAILED", "e": "SKIPPED"} and seen == ["a", "c"]


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 0, i % 50), "e", 1.0) for i in range(100)] + [(200, datetime(2024, 1, 9), "e", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = events.window_counts_once(spark, str(tmp_path)).collect()
    assert sorted((r["n"], r["total"]) for r in got) == [(1, 1.0), (100, 100.0)]  # the open last window too


def test_dispatch_and_envelopes(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([("pipeline.snapshot.ready", "{}"), ("pipeline.stage.failed", "x"), ("other", "y")], "topic string, payload string")
    rows.write.json(str(src))
    seen = {}
    stream = spark.readStream.schema(rows.schema).json(str(src))
    events.dispatch(stream, {t: lambda df, t=t: seen.setdefault(t, df.count()) for t in events.TOPICS}, str(tmp_path / "cp")).awaitTermination()
    assert seen == {"pipeline.snapshot.ready": 1, "pipeline.stage.failed": 1, "pipeline.stage.completed": 0}
    body = json.loads(events.envelope(rows).first()["value"])
    assert body["type"] == "pipeline.snapshot.ready" and len(body["id"]) == 64


def test_keyed_state_keeps_the_first_write(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "key string, op string, value string"
    spark.createDataFrame([("a", "put", "1"), ("a", "put", "2"), ("b", "put", "3"), ("b", "delete", None)], schema).coalesce(1).write.json(src)
    stream = events.keyed_state(spark.readStream.schema(schema).json(src))
    q = stream.writeStream.outputMode("update").format("memory").queryName("kv").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {r["key"]: r["value"] for r in spark.table("kv").collect()} == {"a": "1", "b": None}


def test_online_templates(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("Connected to 10.0.0.1 on port 1",), ("Connected to 10.0.0.2 on port 2",)], "message string").write.json(src)
    q = events.online_templates(spark.readStream.schema("message string").json(src)).writeStream.outputMode("append").format("memory").queryName("tpl").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {r["template"] for r in spark.table("tpl").collect()} == {"Connected to <IP> on port <NUM>"}


def test_new_blobs_once(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "etag string, seen_at timestamp"
    spark.createDataFrame([("x", datetime(2024, 1, 1)), ("x", datetime(2024, 1, 1)), ("y", datetime(2024, 1, 1))], schema).write.json(src)
    q = events.new_blobs(spark.readStream.schema(schema).json(src)).writeStream.outputMode("append").format("memory").queryName("blobs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("blobs").count() == 2


def test_databases_of_service_configurations(spark, tmp_path):
    urls = {"a": "jdbc:postgresql://h:5432/orders?ssl=1", "b": "jdbc:sqlserver://h/a;b=1", "c": "jdbc:h2:mem:test"}
    for service, url in urls.items():
        folder = tmp_path / "services" / service / "src"
        folder.mkdir(parents=True)
        (folder / "application.yml").write_text(f"datasources:\n  default:\n    url: '{url}'\nredis:\n  host: cache\n")
    got = {(r["src"], r["dst"]) for r in manifests.service_edges(spark, str(tmp_path)).collect()}
    assert got == {("svc:a", "db:orders"), ("svc:b", "db:a;b=1"), ("svc:c", "db:h2:mem:test")} | {(f"svc:{s}", "redis:cache") for s in urls}


def test_merge_leaves_a_whole_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, seq int")
    files.merge(rows(("a", 1, 1), ("b", 2, 1)), path, ["k"], "seq")
    files.merge(rows(("b", 3, 2), ("c", 4, 2)), path, ["k"], "seq")
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 3, "c": 4}
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("t")] == ["t"]


def test_no_temporary_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        sparkContext = Context

    with pytest.raises(ValueError):
        files.scratch(Session)
