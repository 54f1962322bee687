"""Domain tables over the driver's tables. Each is a list of expressions that Spark and DuckDB read
alike, so the query and its SQL start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACE_HEX = "lpad(lower(hex(event_id)), 32, '0')"
SPAN_HEX = "lpad(lower(hex(event_id)), 16, '0')"
SECOND = "cast(date_trunc('second', ts) as string)"
MESSAGE = "'User ' || user_id || ' ' || event_type || ' from 10.0.' || (user_id % 256) || '.' || (event_id % 256) || ' took ' || (event_id % 997) || ' ms at /api/' || event_type || '/' || (event_id % 7)"
SEVERITY = "case when event_type = 'error' then 'ERROR' else 'INFO' end"

TABLES = {
    "ev": ("events", {
        "event_id": "event_id", "ts": "ts", "service": "'svc-' || (user_id % 10)", "severity": SEVERITY, "template_id": "event_type", "message": MESSAGE,
        "trace_id": "case when user_id % 7 <> 0 then user_id || '-' || cast(cast(ts as date) as string) end",
        "exception_class": "case when event_type = 'error' and event_id % 2 = 0 then 'java.lang.IllegalStateException' end",
        "log_type": "case event_id % 3 when 0 then 'APP' when 1 then 'ISTIO' else 'UNKNOWN' end", "latency": "value",
    }),
    "lines": ("events", {
        "event_id": "event_id",
        "line": f"case when event_id % 11 = 0 then 'junk ' || event_id when event_id % 3 = 0 then {SECOND} || ' ' || {SEVERITY} || ' [worker-' || (event_id % 4) || '] com.acme.Service - ' || {MESSAGE} || ' traceparent=00-' || {TRACE_HEX} || '-' || {SPAN_HEX} || '-01'"
                f" when event_id % 3 = 1 then '[' || {SECOND} || '] \"GET /api/' || event_type || ' HTTP/1.1\" ' || (200 + event_id % 5) || ' - X-B3: ' || {TRACE_HEX} || '-' || {SPAN_HEX}"
                f" else '[' || {SECOND} || '][' || case when event_type = 'error' then 'error' when event_id % 5 = 0 then 'warning' else 'debug' end || '][router] ' || {MESSAGE} end",
        "stack": "case when event_id % 2 = 0 then 'java.lang.RuntimeException: failed ' || event_id || '\n\tat com.acme.Main.run(Main.java:3)\nCaused by: java.sql.SQLException: refused ' || user_id || '\n\tat com.acme.Db.open(Db.java:' || (event_id % 90) || ')\n\t... 2 more' else event_type end".replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '"),
    }),
    "art_old": ("documents", {"path": "'doc/' || doc_id", "hash": "sha2_256(text)", "seq": "0", "keep": "doc_id % 10 <> 0"}),
    "art_new": ("documents", {"path": "'doc/' || doc_id", "hash": "case when doc_id % 5 = 0 then sha2_256(text || '!') else sha2_256(text) end", "seq": "1", "keep": "doc_id % 7 <> 0"}),
    "paths": ("documents", {
        "doc_id": "doc_id",
        "path": "case doc_id % 12 when 0 then 'services/svc' || (doc_id % 5) || '-service/src/main/java/A' || doc_id || '.java' when 1 then 'libs/lib' || (doc_id % 3) || '/src/test/java/B' || doc_id || '.java' when 2 then 'k8s/istio/vs-' || doc_id || '.yaml'"
                " when 3 then 'deploy/charts/app/templates/t' || doc_id || '.yaml' when 4 then 'services/web/Dockerfile' when 5 then 'libs/core/build.gradle.kts' when 6 then 'infra/istio/gateway-' || doc_id || '.yaml' when 7 then 'services/pay/src/main/resources/application.yml'"
                " when 8 then 'conf/app.properties' when 9 then 'README.md' when 10 then 'deploy/charts/app/chart.yaml' else 'ops/deployments/x' || doc_id || '.yml' end",
        "log_path": "case doc_id % 5 when 0 then 'logs/order-service/app.log' when 1 then 'logs/edge/istio-proxy.txt' when 2 then 'logs/pay-api/pod1/trace.log' when 3 then 'data/blob' || doc_id || '.bin' else 'single' end",
    }),
    "gn": ("supplier", {"id": "s_suppkey", "has_endpoint": "s_suppkey % 3 = 0", "type": "case s_suppkey % 4 when 0 then 'Service' when 1 then 'KafkaTopic' when 2 then 'Class' else case s_suppkey % 8 when 3 then 'AnomalyEpisode' else 'Method' end end", "is_reactive": "s_suppkey % 2 = 0", "complexity": "case s_suppkey % 5 when 0 then 'NONE' when 1 then 'LINEAR' when 2 then 'BRANCHING' when 3 then 'COMPLEX' end"}),
    "vec": ("embeddings", {"doc_id": "vec_id", "embedding": "embedding", "label": "label"}),
    "q": ("benchmark", {"query_id": "item_id", "query": "text"}),
    "docs": ("documents", {"doc_id": "doc_id", "text": "text", "source": "source", "lang": "lang"}),
    "risks": ("orders", {"risk_id": "o_orderkey", "severity": "case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' else 'LOW' end", "category": "case o_orderstatus when 'F' then 'DATA' when 'O' then 'RUNTIME' else 'BUILD' end", "service": "'svc-' || (o_custkey % 10)"}),
    "code": ("documents", {"doc_id": "doc_id", "body": "text || case doc_id % 5 when 0 then '' when 1 then ' a.map(x).filter(y)' when 2 then ' b.flatMap(x).retry(3)' when 3 then ' c.zipWith(d).switchMap(e).then()' else ' f.map(a).map(b).map(c).map(d).map(e).map(g)' end"}),
    "narrative": ("documents", {"doc_id": "doc_id", "text": "'# Flow' || chr(10) || text || chr(10) || '## Steps' || chr(10) || 'Therefore ' || source || ' calls svc-' || (doc_id % 10) || case when doc_id % 2 = 0 then ', then it finally returns because of svc-3' else '' end", "service_a": "'svc-' || (doc_id % 10)", "service_b": "'svc-3'"}),
}


def expressions(name: str, dialect: str) -> tuple[str, list[str]]:
    table, columns = TABLES[name]
    digest = {"spark": "sha2({}, 256)", "duckdb": "sha256({})"}[dialect]

    def put(e: str) -> str:
        while (at := e.find("sha2_256(")) >= 0:
            end = e.index(")", at)
            e = e[:at] + digest.format(e[at + 9 : end]) + e[end + 1 :]
        return e

    return table, [f"{put(e)} as {c}" for c, e in columns.items()]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = expressions(name, "spark")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def sql(name: str) -> str:
    table, columns = expressions(name, "duckdb")
    return f"{name} as (select {', '.join(columns)} from {table})"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call graph over suppliers: s -> 2s + 1 and 6s + 3, modulo their number."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    n = s.count()
    both = s.selectExpr("s_suppkey as src", f"(2 * s_suppkey + 1) % {n} as dst").union(s.selectExpr("s_suppkey", f"(6 * s_suppkey + 3) % {n}"))
    return both.where("src <> dst").distinct()


EDGES_SQL = "nn as (select count(*) n from supplier), ge as (select distinct src, dst from (select s_suppkey src, (2 * s_suppkey + 1) % n dst from supplier, nn union all select s_suppkey, (6 * s_suppkey + 3) % n from supplier, nn) where src <> dst)"


def topics(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """(topic, service): brands as topics; suppliers of returned or accepted lines as the two sides."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(f"l_returnflag = '{flag}'").select("l_partkey", "l_suppkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).selectExpr("p_brand as topic", "'svc-' || (l_suppkey % 20) as service").distinct()


TOPICS_SQL = "tp as (select distinct l_returnflag f, p_brand topic, 'svc-' || (l_suppkey % 20) service from lineitem join part on l_partkey = p_partkey)"
