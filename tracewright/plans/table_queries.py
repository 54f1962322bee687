"""Queries over artifacts, files, metadata and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import logs, text
from tracewright.operators import code, evaluation, relational, report
from tracewright.operators.windows import zero_filled
from tracewright.plans.adapters import frame, sql


def old_new(spark, sf):
    return tuple(frame(spark, sf, n).where("keep").drop("keep") for n in ("art_old", "art_new"))


OLD_NEW = f"{sql('art_old')}, {sql('art_new')}, o as (select * from art_old where keep), n as (select * from art_new where keep)"


def changed(spark, sf):
    return relational.changed(*old_new(spark, sf))


def unseen(spark, sf):
    old, new = old_new(spark, sf)
    return relational.unseen(new, old, "path").select("path", "hash")


def upsert(spark, sf):
    old, new = old_new(spark, sf)
    return relational.upsert(old, new, ["path"], F.col("seq")).select("path", "hash", F.col("seq").cast("int").alias("seq"))


def latest(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows = relational.latest_by_key(orders, ["o_orderstatus"], F.struct("o_orderdate", "o_orderkey"))
    return rows.select("o_orderstatus", "o_orderkey", "o_orderdate")


FILE = r"""case when lower(path) like '%dockerfile' then 'DOCKERFILE' when (lower(path) like '%/helm/%' or lower(path) like '%charts/%') and lower(path) like '%/templates/%' then 'HELM_CHART'
 when lower(path) like '%k8s/%' or regexp_matches(lower(path), '(deployment|service|configmap)\.yaml$') then 'K8S_MANIFEST' when lower(path) like '%/istio/%' or lower(path) like '%virtual-service%' or lower(path) like '%destination-rule%' then 'ISTIO_MANIFEST'
 when (lower(path) like '%/helm/%' or lower(path) like '%charts/%') and lower(path) like '%chart.yaml' then 'HELM_CHART' when regexp_matches(lower(path), '(pom\.xml|build\.gradle|build\.gradle\.kts|settings\.gradle|settings\.gradle\.kts)$') then 'BUILD_FILE'
 when ext = 'java' then 'JAVA_SOURCE' when ext in ('yml', 'yaml') and (path like '%src/main/resources/application.%' or path like '%application.yaml%') then 'YAML_CONFIG' when ext in ('yml', 'yaml') and lower(path) like '%/deployments/%' then 'K8S_MANIFEST'
 when ext in ('yml', 'yaml') and lower(path) like '%istio/%' then 'ISTIO_MANIFEST' when ext in ('yml', 'yaml') and (lower(path) like '%helm/%' or lower(path) like '%charts/%') then 'HELM_CHART' when ext in ('yml', 'yaml') then 'YAML_CONFIG' when ext = 'properties' then 'PROPERTIES_CONFIG' else 'OTHER' end"""
FILES = rf"{sql('paths')}, x as (select *, regexp_extract(lower(path), '^.+\.([^.]+)$', 1) ext from paths), ty as (select doc_id, path, log_path, {FILE} file_type from x)"
FILE_TYPES = ("JAVA_SOURCE", "YAML_CONFIG", "PROPERTIES_CONFIG", "K8S_MANIFEST", "ISTIO_MANIFEST", "HELM_CHART", "DOCKERFILE", "BUILD_FILE", "OTHER")


def files(spark, sf):
    p = frame(spark, sf, "paths")
    return p.select("doc_id", logs.file_type(F.col("path")).alias("file_type"), logs.module_service(F.col("path")).alias("service"), logs.module(F.col("path")).alias("module"))


LOG_KIND = "case when regexp_matches(lower(log_path), 'istio|envoy|proxy') then 'ISTIO' when lower(log_path) like '%app%' or lower(log_path) like '%.log' then 'APP' else 'UNKNOWN' end"


def log_types(spark, sf):
    return frame(spark, sf, "paths").select("doc_id", logs.log_type(F.col("log_path")).alias("log_type"))


def path_services(spark, sf):
    p = frame(spark, sf, "paths")
    return p.select("doc_id", logs.service_of_log_path(F.col("log_path")).alias("log_service"), logs.service_of_source_path(F.col("path")).alias("source_service"))


PATH_SERVICES = f"""with {sql("paths")}, p as (select *, list_filter(string_split(log_path, '/'), lambda x: x <> '') parts from paths), n as (select *, list_filter(parts, lambda x: regexp_matches(x, '(-service|-api)$')) named from p)
select doc_id, case when len(named) > 0 then named[len(named)] when len(parts) > 1 then parts[len(parts) - 1] else 'unknown' end log_service,
 case when regexp_extract(path, 'services/([^/]+)/', 1) <> '' then regexp_extract(path, 'services/([^/]+)/', 1) when regexp_extract(path, '^([^/]+)/', 1) <> '' then regexp_extract(path, '^([^/]+)/', 1) else 'unknown' end source_service from n"""


def type_counts(spark, sf):
    return zero_filled(files(spark, sf), "file_type", FILE_TYPES)


def dominant(spark, sf):
    p = frame(spark, sf, "paths").select("doc_id", "path", logs.log_type(F.col("log_path")).alias("log_type"))
    return relational.dominant(p.withColumn("folder", F.substring_index("path", "/", 1)), "folder", "log_type", "doc_id")


def risk_matrix(spark, sf):
    return report.risk_matrix(frame(spark, sf, "risks"))


def summary(spark, sf):
    return report.summary(frame(spark, sf, "risks"))


def complexity(spark, sf):
    return code.complexities(frame(spark, sf, "code")).select("doc_id", "reactive_complexity", "difficulty")


def listed(words):
    return ", ".join(f"'{w}'" for w in words)


COMPLEXITY = rf"""{sql("code")}, c as (select doc_id, regexp_extract_all(body, '(\w+)\s*\(', 1) k from code), n as (select doc_id, len(list_filter(k, lambda x: x in ({listed(text.REACTIVE)}))) r, len(list_filter(k, lambda x: x in ({listed(text.BRANCHING)}))) b from c),
cx as (select doc_id, case when r = 0 then 'NONE' when b >= 2 or r >= 6 then 'COMPLEX' when b >= 1 then 'BRANCHING' else 'LINEAR' end reactive_complexity from n)"""


def counted(spark, sf):
    return frame(spark, sf, "code").select("doc_id", text.occurrences(F.col("body")).alias("operators"))


COUNTED = f"with {sql('code')} select doc_id, cast({' + '.join(f'(length(body) - length(replace(body, {w!r}, {chr(39) * 2}))) / {len(w)}' for w in text.COUNTED)} as bigint) operators from code"


def hashes(spark, sf):
    return frame(spark, sf, "docs").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


def estimates(spark, sf):
    return frame(spark, sf, "docs").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def chunks(spark, sf):
    return code.split_chunks(frame(spark, sf, "docs").select(F.col("doc_id").alias("key"), "text"), 512).select(F.col("key").alias("doc_id"), "part", "tokens")


CHUNKS = f"""with recursive {sql('docs')}, al as (select doc_id, string_split(text, chr(10)) l from docs), ls as (select doc_id, unnest(l) one, generate_subscripts(l, 1) i from al),
ln as (select doc_id, i, len(list_filter(regexp_split_to_array(one, '[\\s{{}}();,.<>]+'), lambda x: x <> '')) n from ls),
r as (select doc_id, i, 1 part, n held from ln where i = 1 union all select r.doc_id, ln.i, case when held + n > 512 then part + 1 else part end, case when held + n > 512 then n else held + n end from r join ln on ln.doc_id = r.doc_id and ln.i = r.i + 1)
select doc_id, cast(part as int) part, max(held) tokens from r group by all"""


def slugs(spark, sf):
    return frame(spark, sf, "docs").select("doc_id", text.slug(F.col("text")).alias("slug"))


def coherence(spark, sf):
    return frame(spark, sf, "narrative").select("doc_id", F.round(text.coherence(F.col("text")), 6).alias("coherence"))


CONNECT = " + ".join(f"cast(contains(lower(text), '{c}') as int)" for c in text.CONNECTORS)


def completeness(spark, sf):
    n = frame(spark, sf, "narrative")
    steps = F.array("service_a", "service_b")
    return n.select("doc_id", F.round(evaluation.completeness(F.col("text"), steps), 6).alias("completeness"))


def findings(spark, sf):
    return report.findings(frame(spark, sf, "risks")).select("risk_id", "severity", "category")


def roadmap(spark, sf):
    """Orders of each day as phases, numbered over all."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderstatus as flow_id", "o_orderkey as `order`")
    return report.roadmap(orders).select("flow_id", "order", "phase")


def means(spark, sf):
    """Labels as results of two measures."""
    rows = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("'run' as variant", "stack(2, 'quality', cast(quality as double), 'toxic', cast(toxic as double)) as (measure, value)")
    return evaluation.overall(rows).select("variant", "measure", F.round("mean", 6).alias("mean"), "n")


def code_terms(spark, sf):
    """Terms of the code analyzer and how often they occur."""
    terms = frame(spark, sf, "docs").select(F.explode(text.analyzed(F.col("text"), code=True)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


TERMS = rf"""with {sql("docs")}, t as (select unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '{text.NOT_TERM}'), lambda x: x <> '')) term from docs)
select term, count(*) n from t where term not in ({listed(text.CODE_STOP_WORDS)}) group by all"""


QUERIES = {
    "risk_findings": (findings, f"with {sql('risks')} select risk_id, severity, category from risks order by case severity when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 else 4 end, risk_id limit 5"),
    "roadmap_phases": (roadmap, 'select o_orderstatus flow_id, o_orderkey as "order", cast(row_number() over (order by o_orderstatus, o_orderkey) as int) phase from orders'),
    "evaluation_means": (means, "select 'run' variant, measure, round(avg(v), 6) mean, count(*) n from (select 'quality' measure, cast(quality as double) v from labels union all select 'toxic', cast(toxic as double) from labels) group by all"),
    "code_terms": (code_terms, TERMS),
    "changed_artifacts": (changed, f"with {OLD_NEW} select coalesce(o.path, n.path) path, case when o.path is null then 'ADDED' when n.path is null then 'REMOVED' else 'MODIFIED' end change from o full join n on o.path = n.path where o.hash is distinct from n.hash"),
    "new_blobs_anti": (unseen, f"with {OLD_NEW} select path, hash from n where path not in (select path from o)"),
    "upsert_latest": (upsert, f"with {OLD_NEW}, u as (select path, hash, seq from o union all select path, hash, seq from n) select path, hash, cast(seq as int) seq from u qualify row_number() over (partition by path order by seq desc) = 1"),
    "latest_snapshot": (latest, "select o_orderstatus, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_orderstatus order by o_orderdate desc, o_orderkey desc) = 1"),
    "file_classify": (files, f"with {FILES} select doc_id, file_type, case when regexp_extract(path, '(?:^|/)services/([^/]+)/', 1) <> '' then regexp_extract(path, '(?:^|/)services/([^/]+)/', 1) else regexp_extract(path, '(?:^|/)libs/([^/]+)/', 1) end service, case when path like '%/src/main/%' then 'main' when path like '%/src/test/%' then 'test' else '' end module from ty"),
    "log_type_classify": (log_types, f"with {sql('paths')} select doc_id, {LOG_KIND} log_type from paths"),
    "service_from_path": (path_services, PATH_SERVICES),
    "type_counts_zero_filled": (type_counts, f"with {FILES} select v.t file_type, count(ty.file_type) n from (values {', '.join(f'({t!r})' for t in FILE_TYPES)}) v(t) left join ty on ty.file_type = v.t group by all"),
    "dominant_type": (dominant, f"with {sql('paths')}, k as (select doc_id, string_split(path, '/')[1] folder, {LOG_KIND} log_type from paths) select folder, arg_min(log_type, (case when log_type = 'UNKNOWN' then 1 else 0 end, doc_id)) log_type from k group by all"),
    "risk_matrix": (risk_matrix, f"with {sql('risks')} select 'severity' dimension, severity as value, count(*) n from risks group by all union all select 'category', category, count(*) from risks group by all"),
    "exec_summary": (summary, f"with {sql('risks')} select count(*) risks, count(distinct service) services, count(*) filter (severity = 'CRITICAL') critical, count(*) filter (severity = 'HIGH') high from risks"),
    "reactive_complexity": (complexity, f"with {COMPLEXITY} select doc_id, reactive_complexity, case reactive_complexity when 'NONE' then 'TRIVIAL' when 'LINEAR' then 'LOW' when 'BRANCHING' then 'MEDIUM' else 'HIGH' end difficulty from cx"),
    "difficulty_counts": (lambda s, d: relational.counts_of(complexity(s, d), "difficulty"), f"with {COMPLEXITY} select case reactive_complexity when 'NONE' then 'TRIVIAL' when 'LINEAR' then 'LOW' when 'BRANCHING' then 'MEDIUM' else 'HIGH' end difficulty, count(*) n from cx group by all"),
    "operator_counts": (counted, COUNTED),
    "chunk_hashes": (hashes, f"with {sql('docs')} select doc_id, substring(sha256(text), 1, 16) content_hash from docs"),
    "token_estimate": (estimates, rf"with {sql('docs')} select doc_id, len(list_filter(regexp_split_to_array(text, '[\s{{}}();,.<>]+'), lambda x: trim(x) <> '')) tokens from docs"),
    "chunk_split": (chunks, CHUNKS),
    "slugify": (slugs, f"with {sql('docs')} select doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug from docs"),
    "coherence_score": (coherence, rf"with {sql('narrative')} select doc_id, round((least(1.0, len(regexp_split_to_array(text, '(?m)^#{{1,3}} ')) / 5.0) + least(1.0, ({CONNECT}) / 4.0)) / 2.0, 6) coherence from narrative"),
    "completeness_score": (completeness, f"with {sql('narrative')} select doc_id, round((cast(contains(text, service_a) as int) + cast(contains(text, service_b) as int)) / 2.0, 6) completeness from narrative"),
}
