"""Queries of the log path: lines, templates, window features, episodes, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import logs, text
from tracewright.operators import anomaly, drain, ordered, projections, relational, sequences, windows
from tracewright.plans.adapters import frame, sql
from tracewright.streaming import events as stream


def parse(spark, sf):
    p = frame(spark, sf, "lines").select("event_id", logs.parsed_line(F.col("line")).alias("p"))
    return p.select("event_id", "p.source", "p.ts_text", "p.severity", "p.message").where("source is not null")


PARSE = f"""with {sql("lines")}, m as (select *, case when regexp_matches(line, '{logs.APP}') then 1 when regexp_matches(line, '{logs.ACCESS}') then 2 when regexp_matches(line, '{logs.ENVOY}') then 3 end k from lines)
select event_id, case k when 1 then 'APP' when 2 then 'ISTIO_ACCESS' else 'ISTIO_ENVOY' end source,
  case k when 1 then regexp_extract(line, '{logs.APP}', 1) when 2 then regexp_extract(line, '{logs.ACCESS}', 1) else regexp_extract(line, '{logs.ENVOY}', 1) end ts_text,
  case k when 1 then regexp_extract(line, '{logs.APP}', 2) when 2 then 'INFO' else case upper(regexp_extract(line, '{logs.ENVOY}', 2)) when 'WARNING' then 'WARN' when 'ERROR' then 'ERROR' else 'INFO' end end severity,
  case k when 1 then regexp_extract(line, '{logs.APP}', 5) when 2 then regexp_extract(line, '{logs.ACCESS}', 2) || ' ' || regexp_extract(line, '{logs.ACCESS}', 3) || ' -> ' || regexp_extract(line, '{logs.ACCESS}', 4)
    else '[' || regexp_extract(line, '{logs.ENVOY}', 3) || '] ' || regexp_extract(line, '{logs.ENVOY}', 4) end message
from m where k is not null"""


def traces(spark, sf):
    return frame(spark, sf, "lines").select("event_id", logs.trace_context(F.col("line")).alias("t")).select("event_id", "t.trace_id", "t.span_id").where("trace_id is not null")


TRACES = f"""with {sql("lines")} select event_id, case when regexp_matches(line, '{logs.TRACEPARENT}') then regexp_extract(line, '{logs.TRACEPARENT}', 1) else regexp_extract(line, '{logs.B3}', 1) end trace_id,
  case when regexp_matches(line, '{logs.TRACEPARENT}') then regexp_extract(line, '{logs.TRACEPARENT}', 2) else regexp_extract(line, '{logs.B3}', 2) end span_id
from lines where regexp_matches(line, '{logs.TRACEPARENT}') or regexp_matches(line, '{logs.B3}')"""


def exceptions(spark, sf):
    return frame(spark, sf, "lines").select("event_id", logs.last_exception(F.col("stack")).alias("x")).select("event_id", "x.exception_class", "x.exception_message").where("exception_class is not null")


EXCEPTIONS = f"""with {sql("lines")}, l as (select event_id, list_filter(list_transform(string_split(stack, chr(10)), lambda x: regexp_replace(x, '{logs.BLANK_ENDS}', '', 'g')), lambda x: regexp_matches(x, '{logs.EXCEPTION_LINE}')) f from lines)
select event_id, regexp_extract(f[len(f)], '{logs.EXCEPTION_LINE}', 1) exception_class, regexp_extract(f[len(f)], '{logs.EXCEPTION_LINE}', 2) exception_message from l where len(f) > 0"""

MASK = "case " + " ".join(f"when regexp_matches(t, '{p}') then '{m}'" for p, m in text.MASKS) + " else t end"
MASKED = f"masked as (select event_id, service, array_to_string(list_transform(regexp_split_to_array(trim(message), '\\s+'), lambda t: {MASK}), ' ') as template from ev)"


def masked(spark, sf):
    return frame(spark, sf, "ev").select("event_id", "service", F.array_join(text.masked_tokens(F.col("message")), " ").alias("template"))


def template_counts(spark, sf):
    return masked(spark, sf).groupBy("template").agg(F.count("*").alias("match_count"))


NOW = "2024-01-01 00:00:00"


def document_projection(spark, sf):
    e = frame(spark, sf, "ev")
    docs = projections.event_documents(e.withColumn("source", F.col("log_type")).withColumn("message", F.concat_ws(" ", F.col("event_id").cast("string"), "message")), "b1", F.lit(NOW).cast("timestamp"))
    return docs


DOCUMENTS = f"""{sql("ev")}, dc as (select 'b1' batch_id, service service_name, log_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp, template_id, event_id || ' ' || message message,
coalesce(trace_id, '') trace_id, '' span_id, severity, '2024-01-01T00:00:00.000000Z' indexed_at from ev)"""


def document_events(spark, sf):
    """Documents of which some lack their severity, batch or time, read back as events."""
    docs = document_projection(spark, sf)
    lost = lambda c, n: F.when(F.length("message") % n != 0, F.col(c)).alias(c)
    events = projections.document_events(docs.select(lost("severity", 3), lost("batch_id", 5), lost("timestamp", 7), lost("template_id", 2), "service_name", "message", "trace_id"), "b2")
    return events.withColumn("ts", projections.iso(F.col("ts")))


DOCUMENT_EVENTS = f"""{DOCUMENTS} select case when length(message) % 5 <> 0 then batch_id else 'b2' end batch_id, service_name service, case when length(message) % 7 <> 0 then timestamp end ts, case when length(message) % 3 <> 0 then severity else 'INFO' end severity,
case when length(message) % 2 <> 0 then template_id else '' end template_id, message, case when trim(trace_id) <> '' then trace_id end trace_id, cast(null as varchar) span_id, 'APP' as source from dc"""


def classified(spark, sf):
    e = frame(spark, sf, "ev")
    return e.select("event_id", sequences.event_type(F.col("severity"), F.col("log_type"), F.col("message")).alias("event_type"), sequences.detail(F.col("template_id"), F.col("message")).alias("detail"))


KIND = "case when severity in ('ERROR', 'FATAL') then 'LOG_ERROR' when log_type = 'ISTIO' then 'ENDPOINT_CALL' when lower(message) like '%kafka%' and lower(message) like '%produce%' then 'KAFKA_PRODUCE' when lower(message) like '%kafka%' and lower(message) like '%consume%' then 'KAFKA_CONSUME' else 'LOG' end"


def features(seconds):
    return lambda spark, sf: rounded(windows.features(frame(spark, sf, "ev"), seconds))


MEASURES = ("error_rate", "unique_template_ratio", "event_rate", "p99_latency", "burst_score", "new_template_rate", "trace_span_ratio", "exception_rate")


def rounded(df):
    return df.select("service", "bin", "window_start", "window_end", *(F.round(c, 6).alias(c) for c in MEASURES), "total_events")


def features_sql(seconds: int) -> str:
    return f"""{sql("ev")}, anchored as (select *, date_trunc('minute', min(ts) over (partition by service)) first, max(ts) over (partition by service) last from ev),
b0 as (select *, cast(floor((epoch_us(ts) - epoch_us(first)) / {seconds * 1_000_000}.0) as bigint) bin from anchored),
b as (select *, epoch_us(first) + bin * {seconds * 1_000_000} start_us from b0 where epoch_us(first) + bin * {seconds * 1_000_000} < epoch_us(last)),
o as (select *, sum(case when severity in ('ERROR', 'FATAL') then 0 else 1 end) over (partition by service, bin order by ts, event_id) ok from b),
isl as (select service, bin, ok, sum(case when severity in ('ERROR', 'FATAL') then 1 else 0 end) run, count(*) n from o group by all),
bu as (select service, bin, max(run) / sum(n) burst from isl group by all),
tc as (select service, bin, template_id, count(*) c from b group by all),
tm as (select service, bin, count(template_id) templates, sum(case when c < 3 then c else 0 end) rare from tc group by all),
ba as (select service, bin, start_us, count(*) n, avg(case when severity in ('ERROR', 'FATAL') then 1.0 else 0 end) er, avg(case when coalesce(trim(trace_id), '') <> '' then 1.0 else 0 end) tr, avg(case when coalesce(trim(exception_class), '') <> '' then 1.0 else 0 end) ex, quantile_cont(latency, 0.99) p99 from b group by all),
feat as (select service, bin, make_timestamp(start_us) window_start, make_timestamp(start_us + {seconds * 1_000_000}) window_end, round(er, 6) error_rate, round(templates / n, 6) unique_template_ratio, round(n / {float(seconds)}, 6) event_rate, round(p99, 6) p99_latency,
  round(burst, 6) burst_score, round(rare / n, 6) new_template_rate, round(tr, 6) trace_span_ratio, round(ex, 6) exception_rate, n total_events from ba join tm using (service, bin) join bu using (service, bin))"""


SIX_HOURS = 6 * 3600


def burst(spark, sf):
    rows = windows.binned(frame(spark, sf, "ev"), SIX_HOURS)
    return windows.bursts(rows, ["service", "bin"]).select("service", "bin", F.round("burst_score", 6).alias("burst_score"))


def p99(spark, sf):
    return ordered.quantiles(frame(spark, sf, "ev"), ["service"], "latency", {"p99": 0.99}).select("service", F.round("p99", 6).alias("p99_latency"))


def episodes(spark, sf):
    scored = windows.features(frame(spark, sf, "ev"), SIX_HOURS).select("service", "window_start", "window_end", F.col("error_rate").alias("score"))
    return windows.episodes(scored, 0.35, SIX_HOURS).select("service", "episode", "start_time", "end_time", F.round("peak_score", 6).alias("peak_score"), "windows", "severity")


EPISODES = features_sql(SIX_HOURS) + f""", an as (select service, window_start, window_end, error_rate score, lag(window_end) over (partition by service order by window_start) prev from feat where error_rate >= 0.35),
nu as (select *, sum(case when prev is null or epoch_us(window_start) - epoch_us(prev) > {SIX_HOURS * 1_000_000} then 1 else 0 end) over (partition by service order by window_start) episode from an),
ep as (select service, cast(episode as bigint) episode, min(window_start) start_time, max(window_end) end_time, round(max(score), 6) peak_score, count(*) windows, case when max(score) < 0.6 then 'LOW' when max(score) < 0.8 then 'MEDIUM' when max(score) < 0.9 then 'HIGH' else 'CRITICAL' end severity from nu group by all)"""


def severities(spark, sf):
    return windows.zero_filled(episodes(spark, sf), "severity", windows.SEVERITIES)


def iforest(spark, sf):
    return anomaly.scored(windows.features(frame(spark, sf, "ev"), SIX_HOURS), ["service"], list(MEASURES), ["window_start"])


def joined(df, *keys):
    return df.select(*keys, F.col("n").cast("long").alias("n"), F.array_join("items", " → ").alias("items"))


ITEM = f"service || '::' || {KIND} || '(' || template_id || ')'"


def lookup(spark, sf):
    e = frame(spark, sf, "ev")
    first = e.select("template_id", F.col("service").alias("first_service"), "ts", "event_id")
    return relational.first_lookup(e.select("event_id", "template_id"), first, "template_id", "first_service", ["ts", "event_id"])


def sampled(spark, sf):
    e = frame(spark, sf, "ev")
    return relational.stratified(e, 5000).select("event_id", "service", "severity")


SAMPLED = f"""with {sql("ev")}, er as (select * from ev where severity = 'ERROR' order by ts, event_id limit 5000), qu as (select (5000 - least(5000, (select count(*) from ev where severity = 'ERROR'))) // (select count(distinct service) from ev) q),
r as (select *, row_number() over (partition by service order by ts, event_id) k from ev where severity <> 'ERROR') select event_id, service, severity from er union all select event_id, service, severity from r, qu where k <= q"""


def pairs(spark, sf):
    found = sequences.frequent_patterns(sequences.trace_sequences(frame(spark, sf, "ev")), 0.03, 2)
    return found.select(F.array_join("pattern", " → ").alias("pattern"), F.col("count").cast("long").alias("count"))


PAIRS = f"""with {sql("ev")}, it as (select trace_id s, {ITEM} i, row_number() over (partition by trace_id order by ts, event_id) p, count(*) over (partition by trace_id) n from ev where trace_id is not null), f as (select s, i, min(p) a, max(p) b from it where n >= 2 group by all),
m as (select greatest(1, ceil(count(distinct s) * 0.03)) least from f), pat as (select i pattern, count(*) as count from f group by all union all select x.i || ' → ' || y.i, count(*) from f x join f y on x.s = y.s and x.a < y.b group by all)
select pattern, count from pat, m where count >= least"""


def patterns(spark, sf):
    found = sequences.enriched(sequences.frequent_patterns(sequences.trace_sequences(frame(spark, sf, "ev"))))
    return found.select("description", "count", F.round("support", 6).alias("support"), "pattern_type", "has_errors", "has_kafka", "cross_service", F.array_join("services", ",").alias("services"))


#: A pattern's earliest end in each sequence, grown item by item while enough sequences hold it.
PATTERNS = f"""with recursive {sql("ev")}, al as (select trace_id s, {ITEM} i, row_number() over (partition by trace_id order by ts, event_id) p, count(*) over (partition by trace_id) n from ev where trace_id is not null),
it as (select s, i, p from al where n >= 2), m as (select count(distinct s) n, greatest(1, ceil(count(distinct s) * {sequences.MIN_SUPPORT})) least from it),
r as (select * from (select i pattern, s, min(p) p, 1 length from it group by i, s) qualify count(*) over (partition by pattern) >= (select least from m)
union all select * from (select r.pattern || ' → ' || it.i pattern, r.s, min(it.p) p, r.length + 1 length from r join it on it.s = r.s and it.p > r.p where r.length < {sequences.MAX_LENGTH} group by r.pattern, it.i, r.s, r.length) qualify count(*) over (partition by pattern) >= (select least from m)),
c as (select pattern description, count(*) as count, string_split(pattern, ' → ') l from r group by all),
d as (select *, list_transform(l, lambda x: string_split(x, '::')[1]) v from c), e as (select *, list_filter(v, lambda x, k: list_position(v, x) = k) sv, len(list_filter(l, lambda x: contains(x, '::LOG_ERROR('))) er, len(list_filter(l, lambda x: contains(x, '::KAFKA_'))) ka from d)
select description, count, round(count / m.n, 6) support, case when len(l) >= 2 and er = len(l) then case when len(sv) > 1 then 'ERROR_PROPAGATION' else 'CASCADE_FAILURE' end when len(l) >= 2 and ka >= 1 then 'ASYNC_FANOUT'
  when len(list_filter(range(1, len(l) - 1), lambda k: l[k] = l[k + 1] and l[k] = l[k + 2])) > 0 then 'RETRY_PATTERN' else 'NORMAL_FLOW' end pattern_type, er > 0 has_errors, ka > 0 has_kafka, len(sv) > 1 cross_service, array_to_string(sv, ',') services from e, m"""


def passages(spark, sf):
    e = frame(spark, sf, "ev")
    none = F.lit(None).cast("string")
    return e.select("event_id", text.log_passage(F.col("service"), F.col("severity"), F.col("template_id"), F.col("exception_class"), none, none).alias("passage"))


def drain_clusters(spark, sf):
    return drain.clusters(frame(spark, sf, "ev").select("message", F.col("event_id").alias("seq"))).select("cluster_id", "template", "match_count")


def stages(spark, sf):
    """Orders as runs of stages: their priority, status and price."""
    runs = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderpriority as stage", "o_orderstatus <> 'P' as ok", "o_totalprice as seconds")
    return windows.stage_metrics(runs).select("stage", *(F.round(c, 6).alias(c) for c in ("p95", "p99", "success_ratio")), "runs")


STAGES = "select o_orderpriority stage, round(quantile_cont(o_totalprice, 0.95), 6) p95, round(quantile_cont(o_totalprice, 0.99), 6) p99, round(avg(case when o_orderstatus <> 'P' then 1.0 else 0 end), 6) success_ratio, count(*) runs from orders group by all"


def template_texts(spark, sf):
    """What is embedded of each template of each service."""
    rows = masked(spark, sf).groupBy("service", "template").agg(F.count("*").alias("n"))
    return rows.select("service", text.template_passage(F.col("service"), F.col("template"), F.col("n")).alias("passage"))


def supports(spark, sf):
    return sequences.pair_supports(sequences.trace_sequences(frame(spark, sf, "ev")))


SUPPORTS = PAIRS.rsplit("select pattern, count", 1)[0] + "select pattern, count from pat"


E5, E6 = features_sql(300), features_sql(SIX_HOURS)
QUERIES = {
    "log_parse_cascade": (parse, PARSE),
    "trace_context_extract": (traces, TRACES),
    "exception_last": (exceptions, EXCEPTIONS),
    "template_mask": (masked, f"with {sql('ev')}, {MASKED} select * from masked"),
    "template_counts": (template_counts, f"with {sql('ev')}, {MASKED} select template, count(*) match_count from masked group by all"),
    "drain_clusters": (drain_clusters, None),
    "event_document_projection": (document_projection, f"with {DOCUMENTS} select * from dc"),
    "document_event_projection": (document_events, f"with {DOCUMENT_EVENTS}"),
    "event_type_classify": (classified, f"with {sql('ev')} select event_id, {KIND} event_type, template_id detail from ev"),
    "log_features_5m": (features(300), f"with {E5} select * from feat"),
    "log_features_6h": (features(SIX_HOURS), f"with {E6} select * from feat"),
    "error_burst": (burst, f"with {E6} select service, bin, round(burst, 6) burst_score from bu"),
    "latency_p99": (p99, f"with {sql('ev')} select service, round(quantile_cont(latency, 0.99), 6) p99_latency from ev group by all"),
    "anomaly_episodes_by_error_rate": (episodes, f"with {EPISODES} select * from ep"),
    "episode_severity_zero_filled": (severities, f"with {EPISODES} select v.severity, count(ep.severity) n from (values ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) v(severity) left join ep on ep.severity = v.severity group by all"),
    "iforest_scores": (iforest, None),
    "trace_sequences": (lambda s, d: joined(sequences.trace_sequences(frame(s, d, "ev")), "trace_id"), f"with {sql('ev')} select trace_id, count(*) n, string_agg({ITEM}, ' → ' order by ts, event_id) items from ev where trace_id is not null group by all having count(*) >= 2"),
    "temporal_sequences": (lambda s, d: joined(sequences.window_sequences(frame(s, d, "ev")), "bin"), f"with {sql('ev')}, b as (select *, cast(floor((epoch_us(ts) - (select epoch_us(min(ts)) from ev)) / 30000000.0) as bigint) bin from ev) select bin, count(*) n, string_agg({ITEM}, ' → ' order by ts, event_id) items from b group by all having count(*) >= 2"),
    "prefixspan_len2": (pairs, PAIRS),
    "pair_supports": (supports, SUPPORTS),
    "prefixspan_full": (patterns, PATTERNS),
    "template_service_lookup": (lookup, f"with {sql('ev')}, f as (select template_id, arg_min(service, (epoch_us(ts), event_id)) s from ev group by all) select event_id, template_id, s first_service from ev join f using (template_id)"),
    "stratified_sample": (sampled, SAMPLED),
    "embedding_texts": (passages, f"with {sql('ev')} select event_id, 'passage: [' || service || '] ' || severity || ': ' || template_id || case when exception_class is not null then ' | exception: ' || exception_class else '' end passage from ev"),
    "template_texts": (template_texts, f"with {sql('ev')}, {MASKED} select service, 'passage: [' || service || '] Log template: ' || template || ' (frequency: ' || count(*) || ')' passage from masked group by service, template"),
    "stage_metrics": (stages, STAGES),
    "streaming_windows": (stream.window_counts_once, "select date_trunc('day', ts) as start, event_type, count(*) n, round(sum(value), 6) total from events group by all"),
}
