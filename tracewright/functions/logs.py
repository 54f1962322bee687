"""Expressions over raw log lines and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line shapes, tried in order (fixed values).
APP = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\.?\d*)\s+(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+\[([^\]]+)\]\s+([^\s]+)\s+-\s+(.+)$"
ACCESS = r'^\[([^\]]+)\]\s+"(\w+)\s+([^"]+)\s+[^"]+"\s+(\d+)\s+.+$'
ENVOY = r"^\[([^\]]+)\]\[(\w+)\]\[([^\]]+)\]\s+(.+)$"
EXCEPTION = r"(?:Caused by:\s+)?([a-zA-Z0-9_.]+):\s*(.*)"
#: It has to fit the whole trimmed line, so that stack frames name no exception.
EXCEPTION_LINE, BLANK_ENDS = rf"^{EXCEPTION}$", r"^[\x00-\x20]+|[\x00-\x20]+$"
TRACEPARENT = r"(?i)traceparent[=:]\s*00-([0-9a-f]{32})-([0-9a-f]{16})-\d{2}"
B3 = r"(?i)x-b3[=:]\s*([0-9a-f]{16,32})-([0-9a-f]{16})"


def parsed_line(line: Column) -> Column:
    """struct(source, ts_text, severity, thread, logger, message) of the first shape that fits, else null."""
    at = lambda p, i: F.regexp_extract(line, p, i)
    none = F.lit(None).cast("string")

    def shape(source, ts, severity, thread, logger, message):
        return F.struct(F.lit(source).alias("source"), ts.alias("ts_text"), severity.alias("severity"), thread.alias("thread"), logger.alias("logger"), message.alias("message"))

    level = F.when(F.upper(at(ENVOY, 2)) == "WARNING", "WARN").when(F.upper(at(ENVOY, 2)) == "ERROR", "ERROR").otherwise("INFO")
    return F.coalesce(
        F.when(line.rlike(APP), shape("APP", at(APP, 1), at(APP, 2), at(APP, 3), at(APP, 4), at(APP, 5))),
        F.when(line.rlike(ACCESS), shape("ISTIO_ACCESS", at(ACCESS, 1), F.lit("INFO"), none, none, F.concat(at(ACCESS, 2), F.lit(" "), at(ACCESS, 3), F.lit(" -> "), at(ACCESS, 4)))),
        F.when(line.rlike(ENVOY), shape("ISTIO_ENVOY", at(ENVOY, 1), level, none, none, F.concat(F.lit("["), at(ENVOY, 3), F.lit("] "), at(ENVOY, 4)))),
    )


def instant(text: Column) -> Column:
    """Zone-less timestamps are UTC; what can't be read is null."""
    return F.try_to_timestamp(F.regexp_replace(text, " ", "T"))


def trace_context(text: Column) -> Column:
    """struct(trace_id, span_id): W3C traceparent, else the single B3 header, else null."""
    of = lambda p: F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("trace_id"), F.regexp_extract(text, p, 2).alias("span_id")))
    return F.coalesce(of(TRACEPARENT), of(B3))


def last_exception(text: Column) -> Column:
    """struct(exception_class, exception_message) of the last line that is one as a whole, trimmed."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, BLANK_ENDS, "")), lambda x: x.rlike(EXCEPTION_LINE))
    last = F.element_at(lines, -1)
    return F.when(F.size(lines) > 0, F.struct(F.regexp_extract(last, EXCEPTION_LINE, 1).alias("exception_class"), F.regexp_extract(last, EXCEPTION_LINE, 2).alias("exception_message")))


def service_of_log_path(path: Column) -> Column:
    """Last part of the path that ends in -service or -api, else the parent folder."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    named = F.filter(parts, lambda x: x.rlike("(-service|-api)$"))
    return F.when(F.size(named) > 0, F.element_at(named, -1)).when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("unknown")


def service_of_source_path(path: Column, default: str = "unknown") -> Column:
    """services/X/, else the first folder."""
    named, first = F.regexp_extract(path, r"services/([^/]+)/", 1), F.regexp_extract(path, r"^([^/]+)/", 1)
    return F.when(named != "", named).when(first != "", first).otherwise(default)


def module_service(path: Column) -> Column:
    """services/X or libs/X anywhere in the path."""
    s, lib = F.regexp_extract(path, r"(?:^|/)services/([^/]+)/", 1), F.regexp_extract(path, r"(?:^|/)libs/([^/]+)/", 1)
    return F.when(s != "", s).otherwise(lib)


def module(path: Column) -> Column:
    return F.when(path.contains("/src/main/"), "main").when(path.contains("/src/test/"), "test").otherwise("")


def log_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("istio|envoy|proxy"), "ISTIO").when(low.contains("app") | low.endswith(".log"), "APP").otherwise("UNKNOWN")


def file_type(path: Column) -> Column:
    """One of nine types by the path, first rule that holds."""
    low = F.lower(path)
    ext = F.regexp_extract(low, r"^.+\.([^.]+)$", 1)
    chart = low.contains("/helm/") | low.contains("charts/")
    return (
        F.when(low.endswith("dockerfile"), "DOCKERFILE")
        .when(chart & low.contains("/templates/"), "HELM_CHART")
        .when(low.contains("k8s/") | low.rlike(r"(deployment|service|configmap)\.yaml$"), "K8S_MANIFEST")
        .when(low.contains("/istio/") | low.contains("virtual-service") | low.contains("destination-rule"), "ISTIO_MANIFEST")
        .when(chart & low.endswith("chart.yaml"), "HELM_CHART")
        .when(low.rlike(r"(pom\.xml|build\.gradle|build\.gradle\.kts|settings\.gradle|settings\.gradle\.kts)$"), "BUILD_FILE")
        .when(ext == "java", "JAVA_SOURCE")
        .when(ext.isin("yml", "yaml") & (path.contains("src/main/resources/application.") | path.contains("application.yaml")), "YAML_CONFIG")
        .when(ext.isin("yml", "yaml") & low.contains("/deployments/"), "K8S_MANIFEST")
        .when(ext.isin("yml", "yaml") & low.contains("istio/"), "ISTIO_MANIFEST")
        .when(ext.isin("yml", "yaml") & (low.contains("helm/") | low.contains("charts/")), "HELM_CHART")
        .when(ext.isin("yml", "yaml"), "YAML_CONFIG")
        .when(ext == "properties", "PROPERTIES_CONFIG")
        .otherwise("OTHER")
    )
