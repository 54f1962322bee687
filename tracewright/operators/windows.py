"""Per-service time windows: features, bursts, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import ordered

FIVE_MINUTES = 300
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def is_error(severity: Column) -> Column:
    return F.coalesce(severity.isin("ERROR", "FATAL"), F.lit(False))


def present(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def in_range(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


def binned(events: DataFrame, seconds: int = FIVE_MINUTES, by: str | None = "service") -> DataFrame:
    """+ bin, start_us: windows from the first event of the service (or of all), to the minute. A window
    that would start just at the last event is left out, as the windows end before it.

    The first and last event are aggregates joined back, not a window over the service: a service may
    hold a third of all rows, and its rows needn't meet for this."""
    width = seconds * 1_000_000
    if by is None:  # one first event for all
        start = F.lit(events.agg(F.min(micros(F.col("ts")))).first()[0] or 0)
        return events.withColumn("bin", F.floor((micros(F.col("ts")) - start) / width).cast("long")).withColumn("start_us", start + F.col("bin") * width)
    ends = events.groupBy(by).agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    first = micros(F.date_trunc("minute", F.col("__first")))
    rows = events.join(ends, by).withColumn("bin", F.floor((micros(F.col("ts")) - first) / width).cast("long")).withColumn("start_us", first + F.col("bin") * width)
    return rows.where(F.col("start_us") < micros(F.col("__last"))).drop("__first", "__last")


def bursts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run of errors in each window (ordered by ts, event_id) over its events."""
    order = ["ts", "event_id"]
    rows = ordered.parted(events.select(*keys, *order, is_error(F.col("severity")).cast("long").alias("__bad")), keys, order)
    marked = ordered.running(rows, keys, order, 1 - F.col("__bad"), "__ok")
    islands = marked.groupBy(*keys, "__ok").agg(F.sum("__bad").alias("__run"), F.count("*").alias("__n"))
    return islands.groupBy(*keys).agg((F.max("__run") / F.sum("__n")).alias("burst_score"))


def features(events: DataFrame, seconds: int = FIVE_MINUTES) -> DataFrame:
    """The feature vector of every window: events: service, ts, event_id, severity, template_id,
    trace_id, exception_class [, latency].

    Counts by template are made first, so that distinct templates and the share of rare ones need no
    distinct over the window's rows."""
    rows = binned(events, seconds)
    keys = ["service", "bin", "start_us"]
    latency = [F.percentile("latency", 0.99).alias("p99_latency")] if "latency" in events.columns else []
    by_template = rows.groupBy(*keys, "template_id").agg(F.count("*").alias("__c"))
    templates = by_template.groupBy(*keys).agg(F.count("template_id").alias("__templates"), F.sum(F.when(F.col("__c") < 3, F.col("__c")).otherwise(0)).alias("__rare"))
    share = lambda c: F.avg(c.cast("double"))
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("total_events"), share(is_error(F.col("severity"))).alias("error_rate"), share(present(F.col("trace_id"))).alias("trace_span_ratio"), share(present(F.col("exception_class"))).alias("exception_rate"), *latency,
    )
    out = base.join(templates, keys).join(bursts(rows, keys), keys)
    n = F.col("total_events")
    return out.select(
        "service", "bin", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("window_start"), F.timestamp_micros(F.col("start_us") + seconds * 1_000_000).cast("timestamp_ntz").alias("window_end"),
        "error_rate", (F.col("__templates") / n).alias("unique_template_ratio"), (n / float(seconds)).alias("event_rate"), (F.col("p99_latency") if latency else F.lit(0.0)).alias("p99_latency"), "burst_score",
        (F.col("__rare") / n).alias("new_template_rate"), "trace_span_ratio", "exception_rate", "total_events",
    )


def severity_of(score: Column) -> Column:
    return F.when(score < 0.6, "LOW").when(score < 0.8, "MEDIUM").when(score < 0.9, "HIGH").otherwise("CRITICAL")


def episodes(windows: DataFrame, threshold: float = 0.65, gap_seconds: int = 600) -> DataFrame:
    """Runs of anomalous windows (service, window_start, window_end, score); the next window joins if it
    starts at most the gap after the end of the last."""
    keys, order = ["service"], ["window_start"]
    rows = ordered.parted(windows.where(F.col("score") >= threshold), keys, order)
    rows = ordered.previous(rows, keys, order, "window_end", "__before")
    late = micros(F.col("window_start")) - micros(F.col("__before")) > gap_seconds * 1_000_000
    rows = ordered.running(rows, keys, order, F.coalesce(late, F.lit(True)).cast("long"), "episode")
    out = rows.groupBy("service", "episode").agg(F.min("window_start").alias("start_time"), F.max("window_end").alias("end_time"), F.max("score").alias("peak_score"), F.count("*").alias("windows"))
    return out.withColumn("severity", severity_of(F.col("peak_score")))


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """A count for each of the values, 0 where there is none."""
    spark = rows.sparkSession
    every = spark.range(len(values)).select(F.element_at(F.array(*map(F.lit, values)), F.col("id").cast("int") + 1).alias(column))
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stage_metrics(runs: DataFrame) -> DataFrame:
    """runs(stage, ok boolean, seconds) -> p95, p99 and success ratio of each stage."""
    rates = runs.groupBy("stage").agg(F.avg(F.col("ok").cast("double")).alias("success_ratio"), F.count("*").alias("runs"))
    slow = ordered.quantiles(runs, ["stage"], "seconds", {"p95": 0.95, "p99": 0.99})
    return rates.join(slow, "stage", "left").select("stage", "p95", "p99", "success_ratio", "runs")
