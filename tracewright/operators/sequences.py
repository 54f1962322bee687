"""Call sequences of traces and time windows, frequent patterns in them, and their classes."""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.windows import binned, is_error, present

WINDOW_SECONDS, MIN_SUPPORT, MAX_LENGTH = 30, 0.03, 10


def event_type(severity: Column, log_type: Column, template: Column) -> Column:
    """LOG_ERROR before ENDPOINT_CALL before the two Kafka kinds, else LOG (fixed names)."""
    low = F.lower(F.coalesce(template, F.lit("")))
    return (
        F.when(is_error(severity), "LOG_ERROR").when(log_type == "ISTIO", "ENDPOINT_CALL").when(low.contains("kafka") & low.contains("produce"), "KAFKA_PRODUCE")
        .when(low.contains("kafka") & low.contains("consume"), "KAFKA_CONSUME").otherwise("LOG")
    )


def detail(template_id: Column, template: Column) -> Column:
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(some(template_id), F.substring(some(template), 1, 200), F.lit(""))


def item(service: Column, kind: Column, what: Column) -> Column:
    return F.concat(service, F.lit("::"), kind, F.lit("("), what, F.lit(")"))


def items_of(events: DataFrame) -> DataFrame:
    """+ item; events: service, severity, log_type, template_id, message."""
    kind = event_type(F.col("severity"), F.col("log_type"), F.col("message"))
    return events.withColumn("item", item(F.col("service"), kind, detail(F.col("template_id"), F.col("message"))))


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, items in order of ts, event_id, for groups of two and more. A trace or a window holds
    few events; its rows meet in one aggregate."""
    packed = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "item"))).alias("__rows")).where("n >= 2")
    return packed.select(*keys, "n", F.transform("__rows", lambda r: r["item"]).alias("items"))


def trace_sequences(events: DataFrame) -> DataFrame:
    return in_order(items_of(events.where(present(F.col("trace_id")))), ["trace_id"])


def window_sequences(events: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Sequences of windows from the first event of all."""
    return in_order(items_of(binned(events, seconds, by=None)), ["bin"])


def frequent_patterns(sequences: DataFrame, support: float = MIN_SUPPORT, longest: int = MAX_LENGTH) -> DataFrame:
    """(pattern, count, support) of subsequences of single items, by PrefixSpan."""
    n = sequences.count()
    least = max(1, -(-n * support // 1))
    rows = sequences.select(F.transform("items", lambda i: F.array(i)).alias("sequence"))
    spans = PrefixSpan(minSupport=max(0.0, (least - 0.5) / max(1, n)), maxPatternLength=longest, sequenceCol="sequence").findFrequentSequentialPatterns(rows)
    single = spans.where(F.forall("sequence", lambda s: F.size(s) == 1))
    return single.select(F.transform("sequence", lambda s: s[0]).alias("pattern"), F.col("freq").alias("count"), (F.col("freq") / F.lit(float(max(1, n)))).alias("support"))


def longest_run(items: Column) -> Column:
    """Most equal items in a row."""
    step = lambda a, x: F.struct(F.when(a["last"].eqNullSafe(x), a["run"] + 1).otherwise(F.lit(1)).alias("run"), F.greatest(a["most"], F.when(a["last"].eqNullSafe(x), a["run"] + 1).otherwise(F.lit(1))).alias("most"), x.alias("last"))
    return F.aggregate(items, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(None).cast("string").alias("last")), step, lambda a: a["most"])


def services_of(items: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda i: F.substring_index(i, "::", 1)))


def pattern_class(items: Column) -> Column:
    """Fixed names."""
    of = lambda part: F.size(F.filter(items, lambda i: i.contains(part)))
    size = F.size(items)
    errors = (size >= 2) & (of("::LOG_ERROR(") == size)
    return F.when(errors & (F.size(services_of(items)) > 1), "ERROR_PROPAGATION").when(errors, "CASCADE_FAILURE").when((size >= 2) & (of("::KAFKA_") >= 1), "ASYNC_FANOUT").when(longest_run(items) >= 3, "RETRY_PATTERN").otherwise("NORMAL_FLOW")


def enriched(patterns: DataFrame) -> DataFrame:
    """+ pattern_type, services, flags and the arrow description."""
    p = F.col("pattern")
    return patterns.select(
        "*", pattern_class(p).alias("pattern_type"), services_of(p).alias("services"), F.exists(p, lambda i: i.contains("::LOG_ERROR(")).alias("has_errors"), F.exists(p, lambda i: i.contains("::KAFKA_")).alias("has_kafka"),
        (F.size(services_of(p)) > 1).alias("cross_service"), F.array_join(p, " → ").alias("description"),
    )


def pair_supports(sequences: DataFrame) -> DataFrame:
    """Supports of items and ordered pairs of items, by aggregates: (pattern, count)."""
    at = sequences.withColumn("__s", F.monotonically_increasing_id()).select("__s", F.posexplode("items").alias("p", "i"))
    first = at.groupBy("__s", "i").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    one = first.groupBy("i").agg(F.count("*").alias("count")).select(F.col("i").alias("pattern"), "count")
    a, b = first.select("__s", F.col("i").alias("a"), "first"), first.select("__s", F.col("i").alias("b"), "last")
    two = a.join(b, "__s").where("first < last").groupBy("a", "b").agg(F.count("*").alias("count"))
    return one.union(two.select(F.concat("a", F.lit(" → "), "b"), "count"))
