"""Scores of generated narratives and of whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text

#: Weights of judge, completeness, coherence and accuracy (fixed values).
WEIGHTS = (0.3, 0.25, 0.2, 0.25)


def completeness(narrative: Column, services: Column) -> Column:
    """Share of a flow's steps whose service the narrative names; 1 without steps."""
    found = F.size(F.filter(services, lambda s: F.contains(narrative, s)))
    return F.when(F.size(services) == 0, 1.0).otherwise(found / F.size(services))


def accuracy(narrative: Column, terms: Column) -> Column:
    """Share of the distinct expected terms that occur."""
    return completeness(narrative, F.array_distinct(terms))


def synthesis_score(narrative: Column, services: Column, terms: Column, judge: Column) -> Column:
    parts = (text.judge_score(judge), completeness(narrative, services), text.coherence(narrative), accuracy(narrative, terms))
    return sum((p * w for p, w in zip(parts, WEIGHTS, strict=True)), F.lit(0.0))


def overall(results: DataFrame) -> DataFrame:
    """Means of each measure (variant, measure, value), 0 where there is none."""
    return results.groupBy("variant", "measure").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.count("value").alias("n"))
