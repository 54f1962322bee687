"""Report tables, prompts, staged synthesis with a pluggable model, and Markdown."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from string import Template

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import ship

#: Stages of a synthesis in order, with what each is asked (fixed order; wording is ours).
STAGES = {
    "flow_analysis": "Analyse the flow $flow of $services.",
    "code_explanation": "Explain the code behind $flow: $previous",
    "risk_assessment": "Name the risks of $flow: $previous",
    "dependency_mapping": "Map what $flow depends on: $previous",
    "migration_plan": "Plan the migration of $flow: $previous",
    "final_narrative": "Tell the story of $flow: $previous",
}


def risk_matrix(risks: DataFrame) -> DataFrame:
    """Counts by severity and by category: (dimension, value, n), in one pass with grouping sets."""
    sets = risks.select(F.explode(F.create_map(F.lit("severity"), "severity", F.lit("category"), "category")).alias("dimension", "value"))
    return sets.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def summary(risks: DataFrame) -> DataFrame:
    when = lambda s: F.sum((F.col("severity") == s).cast("long"))
    return risks.agg(F.count("*").alias("risks"), F.countDistinct("service").alias("services"), when("CRITICAL").alias("critical"), when("HIGH").alias("high"))


def roadmap(phases: DataFrame) -> DataFrame:
    """phases(flow_id, order, ...) numbered over all flows by flow, then order: numbers within each flow
    plus the phases of the flows before it, so that only the flows' counts meet in one place."""
    counts = phases.groupBy("flow_id").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("flow_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("flow_id", before.alias("__before"))
    inner = F.row_number().over(Window.partitionBy("flow_id").orderBy("order"))
    return phases.withColumn("__n", inner).join(offsets, "flow_id").withColumn("phase", (F.col("__before") + F.col("__n")).cast("int")).drop("__n", "__before")


def findings(risks: DataFrame, most: int = 5) -> DataFrame:
    """The first few findings, gravest first."""
    rank = F.array_position(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))), F.col("severity"))
    return risks.orderBy(rank, "risk_id").limit(most)


def echo(prompt: str) -> str:
    """Default model: answers with the prompt's words, as JSON."""
    return json.dumps({"summary": prompt[:400], "score": 0.5})


def synthesized(flows: DataFrame, model: Callable[[str], str] = echo, retries: int = 2) -> DataFrame:
    """flows(flow_id, services) -> flow_id, stage, n, answer, error. Each flow runs its stages in order;
    a stage that fails after the retries ends its flow and leaves the others alone."""
    ship(flows.sparkSession)

    def ask(prompt: str) -> str:
        for left in range(retries, -1, -1):
            try:
                return model(prompt)
            except Exception:
                if not left:
                    raise
        raise AssertionError

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for flow, services in zip(batch["flow_id"], batch["services"], strict=True):
                previous = ""
                for n, (stage, prompt) in enumerate(STAGES.items(), 1):
                    try:
                        previous = ask(Template(prompt).safe_substitute(flow=flow, services=", ".join(services), previous=previous))
                        out.append((flow, stage, n, previous, None))
                    except Exception as e:
                        out.append((flow, stage, n, None, str(e)))
                        break
            yield pd.DataFrame(out, columns=["flow_id", "stage", "n", "answer", "error"])

    return flows.select("flow_id", "services").mapInPandas(work, "flow_id string, stage string, n int, answer string, error string")


REPORT = Template("# Research report\n\n$summary\n\n## Risks\n\n$risks\n\n## Flows\n\n$flows\n")


def markdown(totals: DataFrame, matrix: DataFrame, stages: DataFrame) -> str:
    """The report's text: a page of counts and one line for each flow, rendered on the driver."""
    t = totals.first()
    risks = "\n".join(f"- {r['dimension']} {r['value']}: {r['n']}" for r in matrix.orderBy("dimension", "value").collect())
    last = stages.where(F.col("stage") == "final_narrative").orderBy("flow_id").select("flow_id", "answer")
    flows = "\n".join(f"- {r['flow_id']}: {r['answer']}" for r in last.toLocalIterator())
    return REPORT.substitute(summary=", ".join(f"{k}: {v}" for k, v in t.asDict().items()), risks=risks, flows=flows)
