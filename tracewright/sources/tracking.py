"""Experiment runs, jobs and pipelines as append-only tables."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import TopologicalSorter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.relational import latest_by_key
from tracewright.sources.files import append

METRICS = "experiment string, run string, kind string, name string, value string, seq long"


class Tracker:
    """Parameters, metrics and artifacts of runs; a run's id is a hash of its experiment and number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, experiment: str, run: str, kind: str, values: dict, seq: int = 0) -> None:
        rows = [(experiment, run, kind, k, str(v), seq) for k, v in values.items()]
        append(self.spark.createDataFrame(rows, METRICS), self.path, ["experiment"])

    def runs(self, experiment: str) -> DataFrame:
        rows = self.spark.read.schema(METRICS).parquet(self.path).where(F.col("experiment") == experiment)
        return latest_by_key(rows, ["experiment", "run", "kind", "name"], F.col("seq"))

    def tracked(self, experiment: str, run: str, parameters: dict, train: Callable[[], dict]) -> dict:
        """Runs train(), whose result is its metrics, between its start and end."""
        self.log(experiment, run, "param", parameters)
        self.log(experiment, run, "status", {"status": "RUNNING"})
        try:
            metrics = train()
        except Exception as e:
            self.log(experiment, run, "status", {"status": "FAILED", "error": e}, 1)
            raise
        self.log(experiment, run, "metric", metrics)
        self.log(experiment, run, "status", {"status": "FINISHED"}, 1)
        return metrics


def save_arrays(path: str, **arrays: np.ndarray) -> None:
    with open(path, "wb") as f:
        np.savez(f, **arrays)


def load_arrays(path: str) -> dict[str, np.ndarray]:
    with np.load(path, allow_pickle=False) as z:
        return dict(z)


def run_stages(stages: dict[str, tuple[list[str], Callable[[], object]]], retries: int = 3) -> dict[str, str]:
    """Runs a DAG of stages (what each needs, what it does) in order; those after a failure are skipped."""
    state: dict[str, str] = {}
    for name in TopologicalSorter({k: set(v[0]) for k, v in stages.items()}).static_order():
        needs, work = stages[name]
        if any(state.get(n) != "SUCCEEDED" for n in needs):
            state[name] = "SKIPPED"
            continue
        for left in range(retries, -1, -1):
            try:
                work()
                state[name] = "SUCCEEDED"
                break
            except Exception:
                if not left:
                    state[name] = "FAILED"
    return state
