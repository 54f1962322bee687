"""Running sums, predecessors, quantiles, episodes and bursts of keys that lie over many range partitions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import ordered, windows

T0 = datetime(2024, 1, 1)


@pytest.fixture
def cut(spark):
    """Partitions stay as they are cut: a hot key lies over several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_order_over_partitions(spark, cut):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.randrange(5), "clash") for i in range(900)] + [("one", 5, 3, "x")]
    df = spark.createDataFrame(rows, "key string, at int, v int, __sum string")
    parts = ordered.parted(df, ["key"], ["at"])
    assert parts.where("key = 'hot'").select("__part").distinct().count() > 3
    got = ordered.running(ordered.previous(parts, ["key"], ["at"], "v", "before"), ["key"], ["at"], F.col("v"), "upto")
    w = Window.partitionBy("key").orderBy("at")
    want = df.withColumns({"before": F.lag("v").over(w), "upto": F.sum("v").over(w)})
    columns = ["key", "at", "v", "before", "upto"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_quantiles(spark, cut):
    rng = random.Random(2)
    rows = [("hot", rng.choice([1.5, 2.0, rng.random() * 100])) for _ in range(800)] + [("few", 3.0), ("few", None), ("none", None), (None, 1.0), (None, 2.0)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["key"]: r for r in ordered.quantiles(spark.createDataFrame(rows, "key string, x double"), ["key"], "x", shares).collect()}
    assert set(got) == {"hot", "few", None}
    for key, r in got.items():
        mine = [x for k, x in rows if k == key and x is not None]
        assert [r[name] for name in shares] == pytest.approx([np.quantile(mine, q) for q in shares.values()])


def test_one_service_of_all_windows(spark, cut):
    rng, rows, at = random.Random(3), [], 0
    for _ in range(400):
        at += rng.choice([5, 5, 5, 10, 15, 20, 60])
        rows.append(("hot", T0 + timedelta(minutes=at), T0 + timedelta(minutes=at + 5), rng.choice([0.5, 0.7, 0.85, 0.95])))
    rows += [("rare", T0, T0 + timedelta(minutes=5), 0.9), ("calm", T0, T0 + timedelta(minutes=5), 0.1)]
    found = sorted((r["service"], r["episode"], r["start_time"], r["end_time"], r["peak_score"], r["windows"]) for r in windows.episodes(spark.createDataFrame(rows, "service string, window_start timestamp, window_end timestamp, score double")).collect())
    want = []
    for service in ("hot", "rare"):
        held, number = [], 0
        for row in sorted(r for r in rows if r[0] == service and r[3] >= 0.65):
            if held and row[1] - held[-1][2] > timedelta(minutes=10):
                number += 1
                want.append((service, number, held[0][1], held[-1][2], max(h[3] for h in held), len(held)))
                held = []
            held.append(row)
        want.append((service, number + 1, held[0][1], held[-1][2], max(h[3] for h in held), len(held)))
    assert found == sorted(want) and len(found) > 20


def test_one_window_of_all_events(spark, cut):
    rng = random.Random(4)
    marks = [rng.choice(["ERROR"] * 5 + ["INFO", None]) for _ in range(700)]
    marks[200:260] = ["FATAL"] * 60  # a run over partitions
    rows = [("s", T0 + timedelta(seconds=i // 3), i, m) for i, m in enumerate(marks)] + [("t", T0, 1, "INFO")]
    got = {r["service"]: r["burst_score"] for r in windows.bursts(spark.createDataFrame(rows, "service string, ts timestamp, event_id long, severity string"), ["service"]).collect()}
    longest = run = 0
    for m in marks:
        run = run + 1 if m in ("ERROR", "FATAL") else 0
        longest = max(longest, run)
    assert longest >= 60 and got == {"s": longest / 700, "t": 0.0}
