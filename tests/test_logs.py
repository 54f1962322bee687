"""Lines, traces, templates, windows, episodes, sequences: small cases with known results."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import logs, text
from tracewright.operators import anomaly, drain, sequences, windows

T0 = datetime(2024, 1, 1, 10, 0, 30)
EV = "event_id long, ts timestamp, service string, severity string, template_id string, message string, trace_id string, exception_class string, log_type string"


def events(spark, rows):
    """rows: dicts over defaults, one second apart."""
    base = {"service": "svc", "severity": "INFO", "template_id": "t1", "message": "m", "trace_id": None, "exception_class": None, "log_type": "APP"}
    out = []
    for i, r in enumerate(rows):
        r = base | {"event_id": i, "ts": T0 + timedelta(seconds=i)} | r
        out.append(tuple(r[c.split()[0]] for c in EV.split(", ")))
    return spark.createDataFrame(out, EV)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "line, source, severity, message",
    [
        ("2024-01-15T10:30:45.123 INFO [main] com.acme.App - Started", "APP", "INFO", "Started"),
        ("2024-01-15 10:30:45.123 ERROR [pool-1] com.acme.Db - Connection lost", "APP", "ERROR", "Connection lost"),
        ('[2024-01-15T10:30:45.123Z] "GET /api/users HTTP/1.1" 200 - 12', "ISTIO_ACCESS", "INFO", "GET /api/users -> 200"),
        ("[2024-01-15T10:30:45.123Z][warning][upstream] no healthy host", "ISTIO_ENVOY", "WARN", "[upstream] no healthy host"),
    ],
)
def test_line_shapes(spark, line, source, severity, message):
    got = one(spark, logs.parsed_line, line)
    assert (got["source"], got["severity"], got["message"]) == (source, severity, message)


@pytest.mark.parametrize("line", ["", "junk", "  at com.acme.Main.run(Main.java:3)", "2024-01-15 10:30:45 LOUD [a] b - c"])
def test_lines_of_no_shape(spark, line):
    assert one(spark, logs.parsed_line, line) is None


def test_instants(spark):
    assert one(spark, logs.instant, "2024-01-15 10:30:45") == datetime(2024, 1, 15, 10, 30, 45)
    assert one(spark, logs.instant, "yesterday") is None


def test_trace_context(spark):
    w3c = f"x TraceParent: 00-{'a' * 32}-{'b' * 16}-01 y"
    assert tuple(one(spark, logs.trace_context, w3c)) == ("a" * 32, "b" * 16)
    assert tuple(one(spark, logs.trace_context, f"x-b3={'c' * 16}-{'d' * 16}")) == ("c" * 16, "d" * 16)
    assert one(spark, logs.trace_context, "none") is None


def test_last_exception(spark):
    stack = "java.lang.RuntimeException: boom\n  at x\nCaused by: java.sql.SQLException: Connection refused"
    assert tuple(one(spark, logs.last_exception, stack)) == ("java.sql.SQLException", "Connection refused")
    assert one(spark, logs.last_exception, "no colon here") is None
    trace = "java.lang.RuntimeException: boom\n\tat com.acme.Main.run(Main.java:3)\n  Caused by: java.io.IOException:  gone \r\n\tat com.acme.Io.read(Io.java:77)\n\t... 2 more"
    assert tuple(one(spark, logs.last_exception, trace)) == ("java.io.IOException", "gone")
    assert one(spark, logs.last_exception, "\tat com.acme.Main.run(Main.java:3)") is None


@pytest.mark.parametrize(
    "path, kind",
    [
        ("services/a/Dockerfile", "DOCKERFILE"), ("deploy/helm/x/templates/a.yaml", "HELM_CHART"), ("k8s/istio/x.yaml", "K8S_MANIFEST"), ("infra/istio/gw.yaml", "ISTIO_MANIFEST"), ("charts/a/Chart.yaml", "HELM_CHART"),
        ("pom.xml", "BUILD_FILE"), ("a/B.java", "JAVA_SOURCE"), ("s/src/main/resources/application.yml", "YAML_CONFIG"), ("a/b.properties", "PROPERTIES_CONFIG"), ("README.md", "OTHER"), ("my-deployment.yaml", "K8S_MANIFEST"), (".java", "OTHER"),
    ],
)
def test_file_types(spark, path, kind):
    assert one(spark, logs.file_type, path) == kind


def test_services_of_paths(spark):
    assert one(spark, logs.service_of_log_path, "logs/order-service/pod/app.log") == "order-service"
    assert one(spark, logs.service_of_log_path, "logs/edge/app.log") == "edge"
    assert one(spark, logs.service_of_source_path, "x/services/pay/src/A.java") == "pay"
    assert one(spark, logs.module_service, "libs/core/src/main/A.java") == "core"
    assert one(spark, logs.log_type, "istio-proxy.log") == "ISTIO" and one(spark, logs.log_type, "x.bin") == "UNKNOWN"


def test_masks(spark):
    got = one(spark, text.masked_tokens, "from 10.0.0.1 id 123e4567-e89b-12d3-a456-426614174000 n 42 at /var/log/x.log")
    assert got == ["from", "<IP>", "id", "<UUID>", "n", "<NUM>", "at", "<PATH>"]
    assert one(spark, text.masked_tokens, "  ") is None


def drained(spark, messages, **options):
    rows = spark.createDataFrame(list(enumerate(messages)), "seq long, message string")
    return sorted((r["template"], r["match_count"]) for r in drain.clusters(rows, **options).collect())


def test_drain_groups_similar_messages(spark):
    same = [f"Connected to 10.0.0.{i} on port {8000 + i}" for i in range(3)]
    assert drained(spark, same) == [("Connected to <IP> on port <NUM>", 3)]
    assert len(drained(spark, ["user logged in", "cache was cleared now", "disk is full"])) == 3
    assert drained(spark, ["", None]) == []


def test_drain_generalizes_on_request(spark):
    rows = ["a b c d e red", "a b c d e blue"]
    assert drained(spark, rows) == [("a b c d e red", 2)]
    assert drained(spark, rows, generalize=True) == [("a b c d e <*>", 2)]


def test_drain_similarity():
    assert drain.similarity(["a", "b"], ["a", "x"]) == 0.5
    assert drain.similarity(["a"], ["a", "x"]) == 1.0 and drain.similarity([], []) == 1.0 and drain.similarity(["a"], []) == 0.0


def feature(spark, rows):
    return windows.features(events(spark, rows)).orderBy("window_start").first()


def test_error_rate_and_burst(spark):
    got = feature(spark, [{"severity": s} for s in ("INFO", "ERROR", "ERROR", "FATAL")] + [{"ts": T0 + timedelta(minutes=20)}])
    assert got["error_rate"] == 0.75 and got["burst_score"] == 0.75 and got["total_events"] == 4


def test_template_trace_and_exception_ratios(spark):
    late = [{"ts": T0 + timedelta(minutes=20)}]
    assert feature(spark, [{}] * 20 + late)["unique_template_ratio"] == 0.05
    assert feature(spark, [{"trace_id": "x"}, {"trace_id": "x"}, {"trace_id": " "}, {}] + late)["trace_span_ratio"] == 0.5
    assert feature(spark, [{"exception_class": "E"}, {}, {}] + late)["exception_rate"] == pytest.approx(1 / 3)
    got = feature(spark, [{"template_id": "a"}] * 3 + [{"template_id": "b"}] + late)
    assert got["new_template_rate"] == 0.25 and got["p99_latency"] == 0 and got["event_rate"] == pytest.approx(4 / 300)


def test_window_count(spark):
    rows = [{"ts": T0.replace(second=0) + timedelta(seconds=6 * i)} for i in range(300)]
    assert windows.features(events(spark, rows)).count() == 6


def test_window_at_the_last_event_is_left_out(spark):
    start = T0.replace(second=0)
    assert windows.features(events(spark, [{"ts": start}, {"ts": start + timedelta(minutes=5)}])).count() == 1


def test_burst_is_the_longest_run(spark):
    marks = "EEIEEEIE"
    rows = events(spark, [{"severity": "ERROR" if m == "E" else "INFO"} for m in marks]).withColumn("bin", F.lit(0))
    assert windows.bursts(rows, ["bin"]).first()["burst_score"] == 3 / 8


def windows_of(spark, starts, scores):
    rows = [("s", T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + 5), x) for m, x in zip(starts, scores, strict=True)]
    return spark.createDataFrame(rows, "service string, window_start timestamp, window_end timestamp, score double")


@pytest.mark.parametrize("starts, n", [([0, 5, 10], 1), ([0, 20], 2), ([0, 15], 1)])
def test_episode_gaps(spark, starts, n):
    assert windows.episodes(windows_of(spark, starts, [0.7] * len(starts))).count() == n


def test_episode_severity(spark):
    got = windows.episodes(windows_of(spark, [0, 5, 10], [0.7, 0.85, 0.64])).first()
    assert got["severity"] == "HIGH" and got["windows"] == 2 and got["peak_score"] == 0.85
    levels = [one(spark, lambda v: windows.severity_of(v.cast("double")), x) for x in ("0.59", "0.6", "0.8", "0.9")]
    assert levels == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_zero_fill(spark):
    rows = spark.createDataFrame([("HIGH",), ("HIGH",)], "severity string")
    assert {r["severity"]: r["n"] for r in windows.zero_filled(rows, "severity", windows.SEVERITIES).collect()} == {"LOW": 0, "MEDIUM": 0, "HIGH": 2, "CRITICAL": 0}


def test_forest_ranks_outliers_first(spark):
    rows = [("s", i, float(i % 5), float(i % 7)) for i in range(200)] + [("s", 999, 90.0, -80.0), ("t", 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "service string, w int, a double, b double")
    got = anomaly.scored(df, ["service"], ["a", "b"], ["w"], trees=50).collect()
    assert max(got, key=lambda r: r["score"])["w"] == 999 and all(0 < r["score"] < 1 for r in got) and len(got) == 201
    again = anomaly.scored(df, ["service"], ["a", "b"], ["w"], trees=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_event_types_and_details(spark):
    e = events(spark, [{"severity": "ERROR", "log_type": "ISTIO"}, {"log_type": "ISTIO"}, {"message": "Kafka produce x"}, {"message": "kafka consume y", "template_id": " "}, {}])
    assert [r["item"].split("::")[1] for r in sequences.items_of(e).orderBy("event_id").collect()] == ["LOG_ERROR(t1)", "ENDPOINT_CALL(t1)", "KAFKA_PRODUCE(t1)", "KAFKA_CONSUME(kafka consume y)", "LOG(t1)"]


def test_trace_sequences(spark):
    e = events(spark, [{"trace_id": "a"}, {"trace_id": "a"}, {"trace_id": "b"}, {}, {"trace_id": "c"}, {"trace_id": "c"}, {"trace_id": "c"}])
    assert {r["trace_id"]: r["n"] for r in sequences.trace_sequences(e).collect()} == {"a": 2, "c": 3}


def test_window_sequences_include_the_last_event(spark):
    e = events(spark, [{"ts": T0}, {"ts": T0 + timedelta(seconds=29)}, {"ts": T0 + timedelta(seconds=30)}, {"ts": T0 + timedelta(seconds=59)}, {"ts": T0 + timedelta(seconds=90)}])
    assert sorted((r["bin"], r["n"]) for r in sequences.window_sequences(e).collect()) == [(0, 2), (1, 2)]


def test_pattern_supports(spark):
    rows = spark.createDataFrame([(["A", "B", "C"],)] * 80 + [(["A", "C"],)] * 20, "items array<string>")
    got = {"".join(r["pattern"]): r["support"] for r in sequences.frequent_patterns(rows, 0.05).collect()}
    assert got == {"A": 1.0, "C": 1.0, "AC": 1.0, "B": 0.8, "AB": 0.8, "BC": 0.8, "ABC": 0.8}
    pairs = {r["pattern"]: r["count"] for r in sequences.pair_supports(rows).collect()}
    assert pairs["A → C"] == 100 and pairs["A → B"] == 80


@pytest.mark.parametrize(
    "pattern, kind",
    [
        (["a::LOG_ERROR(x)", "b::LOG_ERROR(y)"], "ERROR_PROPAGATION"), (["a::LOG_ERROR(x)", "a::LOG_ERROR(y)"], "CASCADE_FAILURE"), (["a::KAFKA_PRODUCE(x)", "b::KAFKA_CONSUME(x)"], "ASYNC_FANOUT"), (["a::KAFKA_PRODUCE(x)", "b::LOG(x)"], "ASYNC_FANOUT"), (["a::KAFKA_PRODUCE(x)"], "NORMAL_FLOW"),
        (["a::LOG(x)"] * 3, "RETRY_PATTERN"), (["a::LOG(x)", "b::LOG(x)", "a::LOG(x)"], "NORMAL_FLOW"), (["a::LOG_ERROR(x)"], "NORMAL_FLOW"),
    ],
)
def test_pattern_classes(spark, pattern, kind):
    row = sequences.enriched(spark.createDataFrame([(pattern,)], "pattern array<string>")).first()
    assert row["pattern_type"] == kind and row["description"] == " → ".join(pattern)
    assert row["has_errors"] == any("ERROR" in p for p in pattern) and row["has_kafka"] == any("KAFKA" in p for p in pattern)


def plain_depth(tree, x, at=0):
    if tree["feature"][at] < 0:
        return tree["value"][at]
    return plain_depth(tree, x, tree["low" if x[tree["feature"][at]] < tree["cut"][at] else "high"][at])


def path_of(tree, x):
    at = [0]
    while tree["feature"][at[-1]] >= 0:
        at.append(tree["low" if x[tree["feature"][at[-1]]] < tree["cut"][at[-1]] else "high"][at[-1]])
    return at


def test_forest_is_a_table(spark, tmp_path, monkeypatch):
    """One service of nearly all windows: bounded samples from all its rows, trees saved and loaded, chunks scored apart."""
    monkeypatch.setattr(anomaly, "CHUNK", 700)
    x = np.random.default_rng(3).normal(size=(6000, 2))
    x[7] = 40, -40
    rows = spark.createDataFrame([("hot", i, float(p), float(q)) for i, (p, q) in enumerate(x)] + [("few", i, float(i), None) for i in range(5)] + [("one", 1, 0.0, 0.0), (None, 1, 0.0, 1.0), (None, 2, 5.0, float("nan"))], "g string, t long, p double, q double")
    samples = anomaly.sampled(rows, ["g"], ["p", "q"], ["t"], 40, 64).groupBy("g", "tree").agg(F.count("*").alias("n"), F.collect_set("p").alias("p")).collect()
    hot = [r for r in samples if r["g"] == "hot"]
    assert len(hot) == 40 and all(40 <= r["n"] <= 64 for r in hot) and len({v for r in hot for v in r["p"]}) > 1200
    assert {(r["g"], r["n"]) for r in samples if r["g"] != "hot"} == {("few", 5), (None, 2)}
    anomaly.save(anomaly.train(rows, ["g"], ["p", "q"], ["t"], 40, 64), str(tmp_path / "forest"))
    forest = anomaly.load(spark, str(tmp_path / "forest"))
    got = {(r["g"], r["t"]): r["score"] for r in anomaly.score(forest, rows, ["g"], ["p", "q"], ["t"]).collect()}
    assert len(got) == 6007 and got["hot", 7] > 0.9 * max(got.values())
    trees = [r.asDict() for r in forest.where("g = 'hot'").orderBy("tree").collect()]
    for i in [*range(0, 6000, 500), 7]:
        mean = np.mean([plain_depth(t, x[i]) / anomaly.path_norm(t["size"]) for t in trees])
        assert got["hot", i] == pytest.approx(2.0**-mean)


def test_a_tree_splits_its_rows():
    x = np.random.default_rng(5).normal(size=(64, 3))
    tree = anomaly.grown(x, [1, 2])
    assert tree == anomaly.grown(x[::-1], [1, 2]) != anomaly.grown(x, [2, 2])
    assert np.allclose(anomaly.depths(tree, x), [plain_depth(tree, r) for r in x])
    leaves = [i for i, f in enumerate(tree["feature"]) if f < 0]
    assert sorted([*tree["low"], *tree["high"]])[2 * len(leaves) :] == list(range(1, len(tree["feature"])))
    for i, (f, cut) in enumerate(zip(tree["feature"], tree["cut"], strict=True)):
        if f >= 0:  # both children have rows, and the cut lies between them
            mine = [r for r in x if i in path_of(tree, r)]
            assert min(r[f] for r in mine) < cut <= max(r[f] for r in mine)
    assert max(tree["value"]) <= 6 + anomaly.path_norm(64) and anomaly.grown(np.zeros((9, 3)), [1])["value"] == [anomaly.path_norm(9)]


def one_by_one(messages):
    """Clusters of masked, distinct messages by first fit: tokens -> [template, count]."""
    buckets = {}
    for tokens in messages:
        found = buckets.setdefault(tuple(tokens[: drain.DEPTH]), [])
        hit = next((c for c in found if drain.similarity(c[0], tokens) >= drain.SIMILAR), None)
        if hit:
            hit[1] += 1
        else:
            found.append([tokens, 1])
    return sorted((" ".join(t), n) for found in buckets.values() for t, n in found)


@pytest.mark.parametrize(("head", "chunk"), [(2000, 20_000), (7, 25)])
def test_a_hot_bucket_is_settled_in_rounds(spark, monkeypatch, head, chunk):
    monkeypatch.setattr(drain, "HEAD", head)
    monkeypatch.setattr(drain, "CHUNK", chunk)
    rng = random.Random(head)
    words = ["red", "green", "blue", "black", "white", "<*>"]
    messages = [["all", "of", "one", "bucket", *rng.choices(words, k=rng.randint(12, 15))] for _ in range(400)] + [["few", *rng.choices(words, k=3)] for _ in range(20)]
    rng.shuffle(messages)
    df = spark.createDataFrame([(" ".join(m), i) for i, m in enumerate(messages)], "message string, seq long")
    got = sorted((r["template"], r["match_count"]) for r in drain.clusters(df).collect())
    assert got == one_by_one(messages) and len(got) > 20
    by_place = df.select("message", F.struct(F.floor(F.col("seq") / 9).alias("file"), F.col("seq").alias("line")).alias("seq"))
    assert sorted((r["template"], r["match_count"]) for r in drain.clusters(by_place).collect()) == got


def test_leaders_are_asked_as_one_by_one():
    rng = random.Random(1)
    some = lambda n: [rng.choices(["a", "b", "c", "<*>"], k=rng.randint(0, 6)) for _ in range(n)]
    led, asked = some(12), some(200)
    want = [next((k for k, t in enumerate(led) if drain.similarity(t, m) >= 0.5), -1) for m in asked]
    assert drain.Leaders(led).first(asked, 0.5).tolist() == want
