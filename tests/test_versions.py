"""Versions of tables: no writer loses, no stop loses."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tracewright.sources import versions


def counts(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, n long")


def test_absent_append_and_time_travel(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path) == (0, None)
    assert versions.append(counts(spark, ("a", 1), ("a", 1)), path) == 1
    assert versions.append(spark.createDataFrame([(2, None, "x")], "n int, k string, other string"), path) == 2
    rows = lambda v=None: sorted(map(str, versions.read(spark, path, v)[1].collect()))
    assert rows() == ["Row(k='a', n=1)", "Row(k='a', n=1)", "Row(k=None, n=2)"]
    assert rows(1) == ["Row(k='a', n=1)"] * 2


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: versions.bump(counts(spark, ("a", 1), (None, i), ("b", None)), path, ["k"], "n"), range(6)))
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert {r["k"]: r["n"] for r in versions.read(spark, path)[1].collect()} == {"a": 6, None: 15, "b": 0}


def test_entry_is_created_once(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.append(counts(spark, ("a", 1)), path)
    first = versions.entry(spark, path, 1)
    assert not versions.created(spark, path, 1, {"folders": []})
    assert versions.entry(spark, path, 1) == first


def test_stop_before_the_entry_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.append(counts(spark, ("a", 1)), path)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "created", stop)
        with pytest.raises(KeyboardInterrupt):
            versions.upsert(counts(spark, ("a", 2)), path, ["k"], "n")
    assert [tuple(r) for r in versions.read(spark, path)[1].collect()] == [("a", 1)]
    assert len(versions.vacuum(spark, path)) == 1
    assert [tuple(r) for r in versions.read(spark, path)[1].collect()] == [("a", 1)]


def test_upsert_and_expected_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.upsert(counts(spark, ("a", 1), ("a", 3), (None, 1)), path, ["k"], "n") == 1
    assert versions.upsert(counts(spark, ("a", 2), ("b", 1)), path, ["k"], "n", expected=1) == 2
    with pytest.raises(versions.Conflict):
        versions.upsert(counts(spark, ("a", 9)), path, ["k"], "n", expected=1)
    assert sorted(map(str, versions.read(spark, path)[1].collect())) == ["Row(k='a', n=3)", "Row(k='b', n=1)", "Row(k=None, n=1)"]
    assert len(versions.vacuum(spark, path)) == 1 and versions.versions(spark, path) == [2]
