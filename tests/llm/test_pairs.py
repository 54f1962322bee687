"""N-gram join and nearest neighbours against brute force; the pipeline end to end."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import hnsw, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, nid string, root int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, "clash", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, rows[5][1]) for i in range(6)] + [(900, None), (901, ""), (902, " "), (903, "Two Words"), (904, "two words"), (None, rows[9][1])]
    return rows


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = lambda i, j: (rows[i][1] or "") == (rows[j][1] or "") or bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    n, parent = len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if near(i, j):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    return links, [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [512, 3])
def test_join_equals_all_pairs(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = {str(r["doc_id"]): r for r in ngram_join.ngram_join(docs(spark, corpus)).collect()}
    links, group = brute(corpus)
    assert len(got) == len(corpus)
    assert [got[str(i)]["n_links"] for i, _ in corpus] == links
    first = {}
    for (i, _), g in zip(corpus, group, strict=True):
        assert first.setdefault(g, got[str(i)]["class_id"]) == got[str(i)]["class_id"]
    assert len(set(first.values())) == len(first)


@pytest.mark.parametrize("block", [512, 4])
def test_join_of_templates_and_chains(spark, block, monkeypatch):
    """Texts of one template (alike to some 0.6 to 0.9) and a chain: more than a block of them is tied."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(21)
    words = [f"v{i}" for i in range(5000)]
    template, rows = [rng.choice(words) for _ in range(80)], []
    for i in range(70):
        w = list(template)
        for at in rng.sample(range(16), rng.randint(0, 4)):
            w[at * 5] = rng.choice(words)
        rows.append((i, " ".join(w)))
    chain = [rng.choice(words) for _ in range(1200)]
    rows += [(100 + i, " ".join(chain[i * 15 : i * 15 + 60])) for i in range(70)]
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(docs(spark, rows)).collect()}
    links, group = brute(rows)
    assert [got[i]["n_links"] for i, _ in rows] == links
    assert len({r["class_id"] for r in got.values()}) == len(set(group)) == len({(g, got[i]["class_id"]) for (i, _), g in zip(rows, group, strict=True)})


def test_groups_of_repeated_and_null_ids_do_not_clash(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (None, "some thing else entirely here now"), (None, "and one more text of its own")]
    got = ngram_join.ngram_join(docs(spark, rows)).collect()
    name = lambda i: {r["class_id"] for r in got if r["doc_id"] == i}
    assert name(6) != name(7) and name(5) == name(6) | name(7) and len(name(None)) == 2
    assert [r["group_first"] for r in got if r["doc_id"] in (6, 7)] == [5, 5]
    out = ngram_join.deduplicated(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted((str(i), t) for i, t in rows if i in (5, None))


def test_one_row_stays_whatever_the_partitioning(spark):
    rows = [(1, "same text of it", "en", s, 3, "clash", k) for k, s in enumerate(["z", "b", None, "a"])]
    for parts in (1, 3):
        (kept,) = ngram_join.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
        assert kept["source"] is None


def test_join_equals_sql(spark, corpus):
    import duckdb

    d = docs(spark, [*corpus, corpus[3]])
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    want = con.sql(ngram_join.SQL)
    got = [tuple(r[c] for c in want.columns) for r in ngram_join.ngram_join(d).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))


def test_one_of_each_group_stays(spark, corpus):
    d = docs(spark, [*corpus, corpus[0]])
    out = ngram_join.deduplicated(d)
    assert out.columns == d.columns
    assert out.count() == len(set(brute(corpus)[1]))


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.HASHES


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[103] == got[101] == 100 and 200 not in got


def test_one_document_and_none(spark):
    assert ngram_join.ngram_join(docs(spark, [(1, "a b c")])).collect()[0]["n_links"] == 0
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0
    assert ngram_join.deduplicated(docs(spark, [])).count() == 0


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([centres[rng.integers(0, 20, 900)] + 0.1 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16)), np.ones((400, 16))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5050, [], 1), (5100, [0.0] * 16, 1), (5150, [float("nan")] * 16, 1), (5200, [1.0] * 3, 1), (5201, [1.0, None] * 8, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = hnsw.nearest(hnsw.build_index(d, shard=400), d.where("vec_id % 50 = 0"), 5).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for q in range(0, 1600, 50):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        s = unit @ unit[q]
        assert all(abs(s[v] - sc) < 1e-12 for _, v, sc in mine) and q not in [m[1] for m in mine]
        s[q] = -9
        hits += sum(s[v] >= np.sort(s)[-5] - 1e-12 for _, v, _ in mine)
        total += 5
        if q >= 1200:
            assert [m[1] for m in mine] == [i for i in range(1200, 1207) if i != q][:5]
    assert hits / total >= 0.95
    assert not any(r["query_id"] >= 5000 for r in got)


def test_neighbours_of_few_and_none(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in hnsw.nearest(hnsw.build_index(d), d.where("vec_id = 0"), 5).collect()] == [(1, 0.0)]
    none = d.where("false")
    assert hnsw.nearest(hnsw.build_index(none), none, 5).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(60))
    base = text()
    rows = [(i, text()) for i in range(60)] + [(100, base), (101, base), (102, base + " more"), (103, "short"), (104, None), (105, text() + " password=abcdefgh12345678")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d2 = stage(spark, d, str(tmp_path))
        assert d2.columns == d.columns
        path = str(tmp_path / name)
        d2.write.parquet(path)
        d = spark.read.parquet(path)
        seen.append({r["doc_id"] for r in d.select("doc_id").collect()})
    assert seen[0] == {i for i, _ in rows} - {103, 104}
    assert seen[1] == seen[0] - {101, 102} == seen[2]
    assert d.where(F.col("text").contains("password=")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == d.count()
