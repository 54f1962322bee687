"""Divergence of sources and compression of vectors against brute force and their SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import divergence, heap_lloyd


def terms(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small)


def brute(rows, least):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(terms(t), s) for t, x, s in rows if x == lang]
        kept = sorted(t for t, n in Counter(t for ts, _ in mine for t in set(ts)).items() if n >= least)
        v, count = len(kept), {s: Counter() for _, s in mine}
        for ts, s in mine:
            count[s].update(t for t in ts if t in set(kept))
        price = lambda c, n, v=v: 1 + 10**9 * (c + 5) // (n + 5 * v) if v else 1
        p = {s: {t: price(c[t], sum(c.values())) for t in kept} for s, c in count.items()}
        total = sum(count.values(), Counter())
        for s in count:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            own = [(price(total[t], sum(total.values())) - p[s][t], t.encode(), t) for t in kept if count[s][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(x for x in own if x[0] < 0)[:50])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["é", "ÉA", "ſ", "日本", "a’b"]
    rows = []
    for _ in range(900):
        source = rng.choice(["a", "b", "c", "é", "zz", None])
        some = words[hash_of(source) % 60 :][: rng.randint(3, 90)]
        rows.append((rng.choice([" ", "1", "\n", "-"]).join(rng.choice(some) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), source))
    return rows + [(None, "en", "empty"), ("", "xx", "only"), ("12 34", "yy", "p"), ("?", "yy", "q"), ("Big " * 3000, "en", "a"), ("same text", "en", "b"), ("same text", "en", "b")]


def hash_of(s):
    return sum((s or "n").encode())


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x") for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, value int, term string")


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, texts, monkeypatch, small):
    if small:  # blocks of a few terms and sources
        for name, value in (("SOURCES", 2), ("TERMS", 7)):
            monkeypatch.setattr(divergence, name, value)
    d = docs(spark, texts)
    want = brute(texts, divergence.LEAST)
    assert result(divergence.divergence(d)) == want
    assert {x[2] for x in want} == {"pair", "term"}
    assert divergence.divergence(d.limit(0)).count() == 0


def test_divergence_sql(texts):
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [list(x) for x in texts])
    assert sorted(con.sql("select lang, source, part, item, value, rank from (" + divergence.SQL + ")").fetchall()) == brute(texts, divergence.LEAST)


def test_partial_counts_add_up(texts, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 40)
    monkeypatch.setattr(divergence, "PIECE", 5)
    rows = [[(x or "").encode() for x in r] for r in texts]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows[k : k + 50], strict=True)], ["text", "lang", "source"]) for k in range(0, len(rows), 50)]
    got, want, handed = {}, {}, list(divergence.counted_terms(batches))
    for r in (r for b in handed for r in b.to_pylist()):
        x = got.setdefault((r["lang"], r["source"], r["term"]), [0, 0])
        x[0], x[1] = x[0] + r["occurrences"], x[1] + r["documents"]
    for t, lang, s in texts:
        for term, n in (Counter(terms(t)) + Counter()).items():
            x = want.setdefault((lang or "", s or "", term), [0, 0])
            x[0], x[1] = x[0] + n, x[1] + 1
        want.setdefault((lang or "", s or "", ""), [0, 0])[1] += 1
    assert got == want and len(handed) > 5


def test_terms_are_cut_between(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 2)
    text = "ab cdé  ÉA1日本語 x".encode()
    assert [t for part in divergence.pieces(text) for t in divergence.TERM.findall(part.lower())] == [t.encode() for t in terms(text.decode())]


def lloyd(vectors, rounds=heap_lloyd.ROUNDS):
    """(id, label, code, error) by measuring every part against every entry in every round."""
    vectors = sorted(vectors, key=lambda v: (v[0] is None, v[0] or 0, v[2]))
    x = [[math.floor(int(c) * 1024 if abs(c) > 2**60 else c * 1024) for c in v[2]] for v in vectors]
    size = len(x[0])
    at = [i * size // 4 for i in range(5)]
    books = [[v[at[p] : at[p + 1]] for v in x[:256]] for p in range(4)]
    apart = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    for step in range(rounds + 1):
        near = [[min((apart(v[at[p] : at[p + 1]], e), k) for k, e in enumerate(books[p])) for v in x] for p in range(4)]
        if step == rounds:
            break
        for p in range(4):
            for k in range(len(books[p])):
                mine = [v[at[p] : at[p + 1]] for v, (_, e) in zip(x, near[p], strict=True) if e == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(v[0]), str(v[1]), "".join(f"{near[p][i][1]:02x}" for p in range(4)), sum(near[p][i][0] for p in range(4))) for i, v in enumerate(vectors)), digest


VECTORS = "vec_id long, label int, embedding array<double>, code string, error int"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS)


def vectors(n, size, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, size))
    rows = [(int(i) * 3, int(rng.integers(0, 4)), (centres[rng.integers(0, 7)] + spread * rng.normal(size=size)).tolist()) for i in range(n)]
    return rows + [(5, None, rows[3][2]), (5, 1, rows[4][2]), (None, 2, rows[0][2]), (2, 2, rows[9][2]), (1, 2, rows[9][2])]


@pytest.mark.parametrize(("rows", "size"), [(vectors(700, 16, 1), 16), (vectors(40, 10, 2), 10), (vectors(330, 8, 3, 0.0), 8), ([(1, 1, [0.5] * 4), (1, 1, [0.5] * 4)], 4)])
def test_heap_lloyd_is_lloyd(spark, rows, size):
    odd = [(900, 1, None), (901, 1, []), (902, 1, [float("nan")] * size), (903, 1, [None] * size), (904, 1, [1.0] * (size + 1)), (905, 2, [float("inf")] * size)]
    d = vector_table(spark, rows + odd).repartition(3)
    out, books = heap_lloyd.compressed(d)
    want, digest = lloyd(rows)
    assert sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in out.collect()) == want
    assert books.digest() == digest


def test_heap_lloyd_of_numbers_of_any_size(spark):
    rows = vectors(60, 8, 4)
    rows = [(i, k, [c * s for c in v]) for (i, k, v), s in zip(rows, [1.0, 1e3, 1e9, 1e14] * 20, strict=False)]
    rows += [(7, 1, [1e300] * 8), (8, 1, [-1.7e308] + [0.0] * 7), (9, 1, [-1e-9] * 8)]
    out, books = heap_lloyd.compressed(vector_table(spark, rows))
    want, digest = lloyd(rows)
    assert sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in out.collect()) == [(*w[:3], w[3] if w[3] < 2**63 else None) for w in want]
    assert books.digest() == digest


def test_heaps_rescan_few():
    rows = np.array([v[2] for v in vectors(3000, 16, 5, 0.05)], np.float64)
    x = heap_lloyd.whole_numbers(rows)
    books = heap_lloyd.Books(x[:64])
    block = heap_lloyd.Block(x, books.arrays())
    changes, scanned = block.settle(books.arrays(), books.drift, fresh=True), []
    for _ in range(12):
        books.move({(int(at), i): v for at, numbers in changes.items() for i, v in enumerate(numbers)})
        before, flat = block.rescanned, block.flat()
        assert sum(np.frombuffer(flat["sizes"], np.int16)) == 4 * len(x)
        again = heap_lloyd.Block(x, books.arrays()).load(flat["keys"], flat["members"], flat["sizes"])
        changes = block.settle(books.arrays(), books.drift)
        assert again.settle(books.arrays(), books.drift) == changes
        scanned.append(block.rescanned - before)
        for p, book in enumerate(books.arrays()):
            assert np.array_equal(block.assigned(p), heap_lloyd.scan(block.part(p), book)[0])
    assert scanned[-1] < 0.5 * 4 * len(x)


def test_heap_lloyd_query_and_sql(spark, tmp_path):
    rows = vectors(300, 8, 6)
    vector_table(spark, rows + [(3, 1, None)]).drop("code", "error").write.parquet(str(tmp_path / "embeddings.parquet"))
    columns = "vec_id, code, error, label_error, codebooks_sha256"
    got = [tuple(r) for r in heap_lloyd.query(spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.sql(f"select {columns} from ({heap_lloyd.SQL})").fetchall(), key=str)
    spark.createDataFrame([], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "none/embeddings.parquet"))
    assert heap_lloyd.query(spark, str(tmp_path / "none")).count() == 0
