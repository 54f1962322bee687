"""Quality rules, mixing and sharding against plain Python."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tracewright.llm import mixing, quality_rules, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else 0, 7, "clash") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None])) for i in range(120)]
    repeat = " ".join(f"x{i}" for i in range(10))
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, " \n\t ", "en", "b"), (203, f"{repeat} {repeat} tail", "en", "a"), (203, f"{repeat} {repeat} tail", "en", "a"), (204, "a b\na b\n\na b\nc", "de", "b"), (None, "no id here", "en", "a"), (205, "#*$ |x| y " * 30, "en", "a"), (206, "long " * 30000, "en", "b"), (207, "z " * 9, "en", "a")]
    return rows


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_statistics(spark, odd_rows):
    got = quality_rules.quality_rules(docs(spark, odd_rows)).collect()
    mine = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert mine == sorted((str(i), *base(t)) for i, t, _, _ in odd_rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60))
    rows = [(i, text(), "en", "a") for i in range(200)] + [(900, " ".join(f"{w}$$$$$" for w in text().split()), "en", "a"), (901, text() + "$$", "xx", "rare")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert kept.pop(900) is False
    assert all(kept.values())


def test_quality_filter_keeps_columns_and_whole_groups(spark, odd_rows):
    d = docs(spark, odd_rows)
    out = quality_rules.filtered(d)
    assert out.columns == d.columns
    stay = [str(i) for i, t, _, _ in odd_rows if not base(t)[5]]
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(stay)


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        now = {s: left * w[s] / weight for s in free}
        over = [s for s in free if now[s] > 3 * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing_hits_budgets_exactly(spark, odd_rows):
    rows = odd_rows + [(500 + i, "tiny", "en", "t") for i in range(2)] + [(None, "four words of it", "en", "n")] * 1000
    got = mixing.mix(docs(spark, rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    again = mixing.mix(docs(spark, rows).repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_repeat_and_cut(spark):
    rows = [(i, f"one two three four five{i}", "en", "a") for i in range(30)] + [(100, "solo word", "en", "b")]
    d = docs(spark, rows)
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(d).collect()}
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["size"] == "clash"
    assert {k: v for k, v in taken.items() if v} == dict(words)
    assert words[100] == 6


def test_shards_differ_by_one_row_at_most(spark, odd_rows):
    got = sharding.hilbert_shards(docs(spark, odd_rows)).collect()
    count = Counter(r["shard"] for r in got)
    assert len(got) == len(odd_rows) and max(count.values()) - min(count.values()) <= 1 and set(count) <= set(range(16))
    for shard, n in count.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert {r["size"] for r in got if r["doc_id"] in (200, 201)} == {1}


def test_hilbert_curve_visits_neighbours(spark):
    cells = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    df = sharding.hilbert(spark.createDataFrame(cells, "x int, y int, z int").selectExpr("x as ox", "y as oy", "z as oz", "x", "y", "z"), ["x", "y", "z"], "h", bits=3)
    at = {r["h"]: (r["ox"], r["oy"], r["oz"]) for r in df.collect()}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(511))


def test_shards_prune(spark):
    rows = [(i, "x" * (1 << (i % 8)), "en" if i % 3 else "de", f"s{i % 9}") for i in range(800)]
    got = sharding.hilbert_shards(docs(spark, rows)).collect()
    spread = {s: len({r["source"] for r in got if r["shard"] == s}) for s in range(16)}
    assert sum(spread.values()) / 16 < 7  # of 9


@pytest.mark.parametrize("run", [quality_rules.quality_rules, quality_rules.filtered, mixing.mix, mixing.mixed_documents, sharding.hilbert_shards])
def test_empty_table(spark, run):
    assert run(docs(spark, [])).count() == 0


def test_quality_cut_takes_symbol_junk_and_keeps_clean_tails(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    line = text(8)
    rows = [(i, text(), "en", "a") for i in range(200)] + [(900, " | ".join(text().split()), "en", "a"), (901, "\n".join([line, line] + [text(8) for _ in range(6)]), "en", "a"), (902, "one | two * " + text(), "en", "a")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert kept.pop(900) is False  # some 18% symbols
    assert all(kept.values())


def test_quality_judges_small_groups_by_language_or_all(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60))
    junk = lambda: " | ".join(text().split())
    rows = [(i, text(), "en", "a") for i in range(200)] + [(300 + i, text(), "en", "b") for i in range(20)]
    odd = [(900, junk(), "en", "b"), (901, junk(), "en", None), (902, junk(), "xx", "c"), (903, junk(), None, None)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, rows + odd)).collect()}
    assert not any(got[i]["kept"] for i, *_ in odd) and all(got[i]["kept"] for i, *_ in rows)
    assert all(r["distance2"] is not None for r in got.values())
    stay = {r["doc_id"] for r in quality_rules.filtered(docs(spark, rows + odd)).collect()}
    assert stay == {i for i, *_ in rows}


def in_duckdb(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.sql(sql).fetchall(), [c[0] for c in con.sql(sql).description]


def test_quality_equals_sql(spark, odd_rows):
    rng = random.Random(13)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(15, 90))) + " |" * k
    rows = odd_rows + [(1000 + i, text(rng.choice([0, 0, 0, 1, 30])), rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i in range(260)]
    d = docs(spark, rows)
    want, names = in_duckdb(quality_rules.SQL, d)
    got = [tuple(r[n] for n in names) for r in quality_rules.quality_rules(d).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r[-2] for r in got}) == 2


def test_quality_estimate_is_near_the_best_of_many_starts(spark):
    """Brute force: concentration steps from 60 random starts find no determinant much below ours."""
    rng = np.random.default_rng(3)
    z = np.floor(np.abs(np.concatenate([rng.normal([1.6, 0.05, 0.1, 0.1], [0.05, 0.03, 0.1, 0.05], (400, 4)), rng.normal([2.5, 0.6, 0.5, 0.3], 0.05, (100, 4))])) * quality_rules.GRID + 0.5)
    rows = [(*map(int, r), "aen", "aweb", False) for r in z]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in quality_rules.DIMS) + ", __lang string, __from string, base_failed boolean")
    (fit,) = quality_rules.fitted(df).collect()
    x, n = z / quality_rules.GRID, 4
    factor = np.array([[fit[f"__l{i}{j}"] if j <= i else 0 for j in range(n)] for i in range(n)])
    assert np.allclose([fit[f"__m{i}"] for i in range(n)], x[:400].mean(axis=0), atol=0.03)

    def spread(core):
        return np.cov(core.T, bias=True) * quality_rules.CONSISTENT + np.diag(np.square(quality_rules.FLOORS))

    best = np.inf
    for _ in range(60):
        core = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(12):
            inverse = np.linalg.inv(spread(core))
            gap = x - core.mean(axis=0)
            core = x[np.argsort(np.einsum("ij,jk,ik->i", gap, inverse, gap), kind="stable")[: int(0.75 * len(x))]]
        best = min(best, np.sqrt(np.linalg.det(spread(core))))
    assert np.prod(np.diag(factor)) <= 1.05 * best


def test_mixing_equals_sql(spark, odd_rows):
    d = docs(spark, odd_rows + [(None, "four words of it", "en", "n")] * 100 + [(7, "the same", "en", "n")] * 30).repartition(5)
    want, names = in_duckdb(mixing.SQL, d)
    got = [tuple(r[n] for n in names) for r in mixing.mix(d).select(*names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_mixed_documents_keep_line_breaks(spark):
    rows = [(i, "one\n two\tthree  four\nfive", "en", "a") for i in range(3)] + [(9, "six\nseven eight", "en", "b")]
    texts = [r["text"] for r in mixing.mixed_documents(docs(spark, rows)).collect()]
    assert all("one\n two\tthree  four\nfive".startswith(t) or "six\nseven eight".startswith(t) for t in texts)


def test_shards_are_written_whole(spark, odd_rows, tmp_path):
    rows = odd_rows + [(None, "twin", "en", "a")] * 40
    d = docs(spark, rows)
    sharding.write_shards(d, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    key = lambda r: (str(r["doc_id"]), r["text"], r["lang"], r["source"], r["size"])
    assert sorted(map(str, map(key, back.collect()))) == sorted(map(str, map(key, d.collect())))
    count = Counter(r["shard"] for r in back.collect())
    assert max(count.values()) - min(count.values()) <= 1 and len(count) == 16
    import zlib

    got = sharding.hilbert_shards(d).collect()
    mine = sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
    assert mine == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)


def test_shards_prune_by_length_and_place_without_joins(spark):
    import random

    rng = random.Random(3)
    rows = [(10**15 if i == 7 else i, "x" * int(rng.lognormvariate(6, 1)), rng.choice(["en", "de"]), f"s{rng.randrange(9)}") for i in range(3000)]
    out = sharding.hilbert_shards(docs(spark, rows))
    got = out.collect()
    rank = {size: i / 3000 for i, size in enumerate(sorted(r["size"] for r in got))}
    span = lambda f: sorted(max(f(r) for r in got if r["shard"] == s) - min(f(r) for r in got if r["shard"] == s) for s in range(16))
    assert span(lambda r: rank[r["size"]])[8] < 0.6  # cut by powers of two: nearly 1
    assert span(lambda r: min(r["doc_id"], 3000) / 3000)[8] < 0.6  # one far number takes no cells from the others
    plan = out._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and not any(f"hashpartitioning({c}" in plan for c in ("source", "lang"))


def test_shard_cells_of_many_values_are_by_rank(spark):
    rows = [(i, "x", "en", f"domain{i % 700:04d}") for i in range(2100)]
    cuts = sharding.text_cuts(docs(spark, rows), "source")
    assert len(cuts) == 15 and cuts == sorted(cuts)
    share = [sum(r[3] >= c for r in rows) / len(rows) for c in cuts]
    assert all(abs(s - (1 - i / 16)) < 0.01 for i, s in enumerate(share, 1))
    assert sharding.text_cuts(docs(spark, []), "source") == []


def test_bpe_keeps_the_pairs_that_many_words_share():
    """New words bring over 50,000 pairs of tokens; forgetting all of them made each be settled again and again."""
    from tracewright.llm import bpe

    with open(bpe.default_vocabulary(), "rb") as f:
        coder = bpe.Bpe(f.read())
    coder.pairs.update(dict.fromkeys(range(1 << 40, (1 << 40) + 60_000), True))
    coder.encode("the words and others")
    assert coder.compatible(*coder.encode_piece(b"undiscoverably")[:2]) and len(coder.pairs) > 60_000
