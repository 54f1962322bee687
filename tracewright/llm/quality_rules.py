"""Quality rules with robust multivariate outliers, with DataFrame functions only.

Each document gets four statistics of its whole text (letters a word, shares of symbols, repeated
lines and repeated 8-word windows). Their transforms, as whole numbers of 1 / GRID, are judged against a
minimum covariance determinant estimate of the document's group (language and source): from two starts
(medians with quartile spreads; means with covariances), concentration steps keep the CORE share of rows
nearest to the current centre and estimate anew; of both results the one with the smaller determinant
counts. A document is rejected if its Mahalanobis distance under it exceeds CUTOFF. Groups of under
LEAST rows are judged by the estimate of their language, and by that of all rows where the language has
fewer, too.

Rows that pass the base rules are counted by group and transformed statistics first, with partial counts
before the shuffle: a hot group is spread over its cells, whose number the grid bounds, and every later
step goes over cells, not rows. Sums are of whole numbers, so that results depend neither on the
partitioning nor on the order. Estimates of a group are one row; they are broadcast while they are few
(checked), so that no row moves for them.

Defined results: null text counts as empty and fails the base rules; null language or source form
groups of their own; a table of under LEAST rows that pass the base rules rejects none of them; equal
rows get equal results; an empty table gives an empty table; other columns are not read (`filtered` keeps them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, if_small, materialize, table, whole

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Share of rows in the core; concentration steps; fewest rows that make an estimate; cells to 1 of a
#: transformed statistic, and to 1 of the logarithm of a distance.
CORE, STEPS, LEAST, GRID, FINE = 0.75, 4, 50, 512, 256
#: Squared distance: the 1 - 1e-6 quantile of chi-squared with 4 degrees of freedom.
CUTOFF = 33.4
#: What makes the covariance of a normal law's core that of the law: CORE over the share of chi-squared
#: with 6 degrees of freedom below the CORE quantile of that with 4.
CONSISTENT = 1.487
#: Least standard deviation of each transformed statistic: most documents have no symbols and no
#: repeats at all, and a spread of 0 would reject the first one that has any. They follow the tails of
#: labelled clean documents: these have no symbols, so that 3% are too many, but up to a third of their
#: lines and a quarter of their windows repeated, which the base rules judge already.
FLOORS = (0.06, 0.03, 0.15, 0.15)
DIMS = tuple(f"__z{i}" for i in range(len(FLOORS)))


def with_value(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def repeated(words: Column) -> Column:
    """Words that lie in a window of 8 found twice or more. Windows are compared by a 64-bit hash of
    their words' hashes; only texts with some equal windows are sorted."""

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    def starts(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"])
        marked = F.transform(s, lambda x, i: F.when(F.coalesce(same(x, i), F.lit(False)), x["p"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def of(w: Column) -> Column:
        paired = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(with_value(with_value(paired, starts), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, 0).otherwise(with_value(with_value(hashes, windows), of)).cast("long")


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(df: DataFrame, text: str) -> DataFrame:
    """df + the base statistics of every whole text, by name."""
    df = df.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    return df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated(F.col("__words")),
        "n_lines": F.size("__lines").cast("long"),
    }).drop("__words", "__lines")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every whole text."""
    df = docs.select("doc_id", "lang", "source", whole(F.col("text")).alias("__text"))
    return measured(df, "__text").drop("__text")


def transformed() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(1 + F.col("word_chars") / words),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1.0)),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def distance(df: DataFrame, out: str = "__d2") -> DataFrame:
    """+ squared Mahalanobis distance by forward substitution in the Cholesky factor (columns __l..)."""
    names, n = [], len(DIMS)
    for i in range(n):
        rest = reduce(lambda a, k: a - F.col(f"__l{i}{k}") * F.col(f"__y{k}"), range(i), F.col(DIMS[i]).cast("double") / GRID - F.col(f"__m{i}"))
        df = df.withColumn(f"__y{i}", rest / F.col(f"__l{i}{i}"))
        names.append(f"__y{i}")
    return df.withColumn(out, reduce(lambda a, y: a + F.col(y) * F.col(y), names, F.lit(0.0))).drop(*names)


def estimate(core: DataFrame, group: list[str], consistent: float) -> DataFrame:
    """Mean, Cholesky factor of the covariance with the floors on the diagonal, and __det, the product
    of the factor's diagonal, from cells with counts __n."""
    n = len(DIMS)
    times = lambda *c: F.sum(reduce(lambda a, b: a * F.col(b), c, F.col("__n").cast("decimal(38,0)"))).cast("double")
    cross = [times(DIMS[i], DIMS[j]).alias(f"__s{i}{j}") for i in range(n) for j in range(i + 1)]
    df = core.groupBy(*group).agg(F.sum("__n").cast("double").alias("__k"), *(times(z).alias(f"__t{i}") for i, z in enumerate(DIMS)), *cross)
    df = df.withColumns({f"__m{i}": F.col(f"__t{i}") / F.col("__k") / GRID for i in range(n)})
    for i in range(n):
        for j in range(i + 1):
            c = (F.col(f"__s{i}{j}") / F.col("__k") / (GRID * GRID) - F.col(f"__m{i}") * F.col(f"__m{j}")) * consistent
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2
            c = reduce(lambda a, k: a - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}"), range(j), c)
            df = df.withColumn(f"__l{i}{j}", F.sqrt(F.greatest(c, F.lit(FLOORS[i] ** 2 / 100))) if i == j else c / F.col(f"__l{j}{j}"))
    df = df.withColumn("__det", reduce(lambda a, i: a * F.col(f"__l{i}{i}"), range(n), F.lit(1.0)))
    return df.drop("__k", *(f"__t{i}" for i in range(n)), *(f"__s{i}{j}" for i in range(n) for j in range(i + 1)))


GROUP = ["__lang", "__from"]


def levels() -> list[tuple[Column, Column]]:
    """A group, its language, all rows; names of languages and sources are never empty."""
    return [(F.col("__lang"), F.col("__from")), (F.col("__lang"), F.lit("")), (F.lit(""), F.lit(""))]


def prepared(stats: DataFrame) -> DataFrame:
    """+ base_failed, the group and the transformed statistics, in whole cells of 1 / GRID."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    name = lambda c: F.coalesce(F.concat(F.lit("a"), F.col(c)), F.lit("b"))
    cells = {z: F.floor(t * GRID + 0.5).cast("long") for z, t in zip(DIMS, transformed(), strict=True)}
    return stats.withColumns({"base_failed": failed, "__lang": name("lang"), "__from": name("source")} | cells)


def counted(rows: DataFrame) -> DataFrame:
    """Cells of the rows that pass the base rules, with their counts __n, at each of levels() where the
    group has LEAST rows."""
    cells = rows.where(~F.col("base_failed")).groupBy(*GROUP, *DIMS).agg(F.count("*").alias("__n"))
    each = F.array(*(F.struct(*(c.alias(g) for c, g in zip(at, GROUP, strict=True))) for at in levels()))
    cells = cells.select(F.explode(each).alias("__at"), *DIMS, "__n").groupBy("__at.__lang", "__at.__from", *DIMS).agg(F.sum("__n").alias("__n"))
    cells = materialize(cells, "quality-cells")
    enough = materialize(cells.groupBy(*GROUP).agg(F.sum("__n").alias("__of")).where(F.col("__of") >= LEAST).select(*GROUP), "quality-groups")
    return cells.join(if_small(enough), GROUP)


def fitted(rows: DataFrame) -> DataFrame:
    """For each group of the rows, the estimate from those that pass the base rules: the group's own,
    that of its language or that of all rows, the first that LEAST rows make. No estimate, no row."""
    cells, n = counted(rows), len(DIMS)
    quarter = [F.expr(f"percentile({z}, array(0.25, 0.5, 0.75), __n)").alias(f"__q{i}") for i, z in enumerate(DIMS)]
    spread = lambda i: F.greatest((F.get(f"__q{i}", F.lit(2)) - F.get(f"__q{i}", F.lit(0))) / GRID / 1.349, F.lit(FLOORS[i]))
    factor = {f"__l{i}{j}": spread(i) if i == j else F.lit(0.0) for i in range(n) for j in range(i + 1)}
    robust = cells.groupBy(*GROUP).agg(*quarter).withColumns({f"__m{i}": F.get(f"__q{i}", F.lit(1)) / GRID for i in range(n)} | factor)
    numbers = [*(f"__m{i}" for i in range(n)), *factor]
    fit = robust.select(*GROUP, F.lit(0).alias("__start"), *numbers).unionByName(estimate(cells, GROUP, 1.0).select(*GROUP, F.lit(1).alias("__start"), *numbers))
    runs = [*GROUP, "__start"]
    for _ in range(STEPS):
        fit = if_small(materialize(fit, "quality-fit"))
        near = distance(cells.join(fit, GROUP)).withColumn("__log", F.floor(F.log(F.col("__d2") + 1e-6) * FINE)).select(*runs, *DIMS, "__n", "__log")
        edge = if_small(materialize(near.groupBy(*runs).agg(F.expr(f"percentile(__log, {CORE}, __n)").alias("__edge")), "quality-edge"))
        fit = estimate(near.join(edge, runs).where(F.col("__log") <= F.col("__edge")), runs, CONSISTENT)
    fit = materialize(fit, "quality-fit")
    best = fit.groupBy(*GROUP).agg(F.min_by(F.struct(*numbers), F.struct("__det", "__start")).alias("__fit")).select(*GROUP, "__fit.*")
    return if_small(materialize(nearest(rows.select(*GROUP).distinct(), materialize(best, "quality-best")), "quality-fit"))


def nearest(groups: DataFrame, fit: DataFrame) -> DataFrame:
    """Each group with the estimate of the first of its levels() that has one."""
    numbers = [c for c in fit.columns if c not in GROUP]
    fit = fit.select(*(F.col(g).alias(f"{g}_of") for g in GROUP), F.struct(*numbers).alias("__fit"))
    for k, at in enumerate(levels()):
        of = if_small(fit.withColumnsRenamed({f"{g}_of": f"{g}_{k}" for g in GROUP} | {"__fit": f"__fit_{k}"}))
        groups = groups.join(of, reduce(Column.__and__, (of[f"{g}_{k}"] == c for g, c in zip(GROUP, at, strict=True))), "left")
    found = F.coalesce(*(F.col(f"__fit_{k}") for k in range(len(levels()))))
    return groups.select(*GROUP, found.alias("__fit")).where("__fit is not null").select(*GROUP, "__fit.*")


def judged(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """prepared() + distance2 (null where the table is too small for any estimate), kept. One comparison decides: a condition
    on the base rules alone would be pushed below the join, and the text measured there once more."""
    out = distance(rows.join(fit, GROUP, "left"), "distance2")
    return out.withColumn("kept", F.coalesce(F.col("distance2"), F.lit(0.0)) <= F.when(F.col("base_failed"), -1.0).otherwise(CUTOFF))


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang, source -> a row for each document, BASE and distance2."""
    rows = materialize(prepared(statistics(docs)), "quality-stats")
    return judged(rows, fitted(rows)).select(*BASE, "distance2")


def filtered(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject; all columns stay. The texts are measured once for the
    estimates and once more as they are judged, so that no text ever moves or is written."""
    fit = fitted(materialize(prepared(statistics(docs)), "quality-stats"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), whole(F.col("text")).alias("__text"), "lang", "source")
    return judged(prepared(measured(held, "__text")), fit).where("kept").select(*(F.col(f"__doc.`{c}`").alias(c) for c in docs.columns))


def query(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def sql() -> str:
    """The query as SQL: base statistics by lists, every estimate and step a common table."""
    n = len(DIMS)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    numbers = ", ".join([*(f"m{i}" for i in range(n)), *(f"l{i}{j}" for i, j in pairs)])

    def distances(rows: str, fit: str, on: str, extra: str) -> str:
        """A chain of subqueries that ends in d2."""
        text = f"select {extra}, {numbers} from {rows} join {fit} on {on}"
        for i in range(n):
            rest = "".join(f" - l{i}{k} * y{k}" for k in range(i))
            text = f"select *, (z{i}::double / {GRID} - m{i}{rest}) / l{i}{i} y{i} from ({text})"
        return f"select *, 0.0::double{''.join(f' + y{i} * y{i}' for i in range(n))} d2 from ({text})"

    def estimated(core: str, by: str, consistent: float) -> str:
        sums = ", ".join([f"sum(n)::double k", *(f"sum(n * z{i})::double t{i}" for i in range(n)), *(f"sum(n * z{i} * z{j})::double s{i}{j}" for i, j in pairs)])
        text = f"select *, {', '.join(f't{i} / k / {GRID} m{i}' for i in range(n))} from (select {by}, {sums} from {core} group by all)"
        for i, j in pairs:
            c = f"(s{i}{j} / k / {GRID * GRID} - m{i} * m{j}) * {consistent}::double"
            if i == j:
                c = f"greatest({c}, 0.0::double) + {FLOORS[i] ** 2!r}::double"
            c += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            text = f"select *, {f'sqrt(greatest({c}, {FLOORS[i] ** 2 / 100!r}::double))' if i == j else f'({c}) / l{j}{j}'} l{i}{j} from ({text})"
        return f"select {by}, {numbers}, 1.0::double{''.join(f' * l{i}{i}' for i in range(n))} det from ({text})"

    grid = lambda x: f"cast(floor(({x}) * {GRID} + 0.5) as bigint)"
    parts = [
        r"""d as materialized (select row_number() over () rid, doc_id, coalesce('a' || lang, 'b') lang, coalesce('a' || source, 'b') src, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from documents)""",
        f"p as (select rid, words, unnest(range(1, len(words) - {WINDOW} + 2)) i from d)",
        f"g as (select rid, i, count(*) over (partition by rid, md5(array_to_string(words[i:i + {WINDOW - 1}], ' '))) c from p)",
        f"u as (select rid, sum(least({WINDOW}, step)) rep from (select rid, coalesce(lead(i) over (partition by rid order by i) - i, {WINDOW}) step from g where c > 1) group by rid)",
        """b as (select d.rid, doc_id, lang, src, cast(len(words) as bigint) n_words, cast(length(array_to_string(words, '')) as bigint) word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines, cast(coalesce(rep, 0) as bigint) n_repeat_words, len(lines) n_lines from d left join u on d.rid = u.rid)""",
        f"""r as materialized (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words base_failed, {grid("ln(1 + word_chars / greatest(n_words, 1)::double)")} z0, {grid("sqrt(n_symbols / (word_chars + 1.0::double))")} z1,
  {grid("sqrt(n_dup_lines / greatest(n_lines, 1)::double)")} z2, {grid("sqrt(n_repeat_words / greatest(n_words, 1)::double)")} z3 from b)""",
        "v as (select lang, src, z0, z1, z2, z3 from r where not base_failed union all select lang, '', z0, z1, z2, z3 from r where not base_failed union all select '', '', z0, z1, z2, z3 from r where not base_failed)",
        f"c as materialized (select lang, src, z0, z1, z2, z3, count(*) n from v where (lang, src) in (select (lang, src) from v group by lang, src having count(*) >= {LEAST}) group by all)",
    ]
    quarter = lambda i, q: f"quantile_cont(z{i}, {q})"
    factor = ", ".join(f"greatest(({quarter(i, 0.75)} - {quarter(i, 0.25)}) / {GRID} / 1.349::double, {FLOORS[i]!r}::double) l{i}{j}" if i == j else f"0.0::double l{i}{j}" for i, j in pairs)
    parts.append(f"f0 as materialized (select lang, src, 0 start, {', '.join(f'{quarter(i, 0.5)} / {GRID} m{i}' for i in range(n))}, {factor}, 0.0::double det from v where (lang, src) in (select (lang, src) from c) group by lang, src union all select lang, src, 1, {numbers}, det from ({estimated('c', 'lang, src', 1.0)}))")
    for k in range(STEPS):
        near = distances("c", f"f{k} f", "c.lang = f.lang and c.src = f.src", "c.lang, c.src, start, z0, z1, z2, z3, n")
        parts.append(f"n{k} as materialized (select lang, src, start, z0, z1, z2, z3, n, floor(ln(d2 + 1e-6) * {FINE}) lg from ({near}))")
        parts.append(f"e{k} as (select lang, src, start, quantile_cont(lg, {CORE}) edge from (select lang, src, start, lg, unnest(range(n)) from n{k}) group by all)")
        parts.append(f"f{k + 1} as materialized ({estimated(f'(select n{k}.* from n{k} join e{k} using (lang, src, start) where lg <= edge)', 'lang, src, start', CONSISTENT)})")
    parts.append(f"best as (select * from f{STEPS} qualify row_number() over (partition by lang, src order by det, start) = 1)")
    parts.append("a as (select distinct on (rid) rid, b.* exclude (start, det), case when b.src <> '' then 0 when b.lang <> '' then 1 else 2 end depth from r join best b on (b.lang = r.lang or b.lang = '') and (b.src = r.src or b.src = '') order by rid, depth)")
    judged = distances("r", "a", "r.rid = a.rid", "r.rid, z0, z1, z2, z3")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2, 0) <= {CUTOFF} kept, d2 distance2 from r left join ({judged}) j on r.rid = j.rid"


SQL = sql()
