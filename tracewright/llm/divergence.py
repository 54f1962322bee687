"""Divergence of sources: how far each source's smoothed term shares lie from each other source's, and its own terms.

Terms are counted where the texts lie, by language and source. Of a language, the terms in at least LEAST
of its documents are kept (V of them), and each group (a language with a source), as well as each language, gives each a
price p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), N its occurrences of kept terms. The
distance of two groups is the sum of |p - q| over all kept terms, though most terms are missing from most
groups. It is put together by inclusion and exclusion over the supports A and B, with z a group's price of a
missing term:

    distance = one(A, z_b) + one(B, z_a) + (V - |A| - |B|) |z_a - z_b|
               + sum over A and B of (|p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|)

one(A, z), the terms of A as if the other had none, comes from a histogram of A's counts; the third part is a
constant a pair; the overlap is corrected by joins of postings. Postings meet in blocks of terms and of
sources, so no task holds more than a bounded number of them, no row is made for each pair of a term, and a term of
all sources is split over blocks. All numbers are whole.

Defined results: null text, lang and source count as ''; a group without terms has its row with each other source;
V = 0 gives distances of 0 and no terms; ties go by the item's bytes; repeated rows count each; very long
texts are cut between terms and counted whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import ship

from .common import if_small, materialize, table, whole

LEAST, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Kept terms and sources of a block: a task of postings holds their product twice at most.
TERMS, SOURCES = 256, 64
#: Counts that a worker holds before it hands them on, and bytes of a text that it cuts into terms at a time.
HELD, PIECE = 200_000, 1 << 20
#: A term in UTF-8, after A-Z have become small: bytes from 0x80 belong to other characters.
TERM = re.compile(rb"[a-z\x80-\xff]+")
OTHER = re.compile(rb"[^A-Za-z\x80-\xff]")


def pieces(text: bytes):
    """The text, cut between terms into pieces of about PIECE bytes."""
    start = 0
    while start < len(text):
        gap = OTHER.search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def counted_terms(batches):
    """Rows (lang, source, term, occurrences, documents) of partial sums. The term '' counts documents."""
    import pyarrow as pa

    names = ["lang", "source", "term", "occurrences", "documents"]
    held: dict = {}
    size = 0

    def handed():
        keys = [(lang, source, term) for (lang, source), terms in held.items() for term in terms]
        sums = [x for terms in held.values() for x in terms.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.binary()).cast(pa.string()) for i in range(3)] + [pa.array([x[i] for x in sums], pa.int64()) for i in range(2)], names
        )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            terms = held.setdefault((lang, source), {})
            before, mine = len(terms), {b"": 0}
            for part in pieces(text):
                for term in TERM.findall(part.lower()):
                    mine[term] = mine.get(term, 0) + 1
            for term, n in mine.items():
                sums = terms.get(term)
                if sums is None:
                    terms[term] = [n, 1]
                else:
                    sums[0] += n
                    sums[1] += 1
            size += len(terms) - before
            if size >= HELD:
                yield handed()
                held, size = {}, 0
    if held:
        yield handed()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, occurrences, total (of the language), first (of a term's rows, one) of every group
    and kept term; the term '' stands for the group itself."""
    ship(docs.sparkSession)
    rows = docs.select(*(whole(F.col(c)).cast("binary").alias(c) for c in ("lang", "source", "text")))
    part = rows.mapInArrow(counted_terms, "lang string, source string, term string, occurrences long, documents long")
    mine = part.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    of_lang = Window.partitionBy("lang", "term")
    seen = mine.withColumns({"total": F.sum("occurrences").over(of_lang), "spread": F.sum("documents").over(of_lang), "first": F.min("source").over(of_lang) == F.col("source")})
    return seen.where((F.col("spread") >= LEAST) | (F.col("term") == "")).drop("documents", "spread")


def price(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exactly; 1 where nothing is kept."""
    part = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.coalesce(F.call_function("div", part, F.nullif((n + SMOOTH * v).cast("decimal(20,0)"), F.lit(0))), F.lit(0))


def groups(kept: DataFrame) -> DataFrame:
    """lang, source, place (from 0 in the language), support, n, zero (the price of a missing term), and of the
    language v, lang_n, blocks: a row a group."""
    real = F.col("term") != ""
    one = lambda x: F.sum(F.when(x, 1).otherwise(0))
    mine = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"), one(real).alias("support"), one(real & F.col("first")).alias("firsts"))
    of_lang = Window.partitionBy("lang")
    out = mine.withColumns({
        "place": F.row_number().over(of_lang.orderBy("source")) - 1, "v": F.sum("firsts").over(of_lang), "lang_n": F.sum("n").over(of_lang),
        "blocks": F.ceil(F.count(F.lit(1)).over(of_lang) / SOURCES).cast("int"),
    })
    return out.withColumn("zero", price(F.lit(0), F.col("n"), F.col("v"))).drop("firsts")


def overlaps(rows: pd.DataFrame) -> pd.DataFrame:
    """What shared terms add to the distance of groups, both ways: from all postings that two blocks of
    sources (or one with itself) have in a block of terms."""
    block = rows["block"].to_numpy()
    term = pd.factorize(rows["term"])[0]
    sides = []
    for at in (block.min(), block.max()):
        mine = rows[block == at]
        place, column = np.unique(mine["place"].to_numpy(), return_inverse=True)
        prices = np.full((term.max() + 1, len(place)), -1, np.int64)
        prices[term[block == at], column] = mine["p"].to_numpy()
        zero = np.zeros(len(place), np.int64)
        zero[column] = mine["zero"].to_numpy()
        sides.append((place, prices, zero))
    (ours, p, z), (theirs, q, y) = sides
    out = []
    for a in range(len(ours)):
        has = np.flatnonzero(p[:, a] >= 0)
        mine, other = p[has, a][:, None], q[has]
        more = np.abs(mine - other) - np.abs(mine - y) - np.abs(z[a] - other) + np.abs(z[a] - y)
        total = np.where(other >= 0, more, 0).sum(axis=0)
        out += [(int(ours[a]), int(b), int(x)) for b, x in zip(theirs, total, strict=True) if b > ours[a] and x]
    both = pd.DataFrame(out + [(b, a, x) for a, b, x in out], columns=["place", "other", "value"]).astype("int64")
    return both.assign(lang=rows["lang"].iloc[0])


def one_sided(histogram: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Both ways, what a group's terms cost against each other group as if that had none, by its histogram
    of prices; and, once for a pair and way, the constant of the terms that neither has."""
    h = histogram.sort_values("p")
    p, n = h["p"].to_numpy(dtype=np.int64), h["terms"].to_numpy(dtype=np.int64)
    number, cost = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * p))
    z = others["other_zero"].to_numpy(dtype=np.int64)
    under = np.searchsorted(p, z)
    one = z * number[under] - cost[under] + (cost[-1] - cost[under]) - z * (number[-1] - number[under])
    neither = (others["v"] - others["support"] - others["other_support"]).to_numpy(dtype=np.int64)
    constant = neither * np.abs(others["zero"].to_numpy(dtype=np.int64) - z)
    there = pd.DataFrame({"lang": others["of"], "place": others["own"], "other": others["other"], "value": one + constant})
    back = pd.DataFrame({"lang": others["of"], "place": others["other"], "other": others["own"], "value": one})
    return pd.concat([there, back])


PAIRS = "lang string, place long, other long, value long"


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: each other source of the language and its distance;
    part `term`: the TOP terms that the source has more of than its language."""
    kept = materialize(counts(docs), "divergence-counts")
    every = materialize(groups(kept), "divergence-groups")
    small = if_small(every)
    postings = kept.where("term != ''").join(small, ["lang", "source"]).withColumn("p", price(F.col("occurrences"), F.col("n"), F.col("v")))

    block = F.col("block")
    dealt = postings.withColumn("block", F.floor(F.col("place") / SOURCES)).withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / TERMS)).alias("__terms"), F.least(block, "__with").alias("__i"), F.greatest(block, "__with").alias("__j"), "block", "term", "place", "p", "zero")
    shared = dealt.groupBy("lang", "__terms", "__i", "__j").applyInPandas(overlaps, PAIRS)

    other = small.select("lang", F.col("place").alias("other"), F.col("zero").alias("other_zero"), F.col("support").alias("other_support"))
    pairs = every.select("lang", "place", "zero", "support", "v").join(other, "lang").where("place != other").withColumnsRenamed({"lang": "of", "place": "own"})
    histogram = postings.groupBy("lang", "place", "p").agg(F.count(F.lit(1)).alias("terms"))
    single = histogram.groupBy("lang", "place").cogroup(pairs.groupBy("of", "own")).applyInPandas(one_sided, PAIRS)

    distance = single.unionByName(shared).groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    names = small.select("lang", "place", "source")
    named = distance.join(names, ["lang", "place"]).join(names.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    own = postings.withColumn("value", F.col("p") - price(F.col("total"), F.col("lang_n"), F.col("v"))).where("value > 0").withColumn("item", F.col("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(named, "pair").unionByName(ranked(own, "term").where(F.col("rank") <= TOP))


def query(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = r"""
with d as (select coalesce(text, '') t, coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () id from documents),
w as (select lang, source, id, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
c as (select lang, source, term, count(*) n from w group by all),
k as (select lang, term from (select distinct lang, term, id from w) group by all having count(*) >= 30),
g as (select distinct lang, source from d),
m as (select g.lang, g.source, k.term, coalesce(c.n, 0) n from g join k using (lang) left join c using (lang, source, term)),
s as (select lang, source, cast(sum(n) as hugeint) total, count(*) v from m group by all),
p as (select m.*, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) p from m join s using (lang, source)),
ln as (select lang, sum(total) total, max(v) v from s group by lang),
lt as (select lang, term, sum(n) n from m group by all),
q as (select lt.lang, lt.term, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) q from lt join ln using (lang)),
e as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(value, 0) as bigint) value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join e on e.lang = a.lang and e.source = a.source and e.item = b.source
      union all select lang, source, 'term', term, cast(p - q as bigint) from p join q using (lang, term) where n > 0 and p > q),
o as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) rank from r)
select * from o where part = 'pair' or rank <= 50
"""
