"""N-gram Jaccard join: pairs of texts whose sets of five-word shingles agree to 0.8 or more.

1. Documents of equal text form a class; from here on only classes are joined (copies count through
   their class, so groups of thousands cost as much as one document).
2. MinHash signatures of the classes' shingle sets; BANDS bands of ROWS rows (chosen for the target
   recall). Classes that share a band hash are candidates: each is tied to the bucket's first class, so
   a bucket of m gives m - 1 rows, not m squared. Components of these ties hold every candidate pair.
3. Candidates are verified on full shingle sets, as products of sparse incidence blocks of BLOCK classes
   at most. A component of one block is verified whole, and so is a larger one, as pairs of blocks, whose
   buckets together hold as many pairs as it has (near copies of one text share most buckets). In a
   larger one with fewer (chains of slightly like texts) first the ties are verified, and only those that hold unite: what they unite is verified
   whole; pairs of different such parts are verified bucket by bucket, each in the
   least bucket that it shares. A task's memory is bounded, and tasks return counts of links and a
   spanning forest of them, never the pairs.
4. Components of the links are the groups of near duplicates.

So the work is that of the candidate pairs: a chain of slightly like texts costs its length, while m texts
that all share a bucket cost m squared comparisons, in bounded blocks, and each text is sent once for
each block.

Words are lower-cased runs without white space; a text of fewer than five words is one shingle of all
it has. A group's name (`class_id`) is the md5 of its first text (by least doc_id, null last, then md5), so that
neither null nor repeated doc_ids make groups clash. Defined results: null counts as empty; empty texts
are copies of each other; repeated rows are copies; an empty table gives an empty
table; other columns are not read (`deduplicated` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

from .common import bitmap, materialize, over_texts, partitions, probable, runs, table, whole, words_of

SHINGLE, SIMILAR = 5, 0.8
#: Target recall of a pair at exactly SIMILAR, and most hash functions that may be spent on it.
RECALL, HASHES = 0.9998, 400
BLOCK = 512
REMEMBERED = 50_000


def bands_and_rows(similar: float = SIMILAR, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Most rows to a band (fewest false candidates) that reach the recall within the hash functions."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similar**rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


BANDS, ROWS = bands_and_rows()


class Shingles:
    """Hashed shingle sets; word hashes are remembered up to a bound."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        """Distinct 64-bit shingle hashes, sorted; none for a text without words."""
        words, known = words_of(text.lower()), self.words
        if not words:
            return np.zeros(0, np.uint64)
        try:
            h = np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in words], dtype=np.uint64)
        n = max(1, len(h) - SHINGLE + 1)
        s = np.zeros(n, np.uint64)
        for i in range(min(SHINGLE, len(h))):
            s = (s ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
            s ^= s >> np.uint64(29)
        return np.unique(s)


class MinHash:
    """Band hashes of a shingle set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.mix = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(low), 256):  # blocks that stay in the processor's cache
            h = np.multiply.outer(self.a, low[i : i + 256])
            h ^= h >> np.uint32(15)
            h += self.b[:, None]
            np.minimum(least, h.min(axis=1), out=least)
        h = (least.reshape(self.bands, self.rows).astype(np.uint64) + np.uint64(1)) * self.mix
        h ^= h >> np.uint64(31)
        keys = h.sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.bands, dtype=np.uint64)
        keys ^= keys >> np.uint64(32)
        return keys.view(np.int64)


def classes(docs: DataFrame) -> DataFrame:
    """A row for each different text: nid (a number of its own), ckey, rep (least doc_id), n, bands.

    Bands are computed before copies meet, for texts never move; of each copy only a digest does."""

    def make():
        shingles, minhash = Shingles(), MinHash()

        def work(texts):
            keys = [minhash(s) if len(s := shingles(t)) else None for t in texts]
            flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
            ends = np.cumsum([0] + [0 if k is None else len(k) for k in keys])
            return {"bands": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))}

        return work

    rows = over_texts(docs.select("doc_id", F.md5(whole(F.col("text"))).alias("ckey"), "text"), make, "doc_id long, ckey string, bands array<bigint>")
    one = rows.groupBy("ckey").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    return materialize(one.withColumn("nid", F.monotonically_increasing_id()), "join-classes")


def candidates(texts: DataFrame) -> DataFrame:
    """(a, b): each class tied to the first of its bucket, for buckets of two and more."""
    keys = texts.select("nid", F.explode("bands").alias("key"))
    firsts = keys.groupBy("key").agg(F.min("nid").alias("b"), F.max("nid").alias("__last")).where("b < __last").drop("__last")
    return keys.join(firsts, "key").where("nid <> b").select(F.col("nid").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b); root: the least node of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): a logarithm of steps even on
    long chains, and never more edges than at the start; each step's edges are written out."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(first.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, similar: float = SIMILAR) -> np.ndarray:
    """Boolean matrix: which sets of `left` (numbers of sets) reach the similarity with which of
    `right` (null: left among itself). Only shingles of two sets and more are counted, a block of
    columns at a time."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    cols = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    order = np.argsort(cols, kind="stable")
    cols, owner = cols[order], owner[order]
    new = np.concatenate([[True], cols[1:] != cols[:-1]])
    number = np.cumsum(new) - 1
    count = np.bincount(number)
    shared = count[number] > 1
    owner, number = owner[shared], (np.cumsum(count > 1) - 1)[number[shared]]
    b = left if right is None else right
    common, width = np.zeros((len(left), len(b))), 4096
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], number[lo:hi] - at] = 1
        common += part[left] @ part[b].T
    return common >= similar * (sizes[left][:, None] + sizes[b][None, :] - common) - 1e-9


def shared_least(a: list, b: list, key: int) -> np.ndarray:
    """Boolean matrix: of which pairs of key lists `key`, which all hold, is the least that both hold.
    The lists are sorted."""
    lower = sorted({k for ks in (*a, *b) for k in ks if k < key})
    number = {k: i for i, k in enumerate(lower)}

    def marks(lists):
        out = np.zeros((len(lists), len(lower)), np.float32)
        for i, ks in enumerate(lists):
            out[i, [number[k] for k in ks if k < key]] = 1
        return out

    return marks(a) @ marks(b).T == 0 if lower else np.ones((len(a), len(b)), bool)


#: Kinds of units: a whole part, a bucket across parts, ties to a bucket's first.
WHOLE, ACROSS, TIES = 0, 1, 2


def verify(batches: Iterator) -> Iterator:
    """Sorted rows of units (kind, unit, bi, bj, nid, n, block, part, keys, text) -> links of each class
    (to documents, to texts) and a forest of them; of TIES units the forest only."""
    shingles = Shingles()
    for group in runs(batches, ["kind", "unit", "bi", "bj"]):
        rows = list({(r[4], r[6]): r for r in group}.values())  # a class's document may stand there twice
        kind, unit, bi, bj = group[0][:4]
        nid, n, block, part = (np.array([r[i] for r in rows], dtype=np.int64) for i in (4, 5, 6, 7))
        here = np.flatnonzero(block == bi)
        there = None if bi == bj else np.flatnonzero(block == bj)
        if not len(here) or there is not None and not len(there):
            continue
        near = links([shingles(r[9]) for r in rows], here, there)
        if there is None:
            np.fill_diagonal(near, False)
        other = here if there is None else there
        if kind == ACROSS:
            near &= part[here][:, None] != part[other][None, :]
            if near.any():
                near &= shared_least([rows[i][8] for i in here], [rows[i][8] for i in other], unit)
        docs, texts, at = near @ n[other], near.sum(axis=1), here
        if there is not None:
            docs, texts, at = np.concatenate([docs, near.T @ n[here]]), np.concatenate([texts, near.sum(axis=0)]), np.concatenate([here, there])
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, row in zip(here.tolist(), near, strict=True):
            for j in other[row].tolist():
                a, b = find(int(nid[i])), find(int(nid[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        counts = kind != TIES
        yield pa.RecordBatch.from_pydict({
            "nid": pa.array(nid[at], pa.int64()), "docs": pa.array(docs * counts, pa.int64()), "texts": pa.array(texts * counts, pa.int64()), "top": pa.array([find(int(x)) for x in nid[at]], pa.int64()),
        })


def verified(batches):
    """verify() on Arrow batches, with results put together to batches of some size."""
    held, rows = [], 0
    for out in verify(b.to_pandas() for b in batches):
        held.append(out)
        rows += out.num_rows
        if rows > 5000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def blocks_of(members: DataFrame, by: list[str]) -> DataFrame:
    """members + __blocks, the number of blocks of the unit that `by` names, and block, the member's."""
    sizes = members.groupBy(*by).agg(F.count("*").alias("__c"))
    sized = members.join(sizes, by).withColumn("__blocks", F.ceil(F.col("__c") / BLOCK).cast("int")).drop("__c")
    return sized.withColumn("block", F.pmod(F.xxhash64("nid"), F.col("__blocks")).cast("int"))


UNIT = ["kind", "unit", "bi", "bj", "nid", "block", "part", "keys"]


def block_pairs(members: DataFrame) -> DataFrame:
    """A row for each member and pair of blocks that it takes part in."""
    rows = members.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return rows.withColumns({"bi": F.least("block", "__other"), "bj": F.greatest("block", "__other")}).select(*UNIT)


def checked(units: DataFrame, texts: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The units' links: (nid, docs, texts, top). Texts of their members only move, once for each unit."""
    spark = docs.sparkSession
    some = materialize(units.select("nid").distinct().join(texts.select("nid", "ckey", "rep", "n"), "nid"), f"{name}-members")
    body = docs.select(F.col("doc_id").alias("__doc"), F.md5(whole(F.col("text"))).alias("__key"), whole(F.col("text")).alias("text"))
    body = probable(body, "__key", bitmap(some, "ckey"))  # most texts have no candidate and stay where they are
    body = body.join(some, (F.col("__key") == F.col("ckey")) & F.col("__doc").eqNullSafe(F.col("rep"))).select("nid", "n", "text")
    rows = units.join(body, "nid").select("kind", "unit", "bi", "bj", "nid", "n", "block", "part", "keys", "text")
    dealt = rows.repartition(partitions(spark), "kind", "unit", "bi", "bj").sortWithinPartitions("kind", "unit", "bi", "bj", "nid")
    return materialize(dealt.mapInArrow(verified, "nid long, docs long, texts long, top long"), name)


def large_units(texts: DataFrame, large: DataFrame, docs: DataFrame) -> DataFrame:
    """Units of the components of over BLOCK classes; large: (nid, root, __c), __c classes in all."""
    keys = materialize(texts.join(large, "nid").select("nid", "root", "__c", F.explode("bands").alias("unit")), "join-keys")
    buckets = keys.groupBy("unit").agg(F.min("nid").alias("first"), F.count("*").alias("__m"), F.min("root").alias("root"), F.min("__c").alias("__c")).where("__m > 1")
    buckets = materialize(buckets, "join-buckets")
    crowded = buckets.groupBy("root").agg(F.sum(F.col("__m").cast("double") * F.col("__m")).alias("__pairs"), F.min("__c").alias("__c")).where("__pairs >= cast(__c as double) * __c").select("root")
    crowded = materialize(crowded, "join-crowded")
    entire = large.join(crowded, "root").select(F.lit(WHOLE).alias("kind"), F.col("root").alias("unit"), "nid", F.col("root").alias("part"), F.lit(None).cast("array<bigint>").alias("keys"))
    units = block_pairs(blocks_of(entire, ["unit"]))
    sparse = materialize(large.join(crowded, "root", "left_anti"), "join-sparse")
    if not sparse.limit(1).count():
        return units
    return units.unionByName(sparse_units(texts, sparse, docs, keys.join(buckets.select("unit", "first"), "unit").join(crowded, "root", "left_anti").select("unit", "nid", "first")))


def sparse_units(texts: DataFrame, large: DataFrame, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Units of components whose buckets hold fewer pairs than they have; keys: (unit, nid, first of the unit)."""
    keys = materialize(keys, "join-sparse-keys")
    none = F.lit(None).cast("array<bigint>")
    # ties: the first against its bucket mates, a block of them at a time
    ties = keys.where("nid <> first").select("nid", F.col("first").alias("unit")).distinct()
    sizes = ties.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks"))
    mates = ties.join(sizes, "unit").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("__blocks")).cast("int") + 1)
    hubs = sizes.select("unit", F.explode(F.sequence(F.lit(1), "__blocks")).alias("bj"), F.col("unit").alias("nid"), F.lit(0).alias("block"))
    ties = mates.select("unit", F.col("block").alias("bj"), "nid", "block").unionByName(hubs).withColumns({"kind": F.lit(TIES), "bi": F.lit(0), "part": F.lit(0).cast("long"), "keys": none})
    held = components(checked(ties.select(*UNIT), texts, docs, "join-ties").select(F.col("nid").alias("a"), F.col("top").alias("b")))
    parts = large.join(held, F.col("nid") == F.col("node"), "left").select("nid", F.coalesce(held["root"], F.col("nid")).alias("part"))
    parts = materialize(parts, "join-parts")
    whole_parts = parts.join(parts.groupBy("part").agg(F.count("*").alias("__m")).where("__m > 1").select("part"), "part")
    units = block_pairs(blocks_of(whole_parts.select(F.lit(WHOLE).alias("kind"), F.col("part").alias("unit"), "nid", "part", none.alias("keys")), ["unit"]))
    # buckets that hold several parts
    spread = keys.select("unit", "nid").join(parts, "nid")
    mixed = spread.groupBy("unit").agg(F.min("part").alias("__a"), F.max("part").alias("__b")).where("__a < __b").select("unit")
    spread = materialize(spread.join(mixed, "unit"), "join-across")
    lists = spread.groupBy("nid").agg(F.sort_array(F.collect_list("unit")).alias("keys"))  # BANDS keys at most
    across = blocks_of(spread.join(lists, "nid").select(F.lit(ACROSS).alias("kind"), "unit", "nid", "part", "keys"), ["unit"])
    return units.unionByName(block_pairs(across))


def joined_classes(docs: DataFrame) -> DataFrame:
    """A row for each different text: ckey, rep (least doc_id), n (documents), class_id (name of its
    group), group_first (the group's least doc_id), group_texts,
    n_links (other documents at SIMILAR or more, copies too), n_text_links (other texts), first
    (whether it is the text that stays of its group)."""
    ship(docs.sparkSession)
    texts = classes(docs)
    tied = materialize(components(candidates(texts)).withColumnRenamed("node", "nid"), "join-tied")
    sizes = tied.groupBy("root").agg(F.count("*").alias("__c"))
    sized = materialize(tied.join(sizes, "root"), "join-sized")
    small = sized.where(F.col("__c") <= BLOCK).select(F.lit(WHOLE).alias("kind"), F.col("root").alias("unit"), F.lit(0).alias("bi"), F.lit(0).alias("bj"), "nid", F.lit(0).alias("block"), F.col("root").alias("part"), F.lit(None).cast("array<bigint>").alias("keys"))
    large = sized.where(F.col("__c") > BLOCK).select("nid", "root", "__c")
    units = small
    if large.limit(1).count():
        units = small.unionByName(large_units(texts, materialize(large, "join-large"), docs))
    found = checked(units, texts, docs, "join-checked")
    linked = found.groupBy("nid").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    top = components(found.select(F.col("nid").alias("a"), F.col("top").alias("b")))
    known = texts.drop("bands").join(linked, "nid", "left").join(top, F.col("nid") == F.col("node"), "left").drop("node")
    known = materialize(known.withColumn("root", F.coalesce("root", "nid")), "join-known")
    place = F.struct(F.col("rep").isNull(), "rep", "ckey")
    groups = known.groupBy("root").agg(F.min_by("ckey", place).alias("class_id"), F.min("rep").alias("group_first"), F.count("*").alias("group_texts"))
    links_of = F.coalesce("docs", F.lit(0)) + F.col("n") - 1
    out = known.join(groups, "root")
    return out.select("ckey", "rep", "n", "class_id", "group_first", "group_texts", links_of.cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"), (F.col("ckey") == F.col("class_id")).alias("first"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> a row for each document: doc_id, class_id (name of its group of near
    duplicates), group_first (the group's least doc_id), text_id (least doc_id of its very text),
    n_links, n_text_links, group_texts."""
    known = joined_classes(docs)
    rows = docs.select("doc_id", F.md5(whole(F.col("text"))).alias("ckey"))
    return rows.join(known, "ckey").select("doc_id", "class_id", "group_first", F.col("rep").alias("text_id"), "n_links", "n_text_links", "group_texts")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: of the group's first text the row with the least
    doc_id (null last), then the least of its other columns in their order. Only documents that have a copy or a link
    move; the others pass as they are."""
    known = joined_classes(docs).where("n > 1 or group_texts > 1")
    known = materialize(known.select(F.col("ckey").alias("__ckey"), F.col("rep").alias("__rep"), "first"), "join-touched")
    bits = bitmap(known, "__ckey")
    rows = docs.withColumn("__key", F.md5(whole(F.col("text"))))
    maybe = probable(rows, "__key", bits).join(known.select("__ckey", "__rep", F.col("first").alias("__first")), F.col("__key") == F.col("__ckey"), "left")
    alone = maybe.where("__ckey is null").select(*docs.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    stay = maybe.where(F.col("__first") & F.col("doc_id").eqNullSafe(F.col("__rep"))).groupBy("__key").agg(F.min(row).alias("__row")).select("__row.*")
    return probable(rows, "__key", bits, among=False).select(*docs.columns).unionByName(alone).unionByName(stay)


def query(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


#: All pairs of texts by their shared shingles, components by a recursive table. For small tables.
SQL = rf"""
with recursive t as (select md5(coalesce(text, '')) ckey, min(doc_id) rep, count(*) n, lower(any_value(coalesce(text, ''))) low from documents group by 1),
w as (select ckey, regexp_extract_all(low, '[^\x20\x09-\x0D]+') w from t),
h as (select distinct ckey, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) g from (select ckey, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) i from w where len(w) > 0)),
z as (select ckey, count(*) z from h group by 1),
p as (select a.ckey a, b.ckey b, count(*) c from h a join h b on a.g = b.g and a.ckey <> b.ckey group by all),
l as materialized (select a, b from p join z x on x.ckey = a join z y on y.ckey = b where c >= {SIMILAR} * (x.z + y.z - c) - 1e-9),
r(a, b) as (select ckey, ckey from t union select r.a, l.b from r join l on r.b = l.a),
g as (select a ckey, arg_min(t.ckey, (rep is null, coalesce(rep, 0), t.ckey)) class_id, min(rep) group_first, count(*) group_texts from r join t on r.b = t.ckey group by a),
k as (select a ckey, sum(t.n) docs, count(*) texts from l join t on l.b = t.ckey group by a)
select doc_id, class_id, group_first, rep text_id, cast(coalesce(docs, 0) + n - 1 as bigint) n_links, coalesce(texts, 0) n_text_links, group_texts
from documents join t on md5(coalesce(text, '')) = t.ckey join g on g.ckey = t.ckey left join k on k.ckey = t.ckey
"""
