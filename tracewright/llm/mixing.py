"""Mixing sources to target weights.

Documents get a hash-random key of doc_id and text; (source, key) is range-sorted over the cluster; sums of each range
partition, added up in order, tell which partition holds a source's cut; only its rows are added up
one by one. A source whose budget exceeds its size is repeated whole, then cut at the rest.

Defined results: a null or wordless text has size 0 and gives nothing; sources go by code point, null
last, as sources of their own; rows that agree in source, doc_id and text are interchangeable: of those
at the cut, as many as the budget holds are taken, one of them in part; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, n_words, partitions, table

#: Weights by the place of the source in code point order, repeating; most passes over one source.
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """(__source, source_size) -> + target: shares by weight of all sizes, none above MOST_PASSES
    times its source. A row for each source, so the windows over all rows hold few.

    The level at which shares stop is found at once: by rising cap for each weight, a source is
    capped if the share left to it and those after it exceeds its cap."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("__n") % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("__n", F.row_number().over(Window.orderBy("__source")) - 1).withColumn("__w", weight.cast("double")).withColumn("__cap", (F.col("source_size") * MOST_PASSES).cast("double"))
    rising = Window.orderBy(F.col("__cap") / F.col("__w"), "__n")
    before = F.coalesce(F.sum("__cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("__w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    rows = rows.withColumn("__all", F.sum(F.col("source_size").cast("double")).over(everything)).withColumn("__free", (F.col("__all") - before) * F.col("__w") <= F.col("__cap") * after)
    capped = F.coalesce(F.sum(F.when(~F.col("__free"), F.col("__cap"))).over(everything), F.lit(0.0))
    free = F.sum(F.when(F.col("__free"), F.col("__w"))).over(everything)
    rows = rows.withColumn("__left", F.col("__all") - capped).withColumn("__weights", free)
    target = F.when(F.col("__free"), F.col("__w") * F.col("__left") / F.col("__weights")).otherwise(F.col("__cap"))
    return rows.select("__source", "source_size", target.alias("target"))


def keyed(docs: DataFrame) -> DataFrame:
    """+ __source (sorts by code point, null last), __key (hash-random), __size."""
    return docs.withColumns({
        "__source": F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b")),
        "__key": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit(""))))),
        "__size": n_words(F.col("text")),
    })


def cuts(docs: DataFrame) -> DataFrame:
    """A row for each source: source_size, target, whole passes, and the key and size at which the
    last pass ends, with the words that the documents just there still give and their number (__ties)."""
    narrow = materialize(keyed(docs.select("doc_id", "source", "text")).select("__source", "__key", "__size"), "mix-sizes")
    ranged = narrow.repartitionByRange(partitions(docs.sparkSession), "__source", "__key").withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "mix-ranged")
    parts = ranged.groupBy("__source", "__part").agg(F.sum("__size").alias("__sum"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = source_targets(parts.groupBy("__source").agg(F.sum("__sum").alias("source_size"))).withColumn("__passes", passes).withColumn("__rest", budget - F.col("__passes") * F.col("source_size"))
    targets = materialize(targets, "mix-targets")
    running = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    holds = parts.withColumn("__start", F.coalesce(F.sum("__sum").over(running), F.lit(0))).join(targets.select("__source", "__rest"), "__source")
    holds = holds.where("__rest > 0 and __start < __rest and __rest <= __start + __sum").select("__source", "__part", "__start", "__rest")
    ties = ranged.join(holds, ["__source", "__part"]).groupBy("__source", "__key", "__size", "__start", "__rest").agg(F.count("*").alias("__ties"))
    inner = Window.partitionBy("__source").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("__before", F.col("__start") + F.coalesce(F.sum(F.col("__size") * F.col("__ties")).over(inner), F.lit(0)))
    at = ties.where("__before < __rest and __rest <= __before + __size * __ties")
    at = at.select("__source", F.col("__key").alias("__cut_key"), F.col("__size").alias("__cut_size"), (F.col("__rest") - F.col("__before")).alias("__give"), "__ties")
    return materialize(targets.join(at, "__source", "left"), "mix-cuts")


def numbered(rows: DataFrame) -> DataFrame:
    """rows + __nth, each one's number among those of its __source, from 0; rows are written, and numbered
    by the counts of their parts, so that no task gets them all."""
    rows = materialize(rows.withColumn("__id", F.monotonically_increasing_id()), "mix-ties")
    part = F.shiftright("__id", 33)
    first = rows.groupBy("__source", part.alias("__of")).agg(F.count("*").alias("__c"), F.min("__id").alias("__first"))
    # a part may hold several sources: its rows of one are numbered by a window over that part alone
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("__source").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select(F.col("__source").alias("__s"), F.col("__of").alias("__p"), before.alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__source", part).orderBy("__id")) - 1
    out = rows.withColumn("__in", inside).join(first, (F.col("__source") == F.col("__s")) & (part == F.col("__p")))
    return out.withColumn("__nth", F.col("__start") + F.col("__in")).drop("__id", "__in", "__s", "__p", "__start")


def mix(docs: DataFrame) -> DataFrame:
    """docs + size, source_size, target, taken (words that the mix takes of the document) and the
    helpers __passes and __last (whole passes; words of the last, partial one)."""
    before = (F.col("__key") < F.col("__cut_key")) | ((F.col("__key") == F.col("__cut_key")) & (F.col("__size") < F.col("__cut_size")))
    at = F.coalesce((F.col("__key") == F.col("__cut_key")) & (F.col("__size") == F.col("__cut_size")), F.lit(False))
    last = F.when(at, F.least(F.col("__size"), F.greatest(F.lit(0), F.col("__give") - F.col("__nth") * F.col("__size")))).when(before, F.col("__size")).otherwise(F.lit(0)).cast("long")
    plan = cuts(docs)
    clash = [c for c in ("size", "source_size", "target", "taken") if c in docs.columns]
    out = keyed(docs.drop(*clash)).join(plan, "__source")
    if (plan.agg(F.max("__ties")).first()[0] or 1) > 1:  # rows alike to be told apart
        out = out.where(~at).withColumn("__nth", F.lit(0).cast("long")).unionByName(numbered(out.where(at)))
    else:
        out = out.withColumn("__nth", F.lit(0).cast("long"))
    out = out.withColumn("__last", last)
    return out.withColumn("taken", F.col("__size") * F.col("__passes") + F.col("__last")).withColumnRenamed("__size", "size").drop("__source", "__key", "__cut_key", "__cut_size", "__give", "__rest", "__ties", "__nth")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a document once for each whole pass, and its text up to
    the end of the last word taken once more where the last pass ends in it; n_chars follows the text."""
    mine = docs.columns
    out = mix(docs.withColumns({f"__own_{c}": F.col(c) for c in mine if c in ("size", "source_size", "target", "taken")}))
    copies = F.col("__passes") + F.when(F.col("__last") > 0, 1).otherwise(0)
    out = out.where(F.col("taken") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    part = F.when((F.col("__copy") > F.col("__passes")) & (F.col("__last") < F.col("size")), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("__last").cast("int")), ""))
    out = out.withColumn("__text", F.coalesce(part, F.col("text")))
    named = {c: F.col(f"__own_{c}" if f"__own_{c}" in out.columns else c) for c in mine} | {"text": F.col("__text")}
    if "n_chars" in mine:
        named["n_chars"] = F.length("__text").cast("long")
    return out.select(*(named[c].alias(c) for c in mine))


def query(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (select doc_id, coalesce('a' || source, 'b') s, md5(coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) k,
                  cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size from documents),
z as (select s, cast(sum(size) as bigint) source_size from d group by s),
w as (select *, cast((row_number() over (order by s) - 1) % 3 + 1 as double) w, cast(source_size * 3 as double) cap, row_number() over (order by s) n from z),
l as (select *, (select sum(cast(source_size as double)) from z) allw,
             coalesce(sum(cap) over (order by cap / w, n rows between unbounded preceding and 1 preceding), 0) bef,
             sum(w) over (order by cap / w, n rows between current row and unbounded following) aft from w),
f as (select *, (allw - bef) * w <= cap * aft free from l),
t as (select s, source_size, case when free then w * (allw - (select coalesce(sum(cap), 0) from f where not free)) / (select sum(w) from f where free) else cap end target from f),
b as (select *, cast(floor(target + 0.5) as bigint) budget from t),
p as (select *, case when source_size > 0 then budget // source_size else 0 end passes from b),
r as (select d.*, p.source_size, p.target, p.passes, p.budget - p.passes * p.source_size rest,
             coalesce(sum(size) over (partition by d.s order by k, size rows between unbounded preceding and 1 preceding), 0) bef from d join p on d.s = p.s)
select doc_id, size, source_size, target, cast(size * passes + greatest(0, least(size, rest - bef)) as bigint) taken from r
"""
