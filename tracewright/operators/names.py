"""Names in Java sources, resolved to types by joins against a table of symbols.

A simple name means, in this order: a type nested in the class or in one around it, a type that the file imports by name, one
of its own package, one of a package that it imports whole, a fully qualified name. Each meaning is a candidate symbol, all
candidates meet the symbols in one equi-join, and the first meaning that exists counts. So two classes of one simple name in
two packages are told apart, and names from outside the sources resolve to nothing.

Input: the rows of code.parsed (fqn, package, imports, fields, methods, interfaces). Defined results: null package or name as
empty; null arrays as empty; a name that two packages imported whole both hold is ambiguous and takes the lesser; repeated
classes count once; an empty table gives empty tables; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names in a type as it is written: `Map<String, a.b.Order>` holds three.
NAME = r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*"
#: A call on a name: `orders.find(`.
CALL = r"(?<![\w$.)])([A-Za-z_$][\w$]*)\s*\.\s*([A-Za-z_$][\w$]*)\s*\("


def names_of(written: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(written, F.lit("")), F.lit(f"({NAME})"), 1))


def dotted(*parts: Column) -> Column:
    return F.concat_ws(".", *(F.nullif(p, F.lit("")) for p in parts))


def symbols(classes: DataFrame) -> DataFrame:
    """Every type's name, once."""
    return classes.where("fqn is not null").select("fqn").distinct()


def resolved(uses: DataFrame, classes: DataFrame) -> DataFrame:
    """uses(fqn: of the class where it stands, name) -> fqn, name, to (null: none of the sources), ambiguous."""
    uses = uses.select("fqn", "name").where("fqn is not null and name <> ''").distinct()
    empty = F.array().cast("array<string>")
    scopes = classes.where("fqn is not null").groupBy("fqn").agg(F.max(F.coalesce("package", F.lit(""))).alias("package"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("imports", empty)))).alias("imports"))
    at = uses.join(scopes, "fqn", "left").withColumns({"package": F.coalesce("package", F.lit("")), "imports": F.coalesce("imports", empty)})
    at = at.withColumns({"first": F.substring_index("name", ".", 1), "tail": F.expr("substring(name, length(substring_index(name, '.', 1)) + 1)")})
    # the class and those around it, innermost first: what stands between the package and the name, cut at each point
    inner = F.split(F.expr("if(package = '', fqn, substring(fqn, length(package) + 2))"), r"\.")
    around = F.transform(F.sequence(F.size(inner), F.lit(1), F.lit(-1)), lambda n: dotted(F.col("package"), F.concat_ws(".", F.slice(inner, F.lit(1), n))))
    nested = F.transform(around, lambda c, i: F.struct(i.cast("int").alias("order"), F.concat(c, F.lit("."), F.col("name")).alias("to")))
    itself = F.transform(F.filter(around, lambda c: F.element_at(F.split(c, r"\."), -1) == F.col("first")), lambda c: F.struct(F.lit(1000).alias("order"), F.concat(c, F.col("tail")).alias("to")))
    single = F.transform(F.filter("imports", lambda i: F.element_at(F.split(i, r"\."), -1) == F.col("first")), lambda i: F.struct(F.lit(1001).alias("order"), F.concat(i, F.col("tail")).alias("to")))
    own = F.array(F.struct(F.lit(1002).alias("order"), dotted(F.col("package"), F.col("name")).alias("to")))
    stars = F.transform(F.filter("imports", lambda i: i.endswith(".*")), lambda i: F.struct(F.lit(1003).alias("order"), F.concat(F.regexp_replace(i, r"\*$", ""), F.col("name")).alias("to")))
    full = F.array(F.struct(F.lit(1004).alias("order"), F.col("name").alias("to")))
    meant = at.select("fqn", "name", F.explode(F.concat(nested, itself, single, own, stars, full)).alias("c")).select("fqn", "name", "c.order", "c.to").distinct()
    known = symbols(classes).withColumnRenamed("fqn", "to")
    hits = meant.join(known, "to").groupBy("fqn", "name", "order").agg(F.min("to").alias("to"), F.count("*").alias("n"))
    best = hits.groupBy("fqn", "name").agg(F.min_by(F.struct("to", (F.col("n") > 1).alias("ambiguous")), "order").alias("b"))
    return uses.join(best, ["fqn", "name"], "left").select("fqn", "name", F.col("b.to").alias("to"), F.coalesce("b.ambiguous", F.lit(False)).alias("ambiguous"))


def fields(classes: DataFrame) -> DataFrame:
    """(fqn, field, name): each name in each field's type."""
    each = classes.select("fqn", F.explode("fields").alias("f"))
    return each.select("fqn", F.col("f.name").alias("field"), F.explode(names_of(F.col("f.type"))).alias("name")).distinct()


def injections(classes: DataFrame) -> DataFrame:
    """(src, dst, field): a class has a field whose type names another."""
    used = fields(classes)
    return used.join(resolved(used, classes).where("to is not null"), ["fqn", "name"]).select(F.col("fqn").alias("src"), F.col("to").alias("dst"), "field").distinct()


def implementations(classes: DataFrame) -> DataFrame:
    """(src, dst): a class implements an interface of the sources. Type arguments don't count."""
    outer = lambda t: F.regexp_extract(t, f"({NAME})", 1)
    used = classes.select("fqn", F.explode("interfaces").alias("i")).select("fqn", outer(F.col("i")).alias("name"))
    return resolved(used, classes).where("to is not null").select(F.col("fqn").alias("src"), F.col("to").alias("dst"))


def calls(classes: DataFrame) -> DataFrame:
    """(src, method, dst, called): calls on a field, or on a type by its name (static), of methods that the type has
    itself. A field hides a type of its name. The outermost name of a field's type is the one that is called."""
    bodies = classes.select("fqn", F.explode("methods").alias("m")).select("fqn", F.col("m.name").alias("method"), F.col("m.body").alias("body"))
    both = F.arrays_zip(F.regexp_extract_all("body", F.lit(CALL), 1).alias("on"), F.regexp_extract_all("body", F.lit(CALL), 2).alias("called"))
    made = bodies.select("fqn", "method", F.explode(F.array_distinct(both)).alias("c")).select("fqn", "method", "c.on", "c.called").distinct()
    typed = classes.select("fqn", F.explode("fields").alias("f")).select("fqn", F.col("f.name").alias("on"), F.regexp_extract("f.type", f"({NAME})", 1).alias("type")).distinct()
    made = made.join(typed, ["fqn", "on"], "left").withColumn("name", F.coalesce("type", "on"))
    to = resolved(made, classes).where("to is not null").select("fqn", "name", "to")
    has = classes.select(F.col("fqn").alias("to"), F.explode("methods").alias("m")).select("to", F.col("m.name").alias("called")).distinct()
    return made.join(to, ["fqn", "name"]).join(has, ["to", "called"]).select(F.col("fqn").alias("src"), "method", F.col("to").alias("dst"), "called").distinct()
