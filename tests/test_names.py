"""Java names resolved over a table of symbols."""

from tracewright.operators import code, graph, names

FILES = {
    "a/Order.java": "package a; public class Order { public void pay() { } public static class Line { private Order order; } private Line line; }",
    "b/Order.java": "package b; public class Order { public void ship() { } }",
    "b/Near.java": "package b; import java.util.List; class Near { private List<Order> orders; private Missing gone; }",
    "c/Single.java": "package c; import a.Order; import b.*; class Single { private Order order; private Near near; void go() { order.pay(); order.ship(); near.nothing(); } }",
    "c/Star.java": "package c; import b.*; class Star { private Order order; void go() { order.ship(); } }",
    "c/Full.java": "package c; import b.Order; class Full implements Port<a.Order> { private a.Order first; private Order second; private a.Order.Line third; void go() { Tool.help(); } }",
    "c/Port.java": "package c; interface Port<T> { }",
    "c/Tool.java": "package c; class Tool { static void help() { } }",
    "d/Both.java": "package d; import a.*; import b.*; class Both { private Order order; }",
    "Bare.java": "class Bare { private Bare self; }",
}


def classes(spark, files=FILES):
    return code.parsed(spark.createDataFrame([*files.items()], "path string, value string")).cache()


def test_nested_types_have_the_names_around_them(spark):
    found = {r["fqn"] for r in classes(spark).select("fqn").collect()}
    assert {"a.Order", "a.Order.Line", "b.Order", "Bare"} <= found


def test_fields_lead_to_classes_and_not_to_equal_names(spark):
    got = {(r["src"], r["field"], r["dst"]) for r in names.injections(classes(spark)).collect()}
    assert got == {
        ("a.Order", "line", "a.Order.Line"), ("a.Order.Line", "order", "a.Order"), ("b.Near", "orders", "b.Order"), ("c.Single", "order", "a.Order"), ("c.Single", "near", "b.Near"),
        ("c.Star", "order", "b.Order"), ("c.Full", "first", "a.Order"), ("c.Full", "second", "b.Order"), ("c.Full", "third", "a.Order.Line"), ("d.Both", "order", "a.Order"), ("Bare", "self", "Bare"),
    }


def test_ambiguous_and_unknown_names(spark):
    c = classes(spark)
    got = {(r["fqn"], r["name"]): (r["to"], r["ambiguous"]) for r in names.resolved(names.fields(c), c).collect()}
    assert got["d.Both", "Order"] == ("a.Order", True)
    assert got["b.Near", "Missing"] == (None, False) == got["b.Near", "List"]
    assert not got["c.Single", "Order"][1]


def test_calls_and_implementations(spark):
    c = classes(spark)
    got = {tuple(r) for r in names.calls(c).collect()}
    assert got == {("c.Single", "go", "a.Order", "pay"), ("c.Star", "go", "b.Order", "ship"), ("c.Full", "go", "c.Tool", "help")}
    assert [tuple(r) for r in names.implementations(c).collect()] == [("c.Full", "c.Port")]


def test_repeated_and_empty_sources(spark):
    twice = classes(spark)
    twice = twice.union(twice)
    assert names.injections(twice).count() == 11
    none = classes(spark).limit(0)
    assert names.injections(none).count() == names.calls(none).count() == 0


def test_graph_injects_resolved_types(spark):
    from pyspark.sql import functions as F

    c = classes(spark).withColumn("service_name", F.lit("shop"))
    n = spark.createDataFrame([("svc:shop", "Service", "shop")], "id string, label string, name string")
    _, edges = graph.build_graph(n, spark.createDataFrame([], "src string, dst string, type string"), c)
    got = {(r["src"], r["dst"]) for r in edges.where("relation = 'INJECTS'").collect()}
    assert ("class:c.Star", "class:b.Order") in got and ("class:c.Star", "class:a.Order") not in got
