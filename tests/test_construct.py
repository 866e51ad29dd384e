"""Map construction on small hand-made inputs."""

from factweave.operators import construct as K
from factweave.sources.sinks import unified_diff


def rows(df, *order):
    return sorted(tuple(r[c] for c in order) for r in df.collect())


def test_inheritance_takes_the_nearest_owner_and_ends_on_cycles(spark):
    bases = spark.createDataFrame([("D", "B"), ("D", "C"), ("B", "A"), ("C", "A"), ("X", "Y"), ("Y", "X")], "cls string, base string")
    members = spark.createDataFrame([("A", "run"), ("B", "run"), ("A", "stop"), ("C", "only"), ("Y", "spin"), ("Y", "spin")], "cls string, name string")
    got = rows(K.inherited_members(members, bases, 3), "cls", "name", "owner", "distance")
    assert [r for r in got if r[0] == "D"] == [("D", "only", "C", 1), ("D", "run", "B", 1), ("D", "stop", "A", 2)]
    assert [r for r in got if r[0] in "XY"] == [("X", "spin", "Y", 1), ("Y", "spin", "Y", 0)]


def test_inheritance_without_levels_or_rows(spark):
    bases = spark.createDataFrame([("D", "B")], "cls string, base string")
    members = spark.createDataFrame([("B", "run")], "cls string, name string")
    assert rows(K.inherited_members(members, bases, 0), "cls", "name") == [("B", "run")]
    assert rows(K.inherited_members(members.limit(0), bases), "cls") == []


def test_routes_belong_to_the_innermost_case(spark):
    cases = spark.createDataFrame([("t", "outer", 0, 1000), ("t", "inner", 300, 400)], "path string, name string, start long, end long")
    calls = spark.createDataFrame([("t", 10, "f"), ("t", 350, "f"), ("t", 360, "f"), ("t", 370, "g"), ("t", 2000, "f"), ("t", 20, "none")], "path string, pos long, callee string")
    definitions = spark.createDataFrame([("f", "a"), ("g", "a"), ("g", "b"), ("f", "a")], "name string, target string")
    got = rows(K.static_routes(calls, cases, definitions), "selector", "target", "calls", "provenance")
    assert got == [("inner", "a", 3, "static"), ("inner", "b", 1, "candidate"), ("outer", "a", 1, "static")]


def test_references_to_own_names_are_no_edges(spark):
    uses = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "z")], "source string, name string")
    definitions = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "c"), ("z", "a"), ("z", "d")], "name string, target string")
    got = rows(K.reference_edges(uses, definitions), "source", "target", "names", "state")
    assert got == [("b", "a", ["x", "y"], "current"), ("b", "c", ["y"], "unknown"), ("c", "a", ["z"], "unknown"), ("c", "d", ["z"], "unknown")]


def test_focus_takes_every_kind(spark):
    domain = spark.createDataFrame([("file", "src/a.c"), ("file", "src/b/c.c"), ("component", "core"), ("package", "core")], "kind string, key string")
    got = rows(K.focus(domain, ("core", "src/b")), "kind", "key", "word")
    assert got == [("component", "core", "core"), ("file", "src/b/c.c", "src/b"), ("package", "core", "core")]


def test_unified_diff_of_changed_new_and_equal_files(spark):
    texts = spark.createDataFrame([("x", "1\n2\n3\n", "1\n4\n3\n"), ("new", None, "1\n"), ("same", "1\n", "1\n")], "path string, before string, after string")
    got = dict(rows(unified_diff(texts, 1), "path", "diff"))
    assert got["x"].split("\n") == ["--- a/x", "+++ b/x", "@@ -1,3 +1,3 @@", " 1", "-2", "+4", " 3"]
    assert got["new"].startswith("--- /dev/null\n+++ b/new") and got["same"] == ""
