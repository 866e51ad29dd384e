"""Semantics that SQL over the bound tables doesn't show."""

import json
import re
import xml.dom.minidom

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.functions import text as X
from factweave.operators import constraints as C
from factweave.operators import construct as K
from factweave.operators import delta as D
from factweave.operators import merge as M
from factweave.operators import predicates as A
from factweave.operators import resolve as V
from factweave.operators import traverse as T
from factweave.sources import readers as I
from factweave.sources import sinks as O
from factweave.streaming import changes


def hit(regex, text):
    return re.fullmatch(regex.replace(r"\z", r"\Z"), text) is not None


@pytest.mark.parametrize(
    ("pattern", "text", "expected"),
    [("a*c", "a/b/c", True), ("a?c", "aéc", True), ("[!a-c]x", "dx", True), ("[!a-c]x", "bx", False), ("[]a]", "]", True), ("[ab", "[ab", True), ("a.c", "abc", False), ("[^x]", "y", True)],
)
def test_glob(pattern, text, expected):
    assert hit(P.glob_regex(pattern), text) is expected


@pytest.mark.parametrize(("pattern", "text", "expected"), [("a/**/b", "a/b", True), ("a/**", "a", True), ("a/**", "a/x/y", True), ("a/**", "ab", False)])
def test_path_glob(pattern, text, expected):
    assert any(hit(r, text) for r in P.path_regexes(pattern)) is expected


@pytest.mark.parametrize(("pattern", "text", "expected"), [("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("a/**/c", "a/b/d/c", True), ("**/c", "c", True)])
def test_collection(pattern, text, expected):
    assert hit(P.collection_regex(pattern), text) is expected


@given(st.text(alphabet="ab/.+[(", max_size=12))
def test_glob_of_literal_text_matches_itself(text):
    if not P.WILD & set(text):
        assert hit(P.glob_regex(text), text)


def test_query_terms():
    assert X.query_terms("The red AND blue, red") == ["red", "blue"]
    assert X.query_terms("of the") == ["of", "the"]
    assert X.query_terms("  ") == []


def test_match_strength(spark):
    df = spark.createDataFrame([("FooBar",), ("foobarbaz",), ("config",), ("confgi",), (None,), ("",)], "f string")
    got = {r.f: (r.a, r.b) for r in df.select("f", X.match_strength(F.col("f"), "bar").alias("a"), X.match_strength(F.col("f"), "config").alias("b")).collect()}
    assert got["FooBar"][0] == 100 and got["foobarbaz"][0] == 48 and got["config"][1] == 120
    assert got[None] == (0, 0) and got[""] == (0, 0)


def edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, state string, resolution string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_a_worse_short_route_reaches_further(spark):
    e = edges(spark, [("s", "x", "unknown", "unique"), ("s", "a", "current", "unique"), ("a", "b", "current", "unique"), ("b", "x", "current", "unique"), ("x", "t", "current", "unique")])
    got = {r.node: (r.unknown, r.distance) for r in T.routes(nodes(spark, "s"), e, 3).collect()}
    assert got["x"] == (0, 3) and got["t"] == (1, 2)


def test_proven_paths_come_first(spark):
    e = edges(spark, [("a", "b", "unknown", "unique"), ("a", "c", "current", "unique"), ("c", "d", "current", "unique"), ("d", "b", "current", "unique")])
    assert [(r.nodes, r.proven) for r in T.shortest_paths(nodes(spark, "a"), nodes(spark, "b"), e).collect()] == [(["a", "c", "d", "b"], True)]
    only = edges(spark, [("a", "b", "unknown", "unique")])
    found = T.shortest_paths(nodes(spark, "a"), nodes(spark, "b"), only)
    assert [(r.nodes, r.proven) for r in found.collect()] == [(["a", "b"], False)]
    assert tuple(T.path_outcome(found, nodes(spark, "a"), nodes(spark, "b"), True, False).first()) == ("unknown", "candidate-witnesses")
    none = T.shortest_paths(nodes(spark, "b"), nodes(spark, "a"), only)
    assert tuple(T.path_outcome(none, nodes(spark, "b"), nodes(spark, "a"), True, False).first()) == ("absent", "exhaustive")
    assert T.path_outcome(none, nodes(spark, "b"), nodes(spark, "a").where("false"), True, False).first()[1] == "endpoint-unresolved"


def test_ties_are_all_enumerated_and_capped(spark):
    e = edges(spark, [("a", m, "current", "unique") for m in "wxyz"] + [(m, "b", "current", "unique") for m in "wxyz"])
    assert T.shortest_paths(nodes(spark, "a"), nodes(spark, "b"), e).count() == 4
    assert [r.nodes[1] for r in T.shortest_paths(nodes(spark, "a"), nodes(spark, "b"), e, most=2).collect()] == ["w", "x"]


def test_cycles(spark):
    e = edges(spark, [("b", "c", "current", "unique"), ("c", "a", "current", "unique"), ("a", "b", "current", "unique"), ("c", "x", "current", "unique"), ("q", "q", "current", "unique")])
    core = T.cycle_core(e)
    assert core.count() == 4
    assert T.cycle_witnesses(core) == [["a", "b", "c"], ["q"]]
    assert T.cycle_core(e.where("source = 'b'")).count() == 0


def test_observations(spark):
    nan, zero = float("nan"), -0.0
    e = spark.createDataFrame([("1", "r", nan), ("2", "r", 0.0), ("3", "r", 1.0), ("4", "r", 1.0)], ["case", "route", "value"])
    a = spark.createDataFrame([("1", "r", nan, True), ("2", "r", zero, True), ("3", "r", 2.0, False)], ["case", "route", "value", "applicable"])
    assert {(r.comparison, r.key) for r in A.observations_equal(a, e).collect()} == {("missing", "4/r")}
    strict = A.observations_equal(a, e, nan_equal=False, signed_zero_equal=False)
    assert {(r.comparison, r.key) for r in strict.collect()} == {("missing", "4/r"), ("different", "1/r"), ("different", "2/r")}
    one = spark.createDataFrame([(1.0, 1.0000000000000002), (0.0, -0.0)], "a double, b double")
    assert [r.d for r in one.select(A.ulp_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1.0, 0.0]


def test_two_waivers_for_one_finding_are_an_error(spark):
    found = spark.createDataFrame([("extra", "k", "current")], "comparison string, key string, state string")
    w = spark.createDataFrame([("extra", "k", "2030-01-01")] * 2, "comparison string, key string, expires string")
    with pytest.raises(Exception, match="ambiguous-waiver"):
        C.apply_waivers(found, w, "2026-01-01").collect()
    assert not C.apply_waivers(found, w.limit(1), "2031-01-01").first()["waived"]


def test_freshness_ladder(spark):
    df = spark.createDataFrame([(True, "same", "same", "changed", "same"), (True, "changed", "same", "same", "same"), (True, "same", "unknown", "same", "same"), (False, "same", "same", "same", "same"), (True, "same", "same", "same", "same")], "p boolean, s string, c string, r string, d string")
    got = [x.v for x in df.select(D.freshness_status(*[F.col(c) for c in "pscrd"]).alias("v")).collect()]
    assert got == ["context-drift", "stale", "unknown", "not-applicable", "current"]


def test_reports(spark):
    found = spark.createDataFrame([("c1", "extra", "a|b", "current"), ("c1", "missing", "<x>", "unknown")], "check string, comparison string, key string, state string")
    assert {r["level"] for r in json.loads(O.sarif(found))["runs"][0]["results"]} == {"error", "warning"}
    statuses = spark.createDataFrame([("c1", "fail"), ("c<2", "unknown"), ("c3", "pass")], "check string, status string")
    xml.dom.minidom.parseString(O.junit(statuses))
    n = spark.createDataFrame([("a", "file"), ("b&", "file")], "node string, kind string")
    r = spark.createDataFrame([("a", "b&", "imports")], "source string, target string, family string")
    xml.dom.minidom.parseString(O.graphml(n, r))
    assert "n0 -->|imports| n1" in O.mermaid(n, r)
    small = O.markdown(found, "t", budget=160)
    assert "more rows" in small and len(small) <= 160


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.py").write_text("class A:\n    def f(self):\n        pass\n")
    (tmp_path / "x.log").write_text("log")
    files = I.repository(spark, str(tmp_path), ["*.log"])
    assert {(r.path, r.ignored) for r in files.collect()} == {("a/m.py", False), ("x.log", True)}
    texts = spark.createDataFrame([("m.py", "class A:\n    def f(self):\n        pass\n"), ("bad.py", "def ("), ("n.py", None)], "path string, text string")
    got = {(r.path, r.name, r.kind) for r in I.python_symbols(texts).collect()}
    assert {("m.py", "A", "class"), ("m.py", "A.f", "function"), ("bad.py", "SyntaxError", "error")} == got
    manifest = spark.createDataFrame([("package.json", '{"name":"p","version":"1","dependencies":{"a":"^1"},"devDependencies":{"b":"2"}}'), ("e", "{}")], "path string, text string")
    assert {(r.scope, r.dependency) for r in I.package_json(manifest).collect()} == {("runtime", "a"), ("dev", "b"), (None, None)}
    report = spark.createDataFrame([('{"files":{"m.py":{"executed_lines":[3],"contexts":{"3":["t1"]}}}}',)], "text string")
    spans = spark.createDataFrame([("m.py", "A", 1, 4), ("m.py", "A.f", 2, 4)], "path string, name string, start long, end long")
    assert [tuple(r) for r in I.observed_tests(I.coverage_py(report), spans).collect()] == [("t1", "m.py", "A.f")]
    bundle = {"mode": 0, "subject": {"project": "p"}, "producer": {"name": "x"}, "capabilities": [{"domain": "d", "coverage": "odd"}], "facts": [{"id": "1", "domain": "d"}]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    rows = I.bundles(spark, str(tmp_path / "b.json"))
    assert I.facts_of(rows).count() == 1 and I.valid_bundles(rows).count() == 0


def test_stream_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = changes.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    run.processAllAvailable()
    run.stop()
    expected = {tuple(r)[1:] for r in changes.event_windows(events).collect()}
    assert {tuple(r)[1:] for r in spark.table("windows").collect()} == expected


def test_refreshed_facts(spark, tmp_path):
    spark.createDataFrame([("a.py", "def f(): pass")], "path string, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    run = changes.refresh_facts(source, I.python_symbols, str(tmp_path / "out"), str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    assert [r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["f"]


def test_completeness_is_not_claimed_for_partial_operands(spark):
    from factweave.plans.evidence import Projection

    items = spark.createDataFrame([("a", "current"), ("b", "current")], "key string, state string")
    more = spark.range(5)

    def kind(**options):
        return Projection(items, "set", more, **options).completeness().first()

    assert kind().classification == "complete" and (kind().universe, kind().selected, kind().excluded) == (5, 2, 3)
    assert kind(truncated=True).classification == kind(unsupported=spark.range(1)).classification == "incomplete" and kind(known=False).classification == "unknown"
    stale = Projection(items.unionByName(spark.createDataFrame([("c", "stale")], "key string, state string")), "set").completeness().first()
    assert (stale.selected, stale.evaluated, stale.unknown, stale.classification) == (3, 2, 1, "incomplete")
    found = spark.createDataFrame([("missing", "x", "current")], "comparison string, key string, state string")
    assert [(r.key, r.state) for r in A.guard(found, Projection(items, "set", truncated=True).completeness()).collect()] == [("*", "unknown")]


def test_cycles_are_named_and_bridges_between_them_are_not(spark):
    rows = [("b", "c"), ("c", "a"), ("a", "b"), ("c", "x"), ("x", "y"), ("y", "x"), ("in", "a"), ("y", "out"), ("s", "s")]
    edges = spark.createDataFrame(rows, "source string, target string")
    got = {(r.comparison, r.key, r.state) for r in A.acyclic(edges).collect()}
    assert got == {("different", k, "current") for k in ("a -> b -> c -> a", "x -> y -> x", "s -> s")}
    assert A.acyclic(edges.where("source < target")).count() == 0
    assert [(r.key, r.state) for r in A.acyclic(edges, most_edges=2).collect()] == [("*", "unknown")]


def test_freshness_by_presence(spark):
    schema = "key string, value string"
    old = spark.createDataFrame([("a", None), ("b", "1"), ("c", None), ("d", "1")], schema)
    new = spark.createDataFrame([("a", None), ("b", None), ("d", "1"), ("e", None)], schema)
    r = D.freshness(old, new).first()
    assert (r.added, r.missing, r.changed, r.unchanged, r.status) == (1, 1, 1, 2, "stale")


@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(1, 60000)), min_size=1, max_size=12), st.lists(st.integers(0, 60000), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_enclosing_against_brute_force(spark, spans, points):
    rows = [("p", s, s + n, f"n{i:02}") for i, (s, n) in enumerate(spans)]
    table = spark.createDataFrame(rows, "path string, start long, end long, name string")
    asked = spark.createDataFrame([("p", x) for x in points] + [("q", 1)], "path string, pos long")
    got = {(r.path, r.pos): r.name for r in D.enclosing(asked, table).collect()}
    want = {("p", x): min(((e - s, n) for _, s, e, n in rows if s <= x < e), default=(0, None))[1] for x in points} | {("q", 1): None}
    assert got == want


def test_one_file_wide_span_is_at_most_two_rows(spark):
    spans = spark.createDataFrame([("p", 0, 1 << 30, "whole")], "path string, start long, end long, name string")
    plan = D.enclosing(spark.createDataFrame([("p", 77)], "path string, pos long"), spans)
    assert plan.first().name == "whole"


def test_inheritance_deeper_than_the_limit_is_marked(spark):
    bases = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(6)] + [("x", "y"), ("y", "x")], "cls string, base string")
    members = spark.createDataFrame([("c6", "m"), ("x", "n")], "cls string, name string")
    whole = {(r.cls, r.name, r.distance): r.complete for r in K.inherited_members(members, bases).collect()}
    assert whole == {(f"c{i}", "m", 6 - i): True for i in range(7)} | {("x", "n", 0): True, ("y", "n", 1): True}
    cut = {r.cls: r.complete for r in K.inherited_members(members, bases, 3).collect()}
    assert cut == {"c3": True, "c4": True, "c5": True, "c6": True, "x": True, "y": True}


def test_merge_conflicts_name_what_differs_and_fail_a_strict_merge(spark):
    schema = "domain string, grp string, provider string, mode int, claim string, value string, extent string"
    rows = [("d", "g1", "a", 0, "semantic-x", "v", "1-2"), ("d", "g1", "b", 1, "other", "v", "1-3"), ("d", "g2", "a", 0, "other", "v", None), ("d", "g2", "b", 1, "other", "v", "9"), ("d", "g3", "a", 0, "other", "v", "1"), ("d", "g3", "b", 0, "other", "v", "1")]
    facts = spark.createDataFrame(rows, schema)
    domains = spark.createDataFrame([("d", False)], "domain string, complete boolean")
    assert {(r.grp, r.code, r.differs) for r in M.conflicts(facts, ("value", "extent")).collect()} == {("g1", "augment-mismatch", "extent"), ("g3", "duplicate-primary-occurrence", "")}
    with pytest.raises(M.MergeConflict, match="2 conflicts; first augment-mismatch in d at g1"):
        M.strict_merge(facts, domains, ("value", "extent"))
    assert M.strict_merge(facts.where("grp = 'g2'"), domains).count() == 1
    lent = {r.grp: (r.extent, r.enriched) for r in M.enriched(facts, ("extent",)).collect()}
    assert lent["g2"] == ("9", "extent") and lent["g1"] == ("1-2", "")


def test_baselines_are_not_overwritten(spark, tmp_path):
    found = spark.createDataFrame([("missing", "a")], "comparison string, key string")
    O.freeze_baseline(found, f"{tmp_path}/one")
    before = spark.read.parquet(f"{tmp_path}/one")
    O.freeze_baseline(found.where("false"), f"{tmp_path}/two", before)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/two").collect()] == [("missing", "a", "resolved")]
    with pytest.raises(Exception, match="(?i)exists"):
        O.freeze_baseline(found, f"{tmp_path}/one")


def test_repository_paths_are_relative_whatever_the_folder(spark, tmp_path):
    root = tmp_path / "it's" / "src"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("x")
    (root / "b.c").write_text("yy")
    got = {r.path: r.bytes for r in I.repository(spark, str(root), []).collect()}
    assert got == {"src/a.py": 1, "b.c": 2}


def test_an_optional_part_that_cannot_be_imported_leaves_the_others(monkeypatch):
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def broken(name, *a):
        if name in ("factweave.llm.queries", "corpus_pipeline"):
            raise ImportError("no library")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", broken)
    assert "pipeline" not in e.queries() and len(e.queries()) == len(e.oracle_sql()) >= 140


def test_call_resolutions(spark):
    calls = [
        ("a", "py", "f", False, None, None), ("a", "py", "f", False, None, None), ("a", "py", "g", False, None, None), ("a", "py", "own", False, None, None), ("a", "py", "hidden", False, None, None),
        ("a", "py", "print", False, None, None), ("a", "py", "len", False, None, None), ("a", "py", "np.sum", False, None, None), ("a", "py", "imp", False, "imported", None), ("a", "py", "f2", False, "local", None),
        ("a", "py", "told", False, None, "z"), ("a", "py", "m", True, None, None), ("a", "py", "meth", False, None, None), ("a", "py", "odd", False, "builtin", None),
    ]
    defs = [("b", "py", "f", "function", "public"), ("b", "py", "g", "function", "public"), ("c", "py", "g", "class", "public"), ("a", "py", "own", "function", "local"), ("b", "py", "hidden", "function", "local"),
            ("b", "py", "len", "function", "public"), ("b", "py", "imp", "function", "public"), ("b", "py", "f2", "function", "public"), ("b", "py", "meth", "method", "public"), ("b", "c", "print", "function", "public")]
    got = V.call_resolutions(
        spark.createDataFrame(calls, "source string, family string, name string, method boolean, binding string, target string"),
        spark.createDataFrame(defs, "path string, family string, name string, kind string, scope string"), {"py": ("print", "len")}, {"np": "numpy"},
    )
    want = {
        "f": ("candidate", 2, 1, None), "g": ("ambiguous", 1, 2, None), "own": ("unique", 1, 1, "a"), "hidden": ("unresolved", 1, 0, None), "print": ("builtin", 1, 0, None), "len": ("unresolved", 1, 1, None),
        "np.sum": ("external", 1, 0, "numpy"), "imp": ("candidate", 1, 1, None), "f2": ("unresolved", 1, 1, None), "told": ("unique", 1, 1, "z"), "m": ("method", 1, 0, None), "meth": ("unresolved", 1, 0, None), "odd": ("builtin", 1, 0, None),
    }
    assert {r.name: (r.kind, r.occurrences, r.candidates, r.target) for r in got.collect()} == want


def test_normal_paths_and_imports(spark):
    paths = ["a/./b//c", "a/../b", "../x", "a/b/../../..", ""]
    rows = spark.createDataFrame(list(enumerate(paths)), "i int, p string")
    assert {r.i: r.n for r in rows.select("i", V.normal_path(F.col("p")).alias("n")).collect()} == {0: "a/b/c", 1: "b", 2: None, 3: None, 4: ""}
    imports = spark.createDataFrame([("a/x.py", "./y"), ("a/x.py", "../lib/z"), ("a/x.py", "y"), ("a/x.py", "q"), ("a/x.py", "../../up")], "source string, module string")
    files = spark.createDataFrame([("a/y.py",), ("lib/z/__init__.py",), ("inc/q.py",), ("y.py",)], "path string")
    got = {r.module: (r.target, r.how) for r in V.import_files(imports, files, ("inc", "")).collect()}
    assert got == {"./y": ("a/y.py", "relative"), "../lib/z": ("lib/z/__init__.py", "relative"), "y": ("a/y.py", "beside"), "q": ("inc/q.py", "root:inc"), "../../up": (None, None)}


def test_scoped_seeds_enter_by_their_relations(spark):
    edges = spark.createDataFrame([("s", "far", "current"), ("r", "next", "current"), ("w", "other", "current")], "source string, target string, state string")
    seeds = spark.createDataFrame([("s", True), ("w", False)], "node string, scoped boolean")
    relations = spark.createDataFrame([("s", "r")], "source string, target string")
    got = {r.node: (r.distance, r.scoped) for r in V.scoped_routes(seeds, relations, edges, 2, "downstream").collect()}
    assert got == {"s": (0, True), "r": (1, False), "next": (2, False), "w": (0, False), "other": (1, False)}


@pytest.mark.parametrize(
    ("path", "expected"),
    [("a/b.o", True), ("keep.o", False), ("deep/keep.o", False), ("out/x", True), ("out/keep.o", True), ("lib/out/x", True), ("sub/t", True), ("t", False), ("sub/in/t", False), ("sub/u", False), ("x/#y", False), ("sp ace", True)],
)
def test_layered_ignore(spark, path, expected):
    """A folder that is ruled out can't give files back; anchored rules hold in their own folder."""
    sources = [("", ["*.o", "!keep.o", "out/", "sp ace  ", "#y"]), ("sub", ["/t", "u/"])]
    assert spark.range(1).select(P.layered_ignore(F.lit(path), sources).alias("x")).first().x is expected


def test_comment_signs_in_strings_are_no_comments(spark):
    text = 'import a  # def no(): pass\nx = "# def no2():"\ndef yes():\n    """# def no3():"""\n    go(1) if (2) else obj.run("a(b")\n'
    rows = spark.createDataFrame([("p.py", text), ("q.c", '#include "x.h"\nint main(void) {\n  puts("// f(1)"); /* g(2) */ return 0;\n}\n')], "path string, text string")
    from factweave.sources import lexical as L

    assert {(r.path, r.domain, r.name) for r in L.facts(rows).collect()} == {("p.py", "import", "a"), ("p.py", "declaration", "yes"), ("q.c", "import", "x.h"), ("q.c", "declaration", "main")}
    found = {(r.path, r.domain, r["name"]): (r.start, r.end) for r in L.occurrences(rows).collect()}
    assert {k[2] for k in found if k[:2] == ("p.py", "call")} == {"go", "obj.run"} and {k[2] for k in found if k[:2] == ("q.c", "call")} == {"main", "puts"}
    texts = {r.path: r.text for r in rows.collect()}
    assert all(texts[p][s:e] == name for (p, _, name), (s, e) in found.items())


def test_waivers_end_when_their_inputs_change(spark):
    found = spark.createDataFrame([("missing", "a", "current", "d1", "error"), ("missing", "b", "current", "d2", "error"), ("missing", "c", "current", "d3", "note")], "comparison string, key string, state string, inputs string, severity string")
    waivers = spark.createDataFrame([("missing", "a", None, "d1"), ("missing", "b", None, "old"), ("missing", "c", "2020-01-01", None)], "comparison string, key string, expires string, inputs string")
    done = C.apply_waivers(found, waivers, "2026-01-01")
    assert {r.key: r.waived for r in done.collect()} == {"a": True, "b": False, "c": False}
    assert [r.key for r in C.blocking(done, with_baseline=False).collect()] == ["b"]
