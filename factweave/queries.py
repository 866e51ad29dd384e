"""One query per operator over the bound tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.functions import text as X
from factweave.operators import constraints as C
from factweave.operators import delta as D
from factweave.operators import graph as G
from factweave.operators import merge as M
from factweave.operators import predicates as A
from factweave.operators import projections as S
from factweave.operators import retrieval as R
from factweave.operators import traverse as T
from factweave.plans.evidence import Projection, finding_id, status_fold
from factweave.sources import sinks as O
from factweave.sources.bindings import Bound, with_bindings

_QUERIES: dict[str, Callable[[Bound], DataFrame]] = {}
_SQL: dict[str, str] = {}

EDGES = "SELECT source, target, kind, max(CASE state WHEN 'current' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) AS r FROM {mentions} GROUP BY source, target, kind"
STATE = "CASE r WHEN 2 THEN 'current' WHEN 1 THEN 'unknown' ELSE 'stale' END"
CALLS = """SELECT source, name, relation, count(DISTINCT target) AS n,
  CASE WHEN count(DISTINCT target) = 1 THEN 'unique' WHEN count(DISTINCT target) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution FROM {calls} GROUP BY source, name, relation"""
CE = f"""e AS ({EDGES}),
 ce AS (SELECT a.component AS source, e.kind, coalesce(b.component, CASE WHEN e.r < 2 THEN e.target END) AS target, max(e.r) AS r
   FROM e JOIN {{component_files}} a ON a.path = e.source LEFT JOIN {{component_files}} b ON b.path = e.target GROUP BY 1, 2, 3)"""
CEDGES = f"{CE}, cedges AS (SELECT source, kind, target, {STATE} AS state FROM ce WHERE target IS NOT NULL AND source <> target)"
FEDGES = f"e AS ({EDGES}), fedges AS (SELECT source, kind, target, {STATE} AS state FROM e)"
SURFACE = """sf AS (SELECT name AS key, CASE WHEN bool_or(declared) THEN 'declared' ELSE 'undeclared' END AS declaration,
  CASE count(DISTINCT candidate) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, bool_or(used) AS used,
  count(DISTINCT provider) AS providers FROM {surface} GROUP BY name)"""


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Bound], DataFrame]):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = with_bindings(sql)
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, fn=fn: fn(Bound(spark, sf_dir))) for n, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- projections -----------------------------------------------------------------------------
query("component_edges", f"WITH {CEDGES} SELECT * FROM cedges")(lambda m: S.component_edges(m))
query("file_edges", f"WITH {FEDGES} SELECT source, kind, target, state FROM fedges WHERE kind = 'R' AND source LIKE 'n/NATION\\_1%' ESCAPE '\\'")(lambda m: S.file_edges(m, kinds=("R",), from_paths=("n/NATION_1*",)))
query("file_edges_named", f"WITH e AS ({EDGES}), x AS (SELECT DISTINCT source, target, kind FROM {{mentions}} WHERE name LIKE 'Brand#1_') SELECT e.source, e.kind, e.target, {STATE} AS state FROM e JOIN x ON e.source = x.source AND e.target = x.target AND e.kind = x.kind")(lambda m: S.file_edges(m, name_patterns=("Brand#1?",)))
query("artifact_routes", "SELECT DISTINCT artifact AS source, role AS kind, path AS target, 'current' AS state FROM {artifacts}")(S.artifact_routes)
query("build_routes", "SELECT build AS source, 'path' AS kind, path AS target, 'current' AS state FROM {builds}")(S.build_routes)
query("component_membership", """SELECT f.path AS key, coalesce(c.n, 0) AS value, CASE WHEN c.n IS NULL THEN 'unassigned' WHEN c.n = 1 THEN 'exclusive' ELSE 'overlap' END AS membership,
  language, layer, bytes, symbol_count, 'current' AS state FROM {files} f LEFT JOIN (SELECT path, count(DISTINCT component) AS n FROM {component_files} GROUP BY path) c ON c.path = f.path""")(S.component_membership)
query("components", "SELECT DISTINCT component AS key, 'current' AS state FROM {component_files}")(S.components)
query("constant_memberships", """SELECT name AS key, CASE WHEN count(*) > 1 THEN 'unknown' ELSE 'current' END AS state FROM
  (SELECT DISTINCT name, path, value FROM {constants} WHERE container = 'Brand#7' AND kind <> 'class-collection') GROUP BY name""")(lambda m: S.constant_memberships(m, "Brand#7"))
query("constant_values", """SELECT name AS key, min(CASE WHEN static THEN value END) AS value, CASE WHEN count(*) > 1 OR min(CASE WHEN static THEN 1 ELSE 0 END) = 0 THEN 'unknown' ELSE 'current' END AS state
  FROM {constants} WHERE container = 'Brand#3' AND kind IN ('PROMO', 'SMALL') GROUP BY name""")(lambda m: S.constant_values(m, "Brand#3", kinds=("PROMO", "SMALL")))
query("file_metrics", "SELECT substr(path, 3) AS key, bytes AS value, 'current' AS state FROM {files} WHERE substr(path, 3) NOT LIKE '%_2'")(lambda m: S.file_metrics(m, strip_prefix="n/", exclude=("*[0-9_]2",)))
query("inventory_paths", "SELECT path AS key, 'current' AS state FROM {inventory} WHERE path LIKE '%/fr/%'")(lambda m: S.inventory_paths(m, include=("*/fr/*",)))
query("mapped_paths", "SELECT path AS key, 'current' AS state FROM {files} WHERE path = 'n/NATION_3' OR path LIKE 'n/NATION_1_'")(lambda m: S.mapped_paths(m, ("n/NATION_3", "n/NATION_1?")))
query("macro_members", """SELECT DISTINCT m.text AS key, 'current' AS state FROM {macros} m JOIN (SELECT DISTINCT path, invocation FROM {macros} WHERE arg = 0 AND text = 'u7') s
  ON m.path = s.path AND m.invocation = s.invocation WHERE m.arg >= 1 AND m.call = 'EMIT'""")(lambda m: S.macro_members(m, "EMIT", "u7"))
query("package_entrypoints", "SELECT DISTINCT package AS source, route AS kind, target, 'current' AS state FROM {entrypoints} WHERE route = 'main'")(lambda m: S.package_entrypoints(m, routes=("main",)))
query("package_exports", "SELECT DISTINCT package AS source, 'export' AS kind, origin AS target, 'current' AS state FROM {exports} WHERE name LIKE '%widget'")(lambda m: S.package_exports(m, name_patterns=("*widget",)))
query("provider_surface", f"WITH {SURFACE} SELECT *, 'current' AS state FROM sf")(S.provider_surface)
query("search_domain", """SELECT DISTINCT kind, key, 'current' AS state FROM (SELECT 'file' AS kind, path AS key FROM {files} UNION ALL SELECT 'symbol', name FROM {symbols}
  UNION ALL SELECT 'component', component FROM {component_files} UNION ALL SELECT 'package', package FROM {entrypoints} UNION ALL SELECT 'artifact', artifact FROM {artifacts})""")(S.search_domain)
query("symbol_entities", """SELECT concat(path, '#', name) AS key, count(*) AS definitions, min(line) AS line, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, 'current' AS state
  FROM {symbols} WHERE scope = 'public' GROUP BY path, name""")(lambda m: S.symbol_entities(m, public_only=True))
query("symbols", "SELECT substr(name, 5) AS key, count(DISTINCT path) AS value, 'current' AS state FROM {symbols} WHERE name LIKE 'red %' GROUP BY 1")(lambda m: S.symbols(m, name_patterns=("red *",), strip_prefix="red "))
query("symbol_relations", f"""WITH c AS ({CALLS}) SELECT c.source, c.relation AS kind, t.target, c.name, c.resolution, CASE c.resolution WHEN 'unique' THEN 'current' ELSE 'unknown' END AS state
  FROM c JOIN {{calls}} t ON t.source = c.source AND t.name = c.name AND t.relation = c.relation WHERE c.relation = 'calls'""")(lambda m: S.symbol_relations(m, kinds=("calls",)))
query("symbol_occurrences", f"""WITH RECURSIVE c AS ({CALLS}), k AS (SELECT t.source, t.target, c.resolution FROM c JOIN {{calls}} t ON t.source = c.source AND t.name = c.name AND t.relation = c.relation WHERE t.name = 'red bolt' AND t.target IS NOT NULL),
 d AS (SELECT DISTINCT path AS node FROM {{symbols}} WHERE name = 'red bolt' AND path < 'Brand#2'
   UNION SELECT CASE WHEN k.source = d.node THEN k.target ELSE k.source END FROM d JOIN k ON k.resolution = 'unique' AND (k.source = d.node OR k.target = d.node)),
 v AS (SELECT node FROM d UNION SELECT a.source FROM v JOIN {{arcs}} a ON a.target = v.node AND a.kind = 'import'),
 x AS (SELECT node AS path, 0 AS r, 'current' AS state FROM d UNION ALL SELECT node, 2, 'current' FROM v
   UNION ALL SELECT k.source, 4, CASE k.resolution WHEN 'unique' THEN 'current' ELSE 'unknown' END FROM k JOIN d ON d.node = k.target),
 b AS (SELECT path, r, state, row_number() OVER (PARTITION BY path ORDER BY r, state) AS i FROM x)
 SELECT path, CASE r WHEN 0 THEN 'declaration' WHEN 2 THEN 'import' ELSE 'reference' END AS role, state FROM b WHERE i = 1""")(lambda m: S.symbol_occurrences(m, "red bolt", ("Brand#1*",)))
query("test_routes", """SELECT DISTINCT concat(grp, ':', path, '::', selector) AS source, CASE WHEN configured THEN 'configured' ELSE 'static' END AS kind, target, 'current' AS state FROM {tests} WHERE grp = 'click'""")(lambda m: S.test_routes(m, group="click"))
query("test_selectors", "SELECT DISTINCT concat(path, '::', selector) AS key, 'current' AS state FROM {tests} WHERE grp = 'view'")(lambda m: S.test_selectors(m, group="view"))
query("literal_operand", "SELECT * FROM (VALUES ('a', 1, 'current'), ('b', 2, 'current')) t(key, value, state)")(lambda m: S.literal(m.spark, {"b": 2, "a": 1}))
query("completeness", """WITH s AS (SELECT count(*) AS n FROM {files} WHERE path LIKE 'n/NATION_1_'), u AS (SELECT count(*) AS n FROM {files})
  SELECT u.n AS universe, s.n AS selected, s.n AS evaluated, u.n - s.n AS excluded, 0 AS unsupported, 0 AS unknown, false AS truncated, 'complete' AS classification FROM s CROSS JOIN u""")(lambda m: Projection(S.mapped_paths(m, ("n/NATION_1?",)), "set", m["files"]).completeness())
query("completeness_partial", f"""WITH {FEDGES}, x AS (SELECT count(*) AS n FROM {{files}} WHERE language = 'r') SELECT count(*) AS universe, count(*) AS selected, count(*) FILTER (WHERE state = 'current') AS evaluated, 0 AS excluded,
  (SELECT n FROM x) AS unsupported, count(*) FILTER (WHERE state <> 'current') AS unknown, true AS truncated, 'incomplete' AS classification FROM fedges""")(
    lambda m: Projection(S.file_edges(m), "relation", unsupported=m["files"].where("language = 'r'"), truncated=True).completeness()
)

# --- predicates ------------------------------------------------------------------------------
KEYS_A = "a AS (SELECT DISTINCT name AS key FROM {symbols} WHERE line < 3), b AS (SELECT DISTINCT name AS key FROM {symbols} WHERE kind = 'PROMO' AND line > 30)"
MISSING, EXTRA = "SELECT 'missing' AS comparison, key, 'current' AS state FROM b WHERE key NOT IN (SELECT key FROM a)", "SELECT 'extra' AS comparison, key, 'current' AS state FROM a WHERE key NOT IN (SELECT key FROM b)"


def _sets(m: Bound) -> tuple[DataFrame, DataFrame]:
    def keys(condition: str) -> DataFrame:
        return m["symbols"].where(condition).select(F.col("name").alias("key")).distinct().withColumn("state", F.lit("current"))

    return keys("line < 3"), keys("kind = 'PROMO' and line > 30")


VALUES = """a AS (SELECT name AS key, max(line) AS value, CASE WHEN count(*) % 2 = 0 THEN 'current' ELSE 'unknown' END AS state FROM {symbols} WHERE kind = 'LARGE' GROUP BY name),
  b AS (SELECT name AS key, max(line) AS value FROM {symbols} WHERE kind <> 'SMALL' AND name < 't' GROUP BY name)"""
DIFFERENT = """SELECT 'different' AS comparison, a.key, CASE a.state WHEN 'current' THEN 'current' ELSE 'unknown' END AS state FROM a JOIN b ON a.key = b.key WHERE a.state <> 'current' OR a.value IS DISTINCT FROM b.value"""


def _values(m: Bound) -> tuple[DataFrame, DataFrame]:
    odd = F.when(F.count("*") % 2 == 0, "current").otherwise("unknown")
    a = m["symbols"].where("kind = 'LARGE'").groupBy(F.col("name").alias("key")).agg(F.max("line").alias("value"), odd.alias("state"))
    return a, m["symbols"].where("kind <> 'SMALL' and name < 't'").groupBy(F.col("name").alias("key")).agg(F.max("line").alias("value"))


query("assert_set_equal", f"WITH {KEYS_A} {MISSING} UNION ALL {EXTRA}")(lambda m: A.set_equal(*_sets(m)))
query("assert_subset", f"WITH {KEYS_A} {EXTRA}")(lambda m: A.subset(*_sets(m)))
query("assert_required_subset", f"WITH {KEYS_A} {MISSING}")(lambda m: A.required_subset(*_sets(m)))
query("assert_disjoint", f"WITH {KEYS_A} SELECT 'overlap' AS comparison, key, 'current' AS state FROM a WHERE key IN (SELECT key FROM b)")(lambda m: A.disjoint(*_sets(m)))
query("assert_mapped_set_equal", f"""WITH {KEYS_A.replace('a AS (', 'o AS (', 1)}, p AS (SELECT CASE key WHEN 'red bolt' THEN 'old bolt' WHEN 'hot gear' THEN 'warm gear' ELSE key END AS key FROM o), a AS (SELECT DISTINCT key FROM p)
  {MISSING} UNION ALL {EXTRA} UNION ALL SELECT 'collision', key, 'unknown' FROM p GROUP BY key HAVING count(*) > 1""")(lambda m: A.mapped_set_equal(*_sets(m), {"red bolt": "old bolt", "hot gear": "warm gear"}))
query("assert_values_equal", f"WITH {VALUES} {MISSING} UNION ALL {EXTRA} UNION ALL {DIFFERENT}")(lambda m: A.values_equal(*_values(m)))
query("assert_required_values", f"WITH {VALUES} {MISSING} UNION ALL {DIFFERENT}")(lambda m: A.required_values(*_values(m)))
query("assert_mapped_values_equal", f"""WITH {VALUES.replace('a AS (', 'o AS (', 1)}, p AS (SELECT CASE key WHEN 'red bolt' THEN 'old bolt' ELSE key END AS key, value, state FROM o),
  a AS (SELECT key, min(value) AS value, CASE WHEN count(*) > 1 THEN 'unknown' ELSE min(state) END AS state FROM p GROUP BY key)
  {MISSING} UNION ALL {EXTRA} UNION ALL {DIFFERENT} UNION ALL SELECT 'collision', key, 'unknown' FROM p GROUP BY key HAVING count(*) > 1""")(lambda m: A.mapped_values_equal(*_values(m), {"red bolt": "old bolt"}))
query("assert_provider_surface", f"""WITH {SURFACE} SELECT CASE WHEN declaration <> 'declared' AND used THEN 'unregistered' WHEN resolution = 'unresolved' THEN 'unresolved' WHEN resolution = 'ambiguous' THEN 'ambiguous' ELSE 'missing' END AS comparison, key, 'current' AS state
  FROM sf WHERE (declaration <> 'declared' AND used) OR resolution IN ('unresolved', 'ambiguous') OR providers < 6
  UNION ALL SELECT 'missing', w.key, 'current' FROM (VALUES ('red bolt'), ('no such')) w(key) WHERE w.key NOT IN (SELECT key FROM sf WHERE declaration = 'declared')""")(
    lambda m: A.provider_surface(S.provider_surface(m), ("red bolt", "no such"), True, True, True, 6)
)
KEY = "concat(source, '|', kind, '|', target)"
query("assert_required_edges", f"""WITH {CEDGES}, p(s, k, t, key) AS (VALUES ('ASIA', '%', 'E%', 'ASIA|*|E*'), ('%', 'Z', '%', '*|Z|*'), ('odd', 'A', 'even', 'odd|A|even'))
  SELECT 'missing' AS comparison, key, 'current' AS state FROM p WHERE NOT EXISTS (SELECT 1 FROM cedges c WHERE c.source LIKE p.s AND c.kind LIKE p.k AND c.target LIKE p.t)""")(lambda m: A.required_edges(S.component_edges(m), [("ASIA", "*", "E*"), ("*", "Z", "*"), ("odd", "A", "even")]))
query("assert_forbidden_edges", f"WITH {CEDGES} SELECT 'forbidden' AS comparison, {KEY} AS key, state FROM cedges WHERE (source LIKE 'A%' AND kind = 'R' AND target LIKE 'n/%') OR (source = 'odd' AND target = 'even')")(
    lambda m: A.forbidden_edges(S.component_edges(m), [("A*", "R", "n/*"), ("odd", "*", "even")])
)
query("assert_allowed_edges", f"WITH {CEDGES} SELECT 'extra' AS comparison, {KEY} AS key, state FROM cedges WHERE NOT (source LIKE 'A%' OR target = 'even')")(lambda m: A.allowed_edges(S.component_edges(m), [("A*", "*", "*"), ("*", "*", "even")]))
LOOPS = """e AS (SELECT DISTINCT source, target FROM {{arcs}} WHERE kind = 'import'),
  w AS (SELECT source AS start, target AS node, source AS trail FROM e WHERE target >= source UNION ALL
        SELECT w.start, e.target, concat(w.trail, ' -> ', e.source) FROM w JOIN e ON e.source = w.node WHERE w.node <> w.start AND e.target >= w.start AND NOT contains(concat(w.trail, ' -> '), concat(e.source, ' -> ')))"""
query("assert_acyclic", f"WITH RECURSIVE {LOOPS} SELECT 'different' AS comparison, concat(trail, ' -> ', start) AS key, 'current' AS state FROM w WHERE node = start".replace("{{", "{").replace("}}", "}"))(
    lambda m: A.acyclic(m["arcs"].where("kind = 'import'"))
)  # each file has one import here, so a cycle is walked once, from its smallest name
query("assert_cardinality", "SELECT 'cardinality' AS comparison, CAST(count(DISTINCT name) AS VARCHAR) AS key, 'current' AS state FROM {symbols} HAVING count(DISTINCT name) > 10")(lambda m: A.cardinality(S.symbols(m), most=10))
query("assert_numeric_bounds", "SELECT 'bounds' AS comparison, path AS key, 'current' AS state FROM {files} WHERE bytes > 200 OR bytes < 110")(lambda m: A.numeric_bounds(S.file_metrics(m), least=110, most=200))
query("assert_min_test_routes", """SELECT 'cardinality' AS comparison, CAST(count(DISTINCT target) AS VARCHAR) AS key, 'current' AS state FROM {tests} HAVING count(DISTINCT target) < 40
  UNION ALL SELECT 'missing', w.key, 'current' FROM (VALUES ('n/NATION_3'), ('n/NONE')) w(key) WHERE w.key NOT IN (SELECT target FROM {tests})""")(lambda m: A.min_test_routes(S.test_routes(m), 40, ("n/NATION_3", "n/NONE")))
OBS = "o AS (SELECT l_returnflag AS c, l_linestatus AS route, avg(l_extendedprice) AS e, avg(l_extendedprice) * (1 + CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1e-6 ELSE 0.01 END) AS a FROM {lineitem} GROUP BY 1, 2)"


def _observations(m: Bound) -> tuple[DataFrame, DataFrame]:
    base = m["lineitem"].groupBy(F.col("l_returnflag").alias("case"), F.col("l_linestatus").alias("route")).agg(F.avg("l_extendedprice").alias("value"))
    shift = F.when(F.col("case") == "A", 0.0).when(F.col("case") == "N", 1e-6).otherwise(0.01)
    return base.withColumn("value", F.col("value") * (1 + shift)).withColumn("applicable", F.lit(True)), base


query("assert_observations_equal", f"WITH {OBS} SELECT 'different' AS comparison, concat(c, '/', route) AS key, 'current' AS state FROM o WHERE abs(a - e) > 1e-4 * greatest(abs(a), abs(e))")(lambda m: A.observations_equal(*_observations(m), rtol=1e-4))
query("operand_guard", f"""WITH {KEYS_A}, {FEDGES}, bad AS (SELECT count(*) AS n FROM fedges WHERE state <> 'current'), x AS ({MISSING} UNION ALL {EXTRA})
  SELECT x.* FROM x CROSS JOIN bad WHERE n = 0 UNION ALL SELECT 'different', '*', 'unknown' FROM bad WHERE n > 0""")(lambda m: A.guard(A.set_equal(*_sets(m)), Projection(S.file_edges(m), "relation").completeness()))

# --- typed constraints and policy ------------------------------------------------------------
TYPED: list[tuple[str, dict, str]] = [
    ("component_membership", {}, "SELECT 'bounds' AS comparison, path AS key, 'current' AS state FROM {files} WHERE path NOT IN (SELECT path FROM {component_files})"),
    ("max_file_bytes", {"most": 240}, "SELECT 'bounds' AS comparison, path AS key, 'current' AS state FROM {files} WHERE bytes > 240"),
    ("required_paths", {"paths": ("n/NATION_3", "n/NONE")}, "SELECT 'missing' AS comparison, key, 'current' AS state FROM (VALUES ('n/NATION_3'), ('n/NONE')) w(key) WHERE key NOT IN (SELECT path FROM {files})"),
    ("forbidden_paths", {"include": ("*/de/*",)}, "SELECT 'cardinality' AS comparison, CAST(count(*) AS VARCHAR) AS key, 'current' AS state FROM {inventory} WHERE path LIKE '%/de/%' HAVING count(*) <> 0"),
    ("required_symbols", {"names": ("red bolt", "nope")}, "SELECT 'missing' AS comparison, key, 'current' AS state FROM (VALUES ('red bolt'), ('nope')) w(key) WHERE key NOT IN (SELECT name FROM {symbols})"),
    ("forbidden_symbols", {"names": ("red bolt", "nope")}, "SELECT DISTINCT 'overlap' AS comparison, name AS key, 'current' AS state FROM {symbols} WHERE name IN ('red bolt', 'nope')"),
    ("symbol_cardinality", {"least": 1000}, "SELECT 'cardinality' AS comparison, CAST(count(DISTINCT name) AS VARCHAR) AS key, 'current' AS state FROM {symbols} HAVING count(DISTINCT name) < 1000"),
    ("test_routes", {"least": 26}, "SELECT 'cardinality' AS comparison, CAST(count(DISTINCT target) AS VARCHAR) AS key, 'current' AS state FROM {tests} HAVING count(DISTINCT target) < 26"),
    ("required_file_edge", {"kinds": ("Q",)}, "SELECT 'cardinality' AS comparison, CAST(count(*) AS VARCHAR) AS key, 'current' AS state FROM {mentions} WHERE kind = 'Q' HAVING count(*) < 1"),
    ("required_bridge", {"bridge": "abi"}, "SELECT 'cardinality' AS comparison, CAST(count(*) AS VARCHAR) AS key, 'current' AS state FROM {mentions} WHERE kind = 'bridge:abi' HAVING count(*) < 1"),
    ("required_package_entrypoint", {"routes": ("lib",)}, "SELECT 'cardinality' AS comparison, CAST(count(*) AS VARCHAR) AS key, 'current' AS state FROM {entrypoints} WHERE route = 'lib' HAVING count(*) < 1"),
    ("required_test_route", {"group": "none"}, "SELECT 'cardinality' AS comparison, CAST(count(*) AS VARCHAR) AS key, 'current' AS state FROM {tests} WHERE grp = 'none' HAVING count(*) < 1"),
    ("provider_surface", {"forbid_ambiguous": True}, f"WITH {SURFACE} SELECT 'ambiguous' AS comparison, key, 'current' AS state FROM sf WHERE resolution = 'ambiguous'"),
    ("allowed_component_edges", {"patterns": [("*", "*", "even")]}, f"WITH {CEDGES} SELECT 'extra' AS comparison, {KEY} AS key, state FROM cedges WHERE target <> 'even'"),
    ("forbidden_component_edges", {"patterns": [("even", "A", "*")]}, f"WITH {CEDGES} SELECT 'forbidden' AS comparison, {KEY} AS key, state FROM cedges WHERE source = 'even' AND kind = 'A'"),
    ("required_component_edges", {"patterns": [("even", "A", "x*")]}, f"WITH {CEDGES} SELECT 'missing' AS comparison, 'even|A|x*' AS key, 'current' AS state WHERE NOT EXISTS (SELECT 1 FROM cedges WHERE source = 'even' AND kind = 'A' AND target LIKE 'x%')"),
    ("allowed_file_edges", {"patterns": [("*", "[AN]", "*")]}, f"WITH {FEDGES} SELECT 'extra' AS comparison, {KEY} AS key, state FROM fedges WHERE kind = 'R'"),
    ("forbidden_file_edges", {"patterns": [("n/NATION_1", "*", "*")]}, f"WITH {FEDGES} SELECT 'forbidden' AS comparison, {KEY} AS key, state FROM fedges WHERE source = 'n/NATION_1'"),
    ("required_file_edges", {"patterns": [("n/NATION_1", "?", "n/NATION_77")]}, f"WITH {FEDGES} SELECT 'missing' AS comparison, 'n/NATION_1|?|n/NATION_77' AS key, 'current' AS state WHERE NOT EXISTS (SELECT 1 FROM fedges WHERE source = 'n/NATION_1' AND kind LIKE '_' AND target = 'n/NATION_77')"),
    ("component_cycles", {"kinds": ("R",), "from_paths": ("n/NATION_3", "n/NATION_6"), "to_paths": ("n/NATION_3", "n/NATION_6")}, f"""WITH e AS ({EDGES}), g AS (SELECT DISTINCT a.component AS source, b.component AS target FROM e JOIN {{component_files}} a ON a.path = e.source JOIN {{component_files}} b ON b.path = e.target
      WHERE kind = 'R' AND e.source IN ('n/NATION_3', 'n/NATION_6') AND e.target IN ('n/NATION_3', 'n/NATION_6') AND a.component <> b.component)
      SELECT 'different' AS comparison, concat(f.source, ' -> ', f.target, ' -> ', f.source) AS key, 'current' AS state FROM g f JOIN g r ON r.source = f.target AND r.target = f.source WHERE f.source < f.target"""),
]
for _kind, _options, _sql in TYPED:
    query(f"typed_{_kind}", _sql)(lambda m, k=_kind, o=_options: C.CONSTRAINTS[k](m, **o))

FOUND = f"WITH {CEDGES}, f AS (SELECT 'forbidden' AS comparison, {KEY} AS key, state FROM cedges WHERE source = 'odd')"


def _found(m: Bound) -> DataFrame:
    return A.forbidden_edges(S.component_edges(m), [("odd", "*", "*")])


def _waivers(m: Bound) -> DataFrame:
    rows = S.component_edges(m).where("source = 'odd' and kind in ('A', 'R')")
    return rows.select(F.lit("forbidden").alias("comparison"), A.edge_key().alias("key"), F.when(F.col("kind") == "A", "2030-01-01").otherwise("2020-01-01").alias("expires"))


def _waived(m: Bound) -> DataFrame:
    return C.apply_waivers(_found(m), _waivers(m), "2026-01-01")


def _ratcheted(m: Bound) -> DataFrame:
    found = _waived(m)
    return C.ratchet(found, found.where("key like 'odd|N|%'"), found.where("key like 'odd|R|E%'"))


BASELINE = "CASE WHEN key LIKE 'odd|R|E%' THEN 'reintroduced' WHEN key LIKE 'odd|N|%' THEN 'known' ELSE 'new' END"
query("waivers", f"{FOUND} SELECT comparison, key, state, key LIKE 'odd|A|%' AS waived FROM f")(_waived)
query("unused_waivers", f"{FOUND} SELECT 'forbidden' AS comparison, concat('even|', kind, '|', target) AS key, '2030-01-01' AS expires FROM cedges WHERE source = 'even'")(
    lambda m: C.unused_waivers(_found(m), S.component_edges(m).where("source in ('even', 'odd')").select(F.lit("forbidden").alias("comparison"), A.edge_key().alias("key"), F.lit("2030-01-01").alias("expires")))
)
query("baseline_ratchet", f"{FOUND} SELECT comparison, key, state, key LIKE 'odd|A|%' AS waived, {BASELINE} AS baseline FROM f")(_ratcheted)
query("blocking", f"{FOUND} SELECT comparison, key, state, false AS waived, {BASELINE} AS baseline FROM f WHERE key NOT LIKE 'odd|A|%' AND key NOT LIKE 'odd|N|%'")(lambda m: C.blocking(_ratcheted(m)))
query("coverage_regressions", "SELECT DISTINCT name AS key FROM {symbols} WHERE kind = 'PROMO' AND line > 30 AND name NOT IN (SELECT name FROM {symbols} WHERE line < 3)")(lambda m: C.coverage_regressions(*reversed(_sets(m))))
query("status_fold", f"""{FOUND}, g AS (SELECT split_part(key, '|', 2) AS chk, comparison, state, split_part(key, '|', 2) <> 'N' AS applicable, key LIKE 'odd|A|%' AS waived FROM f),
  t AS (SELECT chk, count(*) AS n, count(*) FILTER (WHERE applicable) AS ap, count(*) FILTER (WHERE applicable AND NOT waived) AS o, count(*) FILTER (WHERE applicable AND NOT waived AND state = 'current') AS bad FROM g GROUP BY chk)
  SELECT c.chk AS "check", CASE WHEN n IS NULL THEN 'pass' WHEN ap = 0 THEN 'not_applicable' WHEN o = 0 THEN 'waived' WHEN bad > 0 THEN 'fail' ELSE 'unknown' END AS status
  FROM (VALUES ('A'), ('N'), ('R'), ('Z')) c(chk) LEFT JOIN t ON t.chk = c.chk""")(
    lambda m: status_fold(m.spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "check string"), _waived(m).withColumn("check", F.split_part("key", F.lit("|"), F.lit(2))).withColumn("applicable", F.col("check") != "N"))
)
query("verification_summary", f"{FOUND} SELECT comparison, state, count(*) AS findings FROM f GROUP BY comparison, state")(lambda m: _found(m).groupBy("comparison", "state").agg(F.count("*").alias("findings")))
query("finding_identity", f"""{FOUND} SELECT comparison, key, sha256('{{"check":"c1","comparison":"' || comparison || '","key":"' || key || '"}}') AS id FROM f""")(lambda m: _found(m).select("comparison", "key", finding_id(F.lit("c1")).alias("id")))

# --- traversal, paths, retrieval -------------------------------------------------------------
ROUTE_COLUMNS = "stale, unknown, unresolved, ambiguous, candidate, distance"


def _route_sql(direction: str, depth: int) -> str:
    ends = {"downstream": [("source", "target")], "upstream": [("target", "source")], "both": [("source", "target"), ("target", "source")]}[direction]
    arcs = " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, state, resolution FROM {{arcs}}" for a, b in ends)
    hops = ", ".join(
        f"h{i} AS (SELECT node, {ROUTE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {ROUTE_COLUMNS}) AS rn FROM (SELECT x.b AS node, stale + CAST(x.state = 'stale' AS INT) AS stale, unknown + CAST(x.state = 'unknown' AS INT) AS unknown, unresolved + CAST(x.resolution = 'unresolved' AS INT) AS unresolved, ambiguous + CAST(x.resolution = 'ambiguous' AS INT) AS ambiguous, candidate + CAST(x.resolution = 'candidate' AS INT) AS candidate, {i} AS distance FROM h{i - 1} h JOIN x ON x.a = h.node) q) w WHERE rn = 1)"
        for i in range(1, depth + 1)
    )
    every = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(depth + 1))
    return f"""WITH x AS ({arcs}), h0 AS (SELECT 'p/5' AS node, 0 AS stale, 0 AS unknown, 0 AS unresolved, 0 AS ambiguous, 0 AS candidate, 0 AS distance UNION ALL SELECT 'p/77', 0, 0, 0, 0, 0, 0), {hops},
      best AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {ROUTE_COLUMNS}) AS rn FROM ({every}) u) SELECT node, {ROUTE_COLUMNS} FROM best WHERE rn = 1"""


def _seed(m: Bound, *nodes: str) -> DataFrame:
    return m.spark.createDataFrame([(n,) for n in nodes], "node string")


for _d in ("downstream", "upstream", "both"):
    query(f"route_traversal_{_d}", _route_sql(_d, 4))(lambda m, d=_d: T.routes(_seed(m, "p/5", "p/77"), m["arcs"], 4, d))
query("impact", _route_sql("upstream", 3))(lambda m: T.routes(_seed(m, "p/5", "p/77"), m["arcs"], 3, "upstream"))
query("closure", "WITH RECURSIVE r AS (SELECT 'p/9' AS node UNION SELECT a.target FROM r JOIN {arcs} a ON a.source = r.node AND a.kind = 'call') SELECT node FROM r")(
    lambda m: T.closure(_seed(m, "p/9"), m["arcs"].where("kind = 'call'").select(F.col("source").alias("a"), F.col("target").alias("b")))
)
query("reverse_test_routes", f"""WITH {FEDGES}, r AS (SELECT 'n/NATION_3' AS node, 0 AS d UNION ALL SELECT DISTINCT source, 1 FROM fedges WHERE target = 'n/NATION_3' AND source <> 'n/NATION_3'),
  b AS (SELECT t.grp, t.path, t.selector, t.target, r.d, CASE WHEN t.configured THEN 1 ELSE 2 END AS g, row_number() OVER (PARTITION BY t.grp, t.path, t.selector ORDER BY CASE WHEN t.configured THEN 1 ELSE 2 END, r.d, t.target) AS i FROM {{tests}} t JOIN r ON r.node = t.target)
  SELECT grp, path, selector, CASE g WHEN 1 THEN 'configured' ELSE 'static' END AS provenance, d AS distance, target FROM b WHERE i = 1""")(
    lambda m: T.reverse_tests(_seed(m, "n/NATION_3"), S.file_edges(m).withColumn("state", F.lit("current")), m["tests"], 1)
)
query("container_expansion", """WITH s AS (SELECT DISTINCT path, concat(kind, '.', replace(name, ' ', '_')) AS name, 'member' AS kind FROM {symbols} UNION SELECT DISTINCT path, kind, 'class' FROM {symbols})
  SELECT path, name, kind FROM s WHERE name = 'PROMO' AND path = 'Brand#5' UNION SELECT path, name, kind FROM s WHERE path = 'Brand#5' AND name LIKE 'PROMO.%'""")(
    lambda m: (lambda s: T.expand_containers(s.where("name = 'PROMO' and path = 'Brand#5'"), s, ("class",)))(
        m["symbols"].select("path", F.concat("kind", F.lit("."), F.replace("name", F.lit(" "), F.lit("_"))).alias("name"), F.lit("member").alias("kind")).unionByName(m["symbols"].select("path", F.col("kind").alias("name"), F.lit("class").alias("kind"))).distinct()
    )
)
PATHS = """p AS (SELECT node, CAST(0 AS BIGINT) AS d, node AS trail FROM (VALUES ('p/200')) v(node) UNION ALL SELECT a.target, p.d + 1, concat(p.trail, '>', a.target) FROM p JOIN (SELECT DISTINCT source, target FROM {arcs} WHERE FLT) a ON a.source = p.node WHERE p.d < 8)"""


def _path(m: Bound) -> DataFrame:
    return T.shortest_paths(_seed(m, "p/200"), _seed(m, "p/3", "p/0"), m["arcs"], 8, 8)


_PROVEN = PATHS.replace("FLT", "state = 'current' AND resolution IN ('unique', 'builtin')")
query("path_shortest", f"WITH RECURSIVE {_PROVEN}, t AS (SELECT * FROM p WHERE node IN ('p/3', 'p/0')) SELECT trail, CAST(d AS INT) AS length, true AS proven FROM t WHERE d = (SELECT min(d) FROM t)")(
    lambda m: _path(m).select(F.array_join("nodes", ">").alias("trail"), "length", "proven")
)
_ANY = PATHS.replace("FLT", "true").replace("p AS (", "w AS (", 1).replace("p.d", "w.d").replace("p.trail", "w.trail").replace("FROM p JOIN", "FROM w JOIN").replace("= p.node", "= w.node")
query("path_outcome", f"""WITH RECURSIVE {_PROVEN}, {_ANY}, k AS (SELECT (SELECT count(*) FROM p WHERE node IN ('p/3', 'p/0')) AS good, (SELECT count(*) FROM w WHERE node IN ('p/3', 'p/0')) AS other)
  SELECT CASE WHEN good > 0 THEN 'found' WHEN other > 0 THEN 'unknown' ELSE 'absent' END AS outcome, CASE WHEN good > 0 THEN 'witnesses' WHEN other > 0 THEN 'candidate-witnesses' ELSE 'exhaustive' END AS reason FROM k""")(lambda m: T.path_outcome(_path(m), _seed(m, "p/200"), _seed(m, "p/3", "p/0"), True, False))
query("cycle_core", """WITH RECURSIVE g AS (SELECT DISTINCT source, target FROM {arcs} WHERE kind = 'import' AND state = 'current'), n AS (SELECT source AS node FROM g UNION SELECT target FROM g),
  r AS (SELECT source, target FROM g UNION SELECT r.source, g.target FROM r JOIN g ON g.source = r.target), loops AS (SELECT DISTINCT source AS node FROM r WHERE source = target),
  fwd AS (SELECT node FROM loops UNION SELECT r.target FROM r JOIN loops ON loops.node = r.source), bwd AS (SELECT node FROM loops UNION SELECT r.source FROM r JOIN loops ON loops.node = r.target)
  SELECT source, target FROM g WHERE source IN (SELECT node FROM fwd) AND target IN (SELECT node FROM bwd)""")(lambda m: T.cycle_core(m["arcs"].where("kind = 'import' and state = 'current'")))


def _fields(m: Bound) -> DataFrame:
    def field(col: str, weight: int) -> DataFrame:
        return m["symbols"].select(F.lit("symbol").alias("kind"), "path", "name", F.col(col).alias("field"), F.lit(weight).alias("weight")).distinct()

    files = m["files"].select(F.lit("file").alias("kind"), "path", F.col("path").alias("name"), F.col("path").alias("field"), F.lit(10).alias("weight"))
    return field("name", 14).unionByName(field("path", 6)).unionByName(files)


def _strength_sql(term: str) -> str:
    bound = 2 if len(term) >= 8 else 1
    edits = f"CASE WHEN length(t) >= 3 AND levenshtein(t, '{term}') = 1 THEN 32 " + (f"WHEN length(t) >= 3 AND levenshtein(t, '{term}') = 2 THEN 16 " if bound == 2 else "") + "ELSE 0 END" if len(term) >= 4 else "0"
    loose = f"CASE WHEN regexp_matches(t, '^{'.*'.join(term)}.*$') AND length(t) <= {3 * len(term)} AND length(t) > {len(term)} THEN 28 ELSE 0 END" if len(term) >= 4 else "0"
    return f"""CASE WHEN lower(field) = '{term}' THEN 120 ELSE greatest((SELECT max(CASE WHEN t = '{term}' THEN 100 WHEN starts_with(t, '{term}') THEN 72 WHEN contains(t, '{term}') THEN 48 ELSE greatest({edits}, {loose}) END)
      FROM (SELECT unnest(string_split_regex(lower(field), '[^a-z0-9]+')) AS t) u WHERE t <> ''), CASE WHEN contains(lower(field), '{term}') THEN 44 ELSE 0 END) END"""


def _score_sql(terms: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT kind, path, name, weight, {i} AS term, {_strength_sql(t)} AS s FROM fields" for i, t in enumerate(terms))
    quarter = "CASE WHEN s < 44 THEN points // 4 ELSE points END" if len(terms) > 1 else "points"
    return f"""WITH fields AS (SELECT DISTINCT 'symbol' AS kind, path, name, name AS field, 14 AS weight FROM {{symbols}} UNION ALL SELECT DISTINCT 'symbol', path, name, path, 6 FROM {{symbols}} UNION ALL SELECT 'file', path, path, path, 10 FROM {{files}}),
      x AS ({each}), b AS (SELECT *, row_number() OVER (PARTITION BY kind, path, name, term ORDER BY s * weight DESC, s DESC, weight DESC) AS i FROM x WHERE s > 0), k AS (SELECT * FROM b WHERE i = 1),
      df AS (SELECT term, count(*) AS df FROM k GROUP BY term), n AS (SELECT count(*) AS total FROM (SELECT DISTINCT kind, path, name FROM fields)),
      q AS (SELECT kind, path, name, s, weight, CAST(s * weight AS BIGINT) * least(2048, 64 + (256 * (total + 1)) // (df.df + 1)) AS points FROM k JOIN df ON df.term = k.term CROSS JOIN n),
      z AS (SELECT kind, path, name, sum({quarter}) AS p, sum(CASE WHEN s >= 100 THEN 100 ELSE least(100, s + weight * 5 // 2) END) AS c FROM q GROUP BY kind, path, name),
      hits AS (SELECT kind, path, name, CAST(p * c * c // 10000 AS BIGINT) AS score FROM z)"""


SEARCH = "the red widgt"
query("retrieval_score", _score_sql(X.query_terms(SEARCH)) + " SELECT * FROM hits")(lambda m: R.scored(_fields(m), SEARCH))
query("retrieval_diversified", _score_sql(X.query_terms(SEARCH)) + """, o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, kind, path, name) AS nth FROM hits),
  f AS (SELECT kind, path, name, score, 0 AS turn FROM o WHERE nth = 1 ORDER BY score DESC, kind, path, name LIMIT 6),
  r AS (SELECT kind, path, name, score, 1 AS turn FROM hits WHERE (kind, path, name) NOT IN (SELECT (kind, path, name) FROM f))
  SELECT kind, path, name, score FROM (SELECT * FROM f UNION ALL SELECT * FROM r) ORDER BY turn, score DESC, kind, path, name LIMIT 8""")(lambda m: R.diversified(R.scored(_fields(m), SEARCH), 8))


def _ranking(m: Bound) -> tuple[DataFrame, DataFrame]:
    ranked = m["lineitem"].where("l_linenumber <= 7").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rank"))
    ranked = ranked.groupBy("query", "item").agg(F.min("rank").alias("rank"))
    return ranked, m["lineitem"].where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("item")).distinct()


RANKED = "k AS (SELECT l_orderkey AS query, l_partkey AS item, min(l_linenumber) AS rank FROM {lineitem} WHERE l_linenumber <= 7 GROUP BY 1, 2), v AS (SELECT DISTINCT l_orderkey AS query, l_partkey AS item FROM {lineitem} WHERE l_returnflag = 'R')"
query("eval_recall_at_k", f"WITH {RANKED} SELECT v.query, count(*) FILTER (WHERE rank <= 1) / count(*) AS recall_1, count(*) FILTER (WHERE rank <= 3) / count(*) AS recall_3 FROM v LEFT JOIN k ON k.query = v.query AND k.item = v.item GROUP BY v.query")(lambda m: R.recall_at(*_ranking(m), ks=(1, 3)))
query("eval_mrr", f"WITH {RANKED} SELECT v.query, coalesce(1.0 / CAST(min(rank) AS DOUBLE), 0.0) AS rr FROM v LEFT JOIN k ON k.query = v.query AND k.item = v.item GROUP BY v.query")(lambda m: R.reciprocal_rank(*_ranking(m)))
query("pattern_dialects", r"""SELECT path, path LIKE 'src1%/en/%' AS glob, path LIKE 'src1/%' AS below, regexp_full_match(path, 'src[0-9]/[^/]*/[^/]*7') AS collection,
  regexp_full_match(path, 'src[^/]*/.*') AND NOT regexp_full_match(path, 'src[^/]*/fr/.*') AS ignored FROM {inventory}""")(
    lambda m: m["inventory"].select("path", P.glob(F.col("path"), "src1*/en/*").alias("glob"), P.path_glob(F.col("path"), "src1/**").alias("below"), P.collection_glob(F.col("path"), "src[0-9]/**/*7").alias("collection"), P.ignore_decision(F.col("path"), ["/src*/**", "!/src*/fr"]).alias("ignored"))
)
query("text_functions", """SELECT DISTINCT p_name, upper(p_name) AS up, replace(p_name, ' ', '_') AS snake, split_part(p_name, ' ', 2) AS last, CASE WHEN p_brand LIKE '%/%' THEN split_part(p_brand, '/', 1) ELSE '.' END AS area, replace(lower(p_name), ' ', '-') AS package FROM {part}""")(
    lambda m: m["part"].select("p_name", F.upper("p_name").alias("up"), X.snake_case(F.col("p_name")).alias("snake"), X.leaf(F.replace("p_name", F.lit(" "), F.lit("."))).alias("last"), X.top_area(F.col("p_brand")).alias("area"), X.package_name(F.replace("p_name", F.lit(" "), F.lit("_.")), "python").alias("package")).distinct()
)

# --- merge, snapshots, workspace, bridges, graph ----------------------------------------------
MERGED = """o AS (SELECT *, CASE claim WHEN 'semantic-text' THEN 3 WHEN 'syntax-structure' THEN 2 WHEN 'lexical-occurrence' THEN 1 ELSE 0 END AS cr FROM {facts}),
  c AS (SELECT domain, grp, provider, mode, value, row_number() OVER (PARTITION BY domain, grp ORDER BY mode, cr DESC, provider, value) AS i FROM o WHERE mode <> 2),
  u AS (SELECT domain, grp, count(DISTINCT provider) AS contributors FROM o WHERE mode <> 2 GROUP BY domain, grp),
  mg AS (SELECT c.domain, c.grp, c.provider, c.mode, c.value, u.contributors FROM c JOIN u ON u.domain = c.domain AND u.grp = c.grp WHERE c.i = 1 AND NOT (c.mode = 1 AND CLOSED))"""


def _merged(m: Bound, complete: bool = False) -> DataFrame:
    return M.merge(m["facts"], m["facts"].select("domain").distinct().withColumn("complete", F.lit(complete)))


_OPEN = "WITH " + MERGED.replace("CLOSED", "false")
query("provider_merge_selected", f"{_OPEN} SELECT * FROM mg")(_merged)
query("provider_merge_closed_world", "WITH " + MERGED.replace("CLOSED", "EXISTS (SELECT 1 FROM o p WHERE p.mode = 0 AND p.domain = c.domain)") + " SELECT * FROM mg")(lambda m: _merged(m, True))
query("provider_merge_conflicts", """WITH t AS (SELECT domain, grp, count(*) FILTER (WHERE mode = 0) AS p, min(value) FILTER (WHERE mode = 0) AS v, min(value) FILTER (WHERE mode = 1) AS lo, max(value) FILTER (WHERE mode = 1) AS hi FROM {facts} GROUP BY domain, grp)
  SELECT domain, grp, CASE WHEN p > 1 THEN 'duplicate-primary-occurrence' ELSE 'augment-mismatch' END AS code, CASE WHEN p > 1 THEN '' ELSE 'value' END AS differs FROM t WHERE p > 1 OR (p = 1 AND (lo <> v OR hi <> v))""")(lambda m: M.conflicts(m["facts"]))
query("provider_merge_variations", "SELECT domain, grp, count(DISTINCT value) AS variants FROM {facts} WHERE mode <> 2 GROUP BY domain, grp HAVING count(DISTINCT value) > 1")(lambda m: M.variations(m["facts"]))
query("provider_merge_summary", f"""{_OPEN} SELECT (SELECT count(DISTINCT provider) FROM o) AS providers, (SELECT count(*) FROM (SELECT DISTINCT domain, provider FROM o)) AS selections, (SELECT count(*) FROM (SELECT grp FROM o WHERE mode <> 2 GROUP BY domain, grp HAVING count(DISTINCT value) > 1)) AS variations, (SELECT count(*) FROM (SELECT count(*) FILTER (WHERE mode = 0) AS p, min(value) FILTER (WHERE mode = 0) AS v, min(value) FILTER (WHERE mode = 1) AS lo, max(value) FILTER (WHERE mode = 1) AS hi FROM o GROUP BY domain, grp) t WHERE p > 1 OR (p = 1 AND (lo <> v OR hi <> v))) AS conflicts, (SELECT count(*) FROM o WHERE mode <> 2) AS contributed, (SELECT count(*) FROM mg) AS selected_facts, (SELECT count(*) FROM mg WHERE contributors > 1) AS deduplicated,
  (SELECT count(*) FROM o a LEFT JOIN mg ON mg.domain = a.domain AND mg.grp = a.grp WHERE a.mode = 2 AND a.value IS NOT DISTINCT FROM mg.value) AS audit_match, (SELECT count(*) FROM o a LEFT JOIN mg ON mg.domain = a.domain AND mg.grp = a.grp WHERE a.mode = 2 AND a.value IS DISTINCT FROM mg.value) AS audit_difference""")(lambda m: M.summary(m["facts"], _merged(m)))
DIFF = "SELECT coalesce(b.key, a.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {before} b FULL JOIN {after} a ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value"
query("map_diff", DIFF)(lambda m: D.diff(m["before"], m["after"]))
for _c in ("added", "removed", "changed"):
    query(f"map_diff_{_c}", f"SELECT * FROM ({DIFF}) d WHERE change = '{_c}'")(lambda m, c=_c: D.diff(m["before"], m["after"]).where(F.col("change") == c))
query("freshness", """SELECT *, CASE WHEN added + missing + changed > 0 THEN 'stale' ELSE 'current' END AS status FROM (SELECT count(*) FILTER (WHERE b.key IS NULL) AS added, count(*) FILTER (WHERE a.key IS NULL) AS missing,
  count(*) FILTER (WHERE a.value <> b.value) AS changed, count(*) FILTER (WHERE a.value = b.value) AS unchanged FROM {before} b FULL JOIN {after} a ON a.key = b.key) t""")(lambda m: D.freshness(m["before"], m["after"]))
def _snapshots(m: Bound) -> tuple[dict, dict]:
    """Two Maps: in the second, symbols of one kind moved down a line and files of one language have another layer."""
    old = m["symbols"].select("name", "path", "kind", "line").distinct()
    new = old.withColumn("line", F.col("line") + F.when(F.col("kind") == "LARGE", 1).otherwise(0)).withColumn("name", F.when(F.col("kind") == "PROMO", F.concat("name", F.lit("2"))).otherwise(F.col("name")))
    files = m["files"].select("path", "layer", "language")
    edges = m["edges"].select("source", "target", "kind", "state")
    routes = m["builds"].select("build", "path")
    before = {"symbols": (old, ("path", "name")), "files": (files, ("path",)), "edges": (edges, ("source", "target", "kind")), "build_routes": (routes, ("build", "path"))}
    after = {"symbols": (new, ("path", "name")), "files": (files.withColumn("layer", F.when(F.col("language") == "r", "R").otherwise(F.col("layer"))), ("path",)), "edges": before["edges"], "entrypoints": (m["entrypoints"], ("package", "route"))}
    return before, after


def _key_sql(*columns: str) -> str:
    return "concat('[', " + ", ',', ".join(f"""'"', {c}, '"'""" for c in columns) + ", ']')"


query("map_diff_sections", f"""WITH o AS (SELECT path, name, string_agg(concat(kind, line), ',' ORDER BY concat(kind, line)) AS v FROM (SELECT DISTINCT path, name, kind, line FROM {{symbols}}) GROUP BY path, name),
  n AS (SELECT path, name, string_agg(concat(kind, line), ',' ORDER BY concat(kind, line)) AS v FROM (SELECT DISTINCT path, CASE kind WHEN 'PROMO' THEN concat(name, '2') ELSE name END AS name, kind, line + CASE kind WHEN 'LARGE' THEN 1 ELSE 0 END AS line FROM {{symbols}}) GROUP BY path, name)
  SELECT 'symbols' AS section, {_key_sql('coalesce(o.path, n.path)', 'coalesce(o.name, n.name)')} AS key, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON n.path = o.path AND n.name = o.name WHERE o.v IS DISTINCT FROM n.v
  UNION ALL SELECT 'files', {_key_sql('path')}, 'changed' FROM {{files}} WHERE language = 'r'
  UNION ALL SELECT 'build_routes', {_key_sql('build', 'path')}, 'removed' FROM {{builds}}
  UNION ALL SELECT DISTINCT 'entrypoints', {_key_sql('package', 'route')}, 'added' FROM {{entrypoints}}""")(lambda m: D.map_diff(*_snapshots(m)))
query("query_surface_summary", """WITH q AS (SELECT p_name AS key, p_size % 10 = 0 AS ignored, CASE p_size % 3 WHEN 0 THEN 'declared' WHEN 1 THEN 'undeclared' ELSE 'unknown' END AS declaration, p_size % 2 = 0 AS used, CASE p_size % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution FROM {part})
  SELECT count(*) FILTER (WHERE ignored) AS ignored, count(*) FILTER (WHERE NOT ignored AND declaration = 'declared') AS registered, count(*) FILTER (WHERE NOT ignored AND declaration = 'declared' AND NOT used) AS unused, count(*) FILTER (WHERE NOT ignored AND declaration = 'undeclared' AND used) AS unregistered_use,
  count(*) FILTER (WHERE NOT ignored AND declaration = 'unknown') AS declaration_unknown, count(*) FILTER (WHERE NOT ignored AND used) AS used, count(*) FILTER (WHERE NOT ignored AND resolution = 'resolved') AS resolved, count(*) FILTER (WHERE NOT ignored AND resolution = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE NOT ignored AND resolution = 'unresolved') AS unresolved FROM q""")(
    lambda m: D.query_surface_summary(m["part"].select(
        F.col("p_name").alias("key"), (F.col("p_size") % 10 == 0).alias("ignored"), F.expr("CASE p_size % 3 WHEN 0 THEN 'declared' WHEN 1 THEN 'undeclared' ELSE 'unknown' END").alias("declaration"),
        (F.col("p_size") % 2 == 0).alias("used"), F.expr("CASE p_size % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous' ELSE 'unresolved' END").alias("resolution"),
    ))
)
query("file_order", """WITH q AS (SELECT concat('p/', p_partkey) AS node, p_size % 3 AS stale, p_size % 2 AS unknown, 0 AS z, p_size % 4 AS distance, CASE WHEN p_size % 5 < 3 THEN p_size % 5 ELSE 0 END AS score, p_partkey % 7 AS rank, p_partkey % 11 AS degree FROM {part})
  SELECT node, place FROM (SELECT node, CAST(row_number() OVER (ORDER BY stale, unknown, distance, score DESC, CASE WHEN score <> 0 THEN rank ELSE 0 END, degree DESC, node) AS INTEGER) AS place FROM q) WHERE place <= 50""")(
    lambda m: (lambda p: T.file_order(
        p.select("node", (F.col("p_size") % 3).alias("stale"), (F.col("p_size") % 2).alias("unknown"), *[F.lit(0).alias(c) for c in ("unresolved", "ambiguous", "candidate")], (F.col("p_size") % 4).alias("distance")),
        p.where("p_size % 5 in (1, 2)").select("node", (F.col("p_size") % 5).alias("score"), (F.col("p_partkey") % 7).alias("rank")), p.select("node", (F.col("p_partkey") % 11).alias("degree")), 50,
    ))(m["part"].withColumn("node", F.concat(F.lit("p/"), "p_partkey")))
)
query("test_order", """WITH q AS (SELECT DISTINCT path, grp, selector, CASE length(selector) % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'asserted' ELSE 'static' END AS provenance, length(target) % 4 AS seed_score, CASE WHEN configured THEN 'exact' ELSE 'conservative' END AS confidence, length(target) AS symbol_distance FROM {tests})
  SELECT path, selector, confidence, symbol_distance, place FROM (SELECT *, CAST(row_number() OVER (ORDER BY CASE provenance WHEN 'observed' THEN 0 WHEN 'asserted' THEN 1 ELSE 2 END, seed_score DESC, CASE WHEN provenance <> 'static' THEN 0 WHEN confidence = 'exact' THEN 0 ELSE 2 END, symbol_distance, path, grp, selector, confidence) AS INTEGER) AS place FROM q) WHERE place <= 40""")(
    lambda m: T.test_order(m["tests"].select(
        "path", "grp", "selector", F.expr("CASE length(selector) % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'asserted' ELSE 'static' END").alias("provenance"), (F.length("target") % 4).alias("seed_score"), F.lit(0).alias("seed_rank"),
        F.when(F.col("configured"), "exact").otherwise("conservative").alias("confidence"), F.lit("case").alias("scope"), F.lit("requested-seed").alias("role"), F.length("target").alias("symbol_distance"), F.lit(0).alias("seed_distance"), F.lit(0).alias("affinity"), F.lit(0).alias("route_count"),
    ).distinct().withColumn("line", F.when(F.col("confidence") == "conservative", 0).otherwise(1)), 40).select("path", "selector", "confidence", "symbol_distance", "place")
)
query("provider_merge_enriched", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY domain, grp ORDER BY mode, CASE claim WHEN 'semantic-text' THEN 0 WHEN 'syntax-structure' THEN 1 WHEN 'lexical-occurrence' THEN 2 ELSE 3 END, provider, value) AS i, CASE WHEN value LIKE '%:0' THEN value END AS zero FROM {facts} WHERE mode <> 2)
  SELECT domain, grp, (arg_min(zero, i) FILTER (WHERE zero IS NOT NULL)) AS zero, CASE WHEN (min(i) FILTER (WHERE zero IS NOT NULL AND value <> first)) IS NOT NULL AND first NOT LIKE '%:0' THEN 'zero' ELSE '' END AS enriched FROM (SELECT *, first_value(value) OVER (PARTITION BY domain, grp ORDER BY i) AS first FROM l) GROUP BY domain, grp, first""")(
    lambda m: M.enriched(m["facts"].withColumn("zero", F.when(F.col("value").endswith(":0"), F.col("value"))), ("zero",))
)
query("provider_primary_cardinality", "SELECT domain, 'primary-cardinality' AS code FROM {facts} WHERE mode = 0 GROUP BY domain HAVING count(DISTINCT provider) > 1")(lambda m: M.primary_cardinality(m["facts"].select("domain", "provider", "mode")))
query("next_baseline", f"""WITH {KEYS_A}, f AS ({MISSING} UNION ALL {EXTRA}), p AS (SELECT DISTINCT name AS key FROM {{symbols}} WHERE line > 40)
  SELECT DISTINCT comparison, key, 'active' AS status FROM f UNION ALL SELECT 'missing', key, 'resolved' FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.comparison = 'missing' AND f.key = p.key)""")(
    lambda m: O.next_baseline(A.set_equal(*_sets(m)), m["symbols"].where("line > 40").select(F.lit("missing").alias("comparison"), F.col("name").alias("key")).distinct())
)
query("parity_missing", "SELECT a.member, u.value FROM (SELECT DISTINCT member FROM {parity_values}) a CROSS JOIN (SELECT DISTINCT value FROM {parity_values}) u WHERE NOT EXISTS (SELECT 1 FROM {parity_values} p WHERE p.member = a.member AND p.value = u.value)")(lambda m: D.parity_missing(m["parity_values"]))
query("parity_shared", "SELECT value FROM {parity_values} GROUP BY value HAVING count(DISTINCT member) = (SELECT count(DISTINCT member) FROM {parity_values})")(lambda m: D.parity_shared(m["parity_values"]))
query("surface_summary", f"""WITH {SURFACE} SELECT count(*) FILTER (WHERE declaration = 'declared') AS registered, count(*) FILTER (WHERE used) AS used, count(*) FILTER (WHERE declaration = 'declared' AND NOT used) AS unused, count(*) FILTER (WHERE declaration <> 'declared' AND used) AS unregistered_use,
  count(*) FILTER (WHERE resolution = 'resolved') AS resolved, count(*) FILTER (WHERE resolution = 'unresolved') AS unresolved, count(*) FILTER (WHERE resolution = 'ambiguous') AS ambiguous FROM sf""")(lambda m: D.surface_summary(S.provider_surface(m)))
MSG = "SELECT concat('u', user_id) AS path, CASE WHEN event_id % 13 = 0 THEN '*' ELSE event_type END AS key, CAST(CAST(floor(event_id / 20) AS BIGINT) AS VARCHAR) AS value, event_id % 2 AS side FROM {events}"


def _messages(m: Bound, side: int) -> DataFrame:
    rows = m["events"].where(F.col("event_id") % 2 == side)
    key = F.when(F.col("event_id") % 13 == 0, "*").otherwise(F.col("event_type"))
    return rows.select(F.concat(F.lit("u"), "user_id").alias("path"), F.concat(key, F.lit(":"), F.floor(F.col("event_id") / 20).cast("string")).alias("message"))


query("message_bridge", f"WITH x AS ({MSG}) SELECT DISTINCT s.path AS source, r.path AS target FROM x s JOIN x r ON s.side = 0 AND r.side = 1 AND s.value = r.value AND (s.key = r.key OR r.key = '*') AND s.path <> r.path")(lambda m: D.message_bridge(_messages(m, 0), _messages(m, 1)))
query("name_bridge", """SELECT DISTINCT c.source, d.path AS target, c.n AS name FROM (SELECT DISTINCT source, 'lib' AS layer, CASE WHEN name LIKE 'red %' THEN substr(name, 5) ELSE name END AS n FROM {calls}) c
  JOIN (SELECT DISTINCT path, kind AS layer, CASE WHEN name LIKE 'red %' THEN substr(name, 5) ELSE name END AS n FROM {symbols}) d ON d.n = c.n WHERE c.layer <> d.layer""")(
    lambda m: D.name_bridge(m["calls"].select(F.col("source").alias("path"), F.lit("lib").alias("layer"), "name"), m["symbols"].select("path", F.col("kind").alias("layer"), "name"), ("red ",))
)
WORKSPACE = """own AS (SELECT DISTINCT p_type AS project, lower(replace(concat(p_name, ' ', p_size), ' ', '-')) AS id FROM {part}), asked AS (SELECT DISTINCT p_type AS project, lower(replace(concat(p_name, ' ', (p_size * 7) % 61), ' ', '-')) AS id FROM {part}),
  n AS (SELECT id, count(*) AS n, min(project) AS target FROM own GROUP BY id), w AS (SELECT project, asked.id AS name, CASE WHEN n IS NULL THEN 'external' WHEN n = 1 THEN 'route' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN target END AS target FROM asked LEFT JOIN n ON n.id = asked.id)"""


def _workspace(m: Bound) -> DataFrame:
    def named(number: Column) -> DataFrame:
        return m["part"].select(F.col("p_type").alias("project"), F.replace(F.concat_ws(" ", "p_name", number.cast("string")), F.lit(" "), F.lit("_")).alias("name"))

    return D.workspace(named(F.col("p_size") * 7 % 61), named(F.col("p_size")), "python")


for _name, _word in (("routes", "route"), ("externals", "external"), ("ambiguity", "ambiguous")):
    query(f"workspace_{_name}", f"WITH {WORKSPACE} SELECT * FROM w WHERE outcome = '{_word}'")(lambda m, w=_word: _workspace(m).where(F.col("outcome") == w))
query("enclosing_span", """SELECT path, pos, name FROM (SELECT p.path, p.pos, s.name, row_number() OVER (PARTITION BY p.path, p.pos ORDER BY s."end" - s.start, s.name) AS i FROM {chat_points} p LEFT JOIN {chat_spans} s ON s.path = p.path AND s.start <= p.pos AND p.pos < s."end") WHERE i = 1""")(lambda m: D.enclosing(m["chat_points"], m["chat_spans"]))
query("call_resolution_ladder", """WITH d AS (SELECT p_type AS language, p_name AS name, count(DISTINCT p_brand) AS n FROM {part} GROUP BY 1, 2), c AS (SELECT DISTINCT p_brand AS source, p_type AS language, CASE WHEN p_size % 9 = 0 THEN concat(p_name, '2') WHEN p_size % 9 = 1 THEN 'print' ELSE p_name END AS name FROM {part})
  SELECT c.source, c.name, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' WHEN c.name = 'print' THEN 'builtin' ELSE 'unresolved' END AS resolution, coalesce(n, 0) AS candidates FROM c LEFT JOIN d ON d.language = c.language AND d.name = c.name""")(
    lambda m: (lambda p: D.call_ladder(p.select(F.col("path").alias("source"), "language", F.expr("CASE WHEN p_size % 9 = 0 THEN concat(name, '2') WHEN p_size % 9 = 1 THEN 'print' ELSE name END").alias("name")), p, ("print",)))(m["part"].select(F.col("p_brand").alias("path"), F.col("p_type").alias("language"), F.col("p_name").alias("name"), "p_size"))
)
query("import_resolution_ladder", """WITH i AS (SELECT DISTINCT p_type AS source, p_name AS module FROM {part}), f AS (SELECT DISTINCT p_name AS path FROM {part} WHERE p_size = 3 UNION SELECT DISTINCT concat(p_name, '/index') FROM {part} WHERE p_size = 5),
  a AS (SELECT p_name AS module, count(DISTINCT p_brand) AS n, min(p_brand) AS package FROM {part} WHERE p_size = 9 GROUP BY 1), b AS (SELECT i.source, i.module, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.path = i.module) THEN i.module WHEN EXISTS (SELECT 1 FROM f WHERE f.path = concat(i.module, '/index')) THEN concat(i.module, '/index') END AS file FROM i)
  SELECT b.source, b.module, CASE WHEN b.module = 'red bolt' THEN 'builtin' WHEN file IS NOT NULL THEN 'file' WHEN n = 1 THEN 'package' WHEN n > 1 THEN 'ambiguous' ELSE 'external' END AS kind,
  CASE WHEN b.module = 'red bolt' THEN NULL WHEN file IS NOT NULL THEN file WHEN n = 1 THEN package END AS target FROM b LEFT JOIN a ON a.module = b.module""")(
    lambda m: (lambda p: D.import_ladder(p.select(F.col("p_type").alias("source"), F.col("p_name").alias("module")), p.where("p_size = 3").select(F.col("p_name").alias("path")).unionByName(p.where("p_size = 5").select(F.concat("p_name", F.lit("/index")).alias("path"))).distinct(), p.where("p_size = 9").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("package")), ("red bolt",)))(m["part"])
)
query("compile_contexts", "SELECT sha256(concat(p_type, ' ', p_brand)) AS context, concat(p_type, ' ', p_brand) AS options, count(*) AS commands FROM {part} GROUP BY 1, 2")(lambda m: D.intern_contexts(m["part"].select(F.concat_ws(" ", "p_type", "p_brand").alias("options"))))
query("edge_grouping", f"SELECT source, target, kind, string_agg(DISTINCT name, ',' ORDER BY name) AS names, CASE max(CASE state WHEN 'current' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) WHEN 2 THEN 'current' WHEN 1 THEN 'unknown' ELSE 'stale' END AS state FROM {{mentions}} GROUP BY source, target, kind")(lambda m: m["edges"].withColumn("names", F.array_join("names", ",")))
query("resolution_counts", f"WITH c AS ({CALLS}) SELECT source, resolution, count(*) AS calls FROM c GROUP BY source, resolution")(lambda m: m.of_callers(m["class_relations"].groupBy("source", "resolution").agg(F.count("*").alias("calls"))))
query("layer_rollup", "SELECT layer, count(*) AS files, sum(symbol_count) AS symbols FROM {files} GROUP BY layer")(lambda m: m["files"].groupBy("layer").agg(F.count("*").alias("files"), F.sum("symbol_count").alias("symbols")))
query("component_summary", f"""WITH {CEDGES}, o AS (SELECT source, count(*) AS outgoing FROM cedges GROUP BY source) SELECT c.component, count(*) AS files, sum(f.symbol_count) AS symbols, coalesce(max(o.outgoing), 0) AS outgoing
  FROM {{component_files}} c JOIN {{files}} f ON f.path = c.path LEFT JOIN o ON o.source = c.component GROUP BY c.component""")(
    lambda m: m["component_files"].join(m["files"], "path").groupBy("component").agg(F.count("*").alias("files"), F.sum("symbol_count").alias("symbols")).join(S.component_edges(m).groupBy(F.col("source").alias("component")).agg(F.count("*").alias("outgoing")), "component", "left").fillna(0, ["outgoing"])
)
GRAPH = f"{FEDGES}, g AS (SELECT source, CASE kind WHEN 'R' THEN 'imports' WHEN 'A' THEN 'declarations' ELSE 'packages' END AS family, target, CASE state WHEN 'current' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END AS r FROM fedges), gr AS (SELECT source, family, target, {STATE.replace('CASE r', 'CASE max(r)')} AS state FROM g GROUP BY source, family, target)"


def _graph(m: Bound) -> DataFrame:
    kind = F.when(F.col("kind") == "R", "import").when(F.col("kind") == "A", "declaration").otherwise("external")
    return G.relations(m["edges"].withColumn("kind", kind))


query("graph_relations", f"WITH {GRAPH} SELECT * FROM gr")(_graph)
query("graph_nodes", f"WITH {GRAPH}, pg AS (SELECT source, CASE family WHEN 'packages' THEN concat('package:', target) ELSE target END AS target FROM gr) SELECT path AS node, 'file' AS kind FROM {{files}} UNION ALL SELECT node, 'package' FROM (SELECT DISTINCT target AS node FROM pg) t WHERE node LIKE 'package:%'")(
    lambda m: G.nodes(m["files"], _graph(m).withColumn("target", F.when(F.col("family") == "packages", F.concat(F.lit("package:"), "target")).otherwise(F.col("target"))))
)
query("graph_symbol_relations", """WITH o AS (SELECT DISTINCT name, path AS target FROM {symbols}), n AS (SELECT name, count(*) AS n FROM o GROUP BY name), h AS (SELECT DISTINCT source, relation, c.name, o.target, n FROM (SELECT DISTINCT source, relation, name FROM {calls}) c JOIN o ON o.name = c.name JOIN n ON n.name = c.name WHERE source <> o.target)
  SELECT source, relation AS family, target, CASE WHEN min(n) = 1 THEN 'current' ELSE 'unknown' END AS state FROM h GROUP BY source, relation, target""")(lambda m: G.symbol_relations(m["calls"], m["symbols"]))
ROUTES = """rr AS (SELECT DISTINCT path AS source, 'tests' AS family, target, 'current' AS state FROM {tests} UNION SELECT concat('build:', build), 'builds', path, 'current' FROM {builds} UNION SELECT concat('package:', package), 'packages', target, 'current' FROM {entrypoints})"""
query("graph_route_relations", f"WITH {ROUTES} SELECT * FROM rr")(lambda m: G.route_relations(m["tests"], m["builds"], m["entrypoints"]))
query("graph_component_level", f"""WITH {GRAPH}, o AS (SELECT DISTINCT component, path FROM {{component_files}}), b AS (SELECT coalesce(x.component, source) AS source, family, coalesce(y.component, target) AS target, state FROM gr LEFT JOIN o x ON x.path = source LEFT JOIN o y ON y.path = target)
  SELECT source, family, target, CASE max(CASE state WHEN 'current' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) WHEN 2 THEN 'current' WHEN 1 THEN 'unknown' ELSE 'stale' END AS state, 0 AS collapsed FROM b WHERE source <> target GROUP BY source, family, target
  UNION ALL SELECT NULL, family, NULL, NULL, count(*) FROM b WHERE source = target GROUP BY family""")(lambda m: G.at_level(_graph(m), m["component_files"]))
query("graph_groups", f"WITH {GRAPH} SELECT a.layer AS from_group, family, b.layer AS to_group, count(*) AS relations, count(DISTINCT source) AS members FROM gr JOIN {{files}} a ON a.path = source JOIN {{files}} b ON b.path = target WHERE a.layer <> b.layer GROUP BY 1, 2, 3")(lambda m: G.grouped(_graph(m), G.group_key(m["files"], "layer")))
query("graph_ledger", f"WITH {GRAPH} SELECT family, count(*) AS collapsed FROM gr JOIN {{files}} a ON a.path = source JOIN {{files}} b ON b.path = target WHERE a.language = b.language GROUP BY family")(lambda m: G.ledger(_graph(m), G.group_key(m["files"], "language")))
query("graph_evidence_overlay", f"WITH {GRAPH} SELECT family, state, count(*) AS relations FROM gr GROUP BY family, state")(lambda m: G.evidence_overlay(_graph(m)))


# --- sources, sinks, streaming -----------------------------------------------------------------
from factweave.sources import readers as I  # noqa: E402
from factweave.streaming.changes import event_windows  # noqa: E402

query("inventory_counts", """SELECT count(*) AS inventory_files, count(*) FILTER (WHERE path LIKE '%/de/%') AS ignored, count(*) FILTER (WHERE oversized AND path NOT LIKE '%/de/%') AS oversized,
  count(*) FILTER (WHERE NOT oversized AND path NOT LIKE '%/de/%' AND path LIKE '%.en') AS selected, count(*) FILTER (WHERE path NOT LIKE '%/de/%' AND path NOT LIKE '%.en') AS unsupported
  FROM (SELECT concat(source, '/', lang, '/', doc_id, '.', lang) AS path, strlen(text) > 5000 AS oversized FROM {documents})""")(
    lambda m: I.inventory_counts(
        m["documents"].select(F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit("."), "lang").alias("path"), (F.octet_length("text") > 5000).alias("oversized")).withColumn("ignored", P.ignore_decision(F.col("path"), ["de/"])), ("en",)
    )
)
query("file_classification", """SELECT path, CASE WHEN path LIKE 'src1/%' THEN 'core' WHEN path LIKE '%/fr/%' THEN 'french' END AS layer,
  concat_ws(',', CASE WHEN path LIKE '%/en/%' THEN 'source' END, CASE WHEN path LIKE '%7' THEN 'test' END) AS roles FROM {inventory}""")(
    lambda m: I.classify(m["inventory"], [("core", "src1/**"), ("french", "*/fr/*")], [("source", "*/en/*"), ("test", "*7")]).withColumn("roles", F.array_join("roles", ","))
)
query("change_set", """SELECT CASE event_type WHEN 'click' THEN 'added' WHEN 'view' THEN 'modified' WHEN 'error' THEN 'deleted' ELSE 'renamed' END AS status, CASE WHEN event_type IN ('click', 'view', 'error') THEN concat('f', event_id) ELSE concat('g', event_id) END AS path,
  CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN concat('f', event_id) END AS previous FROM {events}""")(
    lambda m: I.change_set(m["events"].select(F.concat(F.expr("CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'M' WHEN 'error' THEN 'D' ELSE 'R100' END"), F.lit("\tf"), "event_id", F.when(F.col("event_type").isin("click", "view", "error"), "").otherwise(F.concat(F.lit("\tg"), "event_id"))).alias("text")))
)
query("canonical_json", """SELECT json, sha256(json) AS sha256 FROM (SELECT concat('{"key":"', component, '","path":"', path, '"}') AS json FROM {component_files})""")(lambda m: O.canonical_json(m["component_files"].select("path", F.col("component").alias("key"))))
query("derived_actions", f"""WITH {KEYS_A} SELECT DISTINCT CASE comparison WHEN 'missing' THEN 'add' ELSE 'remove' END AS action, key, comparison, CASE comparison WHEN 'missing' THEN 0 ELSE 2 END AS step FROM ({MISSING} UNION ALL {EXTRA}) x""")(lambda m: O.derive_actions(A.set_equal(*_sets(m))))
query("event_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY 1, 2")(lambda m: event_windows(m["events"]).withColumn("total", F.round("total", 2)))

# --- further sources and plans -----------------------------------------------------------------
from factweave.plans import requests as Q  # noqa: E402
from factweave.sources import builds as B  # noqa: E402
from factweave.sources import lexical as L  # noqa: E402

query("lexical_facts", """SELECT DISTINCT concat('b/', p_brand, '.py') AS path, 'python' AS language, d AS domain, CASE d WHEN 'declaration' THEN replace(p_name, ' ', '_') ELSE lower(p_type) END AS name, 'lexical-occurrence' AS claim
  FROM {part} CROSS JOIN (VALUES ('declaration'), ('import')) v(d)""")(
    lambda m: L.facts(m["part"].select(F.concat(F.lit("b/"), "p_brand", F.lit(".py")).alias("path"), F.concat(F.lit("import "), F.lower("p_type"), F.lit("\n# def no(): pass\ndef "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("():\n    pass\n")).alias("text")))
)
query("make_targets", "SELECT p_brand AS path, concat('t', p_partkey) AS build, d AS dep FROM {part} CROSS JOIN (VALUES ('a.c'), ('b.h')) v(d)")(
    lambda m: B.make_targets(m["part"].select(F.col("p_brand").alias("path"), F.concat(F.lit("X := 1\nt"), "p_partkey", F.lit(": a.c \\\n b.h\n\tcc $<\n")).alias("text")))
)
query("compile_commands", "SELECT p_brand AS directory, concat(p_partkey, '.c') AS file, concat('-DN=', p_size, ' -Iinc') AS options FROM {part}")(
    lambda m: B.compile_commands(m["part"].select(F.concat(F.lit('[{"directory":"'), "p_brand", F.lit('","file":"'), "p_partkey", F.lit('.c","command":"cc -Iinc -DN='), "p_size", F.lit(' -c x.c -o x.o"}]')).alias("text")))
)
query("context_page", """SELECT path, name, kind, line FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY line DESC, path, name) AS i FROM (SELECT DISTINCT path, name, kind, line FROM {symbols})) WHERE i > 2 AND i <= 7""")(
    lambda m: Q.page(m["symbols"].select("path", "name", "kind", "line").distinct(), "kind", [F.desc("line"), "path", "name"], 5, 2)
)
query("diagnostics", "SELECT 'warning' AS severity, 'file-without-component' AS code, path AS key FROM {files} WHERE path NOT IN (SELECT path FROM {component_files})")(
    lambda m: Q.diagnostics(m["files"].select(F.col("path").alias("key")), m["component_files"].select(F.col("path").alias("key")), "file-without-component", "warning")
)

# --- building a Map ----------------------------------------------------------------------------
from factweave.operators import construct as K  # noqa: E402

DEFS = "d AS (SELECT DISTINCT name, path AS target FROM {symbols}), n AS (SELECT name, count(*) AS n FROM d GROUP BY name)"


def _defs(m: Bound) -> DataFrame:
    return m["symbols"].select("name", F.col("path").alias("target"))


query("reference_edges", f"""WITH {DEFS}, u AS (SELECT DISTINCT source, name FROM {{calls}} WHERE relation = 'references')
  SELECT source, 'reference' AS kind, target, string_agg(u.name, ',' ORDER BY u.name) AS names, CASE WHEN min(n) = 1 THEN 'current' ELSE 'unknown' END AS state FROM u JOIN d ON d.name = u.name JOIN n ON n.name = u.name WHERE source <> target GROUP BY source, target""")(
    lambda m: K.reference_edges(m["calls"].where("relation = 'references'"), _defs(m)).withColumn("names", F.array_join("names", ","))
)
query("inherited_members", """WITH RECURSIVE m AS (SELECT concat('p/', p_partkey) AS cls, p_type AS name FROM {part}), b AS (SELECT DISTINCT source AS cls, target AS base FROM {arcs} WHERE kind = 'call'),
  a AS (SELECT cls, cls AS owner, 0 AS distance FROM (SELECT cls FROM m UNION SELECT cls FROM b) UNION ALL SELECT a.cls, b.base, distance + 1 FROM a JOIN b ON b.cls = a.owner WHERE distance < 64)
  SELECT cls, name, owner, distance, true AS complete FROM (SELECT a.cls, m.name, owner, distance, row_number() OVER (PARTITION BY a.cls, m.name ORDER BY distance, owner) AS i FROM a JOIN m ON m.cls = a.owner) WHERE i = 1""")(
    lambda m: K.inherited_members(m["part"].select(F.concat(F.lit("p/"), "p_partkey").alias("cls"), F.col("p_type").alias("name")), m["arcs"].where("kind = 'call'").select(F.col("source").alias("cls"), F.col("target").alias("base")))
)
query("static_test_routes", f"""WITH {DEFS}, c AS (SELECT path, pos, p_name AS name FROM {{chat_points}} JOIN {{part}} ON p_partkey = pos % 150),
  e AS (SELECT path, pos, name AS selector FROM (SELECT p.path, p.pos, s.name, row_number() OVER (PARTITION BY p.path, p.pos ORDER BY s."end" - s.start, s.name) AS i FROM {{chat_points}} p JOIN {{chat_spans}} s ON s.path = p.path AND s.start <= p.pos AND p.pos < s."end") WHERE i = 1)
  SELECT e.path, selector, target, count(*) AS calls, CASE WHEN min(n) = 1 THEN 'static' ELSE 'candidate' END AS provenance FROM c JOIN e ON e.path = c.path AND e.pos = c.pos JOIN d ON d.name = c.name JOIN n ON n.name = c.name GROUP BY e.path, selector, target""")(
    lambda m: K.static_routes(m["chat_points"].join(m["part"], F.col("p_partkey") == F.col("pos") % 150).select("path", "pos", F.col("p_name").alias("callee")), m["chat_spans"], _defs(m))
)
query("reference_groups", """WITH c AS (SELECT source, name, relation, coalesce(string_agg(DISTINCT target, ',' ORDER BY target), '') AS candidates FROM {calls} GROUP BY source, name, relation)
  SELECT source, relation, candidates, string_agg(name, ',' ORDER BY name) AS names FROM c GROUP BY source, relation, candidates""")(
    lambda m: m.of_callers(K.reference_groups(m["class_relations"]).withColumn("candidates", F.array_join("candidates", ",")).withColumn("names", F.array_join("names", ",")))
)
query("component_edge_rollup", """WITH o AS (SELECT DISTINCT component, path FROM {component_files}) SELECT a.component AS source, b.component AS target, kind, count(*) AS mentions, string_agg(DISTINCT name, ',' ORDER BY name) AS names
  FROM {mentions} t JOIN o a ON a.path = t.source JOIN o b ON b.path = t.target WHERE a.component <> b.component GROUP BY 1, 2, 3""")(
    lambda m: K.component_rollup(m["mentions"], m["component_files"]).withColumn("names", F.array_join("names", ","))
)
query("focus_seeds", """WITH i AS (SELECT 'file' AS kind, path AS key FROM {files} UNION SELECT 'symbol', name FROM {symbols} UNION SELECT 'component', component FROM {component_files} UNION SELECT 'package', package FROM {entrypoints} UNION SELECT 'artifact', artifact FROM {artifacts})
  SELECT kind, key, 'ASIA' AS word FROM i WHERE key = 'ASIA' UNION ALL SELECT kind, key, 'n/NATION_1*' FROM i WHERE key LIKE 'n/NATION\\_1%' ESCAPE '\\' UNION ALL SELECT kind, key, 'red*' FROM i WHERE key LIKE 'red%'""")(
    lambda m: K.focus(S.search_domain(m), ("ASIA", "n/NATION_1*", "red*"))
)
query("path_endpoints", """WITH p AS (SELECT 'n/NATION_1*' AS pattern, 'n/NATION\\_1%' AS l UNION ALL SELECT 'n/NATION_3', 'n/NATION\\_3' UNION ALL SELECT 'n', 'n/%' UNION ALL SELECT 'x/*', 'x/%')
  SELECT pattern, count(path) AS matches, CASE count(path) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM p LEFT JOIN {files} ON path LIKE l ESCAPE '\\' GROUP BY pattern""")(
    lambda m: K.endpoints(m["files"].select(F.col("path").alias("node")), ("n/NATION_1*", "n/NATION_3", "n", "x/*"))
)
query("provider_contributors", """SELECT domain, grp, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, string_agg(DISTINCT claim, ',' ORDER BY claim) AS claims FROM {facts} WHERE mode < 2 GROUP BY domain, grp""")(
    lambda m: M.contributors(m["facts"]).withColumn("providers", F.array_join("providers", ",")).withColumn("claims", F.array_join("claims", ","))
)
query("eval_distractor_ratio", f"WITH {RANKED} SELECT k.query, count(*) FILTER (WHERE v.item IS NULL) / count(*) AS distractors FROM k LEFT JOIN (SELECT DISTINCT query, item FROM v) v ON v.query = k.query AND v.item = k.item WHERE rank <= 3 GROUP BY k.query")(
    lambda m: R.distractor_ratio(*_ranking(m), k=3)
)
query("eval_budget_recall", f"""WITH {RANKED}, u AS (SELECT query, item, sum(5 * rank) OVER (PARTITION BY query ORDER BY rank, item ROWS UNBOUNDED PRECEDING) AS used FROM k)
  SELECT v.query, count(*) FILTER (WHERE used <= 20) / count(*) AS recall FROM v LEFT JOIN u ON u.query = v.query AND u.item = v.item GROUP BY v.query""")(
    lambda m: (lambda ranked, relevant: R.budget_recall(ranked.withColumn("lines", F.col("rank") * 5), relevant, 20))(*_ranking(m))
)
query("diagnostics_overlay", """SELECT path AS node, count(*) FILTER (WHERE state = 'stale') AS errors, count(*) FILTER (WHERE state = 'unknown') AS warnings FROM {files} LEFT JOIN {mentions} ON source = path GROUP BY path""")(
    lambda m: G.diagnostics_overlay(m["files"].select(F.col("path").alias("node")), m["mentions"].select(F.col("source").alias("node"), F.expr("CASE state WHEN 'stale' THEN 'error' WHEN 'unknown' THEN 'warning' END").alias("severity")))
)
query("concept_query", "SELECT doc_id AS id, lang AS type FROM {documents} WHERE lang IN ('en', 'fr') AND lower(source) = 'src1' AND contains(lower(text), 'the')")(
    lambda m: O.concept_query(m["documents"].select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.array("source").alias("tags"), F.col("text").alias("body")), ("en", "fr"), ("SRC1",), "THE").select("id", "type")
)
query("named_entries", "SELECT DISTINCT 'key' AS entry, event_type AS path, regexp_extract(props, '\\{\"(\\w+)\":', 1) AS value FROM {events} WHERE regexp_matches(props, '\\{\"(\\w+)\":')")(
    lambda m: B.named_entries(m["events"].select(F.col("event_type").alias("path"), F.col("props").alias("text")), "key", r'\{"(\w+)":').distinct()
)

query("coverage_contexts", "SELECT DISTINCT p_brand AS path, CAST(p_size AS BIGINT) AS line, concat('t', p_partkey) AS context FROM {part}")(
    lambda m: I.coverage_py(m["part"].select(F.concat(F.lit('{"files":{"'), "p_brand", F.lit('":{"executed_lines":['), "p_size", F.lit('],"contexts":{"'), "p_size", F.lit('":["t'), "p_partkey", F.lit('"]}}}}')).alias("text"))).distinct()
)
query("coverage_statements", "SELECT DISTINCT p_brand AS path, CAST(p_size AS BIGINT) AS start, CAST(p_size + 2 AS BIGINT) AS \"end\", CAST(p_partkey AS BIGINT) AS hits FROM {part}")(
    lambda m: I.istanbul(m["part"].select(F.concat(F.lit('{"'), "p_brand", F.lit('":{"statementMap":{"0":{"start":{"line":'), "p_size", F.lit(',"column":0},"end":{"line":'), F.col("p_size") + 2, F.lit(',"column":1}}},"s":{"0":'), "p_partkey", F.lit("}}}")).alias("text"))).distinct()
)
query("coverage_functions", "SELECT DISTINCT p_brand AS path, p_name AS name, CAST(p_size AS BIGINT) AS start, CAST(p_size + 9 AS BIGINT) AS \"end\", CAST(p_partkey AS BIGINT) AS hits FROM {part}")(
    lambda m: I.v8_coverage(m["part"].select(F.concat(F.lit('{"result":[{"url":"file:///'), "p_brand", F.lit('","functions":[{"functionName":"'), "p_name", F.lit('","ranges":[{"startOffset":'), "p_size", F.lit(',"endOffset":'), F.col("p_size") + 9, F.lit(',"count":'), "p_partkey", F.lit("}]}]}]}")).alias("text"))).distinct()
)
query("bundle_problems", "SELECT CASE p_size % 4 WHEN 0 THEN 'no subject' WHEN 1 THEN 'no producer' WHEN 2 THEN 'unknown coverage' ELSE 'valid' END AS problem, count(*) AS bundles FROM {part} GROUP BY 1")(
    lambda m: I.checked_bundles(m["part"].select(F.from_json(F.concat(
        F.lit('{"artifact":"provider","subject":{"project":'), F.when(F.col("p_size") % 4 == 0, "null").otherwise('"p"'), F.lit('},"producer":{"name":'), F.when(F.col("p_size") % 4 == 1, "null").otherwise('"x"'),
        F.lit('},"capabilities":[{"domain":"d","coverage":"'), F.when(F.col("p_size") % 4 == 2, "odd").otherwise("partial"), F.lit('"}]}'),
    ), I.BUNDLE).alias("b")).select("b.*")).groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("bundles"))
)
query("float_encodings", "SELECT * FROM (VALUES ('{\"float\":\"+inf\"}', '7ff0000000000000'), ('{\"float\":\"-inf\"}', 'fff0000000000000'), ('{\"float\":\"-0\"}', '8000000000000000'), ('{\"float_bits\":\"3ff0000000000000\"}', '3ff0000000000000'), ('{\"float\":\"what\"}', NULL), ('1.5', '3ff8000000000000')) v(encoded, bits)")(
    lambda m: A.float_bits(m.spark.createDataFrame([(e,) for e in ('{"float":"+inf"}', '{"float":"-inf"}', '{"float":"-0"}', '{"float_bits":"3ff0000000000000"}', '{"float":"what"}', "1.5")], "encoded string"))
)

# --- resolution, configuration, occurrences ---------------------------------------------------
from factweave.operators import resolve as V  # noqa: E402
from factweave.sources import config as N  # noqa: E402

CALLED = """c AS (SELECT concat('f', p_partkey % 97) AS source, 'py' AS family, concat(p_name, p_size % 7) AS name, p_size % 11 = 0 AS method,
    CASE p_size % 13 WHEN 0 THEN 'builtin' WHEN 1 THEN 'imported' WHEN 2 THEN 'local' END AS binding, CASE WHEN p_size % 17 = 0 THEN concat('f', p_partkey % 5) END AS target FROM {part}),
  d AS (SELECT concat('f', p_partkey % 53) AS path, 'py' AS family, concat(p_name, p_size % 7 * 2) AS name, CASE p_size % 5 WHEN 0 THEN 'method' WHEN 1 THEN 'declaration' ELSE 'function' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'local' ELSE 'public' END AS scope FROM {part})"""
query("call_resolution_kinds", f"""WITH {CALLED}, u AS (SELECT * FROM d WHERE kind = 'function'), seen AS (SELECT name, count(DISTINCT path) AS n, min(path) AS one FROM u WHERE scope <> 'local' GROUP BY name),
  own AS (SELECT name, path AS source, bool_and(scope = 'local') AS hidden FROM u GROUP BY 1, 2),
  f AS (SELECT source, name, count(*) AS occurrences, CASE WHEN count(DISTINCT target) = 1 AND count(target) = count(*) THEN min(target) END AS exact,
    bool_or(coalesce(binding = 'builtin', false)) AS b, bool_or(coalesce(binding = 'local', false)) AS l, bool_or(coalesce(binding = 'imported', false)) AS i FROM c WHERE NOT method GROUP BY 1, 2),
  j AS (SELECT f.*, coalesce(seen.n, 0) + CASE WHEN coalesce(own.hidden, false) THEN 1 ELSE 0 END AS n, CASE WHEN coalesce(own.hidden, false) THEN f.source ELSE one END AS sole, f.name IN ('red bolt1', 'red bolt2') AS known, f.name = 'hot gear3' AS outer_
    FROM f LEFT JOIN seen ON seen.name = f.name LEFT JOIN own ON own.name = f.name AND own.source = f.source),
  k AS (SELECT *, CASE WHEN exact IS NOT NULL THEN 'unique' WHEN b AND NOT l AND NOT i THEN 'builtin' WHEN b OR l THEN 'unresolved' WHEN known AND NOT i AND n > 0 THEN 'unresolved' WHEN n = 0 AND known THEN 'builtin' WHEN n = 0 AND outer_ THEN 'external'
    WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND NOT i AND sole = source THEN 'unique' WHEN n = 1 THEN 'candidate' ELSE 'unresolved' END AS kind FROM j)
  SELECT source, name, kind, occurrences, CASE WHEN exact IS NOT NULL THEN 1 ELSE n END AS candidates, CASE WHEN exact IS NOT NULL THEN exact WHEN kind = 'external' THEN 'gears' WHEN kind = 'unique' THEN sole END AS target FROM k
  UNION ALL SELECT source, name, 'method', count(*), 0, NULL FROM c WHERE method GROUP BY 1, 2""")(
    lambda m: V.call_resolutions(m.spark.sql(f"WITH {CALLED} SELECT * FROM c", part=m["part"]), m.spark.sql(f"WITH {CALLED} SELECT * FROM d", part=m["part"]), {"py": ("red bolt1", "red bolt2")}, {"hot gear3": "gears"})
)
IMPORTED = """i AS (SELECT DISTINCT concat('d', p_size % 5, '/', p_brand, '.py') AS source, concat('d', p_size % 5) AS dir, CASE p_size % 4 WHEN 0 THEN concat('./m', p_partkey % 50) WHEN 1 THEN concat('../d', p_size % 3, '/m', p_partkey % 50) WHEN 2 THEN concat('m', p_partkey % 50) ELSE concat('../../m', p_partkey % 50) END AS module FROM {part}),
  s AS (SELECT DISTINCT concat(CASE WHEN p_size % 6 = 0 THEN 'src' ELSE concat('d', p_size % 4) END, '/m', p_partkey % 40, CASE WHEN p_size % 2 = 0 THEN '.py' ELSE '/__init__.py' END) AS path FROM {part})"""
query("import_files", f"""WITH {IMPORTED}, t AS (SELECT source, module, 1 AS place, concat(dir, '/', module) AS path, 'beside' AS how FROM i WHERE module NOT LIKE '.%' UNION ALL SELECT source, module, 3, concat('src/', module), 'root:src' FROM i WHERE module NOT LIKE '.%'
    UNION ALL SELECT source, module, 1, concat(dir, '/', substr(module, 3)), 'relative' FROM i WHERE module LIKE './%' UNION ALL SELECT source, module, 1, substr(module, 4), 'relative' FROM i WHERE module LIKE '../d%'),
  x AS (SELECT t.source, t.module, s.path, how, row_number() OVER (PARTITION BY t.source, t.module ORDER BY place + CASE WHEN s.path LIKE '%.py' AND s.path NOT LIKE '%/__init__.py' THEN 0 ELSE 1 END) AS n FROM t JOIN s ON s.path IN (concat(t.path, '.py'), concat(t.path, '/__init__.py')))
  SELECT i.source, i.module, x.path AS target, x.how FROM i LEFT JOIN x ON x.source = i.source AND x.module = i.module AND n = 1""")(
    lambda m: V.import_files(m.spark.sql(f"WITH {IMPORTED} SELECT * FROM i", part=m["part"]), m.spark.sql(f"WITH {IMPORTED} SELECT * FROM s", part=m["part"]), ("src",), (".py", "/__init__.py"))
)
query("index_states", """WITH sp AS (SELECT DISTINCT concat('i/', p_brand) AS path, CASE p_size % 2 WHEN 0 THEN 'scip' ELSE 'lsif' END AS format, p_brand < 'Brand#3' AS required FROM {part}), f AS (SELECT DISTINCT concat('i/', p_brand) AS path FROM {part} WHERE p_brand <> 'Brand#11'), r AS (SELECT DISTINCT concat('i/', p_brand) AS path FROM {part} WHERE p_brand LIKE '%2')
  SELECT sp.path, format, CASE WHEN f.path IS NULL THEN 'missing-index' WHEN r.path IS NULL OR format <> 'scip' THEN 'index-provider-unavailable' ELSE 'ok' END AS status, CASE WHEN f.path IS NOT NULL AND r.path IS NOT NULL AND format = 'scip' THEN NULL WHEN required THEN 'error' ELSE 'warning' END AS severity
  FROM sp LEFT JOIN f ON f.path = sp.path LEFT JOIN r ON r.path = sp.path""")(
    lambda m: (lambda p: V.index_states(p.select("path", F.when(F.col("p_size") % 2 == 0, "scip").otherwise("lsif").alias("format"), (F.col("p_brand") < "Brand#3").alias("required")).distinct(), p.where("p_brand <> 'Brand#11'"), p.where("p_brand like '%2'").select("path", F.lit("scip").alias("format"))))(m["part"].withColumn("path", F.concat(F.lit("i/"), "p_brand")))
)
query("observation_applicability", """WITH n AS (SELECT DISTINCT concat('c', p_partkey % 200) AS "case", CASE WHEN p_size % 9 = 0 THEN NULL ELSE concat('k', p_size % 9) END AS capability FROM {part}), k AS (SELECT DISTINCT n_name AS route, concat('k', (n_nationkey * 3 + v) % 11) AS capability FROM {nation} CROSS JOIN (VALUES (0), (1), (2), (5), (7)) t(v)),
  e AS (SELECT DISTINCT "case", n_name AS route FROM n CROSS JOIN {nation}), l AS (SELECT e."case", e.route, n.capability FROM e JOIN n ON n."case" = e."case" AND n.capability IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.route = e.route AND k.capability = n.capability))
  SELECT e."case", e.route, count(l.capability) = 0 AS applicable, coalesce(string_agg(l.capability, ',' ORDER BY l.capability), '') AS lacking FROM e LEFT JOIN l ON l."case" = e."case" AND l.route = e.route GROUP BY 1, 2""")(
    lambda m: V.applicability(
        m["part"].select(F.concat(F.lit("c"), F.col("p_partkey") % 200).alias("case"), F.when(F.col("p_size") % 9 != 0, F.concat(F.lit("k"), F.col("p_size") % 9)).alias("capability")), m["nation"].select(F.col("n_name").alias("route")),
        m["nation"].select(F.col("n_name").alias("route"), F.explode(F.array(*[F.concat(F.lit("k"), (F.col("n_nationkey") * 3 + v) % 11) for v in (0, 1, 2, 5, 7)])).alias("capability")),
    )
)
query("config_inferred", """WITH b AS (SELECT DISTINCT p_brand AS brand FROM {part}) SELECT 'layer' AS kind, brand AS name, concat(brand, '/**') AS pattern, 'folders' AS origin FROM b UNION ALL SELECT 'package', concat('p', brand), concat(brand, '/**'), concat(brand, '/package.json') FROM b
  UNION ALL SELECT 'build', 'make', concat(brand, '/**'), concat(brand, '/Makefile') FROM b UNION ALL SELECT 'build', 'script:go', concat(brand, '/**'), concat(brand, '/package.json') FROM b UNION ALL SELECT 'tests', concat(brand, '/tests'), concat(brand, '/tests/*'), 'folders' FROM b""")(
    lambda m: (lambda b: N.infer(b.select(F.explode(F.array(
        *[F.struct(F.concat("p_brand", F.lit(n)).alias("path"), t.alias("text")) for n, t in (("/a.py", F.lit("")), ("/x/b.c", F.lit("")), ("/tests/test_a.py", F.lit("")), ("/Makefile", F.lit("")), ("/notes.md", F.lit("")), ("/package.json", F.concat(F.lit('{"name":"p'), "p_brand", F.lit('","scripts":{"go":"make"}}'))))]
    )).alias("f")).select("f.*")))(m["part"].select("p_brand").distinct())
)
query("layered_ignore", """SELECT path, (id LIKE '%7' AND id NOT LIKE '%77') OR (source LIKE '%7' AND source NOT LIKE '%77') OR (source = 'src2' AND lang = 'fr') OR (source = 'src3' AND (lang = 'de' OR (lang = 'en' AND id LIKE '%1'))) AS ignored
  FROM (SELECT concat(source, '/', lang, '/', doc_id) AS path, source, lang, CAST(doc_id AS VARCHAR) AS id FROM {documents})""")(
    lambda m: m["inventory"].select("path", P.layered_ignore(F.col("path"), [("src3", ["de/", "/en/*1"]), ("", ["# rules", "*7", "!*77", "/src2/fr/", "!/src2/fr/1*"])]).alias("ignored"))
)
query("lexical_occurrences", """WITH p AS (SELECT concat('b/', p_partkey, '.py') AS path, replace(p_name, ' ', '_') AS fn FROM {part}) SELECT path, 'call' AS domain, fn AS name, 12 AS start, 12 + length(fn) AS "end" FROM p
  UNION ALL SELECT path, 'string', '"a(b) # c"', 13 + length(fn), 23 + length(fn) FROM p""")(
    lambda m: L.occurrences(m["part"].select(F.concat(F.lit("b/"), "p_partkey", F.lit(".py")).alias("path"), F.concat(F.lit("# no(1)\nv = "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit('("a(b) # c")\ndef f(x):\n    if (x): pass\n')).alias("text")))
)
query("python_facts", """SELECT concat('b/', p_partkey, '.py') AS path, domain, CASE name WHEN '?' THEN replace(p_name, ' ', '_') ELSE name END AS name, CASE kind WHEN '?' THEN replace(p_name, ' ', '_') ELSE kind END AS kind, line, last AS "end"
  FROM {part} CROSS JOIN (VALUES ('import', 'os', 'module', 1, 1), ('import', '.a:b', 'from', 2, 2), ('constant', 'LIMIT', 'int', 3, 3), ('declaration', '?', 'function', 5, 6), ('decorator', 'x.wrap', '?', 4, 4), ('call', 'x.wrap', 'method', 4, 4), ('call', 'go', 'free', 6, 6)) v(domain, name, kind, line, last)""")(
    lambda m: I.python_facts(m["part"].select(F.concat(F.lit("b/"), "p_partkey", F.lit(".py")).alias("path"), F.concat(F.lit("import os\nfrom .a import b\nLIMIT = 3\n@x.wrap(1)\ndef "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("():\n    return go(2)\n")).alias("text")))
)


def _texts(m: Bound, text: Column, path: Column | None = None) -> DataFrame:
    return m["part"].select((path if path is not None else F.concat(F.lit("b/"), "p_partkey")).alias("path"), text.alias("text"))


query("package_dependencies", """SELECT concat('b/', p_partkey) AS path, p_name AS name, '1.0' AS version, s AS scope, d AS dependency, r AS requirement FROM {part} CROSS JOIN (VALUES ('runtime', 'x', '^1'), ('dev', 'y', '*')) v(s, d, r)""")(
    lambda m: I.package_json(_texts(m, F.concat(F.lit('{"name":"'), "p_name", F.lit('","version":"1.0","dependencies":{"x":"^1"},"devDependencies":{"y":"*"}}'))))
)
query("requirement_lines", "SELECT concat('b/', p_partkey) AS path, replace(p_name, ' ', '-') AS dependency, concat('>=', p_size) AS requirement FROM {part}")(
    lambda m: I.requirements(_texts(m, F.concat(F.lit("# none\n\n"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" >="), "p_size")))
)
query("description_fields", "SELECT concat('b/', p_partkey) AS path, f AS field, CASE f WHEN 'Package' THEN p_name ELSE concat('a, ', p_size) END AS value FROM {part} CROSS JOIN (VALUES ('Package'), ('Imports')) v(f)")(
    lambda m: I.description_fields(_texts(m, F.concat(F.lit("Package: "), "p_name", F.lit("\nImports: a,\n    "), "p_size")))
)
query("script_builds", "SELECT concat('b/', p_partkey) AS path, 'go' AS build, concat('make ', p_size) AS command FROM {part}")(lambda m: B.script_builds(_texts(m, F.concat(F.lit('{"scripts":{"go":"make '), "p_size", F.lit('"}}')))))
query("cmake_targets", "SELECT concat('b/', p_partkey) AS path, concat('t', p_size) AS build, 'library' AS kind, i AS input FROM {part} CROSS JOIN (VALUES ('a.c'), ('b.c')) v(i)")(
    lambda m: B.cmake_targets(_texts(m, F.concat(F.lit("add_library(t"), "p_size", F.lit(" STATIC a.c\n  b.c)"))))
)
query("config_sections", "SELECT concat('b/', p_partkey) AS path, 'tool.x' AS section, 'size' AS key, CAST(p_size AS VARCHAR) AS value FROM {part}")(lambda m: B.sections(_texts(m, F.concat(F.lit("[tool.x]\nsize = "), "p_size", F.lit("\n# end\n")))))
query("coverage_gcov", "SELECT p_brand AS path, CAST(p_size AS BIGINT) AS line, CAST(p_partkey AS BIGINT) AS hits FROM {part}")(
    lambda m: B.gcov(_texts(m, F.concat(F.lit('{"files":[{"file":"'), "p_brand", F.lit('","lines":[{"line_number":'), "p_size", F.lit(',"count":'), "p_partkey", F.lit("}]}]}"))))
)
query("coverage_llvm", "SELECT p_brand AS path, CAST(p_size AS BIGINT) AS line, CAST(p_partkey AS BIGINT) AS hits FROM {part}")(
    lambda m: B.llvm_cov(_texts(m, F.concat(F.lit('{"data":[{"files":[{"filename":"'), "p_brand", F.lit('","segments":[['), "p_size", F.lit(",1,"), "p_partkey", F.lit(",true,true]]}]}]}"))))
)
query("observed_tests", """WITH l AS (SELECT DISTINCT p_brand AS path, p_size AS line, concat('t', p_partkey % 30) AS context FROM {part}), d AS (SELECT DISTINCT p_brand AS path, concat('fn', p_size % 10) AS name, p_size % 10 * 5 AS s, p_size % 10 * 5 + 4 AS e FROM {part})
  SELECT DISTINCT context, l.path, name FROM l JOIN d ON d.path = l.path AND s <= line AND line < e""")(
    lambda m: I.observed_tests(
        m["part"].select(F.col("p_brand").alias("path"), F.col("p_size").alias("line"), F.concat(F.lit("t"), F.col("p_partkey") % 30).alias("context")).distinct(),
        m["part"].select(F.col("p_brand").alias("path"), F.concat(F.lit("fn"), F.col("p_size") % 10).alias("name"), (F.col("p_size") % 10 * 5).alias("start"), (F.col("p_size") % 10 * 5 + 4).alias("end")).distinct(),
    )
)
BUNDLED = """concat('{"mode":1,"producer":{"name":"', p_type, '"},"capabilities":[{"domain":"text","coverage":"partial","claims":["a","b"]}],"facts":[{"domain":"text","claim":"lexical-occurrence","path":"', p_brand, '","name":"', p_name, '"}]}')"""
query("bundle_facts", "SELECT p_type AS provider, 1 AS mode, 'text' AS domain, p_brand AS path, p_name AS name, 'lexical-occurrence' AS claim FROM {part}")(
    lambda m: I.facts_of(m["part"].select(F.from_json(F.expr(BUNDLED), I.BUNDLE).alias("b")).select("b.*")).select("provider", "mode", "domain", "path", "name", "claim")
)
query("bundle_capabilities", "SELECT p_type AS provider, 'text' AS domain, 'partial' AS coverage, 2 AS claims, count(*) AS n FROM {part} GROUP BY p_type")(
    lambda m: I.capabilities_of(m["part"].select(F.from_json(F.expr(BUNDLED), I.BUNDLE).alias("b")).select("b.*")).groupBy("provider", "domain", "coverage", F.size("claims").alias("claims")).agg(F.count("*").alias("n"))
)
query("manifest_rows", "SELECT p_type AS project, concat('f', p_partkey) AS path, CAST(p_size AS BIGINT) AS bytes, 'c' AS language FROM {part}")(
    lambda m: I.files_of(m["part"].select(F.from_json(F.concat(F.lit('{"project":"'), "p_type", F.lit('","files":[{"path":"f'), "p_partkey", F.lit('","bytes":'), "p_size", F.lit(',"language":"c"}]}')), I.MANIFEST).alias("x")).select("x.*")).select("project", "path", "bytes", "language")
)
query("correlation_keys", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('span:', p_size, '-', p_size + 1) ELSE concat('key:', p_name) END AS grp FROM {part}")(
    lambda m: m["part"].select("p_partkey", M.correlation(F.col("p_size") % 2 == 0, F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + 1), F.col("p_name")).alias("grp"))
)
query("ulp_steps", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS steps, CAST(p_size + 1 AS DOUBLE) AS around FROM {part}")(
    lambda m: m["part"].select("p_partkey", A.ulp_distance(F.lit(1.0), 1.0 + F.col("p_size") * F.lit(2.0**-52)).alias("steps"), A.ulp_distance(F.lit(-5e-324), F.col("p_size") * F.lit(5e-324)).alias("around"))
)
query("plan_projections", "SELECT * FROM (VALUES ('component_routes', 'components'), ('component_routes', 'mapped_paths'), ('symbol_search', 'search_domain'), ('symbol_search', 'symbol_entities')) v(request, projection)")(
    lambda m: m.spark.createDataFrame([(n, p) for n, r in (("component_routes", Q.QueryRequest(paths=("a",), components=("b",))), ("symbol_search", Q.QueryRequest(symbols=("x",), search="y"))) for p in r.projections()], "request string, projection string")
)
query("symbol_relation_hops", """WITH RECURSIVE e AS (SELECT DISTINCT concat('s/', source) AS source, concat('s/', target) AS target FROM {arcs} WHERE kind = 'call'), r AS (SELECT 's/p/700' AS node, 0 AS d UNION SELECT e.target, d + 1 FROM r JOIN e ON e.source = r.node WHERE d < 6)
  SELECT node, min(d) AS distance FROM r GROUP BY node""")(
    lambda m: T.routes(_seed(m, "s/p/700"), m["arcs"].where("kind = 'call'").select(F.concat(F.lit("s/"), "source").alias("source"), F.concat(F.lit("s/"), "target").alias("target"), "state", "resolution"), 6).select("node", "distance")
)
query("freshness_ladder", """WITH w(x) AS (VALUES ('same'), ('changed'), ('unknown')) SELECT p.v AS same_project, s.x AS source, c.x AS config, o.x AS producer, d.x AS discovery,
  CASE WHEN NOT p.v THEN 'not-applicable' WHEN s.x = 'changed' OR c.x = 'changed' THEN 'stale' WHEN o.x = 'changed' OR d.x = 'changed' THEN 'context-drift' WHEN c.x = 'unknown' OR o.x = 'unknown' OR d.x = 'unknown' THEN 'unknown' ELSE 'current' END AS status
  FROM (VALUES (true), (false)) p(v), w s, w c, w o, w d""")(
    lambda m: m.spark.sql("WITH w(x) AS (VALUES ('same'), ('changed'), ('unknown')) SELECT p.v AS same_project, s.x AS source, c.x AS config, o.x AS producer, d.x AS discovery FROM (VALUES (true), (false)) p(v), w s, w c, w o, w d").withColumn(
        "status", D.freshness_status(F.col("same_project"), F.col("source"), F.col("config"), F.col("producer"), F.col("discovery"))
    )
)
query("unified_diffs", "SELECT p_brand AS path, concat('--- a/', p_brand, chr(10), '+++ b/', p_brand, chr(10), '@@ -1,2 +1,2 @@', chr(10), ' x', chr(10), '-', p_type, chr(10), '+', p_name) AS diff FROM (SELECT DISTINCT p_brand, p_type, p_name FROM {part})")(
    lambda m: O.unified_diff(m["part"].select(F.col("p_brand").alias("path"), F.concat(F.lit("x\n"), "p_type").alias("before"), F.concat(F.lit("x\n"), "p_name").alias("after")).distinct())
)


def _report(m: Bound, *texts: str) -> DataFrame:
    return m.spark.createDataFrame([(t,) for t in texts], "report string")


query("report_markdown", "SELECT concat('# Regions', chr(10), chr(10), '| key | name |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', r_regionkey, ' | ', r_name, ' |'), chr(10) ORDER BY r_regionkey), chr(10)) AS report FROM {region}")(
    lambda m: _report(m, O.markdown(m["region"].select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), "Regions"))
)
query("report_sarif", """SELECT concat('{"runs": [{"results": [', string_agg(concat('{"level": "error", "message": {"text": "missing: ', r_name, '"}, "ruleId": "C"}'), ', ' ORDER BY r_name), '], "tool": {"driver": {"name": "factweave", "rules": [{"id": "C"}]}}}], "version": "2.1.0"}') AS report FROM {region}""")(
    lambda m: _report(m, O.sarif(m["region"].select(F.lit("C").alias("check"), F.lit("missing").alias("comparison"), F.col("r_name").alias("key"), F.lit("current").alias("state"))))
)
query("report_junit", """SELECT concat('<testsuite name="verification" tests="', count(*), '" failures="', count(*) FILTER (WHERE r_regionkey = 0), '">', string_agg(concat('<testcase name="', r_name, '">', CASE r_regionkey WHEN 0 THEN '<failure message="fail"/>' WHEN 1 THEN '<error message="unknown"/>' ELSE '' END, '</testcase>'), '' ORDER BY r_name), '</testsuite>') AS report FROM {region}""")(
    lambda m: _report(m, O.junit(m["region"].select(F.col("r_name").alias("check"), F.expr("CASE r_regionkey WHEN 0 THEN 'fail' WHEN 1 THEN 'unknown' ELSE 'pass' END").alias("status"))))
)
query("report_mermaid", """WITH n AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i FROM {region}) SELECT concat('flowchart LR', chr(10), string_agg(concat('  n', i, '["', r_name, '"]'), chr(10) ORDER BY i), chr(10), string_agg(concat('  n', i, ' -->|self| n', i), chr(10) ORDER BY r_name), chr(10)) AS report FROM n""")(
    lambda m: _report(m, O.mermaid(m["region"].select(F.col("r_name").alias("node")), m["region"].select(F.lit("self").alias("family"), F.col("r_name").alias("source"), F.col("r_name").alias("target"))))
)
query("report_graph_json", """SELECT concat('{"nodes":[', string_agg(concat('{"kind":"region","node":"', r_name, '"}'), ',' ORDER BY r_name), '],"relations":[', string_agg(concat('{"more_names":1,"names":["a","b"],"source":"', r_name, '"}'), ',' ORDER BY r_name), ']}') AS report FROM {region}""")(
    lambda m: _report(m, O.graph_json(m["region"].select(F.col("r_name").alias("node"), F.lit("region").alias("kind")), m["region"].select(F.col("r_name").alias("source"), F.array(F.lit("c"), F.lit("a"), F.lit("b")).alias("names")), 2))
)
query("canonical_json_nested", """SELECT json, sha256(json) AS sha256 FROM (SELECT concat('{"a":{"x":', p_size, ',"y":{"k":1,"z":2}},"b":"', p_name, '"}') AS json FROM {part})""")(
    lambda m: O.canonical_json(m["part"].select(F.col("p_name").alias("b"), F.struct(F.create_map(F.lit("z"), F.lit(2), F.lit("k"), F.lit(1)).alias("y"), F.col("p_size").alias("x")).alias("a")))
)

# --- the Map as a whole -----------------------------------------------------------------------
from factweave.operators import build as W  # noqa: E402


def _facts(m: Bound) -> W.Facts:
    def sql(ctes: str, body: str) -> DataFrame:
        return m.spark.sql(f"WITH {ctes} {body}", part=m["part"])

    files = sql(IMPORTED, "SELECT path, CASE WHEN path LIKE 'src%' THEN 'src' END AS layer FROM s UNION ALL SELECT concat('f', p_partkey % 53), 'flat' FROM {part}").distinct()
    return W.Facts(
        files=files, definitions=sql(CALLED, "SELECT * FROM d"), calls=sql(CALLED, "SELECT * FROM c"), imports=sql(IMPORTED, "SELECT source, module FROM i"), uses=sql(CALLED, "SELECT source, name FROM c WHERE method"),
        packages=sql(IMPORTED, "SELECT DISTINCT 'own' AS package, module AS dependency FROM i WHERE module LIKE 'm1%'"), artifacts=m["part"].select(F.lit("a").alias("artifact"), F.lit("input").alias("role"), F.concat(F.lit("f"), F.col("p_partkey") % 60).alias("path")),
        roots=("src",), suffixes=(".py", "/__init__.py"), builtins={"py": ("red bolt1", "red bolt2")}, namespaces={"hot gear3": "gears"},
    )


_IMPORT_SQL, _CALL_SQL = _SQL["import_files"], _SQL["call_resolution_kinds"]
query("map_edges", f"""SELECT source, kind, target, string_agg(DISTINCT name, ',' ORDER BY name) AS names, CASE max(CASE state WHEN 'current' THEN 2 ELSE 1 END) WHEN 2 THEN 'current' ELSE 'unknown' END AS state FROM (
    SELECT source, 'import' AS kind, target, module AS name, 'current' AS state FROM ({_IMPORT_SQL}) a WHERE target IS NOT NULL AND target <> source
    UNION ALL SELECT source, 'external', concat('package:', module), module, 'current' FROM ({_IMPORT_SQL}) b WHERE target IS NULL AND module LIKE 'm1%'
    UNION ALL SELECT source, CASE kind WHEN 'unique' THEN 'call' ELSE 'external-call' END, CASE kind WHEN 'unique' THEN target ELSE concat('package:', target) END, name, 'current' FROM ({_CALL_SQL}) e WHERE (kind = 'unique' AND target <> source) OR kind = 'external'
    UNION ALL SELECT u.source, 'reference', x.path, u.name, CASE WHEN min(n) OVER (PARTITION BY u.source, x.path) = 1 THEN 'current' ELSE 'unknown' END
      FROM (WITH {CALLED} SELECT DISTINCT source, name FROM c WHERE method) u JOIN (WITH {CALLED} SELECT DISTINCT name, path, count(*) OVER (PARTITION BY name) AS n FROM (SELECT DISTINCT name, path FROM d)) x ON x.name = u.name WHERE u.source <> x.path) t
  GROUP BY source, kind, target""")(lambda m: W.build_map(_facts(m))["edges"].withColumn("names", F.array_join("names", ",")))
query("map_diagnostics", f"""SELECT 'warning' AS severity, 'file-without-layer' AS code, path AS key FROM (WITH {IMPORTED} SELECT path FROM s) x WHERE path NOT LIKE 'src%'
  UNION ALL SELECT DISTINCT 'error', 'missing-artifact-file', concat('f', p_partkey % 60) FROM {{part}} WHERE p_partkey % 60 >= 53""")(lambda m: W.build_map(_facts(m))["diagnostics"])

# --- semantic indexes -------------------------------------------------------------------------
from factweave.sources import indexes as Y  # noqa: E402

#: Two documents: a.py defines x#f at 1:4-5 and b.py reads it at 2:0 to 3:1.
_INDEX = bytes.fromhex("121c" "0a04612e7079" "120c" "0a03010405" "1203782366" "1801" "2206707974686f6e" "1213" "0a04622e7079" "120b" "0a0402000301" "1203782366")
query("scip_occurrences", "SELECT * FROM (VALUES ('a.py', 'python', 'x#f', 'definition', 1, 4, 1, 5, NULL), ('b.py', '', 'x#f', 'reference', 2, 0, 3, 1, NULL), ('bad', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'cut off')) v(path, language, symbol, roles, line, start, end_line, \"end\", problem)")(
    lambda m: Y.scip(m["region"].select(F.when(F.col("r_regionkey") == 0, "bad").otherwise("good").alias("path"), F.when(F.col("r_regionkey") == 0, F.lit(bytearray(_INDEX[:20]))).otherwise(F.lit(bytearray(_INDEX))).alias("content")).distinct())
)
query("structural_matches", "SELECT concat('b/', p_partkey) AS path, 'r1' AS rule, 'Python' AS language, p_name AS text, CAST(p_size AS BIGINT) AS line, CAST(10 AS BIGINT) AS start, CAST(10 + length(p_name) AS BIGINT) AS \"end\" FROM {part}")(
    lambda m: Y.structural_matches(_texts(m, F.concat(F.lit('[{"file":"b/'), "p_partkey", F.lit('","ruleId":"r1","language":"Python","text":"'), "p_name", F.lit('","range":{"byteOffset":{"start":10,"end":'), 10 + F.length("p_name"), F.lit('},"start":{"line":'), "p_size", F.lit(',"column":0},"end":{"line":9,"column":1}}}]'))))
)

query("macro_members_literal", """WITH x AS (SELECT *, text NOT LIKE '%3' AS literal FROM {macros}) SELECT m.text AS key, CASE WHEN bool_and(m.literal) THEN 'current' ELSE 'unknown' END AS state
  FROM x m JOIN (SELECT DISTINCT path, invocation FROM x WHERE arg = 0 AND text = 'u7') s ON s.path = m.path AND s.invocation = m.invocation WHERE m.arg >= 1 AND m.call = 'EMIT' GROUP BY m.text""")(
    lambda m: S.macro_members({"macros": m["macros"].withColumn("literal", ~F.col("text").like("%3"))}, "EMIT", "u7")
)
query("provider_surface_witness", f"""WITH {SURFACE}, w AS (SELECT name AS key, bool_and(provider <> 'SMALL') AS sure FROM {{surface}} GROUP BY name) SELECT sf.*, CASE WHEN sure THEN 'current' ELSE 'unknown' END AS state FROM sf JOIN w ON w.key = sf.key""")(
    lambda m: S.provider_surface({"surface": m["surface"].withColumn("witnessed", F.col("provider") != "SMALL")})
)

query("path_endpoint_kinds", """WITH n AS (SELECT DISTINCT kind, key AS node, CASE kind WHEN 'file' THEN replace(key, 'n/', '') END AS label FROM (SELECT 'file' AS kind, path AS key FROM {files} UNION ALL SELECT 'component', component FROM {component_files} UNION ALL SELECT 'package', package FROM {entrypoints}) t)
  SELECT v.pattern, count(n.node) AS matches, CASE count(n.node) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM (VALUES ('ASIA'), ('component:ASIA'), ('=NATION_3'), ('@n/NATION_4'), ('file:n/NATION_1*')) v(pattern)
  LEFT JOIN n ON CASE v.pattern WHEN 'ASIA' THEN node = 'ASIA' WHEN 'component:ASIA' THEN kind = 'component' AND node = 'ASIA' WHEN '=NATION_3' THEN label = 'NATION_3' WHEN '@n/NATION_4' THEN node = 'n/NATION_4' ELSE kind = 'file' AND node LIKE 'n/NATION\\_1%' ESCAPE '\\' END GROUP BY v.pattern""")(
    lambda m: K.endpoints(S.search_domain(m).where("kind in ('file', 'component', 'package')").select("kind", F.col("key").alias("node"), F.when(F.col("kind") == "file", F.replace("key", F.lit("n/"), F.lit(""))).alias("label")), ("ASIA", "component:ASIA", "=NATION_3", "@n/NATION_4", "file:n/NATION_1*"))
)


def _component_path(m: Bound) -> DataFrame:
    """Paths between components, over edges lifted to them."""
    edges = G.at_level(G.relations(m["edges"].withColumn("kind", F.lit("import"))), m["component_files"]).where("source is not null")
    return T.shortest_paths(_seed(m, "ASIA"), _seed(m, "odd"), edges, depth=3)


query("path_component_level", f"""WITH e AS ({EDGES}), o AS (SELECT DISTINCT component, path FROM {{component_files}}), c AS (SELECT DISTINCT coalesce(x.component, source) AS s, coalesce(y.component, target) AS t, max(r) AS r FROM e LEFT JOIN o x ON x.path = source LEFT JOIN o y ON y.path = target GROUP BY 1, 2)
  SELECT 'ASIA,odd' AS nodes, 1 AS length, r = 2 AS proven FROM c WHERE s = 'ASIA' AND t = 'odd'""")(lambda m: _component_path(m).withColumn("nodes", F.array_join("nodes", ",")))
