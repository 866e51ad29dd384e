"""The select operators: sets, values, relations and graphs from the tables of a Map.

A Map is a dict of DataFrames (see ``sources.bindings.TABLES``). Every function returns lazily and
keeps a ``state``; set and value items have ``key`` (and ``value``), relations ``source``, ``kind``
and ``target``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.functions.text import strip_affixes
from factweave.operators.traverse import closure
from factweave.plans.evidence import CURRENT, UNKNOWN, best_state, collide

Map = dict[str, DataFrame]
ROLES = ("declaration", "binding", "import", "export", "reference")


def normalised(df: DataFrame, key: Column, strip_prefix: str = "", strip_suffix: str = "", include: tuple = (), exclude: tuple = ()) -> DataFrame:
    """``key`` with affixes stripped, then kept by include and dropped by exclude globs."""
    out = df.withColumn("key", strip_affixes(key, strip_prefix, strip_suffix))
    if include:
        out = out.where(P.globs(F.col("key"), include))
    if exclude:
        out = out.where(~P.globs(F.col("key"), exclude))
    return out


def _current(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*columns, F.lit(CURRENT).alias("state"))


def _relation(df: DataFrame, source: str, kind: str | Column, target: str) -> DataFrame:
    what = F.lit(kind) if isinstance(kind, str) else kind
    return _current(df.select(F.col(source).alias("source"), what.alias("kind"), F.col(target).alias("target")).distinct(), F.col("source"), F.col("kind"), F.col("target"))


def artifact_routes(m: Map, artifacts: tuple = ()) -> DataFrame:
    return _relation(m["artifacts"].where(P.among(F.col("artifact"), artifacts)), "artifact", F.col("role"), "path")


def build_routes(m: Map, builds: tuple = ()) -> DataFrame:
    return _relation(m["builds"].where(P.among(F.col("build"), builds)), "build", "path", "path")


def _edge_filter(edges: DataFrame, kinds: tuple = (), kind_patterns: tuple = (), name_patterns: tuple = (), from_paths: tuple = (), to_paths: tuple = ()) -> DataFrame:
    keep = P.among(F.col("kind"), kinds) & P.selectors(F.col("source"), from_paths) & P.selectors(F.col("target"), to_paths)
    if kind_patterns:
        keep = keep & P.globs(F.col("kind"), kind_patterns)
    if name_patterns:
        keep = keep & F.exists("names", lambda n: P.globs(n, name_patterns))
    return edges.where(keep)


def file_edges(m: Map, **filters) -> DataFrame:
    return _edge_filter(m["edges"], **filters).select("source", "kind", "target", "state")


def component_edges(m: Map, **filters) -> DataFrame:
    """File edges lifted through the many-to-many membership, inner pairs dropped.

    A target without component is kept raw if the edge is not current, as it may yet get one.
    """
    edges = _edge_filter(m["edges"], **filters)
    member = m["component_files"].select("component", "path")
    left = edges.join(member.toDF("from_component", "source"), "source")
    lifted = left.join(member.toDF("to_component", "target"), "target", "left")
    target = F.coalesce("to_component", F.when(F.col("state") != CURRENT, F.col("target")))
    pairs = lifted.withColumn("to", target).where("`to` is not null and from_component <> `to`")
    return pairs.groupBy(F.col("from_component").alias("source"), "kind", F.col("to").alias("target")).agg(best_state().alias("state"))


def component_membership(m: Map, **normal) -> DataFrame:
    counts = m["component_files"].groupBy("path").agg(F.countDistinct("component").alias("n"))
    joined = m["files"].join(counts, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    how = F.when(F.col("n") == 0, "unassigned").when(F.col("n") == 1, "exclusive").otherwise("overlap")
    out = normalised(joined, F.col("path"), **normal)
    return _current(out, F.col("key"), F.col("n").alias("value"), how.alias("membership"), F.col("language"), F.col("layer"), F.col("bytes"), F.col("symbol_count"))


def components(m: Map, names: tuple = ()) -> DataFrame:
    return _current(m["component_files"].select(F.col("component").alias("key")).distinct().where(P.among(F.col("key"), names)), F.col("key"))


def constant_memberships(m: Map, container: str, paths: tuple = (), **normal) -> DataFrame:
    rows = m["constants"].where((F.col("container") == container) & (F.col("kind") != "class-collection") & P.selectors(F.col("path"), paths))
    return collide(_current(normalised(rows, F.col("name"), **normal).select("key", "path", "value").distinct(), F.col("key")), "key")


def constant_values(m: Map, container: str, kinds: tuple = (), paths: tuple = (), **normal) -> DataFrame:
    """Static rows have values; others are unknown."""
    rows = m["constants"].where((F.col("container") == container) & P.among(F.col("kind"), kinds) & P.selectors(F.col("path"), paths))
    out = normalised(rows, F.col("name"), **normal).select("key", F.when(F.col("static"), F.col("value")).alias("value"), F.when(F.col("static"), CURRENT).otherwise(UNKNOWN).alias("state"))
    return collide(out, "key", "value")


def file_metrics(m: Map, **normal) -> DataFrame:
    return _current(normalised(m["files"], F.col("path"), **normal), F.col("key"), F.col("bytes").alias("value"))


def inventory_paths(m: Map, **normal) -> DataFrame:
    return _current(normalised(m["inventory"], F.col("path"), **normal), F.col("key"))


def mapped_paths(m: Map, paths: tuple = (), **normal) -> DataFrame:
    return _current(normalised(m["files"].where(P.selectors(F.col("path"), paths)), F.col("path"), **normal), F.col("key"))


def macro_members(m: Map, call: str, selector: str, selector_argument: int = 0, values_from_argument: int = 1, paths: tuple = ()) -> DataFrame:
    """Arguments of the invocations whose selecting argument has a value; one shuffle for both.

    Where macros say which arguments are literals (``literal``), an argument that is an expression
    somewhere is unknown: its text is no value.
    """
    rows = m["macros"].where((F.col("call") == call) & P.selectors(F.col("path"), paths))
    chosen = rows.where((F.col("arg") == selector_argument) & (F.col("text") == selector)).select("path", "invocation").distinct()
    kept = rows.where(F.col("arg") >= values_from_argument).join(chosen, ["path", "invocation"], "left_semi")
    if "literal" not in kept.columns:
        return _current(kept.select(F.col("text").alias("key")).distinct(), F.col("key"))
    grouped = kept.groupBy(F.col("text").alias("key")).agg(F.bool_and(F.coalesce("literal", F.lit(False))).alias("sure"))
    return grouped.select("key", F.when(F.col("sure"), CURRENT).otherwise(UNKNOWN).alias("state"))


def package_entrypoints(m: Map, packages: tuple = (), routes: tuple = (), target_paths: tuple = ()) -> DataFrame:
    rows = m["entrypoints"].where(P.among(F.col("package"), packages) & P.among(F.col("route"), routes) & P.selectors(F.col("target"), target_paths))
    return _relation(rows, "package", F.col("route"), "target")


def package_exports(m: Map, packages: tuple = (), name_patterns: tuple = ()) -> DataFrame:
    rows = m["exports"].where(P.among(F.col("package"), packages) & (P.globs(F.col("name"), name_patterns) if name_patterns else F.lit(True)))
    return _relation(rows, "package", "export", "origin")


def provider_surface(m: Map, **normal) -> DataFrame:
    """Per capability: declared, used, and how many candidates it resolves to.

    Where the surface says whether the bytes behind a row were there (``witnessed``), a capability with
    a row that lacks them is unknown.
    """
    rows = normalised(m["surface"], F.col("name"), **normal)
    grouped = rows.groupBy("key").agg(F.max(F.col("declared").cast("int")).alias("d"), F.max(F.col("used").cast("int")).alias("u"), F.countDistinct("candidate").alias("c"), F.countDistinct("provider").alias("providers"), F.bool_and(F.coalesce("witnessed", F.lit(False)) if "witnessed" in rows.columns else F.lit(True)).alias("sure"))
    resolution = F.when(F.col("c") == 0, "unresolved").when(F.col("c") == 1, "resolved").otherwise("ambiguous")
    state = F.when(F.col("sure"), CURRENT).otherwise(UNKNOWN).alias("state")
    return grouped.select("key", F.when(F.col("d") == 1, "declared").otherwise("undeclared").alias("declaration"), resolution.alias("resolution"), (F.col("u") == 1).alias("used"), "providers", state)


def search_domain(m: Map) -> DataFrame:
    def kind(df: DataFrame, name: str, col: str) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), F.col(col).alias("key")).distinct()

    parts = [("file", "files", "path"), ("symbol", "symbols", "name"), ("component", "component_files", "component"), ("package", "entrypoints", "package"), ("artifact", "artifacts", "artifact")]
    first, *rest = [kind(m[table], name, col) for name, table, col in parts]
    for df in rest:
        first = first.unionByName(df)
    return _current(first, F.col("kind"), F.col("key"))


def _symbol_filter(m: Map, kinds: tuple = (), names: tuple = (), name_patterns: tuple = (), paths: tuple = (), public_only: bool = False) -> DataFrame:
    keep = P.among(F.col("kind"), kinds) & P.among(F.col("name"), names) & P.selectors(F.col("path"), paths)
    if name_patterns:
        keep = keep & P.globs(F.col("name"), name_patterns)
    if public_only:
        keep = keep & (F.col("scope") == "public")
    return m["symbols"].where(keep)


def symbol_entities(m: Map, **filters) -> DataFrame:
    """One item per path and symbol, its definitions merged."""
    grouped = _symbol_filter(m, **filters).groupBy("path", "name").agg(F.count("*").alias("definitions"), F.min("line").alias("line"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return _current(grouped, F.concat_ws("#", "path", "name").alias("key"), F.col("definitions"), F.col("line"), F.col("kinds"))


def symbols(m: Map, strip_prefix: str = "", strip_suffix: str = "", include: tuple = (), exclude: tuple = (), **filters) -> DataFrame:
    """One item per normalised name: evidence is merged, and no collision makes it unknown."""
    rows = normalised(_symbol_filter(m, **filters), F.col("name"), strip_prefix, strip_suffix, include, exclude)
    return _current(rows.groupBy("key").agg(F.countDistinct("path").alias("value")), F.col("key"), F.col("value"))


def symbol_relations(m: Map, kinds: tuple = (), from_paths: tuple = (), to_paths: tuple = (), resolutions: tuple = ()) -> DataFrame:
    """Candidates exploded; a row without one is kept only if no target filter is given."""
    keep = P.among(F.col("relation"), kinds) & P.selectors(F.col("source"), from_paths) & P.among(F.col("resolution"), resolutions)
    rows = m["symbol_relations"].where(keep).select("source", "name", "relation", "resolution", F.explode_outer("candidates").alias("target"))
    if to_paths:
        rows = rows.where(F.col("target").isNotNull() & P.selectors(F.col("target"), to_paths))
    return _current(rows, F.col("source"), F.col("relation").alias("kind"), F.col("target"), F.col("name"), F.col("resolution")).withColumn("state", F.when(F.col("resolution") == "unique", CURRENT).otherwise(UNKNOWN))


def symbol_occurrences(m: Map, name: str, paths: tuple = ()) -> DataFrame:
    """Declarations, references and importers of a symbol, best role per path.

    Fixed point A: files that declare it, grown through unique relations of that name. Fixed point
    B: files that import a relevant file, backwards over import edges.
    """
    seed = m["symbols"].where((F.col("name") == name) & P.selectors(F.col("path"), paths)).select(F.col("path").alias("node")).distinct()
    calls = m["symbol_relations"].where(F.col("name") == name).select("source", "resolution", F.explode("candidates").alias("target"))
    unique = calls.where("resolution = 'unique'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = unique.unionByName(unique.select(F.col("b").alias("a"), F.col("a").alias("b")))
    declaring = closure(seed, both)
    refs = calls.join(declaring.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("path"), F.when(F.col("resolution") == "unique", CURRENT).otherwise(UNKNOWN).alias("state"))
    imports = m["imports"].select(F.col("target").alias("a"), F.col("source").alias("b"))
    relevant = closure(declaring, imports)
    roles = declaring.select(F.col("node").alias("path"), F.lit(0).alias("r"), F.lit(CURRENT).alias("state"))
    roles = roles.unionByName(relevant.select(F.col("node").alias("path"), F.lit(2).alias("r"), F.lit(CURRENT).alias("state"))).unionByName(refs.withColumn("r", F.lit(4)))
    best = roles.groupBy("path").agg(F.min(F.struct("r", "state")).alias("x"))
    names = F.array(*[F.lit(r) for r in ROLES])
    return best.select("path", F.get(names, F.col("x.r")).alias("role"), F.col("x.state").alias("state"))


def test_routes(m: Map, group: str = "", selectors: tuple = (), target_paths: tuple = (), configured_only: bool = False) -> DataFrame:
    """(group:path::selector)-[static or configured]->(target)."""
    keep = P.among(F.col("grp"), (group,) if group else ()) & P.among(F.col("selector"), selectors) & P.selectors(F.col("target"), target_paths)
    rows = m["tests"].where(keep & (F.col("configured") if configured_only else F.lit(True)))
    named = rows.withColumn("case", F.concat(F.col("grp"), F.lit(":"), F.col("path"), F.lit("::"), F.col("selector")))
    return _relation(named, "case", F.when(F.col("configured"), "configured").otherwise("static"), "target")


def test_selectors(m: Map, group: str = "", **normal) -> DataFrame:
    rows = m["tests"].where(P.among(F.col("grp"), (group,) if group else ()))
    return _current(normalised(rows, F.concat_ws("::", "path", "selector"), **normal).select("key").distinct(), F.col("key"))


def literal(spark, values: list[str] | dict[str, int]) -> DataFrame:
    """Asserted facts given inline."""
    if isinstance(values, dict):
        return _current(spark.createDataFrame(sorted(values.items()), "key string, value long"), F.col("key"), F.col("value"))
    return _current(spark.createDataFrame([(v,) for v in sorted(set(values))], "key string"), F.col("key"))
