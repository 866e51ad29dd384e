"""From provider facts to a Map: the analyses in their order, as one graph of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import construct as K
from factweave.operators import delta as D
from factweave.operators import resolve as V
from factweave.plans.evidence import best_state
from factweave.plans.requests import diagnostics
from factweave.sources.builds import named_entries

Map = dict[str, DataFrame]


@dataclass
class Facts:
    """What providers say, by table; a table that is None has no facts.

    files: path, layer. definitions: path, family, name, kind, scope. calls: source, family, name,
    method, binding, target, pos. imports: source, module. uses: source, name. packages: package,
    dependency. builds: build, path. artifacts: artifact, role, path. sends, receives: path, message.
    cases: path, name, start, end. texts: path, text. indexes: path, format, required. summaries: path,
    format. parity: member, value.
    """

    files: DataFrame
    definitions: DataFrame | None = None
    calls: DataFrame | None = None
    imports: DataFrame | None = None
    uses: DataFrame | None = None
    packages: DataFrame | None = None
    builds: DataFrame | None = None
    artifacts: DataFrame | None = None
    sends: DataFrame | None = None
    receives: DataFrame | None = None
    cases: DataFrame | None = None
    texts: DataFrame | None = None
    indexes: DataFrame | None = None
    summaries: DataFrame | None = None
    parity: DataFrame | None = None
    roots: tuple[str, ...] = ("",)
    suffixes: tuple[str, ...] = ("", ".py", "/__init__.py", ".js", "/index.js")
    builtins: dict[str, tuple[str, ...]] = field(default_factory=dict)
    namespaces: dict[str, str] = field(default_factory=dict)
    entries: dict[str, str] = field(default_factory=dict)


def _edges(df: DataFrame, kind: str, target: str | Column, name: str, state: str = "current") -> DataFrame:
    to = F.col(target) if isinstance(target, str) else target
    return df.select("source", F.lit(kind).alias("kind"), to.alias("target"), F.col(name).alias("name"), F.lit(state).alias("state"))


def _packages(f: Facts, m: Map) -> None:
    if f.packages is not None:
        m["packages"] = f.packages.distinct()


def _builds(f: Facts, m: Map) -> None:
    if f.builds is not None:
        m["builds"] = f.builds.join(f.files.select("path"), "path", "left_semi").distinct()


def _graph(f: Facts, m: Map) -> None:
    """Import and call sites; what stays outside the project goes to a package or is external."""
    sites = []
    if f.imports is not None:
        m["imports"] = V.import_files(f.imports, f.files, f.roots, f.suffixes)
        sites.append(_edges(m["imports"].where("target is not null and target <> source"), "import", "target", "module"))
        if f.packages is not None:
            known = f.packages.select(F.col("dependency").alias("lead")).distinct()
            loose = m["imports"].where("target is null").withColumn("lead", F.regexp_extract("module", r"^([^./][^./]*)", 1))
            sites.append(_edges(loose.join(known, "lead"), "external", F.concat(F.lit("package:"), "lead"), "module"))
    if f.calls is not None and f.definitions is not None:
        m["resolutions"] = V.call_resolutions(f.calls, f.definitions, f.builtins, f.namespaces)
        sites.append(_edges(m["resolutions"].where("kind = 'unique' and target <> source"), "call", "target", "name"))
        sites.append(_edges(m["resolutions"].where("kind = 'external'"), "external-call", F.concat(F.lit("package:"), "target"), "name"))
    if sites:
        m["sites"] = reduce(DataFrame.unionByName, sites)


def _references(f: Facts, m: Map) -> None:
    if f.uses is not None and f.definitions is not None:
        found = K.reference_edges(f.uses, f.definitions.select("name", F.col("path").alias("target")))
        sites = found.select("source", "kind", "target", F.explode("names").alias("name"), "state")
        m["sites"] = m["sites"].unionByName(sites) if "sites" in m else sites


def _indexes(f: Facts, m: Map) -> None:
    if f.indexes is not None and f.summaries is not None:
        m["indexes"] = V.index_states(f.indexes, f.files, f.summaries)


def _artifacts(f: Facts, m: Map) -> None:
    if f.artifacts is not None:
        m["artifacts"] = f.artifacts.distinct()


def _bridges(f: Facts, m: Map) -> None:
    if f.sends is not None and f.receives is not None:
        pairs = D.message_bridge(f.sends, f.receives).withColumn("name", F.lit("message"))
        sites = _edges(pairs, "bridge:message", "target", "name")
        m["sites"] = m["sites"].unionByName(sites) if "sites" in m else sites


def _tests(f: Facts, m: Map) -> None:
    if f.cases is not None and f.calls is not None and f.definitions is not None and "pos" in f.calls.columns:
        at = f.calls.where("not method").select(F.col("source").alias("path"), "pos", F.col("name").alias("callee"))
        m["test_routes"] = K.static_routes(at, f.cases, f.definitions.select("name", F.col("path").alias("target")))


def _named_entries(f: Facts, m: Map) -> None:
    if f.texts is not None and f.entries:
        m["entries"] = reduce(DataFrame.unionByName, [named_entries(f.texts, n, p) for n, p in f.entries.items()])


def _parity(f: Facts, m: Map) -> None:
    if f.parity is not None:
        m["parity_gaps"] = D.parity_missing(f.parity)


def _diagnostics(f: Facts, m: Map) -> None:
    found = [diagnostics(f.files.select(F.col("path").alias("key")), f.files.where("layer is not null").select(F.col("path").alias("key")), "file-without-layer", "warning")]
    if "indexes" in m:
        found.append(m["indexes"].where("status <> 'ok'").select("severity", F.col("status").alias("code"), F.col("path").alias("key")))
    if "artifacts" in m:
        found.append(diagnostics(m["artifacts"].select(F.col("path").alias("key")).distinct(), f.files.select(F.col("path").alias("key")), "missing-artifact-file"))
    m["diagnostics"] = reduce(DataFrame.unionByName, found)


#: The analyses in their order: a later one may use what an earlier one has put into the Map.
ANALYSES: tuple[Callable[[Facts, Map], None], ...] = (_packages, _builds, _graph, _references, _indexes, _artifacts, _bridges, _tests, _named_entries, _parity, _diagnostics)


def build_map(facts: Facts) -> Map:
    """All relations that the facts give. Nothing runs here: each is a lazy DataFrame.

    ``edges`` groups the sites of all kinds to one row per source, kind and target, with the names
    and the strongest evidence.
    """
    m: Map = {"files": facts.files}
    if facts.definitions is not None:
        m["symbols"] = facts.definitions
    for analysis in ANALYSES:
        analysis(facts, m)
    if "sites" in m:
        m["edges"] = m["sites"].groupBy("source", "kind", "target").agg(F.array_sort(F.collect_set("name")).alias("names"), best_state().alias("state"))
    return m
