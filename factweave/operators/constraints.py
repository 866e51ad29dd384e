"""Typed constraints: names for pairs of a projection and an assertion, and the policy around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import predicates as A
from factweave.operators import projections as S
from factweave.plans.evidence import CURRENT

Map = dict[str, DataFrame]


def _keys(m: Map, names: tuple) -> DataFrame:
    return S.literal(m["files"].sparkSession, list(names))


def _edge_kind(level: str, check: Callable) -> Callable:
    def run(m: Map, patterns: list[A.Pattern], **filters) -> DataFrame:
        edges = S.component_edges(m, **filters) if level == "component" else S.file_edges(m, **filters)
        return check(edges, patterns)

    return run


CONSTRAINTS: dict[str, Callable[..., DataFrame]] = {
    "component_membership": lambda m, least=1, most=None: A.numeric_bounds(S.component_membership(m), least=least, most=most),
    "component_cycles": lambda m, **f: A.acyclic(S.component_edges(m, **f)),
    "max_file_bytes": lambda m, most: A.numeric_bounds(S.file_metrics(m), most=most),
    "required_paths": lambda m, paths: A.required_subset(S.mapped_paths(m), _keys(m, paths)),
    "forbidden_paths": lambda m, include: A.cardinality(S.inventory_paths(m, include=include), exact=0),
    "required_symbols": lambda m, names: A.required_subset(S.symbols(m), _keys(m, names)),
    "forbidden_symbols": lambda m, names: A.disjoint(S.symbols(m), _keys(m, names)),
    "symbol_cardinality": lambda m, least=None, most=None, **f: A.cardinality(S.symbols(m, **f), least=least, most=most),
    "test_routes": lambda m, least=1, **f: A.min_test_routes(S.test_routes(m, **f), least),
    "required_file_edge": lambda m, **f: A.cardinality(S.file_edges(m, **f), least=1),
    "required_bridge": lambda m, bridge, **f: A.cardinality(S.file_edges(m, kinds=(f"bridge:{bridge}",), **f), least=1),
    "required_package_entrypoint": lambda m, **f: A.cardinality(S.package_entrypoints(m, **f), least=1),
    "required_test_route": lambda m, **f: A.cardinality(S.test_routes(m, **f), least=1),
    "provider_surface": lambda m, **f: A.provider_surface(S.provider_surface(m), **f),
    **{f"{word}_{level}_edges": _edge_kind(level, getattr(A, f"{word}_edges")) for word in ("allowed", "forbidden", "required") for level in ("component", "file")},
}


def apply_waivers(found: DataFrame, waivers: DataFrame, policy_date: str) -> DataFrame:
    """found with ``waived``: a waiver matches by comparison and key and still holds.

    It ends when it expires (null: never) or, if it names the inputs it was given for, when the
    finding's ``inputs`` are others. Two waivers for one finding raise, as which of them holds would be
    undefined.
    """
    live = waivers.where(F.col("expires").isNull() | (F.col("expires") >= policy_date))
    keys = ["comparison", "key"]
    if "inputs" in waivers.columns and "inputs" in found.columns:
        asked = found.select(*keys, F.col("inputs").alias("now")).distinct()
        live = live.join(asked, keys).where(F.col("inputs").isNull() | (F.col("inputs") == F.col("now")))
    live = live.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = found.join(live, keys, "left")
    once = F.when(F.col("n") > 1, F.raise_error(F.lit("ambiguous-waiver"))).otherwise(F.col("n") == 1)
    return joined.withColumn("waived", F.coalesce(once, F.lit(False))).drop("n")


def unused_waivers(found: DataFrame, waivers: DataFrame) -> DataFrame:
    return waivers.join(found.select("comparison", "key").distinct(), ["comparison", "key"], "left_anti")


def ratchet(found: DataFrame, active: DataFrame, resolved: DataFrame) -> DataFrame:
    """found with ``baseline``: reintroduced if once resolved, known if active, else new."""
    old = active.select("comparison", "key").distinct().withColumn("a", F.lit(True))
    gone = resolved.select("comparison", "key").distinct().withColumn("r", F.lit(True))
    both = found.join(old, ["comparison", "key"], "left").join(gone, ["comparison", "key"], "left")
    word = F.when(F.col("r"), "reintroduced").when(F.col("a"), "known").otherwise("new")
    return both.withColumn("baseline", word).drop("a", "r")


def blocking(found: DataFrame, with_baseline: bool = True, severities: tuple[str, ...] = ("error",)) -> DataFrame:
    """Open findings that stop a change: differences or unsure states, and new ones if there is a baseline.

    Where findings have a severity, only those of ``severities`` stop it.
    """
    is_open = ~F.col("waived") & ((F.col("comparison") != "equal") | (F.col("state") != CURRENT))
    fresh = F.col("baseline").isin("new", "reintroduced") if with_baseline else F.lit(True)
    grave = F.col("severity").isin(*severities) if "severity" in found.columns else F.lit(True)
    return found.where(is_open & fresh & grave)


def coverage_regressions(baseline: DataFrame, now: DataFrame) -> DataFrame:
    return baseline.select("key").join(now.select("key"), "key", "left_anti")
