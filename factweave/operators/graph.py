"""Graph projection: nodes and relations at a level, grouped, with ledgers and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import top_area
from factweave.plans.evidence import best_state

FAMILIES = {"import": "imports", "declaration": "declarations"}
PERIPHERAL = ("package", "build", "builtin", "unresolved", "external")


def family(kind: Column) -> Column:
    out = F.when(kind.startswith("bridge:"), "bridges").when((kind == "external") | kind.startswith("package"), "packages")
    for k, f in FAMILIES.items():
        out = out.when(kind == k, f)
    return out.otherwise("references")


def node_kind(node: Column, inner: str) -> Column:
    out = F.when(F.lit(False), "")
    for p in PERIPHERAL:
        out = out.when(node.startswith(p + ":"), p)
    return out.otherwise(inner)


def group_key(files: DataFrame, group_by: str) -> DataFrame:
    """(path, grp) by directory, language or layer of the files."""
    key = top_area(F.col("path")) if group_by == "directory" else F.col(group_by)
    return files.select("path", key.alias("grp"))


def nodes(files: DataFrame, relations: DataFrame, level: str = "file") -> DataFrame:
    """Structural nodes of the level, and peripheral ones that only relations name."""
    own = files.select(F.col("path").alias("node")).distinct()
    ends = relations.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    outer = ends.join(own, "node", "left_anti")
    return own.select("node", F.lit(level).alias("kind")).unionByName(outer.select("node", node_kind(F.col("node"), "external").alias("kind")))


def relations(edges: DataFrame, families: tuple[str, ...] = ()) -> DataFrame:
    out = edges.select("source", family(F.col("kind")).alias("family"), "target", "state")
    out = out.where(F.col("family").isin(*families)) if families else out
    return out.groupBy("source", "family", "target").agg(best_state().alias("state"))


def grouped(relations_: DataFrame, groups: DataFrame) -> DataFrame:
    """Relations between groups: member relations and source members of each family."""
    a, b = groups.toDF("source", "from_group"), groups.toDF("target", "to_group")
    lifted = relations_.join(a, "source").join(b, "target").where("from_group <> to_group")
    return lifted.groupBy("from_group", "family", "to_group").agg(F.count("*").alias("relations"), F.countDistinct("source").alias("members"))


def ledger(relations_: DataFrame, groups: DataFrame) -> DataFrame:
    """Relations that fall inside one group, per family."""
    a, b = groups.toDF("source", "from_group"), groups.toDF("target", "to_group")
    inner = relations_.join(a, "source").join(b, "target").where("from_group = to_group")
    return inner.groupBy("family").agg(F.count("*").alias("collapsed"))


def evidence_overlay(relations_: DataFrame) -> DataFrame:
    return relations_.groupBy("family", "state").agg(F.count("*").alias("relations"))


def diagnostics_overlay(nodes_: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with their numbers of errors and warnings (node, severity); 0 for nodes without any."""
    per = found.groupBy("node").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return nodes_.join(per, "node", "left").fillna(0, ["errors", "warnings"])


def symbol_relations(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, family, target, state) between files, from symbol calls and references (source, name, relation, target).

    A name that one file declares gives a current relation, one that several declare an unknown one
    to each.
    """
    owners = symbols.select("name", F.col("path").alias("target")).distinct()
    counted = owners.join(owners.groupBy("name").agg(F.count("*").alias("n")), "name")
    hit = calls.select("source", "relation", "name").distinct().join(counted, "name").where("source <> target")
    state = F.when(F.col("n") == 1, "current").otherwise("unknown")
    return hit.select("source", F.col("relation").alias("family"), "target", state.alias("state")).groupBy("source", "family", "target").agg(best_state().alias("state"))


def route_relations(tests: DataFrame, builds: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """(source, family, target, state) of test routes (path, target), builds (build, path) and package entrypoints (package, target).

    Builds and packages are peripheral nodes, named by their kind.
    """
    current = F.lit("current").alias("state")
    parts = [
        tests.select(F.col("path").alias("source"), F.lit("tests").alias("family"), "target", current),
        builds.select(F.concat(F.lit("build:"), "build").alias("source"), F.lit("builds").alias("family"), F.col("path").alias("target"), current),
        entrypoints.select(F.concat(F.lit("package:"), "package").alias("source"), F.lit("packages").alias("family"), "target", current),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def at_level(relations_: DataFrame, members: DataFrame) -> DataFrame:
    """(source, family, target, state, collapsed): relations between components, and per family how many fall inside one.

    members: component, path; a file may be in several. Nodes that are in none stay themselves. Rows
    with a null source and target carry the counts.
    """
    own = members.select("component", "path").distinct()
    a, b = own.toDF("from_component", "source"), own.toDF("to_component", "target")
    both = relations_.join(a, "source", "left").join(b, "target", "left").select(F.coalesce("from_component", "source").alias("source"), "family", F.coalesce("to_component", "target").alias("target"), "state")
    lifted = both.where("source <> target").groupBy("source", "family", "target").agg(best_state().alias("state")).withColumn("collapsed", F.lit(0).cast("long"))
    inner = both.where("source = target").groupBy("family").agg(F.count("*").alias("collapsed"))
    none = F.lit(None).cast("string")
    return lifted.unionByName(inner.select(none.alias("source"), "family", none.alias("target"), none.alias("state"), "collapsed"))
