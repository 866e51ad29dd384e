"""Comparing snapshots: keyed differences, freshness, parity, surfaces, bridges, workspaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import package_name


def diff(before: DataFrame, after: DataFrame, value: str = "value") -> DataFrame:
    """(key, change): added, removed or changed, by one full outer join."""
    both = before.select("key", F.col(value).alias("b"), F.lit(1).alias("hb")).join(after.select("key", F.col(value).alias("a"), F.lit(1).alias("ha")), "key", "full_outer")
    change = F.when(F.col("hb").isNull(), "added").when(F.col("ha").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.withColumn("change", change).where("change is not null").select("key", "change")


def freshness(stored: DataFrame, now: DataFrame) -> DataFrame:
    """One row: counts of added, changed, missing and unchanged files and whether that is stale.

    A file is there if its row is, also with a null digest; two null digests are equal.
    """
    here = F.lit(1)
    both = stored.select("key", F.col("value").alias("s"), here.alias("hs")).join(now.select("key", F.col("value").alias("n"), here.alias("hn")), "key", "full_outer")
    old, new, same = F.col("hs").isNotNull(), F.col("hn").isNotNull(), F.col("s").eqNullSafe(F.col("n"))
    out = both.agg(
        F.count_if(~old).alias("added"), F.count_if(~new).alias("missing"),
        F.count_if(old & new & ~same).alias("changed"), F.count_if(old & new & same).alias("unchanged"),
    )
    return out.withColumn("status", F.when(F.col("added") + F.col("missing") + F.col("changed") > 0, "stale").otherwise("current"))


def freshness_status(same_project: Column, source: Column, config: Column, producer: Column, discovery: Column) -> Column:
    """The ladder over digest comparisons, each ``same``, ``changed`` or ``unknown``."""
    rest = [config, producer, discovery]
    return (
        F.when(~same_project, "not-applicable").when((source == "changed") | (config == "changed"), "stale")
        .when((producer == "changed") | (discovery == "changed"), "context-drift")
        .when((rest[0] == "unknown") | (rest[1] == "unknown") | (rest[2] == "unknown"), "unknown").otherwise("current")
    )


def parity_missing(values: DataFrame) -> DataFrame:
    """(member, value) for values that some other member has.

    Per value, the members that have it are taken from the list of all: one aggregate, and only
    gaps become rows.
    """
    everyone = values.agg(F.collect_set("member").alias("everyone"))
    have = values.groupBy("value").agg(F.collect_set("member").alias("have"))
    return have.crossJoin(F.broadcast(everyone)).select(F.explode(F.array_except("everyone", "have")).alias("member"), "value")  # one row of names


def parity_shared(values: DataFrame) -> DataFrame:
    members = values.agg(F.countDistinct("member").alias("m"))
    return values.groupBy("value").agg(F.countDistinct("member").alias("n")).join(members, F.col("n") == F.col("m")).select("value")


def query_surface_summary(surface: DataFrame) -> DataFrame:
    """One row of counts over surface names with ``ignored`` and a declaration that may be unknown; ignored names count as that only."""
    live = ~F.col("ignored")
    declared, used = F.col("declaration") == "declared", F.col("used")
    tests = {
        "ignored": F.col("ignored"), "registered": live & declared, "unused": live & declared & ~used, "unregistered_use": live & (F.col("declaration") == "undeclared") & used,
        "declaration_unknown": live & (F.col("declaration") == "unknown"), "used": live & used, "resolved": live & (F.col("resolution") == "resolved"),
        "ambiguous": live & (F.col("resolution") == "ambiguous"), "unresolved": live & (F.col("resolution") == "unresolved"),
    }
    return surface.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


#: The sections of a Map that two snapshots are compared by.
SECTIONS = (
    "artifacts", "bridge_surfaces", "bridges", "build_routes", "call_resolutions", "component_routes", "edges", "entrypoints", "facts", "files", "inputs",
    "package_dependencies", "package_entrypoint_surfaces", "package_export_origins", "package_exports", "parity_gaps", "public_symbols", "symbols", "symbol_calls",
    "symbol_references", "test_route_evidence", "test_routes", "tool",
)


def section_rows(sections: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """(section, key, value) of a Map's sections: name -> (rows, key columns); the other columns are the value.

    Rows that share a key are one item; its value is the sorted list of theirs.
    """
    out = []
    for name, (rows, keys) in sections.items():
        if name not in SECTIONS:
            raise ValueError(name)
        rest = [c for c in rows.columns if c not in keys]
        key = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]))
        own = F.to_json(F.struct(*[F.col(c) for c in rest]), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
        each = rows.select(key.alias("key"), own.alias("value")).distinct()
        out.append(each.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value")).select(F.lit(name).alias("section"), "key", "value"))
    return reduce(DataFrame.unionByName, out)


def map_diff(before: dict[str, tuple[DataFrame, tuple[str, ...]]], after: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """(section, key, change) over all sections of two Maps, by one full outer join; a section that one Map lacks is empty there."""
    old, new = (section_rows(x).withColumn("here", F.lit(1)) for x in (before, after))
    both = old.alias("b").join(new.alias("a"), ["section", "key"], "full_outer")
    change = F.when(F.col("b.here").isNull(), "added").when(F.col("a.here").isNull(), "removed").when(F.col("a.value") != F.col("b.value"), "changed")
    return both.select("section", "key", change.alias("change")).where("change is not null")


def surface_summary(surface: DataFrame) -> DataFrame:
    """One row of counts over ``projections.provider_surface``."""
    declared, used = F.col("declaration") == "declared", F.col("used")
    tests = {
        "registered": declared, "used": used, "unused": declared & ~used, "unregistered_use": ~declared & used,
        "resolved": F.col("resolution") == "resolved", "unresolved": F.col("resolution") == "unresolved", "ambiguous": F.col("resolution") == "ambiguous",
    }
    return surface.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def message_bridge(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Files joined by messages ``key:value``; a receiver's key may be ``*``; never to itself.

    Two equi-joins (exact, wildcard) instead of one join on a disjunction; pairs are distinct
    before they leave the join.
    """
    split = lambda df: df.select("path", F.substring_index("message", ":", 1).alias("key"), F.expr("substring(message, instr(message, ':') + 1)").alias("value")).distinct()
    s, r = split(sends).withColumnRenamed("path", "source"), split(receives).withColumnRenamed("path", "target")
    exact = s.join(r, ["key", "value"]).select("source", "target")
    wild = s.join(r.where("key = '*'").drop("key"), "value").select("source", "target")
    return exact.unionByName(wild).where("source <> target").distinct()


def name_bridge(calls: DataFrame, definitions: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Calls to definitions of another layer by canonical name (prefix dropped)."""
    canon = F.col("name")
    for p in prefixes:
        canon = F.when(canon.startswith(p), F.substring(canon, len(p) + 1, 1 << 30)).otherwise(canon)
    c = calls.select(F.col("path").alias("source"), F.col("layer").alias("from_layer"), canon.alias("name")).distinct()
    d = definitions.select(F.col("path").alias("target"), F.col("layer").alias("to_layer"), canon.alias("name")).distinct()
    return c.join(d, "name").where("from_layer <> to_layer").select("source", "target", "name").distinct()


def workspace(dependencies: DataFrame, identities: DataFrame, manager: str) -> DataFrame:
    """(project, name, outcome, target): route to the one identity, external if none, ambiguous if more."""
    own = identities.select("project", package_name(F.col("name"), manager).alias("id")).distinct()
    owners = own.groupBy("id").agg(F.count("*").alias("n"), F.min("project").alias("target"))
    asked = dependencies.select("project", package_name(F.col("name"), manager).alias("id")).distinct()
    outcome = F.when(F.col("n").isNull(), "external").when(F.col("n") == 1, "route").otherwise("ambiguous")
    return asked.join(owners, "id", "left").select("project", F.col("id").alias("name"), outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


def enclosing(points: DataFrame, spans: DataFrame, width: int = 256) -> DataFrame:
    """(path, pos, name): the innermost span [start, end) around each point of the same path, null if none.

    A range join by buckets of doubling width: a span lies in at most two buckets of the level that
    is as wide as itself, and a point is looked for in one bucket of each level that its path has.
    """
    size = F.col("end") - F.col("start")
    level = F.greatest(F.ceil(F.log2(size / width)), F.lit(0)).cast("int")
    sized = spans.where("end > start").withColumn("level", level).withColumn("wide", F.call_function("shiftleft", F.lit(width).cast("long"), F.col("level")))
    s = sized.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / F.col("wide")), F.floor((F.col("end") - 1) / F.col("wide"))))))
    levels = sized.select("path", "level", "wide").distinct()
    asked = points.select("path", "pos").distinct()
    p = asked.join(levels, "path").withColumn("bucket", F.floor(F.col("pos") / F.col("wide"))).drop("wide")
    hit = p.join(s.drop("wide"), ["path", "level", "bucket"]).where("start <= pos and pos < end")
    best = hit.groupBy("path", "pos").agg(F.min(F.struct(size.alias("size"), "name")).alias("x"))
    return asked.join(best, ["path", "pos"], "left").select("path", "pos", F.col("x.name").alias("name"))


def call_ladder(calls: DataFrame, definitions: DataFrame, builtins: tuple[str, ...] = ()) -> DataFrame:
    """(source, name, resolution, candidates): unique, ambiguous, builtin or unresolved by candidates."""
    n = definitions.groupBy("language", "name").agg(F.countDistinct("path").alias("candidates"))
    joined = calls.select("source", "language", "name").distinct().join(n, ["language", "name"], "left")
    word = F.when(F.col("candidates") == 1, "unique").when(F.col("candidates") > 1, "ambiguous").when(F.col("name").isin(*builtins), "builtin").otherwise("unresolved")
    return joined.select("source", "name", word.alias("resolution"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def import_ladder(imports: DataFrame, files: DataFrame, aliases: DataFrame, builtins: tuple[str, ...], suffixes: tuple[str, ...] = ("", "/index")) -> DataFrame:
    """(source, module, kind, target): builtin, then a file by suffix priority, then a package alias, else external."""
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.concat("module", F.lit(s)).alias("path")) for i, s in enumerate(suffixes)]))
    asked = imports.select("source", "module").distinct()
    local = asked.select("source", "module", tries.alias("t")).select("source", "module", "t.*").join(files.select("path"), "path")
    best = local.groupBy("source", "module").agg(F.min(F.struct("priority", "path")).alias("x"))
    owners = aliases.groupBy(F.col("alias").alias("module")).agg(F.countDistinct("package").alias("n"), F.min("package").alias("package"))
    joined = asked.join(best, ["source", "module"], "left").join(owners, "module", "left")
    kind = F.when(F.col("module").isin(*builtins), "builtin").when(F.col("x").isNotNull(), "file").when(F.col("n") == 1, "package").when(F.col("n") > 1, "ambiguous").otherwise("external")
    target = F.when(kind == "file", F.col("x.path")).when(kind == "package", F.col("package"))
    return joined.select("source", "module", kind.alias("kind"), target.alias("target"))


def intern_contexts(commands: DataFrame) -> DataFrame:
    """Equal compile options once, with how many commands share them."""
    return commands.groupBy(F.sha2("options", 256).alias("context")).agg(F.min("options").alias("options"), F.count("*").alias("commands"))
