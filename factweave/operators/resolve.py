"""Resolving calls, imports and semantic indexes against the files of a Map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.traverse import routes

BINDINGS = ("builtin", "local", "unknown", "imported")


def call_resolutions(calls: DataFrame, definitions: DataFrame, builtins: dict[str, tuple[str, ...]], namespaces: dict[str, str]) -> DataFrame:
    """(source, name, kind, occurrences, candidates, target) for the names that each file calls.

    calls: source, family, name, method (called on a receiver), binding (one of BINDINGS or null) and
    target (a provider's exact one or null). definitions: path, family, name, kind, scope.
    builtins: names by language family; namespaces: leading name -> external package.

    A free call may mean any function or class of its name in its language, but no bare declaration,
    no method and nothing that is local to another file. Only an exact target or a definition in the
    calling file is ``unique``; one elsewhere is a ``candidate``, several are ``ambiguous``. Bindings
    that are local, unknown or mixed leave the call ``unresolved``, and so does a builtin's name that
    the project also defines. Method calls are counted, not resolved.

    Candidates are counted once per name and joined, so a name with many definitions is one row.
    """
    key = ["source", "family", "name"]
    flags = [F.max(F.coalesce(F.col("binding") == b, F.lit(False))).alias(b) for b in BINDINGS]
    exact = F.when((F.countDistinct("target") == 1) & (F.count("target") == F.count("*")), F.min("target")).alias("exact")
    free = calls.where(~F.col("method")).groupBy(*key).agg(F.count("*").alias("occurrences"), exact, *flags)
    usable = definitions.where(~F.col("kind").isin("declaration", "method")).select("family", "name", "path", F.coalesce(F.col("scope") == "local", F.lit(False)).alias("hidden")).distinct()
    seen = usable.where("not hidden").groupBy("family", "name").agg(F.countDistinct("path").alias("open"), F.min("path").alias("one"))
    own = usable.groupBy("family", "name", F.col("path").alias("source")).agg(F.max("hidden").alias("own_hidden"), F.min("hidden").alias("only_hidden"))
    joined = free.join(seen, ["family", "name"], "left").join(own, key, "left")
    extra = F.coalesce(F.col("only_hidden"), F.lit(False)).cast("int")  # a local definition of the file itself
    n = F.coalesce("open", F.lit(0)) + extra
    only = F.when(extra == 1, F.col("source")).otherwise(F.col("one"))
    builtin = _named(F.col("family"), F.col("name"), builtins)
    package = F.lit(None).cast("string")
    for lead, target in namespaces.items():
        package = F.when((F.col("name") == lead) | F.col("name").startswith(f"{lead}."), target).otherwise(package)
    bound = F.col("builtin") | F.col("local") | F.col("unknown")
    any_binding = bound | F.col("imported")
    kind = (
        F.when(F.col("exact").isNotNull(), "unique").when(F.col("builtin") & ~F.col("local") & ~F.col("unknown") & ~F.col("imported"), "builtin").when(bound, "unresolved")
        .when(builtin & ~any_binding & (n > 0), "unresolved").when((n == 0) & builtin, "builtin").when((n == 0) & package.isNotNull(), "external")
        .when(n > 1, "ambiguous").when((n == 1) & ~F.col("imported") & (only == F.col("source")), "unique").when(n == 1, "candidate").otherwise("unresolved")
    )
    named = joined.select(
        "source", "name", kind.alias("kind"), "occurrences", F.when(F.col("exact").isNotNull(), 1).otherwise(n).cast("long").alias("candidates"),
        F.when(F.col("exact").isNotNull(), F.col("exact")).when(kind == "external", package).when(kind == "unique", only).alias("target"),
    )
    methods = calls.where("method").groupBy("source", "name").agg(F.count("*").alias("occurrences"))
    none = F.lit(None).cast("string")
    return named.unionByName(methods.select("source", "name", F.lit("method").alias("kind"), "occurrences", F.lit(0).cast("long").alias("candidates"), none.alias("target")))


def _named(family: Column, name: Column, names: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(False)
    for f, known in names.items():
        out = out | ((family == f) & name.isin(*known))
    return out


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; null if it leaves the root."""

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc["parts"]) > 0, F.struct(F.slice(acc["parts"], 1, F.size(acc["parts"]) - 1).alias("parts"), acc["out"].alias("out")))
        up = up.otherwise(F.struct(acc["parts"].alias("parts"), F.lit(True).alias("out")))
        down = F.struct(F.concat(acc["parts"], F.array(part)).alias("parts"), acc["out"].alias("out"))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(down)

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))
    return F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(~acc["out"], F.array_join(acc["parts"], "/")))


def import_files(imports: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("",), suffixes: tuple[str, ...] = ("", ".py", "/__init__.py", ".js", "/index.js")) -> DataFrame:
    """(source, module, target, how): the file that an import (source, module) names, null if none.

    A module that begins with a dot segment is relative to the importing file's folder and to
    nothing else. Others are tried beside the importing file, then below each root or include
    folder, in order; for each place the suffixes in order. All tries are one equi-join.
    """
    asked = imports.select("source", "module").distinct()
    folder = F.regexp_replace("source", r"/?[^/]*$", "")
    relative = F.col("module").rlike(r"^\.\.?(/|$)")
    places = [(F.concat_ws("/", folder, F.col("module")), F.when(relative, "relative").otherwise("beside"))]
    places += [(F.when(~relative, F.concat_ws("/", F.lit(r or "."), F.col("module"))), F.lit(f"root:{r}")) for r in roots]
    tries = [F.struct(F.lit(i * len(suffixes) + j).alias("at"), F.concat(normal_path(p), F.lit(s)).alias("path"), how.alias("how")) for i, (p, how) in enumerate(places) for j, s in enumerate(suffixes)]
    each = asked.select("source", "module", F.explode(F.array(*tries)).alias("t")).select("source", "module", "t.*").where("path is not null")
    best = each.join(files.select("path").distinct(), "path").groupBy("source", "module").agg(F.min(F.struct("at", "path", "how")).alias("x"))
    return asked.join(best, ["source", "module"], "left").select("source", "module", F.col("x.path").alias("target"), F.col("x.how").alias("how"))


def scoped_routes(seeds: DataFrame, relations: DataFrame, edges: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """Routes (as ``traverse.routes``) with ``scoped``, from seeds (node, scoped).

    A file that only a symbol selected is reported at distance 0, but the file graph is entered
    through its symbol relations (source, target), one hop away, not through its structural edges.
    """
    inside = seeds.where("scoped").select("node").distinct()
    whole = seeds.where("not scoped").select("node").distinct()
    inside = inside.join(whole, "node", "left_anti")
    near = relations.join(inside, relations.source == inside.node).select(F.col("target").alias("node")).distinct()
    first = routes(whole, edges, depth, direction)
    later = routes(near, edges, depth - 1, direction).withColumn("distance", F.col("distance") + 1)
    own = inside.select("node", *[F.lit(0).alias(c) for c in first.columns if c != "node"])
    rank = F.struct(*[c for c in first.columns if c != "node"])
    best = first.unionByName(later).unionByName(own).groupBy("node").agg(F.min(rank).alias("x"))
    marked = best.join(inside.withColumn("scoped", F.lit(True)), "node", "left")
    return marked.select("node", "x.*", F.coalesce("scoped", F.lit(False)).alias("scoped"))


def index_states(specs: DataFrame, files: DataFrame, summaries: DataFrame) -> DataFrame:
    """(path, format, status, severity) of configured semantic indexes (path, format, required).

    ok, missing-index if the file is not in the Map, or index-provider-unavailable if no summary
    (path, format) of it was read; what is required is an error, else a warning.
    """
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    read = summaries.select("path", "format").distinct().withColumn("read", F.lit(True))
    joined = specs.join(there, "path", "left").join(read, ["path", "format"], "left")
    status = F.when(F.col("there").isNull(), "missing-index").when(F.col("read").isNull(), "index-provider-unavailable").otherwise("ok")
    severity = F.when(status == "ok", F.lit(None).cast("string")).when(F.col("required"), "error").otherwise("warning")
    return joined.select("path", "format", status.alias("status"), severity.alias("severity"))


def applicability(needs: DataFrame, routes_: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(case, route, applicable, lacking): whether a route has all that a case needs.

    needs: case, capability (null: none); routes_: route; capabilities: route, capability.
    """
    cases = needs.select("case").distinct()
    pairs = needs.where("capability is not null").distinct().join(capabilities.select("route", "capability").distinct(), "capability").groupBy("case", "route").agg(F.collect_set("capability").alias("has"))
    wanted = cases.join(needs.where("capability is not null").groupBy("case").agg(F.array_sort(F.collect_set("capability")).alias("wanted")), "case", "left")
    every = wanted.crossJoin(F.broadcast(routes_.select("route").distinct()))  # routes are the few ways a case is run
    lacking = F.array_except(F.coalesce("wanted", F.array().cast("array<string>")), F.coalesce("has", F.array().cast("array<string>")))
    return every.join(pairs, ["case", "route"], "left").select("case", "route", (F.size(lacking) == 0).alias("applicable"), F.array_join(lacking, ",").alias("lacking"))
