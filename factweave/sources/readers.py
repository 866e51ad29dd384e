"""Readers: repositories, manifests, provider bundles, saved artifacts, coverage and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import patterns as P

_SPAN = "struct<start:bigint,end:bigint>"
BUNDLE = (
    "artifact string, schema_version int, provenance string, mode int, subject struct<scope:string,project:string,path:string,name:string>, "
    "producer struct<name:string,version:string>, capabilities array<struct<domain:string,coverage:string,claims:array<string>,boundary:string>>, "
    f"facts array<struct<id:string,domain:string,kind:string,claim:string,project:string,path:string,span:{_SPAN},key:string,correlation:string,name:string,attributes:map<string,string>>>, "
    f"diagnostics array<struct<severity:string,code:string,message:string,project:string,path:string,span:{_SPAN}>>"
)
MANIFEST = "artifact string, schema_version int, project string, files array<struct<path:string,sha256:string,bytes:bigint,language:string,layer:string,roles:array<string>>>"
COVERAGE = ("complete", "bounded", "partial", "none")


def repository(spark: SparkSession, root: str, ignore: list[str] | list[tuple[str, list[str]]], most_bytes: int = 64 << 20) -> DataFrame:
    """(path, bytes, ignored, oversized): files below a folder, without reading their content.

    Paths are relative to the folder, also where its name occurs again further down. ignore: rules of
    the root, or (folder, rules) of every ignore file.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString().rstrip("/") + "/"
    named = rows.withColumn("path", F.substring(F.replace(F.col("path"), F.lit("file:///"), F.lit("file:/")), len(whole) + 1, 1 << 30))
    sources = [("", ignore)] if ignore and isinstance(ignore[0], str) else ignore
    return named.withColumn("ignored", P.layered_ignore(F.col("path"), sources)).withColumn("oversized", F.col("bytes") > most_bytes)


def classify(files: DataFrame, layers: list[tuple[str, str]], roles: list[tuple[str, str]]) -> DataFrame:
    """files with ``layer`` (first glob that matches) and ``roles`` (all that do)."""
    layer: Column = F.lit(None).cast("string")
    for name, pattern in reversed(layers):
        layer = F.when(P.path_glob(F.col("path"), pattern), name).otherwise(layer)
    found = F.array_distinct(F.array_compact(F.array(*[F.when(P.path_glob(F.col("path"), p), r) for r, p in roles])))
    return files.withColumn("layer", layer).withColumn("roles", found)


def inventory_counts(files: DataFrame, known: tuple[str, ...]) -> DataFrame:
    suffix = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return files.agg(
        F.count("*").alias("inventory_files"), F.count_if("ignored").alias("ignored"), F.count_if(F.col("oversized") & ~F.col("ignored")).alias("oversized"),
        F.count_if(~F.col("ignored") & ~F.col("oversized") & suffix.isin(*known)).alias("selected"), F.count_if(~F.col("ignored") & ~suffix.isin(*known)).alias("unsupported"),
    )


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """Provider bundles, one JSON document a file; broken ones have null columns and are quarantined."""
    return spark.read.schema(BUNDLE).option("multiLine", True).json(path)


def checked_bundles(rows: DataFrame) -> DataFrame:
    """rows with ``problem``: null for a bundle with a subject, a producer and only known coverage words, else what is wrong."""
    known = F.forall(F.coalesce("capabilities", F.array().cast("array<struct<domain:string,coverage:string,claims:array<string>,boundary:string>>")), lambda c: c["coverage"].isin(*COVERAGE))
    problem = F.when(F.col("artifact").isNull() & F.col("subject").isNull(), "unreadable").when(F.col("subject.project").isNull(), "no subject")
    return rows.withColumn("problem", problem.when(F.col("producer.name").isNull(), "no producer").when(~known, "unknown coverage"))


def valid_bundles(rows: DataFrame) -> DataFrame:
    """Bundles without a problem; ``checked_bundles`` tells of the others."""
    return checked_bundles(rows).where("problem is null").drop("problem")


def facts_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("producer.name").alias("provider"), "mode", F.explode("facts").alias("f")).select("provider", "mode", "f.*")


def capabilities_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("producer.name").alias("provider"), "mode", F.explode("capabilities").alias("c")).select("provider", "mode", "c.*")


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    return files_of(spark.read.schema(MANIFEST).option("multiLine", True).json(path))


def files_of(manifests: DataFrame) -> DataFrame:
    """A row per file of manifests (as MANIFEST)."""
    return manifests.select("project", F.explode("files").alias("f")).select("project", "f.*")


def package_json(texts: DataFrame) -> DataFrame:
    """(path, name, version, scope, dependency, requirement) from (path, text) of package.json files."""
    maps = {"runtime": "dependencies", "dev": "devDependencies", "peer": "peerDependencies"}
    doc = F.from_json("text", "name string, version string, " + ", ".join(f"{m} map<string,string>" for m in maps.values()))
    rows = texts.select("path", doc.alias("d"))

    def listed(scope: str, member: str) -> Column:
        entries = F.map_entries(F.coalesce(F.col(f"d.{member}"), F.create_map().cast("map<string,string>")))
        return F.transform(entries, lambda e: F.struct(F.lit(scope).alias("scope"), e["key"].alias("dependency"), e["value"].alias("requirement")))

    pairs = F.flatten(F.array(*[listed(s, m) for s, m in maps.items()]))
    return rows.select("path", "d.name", "d.version", F.explode_outer(pairs).alias("p")).select("path", "name", "version", "p.*")


def requirements(texts: DataFrame) -> DataFrame:
    """(path, dependency, requirement) of requirement lines ``name op version`` in (path, text)."""
    lines = texts.select("path", F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike(r"^\s*(#|$)"))
    pattern = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(.*?)\s*$"
    return lines.select("path", F.regexp_extract("line", pattern, 1).alias("dependency"), F.regexp_extract("line", pattern, 2).alias("requirement"))


def description_fields(texts: DataFrame) -> DataFrame:
    """(path, field, value) of ``Field: value`` files, continuation lines joined."""
    joined = F.regexp_replace("text", r"\n[ \t]+", " ")
    lines = texts.select("path", F.explode(F.split(joined, "\n")).alias("line")).where(F.col("line").contains(":"))
    return lines.select("path", F.substring_index("line", ":", 1).alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))


def coverage_py(texts: DataFrame) -> DataFrame:
    """(path, line, context) from coverage reports in (text): files -> contexts per line."""
    doc = F.from_json("text", "files map<string, struct<executed_lines: array<bigint>, contexts: map<string, array<string>>>>")
    rows = texts.select(F.explode(doc["files"]).alias("path", "c"))
    lines = rows.select("path", F.explode("c.contexts").alias("line", "contexts"))
    return lines.select("path", F.col("line").cast("long").alias("line"), F.explode("contexts").alias("context"))


def istanbul(texts: DataFrame) -> DataFrame:
    """(path, start, end, hits) of statements from Istanbul reports in (text)."""
    place = "struct<line:bigint,column:bigint>"
    doc = F.from_json("text", f"map<string, struct<statementMap: map<string, struct<start:{place},end:{place}>>, s: map<string,bigint>>>")
    rows = texts.select(F.explode(doc).alias("path", "c")).select("path", F.explode("c.statementMap").alias("id", "at"), "c.s")
    return rows.select("path", F.col("at.start.line").alias("start"), F.col("at.end.line").alias("end"), F.col("s")[F.col("id")].alias("hits"))


def v8_coverage(texts: DataFrame) -> DataFrame:
    """(path, name, start, end, hits) of functions' ranges (offsets) from V8 reports in (text); paths without the file scheme."""
    doc = F.from_json("text", "result array<struct<url:string,functions:array<struct<functionName:string,ranges:array<struct<startOffset:bigint,endOffset:bigint,count:bigint>>>>>>")
    scripts = texts.select(F.explode(doc["result"]).alias("r")).select(F.regexp_replace("r.url", r"^file:///?", "").alias("path"), F.explode("r.functions").alias("f"))
    ranges = scripts.select("path", F.col("f.functionName").alias("name"), F.explode("f.ranges").alias("x"))
    return ranges.select("path", "name", F.col("x.startOffset").alias("start"), F.col("x.endOffset").alias("end"), F.col("x.count").alias("hits"))


def observed_tests(lines: DataFrame, declarations: DataFrame) -> DataFrame:
    """(context, path, name): tests that ran a line of a declaration, by its innermost span."""
    from factweave.operators.delta import enclosing

    inner = enclosing(lines.select("path", F.col("line").alias("pos")).distinct(), declarations).where("name is not null")
    return lines.join(inner.withColumnRenamed("pos", "line"), ["path", "line"]).select("context", "path", "name").distinct()


def change_set(texts: DataFrame) -> DataFrame:
    """(status, path, previous) from name-status lines in (text): A, M, D, R100."""
    parts = F.split("line", "\t")
    rows = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").select(parts.alias("p"))
    words = F.create_map(*[F.lit(x) for x in ("A", "added", "M", "modified", "D", "deleted", "R", "renamed")])
    renamed = F.size("p") > 2
    return rows.select(words[F.substring(F.col("p")[0], 1, 1)].alias("status"), F.when(renamed, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1))).alias("path"), F.when(renamed, F.get("p", F.lit(1))).alias("previous"))


def python_facts(texts: DataFrame) -> DataFrame:
    """(path, domain, name, kind, line, end) of Python sources (path, text), by stdlib ast.

    Domains: declaration (function, class; nested names are dotted), import (module or from; the
    imported name), call (free or method; the dotted name if it is one), decorator and constant (names
    in capitals bound at the top to a literal). A parser can't be an expression, so this is an
    Arrow-batched ingest step; a file that does not parse gives one row of domain ``error``.
    """
    import ast
    from collections.abc import Iterator

    import pandas as pd

    def dotted(node: ast.AST) -> str | None:
        names = []
        while isinstance(node, ast.Attribute):
            names.append(node.attr)
            node = node.value
        return ".".join([node.id, *names[::-1]]) if isinstance(node, ast.Name) else None

    def walk(node: ast.AST, prefix: str) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            inner = prefix
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{child.name}"
                yield "declaration", name, "class" if isinstance(child, ast.ClassDef) else "function", child.lineno, child.end_lineno
                for d in child.decorator_list:
                    if called := dotted(d.func if isinstance(d, ast.Call) else d):
                        yield "decorator", called, name, d.lineno, d.end_lineno
                inner = name + "."
            elif isinstance(child, ast.Import):
                yield from (("import", a.name, "module", child.lineno, child.end_lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                yield from (("import", f"{module}:{a.name}", "from", child.lineno, child.end_lineno) for a in child.names)
            elif isinstance(child, ast.Call) and (called := dotted(child.func)):
                yield "call", called, "free" if isinstance(child.func, ast.Name) else "method", child.lineno, child.end_lineno
            elif isinstance(child, ast.Assign) and isinstance(node, ast.Module) and isinstance(child.value, ast.Constant):
                yield from (("constant", t.id, type(child.value.value).__name__, child.lineno, child.end_lineno) for t in child.targets if isinstance(t, ast.Name) and t.id.isupper())
            yield from walk(child, inner)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    out += [(path, *row) for row in walk(ast.parse(text or ""), "")]
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((path, "error", type(e).__name__, "error", getattr(e, "lineno", None) or 0, 0))
            yield pd.DataFrame(out, columns=["path", "domain", "name", "kind", "line", "end"])

    return texts.select("path", "text").mapInPandas(run, "path string, domain string, name string, kind string, line long, end long")


def python_symbols(texts: DataFrame) -> DataFrame:
    """(path, name, kind, line, end) of definitions; a file that does not parse gives one row of kind ``error``."""
    return python_facts(texts).where("domain in ('declaration', 'error')").select("path", "name", "kind", "line", "end")
