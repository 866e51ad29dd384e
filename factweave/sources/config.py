"""A configuration inferred from a repository's own files: layers, packages, builds and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = r"\.(c|h|cc|cpp|hpp|py|js|jsx|ts|tsx|R|r)$"
#: Manifest names by what they declare.
BUILDS = {"Makefile": "make", "GNUmakefile": "make", "CMakeLists.txt": "cmake", "compile_commands.json": "compile-commands"}
TESTS = r"(^|/)(tests?|__tests__|testthat)/|(^|/)test_[^/]*\.py$|_test\.(py|c|cc)$|\.(test|spec)\.(js|jsx|ts|tsx)$"


def infer(files: DataFrame) -> DataFrame:
    """(kind, name, pattern, origin) of settings found in files (path, text); texts of manifests alone are read.

    A layer is a top folder with sources, or ``.`` for the root; a package is named by its manifest,
    or by its folder if that has no name; a build is a build file; a test group is a folder with tests.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    below = F.when(folder == "", "**").otherwise(F.concat(folder, F.lit("/**")))
    source = F.col("path").rlike(SOURCES)
    test = source & F.col("path").rlike(TESTS)

    def rows(df: DataFrame, kind: str, what: Column, pattern: Column, origin: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), what.alias("name"), pattern.alias("pattern"), origin.alias("origin"))

    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    layers = files.where(source & ~test).select(top.alias("top")).distinct()
    layers = rows(layers, "layer", F.col("top"), F.when(F.col("top") == ".", "*").otherwise(F.concat("top", F.lit("/**"))), F.lit("folders"))
    manifests = files.where(name.isin("package.json", "pyproject.toml", "DESCRIPTION"))
    toml = F.regexp_extract("text", r"(?ms)^\[project\][^\[]*?^name\s*=\s*[\"']([^\"']+)", 1)
    named = F.when(name == "package.json", F.get_json_object("text", "$.name")).when(name == "pyproject.toml", toml).otherwise(F.trim(F.regexp_extract("text", r"(?m)^Package:(.*)$", 1)))
    own = F.coalesce(F.when(named != "", named), F.when(folder != "", F.regexp_extract(folder, r"([^/]+)$", 1)).otherwise("."))
    packages = rows(manifests, "package", own, below, F.col("path"))
    tools = F.create_map(*[F.lit(x) for pair in BUILDS.items() for x in pair])
    builds = rows(files.where(name.isin(*BUILDS)), "build", F.try_element_at(tools, name), below, F.col("path"))
    scripts = files.where(name == "package.json").select("path", F.explode(F.from_json("text", "scripts map<string,string>")["scripts"]).alias("script", "command"))
    scripts = rows(scripts, "build", F.concat(F.lit("script:"), "script"), F.when(folder == "", "**").otherwise(F.concat(folder, F.lit("/**"))), F.col("path"))
    groups = files.where(test).select(folder.alias("folder")).distinct()
    tests = rows(groups, "tests", F.when(F.col("folder") == "", ".").otherwise(F.col("folder")), F.when(F.col("folder") == "", "*").otherwise(F.concat("folder", F.lit("/*"))), F.lit("folders"))
    return layers.unionByName(packages).unionByName(builds).unionByName(scripts).unionByName(tests)
