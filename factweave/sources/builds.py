"""Build and package manifests as facts: make, scripts, compile commands, CMake, configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def make_targets(texts: DataFrame) -> DataFrame:
    """(path, build, dep) of make rules in (path, text); variables are left as written."""
    joined = F.regexp_replace("text", r"\\\n", " ")
    lines = texts.select("path", F.explode(F.split(joined, "\n")).alias("line"))
    rule = r"^([A-Za-z0-9_./%-]+)[ ]*::?(?!=)[ ]*([^=]*)$"
    rows = lines.where(F.col("line").rlike(rule)).select("path", F.regexp_extract("line", rule, 1).alias("build"), F.split(F.trim(F.regexp_extract("line", rule, 2)), r"\s+").alias("deps"))
    return rows.select("path", "build", F.explode_outer(F.filter("deps", lambda d: d != "")).alias("dep"))


def script_builds(texts: DataFrame) -> DataFrame:
    """(path, build, command) of package.json scripts."""
    doc = F.from_json("text", "scripts map<string,string>")
    return texts.select("path", F.explode(doc["scripts"]).alias("build", "command"))


def compile_commands(texts: DataFrame) -> DataFrame:
    """(directory, file, options): compile options of each command, sorted, without inputs and outputs."""
    doc = F.from_json("text", "array<struct<directory:string,file:string,command:string,arguments:array<string>>>")
    rows = texts.select(F.explode(doc).alias("c")).select("c.*")
    words = F.coalesce("arguments", F.split("command", r"\s+"))
    kept = F.array_sort(F.filter(words, lambda w: w.rlike("^-(I|D|std|isystem|f|m|W)")))
    return rows.select("directory", "file", F.array_join(kept, " ").alias("options"))


def cmake_targets(texts: DataFrame) -> DataFrame:
    """(path, build, kind, input) of add_library and add_executable calls."""
    call = r"(?is)add_(library|executable)\s*\(\s*([\w.-]+)\s*([^)]*)\)"
    rows = texts.select("path", F.arrays_zip(*[F.regexp_extract_all("text", F.lit(call), F.lit(i)).alias(n) for i, n in ((1, "kind"), (2, "build"), (3, "rest"))]).alias("calls"))
    one = rows.select("path", F.explode("calls").alias("c"))
    inputs = F.filter(F.split(F.col("c.rest"), r"\s+"), lambda w: ~w.isin("", "STATIC", "SHARED", "OBJECT", "INTERFACE"))
    return one.select("path", "c.build", F.lower("c.kind").alias("kind"), F.explode_outer(inputs).alias("input"))


def sections(texts: DataFrame) -> DataFrame:
    """(path, section, key, value) of INI and flat TOML files (setup.cfg, pyproject)."""
    parts = F.split(F.concat(F.lit("\n"), F.col("text")), r"\n\s*\[")
    part = texts.select("path", F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("part"))
    named = part.select("path", F.substring_index("part", "]", 1).alias("section"), F.explode(F.split(F.expr("substring(part, instr(part, ']') + 1)"), "\n")).alias("line"))
    pair = r"^\s*([A-Za-z0-9_.\"-]+)\s*=\s*(.*?)\s*$"
    rows = named.where(F.col("line").rlike(pair))
    return rows.select("path", "section", F.replace(F.regexp_extract("line", pair, 1), F.lit('"'), F.lit("")).alias("key"), F.regexp_replace(F.regexp_extract("line", pair, 2), '^"(.*)"$', "$1").alias("value"))


def named_entries(texts: DataFrame, name: str, pattern: str) -> DataFrame:
    """(entry, path, value) of a configured pattern's first group."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    return texts.select(F.lit(name).alias("entry"), "path", F.explode(F.array_sort(F.array_distinct(found))).alias("value"))


def gcov(texts: DataFrame) -> DataFrame:
    """(path, line, hits) of gcov JSON."""
    doc = F.from_json("text", "files array<struct<file:string,lines:array<struct<line_number:bigint,count:bigint>>>>")
    return texts.select(F.explode(doc["files"]).alias("f")).select(F.col("f.file").alias("path"), F.explode("f.lines").alias("l")).select("path", F.col("l.line_number").alias("line"), F.col("l.count").alias("hits"))


def llvm_cov(texts: DataFrame) -> DataFrame:
    """(path, line, hits) of segments in llvm-cov exports."""
    doc = F.from_json("text", "data array<struct<files:array<struct<filename:string,segments:array<array<string>>>>>>")
    files = texts.select(F.explode(doc["data"]).alias("d")).select(F.explode("d.files").alias("f"))
    rows = files.select(F.col("f.filename").alias("path"), F.explode("f.segments").alias("s"))
    return rows.select("path", F.get("s", F.lit(0)).cast("long").alias("line"), F.get("s", F.lit(2)).cast("long").alias("hits"))
