"""Lexical facts of C, JavaScript, Python and R sources, by regular expressions in SQL.

These are the weakest claims (``lexical-occurrence``): declarations and imports by line shape.
Comments are blanked first, but not where a string literal holds their sign. Calls and string
literals come with their spans. Parsers' facts come in as bundles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
#: A string literal, kept as group 1, or a comment.
BLANKS = {
    "c": rf"({_QUOTED})|//[^\n]*|(?s:/\*.*?\*/)", "javascript": rf"({_QUOTED}|`(?s:\\.|[^`\\])*`)|//[^\n]*|(?s:/\*.*?\*/)",
    "python": rf"((?s:\"\"\".*?\"\"\"|\'\'\'.*?\'\'\')|{_QUOTED})|#[^\n]*", "r": rf"({_QUOTED})|#[^\n]*",
}
#: A called name, after a word that declares one or not; words that are no calls are dropped.
CALL = r"(?:\b(def|class|function|new)\s+)?(?<![\w.$])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)[ \t]*\("
NO_CALL = ("if", "for", "while", "switch", "return", "sizeof", "catch", "function", "and", "or", "not", "in", "elif", "def", "class", "defined")
DECLARATIONS = {
    "c": r"(?m)^[A-Za-z_][\w \t*]*?\b([A-Za-z_]\w*)[ \t]*\([^;{}()]*\)\s*\{",
    "javascript": r"(?m)\b(?:function\*?|class)\s+([A-Za-z_$][\w$]*)",
    "python": r"(?m)^[ \t]*(?:async[ \t]+def|def|class)[ \t]+([A-Za-z_]\w*)",
    "r": r"(?m)^[ \t]*([A-Za-z_.][\w.]*)[ \t]*(?:<-|=)[ \t]*function\b",
}
IMPORTS = {
    "c": r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"]+)[>\"]",
    "javascript": r"(?m)(?:\bfrom|\brequire\(|\bimport)\s*[\"']([^\"']+)[\"']",
    "python": r"(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)",
    "r": r"\b(?:library|require)\(\s*[\"']?([\w.]+)",
}
SUFFIXES = {"c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript", "py": "python", "R": "r", "r": "r"}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.get(F.array(table[F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)]), F.lit(0))


def facts(sources: DataFrame) -> DataFrame:
    """(path, language, domain, name, claim) from (path, text); unknown languages give none."""
    rows = sources.select("path", "text", language_of(F.col("path")).alias("language")).where("language is not null and text is not null")

    def by_language(patterns: dict[str, str], text: Column) -> Column:
        out = F.array().cast("array<string>")
        for name, pattern in patterns.items():
            out = F.when(F.col("language") == name, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(out)
        return out

    clean: Column = F.col("text")
    for name, pattern in BLANKS.items():
        clean = F.when(F.col("language") == name, F.regexp_replace("text", pattern, "$1 ")).otherwise(clean)
    raw = F.when(F.col("language") == "c", F.col("text")).otherwise(clean)
    both = F.concat(
        F.transform(by_language(DECLARATIONS, clean), lambda n: F.struct(F.lit("declaration").alias("domain"), n.alias("name"))),
        F.transform(by_language(IMPORTS, raw), lambda n: F.struct(F.lit("import").alias("domain"), n.alias("name"))),
    )
    return rows.select("path", "language", F.explode(both).alias("f")).select("path", "language", "f.*", F.lit("lexical-occurrence").alias("claim")).distinct()


def occurrences(sources: DataFrame) -> DataFrame:
    """(path, domain, name, start, end) of called names and string literals in (path, text); offsets in the text.

    What stands before each match gives its offset, as comments and strings are matched as well and
    so cannot hold a call.
    """
    rows = sources.select("path", "text", language_of(F.col("path")).alias("language")).where("language is not null and text is not null")
    parts = []
    for language, blank in BLANKS.items():
        token = f"{blank}|{CALL}"
        own = rows.where(F.col("language") == language)
        hits = F.arrays_zip(
            F.regexp_extract_all("text", F.lit(token), F.lit(0)).alias("whole"), F.split("text", token, -1).alias("gap"),
            *[F.regexp_extract_all("text", F.lit(token), F.lit(i)).alias(n) for i, n in ((1, "quoted"), (2, "declares"), (3, "called"))],
        )
        each = own.select("path", F.posexplode(hits).alias("at", "x")).where("x.whole is not null").select("path", "at", "x.*")
        before = F.sum(F.length("gap") + F.length("whole")).over(Window.partitionBy("path").orderBy("at"))
        parts.append(each.withColumn("after", before).withColumn("start", F.col("after") - F.length("whole")))
    every = reduce(DataFrame.unionByName, parts)
    strings = every.where("quoted <> ''").select("path", F.lit("string").alias("domain"), F.col("quoted").alias("name"), "start", F.col("after").alias("end"))
    calls = every.where((F.col("called") != "") & ~F.col("declares").isin("def", "class", "function") & ~F.col("called").isin(*NO_CALL))
    at = F.col("start") + F.instr("whole", F.col("called")) - 1
    return strings.unionByName(calls.select("path", F.lit("call").alias("domain"), F.col("called").alias("name"), at.alias("start"), (at + F.length("called")).alias("end")))
