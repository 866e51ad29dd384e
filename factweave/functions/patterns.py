"""Path and name patterns, compiled on the driver to Java regular expressions (no UDF).

Four dialects differ on purpose: in ``glob`` a star crosses slashes, ``path`` adds ``/**`` rules,
``collection`` is segment-wise, ``selector`` also takes a directory for what lies below it. Each
also yields the literal prefix, so that scans get a pushed-down ``startswith``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = set("*?[")
_SPECIAL = set("\\.^$|()[]{}*+?")


def _quote(text: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def _class_end(pattern: str, at: int) -> int:
    """Index of the bracket that closes a class opened at ``at``; -1: none."""
    first = at + 1
    if first < len(pattern) and pattern[first] in "!^":
        first += 1
    return pattern.find("]", first + 1) if first < len(pattern) else -1


def _body(pattern: str, star: str, one: str) -> str:
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        end = _class_end(pattern, at) if c == "[" else -1
        if end > 0:
            inner = pattern[at + 1 : end]
            negated = inner[:1] in ("!", "^")
            members = (inner[1:] if negated else inner).replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&").replace("^", "\\^")
            out.append(f"[{'^' if negated else ''}{members}]")
            at = end
        else:
            out.append(star if c == "*" else one if c == "?" else _quote(c))
        at += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """``*`` any run, slashes too; ``?`` one character; ``[a-z]``, ``[!x]``; an open class is a literal."""
    return rf"(?s)\A{_body(pattern, '.*', '.')}\z"


def path_regexes(pattern: str) -> list[str]:
    """As glob, and with each ``/**/`` as one slash, and ``X/**`` for X itself and what is below."""
    out = [glob_regex(pattern)]
    if "/**/" in pattern:
        out.append(glob_regex(pattern.replace("/**/", "/")))
    if pattern.endswith("/**"):
        out.append(glob_regex(pattern[:-3]))
    return out


def collection_regex(pattern: str) -> str:
    """Segment-wise: ``**`` any number of segments, ``*`` and ``?`` inside one."""
    parts = pattern.split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _body(part, "[^/]*", "[^/]") + ("" if last else "/")
    return rf"(?s)\A{out}\z"


def literal_prefix(pattern: str) -> str:
    cut = next((i for i, c in enumerate(pattern) if c in WILD), len(pattern))
    return pattern[:cut]


def _any(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def glob(col: Column, pattern: str) -> Column:
    if not WILD & set(pattern):
        return col == pattern
    prefix = literal_prefix(pattern)
    hit = col.rlike(glob_regex(pattern))
    return col.startswith(prefix) & hit if prefix else hit


def globs(col: Column, patterns: Iterable[str]) -> Column:
    return _any(glob(col, p) for p in patterns)


def path_glob(col: Column, pattern: str) -> Column:
    return _any(col.rlike(r) for r in path_regexes(pattern))


def collection_glob(col: Column, pattern: str) -> Column:
    tail = pattern.rsplit("/", 1)[-1]
    suffix = tail[max((i for i, c in enumerate(tail) if c in "*?]"), default=-1) + 1 :]
    return col.endswith(suffix) & col.rlike(collection_regex(pattern))


def selector(col: Column, pattern: str) -> Column:
    """Exact, glob, or a directory without wildcard for everything below it."""
    clean = pattern.removeprefix("./").rstrip("/")
    if WILD & set(clean):
        return glob(col, clean)
    return (col == clean) | col.startswith(clean + "/")


def selectors(col: Column, patterns: Iterable[str]) -> Column:
    """An empty list selects all."""
    patterns = list(patterns)
    return _any(selector(col, p) for p in patterns) if patterns else F.lit(True)


def among(col: Column, values: Iterable[str]) -> Column:
    """Exact membership; an empty list selects all."""
    values = list(values)
    return col.isin(*values) if values else F.lit(True)


def ignore_decision(path: Column, rules: list[str]) -> Column:
    """Layered ignore rules: the last that matches decides; ``!`` negates, ``/`` anchors."""
    out = F.lit(False)
    for rule in rules:
        body = rule.removeprefix("!").rstrip("/")
        pattern = body.lstrip("/") if "/" in body else f"**/{body}"
        hit = path.rlike(collection_regex(pattern)) | path.rlike(collection_regex(pattern + "/**"))
        out = F.when(hit, F.lit(not rule.startswith("!"))).otherwise(out)
    return out


def layered_ignore(path: Column, sources: list[tuple[str, list[str]]]) -> Column:
    """Whether ignore files rule a path out; sources: (folder, lines), ``""`` for the root.

    A file's rules hold below its folder, deeper files' after shallower ones', and the last that
    matches decides. ``/`` at the end asks for a folder, one elsewhere anchors the rule to its file's
    folder, ``!`` takes a decision back. What lies in a folder that is ruled out stays out.
    """
    rules = []
    for folder, lines in sorted(sources, key=lambda x: (x[0].count("/") + bool(x[0]), x[0])):
        for line in lines:
            rule = line.rstrip("\n").rstrip(" ")
            if not rule or rule.startswith("#"):
                continue
            body = rule.removeprefix("!").removeprefix("\\")
            inner = body.rstrip("/")
            tail = inner.lstrip("/") if "/" in inner else f"**/{inner}"
            rules.append((collection_regex("/".join(x for x in (folder, tail) if x)), not rule.startswith("!"), body.endswith("/")))

    def decided(one: Column, is_folder: bool) -> Column:
        out = F.lit(False)
        for regex, ignored, folders_only in rules:
            if is_folder or not folders_only:
                out = F.when(one.rlike(regex), F.lit(ignored)).otherwise(out)
        return out

    parts = F.split(path, "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    return F.exists(folders, lambda f: decided(f, True)) | decided(path, False)
