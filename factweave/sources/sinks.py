"""Sinks: canonical JSON, Markdown, SARIF, JUnit, GraphML, Mermaid, concept bundles, baselines."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

MOST_ROWS = 10_000


def canonical_json(df: DataFrame) -> DataFrame:
    """(json, sha256) per row: keys sorted at every level, maps too; nulls kept."""
    body = F.to_json(F.struct(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]), {"ignoreNullFields": "false"})
    return df.select(body.alias("json")).withColumn("sha256", F.sha2("json", 256))


def _sorted(value: Column, kind: DataType) -> Column:
    """A value with the keys of its structs and maps in order."""
    if isinstance(kind, StructType):
        own = F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), own)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def _rows(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """A report's rows on the driver; more than ``most`` raise, as a report is for reading."""
    rows = df.orderBy(*df.columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    return [r.asDict() for r in rows]


def markdown(df: DataFrame, title: str, budget: int = 12_000) -> str:
    """A table cut to whole rows within a budget of characters, with how many were left out."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines = ["| " + " | ".join(str(v).replace("|", "\\|") for v in r.values()) + " |" for r in _rows(df)]
    used, kept = sum(len(x) + 1 for x in head) + 40, 0
    while kept < len(lines) and used + len(lines[kept]) + 1 <= budget:
        used += len(lines[kept]) + 1
        kept += 1
    rest = [f"({len(lines) - kept} more rows)"] if kept < len(lines) else []
    return "\n".join([*head, *lines[:kept], *rest]) + "\n"


def sarif(found: DataFrame, tool: str = "factweave") -> str:
    """Findings (check, comparison, key, state) as SARIF 2.1.0."""
    results = [{"ruleId": r["check"], "level": "error" if r["state"] == "current" else "warning", "message": {"text": f"{r['comparison']}: {r['key']}"}} for r in _rows(found)]
    rules = [{"id": x} for x in sorted({r["ruleId"] for r in results})]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}, sort_keys=True)


def junit(statuses: DataFrame, name: str = "verification") -> str:
    """Checks (check, status) as a JUnit suite: fail is a failure, unknown an error, waived skipped."""
    tags = {"fail": "failure", "unknown": "error", "waived": "skipped", "not_applicable": "skipped"}
    rows = _rows(statuses)
    cases = []
    for r in rows:
        tag = tags.get(r["status"])
        inner = f"<{tag} message={quoteattr(r['status'])}/>" if tag else ""
        cases.append(f"<testcase name={quoteattr(r['check'])}>{inner}</testcase>")
    failed = sum(r["status"] == "fail" for r in rows)
    return f"<testsuite name={quoteattr(name)} tests=\"{len(rows)}\" failures=\"{failed}\">{''.join(cases)}</testsuite>"


def graph_json(nodes: DataFrame, relations: DataFrame, most_names: int = 8) -> str:
    """Nodes and relations as canonical JSON; of a relation's names (if there) the first ``most_names``, and how many were left out."""

    def shown(r: dict) -> dict:
        names = sorted(r.get("names") or [])
        return r | ({"names": names[:most_names], "more_names": max(0, len(names) - most_names)} if "names" in r else {})

    return json.dumps({"nodes": _rows(nodes), "relations": [shown(r) for r in _rows(relations)]}, sort_keys=True, separators=(",", ":"))


def graphml(nodes: DataFrame, relations: DataFrame) -> str:
    n = "".join(f"<node id={quoteattr(r['node'])}><data key=\"kind\">{escape(str(r['kind']))}</data></node>" for r in _rows(nodes))
    e = "".join(f"<edge source={quoteattr(r['source'])} target={quoteattr(r['target'])}><data key=\"family\">{escape(str(r['family']))}</data></edge>" for r in _rows(relations))
    keys = '<key id="kind" for="node" attr.name="kind" attr.type="string"/><key id="family" for="edge" attr.name="family" attr.type="string"/>'
    return f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">{n}{e}</graph></graphml>'


def mermaid(nodes: DataFrame, relations: DataFrame, direction: str = "LR", most_nodes: int = 200) -> str:
    """The first nodes in byte order and the relations between them."""
    if direction not in ("LR", "RL", "TB", "BT"):
        raise ValueError(direction)
    names = [r["node"] for r in nodes.orderBy("node").limit(most_nodes).collect()]
    at = {n: f"n{i}" for i, n in enumerate(names)}
    quoted = [f'  {at[n]}["{n.replace(chr(34), "#quot;")}"]' for n in names]
    kept = relations.where(F.col("source").isin(names) & F.col("target").isin(names))
    arrows = [f"  {at[r['source']]} -->|{r['family']}| {at[r['target']]}" for r in _rows(kept)]
    return "\n".join([f"flowchart {direction}", *quoted, *arrows]) + "\n"


def concept_query(concepts: DataFrame, types: tuple = (), tags: tuple = (), text: str = "") -> DataFrame:
    """Concepts (id, type, tags, body) by type, all tags (folded) and a folded text."""
    keep: Column = F.col("type").isin(*types) if types else F.lit(True)
    for tag in tags:
        keep = keep & F.array_contains(F.transform("tags", F.lower), tag.lower())
    return concepts.where(keep & (F.contains(F.lower("body"), F.lit(text.lower())) if text else F.lit(True)))


def next_baseline(found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(comparison, key, status) of the next baseline: active findings, and those resolved now or before.

    before: the last baseline, of the same columns. A finding that is active again is active.
    """
    active = found.select("comparison", "key").distinct().withColumn("status", F.lit("active"))
    if before is None:
        return active
    gone = before.select("comparison", "key").distinct().join(active, ["comparison", "key"], "left_anti")
    return active.unionByName(gone.withColumn("status", F.lit("resolved")))


def freeze_baseline(found: DataFrame, path: str, before: DataFrame | None = None) -> None:
    """Write the next baseline to a new folder; an existing one is not overwritten, as ``before`` may still be read."""
    next_baseline(found, before).write.mode("error").parquet(path)


def derive_actions(found: DataFrame) -> DataFrame:
    """Candidate actions from findings, ordered: additions before redirects before removals."""
    action = F.when(F.col("comparison") == "missing", "add").when(F.col("comparison").isin("different", "unregistered"), "change").when(F.col("comparison").isin("extra", "forbidden", "overlap"), "remove").otherwise("manual")
    step = F.when(action == "add", 0).when(action == "change", 1).when(action == "remove", 2).otherwise(3)
    return found.select(action.alias("action"), "key", "comparison", step.alias("step")).distinct()


def unified_diff(rows: DataFrame, context: int = 3) -> DataFrame:
    """(path, diff) from (path, before, after), in Arrow batches; a null side is an absent file, equal texts give ''."""
    import difflib

    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for path, old, new in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                names = ("/dev/null" if old is None else f"a/{path}", "/dev/null" if new is None else f"b/{path}")
                lines = difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), *names, n=context, lineterm="")
                out.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["path", "diff"])

    return rows.select("path", "before", "after").mapInArrow(run, "path string, diff string")
