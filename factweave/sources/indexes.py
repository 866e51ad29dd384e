"""Semantic indexes and external matches as facts: SCIP files and structural search results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of an occurrence's roles in the SCIP format.
ROLES = {1: "definition", 2: "import", 4: "write", 8: "read", 16: "generated", 32: "test", 64: "forward"}
_OCCURRENCES = "path string, language string, symbol string, roles string, line long, start long, end_line long, end long, problem string"


def _messages(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message; ValueError if it is cut off."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("cut off")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if kind == 2 else size
        if size is None or at + size > len(data):
            raise ValueError("cut off" if size is not None else f"wire type {kind}")
        yield tag >> 3, data[at : at + size]
        at += size


def _numbers(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value = shift = 0
    return out


def _documents(data: bytes) -> Iterator[tuple]:
    for number, document in _messages(data):
        if number != 2 or not isinstance(document, bytes):
            continue
        path, language, found = "", "", []
        for n, value in _messages(document):
            if n == 1:
                path = value.decode()
            elif n == 4:
                language = value.decode()
            elif n == 2:
                own: dict = {1: []}
                for k, v in _messages(value):
                    if k == 1:  # packed or one by one
                        own[1] += _numbers(v) if isinstance(v, bytes) else [v]
                    else:
                        own[k] = v
                at = own[1]
                if len(at) not in (3, 4):
                    raise ValueError("a range of neither three nor four numbers")
                bits = own.get(3, 0)
                roles = ",".join(name for bit, name in ROLES.items() if bits & bit) or "reference"
                found.append((own.get(2, b"").decode(), roles, at[0], at[1], at[2] if len(at) == 4 else at[0], at[-1]))
        yield from ((path, language, *x, None) for x in found)


def scip(indexes: DataFrame) -> DataFrame:
    """(path, language, symbol, roles, line, start, end_line, end, problem) of SCIP indexes (path, content).

    Lines and columns count from 0. An index that can't be read gives one row with its own path and
    what is wrong, and nothing else. The format is binary, so this is an Arrow-batched ingest step.
    """
    names = [f.split()[0] for f in _OCCURRENCES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out += list(_documents(bytes(content or b"")))
                except (ValueError, UnicodeDecodeError) as e:
                    out.append((path, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in ("line", "start", "end_line", "end")})

    return indexes.select("path", "content").mapInPandas(run, _OCCURRENCES)


def structural_matches(texts: DataFrame) -> DataFrame:
    """(path, rule, language, text, line, start, end) of ast-grep's JSON results in (text); offsets in bytes, lines from 0."""
    place = "struct<line:bigint,column:bigint>"
    kind = f"array<struct<file:string,ruleId:string,language:string,text:string,range:struct<byteOffset:struct<start:bigint,end:bigint>,start:{place},end:{place}>>>"
    rows = texts.select(F.explode(F.from_json("text", kind)).alias("m"))
    return rows.select(
        F.col("m.file").alias("path"), F.coalesce("m.ruleId", F.lit("")).alias("rule"), F.col("m.language").alias("language"), F.col("m.text").alias("text"),
        F.col("m.range.start.line").alias("line"), F.col("m.range.byteOffset.start").alias("start"), F.col("m.range.byteOffset.end").alias("end"),
    )
