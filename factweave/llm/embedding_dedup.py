"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one class first. Each pass draws random hyperplanes, writes a class's sign bits
one after another as one number, sorts all classes by it, and compares each with its neighbours in
a bounded window by matrix products. The number of passes grows with that of the classes
(``passes_for``), and the rows at both edges of a partition are compared again across it. Verified
pairs are joined at once, so a window puts out a spanning set of links and never all its pairs; the
passes' links are united into components.

Passes carry a vector as bytes of its components' shares of the greatest one, a quarter of the size or
less. The rounding has a bound, so most pairs are certain; the few that are not, and that no
certain link joins, are decided by the vectors themselves.

Within a component, link counts are exact: its m members are dealt into about sqrt(m) / 2 blocks,
blocks are compared pairwise, and only counts leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from factweave.llm.common import Stages, bounds, connected_components, finite, groups_of, local_roots, partitions, small_batches

PASSES, PLANES, WINDOW, BLOCK = 16, 48, 64, 256
LEVELS = 127


def passes_for(classes: int, least: float = 0.9, recall: float = 0.95) -> int:
    """Passes that find ``recall`` of the pairs at cosine ``least`` among so many classes; PASSES at least.

    Two vectors at that cosine have a sign bit in common with probability q = 1 - acos(least) / pi.
    About log2(classes / WINDOW) common bits bring them within a window of each other, so a pass
    finds them with probability p = q ** log2(classes / WINDOW), and n passes with 1 - (1 - p) ** n.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, least))) / math.pi
    found = agree ** math.log2(max(2.0, classes / WINDOW))
    return max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-found))) if found < 1 else PASSES


def projection_keys(x: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Sign bits of PLANES random projections, first plane highest: n x passes longs."""
    planes = np.random.default_rng([x.shape[1], 29]).normal(size=(x.shape[1], passes * PLANES))
    powers, out = np.int64(1) << np.arange(PLANES - 1, -1, -1, dtype=np.int64), np.empty((len(x), passes), np.int64)
    for p in range(passes):
        out[:, p] = (x @ planes[:, p * PLANES : (p + 1) * PLANES] > 0) @ powers
    return out


def window_links(x: np.ndarray, least: float, slack: np.ndarray | None = None, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i < j <= i + window) of rows whose product may reach ``least``, and which surely do.

    ``slack``: how far each row may be from the unit vector that it stands for (none: not at all).
    A product of rows off by a and b is off by at most a + b + a * b.
    """
    left, right, sure = [], [], []
    off = np.zeros(len(x)) if slack is None else slack
    for at in range(0, len(x), window):
        product = x[at : at + window] @ x[at : at + 2 * window].T
        a, b = off[at : at + window, None], off[None, at : at + 2 * window]
        doubt = a + b + a * b
        i, j = np.nonzero(product + doubt >= least)
        near = (j > i) & (j - i <= window)
        i, j = i[near], j[near]
        left.append(i + at)
        right.append(j + at)
        sure.append(product[i, j] - (doubt[i, j] + (1e-12 if slack is not None else 0)) >= least)
    if not left:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return np.concatenate(left), np.concatenate(right), np.concatenate(sure)


def squeezed(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Unit rows as signed bytes, with the value of one step for each row."""
    step = np.abs(x).max(1) / LEVELS
    return [r.tobytes() for r in np.rint(x / step[:, None]).astype(np.int8)], step


def restored(column: pa.ChunkedArray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``squeezed`` and how far each may be from its unit vector."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(step), -1)
    return flat * step[:, None], 0.5 * step * math.sqrt(flat.shape[1]) + 1e-12


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as doubles of length 1."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(classes: DataFrame, passes: int) -> DataFrame:
    names = [f.split()[0] for f in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = unit_rows(part.column("v"))
                keys, (small, step) = projection_keys(x, passes), squeezed(x)
                small, step = pa.array(small, pa.binary()), pa.array(step)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), int(dim) * passes + p)), pa.array(keys[:, p]), part.column("node"), step, small], names=names)

    return classes.mapInArrow(run, _ROWS)


_ROWS = "turn long, bits long, node long, step double, small binary"
_SCANNED = f"a long, b long, sure boolean, edge int, {_ROWS}"
LEAST_ROWS, MOST_ROWS = 8 * WINDOW, 1 << 20  # of a partition, about


def _links_of(table: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Links among rows in order, turn by turn: a spanning set of the certain ones, and those uncertain that they don't join."""
    turn = table.column("turn").to_numpy()
    edge = bounds(turn)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        part = table.slice(lo, hi - lo)
        x, slack = restored(part.column("small"), part.column("step").to_numpy())
        i, j, sure = window_links(x, least, slack)
        if len(i):
            node = part.column("node").to_numpy()
            root = local_roots(len(node), i[sure], j[sure])
            moved = np.flatnonzero(root != np.arange(len(node)))
            yield _linked(node[moved], node[root[moved]], True)
            open_ = ~sure & (root[i] != root[j])
            yield _linked(node[i[open_]], node[j[open_]], False)


def _linked(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
    n = len(a)
    blank = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(n, sure)), *blank], names=[f.split()[0] for f in _SCANNED.split(", ")])


def _scan_windows(least: float):
    """Links (a, b) of a sorted partition, and its first and last WINDOW rows with the edge they lie at (a and b null).

    The edge between partitions p and p + 1 has number p + 1.
    """
    names = [f.split()[0] for f in _SCANNED.split(", ")]

    def at_edge(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        for b in table.combine_chunks().to_batches():
            none = pa.nulls(b.num_rows, pa.int64())
            edge = pa.array(np.full(b.num_rows, number, np.int32))
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(b.num_rows, pa.bool_()), edge, *(b.column(n) for n in names[4:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        tail: pa.Table | None = None
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            if seen < WINDOW:
                yield from at_edge(now.slice(0, WINDOW - seen), here)
            seen += b.num_rows
            table = pa.concat_tables([tail, now]) if tail is not None else now
            yield from _links_of(table, least)
            tail = table.slice(max(0, table.num_rows - WINDOW)).combine_chunks()
        if tail is not None:
            yield from at_edge(tail, here + 1)

    return run


def _scan_edges(least: float):
    """Links among the rows of each edge, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["edge"]):
            cut = bounds(table.column("edge").to_numpy())
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield from _links_of(table.slice(lo, hi - lo), least)

    return run


def _decide(least: float):
    """Those of the pairs (a, b, left, right) with a cosine of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sizes = pa.compute.list_value_length(b.column("left")).to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes):
                    part = b.filter(pa.array(sizes == dim))
                    near = (unit_rows(part.column("left")) * unit_rows(part.column("right"))).sum(1) >= least
                    yield part.select(["a", "b"]).filter(pa.array(near))

    return run


def _count_links(least: float):
    """Partial link counts (node, links) of the cells (component, one, two) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["component", "one", "two"]):
            keys = [table.column(c).to_numpy() for c in ("component", "one", "two")]
            edge = bounds(*keys)
            node, size, block = (table.column(c).to_numpy() for c in ("node", "size", "block"))
            x = unit_rows(table.column("v"))
            links = np.zeros(len(node), np.int64)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                same = keys[1][lo] == keys[2][lo]
                first = np.arange(lo, hi) if same else lo + np.flatnonzero(block[lo:hi] == keys[1][lo])
                second = first if same else lo + np.flatnonzero(block[lo:hi] == keys[2][lo])
                for at in range(0, len(first), BLOCK):
                    some = first[at : at + BLOCK]
                    near = x[some] @ x[second].T >= least
                    if same:
                        near[np.arange(len(some)), np.arange(at, at + len(some))] = False  # copies of itself count apart
                    links[some] += near @ size[second]
                    if not same:
                        links[second] += size[some] @ near
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], names=["node", "links"])

    return run


def near_duplicates(rows: DataFrame, least: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; components of any number type are taken.

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing.
    Repeated rows are vectors of their own and link with each other, and so do rows of one id with
    other vectors. Vectors of different lengths are not compared. A null vec_id links like any other
    but names no component: where a component has only those, component_id is null.
    """
    spark = rows.sparkSession
    stages, n = Stages(spark), partitions(spark)
    kind = rows.schema[vector].dataType.elementType
    kind = kind.simpleString() if isinstance(kind, (FloatType, DoubleType)) else "double"
    small_batches(spark)
    values = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    good = F.coalesce(finite("v") & F.exists("v", lambda x: x != 0), F.lit(False))
    own = values.select("vec_id", F.when(good, F.transform("v", lambda x: x + F.lit(0.0).cast(kind))).alias("v"))  # -0 becomes 0
    own = own.withColumn("hash", F.xxhash64("v"))
    grouped = own.where("v is not null").groupBy("hash", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    classes = stages.put(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")
    most = classes.groupBy("dim").count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(most, least)
    many = classes.count() * passes
    ranges = max(1, min(max(n, many // MOST_ROWS), many // LEAST_ROWS))
    order = ["turn", "bits", "node"]
    keyed = _keyed(classes.select("node", "v", "dim"), passes)
    sorted_rows = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    scanned = stages.put(sorted_rows.mapInArrow(_scan_windows(least), _SCANNED), "scanned")
    # the last rows of a partition and the first of the next meet by the number of their edge
    edges = scanned.where("a is null").repartition(n, "edge").sortWithinPartitions("edge", *order)
    across = edges.mapInArrow(_scan_edges(least), _SCANNED)
    found = stages.put(scanned.unionByName(across).where("a is not null").groupBy("a", "b").agg(F.max("sure").alias("sure")), "found")
    stages.drop("scanned")
    sides = [classes.select(F.col("node").alias(a), F.col("v").alias(v)) for a, v in (("a", "left"), ("b", "right"))]
    open_pairs = found.where("not sure").join(sides[0], "a").join(sides[1], "b").select("a", "b", "left", "right")
    links = stages.put(found.where("sure").select("a", "b").unionByName(open_pairs.mapInArrow(_decide(least), "a long, b long")), "links")
    linked = stages.put(connected_components(stages, links), "linked")
    for name in ("found", "links"):
        stages.drop(name)
    own_first = linked.join(classes.select("node", "first"), "node")
    whole = own_first.groupBy("component").agg(F.min("first").alias("component_id"), F.ceil(F.sqrt(F.count("*")) / 2).cast("int").alias("blocks"))
    whole = stages.put(whole, "whole")
    told = stages.put(linked.join(whole.hint("merge"), "component"), "told")  # a sort-merge join of tables: a large component's rows are split
    placed = classes.join(told, "node")
    member = placed.select("component", "node", "size", "v", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int").alias("block"), "blocks")
    cells = member.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = cells.select("component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "size", "v", "block")
    cell = ["component", "one", "two"]
    dealt = cells.repartitionByRange(n, *cell).sortWithinPartitions(*cell)  # by range, as cells are alike: hashing would deal several to one task
    counts = dealt.mapInArrow(_count_links(least), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.join(told, "node", "left").join(counts, "node", "left")
    named = joined.select(
        "hash", F.col("v").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"), F.lit(True).alias("known"),
    )
    match = (own["hash"] == named["hash"]) & (own["v"] == named["same"])
    out = own.join(named, match, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
