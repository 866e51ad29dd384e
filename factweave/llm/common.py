"""Helpers shared by the training-data operators: staged tables, Arrow iteration, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
#: Drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on local masters a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="factweave-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return "file://" + _OWN_DIRS[app]


class Stages:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/factweave-{uuid.uuid4().hex}"
        self.kept = False

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # a written stage is not computed again
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        if not self.kept:  # what is not dropped before goes when the driver ends
            self.kept = True
            self._file_system("").deleteOnExit(self._path(""))
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _file_system(self, name: str):
        return self._path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, name: str) -> None:
        """Delete a stage that nothing reads any more."""
        self._file_system(name).delete(self._path(name), True)

    def release(self) -> None:
        """Let Spark's cleaner drop shuffle files of plans that are no longer referenced."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as single texts may be very long; the same for every operator."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 3 (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3


def finite(vector: str) -> Column:
    """True for vectors without null or non-finite components."""
    inf = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf)), F.lit(False)
    )


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_RUN = 256


def laid_end_to_end(items: Column, size: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """make(item, offset) of every item of an array, offset being the sizes of those before it.

    The array is walked in runs of ``_RUN``, as appending to one growing array costs its square.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def offsets(sizes: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(
            sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"]
        )

    def whole(own: Column) -> Column:
        sizes = F.transform(own, lambda x: size(x).cast("long"))
        runs = bound(sizes, lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _RUN).cast("int")), lambda r: F.slice(z, r * _RUN + 1, F.lit(_RUN))))

        def spread(r: Column) -> Column:
            firsts = offsets(F.transform(r, lambda z: F.aggregate(z, zero, lambda a, n: a + n)), zero)
            return F.flatten(F.zip_with(r, firsts, offsets))

        return F.zip_with(own, bound(runs, spread), make)

    return bound(items, lambda own: F.when(F.size(own) > 0, whole(own)).otherwise(F.transform(own, lambda x: make(x, zero))))


_BLOCK = 4096


def text_blocks(text: Column) -> Column:
    """The text in blocks of ``_BLOCK`` code points, for ``cut_blocks``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def cut_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in blocks, without walking the text from its start."""
    first = F.floor(start / _BLOCK).cast("int")
    count = F.when(end > start, F.floor((end - 1) / _BLOCK).cast("int") - first + 1).otherwise(0)

    def part(block: Column, i: Column) -> Column:
        base = (first + i) * _BLOCK
        low = F.greatest(start - base, F.lit(0)).cast("int")
        return block.substr(low + 1, F.least(end - base, F.lit(_BLOCK)).cast("int") - low)

    return F.array_join(F.transform(F.slice(blocks, first + 1, count), part), "")


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups, several at a time, from a partition sorted by the keys.

    Yields tables that start and end at group boundaries, so a caller can work on many small
    groups at once; ``bounds`` finds the groups in one.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = [held[-1].column(k)[-1].as_py() for k in keys]
            if last == [batch.column(k)[-1].as_py() for k in keys]:
                held.append(batch)
                continue
            cut = int(_same_as(batch, keys, last).sum())
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            batch = batch.slice(cut)
        start = batch.num_rows - int(_same_as(batch, keys, [batch.column(k)[-1].as_py() for k in keys]).sum())
        if start:
            yield pa.Table.from_batches([batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _same_as(batch: pa.RecordBatch, keys: list[str], values: list) -> np.ndarray:
    out = np.ones(batch.num_rows, bool)
    for k, v in zip(keys, values, strict=True):
        out &= batch.column(k).to_numpy(zero_copy_only=False) == v
    return out


def bounds(*keys: np.ndarray) -> np.ndarray:
    """Start offsets of runs of equal keys, with the total length at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links (a, b) among 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


_HEAVY = 500  # a node is heavy if it has more than this share of all links


def _with_least(rows: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """rows (u, v) with m, the least neighbour of u (least: u, m, n).

    Nodes with over ``limit`` links are few: theirs are broadcast, and their rows go to the other join
    under keys of their own, where what they may meet is not used.
    """
    heavy = F.broadcast(least.where(F.col("n") > limit).select("u", F.col("m").alias("known")))
    spread = rows.join(heavy, "u", "left").withColumn("key", F.when(F.col("known").isNull(), F.col("u")).otherwise(-1 - F.col("v")))
    return spread.join(least.select(F.col("u").alias("key"), "m"), "key", "left").select("u", "v", F.coalesce("known", "m").alias("m"))


def connected_components(stages: Stages, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link to another.

    ``edges`` has long columns a and b. Alternating large-star and small-star rounds: each is an
    aggregate with map-side combine and a join. The links of a hub are not brought together: the
    nodes with more than a 500th of all links, 1,000 at most, get their figures by a broadcast. Every
    round is written to the shared folder; the driver sees two numbers a round. Links to itself and
    nulls are ignored.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, turn, seen = stages.put(clean, f"{name}-0"), 0, None
    while True:
        digest = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if digest == seen:
            break
        seen = digest
        limit = max(256, digest[0] // _HEAVY)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), least, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            _with_least(large, low, limit)
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        turn += 1
        now = stages.put(small, f"{name}-{turn}")
        stages.drop(f"{name}-{turn - 1}")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow for a function from a table to a dict of columns."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], (pa.Array, pa.ChunkedArray)) else pa.array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)
