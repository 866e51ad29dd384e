"""Exact top-k inner-product search by block-at-a-time pruning.

Rows are ordered by the sign bits of random projections, so that like vectors stand together, and
cut into document-range blocks. A block keeps a forward index (its integer matrix) and each term's
maximum and minimum, a term being a component. For a query, the sum of its weights times those
maxima (minima for negative weights) bounds every score in the block.

*Shards.* A range of blocks is a shard; there are at most ``MOST_SHARDS``, so their maxima have a fixed
size and go to every task. Queries are rows themselves: each one first searches its own shard,
which gives it a kth score to start from. It is then sent only to the shards whose bound reaches
that score, and the index is shuffled once.

*Blocks.* In a shard, each query takes the blocks by falling bound and stops at the first bound below
its kth score; queries that want the same block next are scored by one matrix product. A shard that
very many queries ask is copied, and its queries are dealt over the copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import Stages, bounds, finite, groups_of, partitions, small_batches

BLOCK = 64
SHARD_ROWS, LEAST_SHARDS, MOST_SHARDS = 4096, 8, 4096
DEALT = 1 << 16  # queries to one copy of a shard
STEP = 2048  # queries scored at a time
BITS = 24
LOW, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max

BLOCKS, ASKS, MAXIMA = 0, 1, 2  # kinds of rows of the index


def quantised(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


class Block:
    """A block's forward index with its term maxima and minima."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.cells, self.top, self.low = ids, cells, cells.max(0), cells.min(0)


def search_blocks(
    q: np.ndarray, q_ids: np.ndarray, blocks: list[Block], k: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best (score, id) over the blocks, and how many blocks it visited.

    ``floor``: a score each query's results must reach (none: any). Score LOW marks an empty place.
    Ties go to the smaller id; a block is skipped only if its bound is below the kth score, so ties
    at the kth are all seen. An id with several vectors counts once, by its best.
    """
    top, low = (np.array([getattr(b, side) for b in blocks], np.int64) for side in ("top", "low"))
    reach = max(1, int(np.abs(q.astype(float)).max(initial=0))) * max(1, int(np.abs(np.r_[top, low].astype(float)).max(initial=0))) * max(1, q.shape[1])
    kind = np.float64 if reach < 2**53 else np.longdouble  # both exact in their range
    qk = q.astype(kind)
    limit = np.maximum(qk, 0) @ top.T.astype(kind) + np.minimum(qk, 0) @ low.T.astype(kind)
    order = np.argsort(-limit, axis=1, kind="stable")
    every = np.concatenate([b.ids for b in blocks])
    repeats = len(np.unique(every)) < len(every)
    score = np.full((len(q), k), LOW, np.int64)
    found = np.full((len(q), k), NONE, np.int64)
    least = np.full(len(q), LOW, np.int64) if floor is None else floor.astype(np.int64)
    alive, visits = np.arange(len(q)), np.zeros(len(q), np.int64)
    for turn in range(len(blocks)):
        want = order[alive, turn]
        alive = alive[limit[alive, want] >= np.maximum(score[alive, -1], least[alive])]
        if not len(alive):
            break
        want = order[alive, turn]
        visits[alive] += 1
        for at in np.unique(want):
            rows, block = alive[want == at], blocks[at]
            got = qk[rows] @ block.cells.T.astype(kind)
            if reach >= 2**62:
                got = np.clip(got, -(2.0**63) + 1024, 2.0**63 - 1024)
            got = got.astype(np.int64)
            got[q_ids[rows][:, None] == block.ids[None, :]] = LOW
            better = (got >= np.maximum(score[rows, -1:], least[rows][:, None])).any(1)
            rows, got = rows[better], got[better]
            both = np.concatenate([score[rows], got], axis=1)
            names = np.concatenate([found[rows], np.broadcast_to(block.ids, got.shape)], axis=1)
            if repeats:
                _once(both, names)
            best = np.lexsort((names, -both.astype(np.longdouble)), axis=1)[:, :k]
            score[rows], found[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
    return score, found, visits


def _once(score: np.ndarray, names: np.ndarray) -> None:
    """Empty all but the best place of each id in a row."""
    order = np.lexsort((-score.astype(np.longdouble), names), axis=1)
    sorted_names = np.take_along_axis(names, order, 1)
    again = np.zeros(score.shape, bool)
    np.put_along_axis(again, order[:, 1:], (sorted_names[:, 1:] == sorted_names[:, :-1]) & (sorted_names[:, 1:] != NONE), 1)
    score[again], names[again] = LOW, NONE


def _codes(vectors: DataFrame) -> DataFrame:
    """(dim, code, id, asks, cells) of (id, cells, asks): sign bits of random projections; cells as bytes."""
    names = ["dim", "code", "id", "asks", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("cells")
            dims = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = part.column("cells").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, int(dim))
                signs = x.astype(np.float64) @ np.random.default_rng([int(dim), 3]).normal(size=(int(dim), BITS)) > 0
                code = signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                cells = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, np.int32)), pa.array(code.astype(np.int64)), part.column("id"), part.column("asks"), cells], names=names)

    return vectors.mapInArrow(run, "dim int, code long, id long, asks boolean, cells binary")


_INDEX = "kind int, shard int, dim int, ids binary, cells binary, score binary, found binary, visits binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("dim", pa.int32()), *[(n, pa.binary()) for n in ("ids", "cells", "score", "found", "visits")]])


def _row(kind: int, shard: int, dim: int, **columns: np.ndarray) -> pa.RecordBatch:
    values = {"kind": [kind], "shard": [shard], "dim": [dim]} | {n: [columns[n].astype(np.int64).tobytes() if n in columns else None] for n in _SCHEMA.names[3:]}
    return pa.RecordBatch.from_pydict(values, schema=_SCHEMA)


def _index(k: int):
    """Rows of a shard (a partition in order) as blocks, its maxima, and its queries with what they find in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table)
        dims, ids = (table.column(c).to_numpy() for c in ("dim", "id"))
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        raw = table.column("cells").to_pylist()
        edge = bounds(dims)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            keep, seen, last = [], set(), None
            for i in range(lo, hi):  # equal rows are in one partition, in order of code and id
                if ids[i] != last:
                    seen, last = set(), ids[i]
                if raw[i] not in seen:
                    seen.add(raw[i])
                    keep.append(i)
            dim = int(dims[lo])
            cells = np.frombuffer(b"".join(raw[i] for i in keep), np.int64).reshape(len(keep), dim)
            own, wants = ids[keep], asks[keep]
            blocks = [Block(own[i : i + BLOCK], cells[i : i + BLOCK]) for i in range(0, len(own), BLOCK)]
            for b in blocks:
                yield _row(BLOCKS, shard, dim, ids=b.ids, cells=b.cells)
            yield _row(MAXIMA, shard, dim, ids=np.array([len(blocks)]), cells=np.concatenate([cells.max(0), cells.min(0)]))
            q, q_ids = cells[wants], own[wants]
            for at in range(0, len(q), STEP):
                part = slice(at, at + STEP)
                score, found, visits = search_blocks(q[part], q_ids[part], blocks, k)
                yield _row(ASKS, shard, dim, ids=q_ids[part], cells=q[part], score=score, found=found, visits=visits)

    return run


_ASKED = "shard int, kind int, dim int, salt int, id long, floor long, ids binary, cells binary"


def _route(shared: Broadcast, k: int):
    """Queries of the index to the other shards whose bound reaches their kth score; ``shared``: maxima by length."""
    names = [f.split()[0] for f in _ASKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, home = b.column("dim")[i].as_py(), b.column("shard")[i].as_py()
                ids, cells, score = (np.frombuffer(b.column(n)[i].as_py(), np.int64) for n in ("ids", "cells", "score"))
                shards, top, low = shared.value[dim]
                q, floor = cells.reshape(len(ids), dim), score.reshape(len(ids), k)[:, -1]
                qk = q.astype(np.longdouble if max(np.abs(cells).max(initial=0), np.abs(top).max(initial=0), np.abs(low).max(initial=0)) >= 2**23 else np.float64)
                limit = np.maximum(qk, 0) @ top.T.astype(qk.dtype) + np.minimum(qk, 0) @ low.T.astype(qk.dtype)
                who, where = np.nonzero((limit >= floor[:, None]) & (shards != home)[None, :])
                for at in range(0, len(who), STEP):
                    w, s = who[at : at + STEP], shards[where[at : at + STEP]]
                    n = len(w)
                    columns = [pa.array(s.astype(np.int32)), pa.array(np.full(n, ASKS, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(ids[w]), pa.array(floor[w]), pa.nulls(n, pa.binary()), pa.array([r.tobytes() for r in q[w]], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_LIST = "query_id long, score binary, found binary, visits long"


def _lists(ids: np.ndarray, score: np.ndarray, found: np.ndarray, visits: np.ndarray) -> pa.RecordBatch:
    """A row for each query: what it found, and in how many blocks."""
    full = score != LOW
    got = [[x[i][full[i]].tobytes() for i in range(len(ids))] for x in (score, found)]
    columns = [pa.array(ids), pa.array(got[0], pa.binary()), pa.array(got[1], pa.binary()), pa.array(visits)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _LIST.split(", ")])


def _merge(k: int):
    """The k best of all lists of each query, in rows sorted by query; an id counts once, by its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["query_id"]):
            query = table.column("query_id").to_numpy()
            lists = [table.column(c).to_pylist() for c in ("score", "found")]
            out = []
            edge = bounds(query)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                score, found = (np.frombuffer(b"".join(x[lo:hi]), np.int64) for x in lists)
                order = np.lexsort((found, ~score))  # by falling score
                _, first = np.unique(found[order], return_index=True)
                best = order[np.sort(first)[:k]]
                out.append((np.full(len(best), query[lo]), np.arange(1, len(best) + 1, dtype=np.int32), found[best], score[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return run


def _search(k: int):
    """Blocks and then queries of each (shard, salt, dim), in order: lists of results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks = None, []
        for b in batches:
            if not b.num_rows:
                continue
            shard, salt, dim, kind, ids, floor = (b.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "salt", "dim", "kind", "id", "floor"))
            edge = bounds(shard, salt, dim, kind)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                here, width = (shard[lo], salt[lo], dim[lo]), int(dim[lo])
                if here != held:
                    held, blocks = here, []
                cells = b.column("cells").slice(lo, hi - lo).to_pylist()
                if kind[lo] == BLOCKS:
                    for own, c in zip(b.column("ids").slice(lo, hi - lo).to_pylist(), cells, strict=True):
                        own = np.frombuffer(own, np.int64)
                        blocks.append(Block(own, np.frombuffer(c, np.int64).reshape(len(own), width)))
                    continue
                q = np.frombuffer(b"".join(cells), np.int64).reshape(hi - lo, width)
                for at in range(0, hi - lo, STEP):
                    part = slice(lo + at, min(hi, lo + at + STEP))
                    score, found, visits = search_blocks(q[at : at + STEP], ids[part], blocks, k, floor[part])
                    yield _lists(ids[part], score, found, visits)

    return run


def _own_lists(k: int):
    """What queries found in their own shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, score, found, visits = (np.frombuffer(b.column(n)[i].as_py(), np.int64) for n in ("ids", "score", "found", "visits"))
                yield _lists(ids, score.reshape(len(ids), k), found.reshape(len(ids), k), visits)

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row where ``is_query``.

    Rows with a null id, a null vector or one with null or non-finite components take no part;
    repeated rows count once; an id with several vectors counts by its best; a query's own id is no
    candidate; vectors meet only vectors of their own length. Fewer than k candidates: all. Empty
    table: no rows. ``visited_share`` tells how much pruning left to do.
    """
    lists = _all_lists(rows, is_query, k, vec_id, vector)[0].select("query_id", "score", "found")
    dealt = lists.repartition(partitions(rows.sparkSession), "query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score long")


def visited_share(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, visits, blocks): how many of all blocks a query was scored against."""
    lists, index = _all_lists(rows, is_query, k, vec_id, vector)
    visits = lists.groupBy("query_id").agg(F.sum("visits").alias("visits"))
    return visits.withColumn("blocks", F.lit(index.where(F.col("kind") == BLOCKS).count()))


def _all_lists(rows: DataFrame, is_query: Column, k: int, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    spark = rows.sparkSession
    stages = Stages(spark)
    small_batches(spark)
    clean = rows.where(F.col(vec_id).isNotNull() & finite(vector)).select(F.col(vec_id).cast("long").alias("id"), quantised(vector).alias("cells"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    coded = stages.put(_codes(clean), "codes")
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, -(-coded.count() // SHARD_ROWS)))
    order = ["dim", "code", "id"]
    ranged = coded.repartitionByRange(shards, *order).sortWithinPartitions(*order, "cells")
    index = stages.put(ranged.mapInArrow(_index(k), _INDEX), "index")
    stages.drop("codes")
    maxima: dict[int, list] = {}
    for r in index.where(F.col("kind") == MAXIMA).select("shard", "dim", "cells").collect():  # at most MOST_SHARDS, and one more for each length
        maxima.setdefault(r.dim, []).append((r.shard, *np.frombuffer(bytes(r.cells), np.int64).reshape(2, -1)))
    known = {dim: tuple(np.array(c, np.int64) for c in zip(*sorted(own, key=lambda x: x[0]), strict=True)) for dim, own in maxima.items()}
    queries = index.where(F.col("kind") == ASKS)
    asked = stages.put(queries.select("shard", "dim", "ids", "cells", "score").mapInArrow(_route(spark.sparkContext.broadcast(known), k), _ASKED), "asked")
    copies = asked.groupBy("shard", "dim").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("copies"))
    copies = F.broadcast(copies)  # as many rows as maxima
    told = asked.join(copies, ["shard", "dim"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("copies").cast("long")).cast("int"))
    own = index.where(F.col("kind") == BLOCKS).join(copies, ["shard", "dim"]).withColumn("salt", F.explode(F.expr("sequence(0, copies - 1)")))
    zero = F.lit(0).cast("long")  # nulls would make floats of the column
    names = [f.split()[0] for f in _ASKED.split(", ")]
    both = own.withColumns({"id": zero, "floor": zero}).select(*names).unionByName(told.select(*names))
    dealt = both.repartition(max(partitions(spark), shards), "shard", "salt").sortWithinPartitions("shard", "salt", "dim", "kind")
    lists = dealt.mapInArrow(_search(k), _LIST)
    at_home = queries.select("ids", "score", "found", "visits").mapInArrow(_own_lists(k), _LIST)
    return at_home.unionByName(lists), index


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
