"""Exact removal of repeated passages with a sampled, bucketed suffix array.

*Sampling.* Every window of ``NEED`` bytes has an anchor: the ``GRAM``-byte string in it with the
least hash, leftmost if tied. Equal windows have equal anchors at equal places, so windows can be
compared anchor by anchor. Consecutive windows with one anchor occurrence are a unit, about one in
39 bytes. Equal units are one leaf: they are found by hash, and each but the earliest points to the
one before it.

*Suffix array.* Where an anchor has several leaves, the bytes around each are one bucket. The bucket's
suffixes whose first ``NEED`` bytes recur are sorted, neighbours' common prefixes give an enhanced
suffix array, and a stack scan yields the tree of common-prefix intervals. An interval whose members
are preceded by different bytes cannot be extended to the left: it is a maximal repeat, output with
all its occurrences, each pointing to the earliest.

*Proof.* What hashes say is not believed: stretches that point to the same earlier text are joined up,
the earlier text's bytes are fetched, and a stretch is removed only if they are its own. Should they
ever differ, two texts had one hash, and all is done again with other hashes.

*Hot passages.* An anchor that stands in very many different units (found in a sample of
documents, and again by exact counts) is not gathered: its windows become units of one window, to
be grouped by their own content, which spreads over all tasks. Each task merges equal units before
the shuffle, so a passage that a third of the documents hold is one row a task.

Texts are fetched in chunks of bounded size, and grouped rows are read as a stream, so no task holds a
whole partition or a long text's copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count as counted

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from factweave.llm.common import Stages, bound, bounds, free_name, groups_of, partitions, small_batches

NEED, GRAM = 100, 24
BUFFER = 1 << 20
POSITION = np.uint64((1 << 24) - 1)
MERGE_ROWS = 500_000
SAMPLE_DOCS, HOT_UNITS, WIDE_UNITS = 40_000, 160, 2048
CHUNK, PIECE, SHARE = 1 << 13, 1 << 11, 1 << 27  # bytes of a chunk, of a fetched piece, and, about, of a partition
#: A place is (doc, twin, start). Rows of units; from_start is -1, or the row is a repeat of what is there (its length in unit).
_ROW = "key long, unit long, doc long, twin long, span long, from_doc long, from_twin long, from_start long"
REPEAT = "doc long, twin long, start long, length long, from_doc long, from_twin long, from_start long"
_FOUND = f"kind int, key long, {REPEAT}"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


@cache
def _tables(seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of the base and of its inverse (modulo 2**64)."""
    size = BUFFER + NEED + 2
    rng = np.random.default_rng([5, seed])
    values = rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    odd = int(rng.integers(1, 1 << 63)) << 3 | 5
    base, inverse = np.uint64(odd % (1 << 64)), np.uint64(pow(odd, -1, 1 << 64))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]), dtype=np.uint64)
    return values, powers, back


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Hashes of any stretch of a buffer in constant time each."""

    def __init__(self, buffer: np.ndarray, seed: int = 0):
        values, powers, self.back = _tables(seed)
        sums = np.cumsum(values[buffer] * powers[: len(buffer)], dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return _mixed(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def every(self, size: int) -> np.ndarray:
        """Of all stretches of one size."""
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size])


def units(buffer: np.ndarray, ends: np.ndarray, hot: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(key, unit hash, start, windows) of all units in texts laid end to end; hot anchors by window."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(buffer) < NEED:
        return none
    hashed = Hashed(buffer, seed)
    grams = hashed.every(GRAM)
    least = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, reach = 1, NEED - GRAM + 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    starts = np.concatenate([[0], ends[:-1]])
    fits = ends - starts >= NEED
    change = np.zeros(len(least) + 1, np.int8)
    change[starts[fits]] += 1
    np.add.at(change, ends[fits] - NEED + 1, -1)
    at = np.flatnonzero(np.cumsum(change[:-1]))
    if not len(at):
        return none
    anchor = (least[at] & POSITION).astype(np.int64)
    edge = np.concatenate([[0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)) + 1, [len(at)]])
    low, count, anchor = at[edge[:-1]], np.diff(edge), anchor[edge[:-1]]
    key, unit = grams[anchor], hashed.of(low, low + count - 1 + NEED) + (anchor - low).astype(np.uint64)
    if len(hot) and (split := np.isin(key, hot)).any():
        single = np.repeat(low[split], count[split]) + _within(count[split])
        own = hashed.of(single, single + NEED)
        key, unit = np.concatenate([key[~split], own]), np.concatenate([unit[~split], _mixed(own + np.uint64(1))])
        low, count = np.concatenate([low[~split], single]), np.concatenate([count[~split], np.ones(len(single), np.int64)])
    return key, unit, low, count


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _buffers(docs: Iterator[tuple[tuple[int, int], bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]], list[int]]]:
    """Texts laid end to end up to BUFFER bytes; longer ones in parts that overlap by NEED - 1."""
    parts, ids, offsets, size = [], [], [], 0
    for doc, text in docs:
        for at in range(0, max(1, len(text) - NEED + 1), BUFFER - NEED):
            part = text[at : at + BUFFER - 1]
            if size + len(part) > BUFFER:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), ids, offsets
                parts, ids, offsets, size = [], [], [], 0
            parts.append(part)
            ids.append(doc)
            offsets.append(at)
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), ids, offsets


def _joined(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, length: np.ndarray, *source: np.ndarray) -> tuple[np.ndarray, ...]:
    """Repeats (as REPEAT) that touch and point to one stretch of earlier text, joined up."""
    shift = source[2] - start
    order = np.lexsort((start, shift, source[1], source[0], twin, doc))
    same = [c[order] for c in (doc, twin, source[0], source[1], shift)]
    low, high = start[order], (start + length)[order]
    fresh = np.ones(len(low), bool)
    fresh[1:] = low[1:] > high[:-1]
    for c in same:
        fresh[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(fresh)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    high = np.maximum.reduceat(high, first)
    low, (doc, twin, from_doc, from_twin, shift) = low[first], [c[first] for c in same]
    return doc, twin, low, high - low, from_doc, from_twin, low + shift


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _merged(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Units (key, unit, doc, twin, span) of a task; those that repeat an earlier one of it as repeats, with spread keys.

    A repeat points to the occurrence before it, so that no place is pointed to by many, and what
    repeats itself along a text points to one stretch of it.
    """
    key, unit, doc, twin, span = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((span, twin, doc, unit, key))
    key, unit, doc, twin, span = (c[order] for c in (key, unit, doc, twin, span))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])
    low, length = span >> 7, (span & 127) - 1 + NEED
    same = np.zeros(len(key), bool)  # a row that is in the table twice
    same[1:] = (doc[1:] == doc[:-1]) & (twin[1:] == twin[:-1]) & (low[1:] == low[:-1])
    again = np.flatnonzero(~fresh & ~same)
    out = _joined(doc[again], twin[again], low[again], length[again], doc[again - 1], twin[again - 1], low[again - 1])
    spread = _mixed(out[0].view(np.uint64) + out[2].view(np.uint64))
    n, none = int(fresh.sum()), np.zeros(int(fresh.sum()), np.int64)
    own = (key[fresh].view(np.int64), unit[fresh].view(np.int64), doc[fresh], twin[fresh], span[fresh], none, none, np.full(n, -1))
    more = (spread.view(np.int64), out[3], out[0], out[1], out[2], *out[4:])
    return _batch(_names(_ROW), *(np.concatenate(c) for c in zip(own, more, strict=True)))


def _bytes_of(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], bytes]]:
    texts = b.column("text").cast(pa.binary())
    for doc, twin, text in zip(b.column("doc").to_pylist(), b.column("twin").to_pylist(), texts, strict=True):
        yield (doc, twin), text.as_py() or b""


def _unit_rows(docs: DataFrame, hot: np.ndarray, seed: int) -> DataFrame:
    """Units of all texts as _ROW; span: start * 128 + windows."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for buffer, ends, ids, offsets in _buffers(_bytes_of(b)):
                key, unit, low, count = units(buffer, ends, shared.value, seed)
                if not len(key):
                    continue
                which = np.searchsorted(ends, low, "right")
                begin = np.concatenate([[0], ends[:-1]])
                start = low - begin[which] + np.array(offsets, np.int64)[which]
                doc, twin = np.array(ids, np.int64).T
                held.append((key, unit, doc[which], twin[which], start * 128 + count))
                size += len(key)
                if size >= MERGE_ROWS:
                    yield _merged(held)
                    held, size = [], 0
        if held:
            yield _merged(held)

    return docs.mapInArrow(run, _ROW)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (_ROW) as _FOUND: kind 1 rows are repeats; kind 2, leaves of anchors that have several (length: windows)."""
    names = _names(_FOUND)
    leaf = None  # key, unit and place of the first of the leaf that the last row belongs to
    tail = None  # place of that last row
    alone = False  # whether that leaf is its key's only one so far
    for b in batches:
        key, unit, doc, twin, span, *source = (b.column(c).to_numpy() for c in _names(_ROW))
        done = source[2] >= 0
        if done.any():
            told = (doc[done], twin[done], span[done], unit[done], *(c[done] for c in source))
            yield _batch(names, np.ones(len(told[0]), np.int32), key[done], *told)
        key, unit, doc, twin, span = (c[~done] for c in (key, unit, doc, twin, span))
        if not len(key):
            continue
        before = [np.concatenate([[x], c[:-1]]) for x, c in zip(tail or (0, 0, 0), (doc, twin, span >> 7), strict=True)]
        end = (doc[-1], twin[-1], span[-1] >> 7)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])
        if leaf is not None:
            fresh[0] = key[0] != leaf[0] or unit[0] != leaf[1]
        low = span >> 7
        again = ~fresh & ~((doc == before[0]) & (twin == before[1]) & (low == before[2]))
        if again.any():
            yield _batch(names, np.ones(int(again.sum()), np.int32), key[again], doc[again], twin[again], low[again], (span[again] & 127) - 1 + NEED, *(c[again] for c in before))
        key, unit, doc, twin, span = (c[fresh] for c in (key, unit, doc, twin, span))  # from here on, leaves
        tail = end
        if not len(key):
            continue
        open_ = alone
        if leaf is not None:  # the last leaf is put in front
            key, unit, doc, twin, span = (np.concatenate([[x], c]) for x, c in zip(leaf, (key, unit, doc, twin, span), strict=True))
        opens = np.ones(len(key), bool)
        opens[1:] = key[1:] != key[:-1]
        several = ~opens
        several[:-1] |= ~opens[1:]
        if leaf is not None and not open_:
            several[0] = False  # put out before
        if several.any():
            none = np.zeros(int(several.sum()), np.int64)
            yield _batch(names, np.full(len(none), 2, np.int32), key[several], doc[several], twin[several], span[several] >> 7, span[several] & 127, none, none, none)
        alone = bool(opens[-1])
        leaf = (key[-1], unit[-1], doc[-1], twin[-1], span[-1])


def suffix_array(suffixes: list[bytes]) -> tuple[list[int], list[int]]:
    """Suffix order and the common prefix length of each with its forerunner (first: 0)."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    common = [0] * len(order)
    for i in range(1, len(order)):
        a, b = suffixes[order[i - 1]], suffixes[order[i]]
        low, high = 0, min(len(a), len(b))
        if a[:high] == b[:high]:
            low = high
        while low < high:  # the longest equal prefix, by halving
            middle = (low + high + 1) // 2
            if a[:middle] == b[:middle]:
                low = middle
            else:
                high = middle - 1
        common[i] = low
    return order, common


def prefix_intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every common-prefix interval of at least that length, children first."""
    stack: list[list[int]] = []
    for i in range(1, len(common) + 1):
        height = common[i] if i < len(common) else 0
        first = i - 1
        while stack and stack[-1][0] > height:
            length, first = stack.pop()
            yield length, first, i - 1
        if height >= least and (not stack or stack[-1][0] < height):
            stack.append([height, first])


def maximal_repeats(suffixes: list[bytes], before: list[int], least: int = NEED) -> Iterator[tuple[int, list[int]]]:
    """(length, members) of intervals preceded by different bytes; -1 before: nothing known, differs."""
    order, common = suffix_array(suffixes)
    for length, first, last in prefix_intervals(common, least):
        left = {before[order[i]] for i in range(first, last + 1)}
        if len(left) > 1 or -1 in left:
            yield length, [order[i] for i in range(first, last + 1)]


def repeated_suffixes(order: np.ndarray, common: list[int], before: np.ndarray, rank: np.ndarray, least: int = NEED) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix array: the longest maximal repeat in which it is not the earliest, and the earliest's place.

    rank: the order of the suffixes by their places in the documents. Length 0: in none. Intervals come
    children first, so the first that takes a suffix is its longest, and shorter ones add nothing.
    """
    length, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
    left, place = before[order], rank[order]
    for size, first, last in prefix_intervals(common, least):
        own = slice(first, last + 1)
        if left[first] >= 0 and (left[own] == left[first]).all():
            continue  # can be extended to the left
        earliest = first + int(place[own].argmin())
        fresh = length[own] == 0
        fresh[earliest - first] = False
        length[own][fresh], source[own][fresh] = size, earliest
    return length, source


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats (as REPEAT) of buckets of (key, doc, twin, span, bytes)."""
    for table in groups_of(batches, ["key"]):
        edge = bounds(table.column("key").to_numpy())
        for first, last in _slices(edge):
            part = table.slice(int(edge[first]), int(edge[last] - edge[first]))
            out = _search_some(edge[first : last + 1] - edge[first], part)
            if len(out[0]):
                yield _batch(_names(REPEAT), *out)


def _slices(edge: np.ndarray, limit: int = 3500) -> Iterator[tuple[int, int]]:
    """Runs of buckets of about ``limit`` units."""
    first = 0
    for last in range(1, len(edge)):
        if edge[last] - edge[first] >= limit or last == len(edge) - 1:
            yield first, last
            first = last


def _search_some(edge: np.ndarray, part: pa.Table) -> tuple[np.ndarray, ...]:
    pieces = part.column("bytes").to_pylist()
    doc, twin, span = (part.column(c).to_numpy() for c in ("doc", "twin", "span"))
    low, count = span >> 7, span & 127
    sizes = np.array([len(p) for p in pieces])
    bucket = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    begin = np.cumsum(sizes) - sizes
    hashed = Hashed(np.frombuffer(b"".join(pieces), np.uint8))
    row = np.repeat(np.arange(len(pieces)), count)
    offset = _within(count)
    window = hashed.of(begin[row] + offset, begin[row] + offset + NEED) + _mixed(bucket[row].astype(np.uint64))
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    often = np.zeros(len(window), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    row, offset = row[often], offset[often]
    start = low[row] + offset
    out: list[tuple[np.ndarray, ...]] = []
    groups = bounds(bucket[row]) if len(row) else [0]
    for a, b in zip(groups[:-1], groups[1:], strict=True):
        members = list(zip(row[a:b].tolist(), offset[a:b].tolist(), strict=True))
        order, common = suffix_array([pieces[r][o:] for r, o in members])
        before = np.array([pieces[r][o - 1] if o else -1 for r, o in members])
        order = np.array(order)
        rank = np.empty(b - a, np.int64)
        rank[np.lexsort((start[a:b], twin[row[a:b]], doc[row[a:b]]))] = np.arange(b - a)
        length, source = repeated_suffixes(order, common, before, rank)
        hit = length > 0
        one, of = order[hit] + a, order[source[hit]] + a
        out.append((doc[row[one]], twin[row[one]], start[one], length[hit], doc[row[of]], twin[row[of]], start[of]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _chunks(docs: DataFrame) -> DataFrame:
    """(doc, twin, chunk, part): texts in parts of CHUNK bytes, each with the PIECE bytes after it."""

    def parts(whole: Column) -> Column:
        last = F.greatest(F.floor((F.length(whole) - 1) / CHUNK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(whole, i * CHUNK + 1, CHUNK + PIECE))

    return docs.select("doc", "twin", F.posexplode(bound(F.col("text").cast("binary"), parts)).alias("chunk", "part"))


def _contexts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, doc, twin, span, bytes) of leaves (key, doc, twin, start, windows)."""
    told = members.withColumn("chunk", F.floor(F.col("start") / CHUNK).cast("int"))
    listed = told.groupBy("doc", "twin", "chunk").agg(F.collect_list(F.struct("key", "start", "windows")).alias("wanted"))

    def cut(part: Column) -> Column:
        def one(w: Column) -> Column:
            own = F.substring(part, (w["start"] - F.col("chunk") * CHUNK + 1).cast("int"), (w["windows"] - 1 + NEED).cast("int"))
            return F.struct(w["key"].alias("key"), (w["start"] * 128 + w["windows"]).alias("span"), own.alias("bytes"))

        return F.transform("wanted", one)

    found = _chunks(docs).join(listed, ["doc", "twin", "chunk"]).select("doc", "twin", F.explode(bound(F.col("part"), cut)).alias("x"))
    return found.select("x.key", "doc", "twin", "x.span", "x.bytes")


def _window_rows(contexts: DataFrame, seed: int) -> DataFrame:
    """Leaves as units of one window each (_ROW)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("doc", "twin", "span", "bytes"))
            for doc, twin, span, own in zip(*columns, strict=True):
                low, count = span >> 7, span & 127
                at = np.arange(count)
                window = Hashed(np.frombuffer(own, np.uint8), seed).of(at, at + NEED)
                held.append((window, _mixed(window + np.uint64(1)), np.full(count, doc), np.full(count, twin), (low + at) * 128 + 1))
                size += count
                if size >= MERGE_ROWS:
                    yield _merged(held)
                    held, size = [], 0
        if held:
            yield _merged(held)

    return contexts.mapInArrow(run, _ROW)


def _found(rows: DataFrame, n: int) -> DataFrame:
    order = _names(_ROW)[:5]
    return rows.repartition(n, "key").sortWithinPartitions(*order).mapInArrow(_grouped, _FOUND)


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield _batch(_names(REPEAT), *_joined(*(b.column(c).to_numpy() for c in _names(REPEAT))))


def repeats(docs: DataFrame, stages: Stages, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Later occurrences (as REPEAT) with the earlier one each repeats: those found by hash, and those of the suffix arrays.

    docs: (doc, twin, text). All occurrences of a maximal repeat but the earliest point to an earlier
    one, so following them leads to it; they may overlap.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.count()
    every = max(1, total // SAMPLE_DOCS)
    sampled = docs.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0)
    different = _unit_rows(sampled, np.zeros(0, np.uint64), seed).where("from_start < 0").select("key", "unit").distinct()
    busy = different.groupBy("key").count().where(f"count >= {HOT_UNITS}").select("key").collect()
    hot = np.sort(np.array([r["key"] for r in busy], np.int64).view(np.uint64))
    found = stages.put(_found(_unit_rows(docs, hot, seed), n), f"found{seed}")
    stages.release()
    hashed = found.where("kind = 1").select(*_names(REPEAT))
    members = found.where("kind = 2").select("key", "doc", "twin", "start", F.col("length").alias("windows"))
    wide = stages.put(members.groupBy("key").count().where(f"count > {WIDE_UNITS}").select("key"), f"wide{seed}")
    narrow = _contexts(docs, members.join(wide, "key", "left_anti"))
    tree = stages.put(narrow.repartition(n, "key").sortWithinPartitions("key", "doc", "twin", "span").mapInArrow(_search, REPEAT), f"tree{seed}")
    if wide.limit(1).count():
        windows = _window_rows(_contexts(docs, members.join(wide, "key")), seed)
        hashed = hashed.unionByName(stages.put(_found(windows, n).where("kind = 1").select(*_names(REPEAT)), f"windows{seed}"))
    stages.release()
    return hashed, tree


def evidence(docs: DataFrame, hashed: DataFrame, n: int) -> DataFrame:
    """(doc, twin, start, length, earlier): repeats found by hash, in pieces, with the bytes that stand at the earlier place."""
    keys = ["doc", "twin", "from_doc", "from_twin"]
    near = hashed.repartition(n, *keys).sortWithinPartitions(*keys, F.col("from_start") - F.col("start"), "start").mapInArrow(_joined_up, REPEAT)
    pieces = near.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / PIECE)))).select(
        "doc", "twin", (F.col("start") + F.col("piece") * PIECE).alias("start"), F.least(F.lit(PIECE), F.col("length") - F.col("piece") * PIECE).alias("length"),
        "from_doc", "from_twin", (F.col("from_start") + F.col("piece") * PIECE).alias("from_start"),
    )
    asked = pieces.withColumn("chunk", F.floor(F.col("from_start") / CHUNK).cast("int"))
    parts = _chunks(docs).withColumnsRenamed({"doc": "from_doc", "twin": "from_twin"})
    own = F.substring("part", (F.col("from_start") - F.col("chunk") * CHUNK + 1).cast("int"), F.col("length").cast("int"))
    return asked.join(parts, ["from_doc", "from_twin", "chunk"]).select("doc", "twin", "start", "length", own.alias("earlier"))


def covered(size: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes lie in a stretch."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.minimum(starts, size), 1)
    np.add.at(change, np.minimum(starts + lengths, size), -1)
    return np.cumsum(change[:-1]) > 0


def _identified(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(doc, twin, text, row) of all rows, and (doc, twin, text) of the documents that they make.

    twin is 0, or tells rows of one id with different texts apart; row: the other columns.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    own = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), F.struct(*rest, F.lit(True).alias(free_name(docs, "there"))).alias("row"))
    shared = own.where("doc is not null").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit(True).alias("several"))
    if not shared.limit(1).count():
        every = own.withColumn("twin", F.lit(0).cast("long"))
        return every, every.where("doc is not null and text is not null").select("doc", "twin", "text")
    every = own.join(shared, "doc", "left").withColumn("twin", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).cast("long")).drop("several")
    return every, every.where("doc is not null and text is not null").select("doc", "twin", "text").dropDuplicates(["doc", "twin"])


def dedupe(docs: DataFrame, out: StructType, make: Callable, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of docs through ``make(batch, list of (bytes, removed mask or None))``, written to the shared folder.

    A batch has doc, text and row (the other columns). Removed is what repeats earlier text. Null
    texts are empty. Rows with a null doc_id have no place in the order: they are left whole and
    make nothing else a repeat. Rows with one doc_id and one text are one document and lose the same
    bytes; rows with one doc_id and different texts are documents of their own, in the order of a
    hash of the text.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    every, base = _identified(docs, text, doc_id)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // SHARE))
    schema = StructType([*out.fields, StructField("__differ", LongType())])
    for seed in counted():
        hashed, tree = repeats(base, stages, n, seed)
        proof = stages.put(evidence(base, hashed, n), f"proof{seed}")
        sure = tree.select("doc", "twin", "start", "length", F.lit(None).cast("binary").alias("earlier"))
        cuts = proof.unionByName(sure).groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "length", "earlier")).alias("cuts"))
        done = stages.put(_applied(every.join(cuts, ["doc", "twin"], "left"), schema, make), f"done{seed}")
        for name in ("found", "wide", "tree", "windows", "proof"):
            stages.drop(f"{name}{seed}")
        if not done.agg(F.sum("__differ")).first()[0]:
            return done.drop("__differ")
        stages.drop(f"done{seed}")


def _applied(keyed: DataFrame, out: StructType, make: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cuts, done, differ = b.column("cuts"), [], []
            for i, raw in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                raw, wrong, mask = raw or b"", 0, None
                own = cuts[i].values
                if own is not None and len(own):
                    starts, lengths = own.field("start").to_numpy(), own.field("length").to_numpy()
                    for start, length, earlier in zip(starts.tolist(), lengths.tolist(), own.field("earlier").to_pylist(), strict=True):
                        wrong += earlier is not None and raw[start : start + length] != earlier
                    mask = covered(len(raw), starts, lengths)
                done.append((raw, mask))
                differ.append(wrong)
            made = make(b, done)
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(differ, pa.int64())], names=[*made.schema.names, "__differ"])

    return keyed.mapInArrow(run, out)


def kept_bytes(raw: bytes, gone: np.ndarray | None) -> bytes:
    return raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes()


_DIGEST = StructType([StructField(n, LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType())])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(b: pa.RecordBatch, done: list) -> pa.RecordBatch:
        runs = [0 if g is None else int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0 for _, g in done]
        gone = [0 if g is None else int(g.sum()) for _, g in done]
        sha = [hashlib.sha256(kept_bytes(*x)).hexdigest() for x in done]
        columns = [b.column("doc"), pa.array([len(x[0]) for x in done], pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)]
        return pa.RecordBatch.from_arrays(columns, names=_DIGEST.names)

    return dedupe(docs, _DIGEST, digest)


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with all its columns; repeated passages go from its text, cut ends to whole characters.

    A character that is only partly covered by a repeat is kept.
    """
    names = docs.columns
    sized = "n_chars" in names

    def cleaned(b: pa.RecordBatch, done: list) -> pa.RecordBatch:
        texts = []
        for raw, gone in done:
            if gone is not None and len(raw):
                first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
                char = np.cumsum(first) - 1
                whole = np.bincount(char, ~gone) == 0
                raw = kept_bytes(raw, whole[char])
            texts.append(raw.decode("utf-8", "replace"))
        null = b.column("text").is_null().to_pylist()
        new = [None if n else t for n, t in zip(null, texts, strict=True)]
        size = pa.array([None if t is None else len(t) for t in new], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()), size, b.column("row")], names=["text", "size", "row"])

    rest = StructType([*[docs.schema[n] for n in names if n != "text"], StructField(free_name(docs, "there"), BooleanType())])
    out = StructType([docs.schema["text"], StructField("size", LongType()), StructField("row", rest)])
    done = dedupe(docs, out, cleaned)

    def column(n: str) -> Column:
        if n == "text":
            return F.col("text")
        if n == "n_chars" and sized:
            return F.col("size").cast(docs.schema[n].dataType).alias(n)
        return F.col("row")[n].alias(n)

    return done.select(*[column(n) for n in names])
