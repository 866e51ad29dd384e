"""Near-duplicates by SimHash and Golay-code fuzzy keys, verified as exact Jaccard similarity of five-word shingle sets.

*Fingerprints.* A set has several 64-bit SimHash fingerprints, each from other hashes of its shingles: a
bit is 1 if set in over half of them. At a similarity of 0.8 two sets differ in a bit with probability
0.15, and ``APART`` at most: that of 4 shingles and a fifth.

*Candidates.* Of each fingerprint the lowest 23 bits are a word, whose fuzzy keys are the Golay codewords
within distance 4 (see ``simhash``), and the bits after it are matched exactly, more of them the more rows
there are (``exact_bits``). Two sets that share a key are compared by two fingerprints, and those over
``RADIUS`` bits apart, or out of the bounds below, don't meet. ``tables_for`` says how many fingerprints it takes to leave a pair of
similarity 0.8 without a shared key with probability ``MISS`` at most, less above and for larger sets. A
key's members fall into groups, and none may be similar to one in another group; equal groups
of several keys are one. Equal sets are one class beforehand.

*Bounds.* A set has a sketch of ``SKETCH`` bits, the parities of how many shingles fall on each. The bits in
which two sketches differ are at most the shingles that two sets do not share, so a pair with too
many of them, or of too different sizes, is ruled out when keys meet and in joins, and never becomes a row.
Joins look at the whole sketch, keys at one folded to ``FOLDED`` bits, as they take more room.

*Verification.* Other sets of one group are compared exactly. A group of more than ``WIDE`` sets
would compare too many pairs: each group has a middle, the member that meets most others, and a set is
first compared with one middle only, the heaviest of its groups'. Then it is compared with the middles
that are in another component than itself. Members that this leaves outside the group's largest
component are compared with all others of the group in other components, so no candidate pair that could
join two components is left out. Links are thus about one a set, whatever the size of its groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from factweave.llm.common import Stages, bounds, connected_components, groups_of, local_roots, partitions, small_batches

WIDE = 2
APART, MISS = 0.1875, 1e-4
RADIUS = 42  # of 128 bits: beyond it are one in 20,000 pairs ``APART``, and all but 7 in 100,000 unrelated ones
MET = (1, 1, 1, 0.5947, 0.5947, 0.1885, 0.1893, 0.0342, 0.0342)  # share of words at distance 0, 1, ... that share a fuzzy key
DENSE = 17  # up to 2**DENSE rows no bits are matched exactly, and one more each time they double
ROUND = 5  # fingerprints whose keys are dealt at once
KEYS = 1 << 20  # about, of a partition
BIG = 512
SKETCH, FOLDED = 1024, 256
SHINGLE, SEED = 5, 42
_MANY = 1 << 16


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of a text's five-word shingles (of all its words if fewer); no words: none."""
    from factweave.llm.simhash import WORD

    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    wide = min(SHINGLE, len(words))
    first, last, digest = starts[: len(words) - wide + 1], ends[wide - 1 :], xxhash.xxh64_intdigest
    del words
    out = np.zeros(0, np.uint64)
    for at in range(0, len(first), _MANY):  # lists of bounded size, however long the text
        spans = zip(first[at : at + _MANY].tolist(), last[at : at + _MANY].tolist(), strict=True)
        out = np.union1d(out, np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))
    return out


def identity(own: np.ndarray) -> int:
    """64-bit hash of a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)) if len(own) else 0


def exact_bits(rows: int) -> int:
    """Bits matched exactly beside a fuzzy key, so that keys of unrelated sets stay of bounded size."""
    return min(41, max(0, rows.bit_length() - DENSE))


def tables_for(exact: int) -> int:
    """Fingerprints needed for a chance of ``MISS`` that two sets ``APART`` share no key."""
    met = sum(comb(23, d) * APART**d * (1 - APART) ** (23 - d) * share for d, share in enumerate(MET))
    return ceil(log(MISS) / log(1 - met * (1 - APART) ** exact))


def fingerprints(own: np.ndarray, tables: int) -> np.ndarray:
    """SimHash fingerprints of a set: a bit is 1 if set in over half the shingles' hashes."""
    seeds = (np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    ones = np.zeros(64 * tables, np.int64)
    for at in range(0, len(own), 255):  # counts of a byte
        mixed = own[at : at + 255, None] + seeds
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(own), bitorder="little").view(np.uint64)


def fuzzy_keys(prints: np.ndarray, table: int, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the uint64 fingerprints of one table; key: a hash of table, exact bits and codeword index."""
    from factweave.llm.simhash import golay_keys

    row, word = golay_keys((prints & np.uint64((1 << 23) - 1)).astype(np.int64))
    after = (prints >> np.uint64(23)) & np.uint64((1 << exact) - 1)
    key = (np.uint64(table) << np.uint64(53)) | (after[row] << np.uint64(12)) | word.astype(np.uint64)
    return row, key.view(np.int64)


def band_keys(own: np.ndarray, exact: int = 0) -> np.ndarray:
    """All keys of a set, as longs; none for the empty one."""
    if not len(own):
        return np.zeros(0, np.int64)
    return np.concatenate([fuzzy_keys(p, i, exact)[1] for i, p in enumerate(fingerprints(own, tables_for(exact))[:, None])])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least 0.8."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def shape(own: np.ndarray) -> np.ndarray:
    """Size and sketch of a set, as longs."""
    odd = np.bincount((own >> np.uint64(54)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.concatenate([[len(own)], np.packbits(odd.astype(np.uint8)).view(np.int64)])


def folded(shapes: np.ndarray) -> np.ndarray:
    """Shapes (a row each) with sketches of ``FOLDED`` bits: parities of the shingles that fall on several."""
    return np.concatenate([shapes[:, :1], np.bitwise_xor.reduce(shapes[:, 1:].reshape(len(shapes), -1, FOLDED // 64), axis=1)], axis=1)


def may_be_similar(a: str, b: str) -> Column:
    """False only for two shapes whose sets have a Jaccard similarity below 0.8.

    With S elements in both sets and D of them in one only, it is (S - D) / (S + D).
    """
    both = F.get(a, F.lit(0)) + F.get(b, F.lit(0))
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, 1 + SKETCH // 64)), F.lit(0))
    return (9 * F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))) <= both) & (9 * apart <= both)


def keyed(docs: DataFrame, tables: int) -> DataFrame:
    """docs (with a text) and set, the identity of the shingle set, prints, its fingerprints, and shape."""
    small_batches(docs.sparkSession)
    longs = ArrayType(LongType())
    schema = StructType([*docs.schema.fields, StructField("set", LongType()), StructField("prints", longs), StructField("shape", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                kind = pa.list_(pa.int64())
                prints = pa.array([fingerprints(s, tables).view(np.int64) for s in sets], kind)
                more = [pa.array([identity(s) for s in sets], pa.int64()), prints, pa.array([shape(s) for s in sets], kind)]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


_LOOK = ["near", "far", "size", *(f"sketch_{i}" for i in range(FOLDED // 64))]


def _dealt(once: DataFrame, tables: range, exact: int) -> DataFrame:
    """(key, node, *_LOOK) of the sets' fingerprints of some tables; near and far are the first two of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                node = b.column("node").to_numpy()
                prints, shapes = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("prints", "shape"))
                look = np.concatenate([prints[:, :2], folded(shapes)], axis=1)
                for i in tables:
                    row, key = fuzzy_keys(prints[:, i].view(np.uint64), i, exact)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node[row], *look[row].T)], names=["key", "node", *_LOOK])

    return once.where("node <> 0").select("node", "prints", "shape").mapInArrow(run, ", ".join(f"{c} long" for c in ("key", "node", *_LOOK)))


def _may(look: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b are within ``RADIUS`` and ``may_be_similar``."""

    def differing(columns: list[np.ndarray]) -> np.ndarray:
        return sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in columns)

    size = look[2].view(np.int64)
    both = size[a] + size[b]
    return (differing(look[:2]) <= RADIUS) & (9 * differing(look[3:]) <= both) & (9 * np.abs(size[a] - size[b]) <= both)


def close_pairs(key: np.ndarray, look: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal keys (sorted) that may be similar: pairs that connect the same rows as all of them do."""
    edges = bounds(key)
    sizes = np.diff(edges)
    end = np.repeat(edges[1:], sizes)
    one, two = [], []
    at, step = np.flatnonzero(np.repeat(sizes <= BIG, sizes)), 1
    while len(at := at[at + step < end[at]]):
        near = at[sum(np.bitwise_count(x[at] ^ x[at + step]) for x in look[:2]) <= RADIUS]
        good = near[_may(look, near, near + step)]
        one.append(good)
        two.append(good + step)
        step += 1
    for low, high in zip(edges[:-1][sizes > BIG].tolist(), edges[1:][sizes > BIG].tolist(), strict=True):
        left = np.arange(low, high)
        while len(left):  # what the first reaches: each pair is compared once, and not inside what it has reached
            first, left, front = left[0], left[1:], left[:1]
            while len(front) and len(left):
                wide = max(1, (1 << 18) // len(left))
                hit = _may(look, front[:wide, None], left[None, :]).any(0)
                one.append(np.full(hit.sum(), first))
                two.append(left[hit])
                front, left = np.concatenate([front[wide:], left[hit]]), left[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *two])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of sets under one key (rows by key and node), named by a hash of their members."""
    for table in groups_of(batches, ["key"]):
        key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
        a, b = close_pairs(key, [table.column(c).to_numpy().view(np.uint64) for c in _LOOK])
        if not len(a):
            continue
        own, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(own), back[: len(a)], back[len(a) :])
        order = np.argsort(root, kind="stable")
        member, edges = node[own[order]], bounds(root[order])
        names = [xxhash.xxh64_intdigest(member[i:j].tobytes(), SEED) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        sizes = np.diff(edges)
        group = np.repeat(np.array(names, np.uint64).view(np.int64), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(member), pa.array(np.repeat(sizes, sizes))], names=["key", "node", "n"])


def _shared(once: DataFrame, sets: int, tables: int, exact: int, stages: Stages) -> DataFrame:
    """(key, node, n) of groups of n sets that may be similar, dealt some fingerprints at a time, as keys take room."""
    parts = []
    for low in range(0, tables, ROUND):
        some = range(low, min(tables, low + ROUND))
        n = max(partitions(once.sparkSession), sets * len(some) * 6 // KEYS)
        keys = _dealt(once, some, exact).repartition(n, "key").sortWithinPartitions("key", "node")
        parts.append(stages.put(keys.mapInArrow(_grouped, "key long, node long, n long"), f"groups-{low}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(own, pa.binary())], names=["node", "own"])

    return texts.mapInArrow(run, "node long, own binary")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            left, right = b.column("left").to_pylist(), b.column("right").to_pylist()
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(left, right, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _links(pairs: DataFrame, rows: DataFrame, once: DataFrame, stages: Stages, name: str) -> DataFrame:
    """Those of the pairs (a, b) of sets that are similar.

    The text of a set is that of one row, found by its number: copies of a text do not meet.
    """
    pairs = stages.put(pairs.distinct(), f"{name}-pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(once.select("node", "number"), "node")
    texts = rows.select("number", "text").join(asked, "number").select("node", "text")
    sets = stages.put(_sets(texts), f"{name}-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("right")), "b")
    found = stages.put(both.select("a", "b", "left", "right").mapInArrow(_verify, "a long, b long"), f"{name}-links")
    stages.drop(f"{name}-sets")
    return found


def components(rows: DataFrame, stages: Stages, exact: int) -> DataFrame:
    """(node, component) of the sets of rows (keyed(), numbered, written) that are linked to another."""
    once = stages.put(rows.groupBy(F.col("set").alias("node")).agg(F.first("prints").alias("prints"), F.first("shape").alias("shape"), F.min("number").alias("number")), "once")
    groups = _shared(once, once.count(), tables_for(exact), exact, stages)
    stages.release()
    weight = groups.groupBy("node").agg(F.sum("n").alias("weight"))
    shared = stages.put(groups.join(once.select("node", "shape").join(weight, "node"), "node"), "shared")
    few, many = shared.where(f"n <= {WIDE}").select("key", "node", "shape"), shared.where(f"n > {WIDE}").select("key", "node", "shape", "weight")
    one, two = ([F.col("key").alias(f"key_{x}"), F.col("node").alias(x), F.col("shape").alias(f"shape_{x}")] for x in "ab")
    near = (F.col("key_a") == F.col("key_b")) & may_be_similar("shape_a", "shape_b")
    pairs = few.select(*one).join(few.select(*two), near & (F.col("a") < F.col("b"))).select("a", "b")
    middle = many.groupBy("key").agg(F.max(F.struct("weight", "node", "shape")).alias("x"))
    middle = stages.put(middle.select("key", "x.*"), "middle")
    stars = many.select(*one).join(middle.select(*two, "weight"), near & (F.col("a") != F.col("b")))
    heaviest = stars.groupBy("a").agg(F.max(F.struct("weight", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    links = _links(pairs.unionByName(_ordered(heaviest)), rows, once, stages, "first")
    linked = stages.put(connected_components(stages, links), "linked")
    stages.release()
    across = near & (F.col("of_a") != F.col("of_b"))
    stars = _placed(many, linked).select(*one, F.col("component").alias("of_a")).join(_placed(middle, linked).select(*two, F.col("component").alias("of_b")), across)
    linked = _joined(linked, _links(_ordered(stars), rows, once, stages, "second"), stages, "second")
    stages.release()
    placed = stages.put(_placed(many, linked), "placed")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("x"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("x.component").alias("main"))
    left = placed.join(main, "key").where("component <> main").drop("main")
    if not left.limit(1).count():
        return linked
    rest = left.select(*one, F.col("component").alias("of_a")).join(placed.select(*two, F.col("component").alias("of_b")), across)
    return _joined(linked, _links(_ordered(rest), rows, once, stages, "third"), stages, "third")


def _placed(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, node, shape, component) of sets."""
    return sets.join(linked, "node", "left").select("key", "node", "shape", F.coalesce("component", "node").alias("component"))


def _joined(linked: DataFrame, links: DataFrame, stages: Stages, name: str) -> DataFrame:
    """Components after more links: a component found before is a star of links to its smallest node."""
    if not links.limit(1).count():
        return linked
    known = linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return stages.put(connected_components(stages, known.unionByName(links), f"cc-{name}"), f"linked-{name}")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
