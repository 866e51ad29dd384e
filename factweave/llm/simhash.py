"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a word of
23. The perfect binary Golay code has a codeword within distance 3 of every word; the codewords
within distance 4 of a word (one or six) are its fuzzy keys, and any two words at distance 2 or
less share one, for the word halfway between them has a codeword within 3. Two fingerprints that
differ in at most two bits leave at least one segment unchanged and differ in at most two bits of
the next, so each fingerprint gets the keys (segment number, its exact bits, a fuzzy key of the
next segment). Fingerprints that share a key are joined and verified.

A key with more than ``WIDE`` distinct fingerprints would compare too many pairs. Its members
instead get 65 keys each: themselves and every word one bit away. Those within two bits share such
a word, and all that share one are within two bits of each other, so no comparison is needed and
no group holds more than 65.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import shingles
from factweave.llm.common import Stages, bounds, connected_components, free_name, groups_of, local_roots, partitions, small_batches

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEGMENTS = ((0, 22), (22, 21), (43, 21))
WIDE = 256
KEYS = 1 << 22  # about, of a partition
SHINGLE, SEED = 3, 42
_STEP = 1 << 16
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the [23, 12, 7] Golay code


def fingerprint(text: str | None) -> int:
    """Bit is 1 if set in over half the shingles' XXH64; no words: 0."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    wide = min(SHINGLE, len(words))
    first, last = starts[: len(words) - wide + 1], ends[wide - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), _STEP):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _STEP].tolist(), last[at : at + _STEP].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first), bitorder="little").view(np.uint64)[0])


def _divide(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator: the syndrome."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


@cache
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the patterns of weight up to 4 that have it (a row of 6), and how many."""
    table = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        picks = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for pattern, syndrome in zip(picks.tolist(), _divide(picks).tolist(), strict=True):
            table[syndrome, count[syndrome]] = pattern
            count[syndrome] += 1
    return table, count


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of all codewords within distance 4 of each 23-bit word."""
    table, count = error_patterns()
    syndrome = _divide(words)
    row = np.repeat(np.arange(len(words)), count[syndrome])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count[syndrome]) - count[syndrome], count[syndrome])
    return row, (words[row] ^ table[syndrome[row], nth]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of uint64 fingerprints; key: segment number, exact segment, codeword index."""
    parts = [((prints >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        row, word = golay_keys(parts[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 40) | (exact[row] << 12) | word)
    return np.concatenate(rows), np.concatenate(keys)


def _signed(prints: np.ndarray) -> np.ndarray:
    return prints.view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with a long column holding the fingerprint's 64 bits."""
    from pyspark.sql.types import LongType, StructField, StructType

    small_batches(docs.sparkSession)
    rest = docs.drop(name)
    schema = StructType([*[f for f in rest.schema if f.name != text], StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = np.array([fingerprint(t) for t in b.column(text).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in schema.names[:-1]], pa.array(_signed(got))], names=schema.names)

    return rest.mapInArrow(run, schema)


def _explode_keys(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            row, key = fuzzy_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return prints.mapInArrow(run, "key long, fp long")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints under one key, as a spanning set: each to the smallest it reaches."""
    for table in groups_of(batches, ["key"]):
        key, fp = table.column("key").to_numpy(), table.column("fp").to_numpy()
        out = []
        edges = bounds(key)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo == 1:
                continue
            own = np.sort(fp[lo:hi])
            bits = own.view(np.uint64)  # of signed numbers, bitwise_count takes the absolute value
            a, b = np.nonzero(np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2, 1))
            if len(a):
                root = local_roots(len(own), a, b)
                moved = root != np.arange(len(own))
                out.append(np.stack([own[moved], own[root[moved]]]))
        if out:
            a, b = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(spark: SparkSession, prints: DataFrame, stages: Stages) -> DataFrame:
    """(node, component) of distinct fingerprints (fp) linked at two or fewer differing bits."""
    keys = stages.put(_explode_keys(prints), "keys")
    wide = keys.groupBy("key").count().where(f"count > {WIDE}").select("key")
    few = keys.join(wide, "key", "left_anti")
    n = max(partitions(spark), keys.count() // KEYS)
    links = few.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long")
    many = keys.join(wide, "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = many.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("half"))
    star = near.groupBy("half").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where("size(all) > 1")
    links = links.unionByName(star.select(F.explode("all").alias("a"), "b"))
    done = connected_components(stages, links.where("a <> b").distinct())
    stages.drop("keys")
    return done


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links, null ids aside (null if a class has
    only those). Null and empty texts have fingerprint 0 and link like any other.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stages.put(fingerprints(base), "prints")
    classes = stages.put(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = stages.put(components(spark, classes.select("fp"), stages), "linked")
    member = classes.join(linked, classes.fp == linked.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(lowest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of the smallest doc_id, once.

    Candidates share a Golay-code fuzzy key of a SimHash fingerprint, as in the query, but at a wider
    radius than its two bits: links are all at a Jaccard similarity of 0.8 or more over five-word
    shingles, which is verified (see ``shingles``). Null ids come last, so a group that has
    only those keeps one row as well; ties go to the smaller hash of the text.
    """
    stages = Stages(spark)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", F.struct(*rest, F.lit(True).alias(free_name(docs, "there"))).alias("row"))
    exact = shingles.exact_bits(own.count())
    rows = stages.put(shingles.keyed(own, shingles.tables_for(exact)).withColumn("number", F.monotonically_increasing_id()), "rows")
    linked = shingles.components(rows, stages, exact)
    named = rows.select("doc_id", "text", "number", "set").join(linked, rows["set"] == linked.node, "left")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), "number")
    first = named.select(F.coalesce("component", "set").alias("component"), order.alias("x")).groupBy("component").agg(F.min("x").alias("x"))
    kept = rows.join(first.select(F.col("x.number").alias("number")), "number", "left_semi")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("row")[c].alias(c) for c in docs.columns])
