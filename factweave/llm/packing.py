"""Sequence packing along a space-filling curve.

Every document becomes token ids; its hashed bag of ids is projected to four dimensions, whose
Hilbert index is its sort key. Documents are range-sorted by that key, and each range is cut, in
curve order, into sequences of ``LENGTH`` ids, so neighbours share sequences. What is left at a
range's end is cut into sequences whose lengths are powers of two, which need no padding.

Ids travel in rows of at most ``PART``, so that ranges are even however long single documents are,
and there are as many ranges as the ids in all ask for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import Stages, partitions, small_batches

LENGTH = 1024
DIMS, BITS, HASHED = 4, 12, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [f.split()[0] for f in PIECES.split(", ")]
VOCABULARY = "byte_bpe_50k"
PART, RANGE = 1 << 11, 1 << 24  # ids in a row and, about, in a range


@cache
def encoder(name: str = VOCABULARY, ranks: str | None = None, library: str | None = None):
    """The public byte-level BPE as a function from texts to ids, as the ``tokenizers`` library gives them.

    ``tiktoken`` runs the same vocabulary about four times as fast and gives the same ids (tests
    compare them) for a text that holds none of the vocabulary's added tokens; a text that holds one
    goes to the library itself, which gives added tokens ids of their own. Either path may be given.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks or public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    exact = Tokenizer.from_file(library or public_tokenizers.path(f"{name}.json"))
    added = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(a in text for a in added):
            return exact.encode(text, add_special_tokens=False).ids
        return plain(text)

    return encode


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n x d, each below 2**bits)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations of each finer cube, axis by axis
        bit, rest = 1 << level, (1 << level) - 1
        for i in range(dims):
            turned = (x[i] & bit) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & rest)
            x[0] ^= np.where(turned, rest, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= parity
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


@cache
def _projection() -> np.ndarray:
    plane = np.random.default_rng(11).normal(size=(HASHED, DIMS))
    return np.linalg.qr(plane)[0]


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document: signed hashed counts of its ids, normalised, projected."""
    bags = np.zeros((len(ids), HASHED))
    for i, one in enumerate(ids):
        mixed = one.astype(np.uint32) * np.uint32(0x9E3779B1)
        bags[i] = np.bincount(mixed >> np.uint32(24), np.where(mixed & 0x800, 1.0, -1.0), HASHED)
    bags /= np.maximum(np.linalg.norm(bags, axis=1, keepdims=True), 1e-9)
    flat = bags @ _projection()
    cell = np.clip((np.tanh(3 * flat) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    return hilbert(cell.astype(np.int64))


def cut_rest(rest: int) -> list[int]:
    """Powers of two, falling, that sum to the rest."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_stream(parts: Iterator[tuple[int | None, int, int, np.ndarray]], first_sequence: int, length: int = LENGTH) -> Iterator[tuple]:
    """Pieces (as PIECES) of parts (document, ids of it before, ids of it in all, ids) in their order."""
    sequence, at, open_pieces = first_sequence, 0, []
    for doc_id, before, total, ids in parts:
        start = 0
        while start < len(ids):
            take = min(len(ids) - start, length - at)
            open_pieces.append((doc_id, before + start, ids[start : start + take], total))
            start, at = start + take, at + take
            if at == length:
                yield from _close(open_pieces, sequence, [length])
                sequence, at, open_pieces = sequence + 1, 0, []
    yield from _close(open_pieces, sequence, cut_rest(at))


def _close(pieces: list[tuple], sequence: int, lengths: list[int]) -> Iterator[tuple]:
    at, left = 0, list(lengths)
    for doc_id, start, ids, total in pieces:
        while len(ids):
            take = min(len(ids), left[0] - at)
            part = ids[:take]
            yield doc_id, start, take, zlib.crc32(part.astype("<u4").tobytes()), total, sequence, at
            ids, start, at = ids[take:], start + take, at + take
            if at == left[0]:
                left.pop(0)
                sequence, at = sequence + 1, 0


_TOKENS = "doc_id long, key long, start long, total long, ids binary"


def tokenise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, start, total, ids): uint16 ids with the closing 0, in parts, and the document's curve key.

    Null text: empty.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            if not b.num_rows:
                continue
            ids = [np.array([*encode(t or ""), 0], np.uint16) for t in b.column(1).to_pylist()]
            sizes = np.array([len(x) for x in ids])
            counts = -(-sizes // PART)
            row = np.repeat(np.arange(len(ids)), counts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * PART
            parts = [ids[r][s : s + PART].tobytes() for r, s in zip(row.tolist(), start.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(curve_keys(ids)[row]), pa.array(start), pa.array(sizes[row]), pa.array(parts, pa.binary())],
                names=[f.split()[0] for f in _TOKENS.split(", ")],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _TOKENS)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row (PIECES) for each piece of each document; docs' other columns are not read.

    Every row of docs is a document of its own, so repeated rows are packed repeatedly; null and
    empty texts are the single id 0; a null doc_id stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    keyed = stages.put(tokenise(docs, text, doc_id), "ids")
    many = keyed.agg(F.sum(F.length("ids"))).first()[0] or 0
    ranges = max(partitions(spark), -(-many // (2 * RANGE)))
    ranged = keyed.repartitionByRange(ranges, "key", "doc_id", "start").sortWithinPartitions("key", "doc_id", "start", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                columns = (b.column(n).to_pylist() for n in ("doc_id", "start", "total"))
                for one, start, total, ids in zip(*columns, b.column("ids"), strict=True):
                    yield one, start, total, np.frombuffer(ids.as_buffer(), np.uint16)

        held = []
        for piece in pack_stream(rows(), TaskContext.get().partitionId() << 40):
            held.append(piece)
            if len(held) == 20_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return ranged.select("doc_id", "start", "total", "ids").mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_FIELDS)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces in place of documents, joined to their other columns by doc_id if wanted."""
    return pack(docs)
