"""Language identification with a blended-spectrum string kernel.

A text is the set of character n-grams (1 to 3, lower case) that it holds, hashed to ``BUCKETS``
presence bits; the kernel of two texts is the normalised size of what they share. Nystroem
landmarks turn it into a finite map, on which one ridge regression per language is solved. As the
map is linear in the presence bits, landmarks and weights fold into one matrix, and whole batches
are scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from factweave.llm.common import crc_fold, free_name, small_batches

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
CHUNK = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    offset: np.ndarray
    sharpness: float = 6.0


def presence(texts: list[str]) -> np.ndarray:
    """A row of BUCKETS presence bytes for each text; n-grams don't cross texts."""
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    flat = out.reshape(-1)
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    first = 0
    while first < len(codes):
        last, size = first + 1, len(codes[first])
        while last < len(codes) and size + len(codes[last]) <= CHUNK:
            size += len(codes[last])
            last += 1
        one = np.concatenate(codes[first:last])
        row = np.repeat(np.arange(first, last, dtype=np.int32), [len(c) for c in codes[first:last]])
        for at in range(0, len(one), CHUNK):  # a long text in overlapping parts
            _mark(flat, one[at : at + CHUNK + max(ORDERS) - 1], row[at : at + CHUNK + max(ORDERS) - 1])
        first = last
    return out


def _mark(flat: np.ndarray, codes: np.ndarray, row: np.ndarray) -> None:
    base = row.astype(np.int64) * BUCKETS
    sums = np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        if len(codes) < n:
            return
        sums = sums[: len(codes) - n + 1] + codes[n - 1 :] * _MIX[n - 1]
        mixed = (sums ^ (sums >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        where = base[: len(mixed)] + (mixed >> np.uint32(18))
        flat[where if n == 1 else where[row[: len(mixed)] == row[n - 1 :]]] = 1


def fit_bits(bits: np.ndarray, langs: list[str], landmarks: int = 256, ridge: float = 1e-2) -> LanguageModel:
    """One-versus-rest kernel ridge regression on Nystroem features of presence rows."""
    names = sorted(set(langs))
    x = bits.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    pick = np.random.default_rng(7).permutation(len(x))[:landmarks]
    marks = x[pick].astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    fold = marks.T @ (vectors[:, keep] / np.sqrt(values[keep]))  # BUCKETS x rank
    z = x @ fold
    weight = 1.0 / np.maximum((y > 0).sum(0), 1)[(y > 0).argmax(1)]  # languages weigh alike
    weight *= len(y) / weight.sum()
    offset = np.average(y, axis=0, weights=weight)
    zw = z * weight[:, None]
    solved = np.linalg.solve(zw.T @ z + ridge * len(z) * np.eye(z.shape[1]) / max(len(names), 1), zw.T @ (y - offset))
    return LanguageModel(names, (fold @ solved).astype(np.float32), offset.astype(np.float32))


def fit(
    docs: DataFrame, per_language: int = 300, most_rows: int = 76_800, text: str = "text", lang: str = "lang", doc_id: str = "doc_id"
) -> LanguageModel | None:
    """Learn from rows with a language and crc32(id) mod 3 not 1; None if there are none.

    The bounded sample: about ``per_language`` rows of every language, by a hash of the id, fewer
    (but 20 at least, or all there are) where they would be over ``most_rows`` in sum. No language is
    left out. Presence bits are made on the executors; two kilobytes a row come to the driver.
    """
    small_batches(docs.sparkSession)
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id")).where(
        (crc_fold("doc_id") != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    per_language = min(per_language, max(20, most_rows // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                packed = np.packbits(presence(b.column("text").to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["lang", "bits"])

    rows = known.where(unit < share[F.col("lang")]).select("text", "lang").mapInArrow(bits, "lang string, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1)
    return fit_bits(np.unpackbits(packed, axis=1), [r["lang"] for r in rows])


def score_texts(texts: list[str | None], model: LanguageModel, step: int = 128) -> tuple[list[str], np.ndarray]:
    """Predicted language and its share of a softmax over the ridge outputs."""
    names, scores = [], np.zeros(len(texts))
    for at in range(0, len(texts), step):
        bits = presence([t or "" for t in texts[at : at + step]])
        size = np.sqrt(np.maximum(bits.sum(1, dtype=np.int64), 1))[:, None]
        out = (bits.astype(np.float32) @ model.weights) / size + model.offset
        soft = np.exp(model.sharpness * (out - out.max(1, keepdims=True)))
        soft /= soft.sum(1, keepdims=True)
        best = out.argmax(1)
        names += [model.languages[i] for i in best]
        scores[at : at + len(best)] = soft[np.arange(len(best)), best]
    return names, scores


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """All columns of docs with ``lang_pred`` and ``score`` (replaced if there).

    Null texts, texts without a letter and any text if there is no model: ``und`` and 0.
    """
    rest = docs.drop("lang_pred", "score")
    if model is None:
        return rest.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    mark = free_name(rest, "letter")
    schema = StructType([*rest.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    order = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            letter = np.array(b.column(mark).to_pylist(), bool)
            all_texts = b.column(text).to_pylist()
            names, scores = score_texts([t for t, ok in zip(all_texts, letter, strict=True) if ok], shared.value)
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            lang[letter], score[letter] = names, scores
            keep = [b.column(n) for n in order[:-2]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score)], names=order)

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return rest.withColumn(mark, letter).mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    held = docs.select("doc_id", F.coalesce(crc_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "text")
    done = predict(held, model)
    return done.select("doc_id", "held_out", "lang_pred", "score")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language; ``und`` ones are rejected. Columns of any name stay as they are."""
    own = docs.select(F.col("text").alias("text"), F.struct(*docs.columns).alias("row"))
    return predict(own, fit(docs)).where("lang_pred <> 'und'").select("row.*")
