"""Toxicity by a linear-chain conditional random field over tokens.

Documents carry labels, tokens don't: a token of a toxic document is labelled toxic if one of its
features (the word, a prefix of 4 to 7 letters) stands in toxic documents far more often than in
clean ones, and every token of a clean document is labelled clean. The field has two tags, one
weight per kept feature, a bias and four transition weights, trained by gradient ascent on windows
around tokens with kept features. Forward-backward marginals of whole texts give offending offsets
and, through a logistic layer over their sum and maximum, the document's score.

Tokens without a kept feature all have the same potentials, so a stretch of them is one power of a
2 x 2 matrix, and a document costs no more than its tokens with features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from factweave.llm.common import Stages, crc_fold, small_batches

TOKEN = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7)
#: Bounds of the training sample: labelled documents of either class, features, windows.
MOST_TOXIC, MOST_CLEAN, MOST_FEATURES, MOST_WINDOWS = 4000, 8000, 4000, 6000
LEAST_GAIN, LEAST_RATIO = 18.0, 12.0
REACH = 4
CACHE = 400_000


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    moves: np.ndarray  # 2 x 2, from tag to tag
    layer: np.ndarray  # logistic: constant, log1p(sum of marginals), greatest marginal
    prior: float
    gaps: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 2)))

    def __post_init__(self):
        step = np.exp(self.moves) * np.exp([0.0, self.bias])[None, :]
        powers = [np.eye(2)]
        for _ in range(256):  # by then a power of a positive 2 x 2 matrix is its limit
            nxt = powers[-1] @ step
            powers.append(nxt / nxt.max())
        self.gaps = np.array(powers)

    def emission(self, word: str) -> float | None:
        own = [self.weights[f] for f in features(word) if f in self.weights]
        return sum(own) if own else None

    def score(self, marginals: list[float]) -> float:
        total, most = sum(marginals), max(marginals, default=0.0)
        return 1 / (1 + math.exp(-float(np.clip(self.layer @ [1.0, math.log1p(total), most], -30, 30))))


class _Known(dict):
    """Emissions of words, made when first asked for."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float | None:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = self.model.emission(word)
        return got


def marginals(model: ToxicityModel, count: int, places: list[int], emissions: list[float]) -> list[float]:
    """Posterior of the toxic tag at the places with features among ``count`` tokens."""
    if not places:
        return []
    gaps, last = model.gaps, len(model.gaps) - 1
    moves = np.exp(model.moves)
    forward, scale = [], [(1.0, math.exp(min(model.bias + e, 60.0))) for e in emissions]
    at, vector = -1, None
    for place, (clean, toxic) in zip(places, scale, strict=True):
        free = place - at - 1
        if vector is None:
            first = np.array([1.0, math.exp(model.bias)]) if free else None
            vector = first @ gaps[min(free - 1, last)] @ moves if free else np.ones(2)
        else:
            vector = vector @ gaps[min(free, last)] @ moves
        vector = vector * (clean, toxic)
        vector = vector / vector.sum()
        forward.append(vector)
        at = place
    back, out = gaps[min(count - 1 - at, last)] @ np.ones(2), []
    for i in range(len(places) - 1, -1, -1):
        both = forward[i] * back
        out.append(float(both[1] / both.sum()))
        if i:
            free = places[i] - places[i - 1] - 1
            back = gaps[min(free, last)] @ (moves @ (np.array(scale[i]) * back))
            back = back / back.sum()
    return out[::-1]


def tag(model: ToxicityModel, text: str, known: _Known) -> tuple[float, list[tuple[int, int, float]]]:
    """Document score and (start, end, marginal) of its tokens with features; offsets in code points."""
    low = text.lower()
    words = TOKEN.findall(low)
    got = list(map(known.__getitem__, words))
    places = [i for i, e in enumerate(got) if e is not None]
    if not places:
        return model.score([]), []
    found = marginals(model, len(words), places, [got[i] for i in places])
    exact = low if len(low) == len(text) else text  # a few letters change length in lower case
    spans, wanted = {}, set(places)
    for i, m in enumerate(TOKEN.finditer(exact)):
        if i in wanted:
            spans[i] = m.span()
    return model.score(found), [(*spans.get(i, (0, 0)), p) for i, p in zip(places, found, strict=True)]


def _train(ids: np.ndarray, tags: np.ndarray, there: np.ndarray, size: int, rounds: int = 120, decay: float = 2e-4):
    """Weights, bias and moves that maximise the conditional likelihood of windows (rows)."""
    n, length, _ = ids.shape
    theta = np.zeros(size + 1 + 4)
    theta[size] = -2.0
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        weights = np.concatenate([[0.0], theta[:size]])
        moves = theta[size + 1 :].reshape(2, 2)
        emit = np.zeros((n, length, 2))
        emit[:, :, 1] = (weights[ids].sum(2) + theta[size]) * there
        step = np.exp(moves)
        alpha, beta = np.zeros((n, length, 2)), np.ones((n, length, 2))
        potential = np.exp(np.clip(emit, -50, 50))
        for t in range(length):
            now = potential[:, t] if t == 0 else np.where(there[:, t, None], (alpha[:, t - 1] @ step) * potential[:, t], alpha[:, t - 1])
            alpha[:, t] = now / now.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            now = np.where(there[:, t + 1, None], (potential[:, t + 1] * beta[:, t + 1]) @ step.T, beta[:, t + 1])
            beta[:, t] = now / now.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        rise = (tags - post[:, :, 1]) * there
        slope = np.zeros_like(theta)
        slope[:size] = np.bincount(ids.reshape(-1), np.repeat(rise.reshape(-1), ids.shape[2]), size + 1)[1:]
        slope[size] = rise.sum()
        pair = alpha[:, :-1, :, None] * step * (potential[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        both = there[:, 1:]
        seen = np.zeros((2, 2))
        np.add.at(seen, (tags[:, :-1][both].astype(int), tags[:, 1:][both].astype(int)), 1)
        slope[size + 1 :] = (seen - pair[both].sum(0)).reshape(-1)
        slope = slope / n - decay * theta
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        theta += 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.999**turn)) + 1e-8)
    return theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a small logistic regression; the constant's penalty is as small."""
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) / 100 * np.eye(x.shape[1])
        theta += np.linalg.solve(bend, x.T @ (y - p) - ridge * len(x) / 100 * theta)
    return theta


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> ToxicityModel | None:
    """Learn from labelled rows with crc32(id) mod 3 not 1; None unless both labels occur.

    The sample holds about MOST_TOXIC and MOST_CLEAN documents, by a hash of the id; their ids are
    broadcast, as the bound is fixed, so no text is shuffled to find them. Feature counts are aggregated on the executors; at most MOST_FEATURES features, MOST_WINDOWS windows and two
    figures per sampled document come to the driver.
    """
    small_batches(docs.sparkSession)
    marked = labels.select(F.col(doc_id).alias("id"), F.col("toxic").cast("int").alias("toxic")).where((crc_fold("id") != 1) & F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = {1: min(1.0, MOST_TOXIC / sizes[1]), 0: min(1.0, MOST_CLEAN / sizes[0])}
    unit = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    chosen = marked.where(unit < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    chosen = F.broadcast(chosen.limit(2 * (MOST_TOXIC + MOST_CLEAN)))  # far above what the shares let through
    named = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    sample = Stages(docs.sparkSession).put(named.join(chosen, "id").select("id", "text", "toxic"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = (Counter(), Counter())
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                sums[y].update({f for w in set(TOKEN.findall(t.lower())) for f in features(w)} | {""})
            for y, c in enumerate(sums):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["f", "y", "n"])

    seen = sample.mapInArrow(count, "f string, y int, n long").groupBy("f").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("bad"), F.sum(F.expr("if(y = 0, n, 0)")).alias("good"))
    whole = sample.groupBy().agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    ratio = (F.col("bad") / float(max(whole["bad"], 1))) / ((F.col("good") + 0.5) / float(max(whole["good"], 1)))
    ranked = seen.where("f <> ''").withColumn("ratio", ratio).withColumn("gain", F.col("bad") * F.log("ratio"))
    kept = ranked.where((F.col("gain") >= LEAST_GAIN) & (F.col("ratio") >= LEAST_RATIO)).orderBy(F.desc("gain"), "f").limit(MOST_FEATURES).select("f").collect()
    names = {r["f"]: i + 1 for i, r in enumerate(kept)}
    if not names:
        return None
    width = len(PREFIXES) + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, list[int]]] = []
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = [[names[f] for f in features(w) if f in names] for w in TOKEN.findall(t.lower())]
                marked_at = [i for i, x in enumerate(own) if x]
                for i in marked_at[:: max(1, len(marked_at) // 4)] or [len(own) // 2] * bool(own):
                    row = []
                    for j in range(i - REACH, i + REACH + 1):
                        ids = own[j] if 0 <= j < len(own) else [-1]
                        row += ids + [0] * (width - len(ids))
                    out.append((y, row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], names=["y", "ids"])

    dealt = sample.mapInArrow(windows, "y int, ids array<int>")
    rows = dealt.orderBy(F.xxhash64("y", "ids")).limit(MOST_WINDOWS).collect()
    ids = np.array([r["ids"] for r in rows]).reshape(len(rows), 2 * REACH + 1, width)
    there = ids[:, :, 0] >= 0
    ids = np.maximum(ids, 0)
    tags = (ids > 0).any(2) & (np.array([r["y"] for r in rows]) == 1)[:, None]
    weights, bias, moves = _train(ids, tags.astype(float), there, len(names))
    model = ToxicityModel({f: float(weights[i - 1]) for f, i in names.items()}, bias, moves, np.zeros(3), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for b in batches:
            if b.num_rows:
                got = [[p for _, _, p in tag(shared.value, t, known)[1]] for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([sum(g) for g in got], pa.float64()), pa.array([max(g, default=0.0) for g in got], pa.float64())], names=["y", "total", "most"])

    stats = np.array([tuple(r) for r in sample.mapInArrow(totals, "y int, total double, most double").collect()], float).reshape(-1, 3)
    model.layer = _logistic(np.stack([np.ones(len(stats)), np.log1p(stats[:, 1]), stats[:, 2]], 1), stats[:, 0])
    model.prior = sizes[1] / (sizes[0] + sizes[1])
    return model


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with ``score`` and ``offending`` (start, end, marginal of at least ``least``), text dropped.

    Null and empty texts have no tokens and get the score of a text without marked tokens; without
    a model every score is 0. Columns of those names are replaced.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop("score", "offending")
    spans = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("marginal", DoubleType())]))
    names = [n for n in rest.columns if n != text]
    schema = StructType([*[rest.schema[n] for n in names], StructField("score", DoubleType()), StructField("offending", spans)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = _Known(own)
        for b in batches:
            if not b.num_rows:
                continue
            got = [tag(own, t or "", known) if own else (0.0, []) for t in b.column(text).to_pylist()]
            bad = [[{"start": s, "end": e, "marginal": p} for s, e, p in g[1] if p >= least] for g in got]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array([g[0] for g in got], pa.float64()), pa.array(bad, kind)], names=schema.names)

    return rest.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels)
    rows = docs.select("doc_id", F.coalesce(crc_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
