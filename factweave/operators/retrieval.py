"""Ranked lexical retrieval in integer arithmetic, and evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import match_strength, query_terms


def scored(fields: DataFrame, query: str) -> DataFrame:
    """(kind, path, name, score) of the candidates that match any term of a query.

    fields: kind, path, name, field, weight (one row per candidate and field). Per term the best
    strength times weight counts; rare terms count more; broad coverage raises the score.
    """
    terms = query_terms(query)
    identity = ["kind", "path", "name"]
    total = fields.select(*identity).distinct().agg(F.count("*").alias("total"))
    if not terms:
        return fields.select(*identity).limit(0).withColumn("score", F.lit(0).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("term"), match_strength(F.col("field"), t).alias("strength")) for i, t in enumerate(terms)]))
    hits = fields.select(*identity, F.col("weight").alias("w"), each.alias("t")).where("t.strength > 0")
    best = hits.groupBy(*identity, F.col("t.term").alias("term")).agg(F.max(F.struct((F.col("t.strength") * F.col("w")).alias("product"), F.col("t.strength").alias("strength"), F.col("w").alias("weight"))).alias("b"))
    frequency = best.groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.least(F.lit(2048), 64 + F.expr("(256 * (total + 1)) div (df + 1)"))
    rows = best.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(total))  # one row a term, one row
    points = (F.col("b.product") * rarity).cast("long")
    if len(terms) > 1:
        points = F.when(F.col("b.strength") < 44, F.floor(points / 4)).otherwise(points).cast("long")
    weight_bonus = F.when(F.col("b.weight") > 40, 100).otherwise(F.floor(F.col("b.weight") * 5 / 2))
    cover = F.when(F.col("b.strength") >= 100, 100).otherwise(F.least(F.lit(100), F.col("b.strength") + weight_bonus)).cast("long")
    sums = rows.select(*identity, points.alias("points"), cover.alias("cover")).groupBy(*identity).agg(F.sum("points").alias("p"), F.sum("cover").alias("c"))
    return sums.select(*identity, F.expr("(p * c * c) div 10000").alias("score"))


def _order() -> list:
    return [F.desc("score"), F.asc("kind"), F.asc("path"), F.asc("name")]


def diversified(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits by score: two thirds of the places one per location, the rest as they come.

    Only ``limit`` hits per location and then ``limit`` overall can be chosen, so ranks are taken
    per location first and no full sort of all hits meets in one task.
    """
    per = Window.partitionBy("path").orderBy(*_order())
    near = hits.withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= limit)
    wide = (2 * limit + 2) // 3 if limit >= 3 else limit
    first = near.where("nth = 1").orderBy(*_order()).limit(wide)
    rest = near.join(first.select("kind", "path", "name"), ["kind", "path", "name"], "left_anti").orderBy(*_order()).limit(limit)
    both = first.withColumn("turn", F.lit(0)).unionByName(rest.withColumn("turn", F.lit(1)))
    chosen = both.orderBy("turn", *_order()).limit(limit)
    return chosen.select("kind", "path", "name", "score")


def recall_at(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(query, recall_k...) from (query, item, rank) and (query, item)."""
    both = relevant.join(ranked, ["query", "item"], "left").groupBy("query")
    return both.agg(*[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks])


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query, rr): one over the rank of the first relevant item, 0 without any."""
    both = relevant.join(ranked, ["query", "item"], "left").groupBy("query").agg(F.min("rank").alias("r"))
    return both.select("query", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("rr"))


def distractor_ratio(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, distractors): the share of the first k results that are not relevant."""
    marked = ranked.where(F.col("rank") <= k).join(relevant.select("query", "item", F.lit(1).alias("hit")).distinct(), ["query", "item"], "left")
    return marked.groupBy("query").agg((F.count_if(F.col("hit").isNull()) / F.count("*")).alias("distractors"))


def budget_recall(ranked: DataFrame, relevant: DataFrame, budget: int) -> DataFrame:
    """(query, recall): relevant items whose results, read in order, end within ``budget`` lines."""
    read = ranked.withColumn("used", F.sum("lines").over(Window.partitionBy("query").orderBy("rank", "item").rowsBetween(Window.unboundedPreceding, 0)))
    both = relevant.join(read.select("query", "item", "used"), ["query", "item"], "left").groupBy("query")
    return both.agg((F.count_if(F.col("used") <= budget) / F.count("*")).alias("recall"))
