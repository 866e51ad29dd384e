"""Evidence states, key collisions, completeness and the result of a predicate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENT, UNKNOWN, STALE = "current", "unknown", "stale"
STATES = {STALE: 0, UNKNOWN: 1, CURRENT: 2}


def rank(state: Column) -> Column:
    return F.when(state == CURRENT, 2).when(state == UNKNOWN, 1).otherwise(0)


def named(rank_col: Column) -> Column:
    return F.when(rank_col == 2, CURRENT).when(rank_col == 1, UNKNOWN).otherwise(STALE)


def best_state(state: str = "state") -> Column:
    """Aggregate: the strongest of the evidence; no evidence counts as current."""
    return named(F.coalesce(F.max(rank(F.col(state))), F.lit(2)))


def collide(items: DataFrame, key: str = "key", *values: str) -> DataFrame:
    """One item per key; keys that several items claim become unknown."""
    picks = [F.min(v).alias(v) for v in values]
    return items.groupBy(key).agg(*picks, F.when(F.count("*") > 1, UNKNOWN).otherwise(F.min("state")).alias("state"))


@dataclass
class Projection:
    """Items with a shape; all lazy.

    ``universe`` is what they were selected from, ``unsupported`` what could not be looked at (both
    rows to be counted), ``truncated`` whether a limit cut the selection, ``known`` whether the
    operand as a whole is known.
    """

    items: DataFrame
    shape: str
    universe: DataFrame | None = None
    unsupported: DataFrame | None = None
    truncated: bool = False
    known: bool = True

    def completeness(self) -> DataFrame:
        """One row of counters and their classification, in one pass over each input.

        universe = selected + excluded, selected = evaluated + unknown. A truncated selection,
        unsupported inputs and items of unknown or stale state make it incomplete.
        """
        sure = F.col("state") == CURRENT
        counts = [self.items.agg(F.count("*").alias("selected"), F.count_if(sure).alias("evaluated"), F.count_if(~sure).alias("unknown"))]
        counts.append((self.universe if self.universe is not None else self.items).agg(F.count("*").alias("universe")))
        if self.unsupported is not None:
            counts.append(self.unsupported.agg(F.count("*").alias("unsupported")))
        row = reduce(lambda a, b: a.crossJoin(b), counts)  # rows of counts
        if self.unsupported is None:
            row = row.withColumn("unsupported", F.lit(0).cast("long"))
        row = row.withColumn("excluded", F.col("universe") - F.col("selected")).withColumn("truncated", F.lit(self.truncated))
        partly = F.col("truncated") | (F.col("unsupported") > 0) | (F.col("unknown") > 0) | (F.col("excluded") < 0)
        kind = F.when(F.lit(not self.known), "unknown").when(partly, "incomplete").otherwise("complete")
        names = ("universe", "selected", "evaluated", "excluded", "unsupported", "unknown", "truncated")
        return row.select(*names, kind.alias("classification"))


def findings(*parts: DataFrame) -> DataFrame:
    """(comparison, key, state) rows of several checks."""
    return reduce(lambda a, b: a.unionByName(b), [p.select("comparison", "key", "state") for p in parts])


def finding_id(check: Column) -> Column:
    """Identity of a finding: digest of the canonical JSON of check, comparison and key."""
    body = F.to_json(F.struct(check.alias("check"), F.col("comparison"), F.col("key")), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def status_fold(checks: DataFrame, found: DataFrame) -> DataFrame:
    """pass, waived, fail, unknown or not_applicable for each check.

    ``found``: check, comparison, state, applicable, waived. No finding passes; only findings that
    don't apply are not_applicable; none open is waived; an open current difference fails; what
    is left is unknown.
    """
    is_open = F.col("applicable") & ~F.col("waived")
    tally = found.groupBy("check").agg(
        F.count("*").alias("n"), F.count_if("applicable").alias("apply"), F.count_if(is_open).alias("open"),
        F.count_if(is_open & (F.col("state") == CURRENT) & (F.col("comparison") != "equal")).alias("bad"),
    )
    status = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "pass").when(F.col("apply") == 0, "not_applicable").when(F.col("open") == 0, "waived").when(F.col("bad") > 0, "fail").otherwise("unknown")
    )
    return checks.join(tally, "check", "left").select("check", status.alias("status"))
