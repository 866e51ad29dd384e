"""Merging facts of overlapping providers: primary (0), augment (1) and audit (2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMARY, AUGMENT, AUDIT = 0, 1, 2


def claim_rank(claim: Column) -> Column:
    return F.when(claim.startswith("semantic-"), 3).when(claim == "syntax-structure", 2).when(claim == "lexical-occurrence", 1).otherwise(0)


def correlation(by_span: Column, span: Column, key: Column) -> Column:
    return F.when(by_span, F.concat(F.lit("span:"), span)).otherwise(F.concat(F.lit("key:"), key))


def merge(facts: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, grp, provider, mode, value, contributors): the fact chosen of each group.

    facts: domain, grp, provider, mode, claim, value. domains: domain, complete. The primary wins;
    else the first augment by claim rank and provider, unless a complete primary closes the domain.
    Grouping is one aggregate with map-side combine, so a hot group is no single task's work.
    """
    primaries = facts.where(F.col("mode") == PRIMARY).select("domain").distinct().withColumn("has", F.lit(True))
    closed = domains.join(primaries, "domain", "left").select("domain", (F.coalesce("has", F.lit(False)) & F.col("complete")).alias("closed"))
    order = F.struct("mode", (-claim_rank(F.col("claim"))).alias("c"), "provider", "value")
    live = facts.where(F.col("mode") != AUDIT).groupBy("domain", "grp").agg(F.min(order).alias("x"), F.countDistinct("provider").alias("contributors"))
    chosen = live.join(closed, "domain").where(~((F.col("x.mode") == AUGMENT) & F.col("closed")))
    return chosen.select("domain", "grp", F.col("x.provider").alias("provider"), F.col("x.mode").alias("mode"), F.col("x.value").alias("value"), "contributors")


def conflicts(facts: DataFrame, compared: tuple[str, ...] = ("value",)) -> DataFrame:
    """(domain, grp, code, differs): groups with several primaries, or augments that differ from the primary.

    ``compared``: the columns that must agree, as value, name, extent or resolution; differs lists
    those that don't. An augment that is silent on one (null) agrees. One aggregate, with no row
    per pair.
    """
    primary, augment = F.col("mode") == PRIMARY, F.col("mode") == AUGMENT
    picks = [F.count_if(primary).alias("p")]
    for c in compared:
        picks += [F.min(F.when(primary, F.col(c))).alias(f"{c}_p"), F.min(F.when(augment, F.col(c))).alias(f"{c}_lo"), F.max(F.when(augment, F.col(c))).alias(f"{c}_hi")]
    tally = facts.groupBy("domain", "grp").agg(*picks)
    off = [F.when(F.coalesce((F.col(f"{c}_lo") != F.col(f"{c}_p")) | (F.col(f"{c}_hi") != F.col(f"{c}_p")), F.lit(False)), F.lit(c)) for c in compared]
    differs = F.array_join(F.array_compact(F.array(*off)), ",")
    code = F.when(F.col("p") > 1, "duplicate-primary-occurrence").when((F.col("p") == 1) & (differs != ""), "augment-mismatch")
    return tally.select("domain", "grp", code.alias("code"), F.when(code == "augment-mismatch", differs).otherwise("").alias("differs")).where("code is not null")


def primary_cardinality(capabilities: DataFrame) -> DataFrame:
    """(domain, code) of domains that several providers claim as primary; capabilities: domain, provider, mode."""
    many = capabilities.where(F.col("mode") == PRIMARY).groupBy("domain").agg(F.countDistinct("provider").alias("n")).where("n > 1")
    return many.select("domain", F.lit("primary-cardinality").alias("code"))


class MergeConflict(ValueError):
    """Facts of overlapping providers contradict each other."""


def strict_merge(facts: DataFrame, domains: DataFrame, compared: tuple[str, ...] = ("value",)) -> DataFrame:
    """``merge``, or MergeConflict with how many groups conflict and the first of them."""
    found = conflicts(facts, compared)
    first = found.orderBy("domain", "grp").limit(1).collect()
    if first:
        raise MergeConflict(f"{found.count()} conflicts; first {first[0]['code']} in {first[0]['domain']} at {first[0]['grp']}")
    return merge(facts, domains)


def enriched(facts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(domain, grp, names..., enriched): attributes of the live facts united, the chosen fact's first.

    Each attribute comes from the first fact that has it, in the order facts are chosen in; enriched
    lists those that the chosen fact itself lacks.
    """
    order = F.struct("mode", (-claim_rank(F.col("claim"))).alias("c"), "provider", "value")
    live = facts.where(F.col("mode") != AUDIT).withColumn("place", order)
    picks = [F.min(F.when(F.col(n).isNotNull(), F.struct("place", F.col(n).alias("it")))).alias(n) for n in names]
    best = live.groupBy("domain", "grp").agg(F.min("place").alias("first"), *picks)
    lent = F.array_compact(F.array(*[F.when(F.col(f"{n}.place") > F.col("first"), F.lit(n)) for n in names]))
    return best.select("domain", "grp", *[F.col(f"{n}.it").alias(n) for n in names], F.array_join(lent, ",").alias("enriched"))


def variations(facts: DataFrame) -> DataFrame:
    """Groups whose live facts differ in value: the ledger of what was not merged away."""
    live = facts.where(F.col("mode") != AUDIT).groupBy("domain", "grp").agg(F.countDistinct("value").alias("variants"))
    return live.where("variants > 1")


def summary(facts: DataFrame, merged: DataFrame) -> DataFrame:
    """One row of counters; audit facts are only compared with what was chosen."""
    base = facts.agg(F.countDistinct("provider").alias("providers"), F.countDistinct("domain", "provider").alias("selections"), F.count_if(F.col("mode") != AUDIT).alias("contributed"))
    ledgers = variations(facts).agg(F.count("*").alias("variations")).crossJoin(conflicts(facts).agg(F.count("*").alias("conflicts")))
    chosen = merged.agg(F.count("*").alias("selected_facts"), F.count_if(F.col("contributors") > 1).alias("deduplicated"))
    audit = facts.where(F.col("mode") == AUDIT).select("domain", "grp", F.col("value").alias("seen")).join(merged.select("domain", "grp", "value"), ["domain", "grp"], "left")
    audits = audit.agg(F.count_if(F.col("seen").eqNullSafe(F.col("value"))).alias("audit_match"), F.count_if(~F.col("seen").eqNullSafe(F.col("value"))).alias("audit_difference"))
    return base.crossJoin(chosen).crossJoin(ledgers).crossJoin(audits)  # rows of counts


def contributors(facts: DataFrame) -> DataFrame:
    """(domain, grp, providers, claims): who stands behind a merged fact; audit rows do not count."""
    kept = facts.where("mode < 2").groupBy("domain", "grp")
    return kept.agg(F.array_sort(F.collect_set("provider")).alias("providers"), F.array_sort(F.collect_set("claim")).alias("claims"))
