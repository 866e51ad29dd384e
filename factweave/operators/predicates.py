"""The 17 assertions: each compares items and yields findings (comparison, key, state).

Operands must be complete; ``guard`` turns an incomplete one into a single unknown finding, so
missing evidence never passes. Edge patterns are driver literals, so matching them is a filter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.operators.traverse import CoreTooLarge, cycle_core, cycle_witnesses
from factweave.plans.evidence import CURRENT, UNKNOWN, findings

Pattern = tuple[str, str, str]


def _found(df: DataFrame, comparison: str, key: str | Column = "key", state: Column | None = None) -> DataFrame:
    return df.select(F.lit(comparison).alias("comparison"), (F.col(key) if isinstance(key, str) else key).alias("key"), (state if state is not None else F.lit(CURRENT)).alias("state"))


def guard(found: DataFrame, *completeness: DataFrame) -> DataFrame:
    """Replace all findings by one unknown if an operand is not complete."""
    bad = reduce(lambda a, b: a.unionByName(b), [c.select("classification") for c in completeness]).agg(F.count_if(F.col("classification") != "complete").alias("bad"))
    kept = found.crossJoin(bad).where("bad = 0").drop("bad")
    return kept.unionByName(_found(bad.where("bad > 0"), "different", F.lit("*"), F.lit(UNKNOWN)))


def mapped(actual: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename keys by a dictionary, identity otherwise; (key, original columns)."""
    if not names:
        return actual
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return actual.withColumn("key", F.coalesce(F.get(F.array(table[F.col("key")]), F.lit(0)), F.col("key")))


def missing(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return _found(expected.join(actual.select("key"), "key", "left_anti"), "missing")


def extra(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return _found(actual.join(expected.select("key"), "key", "left_anti"), "extra")


def set_equal(actual: DataFrame, expected: DataFrame) -> DataFrame:
    return findings(missing(expected, actual), extra(expected, actual))


def collisions(actual: DataFrame) -> DataFrame:
    return _found(actual.groupBy("key").count().where("count > 1"), "collision", state=F.lit(UNKNOWN))


def mapped_set_equal(actual: DataFrame, expected: DataFrame, names: dict[str, str]) -> DataFrame:
    own = mapped(actual, names)
    return findings(set_equal(own.select("key").distinct(), expected), collisions(own))


def different(actual: DataFrame, expected: DataFrame) -> DataFrame:
    both = actual.select("key", F.col("value").alias("a"), "state").join(expected.select("key", F.col("value").alias("e")), "key")
    unsure = _found(both.where(F.col("state") != CURRENT), "different", state=F.lit(UNKNOWN))
    return findings(_found(both.where((F.col("state") == CURRENT) & ~F.col("a").eqNullSafe(F.col("e"))), "different"), unsure)


def values_equal(actual: DataFrame, expected: DataFrame) -> DataFrame:
    return findings(set_equal(actual, expected), different(actual, expected))


def mapped_values_equal(actual: DataFrame, expected: DataFrame, names: dict[str, str]) -> DataFrame:
    own = mapped(actual, names)
    single = own.groupBy("key").agg(F.min("value").alias("value"), F.when(F.count("*") > 1, UNKNOWN).otherwise(F.min("state")).alias("state"))
    return findings(values_equal(single, expected), collisions(own))


def subset(actual: DataFrame, expected: DataFrame) -> DataFrame:
    return extra(expected, actual)


def required_subset(actual: DataFrame, expected: DataFrame) -> DataFrame:
    return missing(expected, actual)


def required_values(actual: DataFrame, expected: DataFrame) -> DataFrame:
    return findings(missing(expected, actual), different(actual, expected))


def disjoint(actual: DataFrame, expected: DataFrame) -> DataFrame:
    return _found(actual.join(expected.select("key"), "key", "left_semi"), "overlap")


def provider_surface(actual: DataFrame, declared: tuple = (), forbid_unregistered: bool = False, forbid_unresolved: bool = False, forbid_ambiguous: bool = False, all_providers: int = 0) -> DataFrame:
    """Required names must be declared; each item breaks at most the first rule in this order."""
    no = F.lit(None).cast("string")
    ladder = F.when(F.lit(forbid_unregistered) & (F.col("declaration") != "declared") & F.col("used"), "unregistered")
    ladder = ladder.when(F.lit(forbid_unresolved) & (F.col("resolution") == "unresolved"), "unresolved")
    ladder = ladder.when(F.lit(forbid_ambiguous) & (F.col("resolution") == "ambiguous"), "ambiguous")
    ladder = ladder.when(F.lit(all_providers > 0) & (F.col("providers") < all_providers), "missing").otherwise(no)
    rules = actual.withColumn("comparison", ladder).where("comparison is not null").select("comparison", "key", "state")
    if not declared:
        return rules
    wanted = actual.sparkSession.createDataFrame([(d,) for d in declared], "key string")
    have = actual.where(F.col("declaration") == "declared").select("key")
    return findings(rules, _found(wanted.join(have, "key", "left_anti"), "missing"))


def edge_key() -> Column:
    return F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce("target", F.lit("")))


def matches(pattern: Pattern) -> Column:
    return reduce(lambda a, b: a & b, [P.glob(F.coalesce(c, F.lit("")), p) for c, p in zip(("source", "kind", "target"), pattern, strict=True)])


def _matches_any(patterns: list[Pattern]) -> Column:
    return reduce(lambda a, b: a | b, [matches(p) for p in patterns], F.lit(False))


def required_edges(edges: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Patterns that no edge matches; one pass over the edges for all patterns."""
    hits = edges.agg(*[F.coalesce(F.bool_or(matches(p)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(patterns)])
    rows = F.explode(F.array(*[F.struct(F.lit("|".join(p)).alias("key"), F.col(f"p{i}").alias("hit")) for i, p in enumerate(patterns)]))
    return _found(hits.select(rows.alias("x")).select("x.*").where("not hit"), "missing")


def forbidden_edges(edges: DataFrame, patterns: list[Pattern]) -> DataFrame:
    return _found(edges.where(_matches_any(patterns)), "forbidden", edge_key(), F.col("state"))


def allowed_edges(edges: DataFrame, patterns: list[Pattern]) -> DataFrame:
    return _found(edges.where(~_matches_any(patterns)), "extra", edge_key(), F.col("state"))


def acyclic(edges: DataFrame, most_edges: int = 100_000) -> DataFrame:
    """A finding for every cycle that a depth-first search in byte order closes: ``a -> b -> a``, smallest node first.

    The search runs on what is left when nodes off all cycles are trimmed away on the executors.
    Should that be more than ``most_edges``, one unknown finding says so: a graph with cycles never passes.
    """
    spark = edges.sparkSession
    try:
        cycles = cycle_witnesses(cycle_core(edges), most_edges)
        rows = [("different", " -> ".join([*c, c[0]]), CURRENT) for c in cycles]
    except CoreTooLarge:
        rows = [("different", "*", UNKNOWN)]
    return spark.createDataFrame(rows, "comparison string, key string, state string")


def cardinality(actual: DataFrame, exact: int | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    n = actual.agg(F.count("*").alias("n"), F.count_if(F.col("state") != CURRENT).alias("unsure"))
    bad = F.lit(False)
    for limit, test in ((exact, F.col("n") != exact), (least, F.col("n") < least), (most, F.col("n") > most)):
        bad = bad | (test if limit is not None else F.lit(False))
    state = F.when(F.col("unsure") > 0, UNKNOWN).otherwise(CURRENT)
    return _found(n.where(bad | (F.col("unsure") > 0)), "cardinality", F.col("n").cast("string"), state)


def numeric_bounds(actual: DataFrame, exact: int | None = None, least: int | None = None, most: int | None = None, allow_empty: bool = False) -> DataFrame:
    v = F.col("value")
    bad = F.lit(False)
    for limit, test in ((exact, v != exact), (least, v < least), (most, v > most)):
        bad = bad | (test if limit is not None else F.lit(False))
    unsure = v.isNull() | (v < 0) | (F.col("state") != CURRENT)
    out = _found(actual.where(unsure | bad), "bounds", state=F.when(unsure, UNKNOWN).otherwise(CURRENT))
    if allow_empty:
        return out
    return findings(out, _found(actual.agg(F.count("*").alias("n")).where("n = 0"), "empty", F.lit("*")))


def min_test_routes(routes: DataFrame, least: int, required: tuple = ()) -> DataFrame:
    few = _found(routes.agg(F.countDistinct("target").alias("n")).where(F.col("n") < least), "cardinality", F.col("n").cast("string"))
    if not required:
        return few
    wanted = routes.sparkSession.createDataFrame([(r,) for r in required], "key string")
    return findings(few, missing(wanted, routes.select(F.col("target").alias("key")).distinct()))


def observations_equal(actual: DataFrame, expected: DataFrame, rtol: float = 0.0, atol: float = 0.0, nan_equal: bool = True, signed_zero_equal: bool = True) -> DataFrame:
    """Values of (case, route) compared within tolerances; absent ones are missing, inapplicable ones skipped.

    Spark takes NaN as equal to NaN and -0.0 to 0.0, so both are tested by hand.
    """
    both = expected.select("case", "route", F.col("value").alias("e")).join(actual.select("case", "route", F.col("value").alias("a"), "applicable"), ["case", "route"], "left")
    key = F.concat_ws("/", "case", "route")
    close = F.abs(F.col("a") - F.col("e")) <= F.greatest(F.lit(atol), F.lit(rtol) * F.greatest(F.abs("a"), F.abs("e")))
    nan = F.isnan("a") | F.isnan("e")
    same = F.when(nan, F.lit(nan_equal) & F.isnan("a") & F.isnan("e")).otherwise(close)
    if not signed_zero_equal:
        negative = [F.col(c).cast("string") == "-0.0" for c in ("a", "e")]
        same = same & (negative[0] == negative[1])
    gone = both.where(F.col("applicable").isNull())
    live = both.where(F.col("applicable"))
    return findings(_found(gone, "missing", key), _found(live.where(~F.coalesce(same, F.lit(False))), "different", key))


def ulp_distance(a: Column, b: Column) -> Column:
    """Steps between two doubles in their monotone order, by a pandas UDF (bits can't be read in SQL)."""
    @F.pandas_udf("double")
    def steps(x: pd.Series, y: pd.Series) -> pd.Series:
        def order(v: pd.Series) -> np.ndarray:
            bits = v.to_numpy(np.float64).view(np.int64)
            return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)

        p, q = order(x), order(y)
        return pd.Series(np.where(p > q, p - q, q - p).view(np.uint64).astype(np.float64))  # wraps to the right value

    return steps(a, b)


#: Names of doubles that JSON has no number for, and their bits.
FLOATS = {"nan": "7ff8000000000000", "+inf": "7ff0000000000000", "-inf": "fff0000000000000", "-0": "8000000000000000"}


def float_bits(rows: DataFrame, encoded: str = "encoded") -> DataFrame:
    """rows with ``bits``, the 16 hexadecimal digits of an encoded double; null if it is none.

    A double is a JSON number, {"float": name} or {"float_bits": digits}. Only plain numbers need Python.
    """
    @F.pandas_udf("string")
    def packed(x: pd.Series) -> pd.Series:
        values = pd.to_numeric(x, errors="coerce")
        return pd.Series([None if pd.isna(v) else f"{int(np.float64(v).view(np.uint64)):016x}" for v in values], dtype=object)

    names = F.create_map(*[F.lit(x) for pair in FLOATS.items() for x in pair])
    text = F.col(encoded)
    digits = F.lower(F.get_json_object(text, "$.float_bits"))
    by_name = F.try_element_at(names, F.get_json_object(text, "$.float"))
    number = F.when(text.rlike(r"^\s*-?[0-9]"), packed(text))
    return rows.withColumn("bits", F.coalesce(F.when(digits.rlike("^[0-9a-f]{16}$"), digits), by_name, number))
