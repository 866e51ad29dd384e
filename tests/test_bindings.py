"""Bindings over tables in which many rows are alike."""

import duckdb
import pytest
from oracle import same

from factweave import queries as q

ROWS = 2000


@pytest.fixture(scope="module")
def alike(tmp_path_factory):
    """2,000 suppliers and parts with seven remainders by 100, also negative, and one row without a key."""
    folder = tmp_path_factory.mktemp("alike")
    keys = f"(SELECT CAST(i AS BIGINT) AS i, CAST(i * 25 - 12500 AS BIGINT) AS k FROM range({ROWS}) r(i) UNION ALL SELECT 1, NULL)"
    duckdb.sql(f"COPY (SELECT k AS s_suppkey FROM {keys}) TO '{folder}/supplier.parquet'")
    brand = "concat('B', CASE WHEN i % 3 = 0 THEN 0 ELSE i // 7 % 4 END)"
    duckdb.sql(f"COPY (SELECT k AS p_partkey, concat('n', i % 3) AS p_name, {brand} AS p_brand FROM {keys}) TO '{folder}/part.parquet'")
    return str(folder)


def joined(df):
    """Rows that the joins of a query's plan made when it was run."""

    def of(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return of(node.plan())
        own = node.metrics().apply("numOutputRows").value() if "Join" in kind else 0
        return own + sum(of(node.children().apply(i)) for i in range(node.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["reference_groups", "resolution_counts", "symbol_relations"])
def test_calls_of_like_suppliers_are_found_once(spark, alike, name):
    df = q.queries()[name](spark, alike)
    same(df, alike, q.oracle_sql()[name])
    assert ROWS <= joined(df) < 8 * ROWS
