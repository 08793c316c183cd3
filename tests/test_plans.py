"""Plan-shape guarantees behind the scale design."""

import pytest

from pricefold.plans.registry import load_all

QUERIES = {name: q.run for name, q in load_all().items()}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def shuffles_above_cache(df) -> list[str]:
    """Shuffle exchanges in the executed plan, not counting the plans of cached
    relations (walks AQE stages; stops at in-memory table scans)."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "InMemoryTableScan":
            return
        if name == "Exchange":
            found.append(node.simpleStringWithNodeId() if hasattr(node, "simpleStringWithNodeId") else name)
        if name == "AdaptiveSparkPlan":
            kids = [node.executedPlan()]
        elif name.endswith("QueryStage"):
            kids = [node.plan()]
        else:
            ch = node.children()
            kids = [ch.apply(i) for i in range(ch.size())]
        for k in kids:
            walk(k)

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_and_no_row_udfs(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in FORBIDDEN if k in plan]


def test_flagship_reuses_series_partitioning(spark, sf_dir):
    """After the series-partitioned bound panel, the optimum needs no shuffle."""
    df = QUERIES["optimize_price"](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    assert "InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert shuffles_above_cache(df) == []
    # the walker does see shuffles where they exist
    assert shuffles_above_cache(spark.range(100).selectExpr("id % 3 AS k").groupBy("k").count())


def test_no_single_partition_over_series(spark, sf_dir):
    """Numbering the series is spread over partitions; one task sees a row per partition only."""
    from pricefold.plans.queries_table import bundle_for
    from pricefold.sources.panel import series_index

    idx = series_index(bundle_for(spark, sf_dir).sales)
    idx.collect()
    plan = idx._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if line.strip(" +-:").startswith("Window") and "sku_id" in line]
    assert windows and all("[_part" in line for line in windows)
