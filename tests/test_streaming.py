import os
import tempfile

import pandas as pd


def test_refresh_reanalyses_touched_series(spark):
    from pricefold.streaming.refresh import SALES_SCHEMA, refresh_optimal_prices

    root = tempfile.mkdtemp(prefix="pricefold-stream-")
    src, out, ck = (os.path.join(root, d) for d in ("sales", "out", "ck"))
    dates = pd.date_range("2022-01-03", periods=60, freq="7D").date
    rows = [(s, d, 10.0 + (i % 7), 100.0 - 2 * (i % 7) + (3 if s == "B" else 0), 6.0) for s in ("A", "B") for i, d in enumerate(dates)]
    spark.createDataFrame(rows, SALES_SCHEMA).coalesce(2).write.mode("append").parquet(src)
    q = refresh_optimal_prices(spark, src, out, ck)
    q.awaitTermination(300)
    assert q.exception() is None, q.exception()
    res = spark.read.parquet(out).toPandas()
    assert sorted(res["sku_id"]) == ["A", "B"]
    assert res["opt_price"].notna().all()

    # a later file of one series: its row is renewed, the other's carried over
    later = [("A", d, 12.0, 80.0, 6.0) for d in pd.date_range("2023-03-06", periods=4, freq="7D").date]
    spark.createDataFrame(later, SALES_SCHEMA).write.mode("append").parquet(src)
    q = refresh_optimal_prices(spark, src, out, ck)
    q.awaitTermination(300)
    assert q.exception() is None, q.exception()
    new = spark.read.parquet(out).toPandas().set_index("sku_id")
    old = res.set_index("sku_id")
    assert sorted(new.index) == ["A", "B"]
    assert new.loc["B", "opt_price"] == old.loc["B", "opt_price"] and new.loc["A", "p_base"] != old.loc["A", "p_base"]
