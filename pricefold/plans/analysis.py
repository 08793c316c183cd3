"""The statistical analysis of every series in one plan (entry 1 of the reference).

scan → side-table joins → spike windows → re-baseline → one aggregate
(elasticity) → residuals → one aggregate (all factor moments + base state)
→ factor values. All exchanges are on the series key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pricefold.operators.factors import factor_moments, factor_table, factor_values, factor_weights
from pricefold.operators.joins import join_side_tables, present
from pricefold.operators.regress import elasticity_fit, in_sample_mape, with_residuals
from pricefold.operators.spikes import SERIES, detect_spikes
from pricefold.session import materialize
from pricefold.sources.panel import Bundle


@dataclass
class Analysis:
    spiked: DataFrame        # panel + spike columns
    fit: DataFrame           # elasticity fit per series
    panel: DataFrame         # spiked panel + residual + side tables
    factors: DataFrame       # wide factor values per series
    summary: DataFrame       # per-series summary used by projections

    def factor_table(self) -> DataFrame:
        return factor_weights(factor_table(self.fit, self.factors))


def bound_panel(bundle: Bundle, partitions: int | None = None, persist: bool = True) -> DataFrame:
    """Sales panel with every side table bound (``bind_optional``), hash-partitioned
    by series and persisted: every later window / aggregate / join keyed by
    series reuses this partitioning instead of adding an exchange."""
    panel = join_side_tables(bundle.sales, bundle)
    spark = panel.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    panel = panel.repartition(n, SERIES)
    return materialize(panel) if persist else panel


def analyse(bundle: Bundle, promo_model: str = "fit", panel: DataFrame | None = None,
            materialize_summary: bool = True) -> Analysis:
    panel = bound_panel(bundle) if panel is None else panel
    spiked = detect_spikes(panel)
    fit = elasticity_fit(spiked)
    resid = with_residuals(spiked, fit)
    moments = factor_moments(resid)
    fvals = factor_values(moments, present(bundle), promo_model)
    mape = in_sample_mape(resid)
    summary = (
        fit.selectExpr(SERIES, "elasticity AS e_base", "ci_low", "ci_high", "r2 AS e_r2",
                       "status AS elasticity_status", "n_obs")
        .join(fvals.hint("merge"), SERIES)
        .join(mape.hint("merge"), SERIES)
    )
    # One row per series, reused by every projection, curve and report: computed
    # once (it keeps the series partitioning) instead of once per consumer.
    summary = materialize(summary) if materialize_summary else summary
    return Analysis(spiked, fit, resid, fvals, summary)
