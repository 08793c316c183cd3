"""pricefold: price-elasticity and demand analytics expressed as Spark plans.

Every operator takes and returns DataFrames that hold *all* series at once
(one row per series and week); nothing is collected per series on the driver.
"""

__version__ = "0.1.0"
