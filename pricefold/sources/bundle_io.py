"""CSV bundle source / sink in the reference's folder layout.

Layout: ``<root>/<category>/<product>/<scenario>/<table>.csv`` with the six
tables of a bundle. Writing uses ``partitionBy`` (one folder per series, all
series in one distributed write); reading uses explicit schemas and recovers
(category, product, scenario) from ``_metadata.file_path`` — no driver-side
directory walk, no schema inference.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_FILES = {
    "sales": "sales_demand", "competitor": "competitor_pricing", "promotions": "marketing_promotions",
    "inventory": "inventory_status", "lifecycle": "product_lifecycle", "sentiment": "consumer_sentiment",
}
SCHEMAS = {
    "sales_demand": "date DATE, sku_id STRING, unit_price DOUBLE, units_sold DOUBLE, cost_per_unit DOUBLE",
    "competitor_pricing": "date DATE, comp_price_avg DOUBLE, comp_price_min DOUBLE, comp_price_max DOUBLE",
    "marketing_promotions": "date DATE, is_promo INT, marketing_spend DOUBLE",
    "inventory_status": "date DATE, units_in_stock BIGINT, avg_daily_sales_14d DOUBLE",
    "product_lifecycle": "sku_id STRING, launch_date DATE, category STRING",
    "consumer_sentiment": "date DATE, cci_current DOUBLE, cci_baseline DOUBLE, google_trends_score DOUBLE",
}


def output_root(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint location the cluster names."""
    from pricefold.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.replace("file:", ""), "pricefold-out", name) if base.startswith("file:") else f"{base}/pricefold-out/{name}"


def sink_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite ``path`` with ``df`` as header CSV (``sink_csv``)."""
    w = df.write.mode("overwrite").option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_bundle(tables: dict[str, DataFrame], root: str, category: str = "tpch", scenario: str = "base") -> None:
    """Write every table of every series into <root>/<category>/<product>/<scenario>/<table>/.

    ``tables`` maps bundle keys to DataFrames carrying ``sku_id`` (the product);
    market-wide tables without ``sku_id`` are written once per product by the caller.
    """
    for key, df in tables.items():
        table = TABLE_FILES[key]
        out = df.selectExpr("*", "sku_id AS product") if "product" not in df.columns else df
        cols = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        sink_csv(out.select("product", *cols), f"{root}/{category}/_p/{scenario}/{table}", ["product"])


def scan_bundle(spark: SparkSession, root: str, table: str = "sales_demand") -> DataFrame:
    """Read one table of every bundle under ``root`` with its explicit schema and
    the (category, product, scenario) keys parsed from the file path."""
    schema = SCHEMAS[table] + ", product STRING"
    df = (spark.read.schema(schema).option("header", True).csv(f"{root}/*/_p/*/{table}")
          .selectExpr("*", "_metadata.file_path AS _path"))
    return df.selectExpr(
        "regexp_extract(_path, '/([^/]+)/_p/', 1) AS category",
        "product",
        "regexp_extract(_path, '/_p/([^/]+)/', 1) AS scenario",
        *[c.split()[0] for c in SCHEMAS[table].split(", ")])


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (category, product, scenario) series found under ``root``, sorted; from file paths, no file is opened."""
    paths = spark.read.format("binaryFile").load(f"{root}/*/_p/*/sales_demand/*").select("path")
    return paths.selectExpr(
        "regexp_extract(path, '/([^/]+)/_p/', 1) AS category",
        "url_decode(regexp_extract(path, '/product=([^/]+)/', 1)) AS product",
        "regexp_extract(path, '/_p/([^/]+)/', 1) AS scenario").distinct().orderBy("category", "product", "scenario")


# Plain folders as users hold them: <root>/<category>/<product>/<scenario>/<table>.csv
_KEYS = [f"url_decode(regexp_extract(path, '/([^/]+)/([^/]+)/([^/]+)/[^/]+[.]csv$', {i})) AS {name}" for i, name in enumerate(("category", "product", "scenario"), 1)]


def scan_folders(spark: SparkSession, root: str, table: str = "sales_demand") -> DataFrame:
    """One table of every bundle in plain folders, with its schema and (category, product, scenario).

    Columns are matched by the header's names, so their order in the files is free; invalid values become NULL.
    """
    names = [c.split() for c in SCHEMAS[table].split(", ")]
    text = spark.read.option("header", True).option("enforceSchema", False).schema(", ".join(f"{n} STRING" for n, _ in names)).csv(f"{root}/*/*/*/{table}.csv")
    keyed = text.selectExpr("*", "_metadata.file_path AS path")
    return keyed.selectExpr(*_KEYS, *[f"try_cast({n} AS {t}) AS {n}" for n, t in names])


def folder_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every bundle in plain folders and the tables it has (sorted names); a bundle without sales_demand is listed, too."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{root}/*/*/*").select("path")
    found = paths.selectExpr(*_KEYS, "regexp_extract(path, '/([^/]+)[.]csv$', 1) AS table")
    return found.groupBy("category", "product", "scenario").agg(F.sort_array(F.collect_set("table")).alias("tables")).orderBy("category", "product", "scenario")


def load_folders(spark: SparkSession, root: str) -> dict[str, DataFrame | None]:
    """The six tables of all bundles by bundle key; None for a table that no bundle has."""
    there = {t for r in folder_catalog(spark, root).selectExpr("explode(tables) AS t").distinct().collect() for t in [r["t"]]}  # six names
    return {key: scan_folders(spark, root, table) if table in there else None for key, table in TABLE_FILES.items()}


def require_sales(catalogue: DataFrame, sales: DataFrame, key: str = "product") -> DataFrame:
    """Each product of the catalogue with its number of sales rows; status MISSING rejects it (the analysis needs sales)."""
    n = sales.groupBy(key).count().withColumnRenamed("count", "n_rows")
    return catalogue.select(key).distinct().join(n, key, "left").selectExpr(
        key, "coalesce(n_rows, 0L) AS n_rows", "CASE WHEN n_rows > 0 THEN 'OK' ELSE 'MISSING' END AS status")
