"""A whole release: judge the runs, build the list, check it, publish it, then save what hangs on it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.functions.values import product_key
from feira.operators.listing import ORACLE_SQL as LISTING_SQL
from feira.operators.listing import last_errors, latest_prices, listed_runs
from feira.operators.lookup import content_tag
from feira.operators.state import catalogue_collect, catalogue_upsert
from feira.operators.warehouse import offer_findings
from feira.plans.public import build_public, public_sql
from feira.sources.domain import prices, products, runs, stores
from feira.sources.files import KeyedTable, new_folder

REPORT = "step string, status string, rows long"


def refresh(product: DataFrame, store: DataFrame, price: DataFrame, run: DataFrame, folder: str, live: int = 0, force: bool = False) -> list[tuple[str, str, int]]:
    """(step, status, rows) of a release into the tables of ``folder``.

    An error found in the list stops the release before anything is published, unless ``force``. A list equal to the
    published one isn't published again. The price points, the catalogue and the current prices come after; one that
    fails is reported and leaves the others and the release as they are: the next release catches up.
    """
    spark = product.sparkSession
    listed = listed_runs(run)
    failed = last_errors(run, listed).filter("problem is not null").count()
    report = [("evaluate", "ok" if not failed else "warnings", failed)]
    offers, shown = build_public(product, store, price, run)
    built = f"{folder}/built/{uuid.uuid4().hex}"  # of this release: one before may still be read
    offers.write.parquet(f"{built}/offers")
    shown.write.parquet(f"{built}/products")
    offers, shown = spark.read.parquet(f"{built}/offers"), spark.read.parquet(f"{built}/products")
    n = offers.count()
    report.append(("build", "ok", n))
    errors = offer_findings(offers, shown, live).filter("level = 'error'").count()
    report.append(("validate", "ok" if not errors else "forced" if force else "blocked", errors))
    if errors and not force:
        return report
    snapshots = KeyedTable(spark, f"{folder}/snapshots", ["etag"])
    tag = content_tag(offers, ("observed_at",)).first()[0]
    before = snapshots.read()
    last = before.agg(F.max_by("etag", "id")).first()[0] if before is not None else None
    if last == tag:
        report.append(("publish", "unchanged", 0))
    else:
        at = before.agg(F.max("id")).first()[0] + 1 if before is not None else 1
        snapshots.save(spark.createDataFrame([(at, tag, n)], "id long, etag string, offers long"))
        report.append(("publish", "ok", n))
    latest = latest_prices(price, store, listed)

    def points() -> DataFrame:
        rows = price.groupBy("product_id", "store_id", "scraped_at").agg(F.min("price").alias("price"))
        return KeyedTable(spark, f"{folder}/points", ["product_id", "store_id", "scraped_at"]).save(rows)

    def catalogue() -> DataFrame:
        return KeyedTable(spark, f"{folder}/catalogue", ["product_key"]).save(catalogue_collect(product, price), catalogue_upsert)

    def current() -> DataFrame:
        named = latest.join(product.select(F.col("id").alias("product_id"), product_key(F.col("name")).alias("product_key")), "product_id")
        rows = named.groupBy("product_key", "retailer_id").agg(F.min("price").alias("price"))
        return KeyedTable(spark, f"{folder}/current", ["product_key", "retailer_id"]).save(rows)

    for name, step in (("price points", points), ("catalogue", catalogue), ("current prices", current)):
        report.append(best_effort(name, step))
    return report


def best_effort(name: str, step: Callable[[], DataFrame]) -> tuple[str, str, int]:
    try:
        return name, "ok", step().count()
    except Exception as problem:  # noqa: BLE001  a later step must not undo a release
        return name, f"failed: {type(problem).__name__}", 0


def _q_refresh(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "refresh")
    tables = products(spark, d), stores(spark, d), prices(spark, d), runs(spark, d)
    first = refresh(*tables, folder)
    return spark.createDataFrame(first, REPORT)


QUERIES = {"pipe_refresh": _q_refresh}

ORACLE_SQL = {
    "pipe_refresh": public_sql("""WITH bad AS (SELECT count(*) AS n FROM (ERRORS) WHERE problem IS NOT NULL),
        cur AS (SELECT DISTINCT md5(lower(p.name)), retailer_id FROM latest JOIN products p ON p.id = product_id)
        SELECT 'evaluate' AS step, CASE WHEN n > 0 THEN 'warnings' ELSE 'ok' END AS status, n AS rows FROM bad UNION ALL SELECT 'build', 'ok', count(*) FROM offers UNION ALL SELECT 'validate', 'ok', 0
        UNION ALL SELECT 'publish', 'ok', count(*) FROM offers UNION ALL SELECT 'price points', 'ok', count(*) FROM (SELECT DISTINCT product_id, store_id, scraped_at FROM prices)
        UNION ALL SELECT 'catalogue', 'ok', count(DISTINCT md5(lower(name))) FROM products WHERE id IN (SELECT product_id FROM prices) UNION ALL SELECT 'current prices', 'ok', count(*) FROM cur""".replace("ERRORS", LISTING_SQL["ag_error_status"])),
}
