"""What each chain lists now: canonical stores, complete runs, latest prices, run health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.sources.domain import prices, products, runs, stores, with_tables

#: A run counts as complete from this share of the usual number of items.
MIN_SHARE = 0.25
#: Older attempts that tell what is usual, and newest attempts that are looked at.
BASELINE = 6
NEWEST = 30


def canonical_stores(store: DataFrame) -> DataFrame:
    """id, retailer_id (the lowest id of the name), name."""
    first = store.groupBy("name").agg(F.min("id").alias("retailer_id"))
    return store.join(first, "name").select("id", "retailer_id", "name")


def listed_runs(run: DataFrame) -> DataFrame:
    """site_key, run_id of each site's newest run that looks complete.

    Failed attempts take a place among the older ones, but only successful ones tell the usual size.
    """
    newest = Window.partitionBy("site_key").orderBy(F.desc("id"))
    recent = run.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= NEWEST)
    usual = F.coalesce(F.max(F.when(F.col("success"), F.col("items_found"))).over(newest.rowsBetween(1, BASELINE)), F.lit(0))
    fit = F.col("run_id").isNotNull() & F.col("success") & (F.col("items_found") > 0) & (F.col("items_found") >= MIN_SHARE * F.col("usual"))
    return recent.withColumn("usual", usual).filter(fit).groupBy("site_key").agg(F.max_by("run_id", "id").alias("run_id"))


def listed_prices(price: DataFrame, store: DataFrame, listed: DataFrame) -> DataFrame:
    """The price rows on each chain's current list, with retailer_id and retailer_name."""
    own = price.join(canonical_stores(store).withColumnsRenamed({"id": "store_id", "name": "retailer_name"}), "store_id")
    own = own.join(listed.select(F.col("site_key").alias("retailer_name"), F.col("run_id").alias("listed_run")), "retailer_name", "left")
    return own.filter(F.col("listed_run").isNull() | (F.col("run_id") == F.col("listed_run"))).drop("listed_run")


def latest_prices(price: DataFrame, store: DataFrame, listed: DataFrame) -> DataFrame:
    """The row of highest id for each product and retailer on the current lists."""
    own = listed_prices(price, store, listed)
    row = F.struct(*[c for c in own.columns if c not in ("product_id", "retailer_id")])
    return own.groupBy("product_id", "retailer_id").agg(F.max_by(row, "id").alias("r")).select("product_id", "retailer_id", "r.*")


def last_errors(run: DataFrame, listed: DataFrame) -> DataFrame:
    """site_key, problem of its latest attempt: failed, empty, set aside for an older run, or null."""
    last = run.groupBy("site_key").agg(F.max_by(F.struct("success", "error", "items_found", "run_id"), "id").alias("r"))
    last = last.select("site_key", "r.*").join(listed.select("site_key", F.col("run_id").alias("listed_run")), "site_key", "left")
    problem = (
        F.when(~F.col("success"), F.coalesce("error", F.lit("failed")))
        .when(F.col("items_found") == 0, "empty")
        .when(F.col("run_id").isNotNull() & F.col("listed_run").isNotNull() & (F.col("run_id") != F.col("listed_run")), "set aside")
    )
    return last.select("site_key", problem.alias("problem"))


def run_evaluation(run: DataFrame, listed: DataFrame, since_id: int) -> DataFrame:
    """site_key, outcome of the latest attempt after ``since_id``: ok, failed, empty, set aside or no result."""
    sites = run.select("site_key").distinct()
    last = run.filter(F.col("id") > since_id).groupBy("site_key").agg(F.max_by(F.struct("success", "items_found", "run_id"), "id").alias("r"))
    all_ = sites.join(last, "site_key", "left").join(listed.select("site_key", F.col("run_id").alias("listed_run")), "site_key", "left")
    outcome = (
        F.when(F.col("r").isNull(), "no result")
        .when(~F.col("r.success"), "failed")
        .when(F.col("r.items_found") == 0, "empty")
        .when(F.col("r.run_id").eqNullSafe(F.col("listed_run")), "ok")
        .otherwise("set aside")
    )
    return all_.select("site_key", outcome.alias("outcome"))


def health(run: DataFrame, window: int = 100) -> DataFrame:
    """The latest attempt of each site among the newest ``window`` attempts."""
    newest = run.orderBy(F.desc("id")).limit(window)
    return newest.groupBy("site_key").agg(F.max("id").alias("id"), F.max_by("success", "id").alias("success"), F.max_by("items_found", "id").alias("items_found"), F.count("*").alias("attempts"))


def latest_per_chain(product: DataFrame, price: DataFrame, store: DataFrame) -> DataFrame:
    """Every product with its latest price at each chain; products without any price once, with nulls."""
    canon = canonical_stores(store).withColumnsRenamed({"id": "store_id", "name": "chain"})
    own = price.join(canon, "store_id").groupBy("product_id", "chain").agg(F.max_by("price", F.struct("scraped_at", "id")).alias("price"))
    return product.select("id").join(own.withColumnRenamed("product_id", "id"), "id", "left")


def _base(spark, d):
    return prices(spark, d), stores(spark, d), listed_runs(runs(spark, d))


def _q_listed_prices(spark, d):
    return listed_prices(*_base(spark, d)).select("id", "product_id", "retailer_id", "retailer_name")


def _q_latest(spark, d):
    return latest_prices(*_base(spark, d)).select("product_id", "retailer_id", "id", "price")


def _q_dims(spark, d):
    p = prices(spark, d).filter("price > 0").join(canonical_stores(stores(spark, d)).withColumnsRenamed({"id": "store_id", "name": "chain"}), "store_id")
    return p.join(products(spark, d).select(F.col("id").alias("product_id"), "name"), "product_id").select("id", "name", "chain", "price")


def _q_guard(spark, d):
    p = prices(spark, d)
    row = Window.partitionBy("product_id", "store_id").orderBy(F.desc("scraped_at"), F.desc("id"))
    return p.withColumn("rn", F.row_number().over(row)).filter("rn = 1").select("product_id", "store_id", "id", "price")


QUERIES = {
    "jn_store_canonical": lambda s, d: canonical_stores(stores(s, d)),
    "win_listed_run": lambda s, d: listed_runs(runs(s, d)),
    "jn_listed_run": _q_listed_prices,
    "win_latest_price": _q_latest,
    "jn_price_dims": _q_dims,
    "win_rn_guard": _q_guard,
    "jn_latest_price_lateral": lambda s, d: latest_per_chain(products(s, d), prices(s, d), stores(s, d)),
    "jn_exists": lambda s, d: products(s, d).join(prices(s, d).select(F.col("product_id").alias("id")), "id", "left_semi").select("id"),
    "ag_error_status": lambda s, d: last_errors(runs(s, d), listed_runs(runs(s, d))),
    "dq_run_evaluation": lambda s, d: run_evaluation(runs(s, d), listed_runs(runs(s, d)), 900),
    "ag_health": lambda s, d: health(runs(s, d)),
}

CANON = "canon AS (SELECT id, min(id) OVER (PARTITION BY name) AS retailer_id, name FROM stores)"
LISTED = f"""listed AS (SELECT site_key, max_by(run_id, id) AS run_id FROM (SELECT *, coalesce(max(CASE WHEN success THEN items_found END) OVER
    (PARTITION BY site_key ORDER BY id DESC ROWS BETWEEN 1 FOLLOWING AND {BASELINE} FOLLOWING), 0) AS usual FROM
    (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY id DESC) <= {NEWEST}))
    WHERE run_id IS NOT NULL AND success AND items_found > 0 AND items_found >= {MIN_SHARE} * usual GROUP BY site_key)"""
ON_LIST = """onlist AS (SELECT p.*, c.retailer_id, c.name AS retailer_name FROM prices p JOIN canon c ON c.id = p.store_id
    LEFT JOIN listed l ON l.site_key = c.name WHERE l.run_id IS NULL OR l.run_id = p.run_id)"""
LATEST = "latest AS (SELECT * FROM onlist QUALIFY row_number() OVER (PARTITION BY product_id, retailer_id ORDER BY id DESC) = 1)"
_ALL = ("products", "stores", "prices", "runs")

ORACLE_SQL = {
    "jn_store_canonical": with_tables(f"WITH {CANON} SELECT * FROM canon", "stores"),
    "win_listed_run": with_tables(f"WITH {LISTED} SELECT * FROM listed", "runs"),
    "jn_listed_run": with_tables(f"WITH {CANON}, {LISTED}, {ON_LIST} SELECT id, product_id, retailer_id, retailer_name FROM onlist", *_ALL),
    "win_latest_price": with_tables(f"WITH {CANON}, {LISTED}, {ON_LIST}, {LATEST} SELECT product_id, retailer_id, id, price FROM latest", *_ALL),
    "jn_price_dims": with_tables(f"WITH {CANON} SELECT p.id, d.name, c.name AS chain, p.price FROM prices p JOIN products d ON d.id = p.product_id JOIN canon c ON c.id = p.store_id WHERE p.price > 0", *_ALL),
    "win_rn_guard": with_tables("SELECT product_id, store_id, id, price FROM prices QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY scraped_at DESC, id DESC) = 1", "prices"),
    "jn_latest_price_lateral": with_tables("SELECT p.id, c.chain, c.price FROM products p LEFT JOIN LATERAL (SELECT s.name AS chain, arg_max(r.price, (r.scraped_at, r.id)) AS price FROM prices r JOIN stores s ON s.id = r.store_id WHERE r.product_id = p.id GROUP BY s.name) c ON true", *_ALL),
    "jn_exists": with_tables("SELECT id FROM products p WHERE EXISTS (SELECT 1 FROM prices r WHERE r.product_id = p.id)", *_ALL),
    "ag_error_status": with_tables(f"""WITH {LISTED}, last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY id DESC) = 1)
        SELECT site_key, CASE WHEN NOT success THEN coalesce(error, 'failed') WHEN items_found = 0 THEN 'empty' WHEN last.run_id IS NOT NULL AND l.run_id IS NOT NULL AND last.run_id <> l.run_id THEN 'set aside' END AS problem
        FROM last LEFT JOIN listed l USING (site_key)""", "runs"),
    "dq_run_evaluation": with_tables(f"""WITH {LISTED}, last AS (SELECT * FROM runs WHERE id > 900 QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY id DESC) = 1)
        SELECT s.site_key, CASE WHEN last.id IS NULL THEN 'no result' WHEN NOT success THEN 'failed' WHEN items_found = 0 THEN 'empty' WHEN last.run_id IS NOT DISTINCT FROM l.run_id THEN 'ok' ELSE 'set aside' END AS outcome
        FROM (SELECT DISTINCT site_key FROM runs) s LEFT JOIN last USING (site_key) LEFT JOIN listed l USING (site_key)""", "runs"),
    "ag_health": with_tables("""SELECT site_key, max(id) AS id, arg_max(success, id) AS success, arg_max(items_found, id) AS items_found, count(*) AS attempts
        FROM (SELECT * FROM runs ORDER BY id DESC LIMIT 100) GROUP BY site_key""", "runs"),
}
