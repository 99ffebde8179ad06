"""Keyed state in batch form: current prices with change history, price points, catalogue, snapshots, branches.

Each takes the old state and what arrived and returns the new state or the rows to append; writing is the caller's. All
are full-outer, left or anti joins on the key, so a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.values import cents, product_key
from feira.operators.listing import canonical_stores, latest_prices, listed_runs
from feira.sources.domain import branches, prices, products, runs, stores, table, with_tables
from feira.sources.files import BucketTable, KeyedTable, added, new_folder, saved_in_turn

#: Superseded prices kept of a pair, the newest.
HISTORY = 20
#: Share of the known branches that a feed must have before missing ones are dropped.
LEAST_BRANCHES = 0.5


def cheapest_listing(found: DataFrame) -> DataFrame:
    """Of several listings of a product at a store in one run the cheapest; the first of equal ones."""
    row = F.struct("price", "id", "regular_price", "offer", "scraped_at")
    return found.groupBy("product_id", "store_id").agg(F.min(row).alias("r")).select("product_id", "store_id", "r.*")


def price_upsert(current: DataFrame, found: DataFrame) -> DataFrame:
    """New state (product_id, store_id, price, seen_at, history): ``found`` replaces the price; a price that changed goes
    to the history, which keeps the newest HISTORY; an unchanged one is only seen again."""
    key = ["product_id", "store_id"]
    new = found.select(*key, F.col("price").alias("new_price"), F.col("scraped_at").alias("new_seen"))
    both = current.join(new, key, "full_outer")
    changed = F.col("price").isNotNull() & F.col("new_price").isNotNull() & (cents(F.col("price")) != cents(F.col("new_price")))
    old = F.coalesce("history", F.array().cast("array<struct<price_cents:int,observed_at:timestamp>>"))
    entry = F.struct(cents(F.col("price")).alias("price_cents"), F.col("seen_at").alias("observed_at"))
    longer = F.concat(old, F.array(entry))
    history = F.when(changed, F.slice(longer, F.greatest(F.lit(1), F.size(longer) - HISTORY + 1), HISTORY)).otherwise(old)
    return both.select(*key, F.coalesce("new_price", "price").alias("price"), F.coalesce("new_seen", "seen_at").alias("seen_at"), history.alias("history"))


def change_points(series: DataFrame) -> DataFrame:
    """Rows whose price differs from the one before them in their series (product_id, store_id by time)."""
    order = Window.partitionBy("product_id", "store_id").orderBy("scraped_at", "id")
    before = F.lag("price").over(order)
    return series.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("price"))).drop("before")


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def points_plan(series: DataFrame, known: DataFrame) -> DataFrame:
    """Points to send: archived ones newer than the last known, and the current price if it differs from the last sent.

    series: product_key, store, observed_at, cents, is_current. known: product_key, store, last_seen, last_cents.
    """
    key = ["product_key", "store"]
    own = series.join(known, key, "left")
    fresh = own.filter(~F.col("is_current") & (F.col("last_seen").isNull() | (F.col("observed_at") > F.col("last_seen"))))
    fresh = fresh.select(*key, "observed_at", "cents").distinct()
    sent = fresh.groupBy(*key).agg(F.max_by("cents", F.struct("observed_at", "cents")).alias("sent"))
    now = own.filter("is_current").join(sent, key, "left")
    now = now.filter(~F.coalesce("sent", "last_cents").eqNullSafe(F.col("cents"))).select(*key, "observed_at", "cents")
    return fresh.unionByName(now)


def catalogue_collect(product: DataFrame, price: DataFrame) -> DataFrame:
    """A row for each product_key: first non-empty fields by id, first and last time seen."""
    p = product.withColumn("product_key", product_key(F.col("name"))).join(price.groupBy(F.col("product_id").alias("id")).agg(F.min("scraped_at").alias("a"), F.max("scraped_at").alias("b")), "id", "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return p.groupBy("product_key").agg(F.min_by("name", "id").alias("name"), first("brand"), first("gtin"), first("image_url"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))


def catalogue_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names overwrite; brand, gtin and image are filled once and never erased; the time seen only widens."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.product_key") == F.col("n.product_key"), "full_outer")
    return both.select(
        F.coalesce("n.product_key", "o.product_key").alias("product_key"),
        F.coalesce("n.name", "o.name").alias("name"),
        *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("brand", "gtin", "image_url")],
        F.least("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
    )


def catalogue_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of rows that are new or differ: null never counts, first_seen only if earlier, last_seen only if a day later."""
    o, n = old.alias("o"), new.alias("n")
    both = n.join(o, F.col("o.product_key") == F.col("n.product_key"), "left")
    differs = lambda c: F.col(f"n.{c}").isNotNull() & ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    later = F.col("n.last_seen") > F.col("o.last_seen") + F.expr("interval 24 hours")
    any_ = F.col("o.product_key").isNull() | differs("name") | differs("brand") | differs("gtin") | differs("image_url") | (F.col("n.first_seen") < F.col("o.first_seen")) | later
    return both.filter(any_).select("n.product_key")


def expire_deals(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Deals that an offers-only run no longer has go back to the regular price."""
    own = current.join(seen.select("product_id", "store_id", F.lit(True).alias("seen")).distinct(), ["product_id", "store_id"], "left")
    gone = F.col("seen").isNull() & F.coalesce(F.col("regular_price") > F.col("price"), F.lit(False))
    return own.select("id", F.when(gone, F.col("regular_price")).otherwise(F.col("price")).alias("price"), F.when(~gone, F.col("offer")).alias("offer"))


def overlay_run(full: DataFrame, offers: DataFrame) -> DataFrame:
    """An offers-only run laid over the last full one: its rows win by key."""
    key = ["product_id", "store_id"]
    return full.join(offers.select(*key), key, "left_anti").unionByName(offers)


def branch_sync(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known branches after a feed: found ones are saved; missing ones go only if the feed has half the known or more."""
    key = ["chain", "external_id"]
    enough = known.groupBy("chain").agg(F.count("*").alias("k")).join(found.groupBy("chain").agg(F.count("*").alias("f")), "chain", "left")
    enough = enough.select("chain", (F.coalesce("f", F.lit(0)) >= LEAST_BRANCHES * F.col("k")).alias("drop_missing"))
    gone = known.join(found.select(*key), key, "left_anti").join(enough, "chain").filter("not drop_missing").select(*key, "name")
    return found.select(*key, "name").unionByName(gone)


def append_new(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` not yet there by ``key``, each once."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def publish(snapshots: DataFrame, new: DataFrame, keep: int = 5) -> DataFrame:
    """Snapshots after ``new`` (one row: id, etag): appended unless its etag equals the newest; the newest ``keep`` stay."""
    last = snapshots.agg(F.max_by("etag", "id").alias("last"))
    fresh = new.join(last, ~F.col("etag").eqNullSafe(F.col("last"))).drop("last")
    return snapshots.unionByName(fresh).orderBy(F.desc("id")).limit(keep)


_SPLIT = "1999-01-01"


def _halves(s, d):
    p = prices(s, d)
    return p.filter(F.col("scraped_at") < _SPLIT), p.filter(F.col("scraped_at") >= _SPLIT)


def _state(p):
    last = p.groupBy("product_id", "store_id").agg(F.max_by(F.struct("price", "scraped_at"), F.struct("scraped_at", "id")).alias("r"))
    return last.select("product_id", "store_id", F.col("r.price").alias("price"), F.col("r.scraped_at").alias("seen_at"), F.array().cast("array<struct<price_cents:int,observed_at:timestamp>>").alias("history"))


def _q_upsert(s, d):
    old, new = _halves(s, d)
    out = price_upsert(_state(old), cheapest_listing(new))
    return out.select("product_id", "store_id", "price", "seen_at", F.size("history").alias("changes"))


def _q_cheapest(s, d):
    return cheapest_listing(prices(s, d)).select("product_id", "store_id", "id", "price")


def _series(s, d):
    p = prices(s, d).join(canonical_stores(stores(s, d)).select(F.col("id").alias("store_id"), F.col("name").alias("store")), "store_id")
    p = p.join(products(s, d).select(F.col("id").alias("product_id"), product_key(F.col("name")).alias("product_key")), "product_id")
    return p.select("product_key", "store", F.col("scraped_at").alias("observed_at"), cents(F.col("price")).alias("cents"), "id")


def _q_points(s, d):
    all_ = _series(s, d)
    known = all_.filter(F.col("observed_at") < _SPLIT).groupBy("product_key", "store").agg(F.max_by(F.struct("observed_at", "cents"), F.struct("observed_at", "id")).alias("r"))
    known = known.select("product_key", "store", F.col("r.observed_at").alias("last_seen"), F.col("r.cents").alias("last_cents"))
    last = Window.partitionBy("product_key", "store").orderBy(F.desc("observed_at"), F.desc("id"))
    series = all_.withColumn("is_current", F.row_number().over(last) == 1).drop("id")
    return points_plan(series, known)


def _q_known(s, d):
    return newest(_series(s, d), ["product_key", "store"], [F.desc("observed_at"), F.desc("id")], 1).select("product_key", "store", "observed_at", "cents")


def _catalogues(s, d):
    old, new = _halves(s, d)
    p = products(s, d)
    return catalogue_collect(p.filter("id % 3 <> 0"), old), catalogue_collect(p, new)


def _q_backfill(s, d):
    return catalogue_upsert(*_catalogues(s, d)).select("product_key", "brand", "gtin", "image_url")


def _q_expire(s, d):
    old, new = _halves(s, d)
    return expire_deals(old, new)


def _q_overlay(s, d):
    old, new = _halves(s, d)
    pick = ["product_id", "store_id", "id", "price"]
    return overlay_run(cheapest_listing(old).select(*pick), cheapest_listing(new).select(*pick))


def _q_branches(s, d):
    b = branches(s, d)
    return branch_sync(b.filter("id % 2 = 0"), b.filter("id % 3 = 0 and chain <> 'Chain 1' or id % 30 = 0"))


def _snapshots(s, d):
    return table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").cast("long").alias("id")).agg(F.md5(F.count("*").cast("string")).alias("etag"))


def _q_current(s, d):
    own = latest_prices(prices(s, d), stores(s, d), listed_runs(runs(s, d)))
    named = own.join(products(s, d).select(F.col("id").alias("product_id"), product_key(F.col("name")).alias("product_key")), "product_id")
    return named.groupBy("product_key", "retailer_name").agg(F.max_by("price", "id").alias("price"), F.max("id").alias("id"))


def _q_nest(s, d):
    nested = _series(s, d).groupBy("product_key", "store").agg(F.array_sort(F.collect_list(F.struct("observed_at", "cents", "id"))).alias("points"))
    return nested.select("product_key", "store", F.array_join(F.transform("points", lambda p: p["cents"].cast("string")), ",").alias("cents"))


def _q_catalogue_table(s, d):
    """The catalogue saved, then merged with what is new."""
    old, new = _catalogues(s, d)
    table_ = KeyedTable(s, new_folder(s, "catalogue"), ["product_key"])
    table_.save(old)
    return table_.save(new, catalogue_upsert)


def _q_price_table(s, d):
    """The state of the older half of the prices, then the newer half's cheapest listings."""
    old, new = _halves(s, d)
    table_ = BucketTable(s, new_folder(s, "price-state"), ["product_id", "store_id"])
    table_.save(_state(old))
    out = saved_in_turn(table_, [cheapest_listing(new)], lambda had, found: price_upsert(had, found))
    return out.select("product_id", "store_id", "price", "seen_at", F.size("history").alias("changes"))


def _q_added(key: list[str]):
    """Price rows by ``key``: those before the split, then those of a year before it and after."""

    def query(s, d):
        first = prices(s, d).groupBy(*key).agg(F.min("price").alias("price")) if "price" not in key else prices(s, d).select(*key).distinct()
        both = [first.filter(F.col("scraped_at") < _SPLIT), first.filter(F.col("scraped_at") >= "1998-01-01")]
        return saved_in_turn(BucketTable(s, new_folder(s, "price-rows"), key), both, added(key)).select("product_id", "store_id", "scraped_at", "price")

    return query


def _q_snapshot_table(s, d):
    """All but the last three snapshots, then those one by one; the newest five stay, an unchanged one isn't added."""
    all_ = _snapshots(s, d)
    last = [r.id for r in all_.orderBy(F.desc("id")).limit(3).collect()]
    table_ = KeyedTable(s, new_folder(s, "snapshots"), ["id"])
    table_.save(all_.filter(~F.col("id").isin(last)).orderBy(F.desc("id")).limit(5))
    return saved_in_turn(table_, [all_.filter(F.col("id") == i) for i in sorted(last)], publish)


def _q_current_table(s, d):
    """The current prices of half of the products, replaced by those of all; a replacement without rows is refused."""
    now = _q_current(s, d)
    table_ = KeyedTable(s, new_folder(s, "current-prices"), ["product_key", "retailer_name"])
    return saved_in_turn(table_, [now.filter("id % 2 = 0"), now], lambda had, found: found)


QUERIES = {
    "st_price_upsert": _q_upsert,
    "snk_price_upsert": _q_price_table,
    "ag_cheapest_listing": _q_cheapest,
    "win_change_points": lambda s, d: change_points(prices(s, d)).select("id", "price"),
    "win_history_cap": lambda s, d: newest(change_points(prices(s, d)), ["product_id"], [F.desc("scraped_at"), F.desc("id")], HISTORY).select("product_id", "id"),
    "win_known_points": _q_known,
    "st_price_points_plan": _q_points,
    "snk_price_points": _q_added(["product_id", "store_id", "scraped_at"]),
    "snk_observations": _q_added(["product_id", "store_id", "scraped_at", "price"]),
    "st_observation_dedup": lambda s, d: prices(s, d).dropDuplicates(["product_id", "store_id", "scraped_at", "price"]).select("product_id", "store_id", "scraped_at", "price"),
    "ag_catalogue_collect": lambda s, d: catalogue_collect(products(s, d), prices(s, d)),
    "snk_catalogue_upsert": _q_catalogue_table,
    "st_backfill_only": _q_backfill,
    "st_catalogue_plan": lambda s, d: catalogue_plan(*_catalogues(s, d)),
    "win_expire_deals": _q_expire,
    "st_overlay_run": _q_overlay,
    "st_branch_sync": _q_branches,
    "snk_snapshot_publish": _q_snapshot_table,
    "win_keep_newest": lambda s, d: _snapshots(s, d).orderBy(F.desc("id")).limit(5),
    "src_latest_snapshot": lambda s, d: _snapshots(s, d).orderBy(F.desc("id")).limit(1),
    "snk_current_prices": _q_current_table,
    "ag_listing_collect": _q_current,
    "ag_price_history_nest": _q_nest,
    "jn_known_anti": lambda s, d: products(s, d).join(_halves(s, d)[0].filter("store_id = 1").select(F.col("product_id").alias("id")), "id", "left_anti").select("id"),
}

_OLD, _NEW = f"scraped_at < TIMESTAMP '{_SPLIT}'", f"scraped_at >= TIMESTAMP '{_SPLIT}'"
_SERIES = """WITH ser AS (SELECT md5(lower(d.name)) AS product_key, s.name AS store, p.scraped_at AS observed_at, round_even(p.price * 100, 0)::INT AS cents, p.id
  FROM prices p JOIN stores s ON s.id = p.store_id JOIN products d ON d.id = p.product_id)"""


def _collect(name: str, product: str, where: str) -> str:
    pick = lambda c: f"arg_min({c}, id) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    return f"""{name} AS (SELECT md5(lower(name)) AS product_key, arg_min(name, id) AS name, {pick('brand')}, {pick('gtin')}, {pick('image_url')}, min(a) AS first_seen, max(b) AS last_seen
      FROM products d LEFT JOIN (SELECT product_id, min(scraped_at) AS a, max(scraped_at) AS b FROM prices WHERE {where} GROUP BY 1) ON product_id = d.id WHERE {product} GROUP BY 1)"""


_CATS = f"WITH {_collect('o', 'id % 3 <> 0', _OLD)}, {_collect('n', 'true', _NEW)}"
_UPS = f"{_CATS} SELECT coalesce(n.product_key, o.product_key) AS product_key, coalesce(n.name, o.name) AS name, coalesce(o.brand, n.brand) AS brand, coalesce(o.gtin, n.gtin) AS gtin, coalesce(o.image_url, n.image_url) AS image_url, least(o.first_seen, n.first_seen) AS first_seen, greatest(o.last_seen, n.last_seen) AS last_seen FROM o FULL JOIN n ON o.product_key = n.product_key"
_UPSERT = f"""WITH o AS (SELECT product_id, store_id, arg_max(price, (scraped_at, id)) AS price, max(scraped_at) AS seen FROM prices WHERE {_OLD} GROUP BY ALL),
  n AS (SELECT product_id, store_id, arg_min(price, (price, id)) AS price, arg_min(scraped_at, (price, id)) AS seen FROM prices WHERE {_NEW} GROUP BY ALL)
  SELECT coalesce(n.product_id, o.product_id) AS product_id, coalesce(n.store_id, o.store_id) AS store_id, coalesce(n.price, o.price) AS price, coalesce(n.seen, o.seen) AS seen_at,
  CASE WHEN coalesce(round_even(n.price * 100, 0) <> round_even(o.price * 100, 0), false) THEN 1 ELSE 0 END AS changes FROM o FULL JOIN n ON o.product_id = n.product_id AND o.store_id = n.store_id"""
_CHANGES = "SELECT * FROM prices WINDOW w AS (PARTITION BY product_id, store_id ORDER BY scraped_at, id) QUALIFY lag(price) OVER w IS NULL OR lag(price) OVER w <> price"
_SNAP = "SELECT strftime(o_orderdate, '%Y%m')::BIGINT AS id, md5(count(*)::VARCHAR) AS etag FROM orders GROUP BY 1"
_CURRENT = """WITH {0} SELECT md5(lower(d.name)) AS product_key, retailer_name, arg_max(l.price, l.id) AS price, max(l.id) AS id FROM latest l JOIN products d ON d.id = l.product_id GROUP BY ALL"""
_PSPR = ("products", "stores", "prices", "runs")


def _current_sql() -> str:
    from feira.operators.listing import CANON, LATEST, LISTED, ON_LIST

    return with_tables(_CURRENT.format(f"{CANON}, {LISTED}, {ON_LIST}, {LATEST}"), *_PSPR)


ORACLE_SQL = {
    "st_price_upsert": with_tables(_UPSERT, "prices"),
    "snk_price_upsert": with_tables(_UPSERT, "prices"),
    "ag_cheapest_listing": with_tables("SELECT product_id, store_id, arg_min(id, (price, id)) AS id, min(price) AS price FROM prices GROUP BY ALL", "prices"),
    "win_change_points": with_tables(f"SELECT id, price FROM ({_CHANGES})", "prices"),
    "win_history_cap": with_tables(f"SELECT product_id, id FROM ({_CHANGES}) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, id DESC) <= {HISTORY}", "prices"),
    "win_known_points": with_tables(f"{_SERIES} SELECT product_key, store, observed_at, cents FROM ser QUALIFY row_number() OVER (PARTITION BY product_key, store ORDER BY observed_at DESC, id DESC) = 1", *_PSPR),
    "st_price_points_plan": with_tables(f"""{_SERIES}, kn AS (SELECT product_key, store, max(observed_at) AS last_seen, arg_max(cents, (observed_at, id)) AS last_cents FROM ser WHERE observed_at < TIMESTAMP '{_SPLIT}' GROUP BY ALL),
        cur AS (SELECT *, row_number() OVER (PARTITION BY product_key, store ORDER BY observed_at DESC, id DESC) = 1 AS c FROM ser),
        fresh AS (SELECT DISTINCT product_key, store, observed_at, cents FROM cur LEFT JOIN kn USING (product_key, store) WHERE NOT c AND (last_seen IS NULL OR observed_at > last_seen)),
        sent AS (SELECT product_key, store, arg_max(cents, (observed_at, cents)) AS sent FROM fresh GROUP BY ALL)
        SELECT * FROM fresh UNION ALL SELECT product_key, store, observed_at, cents FROM cur LEFT JOIN kn USING (product_key, store) LEFT JOIN sent USING (product_key, store) WHERE c AND coalesce(sent, last_cents) IS DISTINCT FROM cents""", *_PSPR),
    "snk_price_points": with_tables("SELECT product_id, store_id, scraped_at, min(price) AS price FROM prices GROUP BY 1, 2, 3", "prices"),
    "snk_observations": with_tables("SELECT DISTINCT product_id, store_id, scraped_at, price FROM prices", "prices"),
    "st_observation_dedup": with_tables("SELECT DISTINCT product_id, store_id, scraped_at, price FROM prices", "prices"),
    "ag_catalogue_collect": with_tables(f"WITH {_collect('c', 'true', 'true')} SELECT * FROM c", *_PSPR),
    "snk_catalogue_upsert": with_tables(_UPS, *_PSPR),
    "st_backfill_only": with_tables(f"SELECT product_key, brand, gtin, image_url FROM ({_UPS})", *_PSPR),
    "st_catalogue_plan": with_tables(f"""{_CATS} SELECT n.product_key FROM n LEFT JOIN o USING (product_key) WHERE o.product_key IS NULL OR n.name IS DISTINCT FROM o.name OR (n.brand IS NOT NULL AND n.brand IS DISTINCT FROM o.brand)
        OR (n.gtin IS NOT NULL AND n.gtin IS DISTINCT FROM o.gtin) OR (n.image_url IS NOT NULL AND n.image_url IS DISTINCT FROM o.image_url) OR n.first_seen < o.first_seen OR n.last_seen > o.last_seen + INTERVAL 24 HOUR""", *_PSPR),
    "win_expire_deals": with_tables(f"""SELECT id, CASE WHEN g THEN regular_price ELSE price END AS price, CASE WHEN NOT g THEN offer END AS offer FROM (SELECT p.*, coalesce(regular_price > price, false) AND (product_id, store_id) NOT IN
        (SELECT (product_id, store_id) FROM prices WHERE {_NEW}) AS g FROM prices p WHERE {_OLD})""", "prices"),
    "st_overlay_run": with_tables(f"""SELECT product_id, store_id, arg_min(id, (price, id)) AS id, min(price) AS price FROM (SELECT *, {_NEW} AS n, max({_NEW}) OVER (PARTITION BY product_id, store_id) AS has FROM prices) WHERE n = has GROUP BY product_id, store_id""", "prices"),
    "st_branch_sync": with_tables("""WITH k AS (SELECT * FROM branches WHERE id % 2 = 0), f AS (SELECT * FROM branches WHERE (id % 3 = 0 AND chain <> 'Chain 1') OR id % 30 = 0),
        e AS (SELECT chain, count(*) AS n, (SELECT count(*) FROM f WHERE f.chain = k.chain) AS m FROM k GROUP BY chain)
        SELECT chain, external_id, name FROM f UNION ALL SELECT chain, external_id, name FROM k JOIN e USING (chain) WHERE external_id NOT IN (SELECT external_id FROM f) AND m < 0.5 * n""", "branches"),
    "snk_snapshot_publish": f"SELECT id, etag FROM (SELECT *, etag IS DISTINCT FROM lag(etag) OVER (ORDER BY id) AS changed, row_number() OVER (ORDER BY id DESC) AS place FROM ({_SNAP})) WHERE place > 3 OR changed ORDER BY id DESC LIMIT 5",
    "win_keep_newest": f"{_SNAP} ORDER BY id DESC LIMIT 5",
    "src_latest_snapshot": f"{_SNAP} ORDER BY id DESC LIMIT 1",
    "snk_current_prices": _current_sql(),
    "ag_listing_collect": _current_sql(),
    "ag_price_history_nest": with_tables(f"{_SERIES} SELECT product_key, store, string_agg(cents::VARCHAR, ',' ORDER BY observed_at, cents, id) AS cents FROM ser GROUP BY ALL", *_PSPR),
    "jn_known_anti": with_tables(f"SELECT id FROM products WHERE id NOT IN (SELECT product_id FROM prices WHERE store_id = 1 AND {_OLD})", *_PSPR),
}
