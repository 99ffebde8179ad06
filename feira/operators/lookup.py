"""Lookups and housekeeping around the list: overrides, indexes, caches, images, re-keying, contracts, small sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import clean, clean_sql
from feira.functions.values import canonical_key, cents, haversine, placeholder_host, product_key, signature
from feira.operators.listing import canonical_stores
from feira.operators.offers import dated, matches_query
from feira.operators.state import append_new
from feira.plans.public import TTL, TTL_WEEKLY, WEEKLY, public_sql, public_tables
from feira.sources.domain import NOW, branches, list_lines, prices, products, runs, stores, with_tables
from feira.sources.files import BucketTable, KeyedTable, added, new_folder, saved_in_turn

CENTER = (-3.7319, -38.5267)


def override_codes(product: DataFrame, overrides: DataFrame) -> DataFrame:
    """id, code, confidence: a manual code by folded name wins with confidence 1; else what the product has."""
    by = overrides.select(clean("name").alias("folded"), F.col("code").alias("manual"))
    own = product.withColumn("folded", clean("name")).join(by, "folded", "left")
    return own.select("id", F.coalesce("manual", "code").alias("code"), F.when(F.col("manual").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"))


def index_lookup(shown: DataFrame, index: DataFrame) -> DataFrame:
    """Published products with code and department of the index by canonical key; missing ones null."""
    return shown.join(index, "identity", "left").select("id", "code", "department")


def cache_lookup(wanted: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of signatures in an answer cache (sig, version, answer)."""
    own = cache.filter(F.col("version") == version).select("sig", "answer")
    return wanted.join(own, "sig"), wanted.join(own, "sig", "left_anti")


def rekey(rows: DataFrame, order: str = "updated_at") -> DataFrame:
    """One row for each canonical key, the one updated last."""
    last = Window.partitionBy("key").orderBy(F.desc(order), F.desc("id"))
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")


def content_tag(rows: DataFrame, volatile: tuple[str, ...]) -> DataFrame:
    """One row (etag): a hash of the rows without volatile columns, whatever their order.

    Row hashes are summed in two parts, so nothing is collected; equal content gives an equal tag.
    """
    kept = sorted(c for c in rows.columns if c not in volatile)
    h = rows.select(F.sha2(F.to_json(F.struct(*kept)), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", i, 12), 16, 10).cast("decimal(38,0)"))
    return h.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1).cast("string"), part(13).cast("string")), 256).alias("etag"))


def stale_urls(urls: DataFrame, checked: DataFrame, now: Column, limit: int) -> DataFrame:
    """URLs to probe: never checked, or older than 7 days (one day when unsure); only http ones, each once."""
    age = F.unix_timestamp(now) - F.unix_timestamp("checked_at")
    due = F.col("checked_at").isNull() | (age > F.when(F.col("status") == "unsure", 86_400).otherwise(7 * 86_400))
    own = urls.filter(F.col("url").rlike("^https?://")).distinct().join(checked, "url", "left").filter(due)
    return own.select("url").orderBy("url").limit(limit)


def image_fallback(product: DataFrame, mirror: DataFrame) -> DataFrame:
    """id, image: a dead or missing URL gives way to the mirrored copy, if there is one."""
    own = product.join(mirror, "id", "left")
    alive = F.col("image_url").isNotNull() & ~placeholder_host(F.col("image_url"))
    return own.select("id", F.when(alive, F.col("image_url")).otherwise(F.coalesce(F.concat(F.lit("/"), "path"), "image_url")).alias("image"))


def catalogue_merge(found: DataFrame, offers: DataFrame) -> DataFrame:
    """Search results whose price series the published list doesn't have."""
    return found.join(offers.select("price_key").distinct(), "price_key", "left_anti")


def catalogue_search(product: DataFrame, price: DataFrame, store: DataFrame, query: str, limit: int) -> DataFrame:
    """product_key, name, chains, low: products that match with the lowest current price of each chain nested."""
    named = product.filter(matches_query("name", query)).select(F.col("id").alias("product_id"), "name", product_key(F.col("name")).alias("product_key"))
    chain = canonical_stores(store).select(F.col("id").alias("store_id"), F.col("name").alias("chain"))
    own = price.join(named, "product_id").join(chain, "store_id").groupBy("product_key", "chain").agg(F.min("name").alias("name"), F.min("price").alias("price"))
    by = own.groupBy("product_key").agg(F.min("name").alias("name"), F.array_sort(F.collect_list(F.struct("chain", "price"))).alias("p"))
    first = query.split()[0]
    best = by.orderBy(F.when(clean("name").startswith(first), 0).otherwise(1), F.length("name"), "name", "product_key").limit(limit)
    return best.select("product_key", "name", F.array_join(F.transform("p", lambda x: x["chain"]), "|").alias("chains"), F.array_min(F.transform("p", lambda x: x["price"])).alias("low"))


def offer_contract(offers: DataFrame, now: Column) -> DataFrame:
    """id, rule for each broken rule of an offer."""
    rules = F.array(
        F.when(F.col("price_cents").isNull() & (F.col("availability") != "unavailable"), "price missing"),
        F.when(F.col("price_cents") <= 0, "price"),
        F.when((F.col("channel") == "flyer") & (F.col("valid_from").isNull() | F.col("valid_until").isNull()), "flyer dates"),
        F.when(F.col("valid_from") >= F.col("valid_until"), "dates reversed"),
        F.when(F.col("observed_at") > now + F.expr("interval 60 seconds"), "future"),
    )
    return offers.select("id", F.explode(F.array_compact(rules)).alias("rule"))


def exact_matches(shown: DataFrame) -> DataFrame:
    """group sizes of products with an equal signature; different barcodes are different products."""
    sig = F.concat_ws("|", clean("name"), clean("brand"), clean("category"), F.col("amount").cast("string"), "unit", F.col("pack_count").cast("string"), F.coalesce("gtin", F.lit("")))
    return shown.groupBy(sig.alias("sig")).agg(F.count("*").alias("members"), F.min("id").alias("first_id"))


def valid_lines(lines: DataFrame, most: int = 200) -> DataFrame:
    """Lines of lists with a quantity of 1 to 999, at most ``most`` of a list (the feature's own limit)."""
    rank = Window.partitionBy("list_id").orderBy("product_id")
    return lines.filter(F.col("quantity").between(1, 999)).withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= most).drop("n")


def branches_in_region(branch: DataFrame, state: str, lat: float, lon: float, km: float) -> DataFrame:
    """Branches whose address ends in ``state`` and that lie within ``km`` of the centre."""
    ends = F.regexp_extract("address", "- ([A-Z]{2})$", 1)
    return branch.filter(((ends == "") | (ends == state)) & (haversine(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude")) <= km))


def score_gate(scores: DataFrame, least: float = 0.8) -> DataFrame:
    """id of rows whose every score in the map ``scores`` reaches ``least``."""
    return scores.filter(F.forall(F.map_values("scores"), lambda x: x >= least)).select("id")


def step_line(points: DataFrame, times: DataFrame) -> DataFrame:
    """For each series and asked time the last price at or before it (as-of): one sort over the union, no range join."""
    a = points.select("key", F.col("at"), F.col("cents"), F.lit(0).alias("asked"))
    b = times.select("key", "at", F.lit(None).cast("int").alias("cents"), F.lit(1).alias("asked"))
    line = Window.partitionBy("key").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("cents", F.last("cents", ignorenulls=True).over(line)).filter("asked = 1").select("key", "at", "cents")


def dim_date(days: DataFrame) -> DataFrame:
    """A row for each local day from the first to the last of ``days`` (at)."""
    local = F.to_date(F.from_utc_timestamp("at", "America/Fortaleza"))
    span = days.agg(F.min(local).alias("a"), F.max(local).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.year("day").alias("year"), F.month("day").alias("month"), F.dayofmonth("day").alias("dom"))


def current_offers(offers: DataFrame) -> DataFrame:
    """id, is_cheapest, chain_count, spread_pct of each offer within its product."""
    chains = offers.groupBy("product_id").agg(F.countDistinct("retailer_id").alias("chain_count"), F.min("price_cents").alias("low"), F.max("price_cents").alias("high"))
    return offers.join(chains, "product_id").select("id", (F.col("price_cents") == F.col("low")).alias("is_cheapest"), "chain_count", F.round((F.col("high") - F.col("low")) / F.col("low") * 100, 4).alias("spread_pct"))


def _coded(s, d):
    k = F.col("id")
    return products(s, d).withColumns({"code": F.when(k % 2 == 0, F.lit("10000000")), "confidence": F.when(k % 2 == 0, 0.5)})


def _q_override(s, d):
    names = products(s, d).filter("id % 10 = 0").groupBy(F.upper("name").alias("name")).agg(F.lit("77777777").alias("code"))
    folded = names.groupBy(clean("name").alias("name")).agg(F.min("code").alias("code"))
    return override_codes(_coded(s, d), folded)


def _q_index(s, d):
    p = products(s, d)
    index = p.filter("id % 3 = 0").groupBy(canonical_key(F.col("name"), F.col("gtin")).alias("identity")).agg(F.lpad(F.min("id").cast("string"), 8, "0").alias("code"), F.lit("d").alias("department"))
    return index_lookup(public_tables(s, d)[1], index)


def _q_cache(s, d):
    p = products(s, d).select("id", signature(F.col("name"), F.col("brand"), "v1").alias("sig"))
    cache = p.filter("id % 4 <> 0").select("sig", F.lit("v1").alias("version"), F.lit("a").alias("answer")).distinct()
    return cache_lookup(p, cache, "v1")[1].select("id")


def _q_rekey(s, d):
    p = products(s, d).withColumns({"key": canonical_key(F.col("name"), F.col("gtin")), "updated_at": F.col("size_no")})
    return rekey(p).select("key", "id")


def _q_etag(s, d):
    return content_tag(products(s, d).withColumn("generated_at", F.current_timestamp()), ("generated_at",))


def _q_stale(s, d):
    u = products(s, d).filter("image_url is not null").select(F.col("image_url").alias("url"), "id")
    now = F.lit(NOW).cast("timestamp")
    checked = u.filter("id % 3 <> 0").select("url", F.when(F.col("id") % 2 == 0, "unsure").otherwise("ok").alias("status"), (now - F.expr("make_dt_interval(cast(id % 10 as int))")).alias("checked_at"))
    return stale_urls(u.select("url"), checked, now, 100)


def _q_fallback(s, d):
    p = products(s, d)
    return image_fallback(p, p.filter("id % 2 = 0").select("id", F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit(".webp")).alias("path")))


def _q_manifest(s, d):
    """Images saved from some of the products, then from others and some of the same."""
    found = _q_fallback(s, d).filter("startswith(image, '/images/')").select("image", "id").distinct()
    some = [found.filter(w).select("image").distinct() for w in ("id % 3 = 0", "id % 3 <> 1", "id % 2 = 0")]
    return saved_in_turn(BucketTable(s, new_folder(s, "image-manifest"), ["image"], 4), some, added(["image"]))


def _q_merge(s, d):
    found = products(s, d).groupBy(product_key(F.col("name")).alias("price_key")).agg(F.min("id").alias("id"))
    return catalogue_merge(found, public_tables(s, d)[0])


def _q_retailers(s, d):
    offers = public_tables(s, d)[0]
    site = stores(s, d).groupBy("name").agg(F.min("id").alias("retailer_id"), F.min_by("website", "id").alias("website"))
    return site.join(offers.select("retailer_id"), "retailer_id", "left_semi").select("retailer_id", "name", "website")


def _q_locations(s, d):
    site = stores(s, d).groupBy(F.col("name").alias("chain")).agg(F.min("id").alias("retailer_id"))
    return branches(s, d).join(site, "chain").select("id", "retailer_id", "name").orderBy("id")


def _q_history_keys(s, d):
    keys = products(s, d).orderBy("id").limit(30).select(product_key(F.col("name")).alias("product_key")).filter(F.col("product_key").rlike("^[0-9a-f]{32}$")).distinct()
    p = prices(s, d).join(products(s, d).select(F.col("id").alias("product_id"), product_key(F.col("name")).alias("product_key")), "product_id")
    return p.join(keys, "product_key", "left_semi").select("product_key", "store_id", "scraped_at", "price", "id")


def _q_gate(s, d):
    k = F.col("id")
    return score_gate(products(s, d).select("id", F.create_map(F.lit("a"), (k % 10) / 10.0, F.lit("b"), (k % 7) / 7.0 + 0.2).alias("scores")))


def _q_step(s, d):
    p = prices(s, d).groupBy(F.concat_ws("-", "product_id", "store_id").alias("key"), F.col("scraped_at").alias("at")).agg(F.max(cents(F.col("price"))).alias("cents"))
    return step_line(p, p.select("key").distinct().withColumn("at", F.lit("1999-06-01").cast("timestamp")))


def status_counts(source: DataFrame, classified: DataFrame, top: int = 15, outside: str = "Outros") -> DataFrame:
    """what, name, n: the products of the source, those classified, outside the taxonomy and pending a review, and the ``top``
    largest categories (ties by name)."""
    row = lambda what, rows: rows.agg(F.lit(what).alias("what"), F.lit("").alias("name"), F.count("*").alias("n"))
    totals = [row("source", source), row("classified", classified), row("outside", classified.filter(F.col("category") == outside)), row("pending", classified.filter(F.col("status") == "pending"))]
    by = classified.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    out = by.select(F.lit("category").alias("what"), "name", "n")
    for total in totals:
        out = out.unionByName(total)
    return out


def _q_status(s, d):
    return status_counts(products(s, d), public_tables(s, d)[1].withColumn("status", F.when(F.col("id") % 6 == 0, "pending").otherwise("ok")))


def _q_per_retailer(s, d):
    site = canonical_stores(stores(s, d)).select("retailer_id", "name").distinct()
    return site.join(public_tables(s, d)[0].groupBy("retailer_id").agg(F.count("*").alias("offers")), "retailer_id", "left").select("retailer_id", "name", F.coalesce("offers", F.lit(0)).alias("offers"))


def _q_bookkeeping(s, d):
    """The last run of each site after the earlier runs, then after the later ones: a site is overwritten, others stay."""
    own, middle = runs(s, d), "2024-01-15"
    of = lambda rows: rows.groupBy("site_key").agg(F.max("created_at").alias("last_run"), F.sum("items_found").alias("rows"), F.max_by("success", "id").alias("ok"))
    late = own.filter((F.col("created_at") >= middle) & (F.col("site_key") != "Chain 3"))
    return saved_in_turn(KeyedTable(s, new_folder(s, "run-bookkeeping"), ["site_key"]), [of(own.filter(F.col("created_at") < middle)), of(late)])


def _q_ttl(s, d):
    return canonical_stores(stores(s, d)).select("name").distinct().select("name", F.when(F.col("name").isin(*WEEKLY), TTL_WEEKLY).otherwise(TTL).alias("ttl_hours"))


def _q_dim_table(s, d):
    """A dimension saved from half of the products, then given the names it lacks."""
    p = products(s, d)
    table_ = KeyedTable(s, new_folder(s, "dim-name"), ["name"])
    table_.save(p.filter("id % 2 = 0").select("name").distinct())
    return table_.save(append_new(p.select("name"), table_.read(), ["name"]))


def _q_offer_product(s, d):
    offers, shown = public_tables(s, d)
    return offers.select("id", "product_id").join(shown.select(F.col("id").alias("product_id"), "name"), "product_id").select("id", "name")


QUERIES = {
    "jn_override": _q_override,
    "jn_index_lookup": _q_index,
    "st_answer_cache": _q_cache,
    "st_key_fallback": _q_rekey,
    "st_etag": _q_etag,
    "st_ttl": _q_ttl,
    "flt_stale_url": _q_stale,
    "jn_image_fallback": _q_fallback,
    "snk_image_manifest": _q_manifest,
    "jn_catalogue_merge": _q_merge,
    "pipe_catalogue_search": lambda s, d: catalogue_search(products(s, d), prices(s, d), stores(s, d), "leite", 40),
    "jn_search_prices": lambda s, d: catalogue_search(products(s, d), prices(s, d), stores(s, d), "arroz", 1000),
    "jn_retailer_list": _q_retailers,
    "set_with_data": lambda s, d: _q_retailers(s, d).select("retailer_id"),
    "jn_retailer_locations": _q_locations,
    "jn_offer_product": _q_offer_product,
    "dq_offer_contract": lambda s, d: offer_contract(dated(public_tables(s, d)[0]), F.lit(NOW).cast("timestamp")),
    "dq_exact_match": lambda s, d: exact_matches(public_tables(s, d)[1]).select("members", "first_id"),
    "flt_valid_line": lambda s, d: valid_lines(list_lines(s, d), 3),
    "flt_branch_region": lambda s, d: branches_in_region(branches(s, d), "CE", *CENTER, 20.0).select("id"),
    "flt_score_gate": _q_gate,
    "flt_history_keys": _q_history_keys,
    "snk_dim_upsert": _q_dim_table,
    "snk_run_bookkeeping": _q_bookkeeping,
    "ag_status_counts": _q_status,
    "ag_offers_per_retailer": _q_per_retailer,
    "gold_step_line": _q_step,
    "gold_dim_date": lambda s, d: dim_date(prices(s, d).select(F.col("scraped_at").alias("at"))),
    "gold_fact_current_offer": lambda s, d: current_offers(public_tables(s, d)[0]),
}

_SITE = "site AS (SELECT name, min(id) AS retailer_id, arg_min(website, id) AS website FROM stores GROUP BY 1)"
_IMG = "SELECT id, CASE WHEN image_url IS NOT NULL AND NOT contains(image_url, 'via.placeholder') THEN image_url WHEN id % 2 = 0 THEN '/images/' || id || '.webp' ELSE image_url END AS image FROM products"


def _search_sql(word: str, limit: int) -> str:
    w = f"regexp_extract_all({clean_sql('name')}, '[a-z0-9]+')"
    return with_tables(f"""WITH f AS (SELECT id, name, md5(lower(name)) AS product_key FROM products WHERE len(list_filter({w}, lambda x: starts_with(x, '{word}'))) > 0),
      o AS (SELECT product_key, s.name AS chain, min(f.name) AS name, min(price) AS price FROM prices p JOIN f ON f.id = p.product_id JOIN stores s ON s.id = p.store_id GROUP BY 1, 2)
      SELECT product_key, min(name) AS name, string_agg(chain, '|' ORDER BY chain) AS chains, min(price) AS low FROM o GROUP BY 1 ORDER BY NOT starts_with({clean_sql('min(name)')}, '{word}'), length(min(name)), min(name), product_key LIMIT {limit}""", "products", "prices", "stores")


ORACLE_SQL = {
    "jn_override": with_tables(f"WITH o AS (SELECT DISTINCT {clean_sql('name')} AS f FROM products WHERE id % 10 = 0) SELECT id, CASE WHEN f IS NOT NULL THEN '77777777' WHEN id % 2 = 0 THEN '10000000' END AS code, CASE WHEN f IS NOT NULL THEN 1.0 WHEN id % 2 = 0 THEN 0.5 END::DOUBLE AS confidence FROM products LEFT JOIN o ON f = {clean_sql('name')}", "products"),
    "st_answer_cache": with_tables("WITH p AS (SELECT id, lower(strip_accents(name)) || '::' || coalesce(lower(brand), '') AS sig FROM products) SELECT id FROM p WHERE sig NOT IN (SELECT sig FROM p WHERE id % 4 <> 0)", "products"),
    "st_ttl": with_tables(f"SELECT DISTINCT name, CASE WHEN name IN ('Chain 0', 'Chain 1') THEN {TTL_WEEKLY} ELSE {TTL} END AS ttl_hours FROM stores", "stores"),
    "flt_stale_url": with_tables("SELECT image_url AS url FROM products WHERE image_url IS NOT NULL AND (id % 3 = 0 OR id % 10 > CASE WHEN id % 2 = 0 THEN 1 ELSE 7 END) ORDER BY 1 LIMIT 100", "products"),
    "jn_image_fallback": with_tables(_IMG, "products"),
    "snk_image_manifest": with_tables(f"SELECT DISTINCT image FROM ({_IMG}) WHERE starts_with(image, '/images/')", "products"),
    "jn_catalogue_merge": public_sql("SELECT md5(lower(name)) AS price_key, min(id) AS id FROM products GROUP BY 1 HAVING md5(lower(any_value(name))) NOT IN (SELECT price_key FROM offers)"),
    "pipe_catalogue_search": _search_sql("leite", 40),
    "jn_search_prices": _search_sql("arroz", 1000),
    "jn_retailer_list": public_sql(f"WITH {_SITE} SELECT retailer_id, name, website FROM site WHERE retailer_id IN (SELECT retailer_id FROM offers)"),
    "set_with_data": public_sql("SELECT DISTINCT retailer_id FROM offers"),
    "jn_retailer_locations": with_tables(f"WITH {_SITE} SELECT b.id, s.retailer_id, b.name FROM branches b JOIN site s ON s.name = b.chain", "branches", "stores"),
    "jn_offer_product": public_sql("SELECT o.id, s.name FROM offers o JOIN shown s ON s.id = o.product_id"),
    "dq_offer_contract": public_sql("SELECT id, 'flyer dates' AS rule FROM offers WHERE product_id % 5 = 0 AND (product_id % 11 <> 0 OR product_id % 7 <> 0) UNION ALL SELECT id, 'dates reversed' FROM offers WHERE product_id % 77 = 0 UNION ALL SELECT id, 'future' FROM offers WHERE observed_at > TIMESTAMP '" + NOW + "' + INTERVAL 60 SECOND"),
    "dq_exact_match": public_sql(f"SELECT count(*) AS members, min(id) AS first_id FROM shown GROUP BY {clean_sql('name')}, lower(brand), category, amount, unit, pack_count, gtin"),
    "flt_valid_line": with_tables("SELECT list_id, product_id, quantity, checked FROM list_lines WHERE quantity BETWEEN 1 AND 999 QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY product_id) <= 3", "list_lines"),
    "flt_branch_region": with_tables("SELECT id FROM (SELECT id, pow(sin(radians(latitude + 3.7319) / 2), 2) + cos(radians(-3.7319::DOUBLE)) * cos(radians(latitude)) * pow(sin(radians(longitude + 38.5267) / 2), 2) AS h FROM branches WHERE id % 10 <> 0) WHERE 2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h)) <= 20", "branches"),
    "flt_score_gate": with_tables("SELECT id FROM products WHERE (id % 10) / 10.0::DOUBLE >= 0.8 AND (id % 7) / 7.0::DOUBLE + 0.2 >= 0.8", "products"),
    "flt_history_keys": with_tables("SELECT md5(lower(d.name)) AS product_key, store_id, scraped_at, price, p.id FROM prices p JOIN products d ON d.id = p.product_id WHERE md5(lower(d.name)) IN (SELECT md5(lower(name)) FROM (SELECT name FROM products ORDER BY id LIMIT 30))", "products", "prices"),
    "snk_dim_upsert": with_tables("SELECT DISTINCT name FROM products", "products"),
    "snk_run_bookkeeping": with_tables("""WITH late AS (SELECT * FROM runs WHERE created_at >= TIMESTAMP '2024-01-15' AND site_key <> 'Chain 3'), own AS (SELECT * FROM late UNION ALL SELECT * FROM runs WHERE created_at < TIMESTAMP '2024-01-15' AND site_key NOT IN (SELECT site_key FROM late))
        SELECT site_key, max(created_at) AS last_run, sum(items_found)::BIGINT AS rows, arg_max(success, id) AS ok FROM own GROUP BY 1""", "runs"),
    "ag_status_counts": public_sql("""SELECT 'source' AS what, '' AS name, count(*) AS n FROM products UNION ALL SELECT 'classified', '', count(*) FROM shown UNION ALL SELECT 'outside', '', count(*) FROM shown WHERE category = 'Outros'
        UNION ALL SELECT 'pending', '', count(*) FROM shown WHERE id % 6 = 0 UNION ALL SELECT * FROM (SELECT 'category', category, count(*) FROM shown GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 15)"""),
    "ag_offers_per_retailer": public_sql(f"WITH {_SITE} SELECT s.retailer_id, name, count(o.id) AS offers FROM site s LEFT JOIN offers o USING (retailer_id) GROUP BY 1, 2"),
    "gold_step_line": with_tables("SELECT product_id || '-' || store_id AS key, TIMESTAMP '1999-06-01' AS at, arg_max(round_even(price * 100, 0)::INT, (scraped_at, price)) FILTER (WHERE scraped_at <= TIMESTAMP '1999-06-01') AS cents FROM prices GROUP BY 1", "prices"),
    "gold_dim_date": "SELECT strftime(d, '%Y-%m-%d') AS day, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS dom FROM (SELECT unnest(generate_series((min(l_shipdate) - INTERVAL 3 HOUR)::DATE, (max(l_shipdate) - INTERVAL 3 HOUR)::DATE, INTERVAL 1 DAY)) AS d FROM lineitem)",
    "gold_fact_current_offer": public_sql("SELECT o.id, price_cents = low AS is_cheapest, chain_count, round((high - low) / low::DOUBLE * 100, 4) AS spread_pct FROM offers o JOIN (SELECT product_id, count(DISTINCT retailer_id) AS chain_count, min(price_cents) AS low, max(price_cents) AS high FROM offers GROUP BY 1) USING (product_id)"),
}
