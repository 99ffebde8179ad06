"""The published list: one offer for each entity and chain, enriched, with its variants and coverage.

Joins of products, groups and prices are told to merge sorted rows: files hold keys in a tenth of what rows of them take, so
by the size of its file Spark would gather millions of ids in the driver to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import CATEGORIES, category_sql, clean, club_of, display_name, match_tokens, parse_size, size_sql, tokens_sql, with_category
from feira.functions.values import canonical_key, cents, product_key
from feira.operators.listing import CANON, LATEST, LISTED, ON_LIST, latest_prices, listed_runs
from feira.sources.domain import prices, products, runs, stores, with_tables
from feira.sources.files import new_folder

#: Offers a chain may have in the list: all of them.
ALL = 0
#: Hours for which a price stays current: of chains that read their whole catalogue weekly, and of the others.
WEEKLY = ("Chain 0", "Chain 1")
TTL_WEEKLY, TTL = 28_800, 14_400


def match_products(product: DataFrame) -> DataFrame:
    """id, rep: the lowest id among products that are the same item at different chains (itself if alone).

    Same identity words (two or more) and same size. A name without size joins the only size of its words and pack;
    with none or several it groups with the other unsized ones.
    """
    p = product.withColumn("tokens", match_tokens("name")).withColumn("size", parse_size("name"))
    named = p.filter(F.size("tokens") >= 2).select("id", F.array_join("tokens", "|").alias("tokens"), "size.*")
    sized = ~((F.col("amount") == 1) & (F.col("unit") == "un"))
    own = F.struct("amount", "unit")
    sizes = F.collect_set(F.when(sized, own)).over(Window.partitionBy("tokens", "pack"))
    key = F.when(sized, own).when(F.size("sizes") == 1, F.col("sizes")[0]).otherwise(F.struct(F.lit(0).alias("amount"), F.lit("?").alias("unit")))
    group = Window.partitionBy("tokens", "pack", "key")
    grouped = named.withColumn("sizes", sizes).withColumn("key", key).withColumn("rep", F.min("id").over(group))
    return product.select("id").join(grouped.select("id", "rep").hint("merge"), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))


def merged_prices(latest: DataFrame, groups: DataFrame) -> DataFrame:
    """The most recent price of each entity and retailer: rep, retailer_id and the price row."""
    own = latest.join(groups.withColumnRenamed("id", "product_id").hint("merge"), "product_id")
    row = F.struct(*[c for c in own.columns if c not in ("rep", "retailer_id")])
    return own.groupBy("rep", "retailer_id").agg(F.max_by(row, "id").alias("r")).select("rep", "retailer_id", "r.*")


def most_useful(merged: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` prices of a retailer: discounted first, then entities of several chains, then by rep; 0 keeps all."""
    if cap <= 0:
        return merged
    discounted = (F.coalesce("offer", F.lit("")) != "") | F.coalesce(F.col("regular_price") > F.col("price"), F.lit(False))
    shared = F.count("*").over(Window.partitionBy("rep")) > 1
    rank = Window.partitionBy("retailer_id").orderBy(F.desc("discounted"), F.desc("shared"), "rep")
    ranked = merged.withColumns({"discounted": discounted, "shared": shared}).withColumn("n", F.row_number().over(rank))
    return ranked.filter(F.col("n") <= cap).drop("discounted", "shared", "n")


def enriched(product: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each entity: the name that reads best, brand, barcode and photo of its first member that has them.

    Best: with a size, not all capitals, longest; then lowest id. A missing brand or photo is borrowed from another
    product of the same barcode.
    """
    m = product.join(groups.hint("merge"), "id").withColumn("s", parse_size("name"))
    sized = ~((F.col("s.amount") == 1) & (F.col("s.unit") == "un"))
    calm = F.upper("name") != F.col("name")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("id")))
    one = m.groupBy("rep").agg(
        F.max_by(F.struct("name", "gtin", "s"), F.struct(sized.alias("a"), calm.alias("b"), F.length("name").alias("c"), (-F.col("id")).alias("d"))).alias("shown"),
        first("brand").alias("brand"),
        first("gtin").alias("gtin"),
        first("image_url").alias("image_url"),
        F.count("*").alias("members"),
    )
    by_code = product.filter("gtin is not null").groupBy("gtin").agg(first("brand").alias("code_brand"), first("image_url").alias("code_image"))
    one = one.join(by_code.hint("merge"), "gtin", "left")
    out = one.select(
        "rep",
        F.col("shown.name").alias("source_name"),
        F.coalesce("brand", "code_brand", F.lit("")).alias("brand"),
        "gtin",
        F.coalesce("image_url", "code_image").alias("image_url"),
        "members",
        "shown.s.amount",
        "shown.s.unit",
        F.col("shown.s.pack").alias("pack_count"),
        canonical_key(F.col("shown.name"), F.col("shown.gtin")).alias("identity"),
    )
    return with_category(out, "source_name").withColumn("name", display_name("source_name"))


def offer_variants(merged: DataFrame, product: DataFrame) -> DataFrame:
    """The prices a shopper can get: a club price with a regular one makes an ordinary offer and a conditional one."""
    p = merged.join(product.select(F.col("id").alias("product_id"), F.col("name").alias("member_name")).hint("merge"), "product_id")
    p = p.withColumns({"c": cents(F.col("price")), "rc": cents(F.col("regular_price")), "club": club_of("offer"), "key": F.concat_ws("-", "rep", "retailer_id")})
    variant = lambda i, price, club, regular, label: F.struct(i.alias("id"), price.alias("price_cents"), club.cast("string").alias("club"), regular.cast("int").alias("regular_price_cents"), label.cast("string").alias("deal_label"))
    none = F.lit(None)
    both = F.array(variant(F.col("key"), F.col("rc"), none, none, none), variant(F.concat("key", F.lit("-club")), F.col("c"), F.col("club"), F.col("rc"), F.col("offer")))
    single = F.array(variant(F.col("key"), F.col("c"), F.col("club"), F.col("rc"), F.nullif("offer", F.lit(""))))
    ttl = F.when(F.col("retailer_name").isin(*WEEKLY), TTL_WEEKLY).otherwise(TTL)
    out = p.withColumn("v", F.explode(F.when(F.col("club").isNotNull() & F.col("rc").isNotNull(), both).otherwise(single)))
    return out.select(
        "v.id",
        F.col("rep").alias("product_id"),
        product_key(F.col("member_name")).alias("price_key"),
        "retailer_id",
        "retailer_name",
        "v.price_cents",
        "v.regular_price_cents",
        "v.deal_label",
        "v.club",
        "stock",
        F.when(F.col("stock") > 0, "available").otherwise("unknown").alias("availability"),
        F.col("scraped_at").alias("observed_at"),
        ttl.alias("ttl_hours"),
        F.lit("catalog").alias("channel"),
    )


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, as several parts of the list need it."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def build_public(product: DataFrame, store: DataFrame, price: DataFrame, run: DataFrame, cap: int = ALL) -> tuple[DataFrame, DataFrame]:
    """(offers, products) of the published list."""
    latest = saved(latest_prices(price, store, listed_runs(run)).filter("price > 0"), "latest")
    usable = product.join(latest.select(F.col("product_id").alias("id")).hint("merge"), "id", "left_semi")
    groups = saved(match_products(usable), "groups")
    merged = most_useful(merged_prices(latest.join(usable.select(F.col("id").alias("product_id")).hint("merge"), "product_id", "left_semi"), groups), cap)
    shown = enriched(usable, groups).join(merged.select("rep").distinct().hint("merge"), "rep", "left_semi")
    return offer_variants(merged, product), shown.withColumnRenamed("rep", "id")


def coverage(offers: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: networks, products, offers, and products that several chains sell."""
    per = offers.groupBy("product_id").agg(F.countDistinct("retailer_id").alias("chains"))
    pairs = per.agg(F.count(F.when(F.col("chains") > 1, 1)).alias("exact_pairs"))
    both = offers.agg(F.countDistinct("retailer_id").alias("networks"), F.count("*").alias("offers"))
    return both.crossJoin(shown.agg(F.count("*").alias("products"))).crossJoin(pairs)  # three tables of one row


def public_tables(spark, d, cap: int = ALL):
    return build_public(products(spark, d), stores(spark, d), prices(spark, d), runs(spark, d), cap)


def _usable(spark, d):
    latest = latest_prices(prices(spark, d), stores(spark, d), listed_runs(runs(spark, d))).filter("price > 0")
    p = products(spark, d)
    return p.join(latest.select(F.col("product_id").alias("id")).hint("merge"), "id", "left_semi"), latest


def _q_match(spark, d):
    usable, _ = _usable(spark, d)
    return match_products(usable)


def _q_merge(spark, d):
    usable, latest = _usable(spark, d)
    return merged_prices(latest, match_products(usable)).select("rep", "retailer_id", "id", "price")


def _q_cap(spark, d):
    usable, latest = _usable(spark, d)
    return most_useful(merged_prices(latest, match_products(usable)), 20).select("rep", "retailer_id", "id")


def _q_products(*columns):
    def query(spark, d):
        return public_tables(spark, d)[1].select("id", *columns)

    return query


def _q_offers(spark, d):
    return public_tables(spark, d)[0]


def _q_borrow(spark, d):
    p = products(spark, d)
    code = p.filter("gtin is not null").groupBy("gtin").agg(F.min_by("brand", F.when(F.col("brand").isNotNull(), F.col("id"))).alias("b"), F.min_by("image_url", F.when(F.col("image_url").isNotNull(), F.col("id"))).alias("i"))
    return p.join(code, "gtin", "left").select("id", F.coalesce("brand", "b").alias("brand"), F.coalesce("image_url", "i").alias("image_url"))


QUERIES = {
    "ag_match_products": _q_match,
    "win_merge_group": _q_merge,
    "win_cap_per_chain": _q_cap,
    "ag_display_member": _q_products("source_name"),
    "ag_first_of": _q_products("brand", "gtin", "image_url"),
    "jn_gtin_borrow": _q_borrow,
    "gen_offer_variants": _q_offers,
    "pipe_build_public": _q_products("name", "brand", "gtin", "image_url", "category", "subcategory", "amount", "unit", "pack_count", "identity"),
    "ag_coverage": lambda s, d: coverage(*public_tables(s, d)),
    "ord_payload": lambda s, d: public_tables(s, d)[1].select("id", clean("name").alias("sort_name")).orderBy("sort_name", "id"),
    "set_regions": lambda s, d: s.createDataFrame([(c,) for c, _ in CATEGORIES], "category string").union(s.createDataFrame([("Outros",)], "category string")).distinct().join(public_tables(s, d)[1].groupBy("category").count(), "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("products")),
}

_T = ("products", "stores", "prices", "runs")


def public_ctes(cap: int = ALL) -> str:
    """DuckDB CTEs, after the domain tables: offers and shown of the published list."""
    gt = "CASE WHEN length({0}) IN (8, 12, 13, 14) AND NOT (length({0}) = 13 AND starts_with({0}, '2')) THEN lpad({0}, 14, '0') END".format("sh.gtin")
    return f"""{CANON}, {LISTED}, {ON_LIST}, {LATEST},
usable AS (SELECT * FROM products WHERE id IN (SELECT product_id FROM latest WHERE price > 0)),
tok AS (SELECT id, array_to_string({tokens_sql('name')}, '|') AS tokens, len({tokens_sql('name')}) AS n, {size_sql('name')} AS s FROM usable),
one AS (SELECT tokens, s.pack AS pack, count(DISTINCT (s.amount, s.unit)) AS k, any_value(s.amount) AS amount, any_value(s.unit) AS unit
  FROM tok WHERE n >= 2 AND NOT (s.amount = 1 AND s.unit = 'un') GROUP BY 1, 2),
keyed AS (SELECT t.id, t.tokens, t.s.pack AS pack, CASE WHEN NOT (t.s.amount = 1 AND t.s.unit = 'un') THEN t.s.amount || t.s.unit WHEN o.k = 1 THEN o.amount || o.unit ELSE '?' END AS key
  FROM tok t LEFT JOIN one o ON o.tokens = t.tokens AND o.pack = t.s.pack WHERE t.n >= 2),
grp AS (SELECT u.id, coalesce(k.rep, u.id) AS rep FROM usable u LEFT JOIN (SELECT id, min(id) OVER (PARTITION BY tokens, pack, key) AS rep FROM keyed) k USING (id)),
merged AS (SELECT l.*, g.rep FROM latest l JOIN grp g ON g.id = l.product_id WHERE l.price > 0 QUALIFY row_number() OVER (PARTITION BY g.rep, l.retailer_id ORDER BY l.id DESC) = 1),
capped AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rep) > 1 AS shared, coalesce(offer, '') <> '' OR coalesce(regular_price > price, false) AS disc FROM merged)
  QUALIFY row_number() OVER (PARTITION BY retailer_id ORDER BY disc DESC, shared DESC, rep) <= {cap or 'count(*) OVER ()'}),
variants AS (SELECT rep || '-' || retailer_id AS id, CASE WHEN offer = 'PinClube' AND regular_price IS NOT NULL THEN rc ELSE c END AS price_cents,
    CASE WHEN offer = 'PinClube' AND regular_price IS NULL THEN 'PinClube' END AS club, CASE WHEN offer = 'PinClube' AND regular_price IS NOT NULL THEN NULL ELSE rc END AS regular_price_cents,
    CASE WHEN offer = 'PinClube' AND regular_price IS NOT NULL THEN NULL ELSE offer END AS deal_label, * EXCLUDE (id, offer) FROM (SELECT *, round_even(price * 100, 0)::INT AS c, round_even(regular_price * 100, 0)::INT AS rc FROM capped)
  UNION ALL SELECT rep || '-' || retailer_id || '-club', c, 'PinClube', rc, offer, * EXCLUDE (id, offer) FROM (SELECT *, round_even(price * 100, 0)::INT AS c, round_even(regular_price * 100, 0)::INT AS rc FROM capped) WHERE offer = 'PinClube' AND rc IS NOT NULL),
offers AS (SELECT v.id, v.rep AS product_id, md5(lower(p.name)) AS price_key, retailer_id, retailer_name, price_cents, regular_price_cents, deal_label, club, stock,
  CASE WHEN stock > 0 THEN 'available' ELSE 'unknown' END AS availability, scraped_at AS observed_at, CASE WHEN retailer_name IN ('Chain 0', 'Chain 1') THEN {TTL_WEEKLY} ELSE {TTL} END AS ttl_hours, 'catalog' AS channel
  FROM variants v JOIN products p ON p.id = v.product_id),
mem AS (SELECT u.*, g.rep, {size_sql('name')} AS s FROM usable u JOIN grp g USING (id)),
best AS (SELECT rep, arg_max(name, (NOT (s.amount = 1 AND s.unit = 'un'), upper(name) <> name, length(name), -id)) AS source_name, arg_max(coalesce(gtin, '-'), (NOT (s.amount = 1 AND s.unit = 'un'), upper(name) <> name, length(name), -id)) AS g0,
  arg_min(brand, id) FILTER (WHERE brand IS NOT NULL) AS brand0, arg_min(gtin, id) FILTER (WHERE gtin IS NOT NULL) AS gtin, arg_min(image_url, id) FILTER (WHERE image_url IS NOT NULL) AS image0, count(*) AS members FROM mem GROUP BY rep),
code AS (SELECT gtin, arg_min(brand, id) FILTER (WHERE brand IS NOT NULL) AS cb, arg_min(image_url, id) FILTER (WHERE image_url IS NOT NULL) AS ci FROM usable WHERE gtin IS NOT NULL GROUP BY gtin),
sh AS (SELECT b.rep AS id, source_name, coalesce(brand0, cb, '') AS brand, b.gtin, coalesce(image0, ci) AS image_url, members, nullif(g0, '-') AS g1, {size_sql('source_name')} AS s FROM best b LEFT JOIN code USING (gtin) WHERE rep IN (SELECT rep FROM capped)),
named AS (SELECT id, source_name AS name FROM sh),
{category_sql('named').replace('best AS', 'bestkw AS').replace('JOIN best b', 'JOIN bestkw b')},
shown AS (SELECT sh.*, s.amount AS amount, s.unit AS unit, s.pack AS pack_count, category, subcategory,
  coalesce('gtin:' || {gt.replace('sh.gtin', 'g1')}, 'tok:' || substring(sha256(array_to_string({tokens_sql('source_name')}, '|') || '|' || s.amount || s.unit || 'x' || s.pack), 1, 16)) AS identity,
  CASE WHEN upper(source_name) <> source_name THEN array_to_string(list_transform(string_split(source_name, ' '), lambda w: CASE WHEN regexp_matches(w, '(?i)^\\d+(?:[.,]\\d+)?(?:kg|g|mg|l|ml|un|und|cm|m)$') THEN lower(w) ELSE w END), ' ')
   ELSE array_to_string(list_transform(string_split(source_name, ' '), lambda w, i: CASE WHEN regexp_matches(w, '(?i)^\\d+(?:[.,]\\d+)?(?:kg|g|mg|l|ml|un|und|cm|m)$') THEN lower(w) WHEN i > 1 AND lower(w) IN ('de', 'da', 'do', 'com', 'e') THEN lower(w)
     ELSE array_to_string(list_transform(string_split(lower(w), '-'), lambda x: upper(x[1]) || x[2:]), '-') END), ' ') END AS name FROM sh JOIN cat USING (id))"""


def public_sql(query: str, *more: str, cap: int = ALL) -> str:
    """DuckDB SQL over the published list: tables offers and shown, and the domain tables in ``more``."""
    body = query.strip()
    body = f",\n{body[5:]}" if body.upper().startswith("WITH ") else f"\n{body}"
    return with_tables(f"WITH {public_ctes(cap)}{body}", *_T, *more)


ORACLE_SQL = {
    "ag_match_products": public_sql("SELECT id, rep FROM grp"),
    "win_merge_group": public_sql("SELECT rep, retailer_id, id, price FROM merged"),
    "win_cap_per_chain": public_sql("SELECT rep, retailer_id, id FROM capped", cap=20),
    "ag_display_member": public_sql("SELECT id, source_name FROM shown"),
    "ag_first_of": public_sql("SELECT id, brand, gtin, image_url FROM shown"),
    "jn_gtin_borrow": with_tables("""WITH code AS (SELECT gtin, arg_min(brand, id) FILTER (WHERE brand IS NOT NULL) AS b, arg_min(image_url, id) FILTER (WHERE image_url IS NOT NULL) AS i FROM products WHERE gtin IS NOT NULL GROUP BY gtin)
        SELECT id, coalesce(brand, b) AS brand, coalesce(image_url, i) AS image_url FROM products LEFT JOIN code USING (gtin)""", "products"),
    "gen_offer_variants": public_sql("SELECT * FROM offers"),
    "pipe_build_public": public_sql("SELECT id, name, brand, gtin, image_url, category, subcategory, amount, unit, pack_count, identity FROM shown"),
    "ag_coverage": public_sql("SELECT (SELECT count(DISTINCT retailer_id) FROM offers) AS networks, (SELECT count(*) FROM offers) AS offers, (SELECT count(*) FROM shown) AS products, (SELECT count(*) FROM (SELECT product_id FROM offers GROUP BY 1 HAVING count(DISTINCT retailer_id) > 1)) AS exact_pairs"),
    "ord_payload": public_sql("SELECT id, trim(regexp_replace(lower(strip_accents(name)), '\\s+', ' ', 'g')) AS sort_name FROM shown"),
    "set_regions": public_sql("SELECT c.category, count(s.id) AS products FROM (SELECT DISTINCT category FROM kw UNION SELECT 'Outros') c LEFT JOIN shown s USING (category) GROUP BY 1"),
}
