"""The star schema over prices: dimensions with keys made of their natural keys, bridges, and the fact of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import clean, club_of, display_name, parse_size, size_sql, tokens_sql, variable_weight, with_category
from feira.functions.values import canonical_key, cents
from feira.operators.discovery import _q_evidence
from feira.operators.listing import canonical_stores, last_errors, listed_runs
from feira.plans.public import public_sql
from feira.sources.domain import branches, prices, products, runs, stores, with_tables
from feira.sources.files import KeyedTable, new_folder


def star_key(*natural: Column) -> Column:
    """The key of a dimension row: a hash of its natural key, so every run and every table agrees on it."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("")) for c in natural])


NO_BRAND = "Sem Marca / Desconhecida"


def dim_brand(product: DataFrame) -> DataFrame:
    """brand_key, slug, name: a row for each folded brand under its most frequent spelling (ties: the least), and one for none."""
    own = product.select(clean(F.coalesce("brand", F.lit(""))).alias("slug"), F.trim("brand").alias("brand"))
    spelled = own.filter("slug <> ''").groupBy("slug", "brand").agg(F.count("*").alias("n")).groupBy("slug").agg(F.min(F.struct((-F.col("n")).alias("n"), "brand")).alias("b")).select("slug", F.col("b.brand").alias("name"))
    none = own.select(F.lit("").alias("slug"), F.lit(NO_BRAND).alias("name")).distinct()
    return spelled.unionByName(none).select(star_key(F.col("slug")).alias("brand_key"), "slug", "name")


def dim_store(store: DataFrame, run: DataFrame) -> DataFrame:
    """store_key, name, source_id, website, run_id, problem: a row for each chain with its current run and its last problem."""
    canon = canonical_stores(store).join(store.select("id", "website"), "id")
    one = canon.groupBy("name").agg(F.min("id").alias("source_id"), F.min_by("website", "id").alias("website"))
    listed = listed_runs(run)
    problem = last_errors(run, listed).select(F.col("site_key").alias("name"), "problem")
    out = one.join(listed.select(F.col("site_key").alias("name"), "run_id"), "name", "left").join(problem, "name", "left")
    return out.select(star_key(F.col("name")).alias("store_key"), "name", "source_id", "website", "run_id", "problem")


def dim_location(branch: DataFrame) -> DataFrame:
    """location_key, store_key, external_id, name, city, state, latitude, longitude of branches; the place is read from the address."""
    state = F.regexp_extract("address", r"- ([A-Z]{2})$", 1)
    city = F.trim(F.regexp_extract("address", r"- ([^-]+) - [A-Z]{2}$", 1))
    return branch.select(star_key(F.col("chain"), F.col("external_id")).alias("location_key"), star_key(F.col("chain")).alias("store_key"), "external_id", "name", F.coalesce(F.nullif(city, F.lit("")), F.lit("Fortaleza")).alias("city"), F.coalesce(F.nullif(state, F.lit("")), F.lit("CE")).alias("state"), "latitude", "longitude")


def bridge_source(product: DataFrame) -> DataFrame:
    """source_id, product_key, canonical, method: every source product's canonical product; by barcode, by words and size, or alone."""
    own = product.withColumn("canonical", canonical_key(F.col("name"), F.col("gtin")))
    many = F.count("*").over(Window.partitionBy("canonical"))
    method = F.when(F.col("canonical").startswith("gtin:"), "gtin_exact").when(many > 1, "token_size").otherwise("singleton")
    return own.select(F.col("id").alias("source_id"), star_key(F.col("canonical")).alias("product_key"), "canonical", method.alias("method"))


def dim_product(product: DataFrame) -> DataFrame:
    """product_key, canonical, name, search, brand_key, category, amount, unit, pack, total, variable, members: a row for each
    canonical product, of its member whose name reads best (sized, not shouted, longest, lowest id)."""
    own = product.join(bridge_source(product).select(F.col("source_id").alias("id"), "product_key", "canonical"), "id").withColumn("s", parse_size("name"))
    sized = ~((F.col("s.amount") == 1) & (F.col("s.unit") == "un"))
    best = F.struct(sized.alias("a"), (F.upper("name") != F.col("name")).alias("b"), F.length("name").alias("c"), (-F.col("id")).alias("d"))
    first = F.min_by("brand", F.when(F.coalesce("brand", F.lit("")) != "", F.col("id")))
    one = own.groupBy("product_key", "canonical").agg(F.max_by("name", best).alias("raw"), first.alias("brand"), F.count("*").alias("members"))
    one = with_category(one, "raw").withColumn("s", parse_size("raw"))
    brand = clean(F.coalesce("brand", F.lit("")))
    return one.select(
        "product_key", "canonical", display_name("raw").alias("name"), F.trim(F.concat_ws(" ", clean("raw"), brand)).alias("search"), star_key(brand).alias("brand_key"), "category", "subcategory",
        "s.amount", "s.unit", "s.pack", (F.col("s.amount") * F.col("s.pack")).alias("total"), variable_weight("raw").alias("variable"), "members",
    )


def bridge_category(shown: DataFrame) -> DataFrame:
    """product_key, category, role, weight: the primary category counts fully, a second one never, so sums count once.

    shown (product_key, name, category): the second category is the one the name has without its first word.
    """
    rest = shown.withColumn("tail", F.regexp_replace("name", r"^\S+\s*", ""))
    second = with_category(rest.select("product_key", F.col("category").alias("first"), "tail"), "tail")
    second = second.filter((F.col("category") != F.col("first")) & (F.col("category") != "Outros")).select("product_key", "category", F.lit("secondary").alias("role"), F.lit(0.0).alias("weight"))
    return shown.select("product_key", "category", F.lit("primary").alias("role"), F.lit(1.0).alias("weight")).unionByName(second)


def promoted_keys(old: DataFrame, product: DataFrame) -> DataFrame:
    """id, canonical, previous: products whose key was made of words (old: id, canonical) take that of their barcode once they
    have one and keep the former as ``previous``; a key of a barcode never goes back."""
    new = product.select("id", canonical_key(F.col("name"), F.col("gtin")).alias("new"))
    both = new.join(old, "id", "left")
    up = F.col("canonical").startswith("tok:") & F.col("new").startswith("gtin:")
    return both.select("id", F.when(F.col("canonical").isNull() | up, F.col("new")).otherwise(F.col("canonical")).alias("canonical"), F.when(up, F.col("canonical")).alias("previous"))


def fact_observation(price: DataFrame, product: DataFrame, store: DataFrame, run: DataFrame) -> DataFrame:
    """price_id, product_key, store_key, date_key and measures of each observation: what an ordinary shopper and a club member
    pay, discount, price of a kilo or litre, and whether it comes from the chain's complete run."""
    canon = canonical_stores(store).select(F.col("id").alias("store_id"), F.col("name").alias("chain"))
    listed = listed_runs(run).select(F.col("site_key").alias("chain"), F.col("run_id").alias("listed"))
    named = product.select(F.col("id").alias("product_id"), star_key(canonical_key(F.col("name"), F.col("gtin"))).alias("product_key"), parse_size("name").alias("s"))
    own = price.join(named, "product_id").join(canon, "store_id").join(listed, "chain", "left").withColumns({"c": cents(F.col("price")), "r": cents(F.col("regular_price")), "club": club_of("offer")})
    for_club = F.col("club").isNotNull() & F.col("r").isNotNull()
    base = F.col("s.amount") * F.col("s.pack")
    known = F.col("s.unit").isin("g", "ml") & (base > 0)
    local = F.from_utc_timestamp("scraped_at", "America/Fortaleza")
    return own.select(
        F.col("id").alias("price_id"), "product_key", star_key(F.col("chain")).alias("store_key"), F.date_format(local, "yyyyMMdd").cast("int").alias("date_key"),
        F.col("c").alias("price_cents"), F.col("r").alias("regular_cents"), F.when(for_club, F.col("r")).otherwise(F.col("c")).alias("ordinary_cents"), F.when(F.col("club").isNotNull(), F.col("c")).alias("club_cents"),
        F.when(F.col("r") > F.col("c"), F.round((F.col("r") - F.col("c")) * 100.0 / F.col("r"), 4)).alias("discount_pct"), F.when(known, F.floor(F.col("c") * 1000.0 / base + 0.5).cast("int")).alias("per_kilo_cents"),
        (F.coalesce(F.col("r") > F.col("c"), F.lit(False)) | (F.coalesce("offer", F.lit("")) != "")).alias("is_promotion"), F.coalesce(F.col("run_id") == F.col("listed"), F.lit(False)).alias("is_complete"),
    )


def _shown(s, d) -> DataFrame:
    table = KeyedTable(s, new_folder(s, "dim-product"), ["product_key"])
    return table.save(dim_product(products(s, d)).select("product_key", "name", "category"))


def _q_bridge(s, d):
    out = bridge_category(_shown(s, d))
    return out.groupBy("category", "role").agg(F.count("*").alias("products"), F.sum("weight").alias("weight"))


def _q_promotion(s, d):
    p = products(s, d)
    old = p.filter("id % 3 <> 0").select("id", canonical_key(F.col("name"), F.when(F.col("id") % 2 == 0, F.col("gtin"))).alias("canonical"))
    return promoted_keys(old, p)


QUERIES = {
    "gold_dim_store": lambda s, d: dim_store(stores(s, d), runs(s, d)).drop("store_key"),
    "gold_dim_location": lambda s, d: dim_location(branches(s, d)).drop("location_key", "store_key"),
    "gold_dim_brand": lambda s, d: dim_brand(products(s, d)).drop("brand_key"),
    "gold_dim_product": lambda s, d: dim_product(products(s, d)).drop("product_key", "brand_key"),
    "gold_bridge": lambda s, d: bridge_source(products(s, d)).drop("product_key"),
    "gold_bridge_category": _q_bridge,
    "gold_key_promotion": _q_promotion,
    "gold_fact_observation": lambda s, d: fact_observation(prices(s, d), products(s, d), stores(s, d), runs(s, d)).drop("product_key", "store_key"),
    "gold_branch_evidence": _q_evidence,
}

_GT = "CASE WHEN length({0}) IN (8, 12, 13, 14) AND NOT (length({0}) = 13 AND starts_with({0}, '2')) THEN lpad({0}, 14, '0') END"


def _key(gtin: str) -> str:
    return f"coalesce('gtin:' || {_GT.format(gtin)}, 'tok:' || substring(sha256(array_to_string({tokens_sql('name')}, '|') || '|' || s.amount || s.unit || 'x' || s.pack), 1, 16))"


_P = f"WITH p AS (SELECT *, {_key('gtin')} AS canonical FROM (SELECT *, {size_sql('name')} AS s FROM products))"
_CLEAN = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "gold_branch_evidence": with_tables("SELECT id * 10 AS flyer_id, id AS branch_id, round(2.0::DOUBLE * length(name) / (2 * length(name) + 2), 6) AS ratio FROM branches", "branches"),
    "gold_dim_brand": with_tables(f"SELECT {_CLEAN.format('brand')} AS slug, min(brand) AS name FROM products WHERE brand IS NOT NULL GROUP BY 1 UNION ALL SELECT '', '{NO_BRAND}'", "products"),
    "gold_dim_location": with_tables("SELECT external_id, name, 'Fortaleza' AS city, right(address, 2) AS state, latitude, longitude FROM branches", "branches"),
    "gold_bridge": with_tables(f"{_P} SELECT id AS source_id, canonical, CASE WHEN starts_with(canonical, 'gtin:') THEN 'gtin_exact' WHEN count(*) OVER (PARTITION BY canonical) > 1 THEN 'token_size' ELSE 'singleton' END AS method FROM p", "products"),
    "gold_key_promotion": with_tables(f"""WITH p AS (SELECT *, {_key('gtin')} AS new, {_key("(CASE WHEN id % 2 = 0 THEN gtin END)")} AS was FROM (SELECT *, {size_sql('name')} AS s FROM products))
        SELECT id, CASE WHEN id % 3 = 0 OR (starts_with(was, 'tok:') AND starts_with(new, 'gtin:')) THEN new ELSE was END AS canonical, CASE WHEN id % 3 <> 0 AND starts_with(was, 'tok:') AND starts_with(new, 'gtin:') THEN was END AS previous FROM p""", "products"),
    "gold_fact_observation": public_sql(f"""WITH z AS (SELECT id AS product_id, {size_sql('name')} AS s FROM products), cn AS (SELECT id AS store_id, name AS chain FROM stores),
        o AS (SELECT p.*, round_even(price * 100, 0)::INT AS c, round_even(regular_price * 100, 0)::INT AS r, s, chain FROM prices p JOIN z USING (product_id) JOIN cn USING (store_id))
        SELECT o.id AS price_id, strftime(scraped_at - INTERVAL 3 HOUR, '%Y%m%d')::INT AS date_key, c AS price_cents, r AS regular_cents, CASE WHEN offer = 'PinClube' AND r IS NOT NULL THEN r ELSE c END AS ordinary_cents, CASE WHEN offer = 'PinClube' THEN c END AS club_cents,
          CASE WHEN r > c THEN round((r - c) * 100.0::DOUBLE / r, 4) END AS discount_pct, CASE WHEN s.unit IN ('g', 'ml') THEN floor(c * 1000.0::DOUBLE / (s.amount * s.pack) + 0.5)::INT END AS per_kilo_cents,
          coalesce(r > c, false) OR coalesce(offer, '') <> '' AS is_promotion, coalesce(o.run_id = l.run_id, false) AS is_complete FROM o LEFT JOIN listed l ON l.site_key = chain"""),
}
