"""Domain tables derived from the generated star schema: products, stores, prices, runs, branches, lists, receipts.

Every table is a narrow projection of one Parquet scan, so column pruning and filters reach the files. ``CTES`` holds
the same projections as DuckDB SQL, written on their own, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of product that give part rows a name people would search for.
KINDS = (
    "Papel Higienico", "Creme de Leite", "Feijão Carioca", "Café Torrado", "Arroz Branco", "Peito de Frango",
    "Macarrão Instantâneo sabor Picanha", "Molho de Tomate", "Sabonete Barra", "Leite Integral", "Cerveja Lata",
    "Carne Bovina", "Agua Sanitaria", "Shampoo", "Biscoito Recheado", "Banana Prata", "Refrigerante Cola",
    "Queijo Mussarela", "Detergente Neutro", "Brinquedo", "Açúcar Refinado", "Pão de Forma", "Lava-Loucas", "Suco de Uva",
)
SIZES = ("500g", "1,5kg", "350ml", "2L", "12 unidades", "Kg", "", "900 ml", "6 un 350ml")

#: "Now" of all queries that compare times with the present.
NOW = "2001-01-15 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, brand, gtin, image_url, created_at."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.trim(F.concat_ws(" ", pick(KINDS, k * 7919), F.col("p_name"), pick(SIZES, k * 31)))
    return p.select(
        k.alias("id"),
        F.when(k % 11 == 0, F.upper(name)).otherwise(name).alias("name"),
        F.when(k % 3 != 0, F.col("p_brand")).alias("brand"),
        F.when(k % 4 == 1, F.concat(F.lit("2"), F.lpad(k.cast("string"), 12, "0")))
        .when(k % 4 != 0, F.concat(F.lit("789"), F.lpad((k % 500).cast("string"), 10, "0")))
        .alias("gtin"),
        F.when(k % 13 == 0, F.concat(F.lit("https://via.placeholder.com/"), k.cast("string")))
        .when(k % 5 != 0, F.concat(F.lit("https://img.chain.com.br/"), k.cast("string"), F.lit(".jpg")))
        .alias("image_url"),
        F.col("p_size").alias("size_no"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name (several ids share one), city, website."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        k.alias("id"),
        F.concat(F.lit("Chain "), (k % 5).cast("string")).alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("City "), F.col("s_nationkey").cast("string"))).alias("city"),
        F.concat(F.lit("https://chain"), (k % 5).cast("string"), F.lit(".com.br")).alias("website"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, product_id, store_id, price, regular_price, offer, run_id, scraped_at, stock, url."""
    return prices_of(table(spark, sf_dir, "lineitem"))


def prices_of(li: DataFrame) -> DataFrame:
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5)
    regular = F.floor(cents / (1 - F.col("l_discount")) + 0.5)
    return li.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 512 + F.col("l_suppkey") % 512).alias("id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        (cents / 100.0).alias("price"),
        F.when(F.col("l_discount") > 0.04, regular / 100.0).alias("regular_price"),
        F.when(F.col("l_returnflag") == "R", F.lit("PinClube")).when(F.col("l_discount") > 0.06, F.lit("10% OFF")).alias("offer"),
        F.concat(F.lit("r"), (F.col("l_orderkey") % 7).cast("string")).alias("run_id"),
        F.col("l_shipdate").alias("scraped_at"),
        F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("int")).alias("stock"),
        F.concat(F.lit("https://chain.com.br/p/"), F.col("l_partkey").cast("string")).alias("url"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, site_key (the name of a chain), success, error, items_found, run_id, duration_ms, created_at."""
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("Chain "), (F.col("user_id") % 5).cast("string")).alias("site_key"),
        ok.alias("success"),
        F.when(~ok & (F.col("event_id") % 2 == 0), F.lit("timeout")).alias("error"),
        F.floor("value").cast("int").alias("items_found"),
        F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string"))).alias("run_id"),
        (F.col("value") * 10).alias("duration_ms"),
        F.col("ts").alias("created_at"),
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, external_id, chain, name, address, latitude, longitude: around one centre."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.concat(F.lit("ext-"), k.cast("string")).alias("external_id"),
        F.concat(F.lit("Chain "), (k % 5).cast("string")).alias("chain"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("Rua "), (k % 97).cast("string"), F.lit(", "), (k % 999).cast("string"), F.lit(" - Fortaleza - "), F.when(k % 10 == 0, F.lit("PI")).otherwise(F.lit("CE"))).alias("address"),
        (F.lit(-3.7319) + ((k * 7919) % 2000 - 1000) / 4000.0).alias("latitude"),
        (F.lit(-38.5267) + ((k * 104729) % 2000 - 1000) / 4000.0).alias("longitude"),
    )


def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list_id, product_id, quantity, checked: shopping lists from orders."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("product_id")).agg(
        F.sum("l_quantity").cast("int").alias("quantity"), F.max(F.col("l_linestatus") == "F").alias("checked")
    )


def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """receipt_id, line_no, product_id, qty, unit_price, discount, total: some with wrong sums, gaps and repeats."""
    li = table(spark, sf_dir, "lineitem")
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5) / 100.0
    off = F.floor(F.col("l_discount") * 100) / 100.0
    wrong = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 9 == 0, F.lit(1.5)).otherwise(F.lit(0.0))
    return li.select(
        F.col("l_orderkey").alias("receipt_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("qty"),
        unit.alias("unit_price"),
        off.alias("discount"),
        (F.floor((F.col("l_quantity") * unit - off) * 100 + 0.5) / 100.0 + wrong).alias("total"),
    )


def code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, description: fiscal codes of 2, 4, 6 and 8 digits, some levels missing."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    full = F.lpad(((k * 7919) % 90_000_000 + 10_000_000).cast("string"), 8, "0")
    digits = pick(("2", "4", "6", "8", "8", "8"), k).cast("int")
    named = p.select(full.alias("full"), digits.alias("digits"), "p_name", pick(KINDS, k * 7919).alias("kind"), k.alias("k"))
    named = named.select(F.expr("substring(full, 1, digits)").alias("code"), F.concat_ws(" ", "kind", "p_name").alias("description"), "k")
    return named.groupBy("code").agg(F.min_by("description", "k").alias("description"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, path, name, parent_slug, depth, is_leaf: one root over regions over nations."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    root = spark.createDataFrame([("alimentos", "Alimentos", "Alimentos", None, 0, False)], "slug string, path string, name string, parent_slug string, depth int, is_leaf boolean")
    slug = F.lower("r_name")
    mid = r.select(slug.alias("slug"), F.concat(F.lit("Alimentos>"), F.initcap("r_name")).alias("path"), F.initcap("r_name").alias("name"), F.lit("alimentos").alias("parent_slug"), F.lit(1).alias("depth"), F.lit(False).alias("is_leaf"))
    leaf = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("n_name").alias("slug"),
        F.concat(F.lit("Alimentos>"), F.initcap("r_name"), F.lit(">"), F.lower("n_name")).alias("path"),
        F.lower("n_name").alias("name"),
        slug.alias("parent_slug"),
        F.lit(2).alias("depth"),
        F.lit(True).alias("is_leaf"),
    )
    return root.unionByName(mid).unionByName(leaf)


_KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_SIZES_SQL = "[" + ", ".join(f"'{s}'" for s in SIZES) + "]"

CTES = {
    "products": f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN upper(nm) ELSE nm END AS name,
    CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand,
    CASE WHEN p_partkey % 4 = 1 THEN '2' || lpad(p_partkey::VARCHAR, 12, '0')
         WHEN p_partkey % 4 <> 0 THEN '789' || lpad((p_partkey % 500)::VARCHAR, 10, '0') END AS gtin,
    CASE WHEN p_partkey % 13 = 0 THEN 'https://via.placeholder.com/' || p_partkey
         WHEN p_partkey % 5 <> 0 THEN 'https://img.chain.com.br/' || p_partkey || '.jpg' END AS image_url, p_size AS size_no
    FROM (SELECT *, trim({_KINDS_SQL}[(p_partkey * 7919) % {len(KINDS)} + 1] || ' ' || p_name || ' ' || {_SIZES_SQL}[(p_partkey * 31) % {len(SIZES)} + 1]) AS nm FROM part)""",
    "stores": """SELECT s_suppkey AS id, 'Chain ' || (s_suppkey % 5) AS name,
    CASE WHEN s_suppkey % 2 = 0 THEN 'City ' || s_nationkey END AS city, 'https://chain' || (s_suppkey % 5) || '.com.br' AS website FROM supplier""",
    "prices": """SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 512 + l_suppkey % 512 AS id, l_partkey AS product_id, l_suppkey AS store_id,
    floor(l_extendedprice / l_quantity + 0.5) / 100.0::DOUBLE AS price,
    CASE WHEN l_discount > 0.04 THEN floor(floor(l_extendedprice / l_quantity + 0.5) / (1 - l_discount) + 0.5) / 100.0::DOUBLE END AS regular_price,
    CASE WHEN l_returnflag = 'R' THEN 'PinClube' WHEN l_discount > 0.06 THEN '10% OFF' END AS offer,
    'r' || (l_orderkey % 7) AS run_id, l_shipdate AS scraped_at, CASE WHEN l_quantity >= 10 THEN l_quantity::INT END AS stock,
    'https://chain.com.br/p/' || l_partkey AS url FROM lineitem""",
    "runs": """SELECT event_id AS id, 'Chain ' || (user_id % 5) AS site_key, event_type <> 'error' AS success,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'timeout' END AS error, floor(value)::INT AS items_found,
    CASE WHEN event_id % 6 <> 0 THEN 'r' || (event_id % 7) END AS run_id, value * 10 AS duration_ms, ts AS created_at FROM events""",
    "branches": """SELECT c_custkey AS id, 'ext-' || c_custkey AS external_id, 'Chain ' || (c_custkey % 5) AS chain, c_name AS name,
    'Rua ' || (c_custkey % 97) || ', ' || (c_custkey % 999) || ' - Fortaleza - ' || CASE WHEN c_custkey % 10 = 0 THEN 'PI' ELSE 'CE' END AS address,
    -3.7319::DOUBLE + ((c_custkey * 7919) % 2000 - 1000) / 4000.0::DOUBLE AS latitude,
    -38.5267::DOUBLE + ((c_custkey * 104729) % 2000 - 1000) / 4000.0::DOUBLE AS longitude FROM customer""",
    "list_lines": """SELECT l_orderkey AS list_id, l_partkey AS product_id, sum(l_quantity)::INT AS quantity, bool_or(l_linestatus = 'F') AS checked
    FROM lineitem GROUP BY ALL""",
    "receipt_lines": """SELECT l_orderkey AS receipt_id, l_linenumber AS line_no, l_partkey AS product_id, l_quantity AS qty, u AS unit_price, o AS discount,
    floor((l_quantity * u - o) * 100 + 0.5) / 100.0::DOUBLE + CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS total
    FROM (SELECT *, floor(l_extendedprice / l_quantity + 0.5) / 100.0::DOUBLE AS u, floor(l_discount * 100) / 100.0::DOUBLE AS o FROM lineitem)""",
    "code_table": f"""SELECT code, min_by(description, k) AS description FROM (SELECT p_partkey AS k,
    substring(lpad(((p_partkey * 7919) % 90000000 + 10000000)::VARCHAR, 8, '0'), 1, [2, 4, 6, 8, 8, 8][p_partkey % 6 + 1]) AS code,
    {_KINDS_SQL}[(p_partkey * 7919) % {len(KINDS)} + 1] || ' ' || p_name AS description FROM part) GROUP BY code""",
    "taxonomy": """SELECT 'alimentos' AS slug, 'Alimentos' AS path, 'Alimentos' AS name, NULL AS parent_slug, 0 AS depth, false AS is_leaf
    UNION ALL SELECT lower(r_name), 'Alimentos>' || rn, rn, 'alimentos', 1, false FROM (SELECT *, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS rn FROM region)
    UNION ALL SELECT lower(n_name), 'Alimentos>' || rn || '>' || lower(n_name), lower(n_name), lower(r_name), 2, true
    FROM nation JOIN (SELECT *, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS rn FROM region) r ON n_regionkey = r_regionkey""",
}


def with_tables(query: str, *names: str) -> str:
    """DuckDB SQL: ``query`` over the named domain tables. A query that begins with WITH goes on with its own tables."""
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    body = query.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
