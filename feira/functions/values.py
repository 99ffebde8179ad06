"""Codes, keys, money, dates, distances and similarities, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from feira.functions.text import clean, clean_sql, known_size, match_tokens, parse_size, size_sql, tokens_sql
from feira.sources.domain import branches, code_table, prices, products, receipt_lines, stores, table, taxonomy, with_tables

EARTH_KM = 6371.0088
CENTER = (-3.7319, -38.5267)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def normalize_gtin(c: Column) -> Column:
    """14 digits; null for other lengths and for in-store codes (13 digits that begin with 2)."""
    d = digits(F.coalesce(c, F.lit("")))
    bad = ~F.length(d).isin(8, 12, 13, 14) | ((F.length(d) == 13) & d.startswith("2"))
    return F.when(~bad, F.lpad(d, 14, "0"))


def valid_ean(c: Column) -> Column:
    """The trimmed code if it is 8, 12, 13 or 14 digits and not all zeros."""
    t = F.trim(c)
    return F.when(t.rlike(r"^(?:\d{8}|\d{12}|\d{13}|\d{14})$") & ~t.rlike(r"^0+$"), t)


def gs1_check(c: Column) -> Column:
    """The digits of a code whose check digit is right, else null."""
    d = digits(F.coalesce(c, F.lit("")))
    own = F.transform(F.split(F.reverse(d), ""), lambda x, i: x.try_cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    total = F.aggregate(own, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(F.length(d).isin(8, 12, 13, 14) & (total % 10 == 0) & ~d.rlike("^0+$"), d)


def code_read(c: Column) -> Column:
    """8 to 16 digits that aren't all zero, whatever their check digit."""
    d = digits(F.coalesce(c, F.lit("")))
    return F.when(F.length(d).between(8, 16) & ~d.rlike("^0+$"), d)


def gtin_key(c: Column) -> Column:
    return F.regexp_replace(digits(c), "^0+", "")


def normalize_code(c: Column) -> Column:
    """Digits of a fiscal code of 2, 4, 6 or 8 digits, else null."""
    d = digits(F.coalesce(c, F.lit("")))
    return F.when(F.length(d).isin(2, 4, 6, 8), d)


def product_key(name: Column) -> Column:
    return F.md5(F.lower(name))


def canonical_key(name: Column, gtin: Column) -> Column:
    """The barcode, or a hash of identity words and size."""
    size = parse_size(name)
    material = F.concat(F.array_join(match_tokens(name), "|"), F.lit("|"), size["amount"].cast("string"), size["unit"], F.lit("x"), size["pack"].cast("string"))
    code = normalize_gtin(gtin)
    return F.coalesce(F.concat(F.lit("gtin:"), code), F.concat(F.lit("tok:"), F.substring(F.sha2(material, 256), 1, 16)))


def signature(name: Column, brand: Column, version: str) -> Column:
    return F.sha2(F.concat_ws("::", clean(name), clean(F.coalesce(brand, F.lit(""))), F.lit(version)), 256)


def cents(price: Column) -> Column:
    """Half to even."""
    return F.bround(price * 100, 0).cast("int")


def parse_money(c: Column) -> Column:
    """Cents from "R$ 1.234,56", "12,5" or "12.5"; null for anything else."""
    t = F.trim(F.regexp_replace(c, r"^\s*R\$\s*", ""))
    comma = F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")
    number = F.when(t.rlike(r"^(?:\d{1,3}(?:\.\d{3})+|\d+),\d{1,2}$"), comma).when(t.rlike(r"^\d+(?:\.\d{1,2})?$"), t)
    return F.floor(number.cast("double") * 100 + 0.5).cast("int")


def strict_cents(c: Column) -> Column:
    """Cents of a price with exactly two decimals and a comma; null otherwise and for zero."""
    t = F.trim(F.regexp_replace(c, r"^R\$\s*", ""))
    n = F.regexp_replace(t, r"[.,]", "").try_cast("int")
    return F.when(t.rlike(r"^(?:\d{1,3}(?:\.\d{3})*|\d+),\d{2}$") & (n > 0), n)


def discount_pct(price: Column, regular: Column) -> Column:
    """Whole percent below the regular price, half up; 0 without one."""
    return F.when((regular > 0) & (price < regular), F.floor((1 - price / regular) * 100 + 0.5)).otherwise(0).cast("int")


def deal_label(price: Column, regular: Column, buy: Column, pay: Column) -> Column:
    """The words of a deal: percent off, and take-n-pay-m."""
    off = F.when(regular > price, F.concat(discount_pct(price, regular).cast("string"), F.lit("% OFF")))
    tier = F.when(buy > pay, F.concat(F.lit("Leve "), buy.cast("string"), F.lit(" pague "), pay.cast("string")))
    return F.nullif(F.concat_ws(" · ", off, tier), F.lit(""))


def unit_price(price_cents: Column, amount: Column, unit: Column, pack: Column) -> Column:
    """Cents for a kilo, litre or unit, half up; null where the size is unknown or it only repeats the price."""
    value = F.floor(price_cents / (amount * pack) * F.when(unit == "un", 1).otherwise(1000) + 0.5).cast("int")
    return F.when(known_size(amount, unit, pack) & (value != price_cents), value)


def normalize_unit(amount: Column, unit: Column) -> Column:
    """struct(amount, unit) in g, ml or un; null for other units and amounts not above zero."""
    u = F.lower(unit)
    base = F.when(u.isin("kg", "g"), "g").when(u.isin("l", "ml"), "ml").when(u == "un", "un")
    value = F.floor(amount * F.when(u.isin("kg", "l"), 1000).otherwise(1) + 0.5).cast("int")
    return F.when(base.isNotNull() & (amount > 0), F.struct(value.alias("amount"), base.alias("unit")))


def parse_validity(c: Column, year: Column) -> Column:
    """struct(start, end) in UTC of "20 a 22/09" and "30/09 a 05/10", local days of a zone three hours behind.

    A start month after the end month lies in the year before; impossible days give nulls.
    """
    p = r"(\d{1,2})(?:/(\d{1,2}))?\s*a\s*(\d{1,2})/(\d{1,2})"
    g = [F.regexp_extract(clean(c), p, i).try_cast("int") for i in range(1, 5)]
    start_month = F.coalesce(g[1], g[3])
    start_year = F.when(start_month > g[3], year - 1).otherwise(year)
    start = F.try_make_timestamp(start_year, start_month, g[0], F.lit(3), F.lit(0), F.lit(0))
    end = F.try_make_timestamp(year, g[3], g[2], F.lit(23), F.lit(59), F.lit(59)) + F.expr("interval 3 hours")
    both = start.isNotNull() & end.isNotNull()
    return F.struct(F.when(both, start).alias("start"), F.when(both, end).alias("end"))


def flyer_period(start: Column) -> Column:
    """struct(month, week of month) in local time."""
    local = F.from_utc_timestamp(start, "America/Fortaleza")
    return F.struct(F.date_format(local, "yyyy-MM").alias("month"), F.ceil(F.dayofmonth(local) / 7).cast("int").alias("week"))


def countdown(moment: Column, now: Column, verb: str) -> Column:
    """Time to ``moment`` in words, rounded up to minutes."""
    minutes = F.greatest(F.lit(1), F.ceil((F.unix_timestamp(moment) - F.unix_timestamp(now)) / 60)).cast("int")
    days, hours = F.floor(minutes / 1440), F.floor(minutes % 1440 / 60)
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    time = F.when(days > 0, text(days, "d ", hours, "h")).when(hours > 0, text(hours, "h ", minutes % 60, "min")).otherwise(text(minutes, "min"))
    return F.concat(F.lit(f"{verb} em "), time)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Kilometres on the sphere; null for coordinates out of bounds."""
    ok = (F.abs(lat1) <= 90) & (F.abs(lat2) <= 90) & (F.abs(lon1) <= 180) & (F.abs(lon2) <= 180)
    rad = F.radians
    h = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return F.when(ok, 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h))))


def unpack_history(blob: Column) -> Column:
    """array of struct(price_cents, observed_at) from 8 bytes each: cents and epoch seconds, big-endian."""
    entry = lambda i, at: F.conv(F.hex(F.substr(blob, i * 8 + at, F.lit(4))), 16, 10).cast("long")
    n = F.floor(F.octet_length(blob) / 8).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(entry(i, 1).cast("int").alias("price_cents"), F.timestamp_seconds(entry(i, 5)).alias("observed_at")))
    return F.when(n > 0, each).otherwise(F.array())


def pack_history(entries: Column) -> Column:
    """The inverse of ``unpack_history``."""
    four = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.array_join(F.transform(entries, lambda e: F.concat(four(e["price_cents"]), four(F.unix_timestamp(e["observed_at"])))), ""))


@F.pandas_udf(DoubleType())
def sequence_ratio(a, b):
    """2 * matching characters / all characters, by longest matching blocks."""
    from difflib import SequenceMatcher

    import pandas as pd

    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def token_dice(a: Column, b: Column) -> Column:
    """2 * shared words / all words of two word arrays."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def word_similarity(printed: Column, own: Column) -> Column:
    """1 equal, .9 a prefix of three letters or more, .85 one edit from five, .6 letters left out from four."""
    same_start = F.substring(printed, 1, 1) == F.substring(own, 1, 1)
    n = F.length(printed)
    inside = F.regexp_like(own, F.concat(F.lit("^"), F.regexp_replace(printed, "(.)", "$1.*")))
    return (
        F.when(printed == own, 1.0)
        .when((n >= 3) & own.startswith(printed), 0.9)
        .when((n >= 5) & same_start & (F.levenshtein(printed, own) <= 1), 0.85)
        .when((n >= 4) & same_start & (F.length(own) <= n * 2) & inside, 0.6)
        .otherwise(0.0)
    )


def department_of(path: Column, food_root: str = "Alimentos") -> Column:
    """The second level of a path under the food root, else the first."""
    parts = F.split(path, ">")
    return F.when((parts[0] == food_root) & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(parts[0])


# Hosts that only serve example pictures.
PLACEHOLDER_HOSTS = ("via.placeholder.com", "placehold.co", "placeholder.com", "example.com", "example.org", "localhost")


def placeholder_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:]+)", 1))
    return host.isin(*PLACEHOLDER_HOSTS) | host.rlike(r"\.(?:example\.com|example\.org|placeholder\.com)$")


def clamp_confidence(c: Column) -> Column:
    """A confidence as text or number within 0 and 1; 0.75 if there is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.75))))


def tolerant_json(c: Column, schema: str) -> Column:
    """The first JSON object in text around it (code fences, prose); null if it doesn't parse."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)


def _per_product(alias: str, f):
    def query(spark, sf_dir):
        return products(spark, sf_dir).select("id", f(F.col("name"), F.col("gtin"), F.col("brand")).alias(alias))

    return query


def _codes(alias: str, f):
    def query(spark, sf_dir):
        p = products(spark, sf_dir)
        return p.select("id", f(F.concat(F.col("gtin"), F.when(F.col("id") % 3 == 0, " ").otherwise(""))).alias(alias))

    return query


def _per_price(alias: str, f):
    def query(spark, sf_dir):
        return prices(spark, sf_dir).select("id", f().alias(alias))

    return query


def _q_money(spark, sf_dir):
    p = prices(spark, sf_dir).withColumn("c", cents(F.col("price")))
    whole, part = F.floor(F.col("c") / 100).cast("string"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    return p.select("id", parse_money(F.concat(F.lit("R$ "), whole, F.lit(","), part)).alias("comma"), parse_money(F.concat(whole, F.lit("."), part)).alias("dot"), strict_cents(F.concat(whole, F.lit(","), part)).alias("strict"))


def _q_unit_price(spark, sf_dir):
    p = prices(spark, sf_dir).join(products(spark, sf_dir).select(F.col("id").alias("product_id"), "name"), "product_id")
    p = p.withColumn("s", parse_size("name"))
    return p.select("id", unit_price(cents(F.col("price")), F.col("s.amount"), F.col("s.unit"), F.col("s.pack")).alias("unit_cents"))


def _q_normalize_unit(spark, sf_dir):
    k = F.col("id")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("KG", "g", "L", "ml", "un", "cm")]), (k % 6 + 1).cast("int"))
    return products(spark, sf_dir).withColumn("n", normalize_unit((k % 9) / 4.0, unit)).select("id", "n.amount", "n.unit")


def _q_validity(spark, sf_dir):
    k = F.col("id")
    text = F.concat(F.lit("Válidas de "), (k % 31 + 1).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("/"), (k % 12 + 1).cast("string"))).otherwise(""), F.lit(" a "), (k % 28 + 1).cast("string"), F.lit("/"), (k % 7 + 3).cast("string"))
    v = products(spark, sf_dir).withColumn("v", parse_validity(text, F.lit(2001)))
    return v.select("id", F.col("v.start").alias("valid_from"), F.col("v.end").alias("valid_until"))


def _q_period(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("p", flyer_period(F.col("ts"))).select("event_id", "p.month", "p.week")


def _q_countdown(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", countdown(F.col("ts"), F.lit("2024-01-10 00:00:00").cast("timestamp"), "Termina").alias("label"))


def _q_haversine(spark, sf_dir):
    b = branches(spark, sf_dir)
    return b.select("id", F.round(haversine(F.lit(CENTER[0]), F.lit(CENTER[1]), F.col("latitude"), F.col("longitude")), 6).alias("km"))


def _q_codec(spark, sf_dir):
    p = prices(spark, sf_dir).select("product_id", "store_id", F.struct(cents(F.col("price")).alias("price_cents"), F.col("scraped_at").alias("observed_at")).alias("e"))
    packed = p.groupBy("product_id", "store_id").agg(pack_history(F.array_sort(F.collect_list("e"))).alias("blob"))
    return packed.select("product_id", "store_id", F.explode(unpack_history(F.col("blob"))).alias("e")).select("product_id", "store_id", "e.price_cents", "e.observed_at")


def _q_similarity(spark, sf_dir):
    p = products(spark, sf_dir).filter(F.col("id") > 0)
    other = p.select((F.col("id") + 1).alias("id"), F.col("name").alias("other"))
    return p.join(other, "id").select("id", F.round(F.greatest(sequence_ratio(clean("name"), clean("other")), token_dice(match_tokens("name"), match_tokens("other"))), 6).alias("similarity"))


def _q_dice(spark, sf_dir):
    p = products(spark, sf_dir)
    other = p.select((F.col("id") + 1).alias("id"), F.col("name").alias("other"))
    return p.join(other, "id").select("id", F.round(token_dice(match_tokens("name"), match_tokens("other")), 6).alias("dice"))


def _q_word(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lower("p_type").alias("own")).distinct()
    short = p.select("own", F.explode(F.array(F.substring("own", 1, 3), F.regexp_replace("own", "[aeiou]", ""), F.col("own"), F.substring("own", 2, 9), F.concat(F.substring("own", 1, 4), F.lit("x")))).alias("printed"))
    return short.select("own", "printed", word_similarity(F.col("printed"), F.col("own")).alias("similarity")).distinct()


def _q_same_chain(spark, sf_dir):
    """Distinct keys of shops, each with the least key it is one chain with: rows of classes, not pairs of stores."""
    from feira.functions.text import chain_key
    from feira.operators.discovery import same_chain_pairs

    s = stores(spark, sf_dir)
    kind = F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, " Norte").when(F.col("id") % 4 == 2, "x").otherwise(" Ltda")
    named = s.select(chain_key(F.concat(F.lit("Armazem "), F.col("name"), kind)).alias("key")).distinct()
    pairs = same_chain_pairs(named.select(F.col("key").alias("a")), named.select(F.col("key").alias("b")))
    return pairs.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("least"), F.count("*").alias("same"))


def _q_json_path(spark, sf_dir):
    by = prices(spark, sf_dir).groupBy(F.date_format("scraped_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("offers"))
    payload = by.select("month", F.to_json(F.struct(F.struct("offers").alias("coverage"))).alias("payload"))
    return payload.select("month", F.get_json_object("payload", "$.coverage.offers").cast("long").alias("offers"))


def _q_json_tolerant(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wrapped = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n``` done"))
    return e.select("event_id", tolerant_json(wrapped, "k int")["k"].alias("k"))


def _q_codes_norm(spark, sf_dir):
    c = code_table(spark, sf_dir)
    return c.select("code", normalize_code(F.concat(F.substring("code", 1, 4), F.lit("."), F.substring("code", 5, 9))).alias("normal"))


QUERIES = {
    "fn_normalize_gtin": _codes("gtin14", normalize_gtin),
    "fn_valid_ean": _codes("ean", valid_ean),
    "fn_gs1_check": _codes("code", gs1_check),
    "fn_code_read": _codes("code", code_read),
    "fn_gtin_key": _codes("code_key", gtin_key),
    "fn_normalize_code": _q_codes_norm,
    "fn_product_key": _per_product("product_key", lambda n, g, b: product_key(n)),
    "fn_canonical_key": _per_product("canonical_key", lambda n, g, b: canonical_key(n, g)),
    "fn_signature": _per_product("signature", lambda n, g, b: signature(n, b, "v1")),
    "fn_cents": _per_price("cents", lambda: cents(F.col("price") * 1.005)),
    "fn_parse_money": _q_money,
    "fn_discount_pct": _per_price("pct", lambda: discount_pct(cents(F.col("price")), cents(F.col("regular_price")))),
    "fn_deal_label": _per_price("label", lambda: deal_label(F.col("price"), F.col("regular_price"), (F.col("product_id") % 4).cast("int"), F.lit(2))),
    "fn_unit_price": _q_unit_price,
    "fn_normalize_unit": _q_normalize_unit,
    "fn_parse_validity": _q_validity,
    "fn_flyer_period": _q_period,
    "fn_flyer_countdown": _q_countdown,
    "fn_haversine": _q_haversine,
    "fn_history_codec": _q_codec,
    "fn_name_similarity": _q_similarity,
    "fn_token_dice": _q_dice,
    "fn_same_chain": _q_same_chain,
    "fn_word_similarity": _q_word,
    "fn_department_of": lambda spark, d: taxonomy(spark, d).select("slug", department_of(F.col("path")).alias("department")),
    "fn_placeholder_host": lambda spark, d: products(spark, d).select("id", placeholder_host(F.col("image_url")).alias("placeholder")),
    "fn_confidence_clamp": lambda spark, d: receipt_lines(spark, d).select("receipt_id", "line_no", "product_id", clamp_confidence(F.when(F.col("line_no") == 3, "high").otherwise((F.col("total") / 50 - 1).cast("string"))).alias("confidence")),
    "fn_json_path": _q_json_path,
    "fn_json_tolerant": _q_json_tolerant,
}

_BRAND = clean_sql("coalesce(brand, '')")
_G = "(gtin || CASE WHEN id % 3 = 0 THEN ' ' ELSE '' END)"
_D = f"regexp_replace(coalesce({_G}, ''), '\\D', '', 'g')"
_N14 = f"CASE WHEN length({_D}) IN (8, 12, 13, 14) AND NOT (length({_D}) = 13 AND starts_with({_D}, '2')) THEN lpad({_D}, 14, '0') END"
_PLAIN14 = _N14.replace(_G, "gtin")
ORACLE_SQL = {
    "fn_normalize_gtin": with_tables(f"SELECT id, {_N14} AS gtin14 FROM products", "products"),
    "fn_valid_ean": with_tables(f"SELECT id, CASE WHEN regexp_matches(trim({_G}), '^(?:\\d{{8}}|\\d{{12,14}})$') AND NOT regexp_matches(trim({_G}), '^0+$') THEN trim({_G}) END AS ean FROM products", "products"),
    "fn_gs1_check": with_tables(f"""SELECT id, CASE WHEN length(d) IN (8, 12, 13, 14) AND NOT regexp_matches(d, '^0+$') AND
        list_sum(list_transform(range(1, length(d) + 1), lambda i: substring(reverse(d), i, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0 THEN d END AS code FROM (SELECT id, {_D} AS d FROM products)""", "products"),
    "fn_code_read": with_tables(f"SELECT id, CASE WHEN length({_D}) BETWEEN 8 AND 16 AND NOT regexp_matches({_D}, '^0+$') THEN {_D} END AS code FROM products", "products"),
    "fn_gtin_key": with_tables(f"SELECT id, ltrim(regexp_replace({_G}, '\\D', '', 'g'), '0') AS code_key FROM products", "products"),
    "fn_normalize_code": with_tables("SELECT code, code AS normal FROM code_table", "code_table"),
    "fn_product_key": with_tables("SELECT id, md5(lower(name)) AS product_key FROM products", "products"),
    "fn_canonical_key": with_tables(f"""SELECT id, coalesce('gtin:' || g, 'tok:' || substring(sha256(array_to_string(t, '|') || '|' || s.amount || s.unit || 'x' || s.pack), 1, 16)) AS canonical_key
        FROM (SELECT id, {_PLAIN14} AS g, {tokens_sql('name')} AS t, {size_sql('name')} AS s FROM products)""", "products"),
    "fn_signature": with_tables(f"SELECT id, sha256({clean_sql('name')} || '::' || {_BRAND} || '::v1') AS signature FROM products", "products"),
    "fn_cents": with_tables("SELECT id, round_even(price * 1.005::DOUBLE * 100, 0)::INT AS cents FROM prices", "prices"),
    "fn_parse_money": with_tables("SELECT id, c AS comma, c AS dot, c AS strict FROM (SELECT id, round_even(price * 100, 0)::INT AS c FROM prices)", "prices"),
    "fn_discount_pct": with_tables("SELECT id, CASE WHEN r > p THEN floor((1 - p / r::DOUBLE) * 100 + 0.5)::INT ELSE 0 END AS pct FROM (SELECT id, round_even(price * 100, 0)::INT AS p, round_even(regular_price * 100, 0)::INT AS r FROM prices)", "prices"),
    "fn_deal_label": with_tables("""SELECT id, nullif(concat_ws(' · ', CASE WHEN regular_price > price THEN floor((1 - price / regular_price) * 100 + 0.5)::INT || '% OFF' END,
        CASE WHEN product_id % 4 > 2 THEN 'Leve ' || (product_id % 4) || ' pague 2' END), '') AS label FROM prices""", "prices"),
    "fn_unit_price": with_tables(f"""SELECT id, CASE WHEN NOT (s.unit = 'un' AND s.amount * s.pack = 1) AND v <> c THEN v END AS unit_cents FROM (SELECT *, floor(c / (s.amount * s.pack)::DOUBLE * CASE WHEN s.unit = 'un' THEN 1 ELSE 1000 END + 0.5)::INT AS v
        FROM (SELECT p.id, round_even(price * 100, 0)::INT AS c, s FROM prices p JOIN (SELECT id AS product_id, {size_sql('name')} AS s FROM products) USING (product_id)))""", "products", "prices"),
    "fn_normalize_unit": with_tables("""SELECT id, CASE WHEN u <> 'cm' AND a > 0 THEN floor(a * CASE WHEN u IN ('kg', 'l') THEN 1000 ELSE 1 END + 0.5)::INT END AS amount,
        CASE WHEN u <> 'cm' AND a > 0 THEN CASE WHEN u IN ('kg', 'g') THEN 'g' WHEN u = 'un' THEN 'un' ELSE 'ml' END END AS unit
        FROM (SELECT id, (id % 9) / 4.0::DOUBLE AS a, lower(['KG', 'g', 'L', 'ml', 'un', 'cm'][id % 6 + 1]) AS u FROM products)""", "products"),
    "fn_parse_validity": with_tables("""SELECT id, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s + INTERVAL 3 HOUR END AS valid_from, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN e + INTERVAL 27 HOUR - INTERVAL 1 SECOND END AS valid_until
        FROM (SELECT id, try_cast(CASE WHEN sm > em THEN 2000 ELSE 2001 END || '-' || sm || '-' || sd AS TIMESTAMP) AS s, try_cast('2001-' || em || '-' || ed AS TIMESTAMP) AS e
        FROM (SELECT id, id % 31 + 1 AS sd, CASE WHEN id % 2 = 0 THEN id % 12 + 1 ELSE id % 7 + 3 END AS sm, id % 28 + 1 AS ed, id % 7 + 3 AS em FROM products))""", "products"),
    "fn_flyer_period": "SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%Y-%m') AS month, ceil(day(ts - INTERVAL 3 HOUR) / 7.0)::INT AS week FROM events",
    "fn_flyer_countdown": """SELECT event_id, 'Termina em ' || CASE WHEN m >= 1440 THEN (m // 1440) || 'd ' || (m % 1440 // 60) || 'h' WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'min' ELSE m || 'min' END AS label
        FROM (SELECT event_id, greatest(1, ceil((floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-10')) / 60.0))::INT AS m FROM events)""",
    "fn_haversine": with_tables(f"""SELECT id, round(2 * {EARTH_KM} * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h))), 6) AS km FROM (SELECT id, pow(sin(radians(latitude - {CENTER[0]}) / 2), 2) +
        cos(radians({CENTER[0]}::DOUBLE)) * cos(radians(latitude)) * pow(sin(radians(longitude - {CENTER[1]}) / 2), 2) AS h FROM branches)""", "branches"),
    "fn_history_codec": with_tables("SELECT product_id, store_id, round_even(price * 100, 0)::INT AS price_cents, scraped_at AS observed_at FROM prices", "prices"),
    "fn_token_dice": with_tables(f"""SELECT a.id, round(2 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t))::DOUBLE, 6) AS dice FROM (SELECT id, {tokens_sql('name')} AS t FROM products) a
        JOIN (SELECT id + 1 AS id, {tokens_sql('name')} AS t FROM products) b USING (id)""", "products"),
    "fn_word_similarity": """WITH own AS (SELECT DISTINCT lower(p_type) AS own FROM part),
        pr AS (SELECT DISTINCT own, unnest([substring(own, 1, 3), regexp_replace(own, '[aeiou]', '', 'g'), own, substring(own, 2, 9), substring(own, 1, 4) || 'x']) AS printed FROM own)
        SELECT own, printed, CASE WHEN printed = own THEN 1.0 WHEN length(printed) >= 3 AND starts_with(own, printed) THEN 0.9
          WHEN length(printed) >= 5 AND printed[1] = own[1] AND levenshtein(printed, own) <= 1 THEN 0.85
          WHEN length(printed) >= 4 AND printed[1] = own[1] AND length(own) <= length(printed) * 2 AND regexp_matches(own, '^' || regexp_replace(printed, '(.)', '\\1.*', 'g')) THEN 0.6 ELSE 0.0 END::DOUBLE AS similarity FROM pr""",
    "fn_department_of": with_tables("SELECT slug, CASE WHEN depth = 0 THEN path ELSE string_split(path, '>')[2] END AS department FROM taxonomy", "taxonomy"),
    "fn_placeholder_host": with_tables("SELECT id, CASE WHEN image_url IS NULL THEN NULL ELSE contains(image_url, '//via.placeholder.com/') END AS placeholder FROM products", "products"),
    "fn_confidence_clamp": with_tables("SELECT receipt_id, line_no, product_id, CASE WHEN line_no = 3 THEN 0.75 ELSE greatest(0.0, least(1.0, total / 50 - 1)) END::DOUBLE AS confidence FROM receipt_lines", "receipt_lines"),
    "fn_json_path": with_tables("SELECT strftime(scraped_at, '%Y-%m') AS month, count(*) AS offers FROM prices GROUP BY 1", "prices"),
    "fn_json_tolerant": "SELECT event_id, (props ->> '$.k')::INT AS k FROM events",
}
