"""Queries over the published list: states, filters, ranks, deals, alternatives, nearness, baskets."""

from __future__ import annotations

import re
from unicodedata import combining, normalize

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import SIZE_WORD, clean, clean_sql, sizeless_name, words
from feira.functions.values import CENTER, EARTH_KM, discount_pct, haversine
from feira.plans.public import public_sql, public_tables, saved
from feira.sources.domain import NOW, branches, list_lines, with_tables
from feira.sources.files import new_folder

#: Prices of one product that differ by this factor or more are no saving but different units of sale.
SUSPECT = 3


def offer_state(now: Column) -> Column:
    """future, expired, stale, unavailable or current, in this order."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp("observed_at")) / 3600
    return (
        F.when(F.col("valid_from") > now, "future")
        .when(F.col("valid_until") < now, "expired")
        .when((F.col("channel") != "flyer") & (hours > F.col("ttl_hours")), "stale")
        .when(F.col("availability") == "unavailable", "unavailable")
        .otherwise("current")
    )


def rank_offers(offers: DataFrame, now: Column, conditions: bool = False, state: str = "current") -> DataFrame:
    """Priced offers in ``state``, without those only club members get unless ``conditions``."""
    own = offers.filter(F.col("price_cents").isNotNull() & (offer_state(now) == state))
    return own if conditions else own.filter(F.col("club").isNull())


def daily_deals(ranked: DataFrame, shown: DataFrame) -> DataFrame:
    """Products whose cheapest offer beats the next chain's by less than SUSPECT times, biggest saving first."""
    by_chain = ranked.groupBy("product_id", "retailer_id").agg(F.min(F.struct("price_cents", "id")).alias("o"))
    order = Window.partitionBy("product_id").orderBy("o.price_cents", "o.id")
    two = by_chain.withColumn("n", F.row_number().over(order)).filter("n <= 2").groupBy("product_id")
    pair = two.agg(F.min(F.struct("n", "o.price_cents", "o.id", "retailer_id")).alias("best"), F.max(F.struct("n", "o.price_cents", "o.id", "retailer_id")).alias("next"))
    b, x = F.col("best.price_cents"), F.col("next.price_cents")
    deals = pair.filter((F.col("next.n") == 2) & (x > b) & (x < b * SUSPECT))
    named = deals.join(shown.select(F.col("id").alias("product_id"), "name"), "product_id")
    return named.select("product_id", "name", b.alias("price_cents"), F.col("best.retailer_id").alias("retailer_id"), x.alias("next_cents"), (x - b).alias("saving")).orderBy(F.desc("saving"), "name", "product_id")


def matches_query(text: Column | str, query: str) -> Column:
    """Every typed word starts some word of the text; one with digits may also stand inside the compacted text."""
    plain = "".join(c for c in normalize("NFD", query) if not combining(c)).lower()
    typed = re.findall(r"[a-z0-9]+", plain)
    compact = F.regexp_replace(clean(text), "[^a-z0-9]+", "")
    starts = lambda w: F.exists(words(text), lambda x: x.startswith(w))
    out = F.lit(True)
    for w in typed:
        out = out & (starts(w) | compact.contains(w) if re.search(r"\d", w) else starts(w))
    return out


def relevance(text: Column | str, typed: list[str]) -> Column:
    """0: the name starts with the typed words; 1: they stand in a row inside; 2: its first word starts with the first; 3."""
    own = words(text)
    at = lambda i: F.reduce(F.array(*[F.lit(k) for k in range(len(typed))]), F.lit(True), lambda a, k: a & F.coalesce(F.get(own, i + k).startswith(F.get(F.array(*[F.lit(w) for w in typed]), k)), F.lit(False)))
    inside = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(own) - len(typed))), lambda i: (i + len(typed) <= F.size(own)) & at(i))
    return F.when(at(F.lit(0)), 0).when((F.size(own) > len(typed)) & inside, 1).when(F.get(own, F.lit(0)).startswith(typed[0]), 2).otherwise(3)


def search(shown: DataFrame, query: str, limit: int) -> DataFrame:
    """The best ``limit`` matches: first word first, shorter names, then A to Z; ``place``, and ``truncated``: whether there are more."""
    first = query.split()[0]
    hit = shown.filter(matches_query("name", query))
    starts = F.when(F.get(words("name"), F.lit(0)).startswith(first), 0).otherwise(1)
    order = (starts, F.length("name"), F.col("name"), F.col("id"))
    best = hit.orderBy(*order).limit(limit + 1)  # one more than shown tells that there are more
    best = best.withColumns({"place": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)), "found": F.count("*").over(Window.partitionBy(F.lit(0)))})
    return best.filter(F.col("place") <= limit).withColumn("truncated", F.col("found") > limit).drop("found")


def filter_products(shown: DataFrame, offers: DataFrame, now: Column, networks: list[int], min_discount: int, low: int | None, high: int | None) -> DataFrame:
    """Products with one current offer that meets everything at once: id, price, discount."""
    pct = discount_pct(F.col("price_cents"), F.col("regular_price_cents"))
    own = rank_offers(offers, now).withColumn("pct", pct)
    if networks:
        own = own.filter(F.col("retailer_id").isin(*networks))
    if low is not None:
        own = own.filter(F.col("price_cents") >= low)
    if high is not None:
        own = own.filter(F.col("price_cents") <= high)
    own = own.filter(F.col("pct") >= min_discount)
    best = own.groupBy(F.col("product_id").alias("id")).agg(F.min("price_cents").alias("price"), F.max("pct").alias("discount"))
    return shown.select("id", "name").join(best, "id")


def nearest_branches(branch: DataFrame, lat: float, lon: float) -> DataFrame:
    """chain, branch_id, km of the branch nearest to a point."""
    km = haversine(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    near = branch.withColumn("km", km).filter("km is not null").groupBy("chain").agg(F.min(F.struct("km", "id")).alias("b"))
    return near.select("chain", F.col("b.id").alias("branch_id"), F.col("b.km").alias("km"))


def cheapest(ranked: DataFrame) -> DataFrame:
    best = ranked.groupBy("product_id").agg(F.min(F.struct("price_cents", "id", "retailer_id")).alias("o"))
    return best.select("product_id", "o.price_cents", "o.id", "o.retailer_id")


def alternatives(shown: DataFrame, priced: DataFrame, n: int) -> DataFrame:
    """For each product up to ``n`` others of its kind (subcategory, else category, never Outros), priced ones first,
    then by id."""
    kind = F.when(F.col("subcategory") != "", F.concat(F.lit("s:"), F.col("subcategory"))).when(F.col("category") != "Outros", F.concat(F.lit("c:"), F.col("category")))
    own = _with_price(shown.withColumn("kind", kind), priced).select("id", "kind", "has")
    # only the first n + 1 of a kind can be among anyone's first n, so no kind is joined with itself
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("has"), "id"))).filter(F.col("kind").isNotNull() & (F.col("n") <= n + 1))
    other = ranked.select("kind", F.col("id").alias("other_id"), "n")
    met = own.join(other, "kind").filter("id <> other_id")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("n"))).filter(F.col("place") <= n).select("id", "other_id", "place")


def _with_price(shown: DataFrame, priced: DataFrame) -> DataFrame:
    """``shown`` with ``has``: 1 for products with a current price, else 0."""
    own = shown.join(priced.select(F.col("product_id").alias("id"), F.lit(1).alias("has")).distinct(), "id", "left")
    return own.withColumn("has", F.coalesce("has", F.lit(0)))


#: Ranges of a size scale for a factor of e.
SIZE_RANGES = 16


def nearest_sizes(actives: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """id, other_id, place: for each active (id, kind, unit, amount) the first ``n`` other members (id, kind, has, unit,
    amount) of its kind: with a price first, then of its unit, then of the closest size (ratio), then by id.

    Sizes are numbered in order within each (kind, has, unit), range by range; a size finds its place among them and looks up the
    n numbers on either side. Members of one size count by their first n + 1 ids, and actives of one size ask once, so a
    kind is never joined with itself and no task holds more than a range of sizes.
    """
    group = ["kind", "has", "unit"]
    first = members.withColumn("at", F.row_number().over(Window.partitionBy(*group, "amount").orderBy("id"))).filter(F.col("at") <= n + 1)
    sizes = first.groupBy(*group, "amount").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = actives.select("kind", F.col("amount").alias("own")).distinct()
    asked = asked.join(members.select(*group).distinct(), "kind")
    both = sizes.select(*group, "amount", "ids", F.lit(1).alias("is")).unionByName(asked.select(*group, F.col("own").alias("amount"), F.lit(None).cast("array<long>").alias("ids"), F.lit(0).alias("is")))
    both = both.withColumn("span", F.floor(F.ln("amount") * SIZE_RANGES))
    spans = both.groupBy(*group, "span").agg(F.sum("is").alias("k"))
    spans = spans.select(*group, "span", (F.sum("k").over(Window.partitionBy(*group).orderBy("span")) - F.col("k")).alias("before"))  # a few hundred ranges a group
    within = F.sum("is").over(Window.partitionBy(*group, "span").orderBy("amount", F.desc("is")).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("within", within).join(spans, [*group, "span"]).withColumn("number", F.col("within") + F.col("before"))
    known = placed.filter("is = 1").select(*group, "number", F.col("amount").alias("size"), "ids")
    sought = placed.filter("is = 0").select(*group, F.col("amount").alias("own"), F.explode(F.expr(f"sequence(greatest(1, number - {n}), number + {n})")).alias("number"))
    apart = F.round(F.abs(F.ln(F.col("size") / F.col("own"))), 9)
    met = sought.join(known, [*group, "number"]).select(*group, "own", apart.alias("apart"), F.explode("ids").alias("other_id"))
    near = Window.partitionBy(*group, "own").orderBy("apart", "other_id")
    met = met.withColumn("at", F.row_number().over(near)).filter(F.col("at") <= n + 1)  # of each unit, with and without a price
    listed = actives.select("id", "kind", F.col("unit").alias("own_unit"), F.col("amount").alias("own")).join(met, ["kind", "own"]).filter("id <> other_id")
    order = Window.partitionBy("id").orderBy(F.desc("has"), F.desc(F.col("unit") == F.col("own_unit")), "apart", "other_id")
    return listed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("id", "other_id", "place")


def alternatives_by_code(shown: DataFrame, priced: DataFrame, n: int) -> DataFrame:
    """id, other_id, place: up to ``n`` others of a product's fiscal code (``ncm``) and subcategory, or of the code alone where
    nothing else has both, by ``nearest_sizes``; products without a code have the list of ``alternatives``."""
    own = _with_price(shown, priced).withColumn("both", F.concat_ws("|", "ncm", F.coalesce("subcategory", F.lit(""))))
    coded = own.filter("ncm is not null")
    counts = coded.groupBy("both").agg(F.count("*").alias("same"))
    coded = coded.join(counts, "both").withColumn("kind", F.when(F.col("same") > 1, F.concat(F.lit("b:"), "both")).otherwise(F.concat(F.lit("n:"), "ncm")))
    size = F.col("amount").cast("double")
    of = lambda prefix, c: coded.select("id", F.concat(F.lit(prefix), c).alias("kind"), "has", "unit", size.alias("amount"))
    wide = coded.filter("same = 1").select("kind").distinct()
    members = of("b:", "both").unionByName(of("n:", "ncm").join(wide, "kind", "left_semi"))
    by_code = nearest_sizes(coded.select("id", "kind", "unit", size.alias("amount")), members, n)
    plain = alternatives(shown, priced, n).join(own.filter("ncm is null").select("id"), "id", "left_semi")
    return by_code.unionByName(plain)


def basket(lines: DataFrame, ranked: DataFrame) -> DataFrame:
    """What each list costs at each retailer that has any of it: covered, total, complete.

    A line takes the cheapest offer whose ``limit_per_customer`` (null: none) isn't below its quantity.
    """
    best = ranked.groupBy("product_id", "retailer_id", "limit_per_customer").agg(F.min("price_cents").alias("price_cents"))
    size = lines.groupBy("list_id").agg(F.count("*").alias("lines"))
    fits = F.coalesce(F.col("quantity") <= F.col("limit_per_customer"), F.lit(True))
    line = lines.join(best, "product_id").filter(fits).groupBy("list_id", "product_id", "quantity", "retailer_id").agg(F.min("price_cents").alias("price_cents"))
    got = line.groupBy("list_id", "retailer_id").agg(F.count("*").alias("covered"), F.sum(F.col("price_cents") * F.col("quantity")).alias("total"))
    return got.join(size, "list_id").select("list_id", "retailer_id", "covered", "total", (F.col("covered") == F.col("lines")).alias("complete"))


def store_estimates(baskets: DataFrame, near: DataFrame, chain_of: DataFrame) -> DataFrame:
    """Baskets with km and the flags cheapest (lowest complete total of the list) and nearest."""
    own = baskets.join(chain_of, "retailer_id").join(near.select("chain", "km"), "chain", "left")
    low = F.min(F.when(F.col("complete"), F.struct("total", "retailer_id"))).over(Window.partitionBy("list_id"))
    close = F.min(F.when(F.col("km").isNotNull(), F.struct("km", "retailer_id"))).over(Window.partitionBy("list_id"))
    own = own.withColumns({"low": low, "close": close})
    return own.select("list_id", "retailer_id", "covered", "total", "complete", F.round("km", 6).alias("km"), (F.col("low.retailer_id") == F.col("retailer_id")).alias("cheapest"), (F.col("close.retailer_id") == F.col("retailer_id")).alias("nearest"))


def group_by_size(shown: DataFrame, ranked: DataFrame) -> DataFrame:
    """Names that differ by size only, with the number of members, the first id and the range of prices."""
    low = cheapest(ranked).select(F.col("product_id").alias("id"), "price_cents")
    return shown.join(low, "id", "left").groupBy(clean(sizeless_name("name")).alias("line")).agg(F.count("*").alias("members"), F.min("id").alias("first_id"), F.min("price_cents").alias("low"), F.max("price_cents").alias("high"))


def lowest_label(ranked: DataFrame) -> DataFrame:
    """id, label: only price, lowest price, or a tie on it; null for the others."""
    w = Window.partitionBy("product_id")
    own = ranked.withColumns({"n": F.count("*").over(w), "low": F.min("price_cents").over(w), "tied": F.count("*").over(Window.partitionBy("product_id", "price_cents"))})
    text = F.when(F.col("price_cents") > F.col("low"), None).when(F.col("n") == 1, "single").when(F.col("tied") > 1, "tie").otherwise("lowest")
    return own.select("id", text.alias("label"))


def ranked_all(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with each row's place in one order of the whole table: rows are dealt by range, numbered within their range,
    and the rows of earlier ranges are added, so no task holds more than a range."""
    folder = new_folder(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()).write.parquet(folder)
    dealt = df.sparkSession.read.parquet(folder)
    before = Window.partitionBy(F.lit(0)).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("range_no").count().select("range_no", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return dealt.withColumn(name, own).join(F.broadcast(sizes), "range_no").withColumn(name, (F.col(name) + F.col("earlier")).cast("int")).drop("range_no", "earlier")


def dated(offers: DataFrame) -> DataFrame:
    """Offers with periods, flyers, sold-out ones and limits per customer, by number, so that every state occurs."""
    k = F.col("product_id")
    return offers.withColumns(
        {
            "valid_from": F.when(k % 11 == 0, F.col("observed_at") + F.expr("interval 2500 days")).cast("timestamp"),
            "valid_until": F.when(k % 7 == 0, F.col("observed_at") + F.expr("interval 300 days")).cast("timestamp"),
            "channel": F.when(k % 5 == 0, "flyer").otherwise("catalog"),
            "availability": F.when(k % 13 == 0, "unavailable").otherwise(F.col("availability")),
            "limit_per_customer": F.when((k + F.col("retailer_id")) % 3 == 0, 20),
        }
    )


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _offers(s, d):
    offers, shown = public_tables(s, d)
    return dated(offers), shown


def _ranked(s, d):
    offers, shown = _offers(s, d)
    return rank_offers(offers, _now()), shown


def _q_state(s, d):
    return _offers(s, d)[0].select("id", offer_state(_now()).alias("state"))


def _q_rank(s, d):
    return _ranked(s, d)[0].select("id", "product_id", "price_cents").orderBy("price_cents", "id")


def _q_last_known(s, d):
    own = rank_offers(_offers(s, d)[0], _now(), state="stale").filter("availability <> 'unavailable'")
    return own.select("id", "product_id", "price_cents").orderBy("price_cents", "id")


def _q_deals(s, d):
    return daily_deals(*_ranked(s, d))


def _q_token_prefix(s, d):
    return public_tables(s, d)[1].filter(matches_query("name", "pap hig")).select("id", "name")


def _q_payload_filters(s, d):
    offers, shown = public_tables(s, d)
    own = shown.filter(clean("source_name").contains("leite")).select(F.col("id").alias("product_id"))
    return offers.filter("retailer_id = 0 and channel = 'catalog'").join(own, "product_id", "left_semi").select("id", "product_id")


def _q_filters(s, d):
    offers, shown = _offers(s, d)
    return filter_products(shown, offers, _now(), [0, 1, 2], 5, 500, 3000)


def _near(s, d):
    return nearest_branches(branches(s, d), *CENTER)


def _q_nearby(s, d):
    offers = public_tables(s, d)[0]
    return offers.join(_near(s, d).filter("km <= 1.5"), F.col("retailer_name") == F.col("chain"), "left_semi").select("id")


def _q_nearest(s, d):
    return _near(s, d).select("chain", "branch_id", F.round("km", 6).alias("km"))


def _q_reach(s, d):
    offers = public_tables(s, d)[0].join(_near(s, d), F.col("retailer_name") == F.col("chain"), "left")
    return offers.agg(F.count(F.when(F.col("km") > 1.5, 1)).alias("outside"), F.count(F.when(F.col("km").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("club").isNotNull(), 1)).alias("conditional"))


def _q_priced(s, d):
    ranked, shown = _ranked(s, d)
    return shown.join(ranked.select(F.col("product_id").alias("id")).hint("merge"), "id", "left_semi").select("id")


def _q_spread(s, d):
    own = _ranked(s, d)[0].groupBy("product_id").agg((F.max("price_cents") / F.min("price_cents")).alias("r"))
    return own.select("product_id", F.round("r", 6).alias("spread"), (F.col("r") >= SUSPECT).alias("suspicious"))


def _q_departments(s, d):
    return public_tables(s, d)[1].groupBy("category").agg(F.count("*").alias("products")).orderBy(F.desc("products"), "category")


def priced_products(shown: DataFrame, ranked: DataFrame, near: DataFrame) -> DataFrame:
    """id, name, price, discount and km of each product: its lowest price, its largest discount, and how far the nearest
    branch of the chain with that price is (near: chain, km). Null without a price, or without a known branch."""
    pct = discount_pct(F.col("price_cents"), F.col("regular_price_cents"))
    best = ranked.groupBy(F.col("product_id").alias("id")).agg(F.min(F.struct("price_cents", F.col("id").alias("offer"), "retailer_name")).alias("o"), F.max(pct).alias("discount"))
    known = shown.select("id", "name").join(best, "id", "left").select("id", "name", F.col("o.price_cents").alias("price"), F.coalesce("discount", F.lit(0)).alias("discount"), F.col("o.retailer_name").alias("chain"))
    return known.join(near.select("chain", "km"), "chain", "left").drop("chain")


def sorted_products(known: DataFrame, query: str) -> DataFrame:
    """id and its place in each order of a list of products (``priced_products``): by_name, by_price, by_price_down, by_discount,
    by_discount_near and by_relevance to ``query``. Products without a price or distance come last, ties by id."""
    typed = words(F.lit(query))
    first = known.sparkSession.range(1).select(typed.alias("w")).first().w
    price, down, near = F.col("price").asc_nulls_last(), F.col("price").desc_nulls_last(), F.col("km").asc_nulls_last()
    orders = {
        "by_name": (clean("name"),),
        "by_price": (price,),
        "by_price_down": (down,),
        "by_discount": (F.desc("discount"), price),
        "by_discount_near": (F.desc("discount"), near),
        "by_relevance": (F.col("rank"), F.length("name"), F.col("name")) if first else (F.desc("discount"), near),
    }
    ranked = known.withColumn("rank", relevance("name", first) if first else F.lit(0))
    for name, order in orders.items():
        ranked = ranked_all(ranked, name, *order, F.col("id"))
    return ranked.select("id", *orders)


def todays_list(known: DataFrame, deals: DataFrame) -> DataFrame:
    """product_id, discount, km, deal, place: the best deal first, then priced products by discount and nearness."""
    best = deals.orderBy(F.desc("saving"), "name", "product_id").limit(1).select(F.col("product_id").alias("id"), F.lit(True).alias("deal"))
    own = known.filter("price is not null").join(F.broadcast(best), "id", "left").withColumn("deal", F.coalesce("deal", F.lit(False)))  # one row
    placed = ranked_all(own, "place", F.desc("deal"), F.desc("discount"), F.col("km").asc_nulls_last(), F.col("id"))
    return placed.select(F.col("id").alias("product_id"), "discount", F.round("km", 6).alias("km"), "deal", "place")


def _priced(s, d):
    ranked, shown = _ranked(s, d)
    ranked = saved(ranked, "ranked")
    return priced_products(shown, ranked, _near(s, d)), ranked, shown


def _q_today(s, d):
    known, ranked, shown = _priced(s, d)
    return todays_list(known, daily_deals(ranked, shown))


def _q_basket(s, d):
    return basket(list_lines(s, d), _ranked(s, d)[0])


def _q_estimates(s, d):
    offers, _ = _offers(s, d)
    ranked = rank_offers(offers, _now())
    chain_of = offers.select("retailer_id", F.col("retailer_name").alias("chain")).distinct()
    return store_estimates(basket(list_lines(s, d), ranked), _near(s, d), chain_of)


def _q_alternatives(s, d):
    ranked, shown = _ranked(s, d)
    code = F.when(F.col("id") % 7 != 0, F.lpad((F.col("id") * 7919 % 40).cast("string"), 8, "2"))
    return alternatives_by_code(saved(shown.withColumn("ncm", code), "shown"), saved(ranked.select("product_id").distinct(), "priced"), 8)


def _q_kind(s, d):
    ranked, shown = _ranked(s, d)
    return alternatives(shown, ranked, 8)


def _q_sizes(s, d):
    ranked, shown = _ranked(s, d)
    return group_by_size(shown, ranked)


def _q_relevance(s, d):
    shown = public_tables(s, d)[1]
    return shown.filter(matches_query("name", "leite integral")).select("id", relevance("name", ["leite", "integral"]).alias("rank")).orderBy("rank", "id")


def _q_sorts(s, d):
    return sorted_products(_priced(s, d)[0], "leite integral")


def _q_out(s, d):
    state = offer_state(_now())
    return _offers(s, d)[0].select("id", F.when(F.col("price_cents").isNull(), "no price").when(state != "current", state).alias("reason"))


QUERIES = {
    "flt_offer_state": _q_state,
    "flt_rank_offers": _q_rank,
    "flt_last_known": _q_last_known,
    "ord_daily_deals": _q_deals,
    "flt_token_prefix": _q_token_prefix,
    "flt_payload_filters": _q_payload_filters,
    "flt_product_filters": _q_filters,
    "flt_nearby": _q_nearby,
    "jn_nearest_branch": _q_nearest,
    "ag_reach_counts": _q_reach,
    "flt_priced_products": _q_priced,
    "ag_price_spread": _q_spread,
    "ag_departments": _q_departments,
    "ag_cheapest_per_product": lambda s, d: cheapest(_ranked(s, d)[0]),
    "ag_group_by_size": _q_sizes,
    "win_tie_count": lambda s, d: lowest_label(_ranked(s, d)[0]),
    "fn_lowest_label": lambda s, d: lowest_label(_ranked(s, d)[0]).filter("label is not null"),
    "fn_out_of_comparison": _q_out,
    "ord_today": _q_today,
    "ord_alternatives": _q_alternatives,
    "ord_alternatives_kind": _q_kind,
    "ord_search_rank": lambda s, d: search(public_tables(s, d)[1], "leite", 21).select("id", "name", "place", "truncated"),
    "ord_relevance": _q_relevance,
    "ord_filter_sorts": _q_sorts,
    "ag_basket_store": _q_basket,
    "ag_store_estimates": _q_estimates,
}

_DATED = """WITH dated AS (SELECT * REPLACE (CASE WHEN product_id % 5 = 0 THEN 'flyer' ELSE 'catalog' END AS channel, CASE WHEN product_id % 13 = 0 THEN 'unavailable' ELSE availability END AS availability),
  CASE WHEN product_id % 11 = 0 THEN observed_at + INTERVAL 2500 DAY END AS valid_from, CASE WHEN product_id % 7 = 0 THEN observed_at + INTERVAL 300 DAY END AS valid_until, CASE WHEN (product_id + retailer_id) % 3 = 0 THEN 20 END AS limit_per_customer FROM offers),
st AS (SELECT *, CASE WHEN valid_from > TIMESTAMP '{now}' THEN 'future' WHEN valid_until < TIMESTAMP '{now}' THEN 'expired'
  WHEN channel <> 'flyer' AND (epoch(TIMESTAMP '{now}') - epoch(observed_at)) / 3600.0 > ttl_hours THEN 'stale' WHEN availability = 'unavailable' THEN 'unavailable' ELSE 'current' END AS state FROM dated),
rk AS (SELECT *, CASE WHEN regular_price_cents > price_cents THEN floor((1 - price_cents / regular_price_cents::DOUBLE) * 100 + 0.5)::INT ELSE 0 END AS pct FROM st WHERE price_cents IS NOT NULL AND state = 'current' AND club IS NULL),
ch AS (SELECT product_id, retailer_id, min((price_cents, id)) AS o FROM rk GROUP BY ALL),
n2 AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY o) AS n FROM ch),
deals AS (SELECT a.product_id, s.name, a.o[1] AS price_cents, a.retailer_id, b.o[1] AS next_cents, b.o[1] - a.o[1] AS saving FROM n2 a JOIN n2 b ON a.product_id = b.product_id AND a.n = 1 AND b.n = 2
  JOIN shown s ON s.id = a.product_id WHERE b.o[1] > a.o[1] AND b.o[1] < a.o[1] * 3) """.replace("{now}", NOW)
_W = "regexp_extract_all(" + clean_sql("name") + ", '[a-z0-9]+')"
_LINE = clean_sql(f"coalesce(nullif(trim(regexp_replace(regexp_replace(name, '{SIZE_WORD}', ' ', 'g'), '\\s+', ' ', 'g')), ''), name)")
_HAV = f"2 * {EARTH_KM} * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h)))"
_NEAR = f"""near AS (SELECT chain, arg_min(id, (km, id)) AS branch_id, min(km) AS km FROM (SELECT *, {_HAV} AS km FROM (SELECT *, pow(sin(radians(latitude - {CENTER[0]}) / 2), 2) +
  cos(radians({CENTER[0]}::DOUBLE)) * cos(radians(latitude)) * pow(sin(radians(longitude - {CENTER[1]}) / 2), 2) AS h FROM branches)) GROUP BY chain)"""
_BASKET = """, bst AS (SELECT list_id, product_id, retailer_id, quantity, any_value(n) AS n, min(price_cents) AS price_cents FROM (SELECT *, count(*) OVER (PARTITION BY list_id) AS n FROM list_lines) JOIN rk USING (product_id)
    WHERE limit_per_customer IS NULL OR quantity <= limit_per_customer GROUP BY list_id, product_id, retailer_id, quantity),
 bsk AS (SELECT list_id, retailer_id, count(*) AS covered, sum(price_cents * quantity)::BIGINT AS total, count(*) = any_value(n) AS complete FROM bst GROUP BY list_id, retailer_id)"""


_PRICED = f""", {_NEAR}, pp AS (SELECT s.id, s.name, price, coalesce(discount, 0) AS discount, km FROM shown s LEFT JOIN (SELECT product_id, min(price_cents) AS price, max(pct) AS discount, arg_min(retailer_name, (price_cents, id)) AS chain FROM rk GROUP BY 1) b ON b.product_id = s.id LEFT JOIN near USING (chain))"""
_KD = ", kd AS (SELECT id, CASE WHEN subcategory <> '' THEN 's:' || subcategory WHEN category <> 'Outros' THEN 'c:' || category END AS kind FROM shown)"


def _sql(query: str, *more: str, extra: str = "") -> str:
    return public_sql(f"{_DATED}{extra} {query}", *more)


ORACLE_SQL = {
    "flt_offer_state": _sql("SELECT id, state FROM st"),
    "flt_rank_offers": _sql("SELECT id, product_id, price_cents FROM rk"),
    "flt_last_known": _sql("SELECT id, product_id, price_cents FROM st WHERE state = 'stale' AND availability <> 'unavailable' AND club IS NULL AND price_cents IS NOT NULL"),
    "ord_daily_deals": _sql("SELECT * FROM deals"),
    "flt_token_prefix": public_sql(f"SELECT id, name FROM shown WHERE len(list_filter({_W}, lambda w: starts_with(w, 'pap'))) > 0 AND len(list_filter({_W}, lambda w: starts_with(w, 'hig'))) > 0"),
    "flt_payload_filters": public_sql(f"SELECT o.id, product_id FROM offers o JOIN shown s ON s.id = product_id WHERE retailer_id = 0 AND contains({clean_sql('source_name')}, 'leite')"),
    "flt_product_filters": _sql("SELECT s.id, s.name, min(price_cents) AS price, max(pct) AS discount FROM rk JOIN shown s ON s.id = product_id WHERE retailer_id IN (0, 1, 2) AND pct >= 5 AND price_cents BETWEEN 500 AND 3000 GROUP BY ALL"),
    "flt_nearby": public_sql(f"WITH {_NEAR} SELECT id FROM offers WHERE retailer_name IN (SELECT chain FROM near WHERE km <= 1.5)", "branches"),
    "jn_nearest_branch": with_tables(f"WITH {_NEAR} SELECT chain, branch_id, round(km, 6) AS km FROM near", "branches"),
    "ag_reach_counts": public_sql(f"WITH {_NEAR} SELECT count(*) FILTER (WHERE km > 1.5) AS outside, count(*) FILTER (WHERE km IS NULL) AS unknown, count(club) AS conditional FROM offers LEFT JOIN near ON chain = retailer_name", "branches"),
    "flt_priced_products": _sql("SELECT id FROM shown WHERE id IN (SELECT product_id FROM rk)"),
    "ag_price_spread": _sql("SELECT product_id, round(max(price_cents) / min(price_cents)::DOUBLE, 6) AS spread, max(price_cents) >= 3 * min(price_cents) AS suspicious FROM rk GROUP BY 1"),
    "ag_departments": public_sql("SELECT category, count(*) AS products FROM shown GROUP BY 1"),
    "ag_cheapest_per_product": _sql("SELECT product_id, min(price_cents) AS price_cents, arg_min(id, (price_cents, id)) AS id, arg_min(retailer_id, (price_cents, id)) AS retailer_id FROM rk GROUP BY 1"),
    "ag_group_by_size": _sql(f"SELECT line, count(*) AS members, min(id) AS first_id, min(p) AS low, max(p) AS high FROM (SELECT s.id, {_LINE} AS line, p FROM shown s LEFT JOIN (SELECT product_id, min(price_cents) AS p FROM rk GROUP BY 1) c ON c.product_id = s.id) GROUP BY 1"),
    "win_tie_count": _sql("SELECT id, CASE WHEN price_cents > low THEN NULL WHEN n = 1 THEN 'single' WHEN tied > 1 THEN 'tie' ELSE 'lowest' END AS label FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS n, min(price_cents) OVER (PARTITION BY product_id) AS low, count(*) OVER (PARTITION BY product_id, price_cents) AS tied FROM rk)"),
    "fn_lowest_label": _sql("SELECT id, CASE WHEN n = 1 THEN 'single' WHEN tied > 1 THEN 'tie' ELSE 'lowest' END AS label FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS n, min(price_cents) OVER (PARTITION BY product_id) AS low, count(*) OVER (PARTITION BY product_id, price_cents) AS tied FROM rk) WHERE price_cents = low"),
    "fn_out_of_comparison": _sql("SELECT id, CASE WHEN state <> 'current' THEN state END AS reason FROM st"),
    "ord_today": _sql("""SELECT id AS product_id, discount, round(km, 6) AS km, coalesce(id = (SELECT product_id FROM deals ORDER BY saving DESC, name, product_id LIMIT 1), false) AS deal,
        row_number() OVER (ORDER BY coalesce(id = (SELECT product_id FROM deals ORDER BY saving DESC, name, product_id LIMIT 1), false) DESC, discount DESC, km ASC NULLS LAST, id) AS place FROM pp WHERE price IS NOT NULL""", "branches", extra=_PRICED),
    "ord_alternatives_kind": _sql("""SELECT a.id, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY (b.id IN (SELECT product_id FROM rk)) DESC, b.id) AS place FROM kd a JOIN kd b ON a.kind = b.kind AND a.id <> b.id
        QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (b.id IN (SELECT product_id FROM rk)) DESC, b.id) <= 8""", extra=_KD),
    "ord_alternatives": _sql("""SELECT a.id, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY b.has DESC, b.unit = a.unit DESC, round(abs(ln(b.amount / a.amount::DOUBLE)), 9), b.id) AS place
          FROM cd a JOIN cd b ON a.id <> b.id AND a.ncm = b.ncm AND (b.sub = a.sub OR a.same = 1)
          QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.has DESC, b.unit = a.unit DESC, round(abs(ln(b.amount / a.amount::DOUBLE)), 9), b.id) <= 8
        UNION ALL SELECT a.id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY (b.id IN (SELECT product_id FROM rk)) DESC, b.id) FROM kd a JOIN kd b ON a.kind = b.kind AND a.id <> b.id WHERE a.id % 7 = 0
          QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (b.id IN (SELECT product_id FROM rk)) DESC, b.id) <= 8""", extra=_KD + """,
        cd AS (SELECT *, count(*) OVER (PARTITION BY ncm, sub) AS same FROM (SELECT id, lpad((id * 7919 % 40)::VARCHAR, 8, '2') AS ncm, coalesce(subcategory, '') AS sub, unit, amount, (id IN (SELECT product_id FROM rk))::INT AS has FROM shown WHERE id % 7 <> 0))"""),
    "ord_search_rank": public_sql(f"SELECT id, name, row_number() OVER (ORDER BY starts_with({_W}[1], 'leite') DESC, length(name), name, id) AS place, count(*) OVER () > 21 AS truncated FROM shown WHERE len(list_filter({_W}, lambda w: starts_with(w, 'leite'))) > 0 QUALIFY place <= 21"),
    "ord_relevance": public_sql(f"""SELECT id, CASE WHEN starts_with(w[1], 'leite') AND starts_with(w[2], 'integral') THEN 0 WHEN len(list_filter(range(2, len(w)), lambda i: starts_with(w[i], 'leite') AND starts_with(w[i + 1], 'integral'))) > 0 THEN 1
        WHEN starts_with(w[1], 'leite') THEN 2 ELSE 3 END AS rank FROM (SELECT id, {_W} AS w FROM shown) WHERE len(list_filter(w, lambda x: starts_with(x, 'leite'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'integral'))) > 0"""),
    "ord_filter_sorts": _sql(f"""SELECT id, row_number() OVER (ORDER BY {clean_sql("name")}, id) AS by_name, row_number() OVER (ORDER BY price ASC NULLS LAST, id) AS by_price, row_number() OVER (ORDER BY price DESC NULLS LAST, id) AS by_price_down,
        row_number() OVER (ORDER BY discount DESC, price ASC NULLS LAST, id) AS by_discount, row_number() OVER (ORDER BY discount DESC, km ASC NULLS LAST, id) AS by_discount_near, row_number() OVER (ORDER BY rank, length(name), name, id) AS by_relevance
        FROM (SELECT *, CASE WHEN starts_with(w[1], 'leite') AND starts_with(w[2], 'integral') THEN 0 WHEN len(list_filter(range(2, len(w)), lambda i: starts_with(w[i], 'leite') AND starts_with(w[i + 1], 'integral'))) > 0 THEN 1
        WHEN starts_with(w[1], 'leite') THEN 2 ELSE 3 END AS rank FROM (SELECT *, {_W} AS w FROM pp))""", "branches", extra=_PRICED),
    "ag_basket_store": _sql("SELECT * FROM bsk", "list_lines", extra=_BASKET),
    "ag_store_estimates": _sql("""SELECT list_id, retailer_id, covered, total, complete, round(km, 6) AS km, (min(CASE WHEN complete THEN (total, retailer_id) END) OVER (PARTITION BY list_id))[2] = retailer_id AS cheapest,
        (min(CASE WHEN km IS NOT NULL THEN (km, retailer_id) END) OVER (PARTITION BY list_id))[2] = retailer_id AS nearest FROM bsk JOIN (SELECT DISTINCT retailer_id, retailer_name FROM offers) USING (retailer_id) LEFT JOIN near ON chain = retailer_name""", "list_lines", "branches", extra=_BASKET + ", " + _NEAR),
}
