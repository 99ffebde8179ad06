"""What a receipt would have cost at each chain: the same products, else goods of the same kind by their price per measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import name_tokens
from feira.functions.values import gtin_key
from feira.operators.offers import _DATED, _ranked
from feira.plans.public import public_sql, saved
from feira.sources.domain import receipt_lines

# The share of a product's words that goods of its kind carry, and how far their prices per measure may be apart.
WORD_SHARE, PRICE_FACTOR = 0.75, 3
#: Steps of a price scale for a factor of e, and levels of ranges over it that cover the allowed band.
STEPS, LEVELS = 256, 10

KIND = ["subcategory", "unit"]


def core_words(name: str, brand: str) -> Column:
    """The words that name a product, without those of its brand; repeated ones stay."""
    return F.filter(name_tokens(name), lambda w: ~F.array_contains(name_tokens(F.coalesce(F.col(brand), F.lit(""))), w))


def kinds_alike(anchors: DataFrame, goods: DataFrame) -> DataFrame:
    """(subcategory, unit, core, own): word lists ``core`` of anchors with the word sets ``own`` of goods that carry WORD_SHARE of them.

    A containment join: goods that lack as many words as an anchor may not lack can't qualify, so each anchor looks up only
    that many of its words, the rarest of its kind. Equal lists are compared once.
    """
    a = anchors.select(*KIND, "core").distinct().filter(F.size("core") >= 2)
    g = goods.select(*KIND, "own").distinct()
    carried = g.select(*KIND, "own", F.explode("own").alias("word"))
    often = carried.groupBy(*KIND, "word").agg(F.count("*").alias("n"))
    sought = a.select(*KIND, "core", F.explode("core").alias("word")).join(often, [*KIND, "word"], "left")
    sought = sought.groupBy(*KIND, "core").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("by"))
    least = F.ceil(F.size("core") * WORD_SHARE).cast("int")
    first = F.array_distinct(F.slice(F.col("by.word"), F.lit(1), F.size("core") - least + 1))
    met = sought.select(*KIND, "core", F.explode(first).alias("word")).join(carried, [*KIND, "word"]).select(*KIND, "core", "own").distinct()
    return met.filter(F.size(F.filter("core", lambda w: F.array_contains("own", w))) >= least)


def _step(price: Column) -> Column:
    return F.floor(F.ln(price) * STEPS)


def cheapest_alike(wanted: DataFrame, goods: DataFrame) -> DataFrame:
    """subcategory, unit, core, per (paid per measure), retailer_id, best (base, product_id, price_cents): at each retailer
    the goods alike with the lowest price per measure, of those whose cheapest price anywhere is within PRICE_FACTOR of ``per``.

    wanted (subcategory, unit, core, per), goods (subcategory, unit, own, product_id, retailer_id, price_cents, amount).
    The band is a range on a scale of the goods' lowest prices. Minima are kept for ranges of 1, 2, 4, ... steps of each set
    of words, and a band takes the few that make it up; goods at its ends are compared one by one. So work grows with lines and goods and
    never with their product.
    """
    base = F.col("price_cents") / F.col("amount")
    low = goods.groupBy("product_id").agg(F.min(base).alias("low"))
    priced = goods.withColumn("base", base).join(low, "product_id").withColumn("step", _step(F.col("low")))
    best = F.min(F.struct("base", "product_id", "price_cents")).alias("best")
    at_step = saved(priced.groupBy(*KIND, "own", "retailer_id", "step", "low").agg(best), "goods")
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    by_range = at_step.select(*KIND, "own", "retailer_id", "step", "best", levels).withColumn("node", F.expr("shiftright(step, level)"))
    by_range = by_range.groupBy(*KIND, "own", "level", "node", "retailer_id").agg(F.min("best").alias("best"))

    wanted = wanted.select(*KIND, "core", "per").distinct()
    pairs = wanted.join(kinds_alike(wanted, goods), [*KIND, "core"]).withColumns({"lo": _step(F.col("per") / PRICE_FACTOR), "hi": _step(F.col("per") * PRICE_FACTOR)})
    ends = pairs.withColumn("step", F.explode(F.expr("array_distinct(array(lo - 1, lo, lo + 1, hi - 1, hi, hi + 1))"))).join(at_step, [*KIND, "own", "step"])
    ratio = F.col("low") / F.col("per")
    ends = ends.filter((ratio <= PRICE_FACTOR) & (ratio >= 1 / PRICE_FACTOR)).select(*KIND, "core", "per", "retailer_id", "best")
    # steps lo + 2 to hi - 2, half open; on each level the odd node at either side belongs to the band
    spans = pairs.select(*KIND, "core", "per", "own", (F.col("lo") + 2).alias("a"), (F.col("hi") - 1).alias("z"), levels)
    spans = spans.withColumns({"a": F.expr("-shiftright(-a, level)"), "z": F.expr("shiftright(z, level)")}).filter("a < z")
    nodes = spans.withColumn("node", F.explode(F.expr("filter(array(if(pmod(a, 2) = 1, a, null), if(pmod(z, 2) = 1, z - 1, null)), x -> x is not null)")))
    inner = nodes.join(by_range, [*KIND, "own", "level", "node"]).select(*KIND, "core", "per", "retailer_id", "best")
    return ends.unionByName(inner).groupBy(*KIND, "core", "per", "retailer_id").agg(F.min("best").alias("best"))


def lines_at_chains(lines: DataFrame, product: DataFrame, ranked: DataFrame) -> DataFrame:
    """receipt_id, line_no, retailer_id, kind (same, similar), product_id, pack_cents, cost_cents, paid_cents (of the line).

    lines (receipt_id, line_no (once a receipt), product_id, paid_cents a piece, quantity), product (id, name, brand, gtin, subcategory, amount, unit,
    pack_count), ranked (product_id, retailer_id, price_cents): current ordinary offers. The product bought, by its barcode
    where it has one, goes before goods of its kind. Ties go to the lowest product_id.
    """
    own = lines.filter("paid_cents is not null").withColumnRenamed("product_id", "bought")
    size = (F.col("amount") * F.col("pack_count")).cast("double")
    code = gtin_key(F.coalesce("gtin", F.lit("")))
    named = product.select(
        F.col("id").alias("product_id"),
        F.when(code != "", F.concat(F.lit("g:"), code)).otherwise(F.concat(F.lit("p:"), F.col("id").cast("string"))).alias("key"),
        *KIND,
        size.alias("amount"),
        core_words("name", "brand").alias("core"),
        (F.coalesce("subcategory", F.lit("")) != "").alias("tagged"),
        (F.col("unit") != "un").alias("measured"),
    )
    named = saved(named, "goods")
    best = saved(ranked.groupBy("product_id", "retailer_id").agg(F.min("price_cents").alias("price_cents")), "goods")
    offered = best.join(named, "product_id")
    used = own.join(named.withColumnRenamed("product_id", "bought"), "bought")
    used = used.withColumn("per", F.when(F.col("tagged") & F.col("measured") & (F.col("subcategory") != "Outros"), F.col("paid_cents") / F.col("amount")))

    same = offered.groupBy("key", "retailer_id").agg(F.min(F.struct("price_cents", "product_id")).alias("o"))
    cents = lambda c: F.floor(c + 0.5).cast("long")
    row = lambda rank, cost, product_id, pack: F.struct(F.lit(rank).alias("rank"), cost.alias("cost"), product_id.alias("product_id"), pack.alias("pack"))
    line = ["receipt_id", "line_no", "paid_cents", "quantity"]
    first = used.join(same, "key").select(*line, "retailer_id", row(0, cents(F.col("o.price_cents") * F.col("quantity")), F.col("o.product_id"), F.col("o.price_cents")).alias("r"))
    goods = offered.filter("tagged and measured").withColumn("own", F.array_sort(F.array_distinct("core")))
    alike = cheapest_alike(used.filter("per > 0"), goods)
    other = used.filter("per > 0").join(alike, [*KIND, "core", "per"])
    other = other.select(*line, "retailer_id", row(1, cents(F.col("best.base") * (F.col("quantity") * F.col("amount"))), F.col("best.product_id"), F.col("best.price_cents")).alias("r"))
    at = first.unionByName(other).groupBy(*line, "retailer_id").agg(F.min("r").alias("r"))
    return at.select(
        "receipt_id", "line_no", "retailer_id", F.when(F.col("r.rank") == 0, "same").otherwise("similar").alias("kind"), "r.product_id", F.col("r.pack").alias("pack_cents"), F.col("r.cost").alias("cost_cents"),
        (F.col("paid_cents") * F.col("quantity")).alias("paid_cents"),
    )


def considered(lines: DataFrame, product: DataFrame) -> DataFrame:
    """receipt_id, line_no, paid of the lines that a comparison is about: with a price paid and a known product."""
    used = lines.filter("paid_cents is not null").join(product.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    return used.select("receipt_id", "line_no", (F.col("paid_cents") * F.col("quantity")).alias("paid"))


def compare_baskets(used: DataFrame, at: DataFrame) -> DataFrame:
    """receipt_id, retailer_id, covered, alike, missing (line numbers), total, paid (of covered lines), place, best_single.

    used: ``considered``; at: ``lines_at_chains``. Whole baskets come first, then those that lack least, then the cheapest.
    """
    every = used.groupBy("receipt_id").agg(F.array_sort(F.collect_list("line_no")).alias("every"))
    own = at.groupBy("receipt_id", "retailer_id").agg(
        F.count("*").alias("covered"), F.count(F.when(F.col("kind") == "similar", 1)).alias("alike"), F.collect_list("line_no").alias("has"), F.sum("cost_cents").alias("total"), F.sum("paid_cents").alias("paid")
    )
    own = own.join(every, "receipt_id").withColumn("lack", F.array_except("every", "has"))
    order = Window.partitionBy("receipt_id").orderBy(F.size("lack"), "total", "retailer_id")
    own = own.withColumn("place", F.row_number().over(order))
    text = F.array_join(F.transform("lack", lambda x: x.cast("string")), ",")
    return own.select("receipt_id", "retailer_id", "covered", "alike", text.alias("missing"), "total", "paid", "place", ((F.col("place") == 1) & (F.size("lack") == 0)).alias("best_single"))


def best_split(used: DataFrame, at: DataFrame, baskets: DataFrame) -> DataFrame:
    """receipt_id, considered, paid_all, lines, total, paid, retailers: each line where it is cheapest (ties: the better basket)."""
    line = at.join(baskets.select("receipt_id", "retailer_id", "place"), ["receipt_id", "retailer_id"])
    line = line.groupBy("receipt_id", "line_no").agg(F.min(F.struct("cost_cents", "place", "retailer_id", "paid_cents")).alias("b"))
    split = line.groupBy("receipt_id").agg(
        F.count("*").alias("lines"), F.sum("b.cost_cents").alias("total"), F.sum("b.paid_cents").alias("paid"), F.array_join(F.transform(F.array_sort(F.collect_set("b.retailer_id")), lambda x: x.cast("string")), ",").alias("retailers")
    )
    every = used.groupBy("receipt_id").agg(F.count("*").alias("considered"), F.sum("paid").alias("paid_all"))
    return every.join(split, "receipt_id", "left").select("receipt_id", "considered", "paid_all", F.coalesce("lines", F.lit(0)).alias("lines"), "total", "paid", F.coalesce("retailers", F.lit("")).alias("retailers"))


def _receipts(s, d) -> DataFrame:
    """Receipt lines, numbered anew as printed numbers repeat, with the cents paid a piece; some without."""
    paid = F.when(F.col("line_no") % 6 != 0, F.floor(F.col("unit_price") * 100 + 0.5))
    own = receipt_lines(s, d).withColumn("n", F.row_number().over(Window.partitionBy("receipt_id").orderBy("line_no", "product_id", "unit_price", "qty")))
    return own.select("receipt_id", F.col("n").alias("line_no"), "product_id", paid.cast("long").alias("paid_cents"), F.col("qty").cast("double").alias("quantity"))


def _short(name: Column) -> Column:
    """The first three words of a name and its size, so that goods of one kind share words."""
    return F.regexp_extract(name, r"^(\S+(?:\s+\S+){0,2})", 1)


def _compared(s, d):
    ranked, shown = _ranked(s, d)
    goods = saved(shown.withColumn("name", _short(F.col("name"))), "shown")
    lines = _receipts(s, d)
    return considered(lines, goods), saved(lines_at_chains(lines, goods, saved(ranked.select("product_id", "retailer_id", "price_cents"), "ranked")), "lines")


def _q_basket(s, d):
    return compare_baskets(*_compared(s, d))


def _q_split(s, d):
    used, at = _compared(s, d)
    return best_split(used, at, compare_baskets(used, at))


def _q_lines(s, d):
    return _compared(s, d)[1]


QUERIES = {"ag_receipt_basket": _q_basket, "ag_receipt_split": _q_split, "jn_receipt_alike": _q_lines}


def _sql(query: str) -> str:
    from feira.functions.text import ABBREVIATIONS, FILLERS, MULTI, SIZE, clean_sql

    def tokens(c: str) -> str:
        return f"""list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace({clean_sql(c)}, '{MULTI}', ' '), '{SIZE}', ' '), '([a-z])(\\d{{3,}})', '\\1 \\2', 'g'), '(\\d{{3,}})([a-z])', '\\1 \\2', 'g'), '[a-z0-9]+'),
        lambda w: coalesce(map {{{", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items())}}}[w], w)), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '\\d+') AND w NOT IN ({", ".join(f"'{w}'" for w in FILLERS)}))"""

    return public_sql(f"""{_DATED}, gd AS (SELECT id, subcategory, unit, (amount * pack_count)::DOUBLE AS amount, list_filter(tn, lambda w: NOT list_contains(tb, w)) AS core,
        CASE WHEN ltrim(regexp_replace(coalesce(gtin, ''), '\\D', '', 'g'), '0') <> '' THEN 'g:' || ltrim(regexp_replace(gtin, '\\D', '', 'g'), '0') ELSE 'p:' || id END AS key
        FROM (SELECT *, {tokens("regexp_extract(name, '^(\\S+(?:\\s+\\S+){0,2})', 1)")} AS tn, {tokens("coalesce(brand, '')")} AS tb FROM shown)),
      us AS (SELECT receipt_id, n AS line_no, product_id, floor(unit_price * 100 + 0.5)::BIGINT AS paid, qty::DOUBLE AS qty FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY line_no, product_id, unit_price, qty) AS n FROM receipt_lines) WHERE line_no % 6 <> 0 AND product_id IN (SELECT id FROM shown)),
      bp AS (SELECT product_id, retailer_id, min(price_cents) AS c FROM rk GROUP BY ALL), lw AS (SELECT product_id, min(c / amount) AS low FROM bp JOIN gd ON id = product_id GROUP BY 1),
      sm AS (SELECT key, retailer_id, min((c, product_id)) AS o FROM bp JOIN gd ON id = product_id GROUP BY ALL),
      near AS (SELECT a.id AS anchor, b.id AS other FROM gd a JOIN gd b USING (subcategory, unit) WHERE a.subcategory NOT IN ('', 'Outros') AND unit <> 'un' AND a.id <> b.id AND len(a.core) >= 2 AND b.id IN (SELECT product_id FROM bp)
        AND len(list_filter(a.core, lambda w: list_contains(b.core, w))) / len(a.core)::DOUBLE >= 0.75),
      found AS (SELECT receipt_id, line_no, paid, qty, sm.retailer_id, 0 AS rank, floor(o[1] * qty + 0.5)::BIGINT AS cost, o[2] AS pid, o[1] AS pack FROM us JOIN gd ON gd.id = us.product_id JOIN sm USING (key)
        UNION ALL SELECT receipt_id, line_no, paid, qty, bp.retailer_id, 1, floor(min(c / h.amount) * (qty * g.amount) + 0.5)::BIGINT, arg_min(other, (c / h.amount, other)), arg_min(c, (c / h.amount, other))
        FROM us JOIN gd g ON g.id = us.product_id JOIN near ON anchor = us.product_id JOIN gd h ON h.id = other JOIN bp ON bp.product_id = other JOIN lw ON lw.product_id = other
        WHERE paid > 0 AND low / (paid / g.amount) <= 3 AND low / (paid / g.amount) >= 1 / 3::DOUBLE GROUP BY receipt_id, line_no, paid, qty, bp.retailer_id, g.amount),
      ln AS (SELECT receipt_id, line_no, retailer_id, CASE WHEN rank = 0 THEN 'same' ELSE 'similar' END AS kind, pid AS product_id, pack AS pack_cents, cost AS cost_cents, paid * qty AS paid_cents FROM found
        QUALIFY row_number() OVER (PARTITION BY receipt_id, line_no, retailer_id ORDER BY rank) = 1),
      ev AS (SELECT receipt_id, list_sort(list(line_no)) AS every, count(*) AS considered, sum(paid * qty) AS paid_all FROM us GROUP BY 1),
      bk AS (SELECT receipt_id, retailer_id, count(*) AS covered, count(*) FILTER (WHERE kind = 'similar') AS alike, any_value(every) AS every, list(line_no) AS has, sum(cost_cents)::BIGINT AS total, sum(paid_cents) AS paid
        FROM ln JOIN ev USING (receipt_id) GROUP BY receipt_id, retailer_id),
      lk AS (SELECT *, list_filter(every, lambda x: NOT list_contains(has, x)) AS lack FROM bk),
      pl AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY len(lack), total, retailer_id) AS place FROM lk),
      sp AS (SELECT receipt_id, count(*) AS lines, sum(b[1])::BIGINT AS total, sum(b[4]) AS paid, array_to_string(list_sort(list(DISTINCT b[3])), ',') AS retailers
        FROM (SELECT receipt_id, line_no, min((cost_cents, place, retailer_id, paid_cents)) AS b FROM ln JOIN pl USING (receipt_id, retailer_id) GROUP BY ALL) GROUP BY 1)
      {query}""", "receipt_lines")  # fmt: skip


ORACLE_SQL = {
    "ag_receipt_basket": _sql("SELECT receipt_id, retailer_id, covered, alike, array_to_string(lack, ',') AS missing, total, paid, place, (place = 1 AND len(lack) = 0) AS best_single FROM pl"),
    "ag_receipt_split": _sql("SELECT receipt_id, considered, paid_all, coalesce(lines, 0) AS lines, total, paid, coalesce(retailers, '') AS retailers FROM ev LEFT JOIN sp USING (receipt_id)"),
    "jn_receipt_alike": _sql("SELECT * FROM ln"),
}
