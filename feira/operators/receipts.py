"""Receipts: matching lines to products, and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import name_tokens, parse_size
from feira.functions.values import word_similarity
from feira.operators.offers import _ranked
from feira.plans.public import public_sql
from feira.sources.domain import list_lines, prices, products, receipt_lines

# The price paid must be this near to a product's prices, and the next product this much further off.
PRICE_FITS, PRICE_CLEARLY_BETTER = 0.1, 0.15


def similar_words(printed: DataFrame, own: DataFrame) -> DataFrame:
    """p, o, sim of the words of ``printed`` (p) and ``own`` (o) that are alike at all.

    Each way of being alike has its own index: equal words; the first three letters, for beginnings; all forms with one letter
    left out, for one edit; and for left-out letters the printed word's rarest letter, which the other word must hold.
    """
    p, o = printed.select("p").filter("p <> ''").distinct(), own.select("o").filter("o <> ''").distinct()
    equal = p.join(o, F.col("p") == F.col("o"))
    begins = p.filter("length(p) >= 3").join(o, (F.substring("p", 1, 3) == F.substring("o", 1, 3)) & F.col("o").startswith(F.col("p")))

    def shorter(df: DataFrame, c: str) -> DataFrame:
        first = F.substring(c, 1, 1)  # the first letter is always the same
        cuts = F.transform(F.sequence(F.lit(2), F.greatest(F.length(c), F.lit(2))), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1)))
        return df.select(c, F.explode(F.array_distinct(F.concat(F.array(F.col(c)), cuts))).alias("cut"), first.alias("first"))

    edited = shorter(p.filter("length(p) >= 5"), "p").join(shorter(o.filter("length(o) >= 4"), "o"), ["first", "cut"])
    letters = o.select("o", F.explode(F.array_distinct(F.split("o", ""))).alias("letter"), F.substring("o", 1, 1).alias("first"))
    often = letters.groupBy("letter").agg(F.count("*").alias("n"))
    rarest = p.filter("length(p) >= 4").select("p", F.explode(F.array_distinct(F.split("p", ""))).alias("letter")).join(often, "letter", "left")
    rarest = rarest.groupBy("p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter")).alias("r")).select("p", F.col("r.letter").alias("letter"), F.substring("p", 1, 1).alias("first"))
    inside = rarest.join(letters, ["first", "letter"]).filter(F.length("o").between(F.length("p"), 2 * F.length("p")))
    met = reduce(DataFrame.unionAll, [x.select("p", "o") for x in (equal, begins, edited, inside)]).distinct()
    return met.withColumn("sim", word_similarity(F.col("p"), F.col("o"))).filter("sim > 0")


def match_lines(lines: DataFrame, product: DataFrame, margin: float = 0.1, least: float = 0.6, ranges: DataFrame | None = None) -> DataFrame:
    """line_id, product_id, score of the product that a printed name means, if one clearly is.

    lines (line_id, name, paid_cents if known), product (id, name, brand and gtin if known), ranges (product_id, low, high: its
    current prices in cents). A word weighs by how few products carry it; sizes must agree where both are known. Two words
    must be found (one where either side has only one), and the score must reach ``least``. Products within ``margin`` of the
    best tie: if all are one pack (size, and brand or barcode), the first with a price is it; else the price paid decides, if
    it is within PRICE_FITS of one product's prices and PRICE_CLEARLY_BETTER nearer than to the next.

    Words meet by ``similar_words``; lines of the same words are scored once, and so are products of the same words.
    """
    none = F.lit(None)
    col = lambda df, c, kind: (F.col(c) if c in df.columns else none).cast(kind).alias(c)
    own = product.select("id", F.array_sort(F.array_distinct(name_tokens("name"))).alias("own"), parse_size("name").alias("s"), col(product, "brand", "string"), col(product, "gtin", "string"))
    own = own.join(ranges.select(F.col("product_id").alias("id"), "low", "high"), "id", "left") if ranges is not None else own.withColumns({"low": none.cast("long"), "high": none.cast("long")})
    sizes = own.groupBy("own", "s", "brand", "gtin", "low", "high").agg(F.min("id").alias("product_id"), F.count("*").alias("members"))
    sets = own.groupBy("own").agg(F.min("id").alias("set_id"), F.count("*").alias("carriers")).withColumn("own_words", F.size("own"))
    printed = lines.select("line_id", F.array_sort(F.array_distinct(name_tokens("name"))).alias("printed"), parse_size("name").alias("t"), col(lines, "paid_cents", "double"))
    words = sets.select("set_id", "own_words", "carriers", F.explode("own").alias("o"))
    n = product.agg(F.count("*").alias("n"))
    weight = words.groupBy("o").agg(F.sum("carriers").alias("k")).crossJoin(n).select("o", (F.log((F.col("n") + 1) / (F.col("k") + 1)) + 1).alias("w"))
    alike = similar_words(printed.select(F.explode("printed").alias("p")), weight).join(weight, "o")
    met = printed.select("printed").distinct().select("printed", F.explode("printed").alias("p")).join(alike, "p").join(words.drop("carriers"), "o")
    by_word = met.groupBy("printed", "set_id", "own_words", "p").agg(F.max(F.struct("sim", "w")).alias("m")).select("printed", "set_id", "own_words", (F.col("m.sim") * F.col("m.w")).alias("v"), F.col("m.w").alias("w"), F.col("m.sim").alias("s0"))
    by = by_word.groupBy("printed", "set_id", "own_words").agg(F.sum("v").alias("v"), F.sum("w").alias("w"), F.count("*").alias("hit"), F.count(F.when(F.col("s0") >= 0.6, 1)).alias("found")).withColumn("words", F.size("printed"))
    by = by.withColumn("score", F.round(F.col("v") / (F.col("w") + (F.col("words") - F.col("hit")) * 2), 6))
    by = by.filter((F.col("score") >= least) & ((F.col("found") >= 2) | ((F.col("words") == 1) & (F.col("own_words") == 1)))).select("printed", "set_id", "score")
    offered = sizes.join(sets.select("own", "set_id"), "own").drop("own")
    by = by.join(offered, "set_id").join(printed.select("printed", "t", "paid_cents").distinct(), "printed")
    unknown = lambda c: (F.col(f"{c}.unit") == "un") & (F.col(f"{c}.amount") == 1)
    by = by.filter(unknown("t") | unknown("s") | ((F.col("t.unit") == F.col("s.unit")) & (F.col("t.amount") == F.col("s.amount"))))

    line = Window.partitionBy("printed", "t", "paid_cents")
    tied = by.withColumn("top", F.max("score").over(line)).filter(F.round(F.col("top") - F.col("score"), 6) < margin)
    best = F.struct((-F.col("score")).alias("score"), "product_id", "s", "brand", "gtin")
    tied = tied.withColumns({"first": F.min(best).over(line), "many": F.sum("members").over(line)})
    kept = lambda c: (F.coalesce(c, F.lit("")) != "") & (F.col(c) == F.col(f"first.{c}"))
    same = (F.col("s") == F.col("first.s")) & (F.coalesce(kept("brand"), F.lit(False)) | F.coalesce(kept("gtin"), F.lit(False)))
    paid = F.col("paid_cents")
    off = F.when(paid < F.col("low"), (F.col("low") - paid) / paid).when(paid > F.col("high"), (paid - F.col("high")) / paid).when(F.col("low").isNotNull() & paid.isNotNull(), 0.0)
    found = tied.withColumn("off", off).groupBy("printed", "t", "paid_cents").agg(
        F.first("first").alias("first"), F.first("many").alias("many"), F.min(same.cast("int")).alias("same"),
        F.min(F.when(F.col("low").isNotNull(), F.struct((-F.col("score")).alias("score"), "product_id"))).alias("priced"),
        F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.col("off").isNotNull(), F.array_repeat(F.struct("off", "product_id", "score"), F.least("members", F.lit(2)).cast("int")))))), 1, 2).alias("near"),
    )
    one, two = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    by_price = (one["off"] <= PRICE_FITS) & (two.isNull() | (two["off"] - one["off"] >= PRICE_CLEARLY_BETTER))
    first = F.struct((-F.col("first.score")).alias("score"), F.col("first.product_id").alias("product_id"))
    priced = F.struct((-F.col("priced.score")).alias("score"), F.col("priced.product_id").alias("product_id"))
    pick = F.when(F.col("many") == 1, first).when(F.col("same") == 1, F.when(F.col("priced").isNotNull(), priced).otherwise(first)).when(by_price, F.struct(one["score"].alias("score"), one["product_id"].alias("product_id")))
    clear = found.withColumn("pick", pick).filter("pick is not null").select("printed", "t", "paid_cents", "pick.product_id", "pick.score")
    keys = F.expr("l.printed = c.printed and l.t = c.t and l.paid_cents <=> c.paid_cents")
    return printed.alias("l").join(clear.alias("c"), keys).select("l.line_id", "c.product_id", "c.score")


def verdicts(lines: DataFrame, ranked: DataFrame) -> DataFrame:
    """receipt_id, line_no, product_id, verdict (below, inside, above the current prices, or no price), overpaid cents."""
    span = ranked.groupBy("product_id").agg(F.min("price_cents").alias("low"), F.max("price_cents").alias("high"))
    paid = F.floor(F.col("unit_price") * 100 + 0.5).cast("int")
    own = lines.withColumn("paid", paid).join(span, "product_id", "left")
    verdict = F.when(F.col("low").isNull(), "no price").when(F.col("paid") < F.col("low") - 1, "below").when(F.col("paid") > F.col("high") + 1, "above").otherwise("inside")
    over = F.greatest(F.lit(0), F.col("paid") - F.coalesce("low", "paid"))
    return own.select("receipt_id", "line_no", "product_id", "paid", verdict.alias("verdict"), over.alias("overpaid"))


def _q_receipt_name(s, d):
    p = products(s, d)
    lines = p.select(F.col("id").alias("line_id"), F.upper(F.regexp_replace("name", "(?i)(leite|queijo|carne|integral)([a-z]*)", "$1")).alias("name"))
    cents = F.floor(F.col("price") * 100 + 0.5).cast("long")
    ranges = prices(s, d).groupBy("product_id").agg(F.min(cents).alias("low"), F.max(cents).alias("high"))
    return match_lines(lines.withColumn("paid_cents", F.when(F.col("line_id") % 2 == 0, F.col("line_id") % 7 * 100 + 95000)), p, ranges=ranges)


def _sample(s, d):
    return receipt_lines(s, d)


def receipt_report(judged: DataFrame, wanted: DataFrame) -> DataFrame:
    """receipt_id, lines, above, unpriced, overpaid of the judged lines (``verdicts``), and not_bought: the products of the shopping
    list behind a receipt (wanted: receipt_id, product_id) that aren't on it, comma-joined."""
    report = judged.groupBy("receipt_id").agg(
        F.count("*").alias("lines"), F.count(F.when(F.col("verdict") == "above", 1)).alias("above"), F.count(F.when(F.col("verdict") == "no price", 1)).alias("unpriced"), F.sum("overpaid").alias("overpaid")
    )
    left = wanted.select("receipt_id", "product_id").distinct().join(judged.select("receipt_id", "product_id"), ["receipt_id", "product_id"], "left_anti")
    left = left.groupBy("receipt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("product_id")), lambda x: x.cast("string")), ",").alias("not_bought"))
    return report.join(left, "receipt_id", "left").withColumn("not_bought", F.coalesce("not_bought", F.lit("")))


def _q_report(s, d):
    wanted = list_lines(s, d).select(F.col("list_id").alias("receipt_id"), F.when(F.col("product_id") % 4 == 0, F.col("product_id") + 1).otherwise(F.col("product_id")).alias("product_id"))
    return receipt_report(verdicts(_sample(s, d), _ranked(s, d)[0]), wanted)


QUERIES = {
    "jn_receipt_name": _q_receipt_name,
    "ag_receipt_report": _q_report,
}


def _sql(query: str, *more: str) -> str:
    from feira.operators.offers import _DATED

    return public_sql(f"{_DATED} {query}", *more)


ORACLE_SQL = {
    "ag_receipt_report": _sql("""SELECT receipt_id, count(*) AS lines, count(*) FILTER (WHERE paid > high + 1) AS above, count(*) FILTER (WHERE low IS NULL) AS unpriced, sum(greatest(0, paid - coalesce(low, paid)))::BIGINT AS overpaid, coalesce(any_value(nb), '') AS not_bought
        FROM (SELECT *, floor(unit_price * 100 + 0.5)::INT AS paid FROM receipt_lines) LEFT JOIN (SELECT product_id, min(price_cents) AS low, max(price_cents) AS high FROM rk GROUP BY 1) USING (product_id)
        LEFT JOIN (SELECT receipt_id, string_agg(p::VARCHAR, ',' ORDER BY p) AS nb FROM (SELECT DISTINCT list_id AS receipt_id, CASE WHEN product_id % 4 = 0 THEN product_id + 1 ELSE product_id END AS p FROM list_lines) w
          WHERE NOT EXISTS (SELECT 1 FROM receipt_lines r WHERE r.receipt_id = w.receipt_id AND r.product_id = w.p) GROUP BY 1) USING (receipt_id) GROUP BY 1""", "receipt_lines", "list_lines"),
}
