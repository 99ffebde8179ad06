"""Flyer pages as boxes of text: which prices belong together, and which name is printed for a price.

Boxes and words come from any reader of images or PDF files. Pages are independent, so all joins are by page; within one,
positions are compared, and a page holds as many boxes as print fits on it. Joins are told to merge sorted rows: Spark takes
boxes that were exploded from a small column for no larger than it, and would gather them all in the driver to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import clean, fix_units
from feira.sources.domain import table

# Least confidences, and the layout as shares of the image: where prices stand to a badge, names to prices.
MIN_CONF, BADGE_MIN_CONF, NAME_MIN_CONF, PCT_TOLERANCE = 0.5, 0.3, 0.4, 1.0
CELL_LEFT, CELL_WIDTH, CELL_HEIGHT = 0.02, 0.25, 0.20
NAME_WIDTH, NAME_MARGIN_X, NAME_MARGIN_Y = 0.22, 0.012, 0.013
# How badges and labels are printed.
BADGE = r"^(\d{1,2})\s*%$"
LABEL = r"(?i)^\W*\d?\W*(de|por|c[aeo]d[ae])\W*$"

PAGE = ["flyer_id", "page"]


def box_price(text: Column) -> Column:
    """Cents of a price box: "4,99", "6.49", "499"; null for a text with letters or without two places."""
    plain = F.regexp_replace(text, r"[^\d,.]", "")
    parted, joined = r"^(\d{1,3})[.,](\d{2})$", r"^(\d{1,3}?)(\d{2})$"
    pattern = lambda p: (F.regexp_extract(plain, p, 1).try_cast("int") * 100 + F.regexp_extract(plain, p, 2).try_cast("int"))
    return F.when(text.rlike(r"\p{L}"), None).otherwise(F.coalesce(F.when(plain.rlike(parted), pattern(parted)), F.when(plain.rlike(joined), pattern(joined))))


def badge_pairs(boxes: DataFrame) -> DataFrame:
    """flyer_id, page, badge, regular, price (box ids), pct, regular_cents, price_cents: the one pair of prices in the cell
    of a discount badge that has its percentage; badges with no pair or several are left out.

    boxes (flyer_id, page, box, text, conf, x0, y0, x1, y1, width, height). Badges are served from the top: a price that an
    earlier badge took is no candidate for a later one, so the badges of a page are settled in rounds.
    """
    price = boxes.filter(F.col("conf") >= MIN_CONF).withColumn("cents", box_price(F.col("text"))).filter("cents is not null")
    badge = boxes.filter((F.col("conf") >= BADGE_MIN_CONF) & F.trim("text").rlike(BADGE)).withColumn("pct", F.regexp_extract(F.trim("text"), BADGE, 1).cast("int"))
    near = badge.select(*PAGE, F.col("box").alias("badge"), "pct", "x0", "y0", "y1", "width", "height").alias("b").join(price.select(*PAGE, F.col("box").alias("p"), "cents", F.col("x0").alias("px"), F.col("y0").alias("py")).hint("merge"), PAGE)
    near = near.filter(F.col("px").between(F.col("x0") - CELL_LEFT * F.col("width"), F.col("x0") + CELL_WIDTH * F.col("width")) & F.col("py").between(F.col("y1"), F.col("y1") + CELL_HEIGHT * F.col("height")))
    a = near.select(*PAGE, "badge", "pct", "y0", "x0", F.col("p").alias("regular"), F.col("cents").alias("regular_cents"))
    b = near.select(*PAGE, "badge", F.col("p").alias("price"), F.col("cents").alias("price_cents"))
    off = F.abs((1 - F.col("price_cents") / F.col("regular_cents")) * 100 - F.col("pct"))
    pairs = a.join(b.hint("merge"), [*PAGE, "badge"]).filter((F.col("regular") != F.col("price")) & (F.col("regular_cents") > F.col("price_cents")) & (off < PCT_TOLERANCE))

    mine = pairs.groupBy(*PAGE, "badge", "pct", "y0", "x0").agg(F.array_sort(F.collect_list(F.struct("regular", "price", "regular_cents", "price_cents"))).alias("pairs"))
    by = mine.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "badge", "pct", "pairs"))).alias("badges"))
    none = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<badge:bigint,pct:int,p:struct<regular:bigint,price:bigint,regular_cents:int,price_cents:int>>>").alias("out"))

    def settle(done: Column, b: Column) -> Column:
        free = F.filter(b["pairs"], lambda p: ~F.array_contains(done["used"], p["regular"]) & ~F.array_contains(done["used"], p["price"]))
        one = F.struct(b["badge"].alias("badge"), b["pct"].alias("pct"), free[0].alias("p"))
        taken = F.struct(F.concat(done["used"], F.array(free[0]["regular"], free[0]["price"])).alias("used"), F.concat(done["out"], F.array(one)).alias("out"))
        return F.when(F.size(free) == 1, taken).otherwise(done)

    out = by.select(*PAGE, F.explode(F.reduce("badges", none, settle)["out"]).alias("o"))
    return out.select(*PAGE, "o.badge", "o.pct", "o.p.*")


def bubble_names(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """flyer_id, page, badge, name: the lines of text left of a pair of prices, in reading order, sizes put right.

    Boxes whose centres lie within 0.6 of a box's height are one line, read from the left.
    """
    at = boxes.select(*PAGE, "box", "x0", "y0", "y1", "width", "height")
    de = at.select(*PAGE, F.col("box").alias("regular"), F.col("x0").alias("dx"), F.col("y0").alias("dy"), "width", "height")
    por = at.select(*PAGE, F.col("box").alias("price"), F.col("y1").alias("py"))
    bubble = pairs.join(de.hint("merge"), [*PAGE, "regular"]).join(por.hint("merge"), [*PAGE, "price"])
    text = boxes.filter((F.col("conf") >= NAME_MIN_CONF) & F.col("text").rlike(r"\p{L}") & ~F.col("text").rlike(LABEL)).select(*PAGE, "box", "text", "x0", "y0", "x1", "y1")
    mx, my = NAME_MARGIN_X * F.col("width"), NAME_MARGIN_Y * F.col("height")
    near = bubble.join(text.hint("merge"), PAGE).filter(
        (F.col("x1") <= F.col("dx") + mx) & (F.col("x0") >= F.col("dx") - NAME_WIDTH * F.col("width")) & (F.col("y0") >= F.col("dy") - my) & (F.col("y1") <= F.col("py") + my)
    )
    near = near.withColumn("centre", (F.col("y0") + F.col("y1")) / 2)
    by = near.groupBy(*PAGE, "badge").agg(F.array_sort(F.collect_list(F.struct("centre", "x0", "box", "text", (F.col("y1") - F.col("y0")).alias("h")))).alias("boxes"))
    # a line goes on while a box's centre is near that of the line's first box
    lines = F.reduce(
        "boxes",
        F.array().cast("array<struct<line:int,first:double,x0:double,text:string>>"),
        lambda done, b: F.concat(
            done,
            F.array(
                F.when(
                    (F.size(done) > 0) & (b["centre"] - F.element_at(done, -1)["first"] <= 0.6 * b["h"]),
                    F.struct(F.element_at(done, -1)["line"].alias("line"), F.element_at(done, -1)["first"].alias("first"), b["x0"].alias("x0"), b["text"].alias("text")),
                ).otherwise(F.struct((F.when(F.size(done) > 0, F.element_at(done, -1)["line"]).otherwise(0) + 1).alias("line"), b["centre"].alias("first"), b["x0"].alias("x0"), b["text"].alias("text")))
            ),
        ),
    )
    ordered = F.array_sort(F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["x0"].alias("x0"), x["text"].alias("text"))))
    words = F.filter(F.transform(ordered, lambda x: F.regexp_replace(x["text"], "^[ '\"`´“”]+|[ '\"`´“”]+$", "")), lambda w: w != "")
    out = by.select(*PAGE, "badge", fix_units(F.array_join(words, " ")).alias("name"))
    return out.filter(F.length(F.regexp_replace("name", r"[^\p{L}]", "")) >= 3)


# How far a name may be from its price, in points of a page of usual width; what a price is for.
MAX_PAIR_DISTANCE = 42.0
UNITS = {"cada": "", "un": "", "unid": "", "unidade": "", "quilo": " (kg)", "kg": " (kg)"}
INTEGER, WHOLE_PRICE = r"^\d{1,3}$", r"^\d{1,3},\d{2}$"


def page_prices(words: DataFrame) -> DataFrame:
    """flyer_id, page, price_id, cents, suffix and the box of prices printed in large figures after an R$.

    words (flyer_id, page, word, text, size, x0, x1, top, bottom, scale). The number starts where the R$ ends in print of
    1.8 times its size; smaller figures right after it, level with its top, are the cents. A price under "CPF" is for members only.
    """
    w = words.select(*PAGE, "word", "text", "size", "x0", "x1", "top", "bottom", "scale")
    right = lambda p: w.select(*PAGE, *[F.col(c).alias(f"{p}_{c}") for c in ("word", "text", "size", "x0", "x1", "top", "bottom")]).hint("merge")
    number = f"{INTEGER}|{WHOLE_PRICE}"
    sign = w.filter("text = 'R$'").join(right("i"), PAGE).filter(F.col("i_text").rlike(number) & (F.col("i_size") >= 1.8 * F.col("size")))
    sign = sign.filter(F.col("i_x0").between(F.col("x1") - 3 * F.col("scale"), F.col("x1") + 5 * F.col("scale")) & (F.col("i_top") - 2 * F.col("scale") <= F.col("top")) & (F.col("top") <= F.col("i_bottom")))
    sign = _nearest(sign, "word", F.col("i_x0"), F.col("i_word"))
    cents = sign.join(right("c"), PAGE, "left").filter(
        F.col("c_text").rlike(r"^\d{2}$") & (F.col("c_size") < F.col("i_size") * 0.85) & F.col("c_x0").between(F.col("i_x1") - 2 * F.col("scale"), F.col("i_x1") + 0.7 * F.col("i_size"))
        & F.col("c_top").between(F.col("i_top") - 4 * F.col("scale"), F.col("i_top") + 0.6 * F.col("i_size"))
    )
    cents = _nearest(cents, "word", F.col("c_x0"), F.col("c_word")).select(*PAGE, "word", "c_text", "c_x0", "c_x1", "c_top", "c_bottom")
    whole = F.col("i_text").rlike(r"[.,]")
    both = sign.join(cents.hint("merge"), [*PAGE, "word"], "left").filter(whole | F.col("c_text").isNotNull())
    value = F.when(whole, F.regexp_replace("i_text", r"[.,]", "").cast("int")).otherwise(F.col("i_text").cast("int") * 100 + F.col("c_text").cast("int"))
    part = lambda c: F.when(~whole, F.col(f"c_{c}"))
    priced = both.select(*PAGE, F.col("word").alias("price_id"), value.cast("int").alias("cents"), "scale", F.col("i_size").alias("figure"), F.least("x0", "i_x0", part("x0")).alias("x0"), F.greatest("x1", "i_x1", part("x1")).alias("x1"), F.least("top", "i_top", part("top")).alias("top"), F.greatest("bottom", "i_bottom", part("bottom")).alias("bottom")).filter("cents > 0")
    said = F.lower(F.regexp_replace("u_text", r"^[.,]+|[.,]+$", ""))
    unit = priced.join(right("u"), PAGE).filter(said.isin(*UNITS) & (F.col("u_x1") >= F.col("x0") - 2 * F.col("scale")) & (F.col("u_x0") <= F.col("x1") + 2 * F.col("scale")) & F.col("u_top").between(F.col("bottom") - 0.6 * F.col("figure"), F.col("bottom") + 8 * F.col("scale")))
    suffix = F.when(said.isin(*[k for k, v in UNITS.items() if v]), " (kg)").otherwise("")
    unit = _nearest(unit, "price_id", F.abs(F.col("u_top") - F.col("bottom")), F.col("u_word")).select(*PAGE, "price_id", suffix.alias("suffix"), "u_x0", "u_x1", "u_top", "u_bottom")
    middle = (F.col("m_x0") + F.col("m_x1")) / 2
    member = priced.join(right("m").filter("upper(m_text) = 'CPF'").hint("merge"), PAGE).filter(middle.between(F.col("x0") - 25 * F.col("scale"), F.col("x1") + 25 * F.col("scale")) & (F.col("top") - F.col("m_bottom")).between(-2 * F.col("scale"), 0.5 * F.col("figure")))
    out = priced.join(unit.hint("merge"), [*PAGE, "price_id"], "left").join(member.select(*PAGE, "price_id").distinct().hint("merge"), [*PAGE, "price_id"], "left_anti")
    return out.select(*PAGE, "price_id", "cents", F.coalesce("suffix", F.lit("")).alias("suffix"), "scale", F.least("x0", "u_x0").alias("x0"), F.greatest("x1", "u_x1").alias("x1"), F.least("top", "u_top").alias("top"), F.greatest("bottom", "u_bottom").alias("bottom"))


def _nearest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of several rows of one ``key`` of a page the first in ``order``."""
    first = Window.partitionBy(*PAGE, key).orderBy(*order)
    return df.withColumn("nearest_no", F.row_number().over(first)).filter("nearest_no = 1").drop("nearest_no")


def price_blocks(prices: DataFrame, blocks: DataFrame) -> DataFrame:
    """flyer_id, page, price_id, block, name, cents: each price with the block of text nearest above or beside it, each block
    once; the nearest pairs of a page are settled first.

    blocks (flyer_id, page, block, name, x0, x1, top, bottom).
    """
    b = blocks.select(*PAGE, "block", "name", *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "top", "bottom")])
    both = prices.join(b.hint("merge"), PAGE)
    aside = F.greatest(F.lit(0.0), F.col("b_x0") - F.col("x1"), F.col("x0") - F.col("b_x1"))
    above = F.col("top") - F.col("b_bottom")
    over = (above >= -6 * F.col("scale")) & (aside <= 0.6 * (F.col("x1") - F.col("x0")) + 8 * F.col("scale"))
    level = (above < -6 * F.col("scale")) & (F.col("b_top") < F.col("bottom")) & (F.col("b_bottom") > F.col("top")) & (aside > 0)
    cost = F.when(over, F.greatest(above, F.lit(0.0)) + 1.5 * aside).when(level, 12 * F.col("scale") + aside + 1.5 * F.abs(F.col("b_top") - F.col("top")) / 4)
    options = both.withColumn("cost", cost).filter(F.col("cost") <= MAX_PAIR_DISTANCE * F.col("scale"))
    options = options.select(*PAGE, "price_id", "block", F.concat(F.regexp_replace(F.trim("name"), r"\s+", " "), F.col("suffix")).alias("name"), "cents", "cost")

    by = options.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("cost", "price_id", "block", "name", "cents"))).alias("options"))
    none = F.array().cast("array<struct<cost:double,price_id:bigint,block:bigint,name:string,cents:int>>")

    def settle(done: Column, o: Column) -> Column:
        taken = F.exists(done, lambda x: (x["price_id"] == o["price_id"]) | (x["block"] == o["block"]))
        return F.when(taken, done).otherwise(F.concat(done, F.array(o)))

    out = by.select(*PAGE, F.explode(F.reduce("options", none, settle)).alias("o")).select(*PAGE, "o.price_id", "o.block", "o.name", "o.cents")
    return out.filter(F.length(F.regexp_replace(clean("name"), "[^a-z]", "")) >= 3)


def _first_lines(s, d) -> DataFrame:
    """The lines 1 to 5 of orders, of those with the same number the one that stands first in the table's files."""
    at = F.struct("_metadata.file_path", "_metadata.row_index")
    row = F.struct("l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    li = table(s, d, "lineitem").filter("l_linenumber <= 5").select("l_orderkey", "l_linenumber", row.alias("row"), at.alias("at"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("row", "at").alias("row")).select("l_orderkey", "l_linenumber", "row.*")


def _boxes(s, d) -> DataFrame:
    """Boxes of flyers made of order lines: a row of the page for each line, with a badge, two prices and a name."""
    li = _first_lines(s, d)
    k, cents = F.col("l_linenumber"), F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 10).cast("int") % 90_000 + 500
    pct = F.floor(F.col("l_discount") * 100).cast("int") + 11
    row = li.select(F.col("l_orderkey").alias("flyer_id"), F.lit(1).alias("page"), k.alias("k"), pct.alias("pct"), cents.alias("regular"), F.floor(cents * (100 - pct) / 100.0).cast("int").alias("price"), F.col("l_partkey").alias("part"))
    at = lambda i, text, x, y, w, conf=0.9: F.struct((F.col("k").cast("long") * 10 + i).alias("box"), text.alias("text"), F.lit(conf).cast("double").alias("conf"), F.lit(x).cast("double").alias("x0"), (F.col("k") * 400.0 + y).alias("y0"), F.lit(x + w).cast("double").alias("x1"), (F.col("k") * 400.0 + y + 20).alias("y1"))
    money = lambda c: F.concat((c / 100).cast("int").cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))
    boxes = F.array(
        at(0, F.concat(F.col("pct").cast("string"), F.lit("%")), 500, 0, 40), at(1, money(F.col("regular")), 510, 60, 60), at(2, F.when(F.col("k") % 2 == 0, F.col("price").cast("string")).otherwise(money(F.col("price"))), 520, 90, 60),
        at(3, F.concat(F.lit("Produto "), F.col("part").cast("string")), 330, 58, 80), at(4, F.lit("20Og"), 420, 61, 50), at(5, F.lit("De:"), 480, 60, 20), at(6, F.lit("faded"), 330, 90, 60, 0.1),
    )
    return row.select("flyer_id", "page", F.explode(boxes).alias("b")).select("flyer_id", "page", "b.*", F.lit(1000.0).alias("width"), F.lit(1600.0).alias("height"))


def _words_of_pages(s, d) -> tuple[DataFrame, DataFrame]:
    """Words and name blocks of pages made of order lines; every sixth price is for members."""
    li = _first_lines(s, d)
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("int") % 90_000 + 105
    row = li.select(F.col("l_orderkey").alias("flyer_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("k"), cents.alias("cents"), F.col("l_partkey").alias("part"))
    word = lambda i, text, size, x, y, w: F.struct((F.col("k").cast("long") * 10 + i).alias("word"), text.alias("text"), F.lit(size).cast("double").alias("size"), F.lit(x).cast("double").alias("x0"), F.lit(x + w).cast("double").alias("x1"), (F.col("k") * 150.0 + y).alias("top"), (F.col("k") * 150.0 + y + size).alias("bottom"))
    each = F.array(
        word(0, F.lit("R$"), 10, 100, 60, 12), word(1, (F.col("cents") / 100).cast("int").cast("string"), 30, 113, 55, 40), word(2, F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), 15, 155, 56, 15),
        word(3, F.when(F.col("part") % 4 == 0, "quilo").otherwise("Cada."), 8, 120, 86, 20), word(4, F.when((F.col("k") + F.col("flyer_id")) % 6 == 0, "CPF").otherwise("x"), 8, 120, 46, 20),
    )
    words = row.select("flyer_id", "page", F.explode(each).alias("w")).select("flyer_id", "page", "w.*", F.lit(1.0).alias("scale"))
    blocks = row.select("flyer_id", "page", F.col("k").cast("long").alias("block"), F.concat(F.lit("Produto  "), F.col("part").cast("string")).alias("name"), F.lit(95.0).alias("x0"), F.lit(180.0).alias("x1"), (F.col("k") * 150.0 + 20).alias("top"), (F.col("k") * 150.0 + 45).alias("bottom"))
    return words, blocks


def _q_blocks(s, d):
    words, blocks = _words_of_pages(s, d)
    return price_blocks(page_prices(words), blocks).select("flyer_id", F.col("block").alias("line"), "name", "cents")


def _q_names(s, d):
    boxes = _boxes(s, d)
    return bubble_names(boxes, badge_pairs(boxes)).select("flyer_id", F.col("badge").alias("badge"), "name")


QUERIES = {
    "jn_badge_prices": lambda s, d: badge_pairs(_boxes(s, d)).select("flyer_id", "badge", "pct", "regular_cents", "price_cents"),
    "jn_box_names": _q_names,
    "jn_price_block": _q_blocks,
}

_ROWS = "SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem WHERE l_linenumber <= 5"
_BADGE = f"""SELECT l_orderkey AS flyer_id, l_linenumber::BIGINT * 10 AS badge, pct, r AS regular_cents, floor(r * (100 - pct) / 100.0::DOUBLE)::INT AS price_cents, l_partkey AS part
 FROM (SELECT *, floor(l_discount * 100)::INT + 11 AS pct, floor(l_extendedprice / l_quantity / 10)::INT % 90000 + 500 AS r FROM ({_ROWS}))"""
ORACLE_SQL = {
    "jn_badge_prices": f"SELECT flyer_id, badge, pct, regular_cents, price_cents FROM ({_BADGE})",
    "jn_box_names": f"SELECT flyer_id, badge, 'Produto ' || part || ' 200g' AS name FROM ({_BADGE})",
    "jn_price_block": f"""SELECT l_orderkey AS flyer_id, l_linenumber::BIGINT AS line, 'Produto ' || l_partkey || CASE WHEN l_partkey % 4 = 0 THEN ' (kg)' ELSE '' END AS name, floor(l_extendedprice / l_quantity)::INT % 90000 + 105 AS cents
        FROM ({_ROWS}) WHERE (l_linenumber + l_orderkey) % 6 <> 0""",
}
