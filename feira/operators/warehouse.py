"""Taxonomy, fiscal codes, classification and quality of the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import clean_sql, content_words
from feira.functions.values import clamp_confidence, placeholder_host
from feira.plans.public import public_sql, public_tables
from feira.sources.domain import branches, code_table, list_lines, products, receipt_lines, table, taxonomy, with_tables

#: Matches of a text in the code table, and the score from which the best one counts.
TOP_CODES = 40
LEAST_SCORE = 2
#: Sets of code words from which a word is common: it joins no single texts and codes.
COMMON_WORD = 200


def subtree_leaves(tree: DataFrame) -> DataFrame:
    """slug, leaf: every leaf at or below every node; by following parents upward, level by level."""
    parents = tree.select(F.col("slug").alias("child"), F.col("parent_slug").alias("above"))
    level = tree.filter("is_leaf").select(F.col("slug").alias("slug"), F.col("slug").alias("leaf"))
    out = level
    for _ in range(tree.agg(F.max("depth")).first()[0] or 0):
        level = level.join(parents, F.col("slug") == F.col("child")).filter("above is not null").select(F.col("above").alias("slug"), "leaf")
        out = out.unionByName(level)
    return out


def resolve_slugs(answers: DataFrame, tree: DataFrame) -> DataFrame:
    """Answers (id, slug) with ``resolved``: a slug of the tree, or the slug of a path; invented ones are null."""
    by_slug = tree.select("slug", F.col("slug").alias("a"))
    by_path = tree.select(F.col("path").alias("slug"), F.col("slug").alias("b"))
    return answers.join(by_slug, "slug", "left").join(by_path, "slug", "left").select("id", F.coalesce("a", "b").alias("resolved"))


def code_parents(codes: DataFrame) -> DataFrame:
    """code, parent: the nearest shorter code that exists, of 6, 4 or 2 digits."""
    out = codes.select("code")
    for n in (6, 4, 2):
        own = codes.select(F.col("code").alias(f"p{n}"))
        out = out.join(own, (F.length("code") > n) & (F.substring("code", 1, n) == F.col(f"p{n}")), "left")
    return out.select("code", F.coalesce("p6", "p4", "p2").alias("parent"))


def longest_prefix(df: DataFrame, code: str, table_: DataFrame, value: str) -> DataFrame:
    """``df`` with ``value`` of the longest of 8, 6 and 4 digits that ``table_`` (prefix, value) has."""
    out = df
    for n in (8, 6, 4):
        own = table_.filter(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col(value).alias(f"_v{n}"))
        out = out.join(own, F.substring(code, 1, n) == F.col(f"_p{n}"), "left")
    return out.withColumn(value, F.coalesce("_v8", "_v6", "_v4")).drop(*[f"_{k}{n}" for k in "pv" for n in (8, 6, 4)])


def token_overlap(text: DataFrame, codes: DataFrame, top: int = TOP_CODES, common: int = COMMON_WORD) -> DataFrame:
    """The best codes (8 digits) of each text (id, words) by shared words less a twentieth for each further word of the
    code; through an inverted index, so only pairs that share a word are met.

    Texts of the same words are scored once, and so are codes of the same words, of which the first ``top`` by length and
    code are all that a text can take. A set of codes is opened only while better sets leave room for it.

    Words that more than ``common`` sets hold join no texts with codes. What texts and codes share of them depends on their
    common words alone, so those are scored once for all texts of the same common words, against all codes of the same common
    words and size. The best ``top`` of that are enough: a code's other shared words only raise its score, so whatever ranks
    behind these ``top`` and shares nothing else ranks behind them for every such text.
    """
    bag = F.array_join(F.array_sort("words"), " ")
    own = text.select("id", bag.alias("bag"))
    named = codes.filter(F.length("code") == 8).select("code", F.length("description").alias("len"), F.array_sort(content_words("description")).alias("own"))
    named = named.withColumn("set", F.array_join("own", " "))
    c = named.select("set", "own").dropDuplicates(["set"]).select("set", F.size("own").alias("n"), F.explode("own").alias("word"))
    frequent = c.groupBy("word").agg(F.count("*").alias("sets")).filter(F.col("sets") > common).select("word", F.lit(True).alias("often"))
    w = text.select(bag.alias("bag"), "words").dropDuplicates(["bag"]).select("bag", F.explode("words").alias("word"))
    w, c = (x.join(frequent, "word", "left") for x in (w, c))
    shared_words = F.array_sort(F.collect_list(F.when(F.col("often"), F.col("word"))))
    bags, sets = w.groupBy("bag").agg(shared_words.alias("bw")), c.groupBy("set", "n").agg(shared_words.alias("cw"))
    score = F.round(F.col("shared") - (F.col("n") - F.col("shared")) * 0.05, 4)

    def best_sets(met: DataFrame, by: str) -> DataFrame:
        """Sets that ``top`` codes of better ones don't shut out."""
        better = F.sum("codes").over(Window.partitionBy(by).orderBy(F.desc("score"))) - F.sum("codes").over(Window.partitionBy(by, "score"))
        return met.withColumn("better", better).filter(F.col("better") < top)

    def first_codes(df: DataFrame, *by: str) -> DataFrame:
        """The first ``top`` codes of each set, and how many they are."""
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("len", "code"))
        held = F.least(F.count("*").over(Window.partitionBy(*by)), F.lit(top))
        return df.withColumns({"i": rank, "codes": held}).filter(F.col("i") <= top).drop("i")

    members = first_codes(named.select("set", "len", "code"), "set")
    rare = w.filter("often IS NULL").join(c.filter("often IS NULL").drop("often"), "word").groupBy("bag", "set", "n").agg(F.count("*").alias("rare"))
    rare = rare.join(bags, "bag").join(sets.select("set", "cw"), "set").withColumn("shared", F.col("rare") + F.size(F.array_intersect("bw", "cw")))
    sizes = members.groupBy("set").agg(F.first("codes").alias("codes"))
    met = best_sets(rare.select("bag", "set", score.alias("score")).join(sizes, "set"), "bag")
    opened = met.join(members.select("set", "len", "code"), "set").select("bag", "score", "len", "code")

    grouped = first_codes(named.join(sets.filter(F.size("cw") > 0), "set").select(F.array_join("cw", " ").alias("cw"), "n", "len", "code"), "cw", "n")
    groups = grouped.groupBy("cw", "n").agg(F.first("codes").alias("codes")).select("cw", "n", "codes", F.explode(F.split("cw", " ")).alias("word"))
    asked = bags.filter(F.size("bw") > 0).select("bag", F.array_join("bw", " ").alias("bw"))
    alike = asked.select("bw").distinct().select("bw", F.explode(F.split("bw", " ")).alias("word")).join(groups, "word")
    alike = best_sets(alike.groupBy("bw", "cw", "n", "codes").agg(F.count("*").alias("shared")).select("bw", "cw", "n", "codes", score.alias("score")), "bw")
    reached = alike.join(grouped.drop("codes"), ["cw", "n"])
    rank = F.row_number().over(Window.partitionBy("bw").orderBy(F.desc("score"), "len", "code"))
    reached = reached.withColumn("i", rank).filter(F.col("i") <= top).select("bw", "score", "len", "code")

    both = opened.unionByName(asked.join(reached, "bw").drop("bw")).groupBy("bag", "code").agg(F.max("score").alias("score"), F.first("len").alias("len"))
    place = F.row_number().over(Window.partitionBy("bag").orderBy(F.desc("score"), "len", "code"))
    best = both.withColumn("place", place).filter(F.col("place") <= top)
    return own.join(best.select("bag", "code", "score", "place"), "bag").select("id", "code", "score", "place")


def overlap_best(overlap: DataFrame) -> DataFrame:
    """The best code where its score is LEAST_SCORE or more, with a confidence of at most 0.7."""
    best = overlap.filter((F.col("place") == 1) & (F.col("score") >= LEAST_SCORE))
    return best.select("id", "code", F.round(F.least(F.lit(0.7), 0.25 + 0.1 * F.col("score")), 6).alias("confidence"))


def resolve_codes(product: DataFrame, by_gtin: DataFrame, by_category: DataFrame) -> DataFrame:
    """id, code, source: the barcode's answer, else the category's, else what the product has."""
    own = product.join(by_gtin, "gtin", "left").join(by_category, "category", "left")
    code = F.coalesce("gtin_code", "category_code", "code")
    source = F.when(F.col("gtin_code").isNotNull(), "gtin").when(F.col("category_code").isNotNull(), "category").when(F.col("code").isNotNull(), "kept").otherwise("none")
    return own.select("id", code.alias("code"), source.alias("source"))


def review_queue(answers: DataFrame, least: float = 0.7) -> DataFrame:
    """id, reason of answers that people must look at: low confidence, or none."""
    reason = F.when(F.col("resolved").isNull(), "no answer").when(F.col("confidence") < least, "low confidence")
    return answers.select("id", reason.alias("reason")).filter("reason is not null")


def code_coverage(resolved: DataFrame) -> DataFrame:
    """source, products, total, coded, share: products (code, source) by where their code is from ("none" without one), and of all of
    them how many have one and their share."""
    by = resolved.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("products"), F.count("code").alias("own"))
    every = Window.partitionBy(F.lit(0))  # a row for each source
    return by.select("source", "products", F.sum("products").over(every).alias("total"), F.sum("own").over(every).alias("coded"), F.round(F.sum("own").over(every) / F.sum("products").over(every), 6).alias("share"))


def product_problems(shown: DataFrame) -> DataFrame:
    """id, rule of each rule of a published product that it breaks: unit, amount, pack, brand, gtin."""
    rules = {
        "unit": ~F.coalesce(F.col("unit").isin("g", "ml", "un"), F.lit(False)),
        "amount": ~F.coalesce(F.col("amount").between(1, 1_000_000), F.lit(False)),
        "pack": ~F.coalesce(F.col("pack_count").between(1, 1000), F.lit(False)),
        "brand": F.coalesce("brand", F.lit("")) == "",
        "gtin": F.col("gtin").isNotNull() & ~F.col("gtin").rlike(r"^(\d{8}|\d{12,14})$"),
    }
    broken = F.array_compact(F.array(*[F.when(broken, rule) for rule, broken in rules.items()]))
    return shown.select("id", F.explode(broken).alias("rule"))


def missing_lines(lines: DataFrame) -> DataFrame:
    """receipt_id, missing (printed line numbers that a receipt skips, comma-joined), of receipts that skip any."""
    return receipt_flags(lines).filter("missing <> ''").select("receipt_id", "missing")


def missing(want: DataFrame, have: DataFrame, *key: str) -> DataFrame:
    """The ``key`` columns of what is wanted and not there, each once; nulls are compared like values."""
    return want.select(*key).subtract(have.select(*key))


def receipt_flags(lines: DataFrame) -> DataFrame:
    """receipt_id, bad_math (lines whose sum is off by over 0.03), missing (line numbers), repeated (line numbers)."""
    off = F.abs(F.col("qty") * F.col("unit_price") - F.col("discount") - F.col("total")) > 0.03
    by = lines.groupBy("receipt_id").agg(F.count(F.when(off, 1)).alias("bad_math"), F.array_sort(F.collect_set("line_no")).alias("have"), F.count("*").alias("n"))
    span = F.sequence(F.array_min("have"), F.array_max("have"))
    return by.select("receipt_id", "bad_math", F.array_join(F.array_except(span, "have"), ",").alias("missing"), (F.col("n") - F.size("have")).alias("repeated"))


def offer_findings(offers: DataFrame, shown: DataFrame, live: int | None, retailers: DataFrame | None = None, with_flyers: DataFrame | None = None) -> DataFrame:
    """level, finding, n: what stops or qualifies a snapshot before it replaces one of ``live`` offers (None: unknown).

    Without offers nothing else is said. Errors: offers without a valid price or product, and under half of the live ones.
    Warnings: each of ``retailers`` (retailer_name) without an offer, unless it has a flyer (with_flyers: retailer_name), and
    an unknown live number.
    """
    known = shown.select(F.col("id").alias("product_id"), F.lit(1).alias("k")).distinct()
    a = offers.join(known, "product_id", "left").agg(F.count("*").alias("n"), F.count(F.when(F.coalesce(F.col("price_cents") <= 0, F.lit(True)) | F.col("k").isNull(), 1)).alias("broken"))
    rule = lambda level, when, finding, n: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(finding).alias("finding"), n.cast("long").alias("n")))
    some = F.col("n") > 0
    rules = [rule("error", ~some, "no offers", F.col("n")), rule("error", F.col("broken") > 0, "no valid price or product", F.col("broken"))]
    rules.append(rule("warning", some, "live offers unknown", F.lit(0)) if live is None else rule("error", some & (F.col("n") < live * 0.5), "under half of the live offers", F.col("n")))
    out = a.select(F.explode(F.array_compact(F.array(*rules))).alias("r")).select("r.*")
    if retailers is not None:
        silent = retailers.select("retailer_name").distinct().join(offers.select("retailer_name").distinct(), "retailer_name", "left_anti")
        silent = silent if with_flyers is None else silent.join(with_flyers.select("retailer_name").distinct(), "retailer_name", "left_anti")
        silent = silent.join(F.broadcast(a.filter(some).select(F.lit(0).cast("long").alias("n"))))  # one row, or none
        out = out.unionByName(silent.select(F.lit("warning").alias("level"), F.concat(F.lit("no offers of "), "retailer_name").alias("finding"), "n"))
    return out


def html_links(pages: DataFrame, keywords: tuple[str, ...], base: str, limit: int) -> DataFrame:
    """page_id, url, place (from 1): the first ``limit`` different links of each page (page_id, html) whose address or text
    holds one of the keywords; relative ones are completed by ``base``. Links in other quotes or without are found too."""
    link = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)[^>]*>(.*?)</a>"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("text"))
    each = pages.select("page_id", F.posexplode(both).alias("i", "x")).select("page_id", "i", F.col("x.href").alias("href"), F.lower(F.regexp_replace("x.text", "<[^>]*>", "")).alias("text"))
    wanted = F.lit(False)
    for k in keywords:
        wanted = wanted | F.lower("href").contains(k) | F.col("text").contains(k)
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("href", "^/+", "")))
    first = each.filter(wanted).groupBy("page_id", url.alias("url")).agg(F.min("i").alias("i"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("i"))).filter(F.col("place") <= limit).select("page_id", "url", "place")


def idf_weights(df: DataFrame) -> DataFrame:
    """word, weight = ln((N + 1) / (df + 1)) + 1 over rows (id, words)."""
    n = df.agg(F.count("*").alias("n"))
    by = df.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("k"))
    return by.crossJoin(n).select("word", F.round(F.log((F.col("n") + 1) / (F.col("k") + 1)) + 1, 6).alias("weight"))  # one row on the right


def barcode_near(reads: DataFrame, known: DataFrame) -> DataFrame:
    """id, gtin: the one known barcode that equals the read or is a digit inserted, dropped, changed or swapped away.

    reads (id, key), known (gtin); keys have 11 digits or more. Codes that are so near share what is left of them without one
    digit, or one is what is left of the other: distinct keys and codes are joined by these, and the pairs verified.
    """
    digits = r"^[0-9]*$"
    key, gtin, n = F.col("key"), F.col("gtin"), F.length("key")
    at = F.sequence(F.lit(0), n)
    left, right, new = (lambda i: F.substr(key, F.lit(1), i)), (lambda i, k: F.substr(key, i + k)), (lambda i: F.substr(gtin, i + 1, F.lit(1)))
    put = lambda k: F.exists(at, lambda i: (gtin == F.concat(left(i), new(i), right(i, k))) & new(i).rlike("^[0-9]$"))
    swapped = F.exists(at, lambda i: gtin == F.concat(left(i), F.substr(key, i + 2, F.lit(1)), F.substr(key, i + 1, F.lit(1)), right(i, 3)))
    edits = F.levenshtein(key, gtin)
    near = F.when(edits == 0, True).when((edits == 1) & (gtin.rlike(digits) | (F.length(gtin) < n)), True).when(edits == 1, put(1) | put(2)).when((edits == 2) & (F.length(gtin) == n), swapped).otherwise(False)

    def rests(df: DataFrame, c: str) -> DataFrame:
        whole = F.col(c)
        less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1))), lambda i: F.concat(F.substr(whole, F.lit(1), i - 1), F.substr(whole, i + 1)))
        return df.select(c).filter(whole.isNotNull()).distinct().select(c, F.explode(F.array_distinct(F.concat(F.array(whole), less))).alias("rest"))

    # rows that were exploded are more than Spark's estimate of them, so they are merged, never broadcast
    both = rests(reads.filter(n >= 11), "key").join(rests(known, "gtin").hint("merge"), "rest").filter(near)
    of = both.select("key", "gtin").distinct().groupBy("key").agg(F.min("gtin").alias("gtin"), F.count("*").alias("n"))
    return reads.join(of.hint("merge"), "key").groupBy("id").agg(F.min("gtin").alias("gtin"), F.sum("n").alias("n")).filter("n = 1").select("id", "gtin")


def _answers(s, d):
    p = products(s, d)
    k = F.col("id")
    slug = F.when(k % 4 == 0, "Alimentos>Asia").when(k % 7 == 0, "invented").otherwise(F.concat(F.lit("nation_"), (k % 25).cast("string")))
    return p.select("id", slug.alias("slug"), clamp_confidence(((k % 10) / 8.0).cast("string")).alias("confidence"))


def _texts(s, d):
    return products(s, d).select("id", content_words("name").alias("words"))


def _q_resolve(s, d):
    p = products(s, d).withColumn("category", F.concat(F.lit("c"), (F.col("id") % 10).cast("string"))).withColumn("code", F.when(F.col("id") % 9 == 0, F.lit("99999999")))
    by_gtin = p.filter("gtin is not null").groupBy("gtin").agg(F.min("id").alias("m")).filter("m % 2 = 0").select("gtin", F.concat(F.lit("1"), F.lpad(F.col("m").cast("string"), 7, "0")).alias("gtin_code"))
    by_category = s.range(5).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("category"), F.concat(F.lit("2000000"), F.col("id").cast("string")).alias("category_code"))
    return resolve_codes(p, by_gtin, by_category)


def _q_review(s, d):
    a = _answers(s, d)
    return review_queue(resolve_slugs(a, taxonomy(s, d)).join(a.select("id", "confidence"), "id"))


def _q_prefix(s, d):
    codes = code_table(s, d)
    depts = codes.filter(F.length("code").isin(4, 6, 8)).select(F.col("code").alias("prefix"), F.concat(F.lit("d"), F.substring("code", 1, 2)).alias("department"))
    return longest_prefix(codes.filter(F.length("code") == 8).select("code"), "code", depts.filter(F.length("prefix") < 8), "department").select("code", "department")


def _q_coverage(s, d):
    return code_coverage(_q_resolve(s, d))


def _q_barcode(s, d):
    p = products(s, d).filter("gtin is not null")
    known = p.select(F.regexp_replace("gtin", "^0+", "").alias("gtin")).distinct()
    reads = p.select("id", F.concat(F.substring("gtin", 1, 4), F.lit("5"), F.substring("gtin", 5, 20)).alias("key"))
    return barcode_near(reads, known)


def _q_placeholder(s, d):
    p = products(s, d)
    own = p.filter("image_url is not null").select("id", "image_url", placeholder_host(F.col("image_url")).alias("dead"))
    return own.filter("dead").select("id", "image_url")


def _q_findings(s, d):
    """A list with some prices lost and some products missing, against far more live offers and a chain that sells nothing."""
    offers, shown = public_tables(s, d)
    k = F.col("product_id")
    bad = offers.withColumn("price_cents", F.when(k % 97 == 0, 0).when(k % 89 != 0, F.col("price_cents")))
    retailers = offers.select("retailer_name").distinct().unionByName(s.range(8, 11).select(F.concat(F.lit("Chain "), F.col("id").cast("string")).alias("retailer_name")))
    flyer = s.range(9, 10).select(F.concat(F.lit("Chain "), F.col("id").cast("string")).alias("retailer_name"))
    return offer_findings(bad, shown.filter("id % 83 <> 0"), 1_000_000_000, retailers, flyer)


def _q_contract(s, d):
    shown, k = public_tables(s, d)[1], F.col("id")
    broken = shown.withColumns(
        {
            "unit": F.when(k % 31 == 0, "kg").otherwise(F.col("unit")),
            "amount": F.when(k % 37 == 0, 0).when(k % 41 == 0, 2_000_000).otherwise(F.col("amount")),
            "pack_count": F.when(k % 43 == 0, 1001).otherwise(F.col("pack_count")),
            "gtin": F.when(k % 47 == 0, "12345").otherwise(F.col("gtin")),
        }
    )
    return product_problems(broken)  # some products of each kind of fault


def _q_missing(s, d):
    """Three differences: line numbers that receipts skip, branches that a later feed lacks, listed goods not on the receipt."""
    lines = missing_lines(receipt_lines(s, d)).select(F.lit("line").alias("kind"), F.col("receipt_id").cast("string").alias("owner"), F.explode(F.split("missing", ",")).alias("item"))
    known = branches(s, d)
    gone = missing(known, known.filter("id % 4 <> 0"), "chain", "external_id").select(F.lit("branch").alias("kind"), F.col("chain").alias("owner"), F.col("external_id").alias("item"))
    bought = receipt_lines(s, d).filter("(product_id + receipt_id) % 6 <> 0").select(F.col("receipt_id").alias("list_id"), "product_id")
    left = missing(list_lines(s, d), bought, "list_id", "product_id").select(F.lit("listed").alias("kind"), F.col("list_id").cast("string").alias("owner"), F.col("product_id").cast("string").alias("item"))
    return lines.unionByName(gone).unionByName(left)


QUERIES = {
    "src_taxonomy_csv": lambda s, d: taxonomy(s, d),
    "tree_subtree_leaves": lambda s, d: subtree_leaves(taxonomy(s, d)),
    "tree_leaves": lambda s, d: taxonomy(s, d).filter("is_leaf").select("path", "slug").orderBy("path"),
    "tree_children": lambda s, d: taxonomy(s, d).filter("parent_slug = 'alimentos'").select("slug", "name"),
    "tree_slug_resolve": lambda s, d: resolve_slugs(_answers(s, d), taxonomy(s, d)),
    "src_code_table": lambda s, d: code_parents(code_table(s, d)),
    "jn_longest_prefix": _q_prefix,
    "jn_token_overlap": lambda s, d: token_overlap(_texts(s, d), code_table(s, d)),
    "jn_overlap_best": lambda s, d: overlap_best(token_overlap(_texts(s, d), code_table(s, d))),
    "jn_code_resolve": _q_resolve,
    "ag_code_coverage": _q_coverage,
    "dq_review_queue": _q_review,
    "ag_receipt_flags": lambda s, d: receipt_flags(receipt_lines(s, d)),
    "set_missing": _q_missing,
    "ag_idf_weights": lambda s, d: idf_weights(_texts(s, d)),
    "jn_barcode_near": _q_barcode,
    "flt_dead_url": _q_placeholder,
    "flt_missing_image": lambda s, d: products(s, d).filter("coalesce(image_url, '') = ''").select("id").orderBy("id").limit(50),
    "src_products": lambda s, d: products(s, d).orderBy("id").limit(100).select("id", "name"),
    "dq_check_snapshot": _q_findings,
    "dq_product_contract": _q_contract,
    "src_html_links": lambda s, d: html_links(table(s, d, "pages"), ("a", "1"), "https://shop.example.org/", 5),
}

_STOPS = "('com', 'sem', 'para', 'por', 'dos', 'das', 'nos', 'nas', 'que', 'uma', 'uns', 'umas', 'aos', 'pelo', 'pela', 'seu', 'sua', 'mais', 'tipo')"


def _words_sql(x: str) -> str:
    return f"list_sort(list_filter(list_distinct(regexp_extract_all({clean_sql(x)}, '[a-z0-9]{{3,}}')), lambda w: w NOT IN {_STOPS}))"


_OVER = f"""WITH w AS (SELECT id, unnest({_words_sql('name')}) AS word FROM products),
 c AS (SELECT code, length(description) AS len, len({_words_sql('description')}) AS n, unnest({_words_sql('description')}) AS word FROM code_table WHERE length(code) = 8),
 m AS (SELECT id, code, len, round(count(*) - (n - count(*)) * 0.05::DOUBLE, 4) AS score FROM w JOIN c USING (word) GROUP BY id, code, len, n),
 ov AS (SELECT id, code, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, len, code) AS place FROM m QUALIFY place <= {TOP_CODES})"""
_RES = """WITH p AS (SELECT *, 'c' || (id % 10) AS category, CASE WHEN id % 9 = 0 THEN '99999999' END AS code FROM products),
 g AS (SELECT gtin, '1' || lpad(min(id)::VARCHAR, 7, '0') AS gc FROM products WHERE gtin IS NOT NULL GROUP BY gtin HAVING min(id) % 2 = 0),
 r AS (SELECT p.id, coalesce(g.gc, CASE WHEN id % 10 < 5 THEN '2000000' || (id % 10) END, code) AS code, CASE WHEN g.gc IS NOT NULL THEN 'gtin' WHEN id % 10 < 5 THEN 'category' WHEN code IS NOT NULL THEN 'kept' ELSE 'none' END AS source FROM p LEFT JOIN g USING (gtin))"""
_ANS = """WITH a AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'Alimentos>Asia' WHEN id % 7 = 0 THEN 'invented' ELSE 'nation_' || (id % 25) END AS slug, least(1.0, (id % 10) / 8.0::DOUBLE) AS confidence FROM products),
 rs AS (SELECT a.id, confidence, coalesce(t.slug, u.slug) AS resolved FROM a LEFT JOIN taxonomy t ON t.slug = a.slug LEFT JOIN taxonomy u ON u.path = a.slug)"""
_FLAGS = """SELECT receipt_id, count(*) FILTER (WHERE abs(qty * unit_price - discount - total) > 0.03) AS bad_math,
 array_to_string(list_sort(list_filter(range(min(line_no), max(line_no) + 1), lambda i: NOT list_contains(list(DISTINCT line_no), i))), ',') AS missing, count(*) - count(DISTINCT line_no) AS repeated FROM receipt_lines GROUP BY 1"""

ORACLE_SQL = {
    "src_taxonomy_csv": with_tables("SELECT * FROM taxonomy", "taxonomy"),
    "tree_subtree_leaves": with_tables("WITH l AS (SELECT * FROM taxonomy WHERE is_leaf) SELECT slug, slug AS leaf FROM l UNION ALL SELECT parent_slug, slug FROM l UNION ALL SELECT t.parent_slug, l.slug FROM l JOIN taxonomy t ON t.slug = l.parent_slug", "taxonomy"),
    "tree_leaves": with_tables("SELECT path, slug FROM taxonomy WHERE is_leaf", "taxonomy"),
    "tree_children": with_tables("SELECT slug, name FROM taxonomy WHERE parent_slug = 'alimentos'", "taxonomy"),
    "tree_slug_resolve": with_tables(f"{_ANS} SELECT id, resolved FROM rs", "products", "taxonomy"),
    "src_code_table": with_tables("SELECT c.code, coalesce(a.code, b.code, e.code) AS parent FROM code_table c LEFT JOIN code_table a ON length(c.code) > 6 AND a.code = c.code[:6] LEFT JOIN code_table b ON length(c.code) > 4 AND b.code = c.code[:4] LEFT JOIN code_table e ON length(c.code) > 2 AND e.code = c.code[:2]", "code_table"),
    "jn_longest_prefix": with_tables("SELECT c.code, CASE WHEN coalesce(a.code, b.code) IS NOT NULL THEN 'd' || c.code[:2] END AS department FROM code_table c LEFT JOIN code_table a ON a.code = c.code[:6] LEFT JOIN code_table b ON b.code = c.code[:4] WHERE length(c.code) = 8", "code_table"),
    "jn_token_overlap": with_tables(f"{_OVER} SELECT * FROM ov", "products", "code_table"),
    "jn_overlap_best": with_tables(f"{_OVER} SELECT id, code, round(least(0.7, 0.25 + 0.1 * score), 6) AS confidence FROM ov WHERE place = 1 AND score >= 2", "products", "code_table"),
    "jn_code_resolve": with_tables(f"{_RES} SELECT * FROM r", "products"),
    "ag_code_coverage": with_tables(f"{_RES} SELECT source, count(*) AS products, (SELECT count(*) FROM r) AS total, (SELECT count(code) FROM r) AS coded, round((SELECT count(code) / count(*)::DOUBLE FROM r), 6) AS share FROM r GROUP BY 1", "products"),
    "dq_review_queue": with_tables(f"{_ANS} SELECT id, CASE WHEN resolved IS NULL THEN 'no answer' ELSE 'low confidence' END AS reason FROM rs WHERE resolved IS NULL OR confidence < 0.7", "products", "taxonomy"),
    "ag_receipt_flags": with_tables(_FLAGS, "receipt_lines"),
    "set_missing": with_tables(f"""SELECT 'line' AS kind, receipt_id::VARCHAR AS owner, unnest(string_split(missing, ',')) AS item FROM ({_FLAGS}) WHERE missing <> ''
        UNION ALL SELECT 'branch', chain, external_id FROM (SELECT chain, external_id FROM branches EXCEPT SELECT chain, external_id FROM branches WHERE id % 4 <> 0)
        UNION ALL SELECT 'listed', list_id::VARCHAR, product_id::VARCHAR FROM (SELECT list_id, product_id FROM list_lines EXCEPT SELECT receipt_id, product_id FROM receipt_lines WHERE (product_id + receipt_id) % 6 <> 0)""", "receipt_lines", "branches", "list_lines"),
    "ag_idf_weights": with_tables(f"SELECT word, round(ln(((SELECT count(*) FROM products) + 1) / (count(*) + 1)::DOUBLE) + 1, 6) AS weight FROM (SELECT id, unnest({_words_sql('name')}) AS word FROM products) GROUP BY 1", "products"),
    "flt_dead_url": with_tables("SELECT id, image_url FROM products WHERE contains(image_url, 'via.placeholder.com')", "products"),
    "flt_missing_image": with_tables("SELECT id FROM products WHERE image_url IS NULL ORDER BY id LIMIT 50", "products"),
    "src_products": with_tables("SELECT id, name FROM products ORDER BY id LIMIT 100", "products"),
    "dq_check_snapshot": public_sql("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE product_id % 97 = 0 OR product_id % 89 = 0 OR product_id % 83 = 0) AS b FROM offers)
        SELECT 'error' AS level, 'no valid price or product' AS finding, b AS n FROM n WHERE b > 0 UNION ALL SELECT 'error', 'under half of the live offers', n FROM n UNION ALL SELECT 'warning', 'no offers of Chain 8', 0 UNION ALL SELECT 'warning', 'no offers of Chain 10', 0"""),
    "dq_product_contract": public_sql("""WITH f AS (SELECT id, brand, CASE WHEN id % 31 = 0 THEN 'kg' ELSE unit END AS unit, CASE WHEN id % 37 = 0 THEN 0 WHEN id % 41 = 0 THEN 2000000 ELSE amount END AS amount, CASE WHEN id % 43 = 0 THEN 1001 ELSE pack_count END AS pack, CASE WHEN id % 47 = 0 THEN '12345' ELSE gtin END AS gtin FROM shown)
        SELECT id, 'brand' AS rule FROM f WHERE brand = '' UNION ALL SELECT id, 'unit' FROM f WHERE unit NOT IN ('g', 'ml', 'un') UNION ALL SELECT id, 'amount' FROM f WHERE amount < 1 OR amount > 1000000
        UNION ALL SELECT id, 'pack' FROM f WHERE pack < 1 OR pack > 1000 UNION ALL SELECT id, 'gtin' FROM f WHERE NOT regexp_full_match(gtin, '\\d{8}|\\d{12,14}')"""),
    "src_html_links": r"""WITH l AS (SELECT page_id, unnest(h) AS href, unnest(t) AS text, generate_subscripts(h, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*>(.*?)</a>', 2) AS t FROM pages)),
        w AS (SELECT page_id, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://shop.example.org/' || ltrim(href, '/') END AS url, min(i) AS i FROM (SELECT *, lower(regexp_replace(text, '<[^>]*>', '', 'g')) AS t FROM l) WHERE contains(lower(href), 'a') OR contains(t, 'a') OR contains(href, '1') OR contains(t, '1') GROUP BY 1, 2)
        SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT AS place FROM w QUALIFY place <= 5""",
}
