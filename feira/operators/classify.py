"""From a classifier's answers to classified products: validated slugs, codes, reviews; and the snapshot's way into the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import content_words, display_name, parse_size, size_sql, tokens_sql, variable_weight
from feira.functions.values import canonical_key, cents, normalize_gtin, signature
from feira.operators.lookup import override_codes
from feira.operators.state import append_new
from feira.operators.warehouse import _OVER, LEAST_SCORE, _answers, _words_sql, overlap_best, resolve_slugs, token_overlap
from feira.sources.domain import code_table, prices, products, taxonomy, with_tables

LEAST_CONFIDENCE = 0.7
VERSION = "v1"


def narrow_codes(drafts: DataFrame, codes: DataFrame) -> DataFrame:
    """id, code, confidence, how: drafts (id, text, code, confidence) brought to items of 8 digits of ``codes`` (code, description).

    A code of the table stays. Another becomes the only item under its first 6 digits, else 4, at 0.9 of the confidence; of
    several the one whose words overlap the text best (then the lowest code) at 0.6. Drafts without any are left out.
    """
    items = codes.filter(F.length("code") == 8)
    known = drafts.join(items.select("code"), "code", "left_semi").select("id", "code", "confidence", F.lit("kept").alias("how"))
    rest = drafts.join(items.select("code"), "code", "left_anti")
    described = items.select(F.col("code").alias("item"), content_words("description").alias("own"))
    out = known
    for n in (6, 4):
        near = rest.filter(F.length("code") >= n).join(described.withColumn("prefix", F.substring("item", 1, n)), F.substring("code", 1, n) == F.col("prefix"))
        shared = F.size(F.array_intersect(content_words("text"), "own"))
        score = F.round(shared - (F.size("own") - shared) * 0.05, 4)
        best = near.groupBy("id").agg(F.max(F.struct(score.alias("score"), (-F.col("item").cast("long")).alias("low"))).alias("b"), F.count("*").alias("n"), F.first("confidence").alias("c"))
        found = best.select("id", F.lpad((-F.col("b.low")).cast("string"), 8, "0").alias("code"), F.round(F.col("c") * F.when(F.col("n") == 1, 0.9).otherwise(0.6), 3).alias("confidence"), F.when(F.col("n") == 1, "only").otherwise("overlap").alias("how"))
        out = out.unionByName(found)
        rest = rest.join(found.select("id"), "id", "left_anti")
    return out


def classified(product: DataFrame, answers: DataFrame, tree: DataFrame, by_category: DataFrame, by_gtin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(silver, review) of products (id, name, brand, gtin) and answers (sig, slug, confidence).

    Silver holds a row for each canonical key, that of the highest id among the answered: slug and path as the tree has them
    (invented ones null), size, review state, and the code of the barcode (by_gtin: gtin, code), else of the category
    (by_category: slug, code). Reviews: products without an answer, and answers of low confidence.
    """
    own = product.withColumns({"sig": signature(F.col("name"), F.col("brand"), VERSION), "key": canonical_key(F.col("name"), F.col("gtin"))})
    one = answers.groupBy("sig").agg(F.max_by(F.struct("slug", "confidence"), "confidence").alias("a")).select("sig", "a.*")
    both = own.join(one, "sig", "left")
    valid = resolve_slugs(both.select("id", "slug"), tree)
    both = both.drop("slug").join(valid, "id").join(tree.select(F.col("slug").alias("resolved"), "path"), "resolved", "left")
    reason = F.when(F.col("confidence").isNull(), "no_answer").when(F.col("confidence") < LEAST_CONFIDENCE, "low_confidence")
    review = both.select("id", reason.alias("reason"), F.col("resolved").alias("slug"), "confidence").filter("reason is not null")
    last = Window.partitionBy("key").orderBy(F.desc("id"))
    top = both.filter("confidence is not null").withColumn("n", F.row_number().over(last)).filter("n = 1").withColumn("code14", F.lpad(normalize_gtin(F.col("gtin")), 14, "0"))
    top = top.join(by_gtin.select(F.col("gtin").alias("code14"), F.col("code").alias("g")), "code14", "left").join(by_category.select(F.col("slug").alias("resolved"), F.col("code").alias("c")), "resolved", "left")
    size = parse_size("name")
    silver = top.select(
        "key", F.col("id").alias("product_id"), display_name("name").alias("name"), "brand", F.col("resolved").alias("slug"), "path", "confidence",
        F.when(F.col("confidence") < LEAST_CONFIDENCE, "pending").otherwise("none").alias("review"),
        size["amount"].alias("amount"), size["unit"].alias("unit"), size["pack"].alias("pack"), (size["amount"] * size["pack"]).alias("total"), variable_weight("name").alias("variable"),
        F.coalesce("g", "c").alias("code"), F.when(F.col("g").isNotNull(), "gtin").when(F.col("c").isNotNull(), "category").alias("code_source"),
    )
    return silver, review


def reclassified(silver: DataFrame, answers: DataFrame, tree: DataFrame, by_category: DataFrame) -> DataFrame:
    """``silver`` (key, slug, code, ...) where rows without a leaf take the new answer (key, slug, confidence), if it is one of the tree."""
    leaves = tree.filter("is_leaf").select(F.col("slug").alias("leaf"))
    fresh = resolve_slugs(answers.select(F.col("key").alias("id"), "slug"), tree).filter("resolved is not null").select(F.col("id").alias("key"), F.col("resolved").alias("new_slug"))
    open_ = silver.join(leaves, F.col("slug") == F.col("leaf"), "left")
    out = open_.join(fresh, "key", "left").join(by_category.select(F.col("slug").alias("new_slug"), F.col("code").alias("new_code")), "new_slug", "left")
    take = F.col("leaf").isNull() & F.col("new_slug").isNotNull()
    return out.select("key", F.when(take, F.col("new_slug")).otherwise(F.col("slug")).alias("slug"), F.when(take, F.col("new_code")).otherwise(F.col("code")).alias("code"), take.alias("changed"))


def coded(silver: DataFrame, codes: DataFrame, overrides: DataFrame) -> DataFrame:
    """id, code, confidence: rows (id, name, code, confidence) without a code take that of the best overlap of words;
    corrections by hand (name, code) then win over all."""
    found = overlap_best(token_overlap(silver.filter("code is null").select("id", content_words("name").alias("words")), codes))
    both = silver.join(found.withColumnsRenamed({"code": "found", "confidence": "sure"}), "id", "left")
    both = both.select("id", "name", F.coalesce("code", "found").alias("code"), F.when(F.col("code").isNull(), F.col("sure")).otherwise(F.col("confidence")).alias("confidence"))
    return override_codes(both, overrides)


def drafted_map(leaves: DataFrame, existing: DataFrame, codes: DataFrame, reuse: DataFrame) -> DataFrame:
    """slug, code, confidence, source: a row for each leaf (slug, path) with a code. Rows of ``existing`` made by hand, or
    named in ``reuse`` (slug), stay; the others take the best overlap of the path's words."""
    named = existing.join(reuse.select("slug", F.lit(True).alias("again")).distinct(), "slug", "left").filter("source = 'manual' or again")
    kept = leaves.select("slug").join(named.select("slug", "code", "confidence", "source"), "slug")
    todo = leaves.join(kept.select("slug"), "slug", "left_anti").select(F.col("slug").alias("id"), content_words("path").alias("words"))
    best = overlap_best(token_overlap(todo, codes))
    return kept.unionByName(best.select(F.col("id").alias("slug"), "code", "confidence", F.lit("overlap").alias("source")))


def seeded_images(product: DataFrame, mirrored: DataFrame, existing: DataFrame) -> DataFrame:
    """key, path: images already mirrored for the same canonical key (the mirror's last row of it), where the table has none."""
    last = mirrored.groupBy("key").agg(F.max_by("path", "id").alias("path"))
    return append_new(product.select("key").join(last, "key"), existing, ["key"])


def ingested(silver: DataFrame, observed: DataFrame, known_tags: DataFrame, snapshot: DataFrame, offers: DataFrame, etag: str) -> tuple[DataFrame, DataFrame]:
    """(silver, observations) after a snapshot.

    silver (key, slug, product_id), snapshot (key, product_id), offers (key, store, at, cents). Products are written anew and
    keep their class. Observations are appended once, and none for a snapshot whose etag is known: taking it in again
    changes nothing.
    """
    new = snapshot.groupBy("key").agg(F.max("product_id").alias("new_id"))
    both = silver.join(new, "key", "full_outer").select("key", "slug", F.coalesce("new_id", "product_id").alias("product_id"), (F.col("product_id").isNull()).alias("is_new"))
    fresh = known_tags.filter(F.col("etag") == etag).agg((F.count("*") == 0).alias("fresh"))
    rows = offers.join(F.broadcast(fresh)).filter("fresh").drop("fresh")  # one row
    return both, observed.unionByName(append_new(rows, observed, ["key", "store", "at"]))


def _signed(s, d) -> DataFrame:
    """Answers by signature, for four products of five."""
    a = _answers(s, d).filter("id % 5 <> 0")
    p = products(s, d).select("id", "name", "brand")
    return a.join(p, "id").select(signature(F.col("name"), F.col("brand"), VERSION).alias("sig"), "slug", "confidence")


def _by_category(s, d) -> DataFrame:
    return taxonomy(s, d).filter("is_leaf and length(slug) > 5").select("slug", F.lpad(F.length("slug").cast("string"), 8, "3").alias("code"))


def _by_gtin(s, d) -> DataFrame:
    p = products(s, d).filter("gtin is not null and gtin not like '2%'")
    return p.groupBy(F.lpad("gtin", 14, "0").alias("gtin")).agg(F.min("id").alias("m")).filter("m % 2 = 0").select("gtin", F.lpad("m", 8, "1").alias("code"))


def _keyed(s, d) -> DataFrame:
    return products(s, d).withColumn("key", canonical_key(F.col("name"), F.col("gtin")))


def _q_classify(s, d):
    silver, review = classified(products(s, d), _signed(s, d), taxonomy(s, d), _by_category(s, d), _by_gtin(s, d))
    return silver.select("product_id", "slug", "path", "confidence", "review", "amount", "total", "code", "code_source", F.lit("silver").alias("kind")).unionByName(
        review.select(F.col("id").alias("product_id"), "slug", F.lit(None).cast("string").alias("path"), "confidence", F.col("reason").alias("review"), F.lit(None).cast("int").alias("amount"), F.lit(None).cast("int").alias("total"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("code_source"), F.lit("review").alias("kind"))
    )


def _q_reclassify(s, d):
    p = products(s, d)
    old = p.select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 == 0, "nation_1").when(F.col("id") % 3 == 1, "asia").alias("slug"), F.lit("0").alias("code"))
    new = _answers(s, d).select(F.col("id").cast("string").alias("key"), "slug", "confidence")
    return reclassified(old, new, taxonomy(s, d), _by_category(s, d))


def _q_coded(s, d):
    p = products(s, d).select("id", "name", F.when(F.col("id") % 3 == 0, "99999999").alias("code"), F.lit(0.5).alias("confidence"))
    hand = products(s, d).filter("id % 10 = 0").groupBy(F.upper("name").alias("name")).agg(F.lit("77777777").alias("code"))
    return coded(p, code_table(s, d), hand)


def _q_drafted(s, d):
    leaves = products(s, d).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("slug"), F.col("name").alias("path"), "id")
    old = leaves.filter("id % 2 = 0").select("slug", F.lit("11111111").alias("code"), F.lit(1.0).alias("confidence"), F.when(F.col("id") % 4 == 0, "manual").otherwise("model").alias("source"))
    return drafted_map(leaves, old, code_table(s, d), leaves.filter("id % 6 = 0").select("slug"))


def _q_narrow(s, d):
    c = code_table(s, d)
    p = products(s, d)
    code = F.lpad(((F.col("id") * 7919) % 90_000_000 + 10_000_000).cast("string"), 8, "0")
    drafts = p.select("id", F.col("name").alias("text"), F.when(F.col("id") % 3 == 0, code).when(F.col("id") % 3 == 1, F.concat(F.substring(code, 1, 6), F.lit("00"))).otherwise(F.concat(F.substring(code, 1, 4), F.lit("0000"))).alias("code"), F.lit(0.8).alias("confidence"))
    return narrow_codes(drafts, c)


def _q_seed(s, d):
    p = _keyed(s, d)
    mirror = p.filter("id % 2 = 0").select("key", "id", F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit(".webp")).alias("path"))
    return seeded_images(p, mirror, p.filter("id % 5 = 0").select("key").distinct())


def _q_ingest(s, d):
    p = _keyed(s, d)
    old = p.filter("id % 2 = 0").groupBy("key").agg(F.lit("kept").alias("slug"), F.max("id").alias("product_id"))
    offers = prices(s, d).join(p.select(F.col("id").alias("product_id"), "key"), "product_id").select("key", F.col("store_id").alias("store"), F.col("scraped_at").alias("at"), cents(F.col("price")).alias("cents"))
    first = offers.groupBy("key", "store", "at").agg(F.min("cents").alias("cents"))
    seen = first.filter("store % 2 = 0")
    tags = s.range(3).select(F.concat(F.lit("tag-"), F.col("id").cast("string")).alias("etag"))
    silver, observed = ingested(old, seen, tags, p.select("key", F.col("id").alias("product_id")), first, "tag-new")
    once_more = ingested(silver.drop("is_new"), observed, tags.union(s.sql("select 'tag-new'")), p.select("key", F.col("id").alias("product_id")), first, "tag-new")[1]
    counts = silver.agg(F.count("*").alias("products"), F.count(F.when(F.col("is_new"), 1)).alias("new_products"), F.count("slug").alias("classified"), F.sum("product_id").alias("ids"))
    return counts.crossJoin(once_more.agg(F.count("*").alias("observations"), F.sum("cents").alias("cents")))  # one row each


QUERIES = {
    "jn_code_narrow": _q_narrow,
    "pipe_classify_ingest": _q_classify,
    "pipe_reclassify_unmapped": _q_reclassify,
    "pipe_code_unmapped": _q_coded,
    "pipe_draft_category_map": _q_drafted,
    "jn_seed_images": _q_seed,
    "st_snapshot_ingest": _q_ingest,
}


def _over(source: str) -> str:
    """The overlap CTEs of the warehouse's oracles over another table (id, name)."""
    return _OVER.replace("FROM products)", f"FROM {source})", 1)


def _keys() -> str:
    return f"""k AS (SELECT *, coalesce('gtin:' || CASE WHEN length(gtin) IN (8, 12, 13, 14) AND NOT (length(gtin) = 13 AND starts_with(gtin, '2')) THEN lpad(gtin, 14, '0') END,
        'tok:' || substring(sha256(array_to_string({tokens_sql('name')}, '|') || '|' || s.amount || s.unit || 'x' || s.pack), 1, 16)) AS key FROM (SELECT *, {size_sql('name')} AS s FROM products))"""


ORACLE_SQL = {
    "pipe_draft_category_map": with_tables(f"""{_over("(SELECT * FROM products WHERE NOT (id % 4 = 0 OR id % 6 = 0))")}
        SELECT 'p' || id AS slug, '11111111' AS code, 1.0::DOUBLE AS confidence, CASE WHEN id % 4 = 0 THEN 'manual' ELSE 'model' END AS source FROM products WHERE id % 4 = 0 OR id % 6 = 0
        UNION ALL SELECT 'p' || id, code, round(least(0.7, 0.25 + 0.1 * score), 6), 'overlap' FROM ov WHERE place = 1 AND score >= {LEAST_SCORE}""", "products", "code_table"),
    "pipe_code_unmapped": with_tables(f"""{_over("(SELECT * FROM products WHERE id % 3 <> 0)")}, h AS (SELECT DISTINCT trim(regexp_replace(lower(strip_accents(name)), '\\s+', ' ', 'g')) AS f FROM products WHERE id % 10 = 0)
        SELECT p.id, CASE WHEN h.f IS NOT NULL THEN '77777777' WHEN p.id % 3 = 0 THEN '99999999' ELSE o.code END AS code, CASE WHEN h.f IS NOT NULL THEN 1.0 WHEN p.id % 3 = 0 THEN 0.5 WHEN o.score IS NOT NULL THEN round(least(0.7, 0.25 + 0.1 * o.score), 6) END::DOUBLE AS confidence
        FROM products p LEFT JOIN h ON h.f = trim(regexp_replace(lower(strip_accents(p.name)), '\\s+', ' ', 'g')) LEFT JOIN (SELECT * FROM ov WHERE place = 1 AND score >= {LEAST_SCORE}) o ON o.id = p.id""", "products", "code_table"),
    "pipe_reclassify_unmapped": with_tables("""WITH a AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'nation_1' WHEN id % 3 = 1 THEN 'asia' END AS old, CASE WHEN id % 4 = 0 THEN 'Alimentos>Asia' WHEN id % 7 = 0 THEN 'invented' ELSE 'nation_' || (id % 25) END AS slug FROM products),
        b AS (SELECT a.id, a.old, coalesce(t.slug, u.slug) AS new FROM a LEFT JOIN taxonomy t ON t.slug = a.slug LEFT JOIN taxonomy u ON u.path = a.slug),
        c AS (SELECT *, new IS NOT NULL AND NOT EXISTS (SELECT 1 FROM taxonomy x WHERE x.slug = old AND x.is_leaf) AS changed FROM b)
        SELECT id::VARCHAR AS key, CASE WHEN changed THEN new ELSE old END AS slug, CASE WHEN changed THEN (SELECT lpad(length(x.slug)::VARCHAR, 8, '3') FROM taxonomy x WHERE x.slug = new AND x.is_leaf AND length(x.slug) > 5) ELSE '0' END AS code, changed FROM c""", "products", "taxonomy"),
    "jn_code_narrow": with_tables(f"""WITH d AS (SELECT id, name, [c, c[:6] || '00', c[:4] || '0000'][id % 3 + 1] AS code FROM (SELECT *, lpad(((id * 7919) % 90000000 + 10000000)::VARCHAR, 8, '0') AS c FROM products)),
        it AS (SELECT code AS item, {_words_sql('description')} AS own FROM code_table WHERE length(code) = 8), k AS (SELECT id, code FROM d SEMI JOIN it ON item = d.code),
        m AS (SELECT d.id, p AS n, item, round(len(list_intersect({_words_sql('name')}, own)) - (len(own) - len(list_intersect({_words_sql('name')}, own))) * 0.05::DOUBLE, 4) AS score FROM d CROSS JOIN (VALUES (6), (4)) v(p) JOIN it ON item[:p] = d.code[:p] WHERE d.id NOT IN (SELECT id FROM k)),
        b AS (SELECT id, n, arg_max(item, (score, -item::BIGINT)) AS code, count(*) AS many FROM m GROUP BY 1, 2 QUALIFY n = max(n) OVER (PARTITION BY id))
        SELECT id, code, 0.8::DOUBLE AS confidence, 'kept' AS how FROM k UNION ALL SELECT id, code, CASE WHEN many = 1 THEN 0.72 ELSE 0.48 END, CASE WHEN many = 1 THEN 'only' ELSE 'overlap' END FROM b""", "products", "code_table"),
    "jn_seed_images": with_tables(f"WITH {_keys()} SELECT key, 'images/' || max(id) || '.webp' AS path FROM k WHERE id % 2 = 0 AND key NOT IN (SELECT key FROM k WHERE id % 5 = 0) GROUP BY key", "products"),
    "st_snapshot_ingest": with_tables(f"""WITH {_keys()}, o AS (SELECT key, store_id, scraped_at, min(round_even(price * 100, 0)::INT) AS cents FROM prices p JOIN k ON k.id = product_id GROUP BY 1, 2, 3), a AS (SELECT key, max(id) AS id, bool_or(id % 2 = 0) AS old FROM k GROUP BY 1)
        SELECT (SELECT count(*) FROM a) AS products, (SELECT count(*) FROM a WHERE NOT old) AS new_products, (SELECT count(*) FROM a WHERE old) AS classified, (SELECT sum(id)::BIGINT FROM a) AS ids, (SELECT count(*) FROM o) AS observations, (SELECT sum(cents)::BIGINT FROM o) AS cents""", "products", "prices"),
}
