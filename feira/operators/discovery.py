"""Chains that aren't known yet, and matches of names that are only alike: images, lookups, flyers and branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import chain_key, clean
from feira.functions.values import sequence_ratio
from feira.operators.likeness import likeness, most_alike, plain_name
from feira.sources.domain import branches, products, stores, with_tables
from feira.sources.files import new_folder

# The ratios from which two names count as alike, for chains, images, lookups and flyers.
SIMILAR, IMAGE, LOOKUP_AT_PLACE, LOOKUP_BY_NAME, BRANCH = 0.88, 0.62, 0.40, 0.75, 0.62


def _grams(c: Column) -> Column:
    """Distinct runs of three letters of a folded name (the name itself if shorter)."""
    n = F.length(c)
    return F.when(n < 3, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3)))))


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio) of names of ``left`` (a) and ``right`` (b) whose ratio of matching letters is ``least`` or more.

    Distinct names are compared once, and only those that share a run of three letters and whose lengths allow the ratio.
    For ratios from 0.88 and names from five letters all alike share one; ``likeness`` has the join for lower ratios.
    """
    a = left.select("a").filter("a <> ''").distinct().withColumn("g", _grams(F.col("a")))
    b = right.select("b").filter("b <> ''").distinct().withColumn("g", _grams(F.col("b")))
    shared = a.select("a", F.explode("g").alias("gram")).join(b.select("b", F.explode("g").alias("gram")), "gram").groupBy("a", "b").agg(F.count("*").alias("n"))
    short, both = F.least(F.length("a"), F.length("b")), F.length("a") + F.length("b")
    return shared.filter(2 * short >= least * both).withColumn("ratio", sequence_ratio("a", "b")).filter(F.col("ratio") >= least).select("a", "b", "ratio")


def same_chain_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of chain keys that are one chain: equal, one with more words, or from five letters nearly equal."""
    first = lambda c: F.substring_index(c, " ", 1)
    x, y = left.select("a").filter("a <> ''").distinct(), right.select("b").filter("b <> ''").distinct()
    begins = x.join(y, first("a") == first("b")).filter((F.col("a") == F.col("b")) | F.col("a").startswith(F.concat("b", F.lit(" "))) | F.col("b").startswith(F.concat("a", F.lit(" "))))
    typo = alike(x.filter("length(a) >= 5"), y.filter("length(b) >= 5"), SIMILAR)
    return begins.select("a", "b").union(typo.select("a", "b")).distinct()


def discovered_chains(places: DataFrame, known: DataFrame) -> DataFrame:
    """key, name, branches, cities, address of the chains of ``places`` (id, name, city, address) that ``known`` (name) lacks.

    The most frequent keys lead (then the shorter, then by letters): each other key joins the first leader it is the same
    chain as. Leaders are settled in rounds over the distinct keys, until every key leads or follows.
    """
    spark = places.sparkSession
    own = places.withColumn("key", chain_key("name")).filter("key <> ''")
    theirs = same_chain_pairs(own.select(F.col("key").alias("a")), known.select(chain_key("name").alias("b")))
    own = own.join(theirs.select(F.col("a").alias("key")).distinct(), "key", "left_anti")
    keys = own.groupBy("key").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.length("key").alias("l"), F.col("key").alias("k"))
    keys = keys.select("key", order.alias("o"))
    same = same_chain_pairs(keys.select(F.col("key").alias("a")), keys.select(F.col("key").alias("b"))).filter("a <> b")
    same = same.join(keys.select(F.col("key").alias("a"), F.col("o").alias("ao")), "a").join(keys.select(F.col("key").alias("b"), F.col("o").alias("bo")), "b").filter("bo < ao")  # b comes before a
    path = new_folder(spark, "chains")
    same.write.parquet(f"{path}/pairs")
    same = spark.read.parquet(f"{path}/pairs")
    state, turn = keys.select("key", "o", F.lit(None).cast("string").alias("head")), 0
    while True:
        state.write.parquet(f"{path}/round-{turn}")
        state = spark.read.parquet(f"{path}/round-{turn}")
        if not state.filter("head is null").take(1):
            break
        before = same.join(state.select(F.col("key").alias("b"), F.col("head").alias("b_head")), "b")
        # the first leader before a key, and whether a key before that one is still open
        told = before.groupBy(F.col("a").alias("key")).agg(F.min(F.when(F.col("b_head") == F.col("b"), F.struct("bo", "b"))).alias("lead"), F.min(F.when(F.col("b_head").isNull(), F.struct("bo", "b"))).alias("open"))
        both = state.join(told, "key", "left")
        blocked = F.col("open").isNotNull() & (F.col("lead").isNull() | (F.col("open") < F.col("lead")))
        head = F.when(F.col("head").isNotNull(), F.col("head")).when(blocked, None).otherwise(F.coalesce("lead.b", "key"))
        state, turn = both.select("key", "o", head.alias("head")), turn + 1
    of = own.join(state.select("key", "head", "o"), "key")
    spelled = of.groupBy("head", "name").agg(F.count("*").alias("k")).groupBy("head").agg(F.max_by("name", F.struct("k", "name")).alias("name"))
    by = of.groupBy("head").agg(F.count("*").alias("branches"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("city") != "", F.col("city")))), ", ").alias("cities"), F.min_by("address", F.struct("o", "id")).alias("address"))
    return by.join(spelled, "head").select(F.col("head").alias("key"), "name", "branches", "cities", "address")


def synced_candidates(known: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Candidates (key, status, first_seen, last_seen, branches) after a discovery (key, branches): what people decided and
    when a chain was first seen stays; found ones are counted anew; new ones have the status "new"."""
    new = found.select("key", F.col("branches").alias("now_branches"))
    both = known.join(new, "key", "full_outer")
    seen = F.col("now_branches").isNotNull()
    return both.select(
        "key", F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("first_seen", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("now_branches", "branches").alias("branches")
    )


def image_matches(product: DataFrame, found: DataFrame) -> DataFrame:
    """id, image, source, confidence: of images found for products (id, name, brand; found: id, kind, name, brand, image) the
    one of the barcode, else the most similar one from IMAGE on (likeness of names, or of brands where both have one and
    that is higher; ties: lowest image)."""
    both = product.join(found.select("id", "kind", F.col("name").alias("their_name"), F.col("brand").alias("their_brand"), "image"), "id").filter("coalesce(image, '') <> ''")
    both = both.withColumns({"a": plain_name("name"), "b": plain_name("their_name"), "c": plain_name("brand"), "d": plain_name("their_brand")})
    branded = (F.coalesce("brand", F.lit("")) != "") & (F.coalesce("their_brand", F.lit("")) != "")
    scored = both.withColumns({"by_name": likeness("a", "b"), "by_brand": likeness("c", "d")})
    score = F.when(F.col("kind") == "gtin", 1.0).when(branded, F.greatest("by_name", "by_brand")).otherwise(F.col("by_name"))
    scored = scored.withColumn("confidence", F.round(score, 6)).filter((F.col("kind") == "gtin") | (score >= IMAGE))
    best = Window.partitionBy("id").orderBy(F.desc(F.col("kind") == "gtin"), F.desc("confidence"), "image")
    return scored.withColumn("n", F.row_number().over(best)).filter("n = 1").select("id", "image", F.col("kind").alias("source"), "confidence")


def looked_up(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """num, id, how: the flagged product that a reviewed row means.

    rows (num, name, gtin), flagged (place, id, name, gtin; places count from 1). First the product at the row's number, if
    the names are at all alike; then that of the barcode; then the most similar name from LOOKUP_BY_NAME on (ties: first place).
    """
    own = rows.select("num", plain_name("name").alias("a"), F.col("gtin").alias("code"))
    named = flagged.select("place", "id", plain_name("name").alias("b"))
    at = own.join(named.withColumnRenamed("place", "num"), "num").withColumn("r", likeness("a", "b")).filter(F.col("r") >= LOOKUP_AT_PLACE)
    at = at.select("num", F.lit(1).alias("rank"), F.lit("place").alias("how"), "id")
    by_code = own.filter("code is not null").join(flagged.filter("gtin is not null").select(F.col("id"), "place", F.lpad("gtin", 14, "0").alias("g")), F.lpad("code", 14, "0") == F.col("g"))
    by_code = by_code.groupBy("num").agg(F.min_by("id", "place").alias("id")).select("num", F.lit(2).alias("rank"), F.lit("barcode").alias("how"), "id")
    open_ = own.join(at.union(by_code).select("num").distinct(), "num", "left_anti")
    near = most_alike(open_, named, LOOKUP_BY_NAME)
    first = named.groupBy("b").agg(F.min(F.struct("place", "id")).alias("f"))
    by_name = open_.join(near, "a").join(first, "b").groupBy("num").agg(F.min("f").alias("f")).select("num", F.lit(3).alias("rank"), F.lit("name").alias("how"), F.col("f.id").alias("id"))
    return at.union(by_code).union(by_name).groupBy("num").agg(F.min(F.struct("rank", "how", "id")).alias("m")).select("num", "m.how", "m.id")


def branch_evidence(flyers: DataFrame, branch: DataFrame) -> DataFrame:
    """flyer_id, branch_id, ratio: the branch of the flyer's chain whose name its title is most like, from BRANCH on (ties:
    lowest branch_id). Titles and names are compared once each, and only where they can be alike."""
    f = flyers.select("flyer_id", "chain", plain_name("title").alias("a"))
    b = branch.select("branch_id", "chain", plain_name("name").alias("b"))
    near = most_alike(f, b, BRANCH, ["chain"]).join(b.groupBy("chain", "b").agg(F.min("branch_id").alias("branch_id")), ["chain", "b"])
    best = near.groupBy("chain", "a").agg(F.min("branch_id").alias("branch_id"), F.first("score").alias("score"))
    return f.join(best, ["chain", "a"]).select("flyer_id", "branch_id", F.round("score", 6).alias("ratio"))


SHOPS = ("Supermercado Aurora", "SUPER AURORA", "Aurora - Loja 2", "Aurora Norte", "Mercado Boa Vista", "Boa Vizta", "Chain 1", "Mercadinho do Porto", "Porto", "Loja")


def _places(s, d) -> DataFrame:
    from feira.sources.domain import pick

    b = branches(s, d)
    return b.select("id", pick(SHOPS, F.col("id") * 7).alias("name"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("City "), (F.col("id") % 4).cast("string"))).otherwise("").alias("city"), "address")


def _chains(s, d) -> DataFrame:
    return discovered_chains(_places(s, d), stores(s, d).select("name").distinct())


def _q_sync(s, d):
    known = s.createDataFrame([("aurora", "accepted", "2000-01-01", "2000-01-01", 3), ("velha", "rejected", "2000-01-01", "2000-02-01", 1)], "key string, status string, first_seen string, last_seen string, branches long")
    return synced_candidates(known, _chains(s, d), F.lit("2001-01-15"))


def _q_images(s, d):
    p, k = products(s, d).select("id", "name", "brand"), F.col("id")
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), name.alias("name"), brand.alias("brand"), image.alias("image")) for kind, name, brand, image in (
        ("gtin", F.lit("x"), F.lit(None).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("g"), k.cast("string")))),
        ("search", F.array_join(F.reverse(F.split(F.upper("name"), " ")), " "), F.lit(None).cast("string"), F.when(k % 4 != 0, F.concat(F.lit("s"), k.cast("string")))),
        ("search", F.lit("zzz"), F.col("brand"), F.concat(F.lit("t"), k.cast("string"))),
    )])
    return image_matches(p, p.select("id", F.explode(kinds).alias("f")).select("id", "f.*"))


def _q_ladder(s, d):
    p, k = products(s, d), F.col("id")
    flagged = p.select(k.alias("place"), "id", "name", "gtin")
    reordered = F.array_join(F.reverse(F.split("name", " ")), " ")
    name = F.when(k % 3 == 0, F.col("name")).when(k % 6 == 2, reordered).otherwise("zzzz")
    # the numbers of rows to be found by name are those of no product
    num = F.when(k % 6 == 2, -k).otherwise(k)
    return looked_up(p.select(num.alias("num"), name.alias("name"), F.when(k % 3 == 1, F.col("gtin")).alias("gtin")), flagged)


def _q_evidence(s, d):
    b = branches(s, d)
    flyer = b.select((F.col("id") * 10).alias("flyer_id"), "chain", F.upper("name").alias("title"))
    return branch_evidence(flyer, b.select(F.col("id").alias("branch_id"), "chain", F.concat(F.col("name"), F.lit(" x")).alias("name")))


QUERIES = {
    "ag_chain_discovery": _chains,
    "st_candidate_sync": _q_sync,
    "jn_image_best_match": _q_images,
    "jn_lookup_ladder": _q_ladder,
}

_PICK = "[" + ", ".join(f"'{x}'" for x in SHOPS) + "]"
_HEADS = """[1, 1, 1, 1, 2, 2, 0, 3, 3, 0]"""
ORACLE_SQL = {
    "jn_image_best_match": with_tables("""SELECT id, CASE WHEN id % 3 = 0 THEN 'g' || id WHEN id % 4 <> 0 THEN 's' || id ELSE 't' || id END AS image, CASE WHEN id % 3 = 0 THEN 'gtin' ELSE 'search' END AS source, 1.0::DOUBLE AS confidence
        FROM products WHERE id % 3 = 0 OR id % 4 <> 0 OR coalesce(brand, '') <> ''""", "products"),
    "jn_lookup_ladder": with_tables("""SELECT id AS num, CASE WHEN id % 3 = 0 THEN 'place' ELSE 'barcode' END AS how, CASE WHEN id % 3 = 0 THEN id ELSE (SELECT min(q.id) FROM products q WHERE q.gtin = p.gtin) END AS id
        FROM products p WHERE id % 3 = 0 OR (id % 3 = 1 AND gtin IS NOT NULL)
        UNION ALL SELECT -p.id, 'name', min(q.id) FROM (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) AS w FROM products) p JOIN (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) AS w FROM products) q USING (w) WHERE p.id % 6 = 2 GROUP BY p.id""", "products"),
    "ag_chain_discovery": with_tables(f"""WITH p AS (SELECT id, {_PICK}[(id * 7) % 10 + 1] AS name, {_HEADS}[(id * 7) % 10 + 1] AS h, CASE WHEN id % 3 <> 0 THEN 'City ' || (id % 4) END AS city, address, (id * 7) % 10 AS k FROM branches)
        SELECT CASE h WHEN 1 THEN 'aurora' WHEN 2 THEN CASE WHEN (SELECT count(*) FROM p WHERE k = 4) >= (SELECT count(*) FROM p WHERE k = 5) THEN 'boa vista' ELSE 'boa vizta' END ELSE 'porto' END AS key,
          (SELECT q.name FROM p q WHERE q.h = p.h GROUP BY 1 ORDER BY count(*) DESC, q.name DESC LIMIT 1) AS name, count(*) AS branches, coalesce(array_to_string(list_sort(list(DISTINCT city) FILTER (WHERE city IS NOT NULL)), ', '), '') AS cities,
          arg_min(address, id) FILTER (WHERE k IN (0, 1, 2) OR h = 3 OR (h = 2 AND k = CASE WHEN (SELECT count(*) FROM p WHERE k = 4) >= (SELECT count(*) FROM p WHERE k = 5) THEN 4 ELSE 5 END)) AS address FROM p WHERE h > 0 GROUP BY h""", "branches"),
}
