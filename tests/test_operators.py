"""Entity groups, complete runs, state and ranks on small tables; every registered query against its oracle is the driver's."""

import datetime as dt

from feira.operators import listing, offers, state
from feira.plans import public, registry


def test_unsized_joins_the_only_size(spark):
    p = spark.createDataFrame([(1, "Arroz Tio Branco 1kg"), (2, "ARROZ BRANCO TIO"), (3, "Tio Arroz Branco 1 kg"), (4, "Arroz")], "id long, name string")
    assert {(r.id, r.rep) for r in public.match_products(p).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_unsized_stay_apart_from_two_sizes(spark):
    p = spark.createDataFrame([(1, "Cafe Pilao 250g"), (2, "Cafe Pilao 500g"), (3, "Cafe Pilao"), (4, "Pilao Cafe")], "id long, name string")
    assert {(r.id, r.rep) for r in public.match_products(p).collect()} == {(1, 1), (2, 2), (3, 3), (4, 3)}


def test_small_run_is_set_aside_at_the_boundary(spark):
    rows = [(1, "a", True, 100, "r1"), (2, "a", False, 0, "r2"), (3, "a", True, 24, "r3"), (4, "b", True, 100, "s1"), (5, "b", True, 25, "s2")]
    run = spark.createDataFrame(rows, "id long, site_key string, success boolean, items_found int, run_id string")
    assert {(r.site_key, r.run_id) for r in listing.listed_runs(run).collect()} == {("a", "r1"), ("b", "s2")}


def test_history_keeps_the_newest(spark):
    t = dt.datetime(2026, 1, 1)
    history = [(100 + i, t) for i in range(20)]
    cur = spark.createDataFrame([(1, 1, 9.0, t, history), (2, 1, 5.0, t, [])], "product_id long, store_id long, price double, seen_at timestamp, history array<struct<price_cents:int,observed_at:timestamp>>")
    found = spark.createDataFrame([(1, 1, 8.0, t, 1), (2, 1, 5.0, t, 2), (3, 1, 1.0, t, 3)], "product_id long, store_id long, price double, scraped_at timestamp, id long")
    got = {r.product_id: r for r in state.price_upsert(cur, found).collect()}
    assert len(got[1].history) == 20 and got[1].history[-1].price_cents == 900 and got[1].history[0].price_cents == 101
    assert got[2].history == [] and got[3].price == 1.0
    again = {r.product_id: r for r in state.price_upsert(state.price_upsert(cur, found), found).collect()}
    assert again == got  # a repeated batch changes nothing


def test_ranked_and_last_known_are_disjoint(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    own, _ = offers._offers(spark, d)
    ranked = offers.rank_offers(own, offers._now()).select("id")
    stale = offers.rank_offers(own, offers._now(), state="stale").select("id")
    assert ranked.intersect(stale).count() == 0


def test_every_oracle_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_imports():
    import __spark_entry__ as e

    assert "ord_daily_deals" in e.queries()


def test_content_tag_ignores_order_and_volatile_columns(spark):
    from feira.operators.lookup import content_tag

    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id long, v string, seen long")
    b = spark.createDataFrame([(2, "y", 9), (1, "x", 9)], "id long, v string, seen long")
    c = spark.createDataFrame([(2, "y", 9), (1, "z", 9)], "id long, v string, seen long")
    tags = [content_tag(x, ("seen",)).first().etag for x in (a, b, c)]
    assert tags[0] == tags[1] != tags[2]


def test_published_list_keeps_every_offer(spark):
    t, n = dt.datetime(2001, 1, 1), 450
    product = spark.createDataFrame([(i, f"Produto a{i} b{i} 1kg", None, None, None) for i in range(n)], "id long, name string, brand string, gtin string, image_url string")
    store = spark.createDataFrame([(1, "Chain 0", None, "https://chain0.com.br")], "id long, name string, city string, website string")
    price = spark.createDataFrame([(i, i, 1, 2.0, None, None, "r1", t, None, None) for i in range(n)], "id long, product_id long, store_id long, price double, regular_price double, offer string, run_id string, scraped_at timestamp, stock int, url string")
    run = spark.createDataFrame([(1, "Chain 0", True, n, "r1")], "id long, site_key string, success boolean, items_found int, run_id string")
    sold, shown = public.build_public(product, store, price, run)
    assert {r.product_id for r in sold.select("product_id").collect()} == {r.id for r in shown.select("id").collect()} == set(range(n))
