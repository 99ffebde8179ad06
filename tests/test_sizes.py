"""Queries whose rows grow beyond what their files let expect: the rows chosen, and the way of their joins."""

import re

import pytest

from feira.plans import public, registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, rows, path):
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("name,row", [("jn_badge_prices", ("pct", 13)), ("jn_box_names", ("name", "Produto 9 200g")), ("jn_price_block", ("name", "Produto 9"))])
def test_first_of_lines_with_one_number(spark, tmp_path, name, row):
    import os

    lines(spark, [(1, 9, 1, 1, 1.0, 3000.0, 0.02), (1, 4, 1, 1, 1.0, 2000.0, 0.05)], f"{tmp_path}/lineitem.parquet")
    first = [f for f in os.listdir(f"{tmp_path}/lineitem.parquet") if f.endswith(".parquet")][0]
    os.rename(f"{tmp_path}/lineitem.parquet/{first}", f"{tmp_path}/lineitem.parquet/a.parquet")
    # a larger file is read first, though it stands behind
    lines(spark, [(1, 3, 1, 1, 1.0, 1000.0, 0.08)] + [(k, 7, 1, 6, 1.0, 1.0 + k, 0.0) for k in range(2, 3000)], f"{tmp_path}/lineitem.parquet")
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert [r[row[0]] for r in got] == [row[1]]


@pytest.mark.parametrize("name", ["jn_badge_prices", "jn_box_names", "jn_price_block"])
def test_boxes_are_never_broadcast(spark, name):
    assert "Broadcast" not in plan_of(registry.queries()[name](spark, "/root/testdata/sf0.001"))


def test_scopes_are_made_for_coverages_not_flyers(spark, tmp_path):
    """Flyers times stores are never rows: at 1 GB they would be 58,000,000,000."""
    spark.range(600).selectExpr("id AS o_orderkey", "timestamp'2000-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id AS s_suppkey", "'x' AS s_name", "1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    df = registry.queries()["ag_flyer_scope"](spark, str(tmp_path))
    assert not re.search(r"keys=\[flyer_id#\d+L", plan_of(df))
    got, want = {r.flyer_id: r.scope for r in df.collect()}, {}
    for f in (f for f in range(600) if f % 7 < 5):
        every = [x for x in range(40) if x % 5 == f % 7]
        gone = [x for x in every if (f // 40 + x) % 4 == 0 and f % 80]
        want[f] = "all except " + ",".join(map(str, gone)) if gone else "all"
    assert got == want


def test_near_barcodes_against_all_edits(spark):
    import random

    from feira.operators.warehouse import barcode_near

    rng = random.Random(4)
    known = sorted({"".join(rng.choice("0123") for _ in range(rng.choice([11, 12]))) for _ in range(60)} | {"7891234567895", "789123456789A", "1111111111111"})

    def edited(c):
        i = rng.randrange(len(c) - 1)
        return rng.choice([c, c[:i] + c[i + 1 :], c[:i] + rng.choice("012A") + c[i:], c[:i] + rng.choice("012A") + c[i + 1 :], c[:i] + c[i + 1] + c[i] + c[i + 2 :], c[::-1]])

    reads = [(i, edited(edited(rng.choice(known)) if i % 3 == 0 else rng.choice(known))) for i in range(300)]
    reads += [(0, "7891234567895"), (400, None), (401, "7891234567"), (402, "7891234567890"), (403, "78912345678950"), (404, "78912345678A5"), (405, "111111111111"), (406, "7891234567985")]

    def near(c):
        out = {c}
        for i in range(len(c) + 1):
            out |= {c[:i] + x + c[i + k :] for x in "0123456789" for k in (0, 1)} | {c[:i] + c[i + 1 :], c[:i] + c[i + 1 : i + 2] + c[i : i + 1] + c[i + 2 :]}
        return out

    hits = {}
    for i, c in reads:
        if c is not None and len(c) >= 11:
            hits.setdefault(i, []).extend(sorted(near(c) & set(known)))
    got = barcode_near(spark.createDataFrame(reads, "id long, key string"), spark.createDataFrame([(k,) for k in known], "gtin string"))
    assert {r.id: r.gtin for r in got.collect()} == {i: h[0] for i, h in hits.items() if len(h) == 1}


def test_near_barcodes_are_never_broadcast(spark):
    assert "Broadcast" not in plan_of(registry.queries()["jn_barcode_near"](spark, "/root/testdata/sf0.1"))


def test_ids_of_products_are_never_broadcast(spark):
    assert "Broadcast" not in plan_of(registry.queries()["flt_priced_products"](spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in plan_of(public.match_products(public.products(spark, "/root/testdata/sf0.001")))


def test_shuffles_of_a_written_table_are_dropped(spark, tmp_path, monkeypatch):
    """All shuffles of an operator lay on disk together until the driver happened to collect its garbage."""
    import time

    from feira.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = held.size()
    out = common.written(spark.range(1000).repartition(7, "id").groupBy("id").count(), "x")
    for _ in range(100):  # beside Spark's other work
        if held.size() <= before:
            break
        time.sleep(0.1)
    assert held.size() <= before and out.count() == 1000 and spark.conf.get(common.DROP_SHUFFLE) == "false"


def test_postings_are_never_written_whole(spark, monkeypatch):
    from feira.llm import common, ngram_join

    names = []
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (names.append(name), common.written(df, name))[1])
    words = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(words + [w + " more" for w in words[:9]])), "doc_id long, text string")
    ids = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert ids == {i: i - 30 if i >= 30 else i for i in range(39)} and "join-index" not in names
