"""The streaming forms over files, against their batch forms."""

import datetime as dt

import pytest

from feira.sources.files import BucketTable, added
from feira.streaming.prices import deduplicated, drain, into, upsert_stream, windowed_changes

SCHEMA = "product_id long, store_id long, price double, scraped_at timestamp"


def stream(spark, tmp_path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def table(spark, tmp_path, *key):
    return BucketTable(spark, f"file://{tmp_path}/table", list(key))


def test_upsert_keeps_changes_and_ignores_late_rows(spark, tmp_path):
    held = table(spark, tmp_path, "product_id", "store_id")
    parts = [
        [(1, 1, 2.0, day(1)), (2, 1, 5.0, day(1))],
        [(1, 1, 2.5, day(2)), (1, 1, 2.5, day(3)), (1, 1, 7.0, day(3)), (2, 1, 5.0, day(4))],
        [(1, 1, 9.0, day(0)), (1, 1, 9.0, day(3))],  # late, and repeated with another price
        [(3, 3, 1.0 + k, day(k)) for k in range(30)],
    ]
    got = []
    for i, rows in enumerate(parts):  # the stream starts anew from its checkpoint for each part
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        drain(upsert_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), f"{tmp_path}/c{i > 9}", into(held))
        got.append({(r.product_id, r.price_cents, r.observed_at, r.changes) for r in held.read().collect()})
    assert got[0] == {(1, 200, day(1), 0), (2, 500, day(1), 0)}
    assert got[1] == got[2] == {(1, 250, day(3), 1), (2, 500, day(4), 0)}
    assert got[3] == got[2] | {(3, 3000, day(29), 20)}


def test_upsert_against_a_plain_loop_and_calls_for_products_together(spark, tmp_path):
    """Keys share a state; a call for each key took longest."""
    import random

    from feira.operators.state import HISTORY
    from feira.streaming import prices as streaming

    rng, held, state = random.Random(3), table(spark, tmp_path, "product_id", "store_id"), {}
    for turn in range(3):
        rows = [(rng.randrange(0, 200, 7), rng.randrange(3), rng.randrange(1, 4) / 4, day(rng.randrange(turn * 20, turn * 20 + 40))) for _ in range(900)]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        drain(streaming.upsert_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), f"{tmp_path}/c", into(held))
        new = {}
        for p, s, price, at in rows:
            new[p, s, at] = min(new.get((p, s, at), 1000), round(price * 100))
        for p, s, at in sorted(new, key=lambda k: k[2]):
            cents, seen, changes = state.get((p, s), (None, None, 0))
            if seen is None or at > seen:
                state[p, s] = (new[p, s, at], at, min(HISTORY, changes + (cents is not None and cents != new[p, s, at])))
        assert {(r.product_id, r.store_id): (r.price_cents, r.observed_at, r.changes) for r in held.read().collect()} == state
    assert max(x[2] for x in state.values()) == HISTORY
    src = streaming.upsert_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    assert "[products" in src._jdf.queryExecution().analyzed().toString()


def test_dedup_and_a_batch_sent_twice(spark, tmp_path):
    rows = [(1, 1, 2.0, day(1)), (1, 1, 2.0, day(1)), (1, 2, 2.0, day(1))]
    src = stream(spark, tmp_path, rows, rows)
    q = deduplicated(src).writeStream.format("memory").queryName("dd").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dd").count() == 2
    key = ["product_id", "store_id", "scraped_at", "price"]
    held = table(spark, tmp_path, *key)
    sink = into(held, added(key))
    once = spark.createDataFrame(rows, SCHEMA).dropDuplicates(key)
    for number in (0, 0, 1):
        sink(once, number)
        assert held.read().count() == 2


def test_a_save_reads_and_writes_only_its_buckets(spark, tmp_path):
    held = table(spark, tmp_path, "k")
    assert held.read() is None and held.save(spark.createDataFrame([], "k long, v long")) is None
    held.save(spark.createDataFrame([(i, 0) for i in range(200)], "k long, v long"))
    files = {f.name for f in tmp_path.glob("table/bucket=*/*.parquet")}
    held.save(spark.createDataFrame([(7, 1), (1000, 2)], "k long, v long"))
    left = {f.name for f in tmp_path.glob("table/bucket=*/*.parquet")} & files
    assert len({f.parent.name for f in tmp_path.glob("table/bucket=*/*.parquet") if f.name in left}) in (14, 15)
    assert {r.k: r.v for r in held.read().collect()} == {i: int(i == 7) for i in range(200)} | {1000: 2}
    plan = held.read([3])._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]  # other buckets aren't read


@pytest.mark.parametrize("again", [False, True])
def test_a_merge_that_adds_leaves_what_is_there(spark, tmp_path, again):
    held = table(spark, tmp_path, "k")
    held.save(spark.createDataFrame([(1, 1), (2, 1)], "k long, v long"))
    for _ in range(1 + again):
        held.save(spark.createDataFrame([(2, 2), (3, 2)], "k long, v long"), added(["k"]))
    assert {r.k: r.v for r in held.read().collect()} == {1: 1, 2: 1, 3: 2}


def test_windows(spark, tmp_path):
    src = stream(spark, tmp_path, [(1, 1, 2.0, day(1)), (1, 1, 1.0, day(2))], [(1, 1, 3.0, day(90))], [(1, 1, 3.0, day(91))])
    q = windowed_changes(src).writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/c4").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.rows, r.low) for r in spark.table("win").collect()] == [(2, 1.0)]
