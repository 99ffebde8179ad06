"""Structured Streaming forms of the keyed price state.

``upsert_stream`` keeps the current price and the newest changes of each (product, store) in the state store, some products
together;
``deduplicated`` drops repeated observations inside a watermark; ``windowed_changes`` counts price rows by time window;
``into`` is a sink that writes micro-batches into a bucketed table, reading only the buckets that a batch touches.

The registered queries send the prices in parts, by time, some rows again and some late, and start the stream anew from its
checkpoint for each part, so state and tables must carry over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from feira.operators.state import HISTORY
from feira.sources.domain import prices, with_tables
from feira.sources.files import BucketTable, added, new_folder

OUTPUT = "product_id long, store_id long, price_cents int, at long, changes int"
KEY = ["product_id", "store_id"]
#: Products that share a state: a call of Python and two reads of the state store serve all their keys.
TOGETHER = 64


def _bytes(table) -> bytes:
    """A pandas table as Arrow's stream format."""
    import pyarrow as pa

    own = pa.Table.from_pandas(table, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, own.schema) as writer:
        writer.write_table(own)
    return out.getvalue().to_pybytes()


def _table(state):
    """The pandas table of rows (product_id, store_id, price_cents, at) that a value state holds; empty before the first."""
    import pandas as pd
    import pyarrow as pa

    if state.exists():
        return pa.ipc.open_stream(bytes(state.get()[0])).read_pandas()
    return pd.DataFrame({c: pd.Series(dtype="int64") for c in (*KEY, "price_cents", "at")})


class PriceState(StatefulProcessor):
    """The newest price of each key of some products and, HISTORY of a key at most, the prices it replaced. Rows that aren't
    newer than the state (late or repeated) change nothing; of several prices at one time the lowest counts."""

    def init(self, handle) -> None:
        self.current = handle.getValueState("current", "rows binary")
        self.history = handle.getValueState("history", "rows binary")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        columns = [*KEY, "price_cents", "at"]
        found = pd.concat([x[columns] for x in rows]).groupby([*KEY, "at"], as_index=False)["price_cents"].min()[columns]
        touched = found[KEY].drop_duplicates()
        current, history = _table(self.current), _table(self.history)
        seen = found[KEY].merge(current[[*KEY, "at"]], on=KEY, how="left")["at"].to_numpy()
        new = found[~(found["at"].to_numpy() <= seen)]  # without a state there is no time to be newer than
        if len(new):
            said = current.merge(new[KEY].drop_duplicates(), on=KEY)
            said = pd.concat([said, new]).sort_values([*KEY, "at"], kind="stable", ignore_index=True)
            after = said.groupby(KEY)["price_cents"].shift(-1)
            changed = said[after.notna() & (after != said["price_cents"])]
            newest = said.drop_duplicates(KEY, keep="last")
            current = pd.concat([current, newest]).drop_duplicates(KEY, keep="last")
            self.current.update((_bytes(current),))
            if len(changed):
                # a price that stays counts from when it was last seen
                history = pd.concat([history, changed]).groupby(KEY).tail(HISTORY)
                self.history.update((_bytes(history),))
        changes = history.groupby(KEY).size().rename("changes").reset_index()
        out = touched.merge(current, on=KEY).merge(changes, on=KEY, how="left").fillna({"changes": 0})
        yield out[[*columns, "changes"]].astype({"price_cents": "int32", "changes": "int32"})

    def close(self) -> None:
        pass


def upsert_stream(price: DataFrame) -> DataFrame:
    """A row for each key that a micro-batch touched: its current price and number of kept changes."""
    cents = F.bround(F.col("price") * 100, 0).cast("int").alias("price_cents")
    own = price.select(F.floor(F.col("product_id") / TOGETHER).alias("products"), *KEY, cents, F.unix_micros(F.col("scraped_at").cast("timestamp")).alias("at"))
    told = own.filter("price_cents is not null and at is not null").groupBy("products").transformWithStateInPandas(PriceState(), OUTPUT, "Update", "None")
    return told.select(*KEY, "price_cents", F.timestamp_micros("at").alias("observed_at"), "changes")


def deduplicated(price: DataFrame, delay: str = "10 days") -> DataFrame:
    """Observations, each once within the watermark."""
    return price.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["product_id", "store_id", "scraped_at", "price"])


def windowed_changes(price: DataFrame, length: str = "30 days", delay: str = "10 days") -> DataFrame:
    """Rows and lowest price by store and window of event time; windows that the watermark has passed leave the state."""
    by = price.withWatermark("scraped_at", delay).groupBy(F.window("scraped_at", length), "store_id").agg(F.count("*").alias("rows"), F.min("price").alias("low"))
    return by.select(F.col("window.start").alias("window_start"), "store_id", "rows", "low")


def into(table: BucketTable, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows replace those of equal key, or merge with them. A micro-batch that is done again after a
    failure leaves the same table."""

    def sink(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # the buckets touched and the rows are one run of the batch
        table.save(held, merge)
        held.unpersist()

    return sink


#: The state store that keeps state of any form.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, checkpoint: str, sink, mode: str = "update") -> None:
    """All that the source holds and hasn't been read yet, through ``sink``; where it stopped is kept in ``checkpoint``."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(STORE[0], before) if before else conf.unset(STORE[0])


def in_parts(parts: list[DataFrame], flow: Callable[[DataFrame], DataFrame], sink, mode: str = "update") -> None:
    """Each part written to the folder of a stream, which then starts anew from its checkpoint and reads what is new."""
    spark = parts[0].sparkSession
    folder, checkpoint = new_folder(spark, "arriving"), new_folder(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(folder)
        drain(flow(spark.readStream.schema(part.schema).parquet(folder)), checkpoint, sink, mode)


CUTS = ("1995-01-01", "1997-01-01")


def _parts(s, d) -> list[DataFrame]:
    own = prices(s, d).select("product_id", "store_id", F.col("scraped_at").cast("timestamp").alias("scraped_at"), "price")
    at = F.col("scraped_at")
    return [own.filter(at < CUTS[0]), own.filter((at >= CUTS[0]) & (at < CUTS[1])), own.filter(at >= CUTS[1])]


def _q_upsert(s, d) -> DataFrame:
    """Parts by time; the second brings rows of the first again, the third late ones of another price."""
    first, second, third = _parts(s, d)
    again = first.filter("store_id % 3 = 0")
    late = first.filter("store_id % 5 = 0").withColumn("price", F.col("price") + 1)
    table = BucketTable(s, new_folder(s, "price-stream"), ["product_id", "store_id"])
    in_parts([first, second.unionByName(again), third.unionByName(late)], upsert_stream, into(table))
    return table.read()


def _q_windows(s, d) -> DataFrame:
    table = BucketTable(s, new_folder(s, "windows"), ["window_start", "store_id"])
    in_parts(_parts(s, d), windowed_changes, into(table))
    return table.read()


def _q_ingest(s, d) -> DataFrame:
    """Parts by time, and the second once more as a whole."""
    first, second, third = _parts(s, d)
    key = ["product_id", "store_id", "scraped_at", "price"]
    table = BucketTable(s, new_folder(s, "observations"), key)
    in_parts([first, second, third, second], lambda rows: rows, lambda batch, number: into(table, added(key))(batch.dropDuplicates(key), number), "append")
    return table.read()


QUERIES = {"stream_price_upsert": _q_upsert, "stream_price_windows": _q_windows, "stream_observations": _q_ingest}

ORACLE_SQL = {
    "stream_price_upsert": with_tables(f"""WITH t AS (SELECT product_id, store_id, scraped_at, round_even(min(price) * 100, 0)::INT AS cents FROM prices GROUP BY 1, 2, 3),
        c AS (SELECT *, lag(cents) OVER (PARTITION BY product_id, store_id ORDER BY scraped_at) <> cents AS changed FROM t)
        SELECT product_id, store_id, arg_max(cents, scraped_at) AS price_cents, max(scraped_at)::TIMESTAMP AS observed_at, least({HISTORY}, count(*) FILTER (WHERE changed))::INT AS changes FROM c GROUP BY 1, 2""", "prices"),
    "stream_price_windows": with_tables("SELECT time_bucket(INTERVAL 30 DAY, scraped_at::TIMESTAMP, TIMESTAMP '1970-01-01') AS window_start, store_id, count(*) AS rows, min(price) AS low FROM prices GROUP BY 1, 2", "prices"),
    "stream_observations": with_tables("SELECT DISTINCT product_id, store_id, scraped_at::TIMESTAMP AS scraped_at, price FROM prices", "prices"),
}
