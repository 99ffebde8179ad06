"""Operator 2: sharding by histogram sort with sampling.

Rows are ordered by (hash of the text, doc_id): equal texts lie side by side, and a group of copies larger than a
shard is still split between its doc_ids. Splitters are found on the keys alone: sample keys inside the intervals that
may hold a splitter, count exactly the bytes below each over all partitions, narrow the intervals, and repeat until the
bytes below each splitter are within ``tolerance`` or no key is left between. Then the rows move once.

Law ``bytes``: shard sizes are near equal. Each shard is made of ``parts`` equal ranges, so that no task holds a whole
shard; a row's slot is the rows of its shard's earlier ranges plus its place in its own.

Edge cases: null text has 0 bytes, null doc_id orders first; rows equal in text and doc_id share a key, stay in one
shard and get different slots; with fewer keys than shards some shards stay empty; an empty table gives no rows;
columns named like the added ones are replaced, all others stay; a text of any length counts with all its bytes. Copies
of a text are parted where a splitter falls among them: near equal sizes come before keeping groups together.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.llm.common import aside, fresh, table, utf8_size, written

#: Bytes of a range that one task orders, when a shard is larger than ``LEAST_PARTS`` of them.
PART_BYTES = 256 << 20
LEAST_PARTS = 8
#: Sampled keys per open interval and round.
PROBES = 6


def _places(high: np.ndarray, low: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many of ``keys`` (n x 2, ascending) are at most each (high, low)."""
    left, right = np.searchsorted(keys[:, 0], high, "left"), np.searchsorted(keys[:, 0], high, "right")
    out = left.copy()
    tied = np.flatnonzero(left != right)
    for a in np.unique(left[tied]) if len(tied) else ():
        rows = tied[left[tied] == a]
        out[rows] = a + np.searchsorted(keys[a : right[rows[0]], 1], low[rows], "right")
    return out


def _count_below(sizes: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows strictly below each key, over all partitions: one row per interval and partition is summed."""
    n = len(keys)

    def histogram(batches):
        import pyarrow as pa

        size, rows = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for b in batches:
            at = _places(b.column("h").to_numpy(), b.column("id").to_numpy(), keys)
            size += np.bincount(at, b.column("size").to_numpy(), n + 1).astype(np.int64)
            rows += np.bincount(at, minlength=n + 1)
        yield pa.RecordBatch.from_pydict({"at": np.arange(n + 1, dtype=np.int32), "size": size, "rows": rows})

    sums = sizes.select("h", "id", "size").mapInArrow(histogram, "at int, size long, rows long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    got = {r.at: (r.size, r.rows) for r in sums.collect()}
    each = np.array([got.get(k, (0, 0)) for k in range(n)], np.int64).reshape(n, 2)
    return np.cumsum(each[:, 0]), np.cumsum(each[:, 1])


def _sample(sizes: DataFrame, low: np.ndarray, high: np.ndarray, share: float, turn: int) -> np.ndarray:
    """Keys strictly inside the intervals (low, high), each kept with probability ``share`` by a hash of key and turn:
    a few for each interval. Repeated rows share a key and are kept or left together."""
    bound = int(min(1.0, share) * (1 << 30))

    def pick(batches):
        import pyarrow as pa

        for b in batches:
            h, i = b.column("h").to_numpy(), b.column("id").to_numpy()
            at = _places(h, i, low) - 1  # the last interval that begins at or below
            ok = at >= 0
            lo, hi = low[np.maximum(at, 0)], high[np.maximum(at, 0)]
            ok &= ((h > lo[:, 0]) | (i > lo[:, 1])) & ((h < hi[:, 0]) | ((h == hi[:, 0]) & (i < hi[:, 1])))
            inside = np.unique(np.column_stack([h[ok], i[ok]]), axis=0)
            yield pa.RecordBatch.from_pydict({"h": inside[:, 0], "id": inside[:, 1]})

    luck = F.pmod(F.xxhash64("h", "id", F.lit(turn)), F.lit(1 << 30))
    rows = sizes.filter(luck < bound).select("h", "id").mapInArrow(pick, "h long, id long")
    return np.array([(r.h, r.id) for r in rows.collect()], np.int64).reshape(-1, 2)


def _ordered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, axis=0) if len(keys) else keys.reshape(-1, 2)


def splitters(sizes: DataFrame, n: int, tolerance: float) -> np.ndarray:
    """n - 1 keys that cut ``sizes`` (h, id, size) into n ranges of near equal bytes; a range begins at its key.

    What the driver holds is a few keys for each splitter, whatever the number of rows.
    """
    whole = sizes.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    if not whole.rows or n < 2:
        return np.empty((0, 2), np.int64)
    goals = whole.size * np.arange(1, n) / n
    slack = tolerance * whole.size / n
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    known = np.array([[least, least], [most, most]], np.int64)
    below, rows = np.array([0, whole.size]), np.array([0, whole.rows])
    closed = np.zeros(n - 1, bool)
    for turn in count():  # each turn cuts the open intervals about PROBES-fold, until none is left
        right = np.searchsorted(below, goals, "left")  # the first known key with at least the goal below it
        left = np.maximum(right - 1, 0)
        gap = np.minimum(below[right] - goals, goals - below[left])
        closed |= gap <= slack
        # an interval that holds its left key only can't be cut further
        open_ = np.unique(left[~closed])
        open_ = open_[rows[open_ + 1] - rows[open_] > 1]
        if not len(open_):
            break
        inside = int((rows[open_ + 1] - rows[open_]).sum())
        share = PROBES * len(open_) / inside
        found = _sample(sizes, known[open_], known[open_ + 1], share, turn)
        while not len(found) and share < 1:  # few keys, often repeated: a larger share, by steps that stay a few keys each
            share *= 8
            found = _sample(sizes, known[open_], known[open_ + 1], share, turn)
        if not len(found):
            break  # the intervals hold repeated rows of one key
        fresh_keys = _ordered(found)
        if len(fresh_keys):
            new_below, new_rows = _count_below(sizes, fresh_keys)
            known, below, rows = np.vstack([known, fresh_keys]), np.append(below, new_below), np.append(rows, new_rows)
            order = np.lexsort((known[:, 1], known[:, 0]))
            known, below, rows = known[order], below[order], rows[order]
    right = np.searchsorted(below, goals, "left")
    left = np.maximum(right - 1, 0)
    nearer = np.where(below[right] - goals <= goals - below[left], right, left)
    return known[nearer]


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.02, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with size, shard, slot and law ``bytes``, moved once so that each range of a shard lies together.

    tolerance: of a range's share of bytes, for each splitter.
    """
    docs = fresh(docs, "size", "shard", "slot", "law", "range_no", "key_h", "key_id")
    own, earlier_rows = aside(docs, "place", "earlier")
    keyed = docs.withColumns(
        {"size": utf8_size() + 16, "key_h": F.xxhash64("text"), "key_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))}
    )
    sizes = written(keyed.select(F.col("key_h").alias("h"), F.col("key_id").alias("id"), "size"), "shard-keys")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-total // (shards * part_bytes)))
    cuts = splitters(sizes, shards * parts, tolerance)

    @F.arrow_udf("int")
    def range_of(h, i):
        import pyarrow as pa

        return pa.array(_places(h.to_numpy(zero_copy_only=False), i.to_numpy(zero_copy_only=False), cuts).astype(np.int32))

    rows = sizes.groupBy(range_of("h", "id").alias("range_no")).count()
    earlier = Window.partitionBy(F.floor(F.col("range_no") / parts)).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("range_no", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    placed = keyed.withColumn("range_no", range_of("key_h", "key_id")).repartition("range_no")
    place = Window.partitionBy("range_no").orderBy("key_h", "key_id")
    placed = placed.withColumn(own, F.row_number().over(place)).join(rows.withColumnRenamed("earlier", earlier_rows), "range_no")
    placed = placed.withColumns(
        {"shard": F.floor(F.col("range_no") / parts).cast("int"), "slot": (F.col(earlier_rows) + F.col(own) - 1).cast("long"), "law": F.lit("bytes")}
    )
    return placed.drop("key_h", "key_id", "range_no", own, earlier_rows)


def op2_sharding(spark, sf_dir):
    out = shard(table(spark, sf_dir, "documents"), 40)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
