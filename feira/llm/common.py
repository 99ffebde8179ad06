"""What the corpus operators share: table access, shared storage, byte-level words and hashing helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Rows per Arrow batch asked of Spark for document texts: keeps a Python worker's batch to a few MB.
BATCH_ROWS = 1000

#: ASCII white space that parts words, as in the class [^\x20\x09-\x0D]+; ``bytes.split()`` parts at exactly these.
SPACE = r"[ \t\n\x0B\f\r]+"


#: The folder of local sessions without spark.checkpoint.dir (tests).
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. A temporary one only in a local session,
    whose executors are the driver; a cluster must name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        folder = _OWN[0]
    return folder.rstrip("/")


#: Whether Spark drops the shuffle files of a job when the job has ended, not some time later.
DROP_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: cuts lineage and survives lost executors.

    What was shuffled for it is dropped at once, so that the shuffles of several steps never lie on disk together.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLE, "false")
    spark.conf.set(DROP_SHUFFLE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLE, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size so that batches of whole texts stay small in Python workers; a size already
    at most that stays. It must hold when a lazily returned result runs, so it isn't set back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def aside(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that an operator needs for itself, changed where ``df`` has them (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash with names an operator adds (compared without case, as Spark resolves them)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def texts(batch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column of an Arrow batch; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


_MIX = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words (bytes), remembered per Python worker up to ``limit`` words and then begun anew.

    The hash of a word never depends on what was seen before, so every task and retry agrees.
    """

    def __init__(self, limit: int = 150_000):
        self.seen: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        if len(self.seen) > self.limit:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def plain_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of an Arrow column of texts, found with numpy: bytes of all words with one space after each, where those
    spaces are, and the words before each text (one more than texts). Null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(column)
    raw = column.cast(pa.large_binary()).fill_null(b"")
    none = pa.array([b""], pa.large_binary())
    raw = pa.concat_arrays([none, raw, none])  # so that a space stands before and after every text
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n + 2], pa.int32()), raw), pa.scalar(b" ", pa.large_binary()))
    x = np.frombuffer(joined.buffers()[2], np.uint8, len(joined[0].as_buffer()))
    first = np.cumsum(pc.binary_length(raw).to_numpy() + 1)[:-1]  # of each text in x
    space = _IS_SPACE[x]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2] + 1, edges[1::2] + 1
    keep = ~space
    keep[1:] |= keep[:-1]
    body = x[keep]
    after = np.cumsum(ends - starts + 1) - 1
    body[after] = 32
    return body, after, np.searchsorted(starts, first)


def word_hashes(body: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``plain_words``, by reading eight bytes at a time."""
    from xxhash import xxh3_64_intdigest

    starts = np.append(0, after[:-1] + 1)[: len(after)]
    sizes = after - starts
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(body) + 1,), "<u8", padded, strides=(1,))
    out = mix64((eight[starts] & _LOW_BYTES[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * np.uint64(_MIX))
    rest, at = np.flatnonzero((sizes > 8) & (sizes <= 64)), 8
    while len(rest):
        out[rest] = mix64(out[rest] * np.uint64(3) ^ (eight[starts[rest] + at] & _LOW_BYTES[np.minimum(sizes[rest] - at, 8)]))
        at += 8
        rest = rest[sizes[rest] > at]
    for k in np.flatnonzero(sizes > 64).tolist():
        out[k] = xxh3_64_intdigest(body[starts[k] : after[k]].tobytes())
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (order matters)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = mix64(h + words[k : k + m] + np.uint64(_MIX * (k + 1) % (1 << 64)))
    return h


@F.arrow_udf(LongType())
def count_words(text):
    """Words of the class [^\\x20\\x09-\\x0D]+ in a whole text; null: 0."""
    import pyarrow as pa

    return pa.array([0 if x is None else len(x.split()) for x in text.cast(pa.binary()).to_pylist()], pa.int64())


def no_rows(df: DataFrame) -> bool:
    return not df.take(1)


def utf8_size(column: str = "text"):
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
