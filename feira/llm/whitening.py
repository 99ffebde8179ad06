"""Operator 11: embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

An entry c becomes the whole number floor(256 * c). The fit list X is each distinct vector once. Alternating products
u = Xv and w = X'u on centred rows build U'XV = B, B upper bidiagonal. Both sides are orthogonalised anew against all
earlier vectors. The SVD of the small B gives the components and their deviations.

A vector u is as long as the table, so it is never stored: u = Xp for a p of the length of a row, kept by the driver. One
Spark job a step forms the rows' values Xp, their products with all earlier ones and X'u, and sums them over blocks of
rows. The driver holds a few vectors of the length of an embedding per step, whatever the number of rows.

The iteration ends when the wanted components are settled to double precision and what is left of the total variance
is less than the last one's, so none can have been missed (repeated values included); at the latest after as many steps
as an embedding has entries.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are left out, as are rows of another
length than the commonest (ties: the longest); an entry whose floor is beyond a long takes the nearest long, and a
deviation beyond a long is null. Repeated rows and ids are kept, each with its own result; a null id stays null. A component
whose variance is less than 1e-12 of the whole is none: a table of one distinct vector has no result, an empty one
neither. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.common import table, written

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Rows of a block of the fit list.
BLOCK_ROWS = 2048
#: A residual or a norm below this share of the largest singular value is none.
TINY = 1e-14
#: A variance below this share of the whole is none.
LEAST = 1e-12


def whole_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector, and ``x`` array<long>: floor(256 * c) of each entry."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    usable = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & sound)
    return usable.withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * 256)))


def _matrices(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of int64) for each length of an Arrow column of lists."""
    offsets = np.asarray(column.offsets)
    sizes, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out.append((at, flat[offsets[at][:, None] + np.arange(d)]))
    return out


def fit_blocks(vectors: DataFrame) -> DataFrame:
    """The distinct vectors as a written table of blocks: d (entries of a row), n (rows), data (int64, row by row)."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for _, m in _matrices(batch.column("x")):
                for k in range(0, len(m), BLOCK_ROWS):
                    part = m[k : k + BLOCK_ROWS]
                    yield pa.RecordBatch.from_pydict({"d": pa.array([m.shape[1]], pa.int32()), "n": pa.array([len(part)], pa.int64()), "data": [part.astype("<i8").tobytes()]})

    return written(vectors.select("x").distinct().mapInArrow(pack, "d int, n long, data binary"), "whitening-fit")


def _rows(batch) -> np.ndarray:
    d = batch.column("d")[0].as_py()
    return np.concatenate([np.frombuffer(b, "<i8") for b in batch.column("data").to_pylist()]).reshape(-1, d)


def exact_sums(blocks: DataFrame) -> tuple[int, list[int], int]:
    """n, the sum of each entry and the sum of all squares of the fit list, exactly."""

    def sums(batches):
        import pyarrow as pa

        for batch in batches:
            m = _rows(batch)
            top = int(np.abs(m.astype(float)).max()) + 1
            wide = m if top * top * m.size < 1 << 62 else m.astype(object)
            total = [*map(str, wide.sum(axis=0).tolist()), str(int((wide * wide).sum()))]
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(total)), pa.int32()), "v": total})

    found = blocks.select("d", "data").mapInArrow(sums, "k int, v string").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("k").collect()
    n = blocks.agg(F.sum("n")).first()[0]
    values = [int(r.v) for r in found]
    return n, values[:-1], values[-1]


class Centre:
    """Centring of whole-number rows on S/n, in doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], float)
        self.part = np.array([s % n / n for s in sums])

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return (m.astype(float) - self.whole) - self.part


def products(blocks: DataFrame, centre: Centre, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For u = X p[:, -1]: the product of u with Xp of each column of ``p``, and X'u. One pass over the blocks."""

    def multiply(batches):
        import pyarrow as pa

        total = 0.0
        for batch in batches:
            x = centre(_rows(batch))
            y = x @ p
            total = total + np.concatenate([y.T @ y[:, -1], x.T @ y[:, -1]])
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})

    found = blocks.select("d", "data").mapInArrow(multiply, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(p.shape[1] + p.shape[0])
    for r in found:
        values[r.k] = r.v
    return values[: p.shape[1]], values[p.shape[1] :]


def _apart(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """``x`` without its parts along the orthonormal columns of ``base``, taken off twice."""
    for _ in range(2):
        x = x - base @ (base.T @ x)
    return x


def bidiagonalise(product, d: int, total: float, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of X and its right vectors (columns), the first ``wanted`` of them settled.

    product(p): for a matrix p of d rows, as ``products``. total: the sum of squares of X.
    """
    rng = np.random.default_rng(seed)
    v, p, g = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # g: X'u of each u
    b = np.zeros((d, d))
    nxt, beta, scale = _apart(rng.standard_normal(d), v), 0.0, np.sqrt(total)
    for k in range(d):
        v = np.column_stack([v, nxt / np.linalg.norm(nxt)])
        own = v[:, k] - beta * p[:, k - 1] if k and beta else v[:, k].copy()
        while True:  # again when most of u lay along earlier ones
            dots, image = product(np.column_stack([p, own]))
            before, dots = dots[-1], dots[:-1]
            own, image = own - p @ dots, image - g @ dots
            square = max(0.0, before - dots @ dots)
            if square > 0.25 * before or before <= (TINY * scale) ** 2:
                break
        alpha = np.sqrt(square)
        none = alpha <= TINY * scale
        alpha = 0.0 if none else alpha
        p, g = (np.column_stack([a, np.zeros(d) if none else x / alpha]) for a, x in ((p, own), (g, image)))
        b[k, k] = alpha
        if k:
            b[k - 1, k] = beta
        rest = _apart(g[:, k] - alpha * v[:, k], v)
        beta = float(np.linalg.norm(rest))
        small = b[: k + 1, : k + 1]
        left, sigma, right = np.linalg.svd(small)
        top = min(wanted, k + 1)
        settled = beta * np.abs(left[-1, :top]).max() <= 4 * TINY * sigma[0] and k + 1 >= min(wanted, d)
        missing = max(0.0, total - float((small**2).sum()))
        if settled and (missing < sigma[top - 1] ** 2 or missing <= LEAST * total / 10):
            break
        if beta <= TINY * scale:  # an invariant space: go on from a new direction
            beta, rest = 0.0, _apart(rng.standard_normal(d), v)
        nxt = rest
    return sigma, v @ right.T


def _deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S)^2 of each row, exactly; None beyond a long."""
    top = n * (int(np.abs(m.astype(float)).max()) + 1) + max(map(abs, sums))
    kind = np.int64 if top * top * m.shape[1] < 1 << 62 else object
    t = m.astype(kind) * n - np.array(sums, kind)
    return [x if x < 1 << 63 else None for x in (t * t).sum(axis=1).tolist()]


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4) -> DataFrame:
    """A row for each usable row and component: vec_id, component (from 1), n, deviation, whitened, explained and
    identity_error, as in SCHEMA.

    deviation: sum of (n * x - S)^2; whitened: x - S/n projected on the component over its standard deviation; explained:
    the component's share of all variance; identity_error: largest distance of the whitened fit list's covariance from
    the identity.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, vector).select(F.col(key).cast("long").alias("vec_id"), "x")
    blocks = fit_blocks(vectors)
    lengths = blocks.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    d = lengths[0].d
    blocks = blocks.filter(F.col("d") == d)
    n, sums, squares = exact_sums(blocks)
    spread = n * squares - sum(s * s for s in sums)  # n times the sum of squares of the centred rows, exactly
    if not spread:
        return spark.createDataFrame([], SCHEMA)
    centre, total = Centre(n, sums), spread / n
    sigma, right = bidiagonalise(lambda p: products(blocks, centre, p), d, total, components)
    kept = int((sigma[:components] ** 2 > LEAST * total).sum())
    to_white = right[:, :kept] / (sigma[:kept] / np.sqrt(n))
    gram = np.zeros((kept, kept))
    for k in range(kept):  # the columns of the whitened covariance, measured on all rows
        gram[: k + 1, k] = products(blocks, centre, to_white[:, : k + 1])[0] / n
        gram[k, : k + 1] = gram[: k + 1, k]
    error = float(np.abs(gram - np.eye(kept)).max())
    explained = sigma[:kept] ** 2 / total

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("vec_id")
            for at, m in _matrices(batch.column("x")):
                if m.shape[1] != d:
                    continue
                y, rows = centre(m) @ to_white, len(m)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.take(pa.array(np.repeat(at, kept))),
                        "component": pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)),
                        "n": pa.array(np.full(rows * kept, n)),
                        "deviation": pa.array([x for x in _deviations(m, n, sums) for _ in range(kept)], pa.int64()),
                        "whitened": pa.array(y.ravel()),
                        "explained": pa.array(np.tile(explained, rows)),
                        "identity_error": pa.array(np.full(rows * kept, error)),
                    }
                )

    return vectors.mapInArrow(score, SCHEMA)


def op11_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
