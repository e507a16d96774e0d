"""Embedding whitening by QDWH spectral divide and conquer.

The covariance is summed up by the executors as one small matrix per task. Its eigenvectors come from polar
decompositions: the orthogonal polar factor U of V - s I has eigenvalues +1 and -1, for eigenvalues of V above and
below the shift s, so (U + I) / 2 projects on the upper invariant subspace. U itself is found by the dynamically
weighted Halley iteration in QR form (Nakatsukasa and Higham, 2013). The covariance is compressed to both
subspaces and these are split again, until single vectors are left. Only the mean and the components,
dimension x components numbers, are sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import map_batches

#: Entries are whole numbers from here on: floor(STEPS * entry) + OFFSET.
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues below this share of the largest count as none; whitening by them would only scale rounding errors.
LEAST_SHARE = 1e-13


@dataclass(frozen=True)
class Whitening:
    """What whitening needs of the fit list: count and sums are exact, components are columns."""

    n: int
    sums: tuple[int, ...]
    components: tuple[tuple[float, ...], ...]
    values: tuple[float, ...]
    trace: float


def polar_factor(a):
    """The orthogonal polar factor of a symmetric matrix without zero eigenvalue, by QDWH iteration.

    Weights follow a lower bound of the singular values, so that about six steps suffice for any
    condition number up to 1e16. Each step is one QR factorisation; no inverse is formed.
    """
    import numpy as np

    m = len(a)
    eye = np.eye(m)
    x = a / np.linalg.norm(a)
    # the bound may be too small (more steps), hence from a norm of the inverse
    try:
        low = 1.0 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low, 1e-17))
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:m] @ q[m:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if moved < 1e-10 and 1 - low < 1e-10:
            break
    return x


def _split(a, shift: float, rng):
    """An orthogonal basis whose first k columns span the subspace of eigenvalues above `shift`, k, and its error."""
    import numpy as np

    m = len(a)
    projector = (polar_factor(a - shift * np.eye(m)) + np.eye(m)) / 2
    k = int(np.clip(round(float(np.trace(projector))), 1, m - 1))
    # the range of the projector, from as many random combinations of its columns as it has rank
    basis, _ = np.linalg.qr(projector @ rng.standard_normal((m, k)), mode="complete")
    basis, _ = np.linalg.qr(projector @ basis[:, :k], mode="complete")
    return basis, k, float(np.abs(basis[:, k:].T @ a @ basis[:, :k]).max())


def spectral_components(v):
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    The shift is the mean of a block's eigenvalues, its trace by its size: unless the block is a multiple of the identity, some lie on
    either side. If one lies on the shift itself, the split fails to decouple, and other shifts are tried.
    """
    import numpy as np

    v = np.asarray(v, float)
    size = np.abs(v).max() if v.size else 0.0
    rng = np.random.default_rng(11)
    values, vectors = [], []
    blocks = [(v, np.eye(len(v)))] if len(v) else []
    while blocks:
        a, basis = blocks.pop()
        m = len(a)
        mean = float(np.trace(a)) / m
        spread = float(np.linalg.norm(a - mean * np.eye(m)))
        if m == 1 or spread <= 4 * np.finfo(float).eps * size:
            values += [float(x) for x in np.diag(a)]
            vectors += list(basis.T)
            continue
        best = None
        for step in (0.0, 0.03, -0.03, 0.11, -0.11, 0.29, -0.29):
            found = _split(a, mean + step * spread / np.sqrt(m), rng)
            if best is None or found[2] < best[2]:
                best = found
            if best[2] <= 1e-14 * max(spread, size * 1e-2):
                break
        turn, k, _ = best
        for part in (turn[:, :k], turn[:, k:]):
            small = part.T @ a @ part
            blocks.append(((small + small.T) / 2, basis @ part))
    order = np.argsort(-np.array(values), kind="stable")
    q = _polished(v, np.array(vectors).T[:, order]) if values else np.empty((0, 0))
    return np.einsum("ij,ij->j", q, v @ q) if values else np.empty(0), q


def _polished(v, q):
    """Take the rounding errors of many nested splits off: Newton steps towards a diagonal Q'VQ."""
    import numpy as np

    for _ in range(3):
        q, _ = np.linalg.qr(q)
        t = q.T @ v @ q
        values = np.diag(t)
        gap = values[None, :] - values[:, None]
        # first-order rotation; where a gap is as small as the error, any basis is as good
        turn = np.where(np.abs(gap) > 1e3 * np.abs(t), t / np.where(gap == 0, 1.0, gap), 0.0)
        np.fill_diagonal(turn, 0.0)
        q = q + q @ turn
    return np.linalg.qr(q)[0]


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of rows whose vector can be whitened, entries as double."""
    entry = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", vec.alias("vec")).where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    return rows.where(F.forall("vec", entry))


def _matrix(column: pa.Array):
    """A batch of equally long vectors as whole numbers: rows by dimensions."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) * STEPS)
    if x.size and np.abs(x).max() >= 2.0**62:
        raise ValueError("an entry is too large to be held as a whole number")
    return x.astype(np.int64) + OFFSET


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Count and exact sums per dimension: one row per dimension and task before the shuffle."""

    def make(batches) -> Iterator[dict]:
        import numpy as np

        n, total = 0, None
        for b in batches:
            x = _matrix(b.column("vec"))
            # halves keep the sum of a task exact beyond 64 bits
            part = [[int(t) for t in half.sum(axis=0)] for half in (x >> 32, x & 0xFFFFFFFF)]
            part = [(high << 32) + low for high, low in zip(*part)]
            total, n = part if total is None else [a + c for a, c in zip(total, part)], n + len(x)
        if n:
            yield {"at": np.arange(len(total)), "n": [n] * len(total), "total": [str(t) for t in total]}

    parts = map_batches(rows.select("vec"), make, "at int, n long, total string", 4096)
    sums = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = sorted(sums.collect())
    return (found[0].n if found else 0), [int(r.total) for r in found]


def _covariance(rows: DataFrame, make_rows) -> list[list[float]]:
    """Mean outer product of `make_rows` (batch -> matrix): one small matrix per task, added up by entry."""

    def make(batches) -> Iterator[dict]:
        import numpy as np

        n, total = 0, None
        for b in batches:
            z = make_rows(b)
            total, n = z.T @ z if total is None else total + z.T @ z, n + len(z)
        if n:
            i, j = np.triu_indices(len(total))
            yield {"i": i, "j": j, "n": [n] * len(i), "value": total[i, j]}

    parts = map_batches(rows.select("vec"), make, "i int, j int, n long, value double", 4096)
    found = parts.groupBy("i", "j").agg((F.sum("value") / F.sum("n")).alias("value")).collect()
    m = 1 + max((r.i for r in found), default=-1)
    out = [[0.0] * m for _ in range(m)]
    for r in found:
        out[r.i][r.j] = out[r.j][r.i] = r.value
    return out


def _centred(n: int, sums):
    """A function from a batch to x - S/n, the whole part of S/n taken off exactly."""
    whole = [s // n for s in sums]
    rest = [(s % n) / n for s in sums]

    def centre(batch):
        import numpy as np

        return (_matrix(batch.column("vec")) - np.array(whole, np.int64)).astype(float) - np.array(rest)

    return centre


def _one_length(vectors: DataFrame) -> DataFrame:
    rows = _usable(vectors)
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("vec") == (top.d if top else 0))


def fit_whitening(vectors: DataFrame, most: int = COMPONENTS) -> Whitening:
    """Mean and principal components of all usable rows of `vectors` (embedding: array of numbers)."""
    return _fit(_one_length(vectors), most)


def _fit(rows: DataFrame, most: int) -> Whitening:
    import numpy as np

    n, sums = _sums(rows)
    if not n:
        return Whitening(0, (), (), (), 0.0)
    v = np.array(_covariance(rows, _centred(n, sums)))
    values, q = spectral_components(v)
    kept = int((values[:most] > LEAST_SHARE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    columns = tuple(tuple(float(x) for x in q[:, k]) for k in range(kept))
    return Whitening(n, tuple(sums), columns, tuple(float(x) for x in values[:kept]), float(np.trace(v)))


def _projector(model: Whitening):
    """A function from a batch to its whitened rows."""
    centre = _centred(model.n, model.sums)

    def project(batch):
        import numpy as np

        return centre(batch) @ (np.array(model.components).T / np.sqrt(np.array(model.values)))

    return project


def _deviations(x, n: int, sums) -> list[int | None]:
    """Exact sum over dimensions of (n*x - S)^2; null where it is beyond a long."""
    import numpy as np

    # n*x - S = n*(x - S div n) - S mod n keeps the products small
    apart = x - np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    if n * (int(np.abs(apart).max(initial=0)) + 1) < 2**31 // max(1, len(sums)):
        d = n * apart - np.array(rest, np.int64)
        return [int(t) for t in (d * d).sum(axis=1)]
    d = apart.astype(object) * n - np.array(rest, object)
    return [t if t < 2**63 else None for t in (d * d).sum(axis=1)]


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row of `vectors` (vec_id, embedding), fitted on these rows.

    Returns vec_id, component (from 1 on by falling variance), n, deviation, whitened, explained, identity_error: one row per row
    and component. Rows are left out if the vector is null or empty or holds null or non-finite entries, or if
    its length is not the most frequent one (the longer of equally frequent ones). Rows with one or with a null vec_id
    are whitened like any other. Components without variance (below LEAST_SHARE of the largest) are left
    out, so a table of equal vectors, like an empty one, gives no rows. deviation is null beyond
    2^63 - 1. Other columns are ignored, whatever their names. An entry of 2^56 or more is an error.
    """
    rows = _one_length(vectors)
    model = _fit(rows, most)
    schema = (
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    k = len(model.values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    spread = _covariance(rows, _projector(model))
    error = max(abs(spread[i][j] - (i == j)) for i in range(k) for j in range(k))
    # dimension x components numbers, whatever the number of rows
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make(batches) -> Iterator[dict]:
        import numpy as np

        model = shared.value
        project = _projector(model)
        explained = np.array(model.values) / model.trace
        for b in batches:
            m = b.num_rows
            each = np.repeat(np.arange(m), k)
            yield {
                "vec_id": b.column("vec_id").take(pa.array(each)),
                "component": np.tile(np.arange(1, k + 1), m),
                "n": np.full(m * k, model.n),
                "deviation": pa.array(_deviations(_matrix(b.column("vec")), model.n, model.sums), "int64").take(pa.array(each)),
                "whitened": project(b).ravel(),
                "explained": np.tile(explained, m),
                "identity_error": np.full(m * k, error),
            }

    narrow = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "vec")
    return map_batches(narrow, make, schema, 2048)
