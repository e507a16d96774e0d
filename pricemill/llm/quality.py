"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled text. A text like the good ones
compresses better with the first, so the difference of its two compressed sizes tells the classes apart, normalised
by the length and by both sizes. A logistic curve over these two differences and their products turns them into a
probability. Length and compressibility by themselves are no inputs.

The dictionaries and the curve are fitted on a bounded sample (SAMPLE_ROWS per class, by hash of doc_id). The curve
must see texts that the dictionaries have not: each of FOLDS parts of the sample is measured with dictionaries
trained on the other parts, so every row serves both; the dictionaries of the model are trained on all of them. Class
shares come from all labels, and every text is scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import crc_part, map_batches
from pricemill.session import staged

#: Labelled rows of each class in the sample, and characters that a dictionary takes from each of them.
SAMPLE_ROWS, SLICE = 4000, 1000
#: Parts of the sample, each measured on whole texts with the dictionaries of the others.
FOLDS = 4
DICTIONARY_BYTES = 112 * 1024
LEVEL = 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries (empty: none), and scale and weights of the curve."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def size_features(good: bytes, bad: bytes):
    """A function from UTF-8 text to its normalised differences of compressed sizes."""
    import zstandard as z

    def compressor(dictionary: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
        if not dictionary:
            return z.ZstdCompressor(**options).compress
        data = z.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        return z.ZstdCompressor(dict_data=data, **options).compress

    with_good, with_bad = compressor(good), compressor(bad)

    def features(text: bytes) -> tuple[float, ...]:
        a, b = len(with_good(text)), len(with_bad(text))
        return (b - a) / (len(text) + 1), (b - a) / (a + b)

    return features


def _design(features, mean, scale):
    """Standardised features (within five deviations), their products, and a constant."""
    import numpy as np

    x = np.clip((np.asarray(features, float).reshape(-1, len(mean)) - mean) / scale, -5.0, 5.0)
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def _probability(design, weights):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(design @ np.asarray(weights), -40.0, 40.0)))


def _loss(design, labels, row_weights, w, penalty):
    import numpy as np

    z = design @ w
    return float((row_weights * (np.logaddexp(0.0, z) - labels * z)).sum() + 0.5 * penalty * (w @ w))


def _logistic(design, labels, row_weights):
    """Weights of a slightly penalised logistic regression, by Newton steps that always lower the loss.

    A step that does not is halved, so weights cannot run away where the classes are separable or the curve is flat. The
    loss is convex and bounded below by the penalty; a fit that has not settled after all rounds is an error.
    """
    import numpy as np

    penalty = 1e-4 * row_weights.sum()
    w = np.zeros(design.shape[1])
    loss = _loss(design, labels, row_weights, w, penalty)
    for _ in range(200):
        p = _probability(design, w)
        slope = design.T @ (row_weights * (labels - p)) - penalty * w
        curve = (design.T * (row_weights * p * (1 - p))) @ design + penalty * np.eye(len(w))
        step, size = np.linalg.solve(curve, slope), 1.0
        while (new := _loss(design, labels, row_weights, w + size * step, penalty)) > loss - 1e-4 * size * (slope @ step):
            size /= 2
            if size < 1e-10:
                break
        if size < 1e-10 or loss - new <= 1e-10 * max(1.0, abs(loss)):
            return w if size < 1e-10 else w + size * step
        w, loss = w + size * step, new
    raise RuntimeError("the quality curve did not settle")


def _dictionary(slices: list[bytes]) -> bytes:
    """A trained dictionary, or the slices themselves where they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY_BYTES, slices).as_bytes()
    except z.ZstdError:
        return b"\n".join(slices)[-DICTIONARY_BYTES:]


def learnable(held_out: int = 2, parts: int = 4) -> Column:
    """Rows whose labels may be learned from; a null doc_id is not one."""
    return crc_part("doc_id", parts) != held_out


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on labelled rows of `docs` (doc_id, text) by `labels` (doc_id, quality 0 or 1).

    Only rows with `learnable()` ids are used. A doc_id labelled twice counts with its smaller label; null labels and
    texts are left out. If a class has no row, the model scores everything alike, by the share of
    the classes.
    """
    import numpy as np

    own = labels.where(learnable() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality")
    )
    # labels without a document are no examples; both sides are narrow
    known = staged(
        own.join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi"), "labelled"
    )
    totals = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
        constant = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return QualityModel(b"", b"", (0.0,) * 2, (1.0,) * 2, (constant,) + (0.0,) * 5)

    chosen = None
    for quality in sorted(totals):
        part = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    # at most 2 * SAMPLE_ROWS rows of three numbers, whatever the input
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    sample = sample.dropDuplicates(["doc_id"]).cache()
    found = _dictionaries(sample)
    rows = _features(sample, found).orderBy("doc_id").collect()
    sample.unpersist()
    good, bad = found[FOLDS]

    quality = np.array([r.quality for r in rows], float)
    x = np.array([list(r.features) for r in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weight = np.array([totals[int(q)] / max(1, (quality == q).sum()) for q in quality])
    weights = _logistic(_design(x, mean, scale), quality, weight / weight.mean())
    return QualityModel(good, bad, tuple(mean), tuple(scale), tuple(weights))


def _dictionaries(sample: DataFrame) -> list[tuple[bytes, bytes]]:
    """The good and the bad dictionary without each fold, and last those of the whole sample.

    One task per dictionary gets at most SAMPLE_ROWS slices.
    """
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.greatest(F.lit(1), F.length("text") - SLICE))
    slices = sample.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "quality",
        "fold",
        F.substr("text", start, F.lit(SLICE)).alias("slice"),
        F.explode(F.array(*map(F.lit, range(FOLDS + 1)))).alias("without"),
    )

    def make(key, table):
        texts = [t.encode() for t in table.sort_by("doc_id").column("slice").to_pylist() if t]
        columns = {"quality": [key[0].as_py()], "without": [key[1].as_py()], "dictionary": [_dictionary(texts)]}
        return pa.table(columns, schema=pa.schema([("quality", pa.int32()), ("without", pa.int32()), ("dictionary", pa.binary())]))

    trained = slices.where("without != fold").groupBy("quality", "without").applyInArrow(
        make, "quality int, without int, dictionary binary"
    )
    found = {(r.quality, r.without): bytes(r.dictionary) for r in trained.collect()}
    return [(found.get((1, k), b""), found.get((0, k), b"")) for k in range(FOLDS + 1)]


def _features(sample: DataFrame, dictionaries: list[tuple[bytes, bytes]]) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(dictionaries)

    def make(batches) -> Iterator[dict]:
        features = [size_features(*pair) for pair in shared.value]
        for b in batches:
            texts = zip(b.column("fold").to_pylist(), b.column("text").to_pylist())
            yield {
                "doc_id": b.column("doc_id"),
                "quality": b.column("quality"),
                "features": [features[fold](t.encode("utf-8", "surrogatepass")) for fold, t in texts],
            }

    narrow = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "fold", "text")
    return map_batches(narrow, make, "doc_id bigint, quality int, features array<double>")


def _scorer(model: QualityModel):
    features = size_features(model.good, model.bad)

    def score(texts: list[str | None]):
        import numpy as np

        if not texts:
            return np.empty(0)
        sizes = [features((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        return _probability(_design(sizes, model.mean, model.scale), model.weights)

    return score


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) per row of `docs` (doc_id, text): probability of label 1.

    Only the text counts; a null text is scored as an empty one. predicted is 1 from THRESHOLD on. Repeated
    rows and null ids are scored like any other row.
    """

    # the dictionaries go to each executor once, not with every task
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches) -> Iterator[dict]:
        score = _scorer(shared.value)
        for b in batches:
            found = score(b.column("text").to_pylist())
            yield {"doc_id": b.column("doc_id"), "score": found, "predicted": (found >= THRESHOLD).astype("int32")}

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(narrow, make, "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that are predicted good, with all their columns, whatever their names.

    Null texts are scored as empty ones, rows without an id like any other, whole texts however long. An empty table
    gives no rows.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = _scorer(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield part.filter(pa.array(score(part.column("text").to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
