"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and their beginnings (inflected insults share those), hashed to 2 ** BITS places; a term that
occurs c times counts 1 + ln(c). The log-odds of a text are a constant, plus a weight per term, plus the dot product of the
factor vectors of every two terms. The pairwise part tells an insult beside a group, or two doubtful words together,
from either alone, which additive weights cannot. It costs one pass over the terms: the sum over
pairs is half of (square of the summed factors) - (sum of their squares).

Only terms that tell the classes apart (likelihood ratio of at least LEAST_RATIO) have weights and factors, so
that a long text does not collect noise. Terms are counted, and the machine is fitted, on a bounded sample: at
most SAMPLE_ROWS labelled rows per class, by hash of doc_id. Class shares come from all labels, and every text is
scored in full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import map_batches
from pricemill.llm.quality import learnable
from pricemill.session import staged

#: Labelled rows of each class to learn from.
SAMPLE_ROWS = 8000
#: Terms are hashed to 2 ** BITS places; beginnings of words have these lengths.
BITS, BEGINNINGS = 18, (3, 4, 5, 6, 7)
LEAST_RATIO = 10.0
FACTORS = 8
#: Fitting: passes, rows per step, first step size, spread of the first factors, and penalty on sizes.
EPOCHS, BATCH, RATE, START, PENALTY = 10, 64, 0.1, 0.03, 0.02
THRESHOLD = 0.3

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters of a text that are split into words at a time, and words whose terms a worker remembers.
CHUNK, REMEMBERED = 1 << 20, 500_000


@dataclass(frozen=True)
class ToxicityModel:
    """Constant, and place, weight and factors of the terms that count."""

    constant: float
    places: tuple[int, ...] = ()
    weights: tuple[float, ...] = ()
    factors: tuple[tuple[float, ...], ...] = ()


def word_counts(text: str | None) -> Counter:
    """How often each word occurs, in lower case, with the punctuation around it."""
    counts: Counter = Counter()
    if not text:
        return counts
    blank = re.compile(r"\s")
    at = 0
    while at < len(text):
        # chunks end at blanks, so that no word is cut
        end = blank.search(text, at + CHUNK)
        stop = end.start() if end else len(text)
        counts.update(text[at:stop].lower().split())
        at = stop + 1
    return counts


def term_places(word: str) -> list[int]:
    """Places of a word and its beginnings; punctuation around it does not count."""
    import xxhash

    word = word.strip(PUNCTUATION)
    if not word:
        return []
    terms = ["w" + word] + ["b" + word[:k] for k in BEGINNINGS if len(word) >= k]
    return [xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass"), 12) & ((1 << BITS) - 1) for t in terms]


def term_counter(chosen: list[int] | None = None):
    """A function from text to {place: count}; with `chosen`, only of those, numbered in their order."""
    number = None if chosen is None else {p: k for k, p in enumerate(chosen)}
    known: dict[str, list[int]] = {}

    def counts(text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        for word, n in word_counts(text).items():
            places = known.get(word)
            if places is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                places = term_places(word)
                places = known[word] = places if number is None else [number[p] for p in places if p in number]
            for p in places:
                found[p] = found.get(p, 0) + n
        return found

    return counts


def _laid_out(rows: list[dict[int, int]]):
    """Start of each row, and its terms and values end to end."""
    import numpy as np

    starts = np.r_[0, np.cumsum([len(r) for r in rows])].astype(int)
    terms = np.fromiter((p for r in rows for p in r), np.int64, starts[-1])
    values = np.fromiter((c for r in rows for c in r.values()), float, starts[-1])
    return starts, terms, 1.0 + np.log(values)


def log_odds(starts, terms, values, constant, weights, factors):
    """Log-odds per row, and per term its row, scaled factors and the row's summed factors."""
    import numpy as np

    rows = len(starts) - 1
    owner = np.repeat(np.arange(rows), np.diff(starts))
    scaled = factors[terms] * values[:, None]
    total = np.column_stack([np.bincount(owner, scaled[:, j], minlength=rows) for j in range(factors.shape[1])])
    square = np.bincount(owner, (scaled * scaled).sum(axis=1), minlength=rows)
    linear = np.bincount(owner, weights[terms] * values, minlength=rows)
    return constant + linear + 0.5 * ((total * total).sum(axis=1) - square), owner, scaled, total


def _probability(odds):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(odds, -40.0, 40.0)))


def _picked(laid, rows):
    """Some rows of what `_laid_out` returns, in the same form."""
    import numpy as np

    starts, terms, values = laid
    lengths = starts[rows + 1] - starts[rows]
    own = np.r_[0, np.cumsum(lengths)]
    at = np.repeat(starts[rows] - own[:-1], lengths) + np.arange(own[-1])
    return own, terms[at], values[at]


def train(laid, labels, row_weights, terms: int):
    """Constant, weights and factors by steps with own sizes per parameter (AdaGrad), shrunk towards zero."""
    import numpy as np

    rng = np.random.default_rng(12)
    share = float((labels * row_weights).sum() / row_weights.sum())
    constant, weights = np.log(share / (1 - share)), np.zeros(terms)
    factors = rng.normal(0.0, START, (terms, FACTORS))
    c_seen, w_seen, f_seen = 1.0, np.full(terms, 0.1), np.full((terms, FACTORS), 0.1)

    def shrunk(x, step):
        return np.sign(x) * np.maximum(np.abs(x) - step * PENALTY, 0.0)

    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(labels), BATCH):
            own = order[at : at + BATCH]
            starts, places, values = _picked(laid, own)
            odds, owner, scaled, total = log_odds(starts, places, values, constant, weights, factors)
            miss = (_probability(odds) - labels[own]) * row_weights[own]
            slope = miss[owner] * values
            used, at_used = np.unique(places, return_inverse=True)
            dw = np.bincount(at_used, slope, minlength=len(used))
            # a term meets the factors of all others of its row
            others = slope[:, None] * (total[owner] - scaled)
            df = np.column_stack([np.bincount(at_used, others[:, j], minlength=len(used)) for j in range(FACTORS)])
            w_seen[used] += dw * dw
            f_seen[used] += df * df
            step = RATE / np.sqrt(w_seen[used])
            weights[used] = shrunk(weights[used] - step * dw, step)
            step = RATE / np.sqrt(f_seen[used])
            factors[used] = shrunk(factors[used] - step * df, step)
            c_seen += miss.sum() ** 2
            constant -= RATE / np.sqrt(c_seen) * miss.sum()
    return float(constant), weights, factors


def _ratio(toxic: int, rows: int):
    """Twice the log-likelihood ratio of a term's counts (`with_toxic`, `any`) against independence of the classes."""
    seen, term = F.col("with_toxic").cast("double"), F.col("any").cast("double")

    def part(count, of_class: int, of_term):
        return F.when(count > 0, count * F.log(count * F.lit(float(rows)) / (F.lit(float(of_class)) * of_term))).otherwise(0.0)

    without = F.lit(float(rows)) - term
    return 2 * (
        part(seen, toxic, term)
        + part(F.lit(float(toxic)) - seen, toxic, without)
        + part(term - seen, rows - toxic, term)
        + part(F.lit(float(rows - toxic)) - term + seen, rows - toxic, without)
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on labelled rows of `docs` (doc_id, text) by `labels` (doc_id, toxic 0 or 1).

    Only rows with `learnable()` ids are used. A doc_id labelled twice counts with its larger label, one with several
    texts with one of them (the first by its terms). Null labels, ids and texts are left out. If a class has
    no row, everything is scored alike, by the share of the classes.
    """
    import math

    import numpy as np

    own = labels.where(learnable() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    known = staged(
        own.join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi"), "labelled"
    )
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        share = (totals.get(1, 0) + 1e-3) / (sum(totals.values()) + 2e-3)
        return ToxicityModel(math.log(share / (1 - share)))
    order = (F.xxhash64("doc_id", F.lit("toxicity")), "doc_id")
    chosen = [known.where(F.col("toxic") == c).orderBy(*order).limit(SAMPLE_ROWS) for c in (0, 1)]
    # at most 2 * SAMPLE_ROWS rows of two numbers, whatever the input
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id"
    )
    seen = staged(
        _with_terms(sample).groupBy("doc_id", "toxic").agg(F.min(F.struct("places", "counts")).alias("t")), "terms"
    )
    size = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, toxic = sum(size.values()), size[1]
    spread = seen.select("toxic", F.explode("t.places").alias("place")).groupBy("place").agg(
        F.count("*").alias("any"), F.sum("toxic").alias("with_toxic")
    )
    # at most 2 ** BITS numbers, whatever the input
    places = sorted(r.place for r in spread.where(_ratio(toxic, n) >= LEAST_RATIO).select("place").collect())
    if not places:
        share = totals[1] / (totals[0] + totals[1])
        return ToxicityModel(math.log(share / (1 - share)))
    # at most 2 * SAMPLE_ROWS rows of the terms that were kept
    found = sorted(tuple(r) for r in _kept_terms(seen, places).collect())
    starts = np.r_[0, np.cumsum([len(f[2]) // 4 for f in found])]
    terms = np.frombuffer(b"".join(f[2] for f in found), np.int32)
    counts = np.frombuffer(b"".join(f[3] for f in found), np.int32)
    marks = np.array([f[1] for f in found], float)
    weight = np.array([totals[int(c)] / size[int(c)] for c in marks])
    laid = starts, terms, 1.0 + np.log(counts)
    constant, weights, factors = train(laid, marks, weight / weight.mean(), len(places))
    return ToxicityModel(
        constant, tuple(places), tuple(map(float, weights)), tuple(tuple(map(float, f)) for f in factors)
    )


def _kept_terms(seen: DataFrame, places: list[int]) -> DataFrame:
    """(doc_id, toxic, terms, counts): numbers of the kept terms of each row and their counts, four bytes each."""
    shared = seen.sparkSession.sparkContext.broadcast(places)

    def make(batches) -> Iterator[dict]:
        import numpy as np

        kept = np.array(shared.value)
        for b in batches:
            terms, counts = [], []
            for p, c in zip(b.column("places").to_pylist(), b.column("counts").to_pylist()):
                at = np.minimum(np.searchsorted(kept, p), len(kept) - 1)
                own = kept[at] == p
                terms.append(at[own].astype(np.int32).tobytes())
                counts.append(np.array(c, np.int32)[own].tobytes())
            yield {"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "terms": terms, "counts": counts}

    narrow = seen.select("doc_id", "toxic", "t.places", "t.counts")
    return map_batches(narrow, make, "doc_id bigint, toxic int, terms binary, counts binary", 256)


def _with_terms(sample: DataFrame) -> DataFrame:
    def make(batches) -> Iterator[dict]:
        counter = term_counter()
        for b in batches:
            found = [sorted(counter(t).items()) for t in b.column("text").to_pylist()]
            yield {
                "doc_id": b.column("doc_id"),
                "toxic": b.column("toxic"),
                "places": [[p for p, _ in f] for f in found],
                "counts": [[c for _, c in f] for f in found],
            }

    narrow = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")
    return map_batches(narrow, make, "doc_id bigint, toxic int, places array<int>, counts array<int>", 128)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) per row of `docs` (doc_id, text): probability of label 1.

    Only the text counts; a null text is scored as an empty one, by the model's constant. predicted is 1 from THRESHOLD
    on. Repeated rows and null ids are scored like any other row, very long texts in chunks of words. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches) -> Iterator[dict]:
        import numpy as np

        model = shared.value
        counter = term_counter(list(model.places))
        weights = np.array(model.weights)
        factors = np.array(model.factors).reshape(len(weights), -1) if len(weights) else np.zeros((0, 1))
        for b in batches:
            laid = _laid_out([counter(t) for t in b.column("text").to_pylist()])
            score = _probability(log_odds(*laid, model.constant, weights, factors)[0])
            yield {"doc_id": b.column("doc_id"), "score": score, "predicted": (score >= THRESHOLD).astype("int32")}

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(narrow, make, "doc_id bigint, score double, predicted int")
