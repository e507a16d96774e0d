"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts a vector from the two tokens before (each scaled by a position vector) and scores a
token by its product with the token's vector, plus a bias (Mnih and Teh, 2012). Its softmax has two levels. Entries of the
first are the SINGLE most frequent words, the end of text, and classes of all other words: words sorted by their
endings, cut into ranges. Inside a class every listed word has a vector of its own, scored by its product with a vector of
the token before; one more place stands for the words that are not listed, which share its probability by their smoothed
counts. Words whose counts are sent to all tasks (up to FREQUENT) are listed, so the listed vocabulary grows with the corpus
up to that many; the counts of other words are looked up by a join, and they too have the class of their ending.

It is trained in numpy: every partition of the corpus trains on all of its documents, from the same start, and the
parameters are averaged in one aggregation: entries weighted by tokens, listed words by the steps taken on them. Noise
words are shared by a batch on the first level and drawn from the word's class on the second.

Scores are normalised. exp(a + b) = exp(a) exp(b), so the sums over all entries for every pair of context tokens are one
product of two matrices; those inside the classes depend on one token. Both tables are made once, by tasks over ranges of
context tokens, and broadcast, so that scoring a token costs two lookups.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.llm.common import as_list, crc_part, map_batches, numbered, words_of_batch
from pricemill.session import staged

#: Most frequent words that are entries themselves, and at most how many classes hold all others.
SINGLE, CLASSES = 1024, 512
#: Listed words a class has at least, where there are fewer than would fill all classes.
PER_CLASS = 16
#: Words whose counts are broadcast and that have vectors: at most this many, about 5 and 18 MB.
FREQUENT = 1 << 18
SIZE, CONTEXT = 16, 2
NOISE, NOISE_RATIO, BATCH, RATE = 32, 8.0, 8192, 0.1
#: Noise words per word inside a class, and what a step there is divided by.
INSIDE_NOISE, INSIDE_SCALE = 3, 256.0
SMOOTH = 0.1
SEED = 5
#: Tokens for which one copy of the model is trained: partitions with fewer share a copy. Each copy sends all its numbers,
#: so what is sent grows with the tokens and not with the number of partitions.
TRAINED = 1 << 21
#: Words a worker counts before it passes the counts on, and tokens it scores at a time.
HELD, TOGETHER = 1_000_000, 200_000


@dataclass(frozen=True)
class Counts:
    """Totals of the training tokens, the frequent words, most frequent first, and the rest of each class.

    `least` is the smallest listed count; `rest` holds the tokens and kinds of unlisted words, class by class.
    """

    tokens: int
    distinct: int
    ends: int
    words: bytes
    counts: bytes
    least: int = 1 << 62
    rest: bytes = b""

    def lists(self):
        import numpy as np

        return self.words.split(), np.frombuffer(self.counts, np.int64)

    def rests(self, classes: int):
        """(tokens, kinds) of the unlisted words of each class."""
        import numpy as np

        if not self.rest:
            return np.zeros((2, classes), np.int64)
        return np.frombuffer(self.rest, np.int64).reshape(2, classes)


class Lexicon(dict):
    """Index of each listed word by frequency; of any other word, the number of listed words plus its class.

    `entry` and `slot` give, per index, the entry of the first level and the place among the words of the
    classes (-1: the entry is the word). Class c has the places edges[c] to edges[c + 1] - 1, its unlisted words the last.
    """

    def __init__(self, counts: Counts):
        import numpy as np

        words = counts.lists()[0]
        super().__init__((w, i) for i, w in enumerate(words))
        self.listed, self.top = len(words), min(SINGLE, len(words))
        endings = [w[::-1] for w in words[self.top :]]
        order = np.array(sorted(range(len(endings)), key=endings.__getitem__), np.int64)
        self.classes = max(1, min(CLASSES, len(endings) // PER_CLASS))
        cuts = np.arange(self.classes + 1) * len(endings) // self.classes
        self.bounds = [endings[order[cuts[c]]] for c in range(1, self.classes)]
        self.edges = cuts + np.arange(self.classes + 1)
        kind = np.empty(len(endings), np.int64)
        kind[order] = np.repeat(np.arange(self.classes), np.diff(cuts))
        place = np.empty(len(endings), np.int64)
        place[order] = np.arange(len(endings))
        self.entry = np.r_[np.arange(self.top), self.top + kind, self.top + np.arange(self.classes)]
        self.slot = np.r_[np.full(self.top, -1), place + kind, self.edges[1:] - 1]
        self.end, self.start = self.top + self.classes, self.top + self.classes + 1

    def class_of(self, word: bytes) -> int:
        return bisect_right(self.bounds, word[::-1])

    def __missing__(self, word: bytes) -> int:
        return self.listed + bisect_right(self.bounds, word[::-1])

    def of_batch(self, texts: pa.Array):
        """The different words of the texts and their indices, and `words_of_batch`'s places and ends."""
        import numpy as np

        words, places, ends = words_of_batch(texts, lower=True)
        return words, np.fromiter(map(self.__getitem__, as_list(words)), np.int64, len(words)), places, ends


def _texts(docs: DataFrame) -> DataFrame:
    held = F.coalesce(crc_part("doc_id", 10) == 0, F.lit(True))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")
    )


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in `texts`; the end of text is the null word."""

    def make(batches) -> Iterator[dict]:
        import numpy as np

        held: list[pa.Table] = []
        ends = 0

        def summed() -> dict:
            found = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            return {"word": found["word"].combine_chunks(), "n": found["n_sum"].combine_chunks()}

        for b in batches:
            ends += b.num_rows
            words, places, _ = words_of_batch(b.column("text"), lower=True)
            n = np.bincount(places, minlength=len(words))
            own = pa.table({"word": words.cast(pa.binary()), "n": n})
            held.append(own.filter(pa.array(n > 0)))
            if sum(map(len, held)) > HELD:
                yield summed()
                held = []
        if held:
            yield summed()
        yield {"word": [None], "n": [ends]}

    return map_batches(texts.select("text"), make, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_counts(counts: DataFrame) -> Counts:
    """Totals, and the counts of the most frequent words, at most FREQUENT of them."""
    import numpy as np

    # how many words have each count (one row per distinct count, far fewer than words)
    steps = counts.where("word is not null").groupBy("n").agg(F.count("*").alias("words"))
    ranked = sorted(((r.n, r.words) for r in steps.where("n > 1").collect()), reverse=True)
    total = steps.agg(F.sum(F.col("n") * F.col("words")).alias("tokens"), F.sum("words").alias("words")).first()
    least, room = Counts.least, FREQUENT
    for n, words in ranked:
        if words > room:
            break
        least, room = n, room - words
    ends = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    found = sorted(((-r.n, bytes(r.word)) for r in counts.where(F.col("word").isNotNull() & (F.col("n") >= least)).collect()))
    return Counts(
        tokens=(total.tokens or 0) + ends,
        distinct=(total.words or 0) + (ends > 0),
        ends=ends,
        words=b" ".join(w for _, w in found),
        counts=np.array([-n for n, _ in found], np.int64).tobytes(),
        least=least,
    )


def with_rests(counts: Counts, table: DataFrame) -> Counts:
    """Add the tokens and kinds of each class's unlisted words (one row per class comes back)."""
    import numpy as np

    shared = table.sparkSession.sparkContext.broadcast(counts)
    unlisted = table.where(F.col("word").isNotNull() & (F.col("n") < counts.least))

    def make(batches) -> Iterator[dict]:
        lexicon = Lexicon(shared.value)
        sums = np.zeros((2, lexicon.classes), np.int64)
        for b in batches:
            kinds = np.array([lexicon.class_of(w) for w in b.column("word").to_pylist()], np.int64)
            np.add.at(sums[0], kinds, b.column("n").to_numpy())
            np.add.at(sums[1], kinds, 1)
        yield {"class": np.arange(lexicon.classes), "tokens": sums[0], "kinds": sums[1]}

    found = map_batches(unlisted, make, "class int, tokens bigint, kinds bigint")
    rest = np.zeros((2, Lexicon(counts).classes), np.int64)
    for r in found.groupBy("class").agg(F.sum("tokens"), F.sum("kinds")).collect():
        rest[:, r[0]] = r[1], r[2]
    return replace(counts, rest=rest.tobytes())


@dataclass
class LogBilinear:
    """Vectors and biases of both levels, and the scales of the two context places.

    Entries: single words, classes, the end, the start (only ever context). `inner` are context vectors for the words
    inside classes, `words` their vectors with the bias as last column. `norms` are the logs of the sums over all
    entries per pair of context entries, `inner_norms` those over a class's words per context entry and class.
    """

    context: object
    target: object
    bias: object
    place: object
    inner: object
    words: object
    edges: object
    norms: object = None
    inner_norms: object = None

    @classmethod
    def start(cls, counts: Counts, shares=None) -> LogBilinear:
        """Small random context vectors and the log of unigram probabilities: it starts close to a unigram model."""
        import numpy as np

        share, inside, edges = shares or unigram(counts)
        rng = np.random.default_rng(SEED)
        n = len(share) + 1
        return cls(
            rng.normal(0, 0.1, (n, SIZE)).astype(np.float32),
            rng.normal(0, 0.1, (n, SIZE)).astype(np.float32),
            np.r_[np.log(share), -30.0].astype(np.float32),
            np.ones((CONTEXT, SIZE), np.float32),
            rng.normal(0, 0.1, (n, SIZE)).astype(np.float32),
            np.column_stack([np.zeros((len(inside), SIZE)), np.log(inside)]).astype(np.float32),
            edges,
        )

    def predict(self, contexts):
        """Predicted vectors of rows of context entries."""
        return sum(self.context[contexts[:, p]] * self.place[p] for p in range(CONTEXT))

    def norm_rows(self, entries):
        """Rows of `norms` for these entries as the token before."""
        import numpy as np

        n = len(self.bias) - 1
        last, before = (
            (self.context[rows].astype(float) * self.place[p]) @ self.target[:n].T.astype(float)
            for p, rows in enumerate((entries, slice(None)))
        )
        last = last + self.bias[:n]
        tops = [x.max(axis=1, keepdims=True) for x in (last, before)]
        return tops[0] + tops[1].T + np.log(np.exp(last - tops[0]) @ np.exp(before - tops[1]).T)

    def inner_norm_rows(self, entries):
        """Rows of `inner_norms` for these entries as the token before."""
        import numpy as np

        scores = self.inner[entries] @ self.words[:, :SIZE].T + self.words[:, SIZE]
        return np.log(np.add.reduceat(np.exp(scores, out=scores), self.edges[:-1], axis=1, dtype=np.float64))

    def log_probabilities(self, contexts, targets, slots=None):
        """Natural log of the normalised probability of each target in its context.

        With `slots` (-1: none) the probability inside the class is included, else targets are entries.
        """
        import numpy as np

        if self.norms is None:
            every = np.arange(len(self.bias))
            self.norms, self.inner_norms = self.norm_rows(every), self.inner_norm_rows(every)
        out = np.einsum("nd,nd->n", self.predict(contexts), self.target[targets]).astype(float)
        out += self.bias[targets] - self.norms[contexts[:, 0], contexts[:, 1]]
        if slots is not None:
            at = np.flatnonzero(slots >= 0)
            before, slot = contexts[at, 0], slots[at]
            rows = self.words[slot]
            kind = np.searchsorted(self.edges, slot, "right") - 1
            out[at] += np.einsum("nd,nd->n", self.inner[before], rows[:, :SIZE]) + rows[:, SIZE]
            out[at] -= self.inner_norms[before, kind]
        return out


def unigram(counts: Counts, lexicon: Lexicon | None = None):
    """Smoothed shares of the entries that can be predicted, of the words inside their classes, and the classes' edges."""
    import numpy as np

    lexicon, number = lexicon or Lexicon(counts), counts.lists()[1].astype(float)
    rest = counts.rests(lexicon.classes)[0]
    inside = np.zeros(lexicon.edges[-1])
    inside[lexicon.slot[lexicon.top : lexicon.listed]] = number[lexicon.top :]
    inside[lexicon.edges[1:] - 1] = rest
    kinds = np.add.reduceat(inside, lexicon.edges[:-1])
    share = np.r_[number[: lexicon.top], kinds, counts.ends] + SMOOTH
    inside += SMOOTH
    inside /= np.repeat(np.add.reduceat(inside, lexicon.edges[:-1]), np.diff(lexicon.edges))
    return share / share.sum(), inside, lexicon.edges


class Trainer:
    """Noise-contrastive steps (AdaGrad) of one partition on its own copy of the model."""

    def __init__(self, counts: Counts, lexicon: Lexicon | None = None):
        import numpy as np

        share, inside, edges = shares = unigram(counts, lexicon)
        self.model = LogBilinear.start(counts, shares)
        self.kind = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.offset, self.limits = np.log(NOISE_RATIO * share).astype(np.float32), np.cumsum(share)
        self.inside_offset = np.log(INSIDE_NOISE * inside).astype(np.float32)
        self.inside_limits = np.r_[0.0, np.cumsum(inside)]
        self.inside_bounds = self.inside_limits[edges[:-1]], self.inside_limits[edges[1:]]
        self.rng = np.random.default_rng(SEED + 1)
        m = self.model
        self.arrays = (m.target, m.bias, m.context, m.place)
        self.memory = [np.zeros_like(a) for a in self.arrays]
        self.word_memory, self.inner_memory = np.zeros_like(m.words), np.zeros_like(m.inner)
        #: How often a step was taken on each word inside the classes, and tokens seen.
        self.steps, self.tokens = np.zeros(len(m.words), np.int64), 0
        #: Scratch: places of the words of a step among those that it touches, else zero.
        self.place_of = np.zeros(len(m.words), np.int32)

    def learn(self, contexts, targets, slots) -> None:
        for i in range(0, len(targets), BATCH):
            cut = slice(i, i + BATCH)
            self._entries(contexts[cut], targets[cut])
            self._words(contexts[cut, 0], slots[cut])
        self.tokens += len(targets)

    @staticmethod
    def _step(array, old, change) -> None:
        import numpy as np

        old += change * change
        new = old + np.float32(1e-6)
        np.sqrt(new, out=new)
        array += np.divide(np.multiply(change, np.float32(RATE)), new, out=new)

    @staticmethod
    def _spread(index, columns, size):
        """Sums of each column by index; columns one after the other, as only one of them stays in the cache."""
        import numpy as np

        return np.stack([np.bincount(index, column, size) for column in columns], axis=1)

    def _entries(self, c, w) -> None:
        """One step of the first level; the noise entries are shared by the batch."""
        import numpy as np

        model, offset, size = self.model, self.offset, len(self.model.bias)
        noise = np.minimum(np.searchsorted(self.limits, self.rng.random(NOISE)), size - 2)
        places = [np.ascontiguousarray(c[:, p]) for p in range(CONTEXT)]
        before, own = [model.context.take(at, axis=0) for at in places], model.target.take(w, axis=0)
        r = sum(rows * model.place[p] for p, rows in enumerate(before))
        real = (r * own).sum(axis=1) + model.bias[w] - offset[w]
        false = r @ model.target[noise].T + model.bias[noise] - offset[noise]
        up = 1.0 / (1.0 + np.exp(np.clip(real, -30, 30)))
        np.clip(false, -30, 30, out=false)
        np.exp(np.negative(false, out=false), out=false)
        down = np.divide(np.float32(-NOISE_RATIO / NOISE), np.add(false, 1, out=false), out=false)
        back = up[:, None] * own + down @ model.target[noise]
        n = np.float32(1.0 / len(w))
        target = self._spread(w, up * np.ascontiguousarray(r.T), size)
        np.add.at(target, noise, down.T @ r)
        bias = np.bincount(w, up, size)
        np.add.at(bias, noise, down.sum(axis=0))
        columns = np.ascontiguousarray(back.T)
        context = sum(self._spread(at, columns * model.place[p][:, None], size) for p, at in enumerate(places))
        place = np.stack([(back * rows).sum(axis=0) for rows in before])
        for array, old, change in zip(self.arrays, self.memory, (target, bias, context, place)):
            self._step(array, old, (change * n).astype(np.float32))

    def _words(self, before, slots) -> None:
        """One step inside the classes, against noise words of the same class."""
        import numpy as np

        at = np.flatnonzero(slots >= 0)
        if len(at) == 0:
            return
        model, before, slots = self.model, before[at], slots[at]
        kind = self.kind.take(slots)
        low, high = (x.take(kind)[:, None] for x in self.inside_bounds)
        drawn = low + self.rng.random((len(at), INSIDE_NOISE)) * (high - low)
        first, stop = model.edges[kind][:, None], model.edges[kind + 1][:, None]
        noise = np.clip(np.searchsorted(self.inside_limits, drawn, "right") - 1, first, stop - 1)
        rows = np.column_stack([slots, noise])
        self.place_of[rows.ravel()] = 1
        touched = np.flatnonzero(self.place_of)
        self.place_of[touched] = np.arange(len(touched))
        where = self.place_of.take(rows).astype(np.int64)
        self.place_of[touched] = 0
        # the large tables are read once, in order
        own = model.words.take(touched, axis=0)
        h = np.column_stack([model.inner.take(before, axis=0), np.ones(len(at), np.float32)])
        q = own.take(where, axis=0)
        z = np.clip(np.einsum("nd,nkd->nk", h, q) - self.inside_offset.take(touched).take(where), -30, 30)
        g = -1.0 / (1.0 + np.exp(-z))
        g[:, 0] += 1.0
        each = where.ravel()
        words = self._spread(each, ((g * column[:, None]).ravel() for column in np.ascontiguousarray(h.T)), len(touched))
        inner = self._spread(before, np.ascontiguousarray(np.einsum("nk,nkd->nd", g, q[:, :, :SIZE]).T), len(model.inner))
        n = np.float32(1.0 / INSIDE_SCALE)
        memory = self.word_memory.take(touched, axis=0)
        self._step(own, memory, (words * n).astype(np.float32))
        model.words[touched], self.word_memory[touched] = own, memory
        self._step(model.inner, self.inner_memory, (inner * n).astype(np.float32))
        self.steps[touched] += np.bincount(each, minlength=len(touched))


def token_ids(lexicon: Lexicon, index, ends):
    """Contexts, targets and slots of texts: word indices in turn and where each text ends, 0 first. Texts get an end token."""
    import numpy as np

    texts, lengths = len(ends) - 1, np.diff(ends)
    before = CONTEXT + (CONTEXT + 1) * np.arange(texts)
    at = np.arange(len(index)) + np.repeat(before, lengths)
    stops = ends[1:] + before
    ids = np.full(len(index) + (CONTEXT + 1) * texts, lexicon.start, np.int64)
    slots = np.full(len(ids), -1, np.int64)
    real = np.zeros(len(ids), bool)
    ids[at], slots[at], real[at] = lexicon.entry[index], lexicon.slot[index], True
    ids[stops], real[stops] = lexicon.end, True
    at = np.flatnonzero(real)
    return np.stack([ids[at - 1 - p] for p in range(CONTEXT)], axis=1), ids[at], slots[at]


def cuts(ends, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` words, or of one text."""
    import numpy as np

    first = 0
    while first < len(ends) - 1:
        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, stop
        first = stop


def train(texts: DataFrame, counts: Counts) -> LogBilinear:
    """Train on every text of `texts`; partitions train apart and are averaged, words by the steps on them.

    Partitions are put together, without a shuffle, until there are about TRAINED tokens for each.
    """
    import numpy as np

    shared = texts.sparkSession.sparkContext.broadcast(counts)
    model = LogBilinear.start(counts)
    # rows: targets with biases, context vectors, inner ones, places, words
    entries, width = len(model.bias), SIZE + 1
    first_word = 3 * entries + CONTEXT

    def make(batches) -> Iterator[dict]:
        lexicon = Lexicon(shared.value)
        trainer = Trainer(shared.value, lexicon)
        for b in batches:
            if b.num_rows:
                _, index, places, ends = lexicon.of_batch(b.column("text"))
                trainer.learn(*token_ids(lexicon, index[places], ends))
        if trainer.tokens:
            m, tokens = trainer.model, trainer.tokens
            rows = np.column_stack([m.target, m.bias])
            yield {
                "entry": np.arange(first_word, dtype=np.int32),
                "tokens": np.full(first_word, tokens, np.int64),
                "numbers": [*rows, *m.context, *m.inner, *m.place],
            }
            touched = np.flatnonzero(trainer.steps)
            for i in range(0, len(touched), 16_384):
                at = touched[i : i + 16_384]
                yield {"entry": (first_word + at).astype(np.int32), "tokens": trainer.steps[at], "numbers": list(m.words[at])}

    copies = max(1, -(-counts.tokens // TRAINED))
    parts = map_batches(texts.select("text").coalesce(copies), make, "entry int, tokens bigint, numbers array<float>")
    sums = parts.groupBy("entry").agg(
        F.sum("tokens").alias("tokens"),
        *[F.sum(F.get("numbers", F.lit(d)).cast("double") * F.col("tokens")).alias(f"s{d}") for d in range(width)],
    )
    # at most FREQUENT + SINGLE + CLASSES + 4 rows
    found = sums.toArrow()
    if found.num_rows == 0:
        return model
    place = found["entry"].to_numpy()
    table = np.zeros((int(place.max()) + 1, width), np.float32)
    for d in range(width):
        table[place, d] = found[f"s{d}"].to_numpy() / found["tokens"].to_numpy()
    rows, touched = table[:entries], place[place >= first_word]
    model.target, model.bias = rows[:, :SIZE].copy(), rows[:, SIZE].copy()
    model.context = table[entries : 2 * entries, :SIZE].copy()
    model.inner = table[2 * entries : 3 * entries, :SIZE].copy()
    model.place = table[3 * entries : first_word, :SIZE].copy()
    model.words[touched - first_word] = table[touched, : SIZE + 1]
    return model


def normalised(spark: SparkSession, model: LogBilinear) -> LogBilinear:
    """The model with its tables of sums, made by tasks over ranges of context entries."""
    import numpy as np

    shared, n = spark.sparkContext.broadcast(model), len(model.bias)

    def make(batches) -> Iterator[dict]:
        for b in batches:
            rows = b.column("id").to_numpy()
            if len(rows):
                tables = (shared.value.norm_rows(rows), shared.value.inner_norm_rows(rows))
                yield {"id": rows, **{k: [r.astype(np.float32).tobytes() for r in t] for k, t in zip(("a", "b"), tables)}}

    ranges = spark.range(0, n, 1, max(1, n // 192))
    found = map_batches(ranges, make, "id bigint, a binary, b binary", rows=32).orderBy("id").toArrow()
    norms, inner = (np.stack([np.frombuffer(x, np.float32) for x in found[k].to_pylist()]) for k in ("a", "b"))
    return replace(model, norms=norms, inner_norms=inner)


def _scored(texts: DataFrame, counts: Counts, model: LogBilinear) -> DataFrame:
    """Scores of the listed words, and the list of all others with the logs' denominators in their classes."""
    shared = texts.sparkSession.sparkContext.broadcast((counts, model))

    def make(batches) -> Iterator[dict]:
        import numpy as np

        counts, model = shared.value
        lexicon, number = Lexicon(counts), counts.lists()[1]
        below = rest_denominators(counts, lexicon)
        # places after the listed words are for the others, whose counts are looked up later
        base_of = np.r_[np.log10((number + SMOOTH) / denominator(counts)), np.zeros(lexicon.classes)]
        base_end = float(np.log10((counts.ends + SMOOTH) / denominator(counts)))

        def sums(values, ends):
            total = np.r_[0, np.cumsum(values)]
            return total[ends[1:]] - total[ends[:-1]]

        def scored(words, of_word, places, ends):
            index, n = of_word[places], len(ends) - 1
            logs = model.log_probabilities(*token_ids(lexicon, index, ends)) / np.log(10.0)
            row = np.repeat(np.arange(n), np.diff(ends))
            other = np.flatnonzero(index >= lexicon.listed)
            pairs, times = np.unique(row[other] * len(words) + places[other], return_counts=True)
            kind = pairs % max(1, len(words))
            offsets = np.searchsorted(pairs, np.arange(n + 1) * len(words)).astype(np.int32)

            def lists(values):
                return pa.ListArray.from_arrays(pa.array(offsets), values)

            return {
                "n_tokens": np.diff(ends) + 1,
                "n_known": sums(index < lexicon.listed, ends) + (counts.ends > 0),
                "base": np.bincount(row, base_of[index], n) + base_end,
                "score": np.add.reduceat(logs, ends[:-1] + np.arange(n)),
                "words": lists(words.take(pa.array(kind)).cast(pa.binary())),
                "times": lists(pa.array(times.astype(np.int32))),
                "below": lists(pa.array(below[of_word[kind] - lexicon.listed])),
            }

        for b in batches:
            if b.num_rows == 0:
                continue
            words, of_word, places, ends = lexicon.of_batch(b.column("text"))
            for i, j in cuts(ends, TOGETHER):
                own = {k: b.column(k).slice(i, j - i) for k in ("doc_id", "held_out")}
                yield own | scored(words, of_word, places[ends[i] : ends[j]], ends[i : j + 1] - ends[i])

    return map_batches(
        texts,
        make,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double,"
        " words array<binary>, times array<int>, below array<double>",
    )


def denominator(counts: Counts) -> float:
    """Of the smoothed share of a word among all tokens."""
    return counts.tokens + SMOOTH * (counts.distinct + 1)


def rest_denominators(counts: Counts, lexicon: Lexicon):
    """Of the smoothed share of a word among the unlisted words of its class, per class."""
    tokens, kinds = counts.rests(lexicon.classes)
    return tokens + SMOOTH * (kinds + 1)


def score_texts(docs: DataFrame) -> DataFrame:
    """Score every row of `docs` (doc_id, text) with a model of those whose id is not held out.

    Held out are ids whose crc32 (of the id as text) is divisible by 10, and rows without an id. Tokens are the lower-cased
    words and one end. Returns doc_id, held_out, n_tokens, n_known (tokens that occur in training),
    train_tokens, base_score (log10 under the smoothed unigram model), score (log10 under the
    log-bilinear model). Null texts are empty. Repeated rows count and are scored each; an empty table
    gives an empty result.
    """
    texts = _texts(docs)
    learned = texts.where("not held_out")
    table = staged(count_words(learned), "word-counts")
    counts = with_rests(frequent_counts(table), table)
    model = normalised(docs.sparkSession, train(learned, counts))
    rows = numbered(_scored(texts, counts, model), "scored")

    rest = rows.select("row_no", F.explode(F.arrays_zip("words", "times", "below")).alias("w")).select(
        "row_no", F.col("w.words").alias("word"), F.col("w.times").alias("times"), F.col("w.below").alias("below")
    )
    n = F.coalesce("n", F.lit(0))
    found = rest.join(table.where("word is not null"), "word", "left").groupBy("row_no").agg(
        F.sum(F.col("times") * F.log10((n + SMOOTH) / denominator(counts))).alias("base_rest"),
        F.sum(F.col("times") * F.log10((n + SMOOTH) / F.col("below"))).alias("score_rest"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known_rest"),
    )
    joined = rows.drop("words", "times", "below").join(found, "row_no", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_rest", F.lit(0))).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("score_rest", F.lit(0.0))).alias("score"),
    )
