"""Whitening against a dense eigensolver, toxicity against every pair of terms and on held-out rows."""

import math
import zlib

import numpy as np
import pytest

from pricemill.llm import toxicity, whitening
from test_dedup import frame, some_texts

FOLDER = "/root/testdata/sf0.01"


def vectors(spark, rows):
    """Vectors with columns whose names clash with those the operator uses inside."""
    wide = [(i, v, 1, 2, "x", 0) for i, v in rows]
    return spark.createDataFrame(wide, "vec_id long, embedding array<float>, vec int, n int, component string, label int")


def test_eigenvectors_of_matrices():
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    cases = [np.cov(rng.standard_normal((200, 30)).T), np.diag([5.0, 5, 5, 2, 2, 1]), np.zeros((3, 3)), np.eye(4), np.array([[2.0]])]
    cases += [turn @ np.diag([-2.0, -1, 0, 0, 1, 2]) @ turn.T, 1 / (np.arange(12)[:, None] + np.arange(12) + 1.0)]
    for v in cases:
        values, q = whitening.spectral_components(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * max(1, np.abs(v).max()))
        assert np.allclose(q.T @ q, np.eye(len(v)), atol=1e-13) and np.allclose(q @ np.diag(values) @ q.T, v, atol=1e-13 * max(1, np.abs(v).max()))


def test_polar_factor_of_an_ill_conditioned_matrix():
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.standard_normal((8, 8)))
    a = turn @ np.diag([1, -1, 1e-4, -1e-6, 1e-8, 0.5, -0.3, 1e-10]) @ turn.T
    u = whitening.polar_factor((a + a.T) / 2)
    assert np.allclose(u @ u, np.eye(8), atol=1e-12) and np.allclose(u, u.T)


def slow_whitening(rows):
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in usable])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    centred = x - np.array(sums) / n
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    k = min(32, int((e > 1e-10 * e[0]).sum()))
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [i for i, _ in usable], centred @ q[:, :k] / np.sqrt(e[:k]), deviation, e[:k] / e.sum()


@pytest.mark.parametrize("dimension", [5, 40])
def test_whitening(spark, dimension):
    rng = np.random.default_rng(dimension)
    base = rng.standard_normal((150, dimension)) * np.linspace(1, 3, dimension)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(3, rows[3][1]), (None, rows[4][1])]
    odd = [(900, None), (901, []), (902, [float("nan")] * dimension), (903, [None] * dimension), (904, [float("inf")] * dimension)]
    odd += [(905, [1.0] * (dimension + 1)), (906, [1.0])]
    found = whitening.whiten(vectors(spark, rows + odd)).collect()
    ids, z, deviation, explained = slow_whitening(rows)
    k = z.shape[1]
    assert len(found) == len(rows) * k and {r.n for r in found} == {len(rows)}
    assert max(r.identity_error for r in found) < 1e-9
    sign = {}
    for r in sorted(found, key=lambda r: -abs(r.whitened)):
        own = [j for j, i in enumerate(ids) if i == r.vec_id]
        assert r.deviation in {deviation[j] for j in own} and r.explained == pytest.approx(explained[r.component - 1])
        want = z[own[0], r.component - 1]
        s = sign.setdefault(r.component, 1 if want * r.whitened > 0 else -1)
        assert min(abs(s * r.whitened - z[j, r.component - 1]) for j in own) < 1e-7


def test_whitening_of_tables_without_spread(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    line = whitening.whiten(vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])])).collect()
    assert {r.component for r in line} == {1} and sorted(round(abs(r.whitened), 6) for r in line) == [0.0, 1.224745, 1.224745]


def test_deviation_beyond_a_long_is_null():
    x = np.array([[10**12, 0], [0, 0]])
    assert whitening._deviations(x, 2, (10**12, 0))[0] is None or whitening._deviations(x, 2, (10**12, 0))[0] < 2**63
    assert whitening._deviations(np.array([[10, 0], [0, 2]]), 2, (10, 2)) == [104, 104]


def test_log_odds_by_every_pair():
    rng = np.random.default_rng(3)
    weights, factors = rng.standard_normal(9), rng.standard_normal((9, 4))
    rows = [{0: 1, 4: 2, 7: 1}, {}, {5: 3}, dict.fromkeys(range(9), 2)]
    odds = toxicity.log_odds(*toxicity._laid_out(rows), 0.5, weights, factors)[0]
    for row, got in zip(rows, odds):
        x = {p: 1 + math.log(c) for p, c in row.items()}
        want = 0.5 + sum(weights[p] * v for p, v in x.items())
        want += sum(factors[p] @ factors[q] * x[p] * x[q] for p in x for q in x if p < q)
        assert got == pytest.approx(want)


def test_interactions_are_learned(spark):
    """Neither word alone is toxic, both together are: no additive weights can tell."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 30, 8)]
        kind = i % 4
        words += ["insult"] * (kind in (1, 3)) + ["group"] * (kind in (2, 3))
        rows.append((i, " ".join(rng.permutation(words)), "s"))
        labels.append((i, 1, int(kind == 3)))
    docs = frame(spark, rows)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([found[i] == (i % 4 == 3) for i in held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(found[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([s.predicted for s, t in held if t == 0]) < 0.03
    assert np.mean([s.predicted for s, t in held if t == 1]) > 0.5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_toxicity_of_odd_rows(spark):
    rows = some_texts(1) + [(300, "word, " * 400_000, "s0")]
    docs = frame(spark, rows)
    for labels in ([], [(1, 1, 0), (2, 1, 0)], [(3, 0, 0), (6, 1, 0), (9, 0, 1), (9, 1, 0), (12, 1, 1), (None, 1, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = toxicity.fit_toxicity(docs, table)
        assert toxicity.score_toxicity(docs, model).where("score between 0 and 1").count() == len(rows)
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0


def test_words_of_long_texts():
    text = "ab cd\n" * 500_000 + "x" * 3_000_000 + " End"
    counts = toxicity.word_counts(text)
    assert counts["ab"] == counts["cd"] == 500_000 and counts["end"] == 1 and len(counts) == 4
