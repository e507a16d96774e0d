"""Stages of the pipeline on rows with odd names, nulls, ties, repeats and long texts, against plain loops."""

import re

from pricemill.llm import exact, mixing, simhash
from pricemill.llm.common import marked

NAMES = "doc_id long, text string, lang string, source string, row_no long, text_sha256 string, `row` long, size_ string, id_ string, `odd name.x` long"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows):
    wide = [(i, t, "en", s, k, "sha", k + 1, "z", "id", k + 2) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(wide, NAMES)


ROWS = [
    (5, "a b  c", "s"), (3, "a b c", "s"), (3, "a\tb c", "t"), (9, None, None), (8, "", "s"), (None, " ", "s"),
    (None, "x", "s"), (7, "x", None), (6, "only", "s"), (6, "only", "s"), (None, "alone", None),
]


def test_exact_copies_keep_their_columns(spark):
    docs = frame(spark, ROWS)
    kept = exact.drop_exact_copies(docs)
    assert kept.schema == docs.schema
    found = sorted(((r.doc_id, SPACES.sub(" ", r.text or "")) for r in kept.collect()), key=str)
    best = {}
    for i, t, _ in ROWS:
        key = SPACES.sub(" ", t or "")
        best[key] = min(best.get(key, (True, 0)), (i is None, i or 0))
    assert found == sorted(((None if none else i, k) for k, (none, i) in best.items()), key=str)
    again = exact.drop_exact_copies(frame(spark, ROWS[::-1]).repartition(4))
    assert sorted((str(r.text), str(r.source)) for r in again.collect()) == sorted(
        (str(r.text), str(r.source)) for r in kept.collect()
    )
    assert exact.drop_exact_copies(frame(spark, [])).count() == 0


def test_taken_rows_keep_their_columns(spark):
    docs = frame(spark, ROWS)
    taken = mixing.take(docs)
    assert taken.schema == docs.schema
    by_size = mixing.mix(docs).groupBy("doc_id").agg({"copies": "sum"}).collect()
    want = {r.doc_id: r[1] for r in by_size if r[1]}
    found = {}
    for r in taken.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == want
    assert mixing.take(frame(spark, [])).count() == 0


def test_near_copies_keep_their_columns(spark):
    base = [f"w{i % 97}x{i % 31}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    rows = [
        (4, " ".join(base), "s"), (2, " ".join([*base[:199], "end"]), "s"), (2, " ".join(["start", *base[1:]]), None),
        (None, " ".join(base), "s"), (1, None, "s"), (0, "", "s"), (10, " ".join(other), "s"),
        (11, " ".join(other * 2000 + ["tail"]), "s"), (12, " ".join(other * 2000), "s"),
    ]
    docs = frame(spark, rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.schema == docs.schema
    # one row of the first family, and the smallest of three texts with the same shingles, two of 400,000 words
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "None", "1", "0", "10"])
    assert simhash.drop_near_copies(frame(spark, [])).count() == 0


def test_majority_of_many_hashes():
    import numpy as np

    hashes = np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64)
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    want = sum(1 << k for k in range(64) if 2 * int(bits[:, k].sum()) > len(hashes))
    assert simhash.majority_bits(hashes) == want


def test_quality_curve_settles():
    """Separable classes, a single useful input, and no useful input at all: weights stay bounded."""
    import numpy as np

    from pricemill.llm import quality

    rng = np.random.default_rng(3)
    n = 600
    labels = (np.arange(n) % 10 != 0).astype(float)
    apart = np.where(labels == 1, 5.0, -5.0) + rng.normal(0, 0.1, n)
    cases = [(np.column_stack([apart, rng.normal(size=n)]), True), (np.column_stack([apart, apart]), True)]
    for features, separable in [*cases, (np.zeros((n, 2)), False), (rng.normal(size=(n, 2)), False)]:
        mean, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-9)
        design = quality._design(features, mean, scale)
        w = quality._logistic(design, labels, np.ones(n))
        p = quality._probability(design, w)
        assert np.isfinite(w).all() and np.abs(w).max() < 100
        assert abs(p.mean() - labels.mean()) < 0.02
        if separable:
            assert ((p > 0.7) == (labels == 1)).all()


def test_scores_by_recomputed_sizes(spark):
    """Every score from the stored dictionaries, with sizes and curve computed anew."""
    import math

    import zstandard

    from pricemill.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    packers = [
        zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        for d in (model.good, model.bad)
    ]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.score_quality(docs, model).collect():
        data = texts[r.doc_id].encode()
        a, b = (len(p.compress(data)) for p in packers)
        x, y = (
            min(5.0, max(-5.0, (v - m) / s))
            for v, m, s in zip(((b - a) / (len(data) + 1), (b - a) / (a + b)), model.mean, model.scale)
        )
        z = sum(w * v for w, v in zip(model.weights, (1.0, x, y, x * x, x * y, y * y)))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.predicted == (r.score >= 0.7)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_without_copies_are_not_shuffled(spark):
    rows = [(i, f"text {i % 50 if i < 100 else i}", "s") for i in range(3000)]
    docs = frame(spark, rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys in (docs.where("doc_id < 100"), docs.where("doc_id < 0")):
            seen = marked(docs, docs["doc_id"], keys, "doc_id")
            assert seen.columns == [*docs.columns, "maybe"] and seen.count() == 3000
            maybe = {r.doc_id for r in seen.where("maybe").collect()}
            assert {r.doc_id for r in keys.collect()} <= maybe and len(maybe) < 150
            # only the keys are shuffled
            assert shuffles(seen) <= 1
        kept = exact.drop_exact_copies(docs)
        assert sorted(r.doc_id for r in kept.collect()) == [*range(50), *range(100, 3000)]
        # each text is shuffled once, and so are the numbers of copies
        assert shuffles(mixing.take(docs)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_taken_rows_of_one_key(spark):
    rows = [(i % 40, f"a b c {i}", "s") for i in range(100)] + [(i, f"only {i}", "t") for i in range(40, 90)]
    taken = mixing.take(frame(spark, rows))
    want = {r.doc_id: r[1] for r in mixing.mix(frame(spark, rows)).groupBy("doc_id").agg({"copies": "sum"}).collect()}
    found = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert found == {k: n for k, n in want.items() if n}
