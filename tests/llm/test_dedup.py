"""Deduplication operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from pricemill.llm import components, embedding, exact, lines, simhash, substring

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators use inside."""
    wide = [(i, t, "en", s, len(t or ""), 1, "x", 2) for i, t, s in rows]
    return spark.createDataFrame(
        wide,
        "doc_id long, text string, lang string, source string, n_chars long, row_no long, hash string, doc long",
    )


def some_texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(75)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 40, 120)))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 20) : rng.randint(50, 75)]
        text = "".join(w + rng.choice((" ", "\n", "\t ", " \n")) for w in words)
        rows.append((i * 3 % 61, text, f"s{i % 3}"))
    rows += [(200, rows[5][1], "s0"), (201, rows[5][1] + "  ", None), (202, None, "s1"), (203, "", "s1"), (204, " \n", "s2")]
    return rows + [(200, rows[5][1], "s0"), (None, rows[7][1], "s0")]


@pytest.fixture(scope="module")
def rows_():
    return some_texts(3)


def test_exact_groups(spark, rows_):
    found = exact.exact_groups(frame(spark, rows_)).collect()
    assert len(found) == len(rows_)
    groups = collections.defaultdict(list)
    for i, t, _ in rows_:
        groups[hashlib.sha256(SPACES.sub(" ", t or "").encode()).hexdigest()].append(i)
    for r in found:
        own = groups[r.text_sha256]
        assert r.group_size == len(own)
        assert r.keep_id == min((i for i in own if i is not None), default=None)
    kept = exact.drop_exact_copies(frame(spark, rows_))
    assert kept.columns == frame(spark, rows_).columns
    assert kept.count() == len(groups) == sum(r.kept for r in found)


def test_frequent_digest_is_settled_exactly(spark):
    rows = [(i, "the same  text" if i % 3 else f"text {i}", "s") for i in range(3000)]
    found = exact.exact_groups(frame(spark, rows)).where("group_size > 1").collect()
    assert {(r.keep_id, r.group_size) for r in found} == {(1, 2000)} and sum(r.kept for r in found) == 1


def test_substring(spark, rows_):
    first = {}
    texts = [(2**63 if i is None else i, (t or "").encode().split()) for i, t, _ in rows_]
    for i, w in texts:
        for k in range(len(w) - 49):
            key = b" ".join(w[k : k + 50])
            first[key] = min(first.get(key, 2**64), i)
    want = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - 49):
            if first[b" ".join(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((None if i == 2**63 else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    found = substring.substring_dedup(frame(spark, rows_)).drop("spans").collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


def test_cover_reaches_every_shift():
    cover = substring.COVER
    assert {(a - b) % substring.PERIOD for a in cover for b in cover} == set(range(substring.PERIOD))


def test_lines(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choices(["a", " b", "c ", "", "d"], k=rng.randint(0, 9))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "a\nb\nc\nx\na\nb\nc", "s")]
    first, want = {}, []
    parsed = [(i, lines.line_items(t)) for i, t, _ in rows]
    for i, (_, items, _) in parsed:
        for k in range(len(items) - 2):
            first.setdefault(tuple(items[k : k + 3]), (i, k))
    for i, (whole, items, at) in parsed:
        gone = set()
        for k in range(len(items) - 2):
            if first[tuple(items[k : k + 3])] < (i, k):
                gone.update(at[k : k + 3])
        want.append((i, len(items), len(gone), b"\n".join(x for j, x in enumerate(whole) if j not in gone).decode()))
    found = lines.line_dedup(frame(spark, rows)).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_winnow_selects_the_same_in_equal_runs():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 99, 40), rng.integers(0, 99, 40)
    b[10:20] = a[5:15]
    at = set((lines.winnow(a, 3) + 5).tolist()) & set(lines.winnow(b, 3).tolist())
    for start in range(10, 18):
        assert at & set(range(start, start + 3))


def _fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def _groups(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_fingerprint_groups(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(200)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = "Z%d" % rng.randrange(9)
        rows.append((i, " ".join(words), "s"))
    rows += [(50, None, "s"), (51, " ", "s"), (52, "One", "s"), (53, "oNe", "s"), (54, "a b", "s"), (None, "a b", "s")]
    prints = [_fingerprint(t) for _, t, _ in rows]
    root = _groups(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = collections.defaultdict(lambda: 99)
    for (i, _, _), r in zip(rows, root):
        least[r] = min(least[r], 99 if i is None else i)
    want = [(i, f"{p:016x}", least[r]) for (i, _, _), p, r in zip(rows, prints, root)]
    found = simhash.fingerprint_groups(frame(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("few", [2, 64])
def test_links_connect_what_three_bits_connect(spark, few):
    rng = np.random.default_rng(0)
    prints = set()
    for base in rng.integers(0, 2**63, 4).tolist():
        for _ in range(60):
            value = base
            for bit in rng.choice(64, rng.integers(0, 7), False):
                value ^= 1 << int(bit)
            prints.add(value - (1 << 64) if value >= 1 << 63 else value)
    prints = sorted(prints)
    root = _groups(prints, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    nodes = spark.createDataFrame([(0, p) for p in prints], "which int, fp long")
    found = simhash.links(nodes, few)
    # exploded nodes are far more than Spark takes them for, so no side may be broadcast
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    label = {r.node: r.label for r in components.components(found.select("a", "b")).collect()}
    parts = lambda of: {frozenset(p for p, o in zip(prints, of) if o == x) for x in of}
    assert parts([label.get(p, p) for p in prints]) == parts(root)


def test_near_copies(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows = []
    for i in range(20):
        words = [word() for _ in range(300)]
        rows.append((i, " ".join(words), "s"))
        words[rng.randrange(300)] = word()
        rows.append((100 + i, " ".join(words), "s"))
    rows += [(300, None, "s"), (301, "", "s"), (None, rows[0][1], "s")]
    kept = simhash.drop_near_copies(frame(spark, rows))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == frame(spark, rows).columns
    assert set(range(20)) | {300, 301, None} <= ids and len(ids & set(range(100, 120))) <= 1


def _shingle_set(text):
    words = (text or "").lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def _alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) > 0


def _least_of_groups(rows):
    """The smallest doc_id of the group of each doc_id, from all pairs of shingle sets."""
    root = _groups([_shingle_set(t) for _, t, _ in rows], _alike)
    least = {}
    for (i, _, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    return {i: least[r] for (i, _, _), r in zip(rows, root)}


def test_near_copies_that_fail_their_representative(spark):
    # copies of one base with blocks of other words: many are below 0.8 of the base and of each other, yet linked
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base = [word() for _ in range(300)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randint(2, 7)):
            words[rng.randrange(300)] = word()
        rows.append((i, " ".join(words), "s"))
    # the last words only: fingerprints are equal or close, and sets are not
    for i in range(40):
        at = 60 + 2 * i % 40
        rows.append((1000 + i, " ".join(base[at:] + base[:at][::-1]), "s"))
    want = _least_of_groups(rows)
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert {i: found.get(i, i) for i in want} == want


def test_rows_that_repeat_an_id_are_judged_one_by_one(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(100)) for _ in range(3)]
    rows = [(1, texts[0], "first"), (2, texts[0], "copy"), (2, texts[1], "clean"), (3, texts[2], "one"), (3, texts[2], "two")]
    kept = sorted((r.doc_id, r.source) for r in simhash.drop_near_copies(frame(spark, rows)).collect())
    assert kept[:2] == [(1, "first"), (2, "clean")] and len(kept) == 3 and kept[2][0] == 3


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(50)] + [(70, 80), (80, 75), (9, 9)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in found} == {**dict.fromkeys(range(51), 0), 70: 70, 75: 70, 80: 70}


def test_vectors(spark, monkeypatch):
    # small cells and blocks, so that several of each meet
    monkeypatch.setattr(embedding, "PER_PIVOT", 20)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    vectors = [(base[i % 30] + rng.normal(size=8) * 0.07 * (i % 4)).astype(np.float32).tolist() for i in range(120)]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    rows += [(200, vectors[3], 0), (201, None, 0), (202, [0.0] * 8, 0), (203, [float("nan")] * 8, 0), (204, [], 0)]
    rows += [(205, [1.0] * 7 + [None], 0), (206, [1.0, 2.0], 1), (3, vectors[3], 5)]
    usable = [(i, r) for i, r in enumerate(rows) if r[0] < 201]
    x = np.array([r[1] for _, r in usable], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    root = _groups(range(len(x)), lambda a, b: near[a, b])
    least = collections.defaultdict(lambda: 10**9)
    for (_, r), g in zip(usable, root):
        least[g] = min(least[g], r[0])
    want = [(r[0], int(near[k].sum() - 1), least[root[k]]) for k, (_, r) in enumerate(usable)]
    want += [(r[0], 0, r[0]) for r in rows if r[0] >= 201]
    found = embedding.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    )
    assert sorted(tuple(r)[:3] for r in found.collect()) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.collect())


def _watched(monkeypatch):
    """Will hold the sizes of the blocks that `embedding` stages."""
    sizes, staged = [], embedding.staged

    def seen(df, name):
        out = staged(df, name)
        if name == "vector-blocks":
            sizes.extend(len(r.ids) // 8 for r in out.collect())
        return out

    monkeypatch.setattr(embedding, "staged", seen)
    return sizes


@pytest.mark.parametrize("width, spread", [(2, 0.02), (24, 0.3), (24, 0.03)])
def test_a_vector_lies_in_one_block(spark, monkeypatch, width, spread):
    """Far from all pivots, on a line, or all alike: no vector is copied to cells, each pair is met once, nothing is lost."""
    monkeypatch.setattr(embedding, "PER_PIVOT", 8)
    monkeypatch.setattr(embedding, "BLOCK", 16)
    monkeypatch.setattr(embedding, "GROUP_BYTES", 40 * 4 * width, raising=False)
    monkeypatch.setattr(embedding, "HELD_LINKS", 50, raising=False)
    sizes = _watched(monkeypatch)
    rng = np.random.default_rng(width)
    base = rng.normal(size=(1 if spread == 0.03 else 40, width))
    vectors = (base[np.arange(250) % len(base)] + rng.normal(size=(250, width)) * spread).astype(np.float32)
    vectors[-20:] = vectors[:20]
    x = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    near = x @ x.T >= 0.95
    root = _groups(range(250), lambda a, b: near[a, b])
    least = [root.index(r) for r in root]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = [(i, int(near[i].sum()) - 1, least[i], least[i] == i) for i in range(250)]
    assert sorted(map(tuple, found.collect())) == want
    assert sum(sizes) == 230 and max(sizes) <= 16 and len(sizes) > 230 // 16


def test_empty_tables(spark):
    none = frame(spark, [])
    for operator in (
        exact.exact_groups, exact.drop_exact_copies, substring.substring_dedup, lines.line_dedup,
        simhash.fingerprint_groups, simhash.drop_near_copies,
    ):
        assert operator(none).count() == 0
    assert embedding.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_anchors_of_a_batch_are_those_of_each_text(spark):
    texts = [" ".join(f"w{i * j % 60}" for j in range(i * 9 % 130)) for i in range(40)] + [None, " ", " x  y "]
    rows = [(i, t, "s") for i, t in enumerate([*texts, texts[20]])]
    docs = substring._texts(frame(spark, rows))
    alone = [substring._anchors(docs.where(docs.doc == i), 50, True).collect() for i in range(len(rows))]
    together = substring._anchors(docs.coalesce(1), 50, True).collect()
    assert sorted(map(tuple, together)) == sorted(tuple(r) for found in alone for r in found) and together
    assert {(r.pos % substring.PERIOD) for r in together} <= set(substring.COVER)
    contents = {tuple((t or "").split()) for t in texts if len((t or "").split()) > substring.COVER[0] + 19}
    assert len({r.owner for r in substring._anchors(docs, 50, False).collect()}) == len(contents)
