"""Quality, personal data, language model, mixing and packing on small tables; the pipeline end to end."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pricemill.llm import language_model, mixing, packing, pii, quality
from pricemill.llm.common import as_list, words_of, words_of_batch
from pricemill.llm.queries import tokenizer_file
from test_dedup import frame, some_texts

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_quality_on_held_out_rows(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit_quality(documents, labels)
    found = {r.doc_id: r for r in quality.score_quality(documents, model).collect()}
    held = [(found[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good = [s.predicted for s, q in held if q == 1]
    bad = [s.predicted for s, q in held if q == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    kept = quality.keep_good(documents, model)
    assert kept.columns == documents.columns and kept.count() == sum(r.predicted for r in found.values())


def test_quality_of_odd_rows(spark):
    rows = some_texts(1)
    docs = frame(spark, rows)
    for labels in ([], [(1, 1, 0), (2, 1, 0)], [(3, 0, 0), (6, 1, 0), (9, 0, 1), (9, 1, 1), (12, 1, 0), (None, 1, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = quality.fit_quality(docs, table)
        assert quality.score_quality(docs, model).where("score between 0 and 1").count() == len(rows)
    assert quality.score_quality(frame(spark, []), model).count() == 0


def test_dictionaries_leave_their_fold_out(spark):
    rows = [(i, i % 2, i % 5 % quality.FOLDS, f"text number {i}") for i in range(40)]
    sample = spark.createDataFrame(rows, "doc_id long, quality int, fold int, text string")
    found = quality._dictionaries(sample)
    for k, pair in enumerate(found):
        for label, dictionary in zip((1, 0), pair):
            want = [t.encode() for _, q, fold, t in rows if q == label and fold != k]
            assert dictionary == quality._dictionary(want)
    assert len(found) == quality.FOLDS + 1
    one_class = quality._dictionaries(sample.where("quality = 1 and fold = 0"))
    assert one_class[0] == (b"", b"") and one_class[1][1] == b"" and one_class[1][0]


def slow_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_base_spans():
    rng, find = random.Random(1), pii.base_finder()
    for _ in range(5000):
        letters = rng.choice(["a@b.c1-+ .%", "0123456789. -", "+12 ()-.3@a.b", "ab@.-", "1.2@3a.b+ "])
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert pii.joined(find(text)) == pii.joined(slow_spans(text))
    assert find("a" * 200_000 + "9" * 200_000) == []


def test_second_mentions_are_added(spark):
    rows = [
        (1, "call +1 (988) 555-2485 now; later 988-555-2485, zip 123-4567", "s"),
        (2, "é rfmlrasf.67@mail6.example.com; user rfmlrasf.67 there", "s"),
        (3, None, "s"), (4, "", "s"), (4, "nothing 12345678 here", "s"), (None, "x@y.zz", "s"),
    ]
    rows += [(i, f"+1 (988) 555-{i:04d}", "s") for i in range(100, 140)]
    rows += [(i, f"user.{i}@mail.example.com and user.{i}@mail.example.com", "s") for i in range(200, 240)]
    found = {(r.doc_id, r.n_email): r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert found[1, 0].base_spans == "phone:5:22" and found[1, 0].spans == "phone:5:22,phone:34:46"
    assert found[2, 1].spans == "email:2:31,email:38:49"
    assert found[3, 0].spans == found[4, 0].spans == "" and found[None, 1].spans == "email:0:6"
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_similar_names():
    alike = pii.name_index(["john.smith", "rfmlrasf.67", "user.200", "a" * 80 + ".1"])
    same = {"john.smith": "john.smith", "a" * 80 + ".1": "a" * 80 + ".1"}
    near = {"john_smith": "john.smith", "johnsmith": "john.smith", "jon.smith": "john.smith", "johnn.smith": "john.smith",
            "rfmlrasf67": "rfmlrasf.67", "rfmlrbsf67": "rfmlrasf.67", "usr200": "user.200", "use.r200": "user.200", "usar200": "user.200"}
    assert all(alike(w) == n for w, n in same.items())
    assert all(alike(w) == n for w, n in near.items())
    assert not any(map(alike, ["user.201", "user.20", "jo.smyth", "rfmlrasf.76", "a" * 80 + "1", "", "smith", "x" * 100_000]))


def exact_beliefs(nodes, unary, unknown, edges):
    """Posteriors by summing over all labellings."""
    import itertools

    skip, chain = pii._edges(nodes)
    total = np.zeros((len(nodes), len(pii.LABELS)))
    for labels in itertools.product(range(len(pii.LABELS)), repeat=len(nodes)):
        if any(n[4] is not None and n[4] != x for n, x in zip(nodes, labels)):
            continue
        weight = sum(unary.get(n[2], unknown)[x] for n, x in zip(nodes, labels) if n[4] is None)
        weight += sum(edges[k][labels[i], labels[j]] for k, own in enumerate((skip, chain)) for i, j in own)
        for i, x in enumerate(labels):
            total[i, x] += math.exp(weight)
    return total / total.sum(axis=1)[:, None]


def test_beliefs_on_small_graphs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        at, nodes = 0, []
        for _ in range(rng.integers(1, 6)):
            at += int(rng.integers(1, 150))
            label = int(rng.integers(0, 4)) if rng.random() < 0.4 else None
            nodes.append((at, at + 5, f"s{rng.integers(3)}", f"k{rng.integers(4)}", label))
        unary = {f"s{i}": np.log(rng.dirichlet(np.ones(5))) for i in range(2)}
        edges = [(lambda m: (m + m.T) / 2)(rng.normal(size=(5, 5)) * scale) for scale in (1.0, 0.2)]
        found = pii.beliefs(nodes, unary, np.log(np.full(5, 0.2)), edges)
        want = exact_beliefs(nodes, unary, np.log(np.full(5, 0.2)), edges)
        observed = [i for i, n in enumerate(nodes) if n[4] is not None]
        assert np.allclose(found.sum(axis=1), 1) and np.allclose(found[observed], want[observed], atol=1e-6)
        # messages are exact where there is no loop, and near where there is a short one
        skip, chain = pii._edges(nodes)
        assert np.abs(found - want).max() < (0.02 if len(skip) + len(chain) < len(nodes) else 0.35)


def test_many_addresses_in_one_text():
    import time

    def seconds(n):
        text = " ".join(f"user.{i}@mail{i}.example.com then user_{i} or 555-{i:07d}" for i in range(10, n + 10))
        start = time.perf_counter()
        spans = pii.base_finder()(text)
        nodes = pii.node_finder()(text, spans)
        found = pii._added(nodes, pii._potentials({"shape": {("name", "email"): n}, "skip": {("email", "email"): n}, "chain": {}}))
        assert len(spans) == n and len(found) == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(100_000) < 60


def test_language_model(spark):
    rows = some_texts(8)
    found = language_model.score_texts(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    counts, held = collections.Counter(), {}
    for i, t, _ in rows:
        held[i] = i is None or zlib.crc32(str(i).encode()) % 10 == 0
        if not held[i]:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((str(i), held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got) == sorted(want) and all(r.score < 0 for r in found)
    assert language_model.score_texts(frame(spark, [])).count() == 0


def test_model_probabilities_sum_to_one():
    counts = language_model.Counts(100, 4, 10, b"a b c", np.array([50, 30, 10], np.int64).tobytes())
    model = language_model.LogBilinear.start(counts)
    contexts = np.array([[0, 1]] * 5)
    assert np.exp(model.log_probabilities(contexts, np.arange(5))).sum() == pytest.approx(1.0)


def test_words_of_classes_sum_to_one(monkeypatch):
    monkeypatch.setattr(language_model, "SINGLE", 5)
    monkeypatch.setattr(language_model, "PER_CLASS", 4)
    rng = np.random.default_rng(3)
    words = sorted({bytes(rng.integers(97, 103, 4, dtype=np.uint8)) for _ in range(60)})
    number = np.sort(rng.integers(2, 50, len(words)))[::-1].astype(np.int64)
    counts = language_model.Counts(int(number.sum()) + 40, len(words) + 1, 10, b" ".join(words), number.tobytes())
    lexicon = language_model.Lexicon(counts)
    assert lexicon.classes > 3 and lexicon.edges[-1] == len(words) - 5 + lexicon.classes
    assert [lexicon.entry[lexicon[w]] - 5 for w in words[5:]] == [lexicon.class_of(w) for w in words[5:]]
    model = language_model.LogBilinear.start(counts)
    for name in ("context", "target", "inner", "words"):
        array = getattr(model, name)
        setattr(model, name, array + rng.normal(0, 1, array.shape).astype(np.float32))
    # every word, the unlisted words of every class, and the end, after two tokens
    index = np.arange(len(words) + lexicon.classes)
    targets, slots = np.append(lexicon.entry[index], lexicon.end), np.append(lexicon.slot[index], -1)
    for context in ([0, 7], [lexicon.start, lexicon.start], [6, lexicon.end]):
        logs = model.log_probabilities(np.array([context] * len(targets)), targets, slots)
        assert np.exp(logs).sum() == pytest.approx(1.0, abs=1e-5)
        r = model.predict(np.array([context]))[0]
        scores = model.target[:-1] @ r + model.bias[:-1]
        want = scores[targets] - np.log(np.exp(scores.astype(float)).sum())
        for c in range(lexicon.classes):
            own = model.words[lexicon.edges[c] : lexicon.edges[c + 1]]
            inside = own[:, :-1] @ model.inner[context[0]] + own[:, -1]
            here = (slots >= lexicon.edges[c]) & (slots < lexicon.edges[c + 1])
            want[here] += inside[slots[here] - lexicon.edges[c]] - np.log(np.exp(inside.astype(float)).sum())
        assert logs == pytest.approx(want, abs=1e-4)


def test_unlisted_words_are_counted_by_class(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SINGLE", 2)
    monkeypatch.setattr(language_model, "PER_CLASS", 3)
    texts = [" ".join(f"w{j}x{j * 7 % 10}" for j in range(i, 40)) for i in range(0, 40, 2)]
    table = language_model.count_words(frame(spark, [(i, t, None) for i, t in enumerate(texts)]))
    for most in (12, 25):
        monkeypatch.setattr(language_model, "FREQUENT", most)
        counts = language_model.with_rests(language_model.frequent_counts(table), table)
        lexicon = language_model.Lexicon(counts)
        want = np.zeros((2, lexicon.classes), np.int64)
        every = collections.Counter(" ".join(texts).encode().split())
        for w, n in every.items():
            if w not in lexicon:
                want[:, lexicon.class_of(w)] += (n, 1)
        assert 0 < len(lexicon) <= most < len(every) and (counts.rests(lexicon.classes) == want).all()
        share, inside, edges = language_model.unigram(counts)
        assert share.sum() == pytest.approx(1.0) and np.add.reduceat(inside, edges[:-1]) == pytest.approx(1.0)


def test_small_partitions_share_a_model(spark):
    texts = frame(spark, [(i, " ".join(f"w{i * j % 50}" for j in range(30)), None) for i in range(300)]).repartition(20)
    table = language_model.count_words(texts)
    counts = language_model.with_rests(language_model.frequent_counts(table), table)
    found, alone = (language_model.train(t, counts) for t in (texts, texts.coalesce(1)))
    assert all((getattr(found, k) == getattr(alone, k)).all() for k in ("target", "context", "inner", "words"))


def test_words_of_slices():
    texts = [None, "", "  a\x0bB \x1cÉ b  ", "\n", *(f"Word{i} x{i % 7}\t" * (i % 40) for i in range(2000)), "é"]
    for i, n in ((0, 2005), (700, 600), (1300, 705), (3, 1), (0, 0)):
        part = pa.array(texts).slice(i, n)
        for lower in (False, True):
            words, places, ends = words_of_batch(part, lower)
            assert as_list(words) == words.to_pylist()
            own = np.array([*words.to_pylist(), None], object)[places]
            want = [words_of(t) for t in part.to_pylist()]
            want = [[w.lower() for w in t] if lower else t for t in want]
            assert [own[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_model_beats_unigrams(spark, documents):
    found = language_model.score_texts(documents).where("held_out").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), f"s{i % 7}" if i % 7 else "s0") for i in range(400)]
    rows += [(i, "x " * 30, "s0") for i in range(400, 600)] + [(900, None, None), (901, "a b", None), (901, "a b", None)]
    found = mixing.mix(frame(spark, rows))
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5))
    own = sorted(map(tuple, found.collect()), key=str)
    assert own == sorted(map(tuple, again.collect()), key=str) and len(own) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    taken = collections.Counter()
    for r in found.collect():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 21 for s in names)
    assert mixing.take(frame(spark, rows)).count() == found.agg({"copies": "sum"}).first()[0]
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.take(frame(spark, [])).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    odd = ["It's naïve, ok?!", "<|endoftext|> a", "a b\x1cc", "ÀÉ  Straße 12.5 é", "x" * 30000, "word. " * 9000]
    rows = [(i, t, "s") for i, t in enumerate([*odd, *(t for i, t, _ in some_texts(2) if i is not None), None, ""])]
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    found = packing.pack(frame(spark, rows), tokenizer_file()).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(frame(spark, []), tokenizer_file()).count() == 0


def test_curve_visits_neighbours():
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    path = cells[np.argsort(packing.hilbert_index(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pipeline(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "simhash near-dedup", "source mix", "packing",
    ]
    assert found.count() > 0 and found.columns[0] == "doc_id"
