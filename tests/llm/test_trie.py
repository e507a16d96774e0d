"""The trie of conversations against a plain walk over all prefixes."""

import collections
import hashlib
import random
import zlib

import pytest

from pricemill.llm import prefix_trie

ROOT_HASH = hashlib.sha256(b"").hexdigest()


def frame(spark, rows):
    """Conversations with columns whose names clash with those the operator uses inside."""
    wide = [(c, t, r, x, 1, "x", 7, 0) for c, t, r, x in rows]
    return spark.createDataFrame(
        wide, "conv_id long, turn long, role string, text string, row_no long, digest string, depth long, k1 long"
    )


def slow_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, digest, r, x))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + v[h:]
    nodes = collections.defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    children = collections.Counter(n[:-1] for n in nodes if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode().split()) if n else 0
    return sorted(
        (
            min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(n)).encode()).hexdigest(),
        )
        for n, m in nodes.items()
    )


def compare(spark, rows):
    found = prefix_trie.prefix_trie(frame(spark, rows)).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in found) == slow_trie(rows)
    return found


def some_conversations(seed, n, longest):
    rng = random.Random(seed)
    turns = [("system", "be  kind"), ("user", "hello there\tall"), ("assistant", ""), ("user", "a b c"), ("", "é ü"), (None, "x")]
    rows = []
    for c in rng.sample(range(-60, 4 * n), n):
        for t in range(rng.randint(0, longest)):
            rows.append((c, t if rng.random() < 0.9 else None, *turns[rng.choice((0, 0, 1, 1, 2, 3, 4, 5))]))
    return rows


def test_trie(spark):
    for seed in range(2):
        compare(spark, some_conversations(seed, 120, 7))
    compare(spark, [(7, 0, "user", "alone"), (7, 0, "user", "alone"), (None, 1, "user", "nobody"), (40, None, None, None)])
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0


def test_long_conversations_span_bands(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BAND", 4)
    monkeypatch.setattr(prefix_trie, "SHARD", 8)
    rows = some_conversations(5, 60, 19)
    # copies of one long conversation, one of them cut, one longer
    for c, n in ((1000, 41), (1001, 41), (1020, 41), (1040, 30), (1060, 44)):
        rows += [(c, t, "user", f"turn {t}") for t in range(n)]
    compare(spark, rows)


def test_long_texts_and_hot_first_turn(spark):
    rows = [(c, 0, "system", "the same") for c in range(300)]
    rows += [(c, 1, "user", f"question {c % 7}") for c in range(300)] + [(3, 2, "user", "word " * 200_000)]
    compare(spark, rows)


def test_walk_counts_bits():
    rows = {0: [(i, (0, 0), 0, 0) for i in range(3)], 1: [(0, (5, 5), 2, 1), (1, (5, 5), 2, 0), (2, (6, 6), 1, 1)], 2: [(1, (7, 7), 3, 1)]}
    parts = {p[0:3]: p for p in prefix_trie.walk([10, 20, 30], rows, [(0, 0)] * 3, 0)}
    assert len(parts) == 4 and parts[0, 0, 0][6:9] == (3, [10, 20, 30], [])
    by_members = {tuple(p[7]): p for p in parts.values()}
    assert by_members[10, 20][8] == [10] and by_members[30,][8] == [30]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_on_a_table(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    compare(spark, rows)
