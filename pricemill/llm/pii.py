"""Personal data by patterns and a skip-chain conditional random field.

Patterns find emails, addresses of machines, cards and phone numbers. What they miss is often a second mention in
another form: a phone number without its plus, the name part of an address alone. So mentions of a document become nodes: the
spans of the patterns, whose labels are observed, and further number groups and words that resemble
one. Nodes whose keys agree (last seven digits, or the name part, joints or one letter aside) are tied by skip edges however far apart they
stand; neighbouring nodes by chain edges. Loopy message passing over that graph labels the open nodes
consistently with the observed ones, and a node that some label claims for itself is added as a span.

Potentials are smoothed log ratios of counts over all documents: labels by the shape of a node (which leaves out what the
patterns look for: the plus, check digits), labels of observed pairs along skip edges and along chain edges.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
#: Last label: none of the kinds.
LABELS = (*KINDS, "none")
#: Posterior from which an open node becomes a span.
SURE = 0.9
#: Digits that make the key of a number, and letters of a name part that are enough to be telling.
KEY_DIGITS, KEY_NAME = 7, 6
#: Longest word that is compared with names by letters.
LONGEST = 64
#: Open nodes farther apart than this many characters have no chain edge.
CHAIN = 80
ROUNDS = 10
#: Messages that are computed at once.
MESSAGES = 1 << 16


def base_finder():
    """A function from text to its base spans [(kind, start, end)], per kind leftmost and apart."""
    import re

    # fixed values: the patterns of the four kinds
    domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
    ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}").finditer
    card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
    long_number = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}").search
    digits = re.compile(r"[0-9]").findall
    name = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

    def emails(text):
        # the name part ends at the sign and is as long as it can be, so each sign has one candidate
        free, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > free and text[start - 1] in name:
                start -= 1
            found = domain(text, at + 1) if start < at else None
            if found:
                yield ("email", start, found.end())
                free = found.end()
            # a sign before `free` lies in no domain, so none is skipped
            else:
                free = max(free, at + 1)
            at = text.find("@", max(at + 1, free))

    def luhn(number):
        total = 0
        for i, d in enumerate(reversed(number)):
            d = ord(d) - 48
            total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
        return total % 10 == 0

    def find(text: str) -> list[tuple[str, int, int]]:
        spans = list(emails(text)) if "@" in text else []
        if text.count(".") >= 3:
            for m in ip(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    spans.append(("ip", m.start(), m.end()))
        if long_number(text):
            for m in card(text):
                number = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(number) <= 19 and luhn(number):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in phone(text):
                if 9 <= len(digits(m[0])) <= 15:
                    spans.append(("phone", m.start(), m.end()))
        return spans

    return find


def node_finder():
    """A function from text and base spans to nodes [(start, end, shape, keys, label or None)]."""
    import re

    number = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[().-]{0,2}[0-9]|\)\x20[0-9]){6,}(?![0-9A-Za-z])").finditer
    digits = re.compile(r"[0-9]+").findall

    def shape(part: str) -> str:
        """Lengths of digit groups; the same with and without a plus, a country code apart."""
        groups = [len(g) for g in digits(part)]
        if part.startswith("+") and len(groups) > 1:
            groups = groups[1:]
        return "-".join(str(min(g, 20)) for g in groups[:6])

    def nodes(text, spans):
        found = []
        names: dict[str, None] = {}
        for kind, start, end in spans:
            part = text[start:end]
            if kind == "email":
                own = part.partition("@")[0].lower()
                names[own] = None
                found.append((start, end, "name", "n:" + own, LABELS.index(kind)))
            else:
                key = "".join(digits(part))[-KEY_DIGITS:]
                if kind == "ip":
                    key = "ip" + part
                found.append((start, end, shape(part), "d:" + key, LABELS.index(kind)))
        free = _outside([(s, e) for _, s, e in spans])
        for m in number(text):
            if free(m.start(), m.end()):
                key = "".join(digits(m[0]))[-KEY_DIGITS:]
                found.append((m.start(), m.end(), shape(m[0]), "d:" + key, None))
        # a name part that is a common word would be one everywhere; ask for a digit or a joint
        telling = [n for n in names if len(n) >= KEY_NAME and re.search(r"[0-9._]", n)]
        if telling:
            alike = name_index(telling)
            for m in run(text):
                for end in ends(m[0], m.start()):
                    hit = alike(text[m.start() : end].lower()) if free(m.start(), end) else None
                    if hit:
                        found.append((m.start(), end, "name", "n:" + hit, None))
                        break
        return sorted(found, key=lambda n: n[:2])

    run = re.compile(r"[\w.%+-]+").finditer

    def ends(word: str, start: int):
        """Where a name that starts with the word may end, longest first: at its end, or before a dot in it."""
        yield start + len(word)
        at = word.rfind(".")
        while at > 0:
            yield start + at
            at = word.rfind(".", 0, at)

    return nodes


def _outside(spans):
    """A function that tells whether [start, end) overlaps none of the spans, by bisection."""
    from bisect import bisect_left
    from itertools import accumulate

    spans = sorted(spans)
    starts = [s for s, _ in spans]
    furthest = list(accumulate((e for _, e in spans), max))

    def free(start, end):
        before = bisect_left(starts, end)
        return before == 0 or furthest[before - 1] <= start

    return free


def name_index(names: list[str]):
    """A function from a lower-cased word to the name it is, else a name it resembles, else None.

    A word resembles a name if, joints aside, they agree or differ in one letter, added, left out or
    replaced, while all digits agree: another digit is mostly another person. Words of over LONGEST characters are only
    compared as they are. Names without one letter are indexed, so a word costs in proportion to its
    own length, however many names there are.
    """
    import re

    plain = re.compile(r"[._%+-]+").sub
    no_digit = re.compile(r"[^0-9]+").sub
    whole = set(names)
    lengths = {len(n) for n in names}
    bare: dict[str, str] = {}
    for n in names:
        own = plain("", n)
        if len(own) >= KEY_NAME and len(n) <= LONGEST:
            bare.setdefault(own, n)
    sizes = {(len(b), no_digit("", b)) for b in bare}

    def shorter(word):
        return (word[:i] + word[i + 1 :] for i, c in enumerate(word) if not c.isdigit())

    index: dict[str, list[str]] = {}
    for b in bare:
        for v in {b, *shorter(b)}:
            index.setdefault(v, []).append(b)

    def one_letter(a, b):
        if len(a) > len(b):
            a, b = b, a
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    def alike(word):
        if len(word) in lengths and word in whole:
            return word
        if not KEY_NAME - 1 <= len(word) <= LONGEST:
            return None
        own = plain("", word)
        if own in bare:
            return bare[own]
        kept = no_digit("", own)
        if len(own) < KEY_NAME or not any((len(own) + d, kept) in sizes for d in (-1, 0, 1)):
            return None
        close = {b for v in (own, *shorter(own)) for b in index.get(v, ()) if no_digit("", b) == kept and one_letter(own, b)}
        return bare[min(close)] if close else None

    return alike


def _edges(nodes):
    """Skip edges (consecutive nodes of one key, and each to the first observed one) and chain edges."""
    by_key: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        by_key.setdefault(n[3], []).append(i)
    skip = set()
    for own in by_key.values():
        skip.update(zip(own, own[1:]))
        seen = next((i for i in own if nodes[i][4] is not None), None)
        if seen is not None:
            skip.update((min(i, seen), max(i, seen)) for i in own if i != seen)
    chain = {
        (i, i + 1)
        for i in range(len(nodes) - 1)
        if nodes[i + 1][0] - nodes[i][1] <= CHAIN and (i, i + 1) not in skip
    }
    return skip, chain


def learn_potentials(texts: DataFrame) -> dict[str, dict]:
    """Counts over all texts, as log potentials.

    Shapes that are rare share one potential, so the table that reaches the driver is bounded by the
    number of shapes (at most six groups of at most 20 digits, and in practice some hundred).
    """

    def make(batches) -> Iterator[dict]:
        from collections import Counter

        base, node = base_finder(), node_finder()
        counts: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                spans = base(text or "")
                if not spans:
                    continue
                own = node(text, spans)
                for n in own:
                    counts["shape", n[2], LABELS[4 if n[4] is None else n[4]]] += 1
                for kind, pairs in zip(("skip", "chain"), _edges(own)):
                    for i, j in pairs:
                        if own[i][4] is not None and own[j][4] is not None:
                            counts[kind, LABELS[own[i][4]], LABELS[own[j][4]]] += 1
        rows = [(*k, n) for k, n in counts.items()]
        yield dict(zip(("part", "a", "b", "n"), map(list, zip(*rows)))) if rows else {k: [] for k in ("part", "a", "b", "n")}

    counts = (
        map_batches(texts.select("text"), make, "part string, a string, b string, n bigint")
        .groupBy("part", "a", "b")
        .agg(F.sum("n").alias("n"))
        .where("part <> 'shape' or n >= 3")
    )
    table: dict = {"shape": {}, "skip": {}, "chain": {}}
    for r in counts.collect():
        table[r.part][r.a, r.b] = r.n
    return table


def _potentials(table):
    """Unary log potentials by shape; log potentials of skip and chain edges (label by label)."""
    import numpy as np

    n = len(LABELS)
    shapes: dict[str, object] = {}
    for (shape, label), count in table["shape"].items():
        shapes.setdefault(shape, np.ones(n))[LABELS.index(label)] += count
    # patterns never label an open node, so what they left open says little against the other labels
    unary = {}
    for shape, own in shapes.items():
        own = own.copy()
        own[-1] = max(1.0, min(own[-1], own[:-1].sum()))
        unary[shape] = np.log(own / own.sum())
    edges = []
    for kind in ("skip", "chain"):
        joint = np.ones((n, n)) + (np.eye(n) * 4 if kind == "skip" else 0)
        for (a, b), count in table[kind].items():
            i, j = LABELS.index(a), LABELS.index(b)
            joint[i, j] += count / 2
            joint[j, i] += count / 2
        joint /= joint.sum()
        share = joint.sum(axis=1)
        edges.append(np.clip(np.log(joint / np.outer(share, share)), -4.0, 4.0) * (1.0 if kind == "skip" else 0.25))
    return unary, np.log(np.full(n, 1.0 / n)), edges


def beliefs(nodes, unary, unknown, edges):
    """Posterior label probabilities of every node, by loopy sum-product messages."""
    import numpy as np

    n = len(LABELS)
    fields = np.empty((len(nodes), n))
    for i, node in enumerate(nodes):
        if node[4] is None:
            fields[i] = unary.get(node[2], unknown)
        else:
            fields[i] = -30.0
            fields[i, node[4]] = 0.0
    pairs = [(i, j, kind) for kind, own in enumerate(_edges(nodes)) for i, j in sorted(own)]
    # each pair as two directed edges, next to each other: the way back of edge k is k ^ 1
    directed = np.array([d for i, j, kind in pairs for d in ((i, j, kind), (j, i, kind))], np.int64).reshape(-1, 3)
    source, target, kind = directed.T
    table = np.stack(edges)
    messages = np.zeros((len(directed), n))

    def gathered():
        return fields + np.stack([np.bincount(target, messages[:, c], len(nodes)) for c in range(n)], axis=1)

    for _ in range(ROUNDS):
        sums = gathered()
        new = np.empty_like(messages)
        for at in range(0, len(directed), MESSAGES):
            part = np.arange(at, min(at + MESSAGES, len(directed)))
            rest = sums[source[part]] - messages[part ^ 1]
            own = np.logaddexp.reduce(rest[:, :, None] + table[kind[part]], axis=1)
            new[part] = own - np.logaddexp.reduce(own, axis=1)[:, None]
        change = np.abs(new - messages).max() if len(messages) else 0.0
        messages = 0.5 * messages + 0.5 * new
        if change < 1e-6:
            break
    total = gathered()
    total -= np.logaddexp.reduce(total, axis=1)[:, None]
    return np.exp(total)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): spans of personal data.

    Returns doc_id, n_email, n_ip, n_card, n_phone (spans of the patterns), base_spans and spans (all, with
    those that the field adds), as kind:start:end in code points, end exclusive, by kind and start, joined by
    commas. An added span overlaps no span of a pattern and has the last digits or, but for joints or one letter, the name of one. Texts without such spans
    get none. Null texts are empty; repeated rows and null ids are treated like any others; an empty table gives
    an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = learn_potentials(texts)

    def make(batches) -> Iterator[dict]:
        base, node = base_finder(), node_finder()
        potentials = _potentials(table)
        for b in batches:
            out = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_spans", "spans")}
            for text in b.column("text").to_pylist():
                spans = base(text or "")
                kinds = [s[0] for s in spans]
                for k in KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_spans"].append(joined(spans))
                added = _added(node(text, spans), potentials) if spans else []
                out["spans"].append(joined(spans + added))
            yield out | {"doc_id": b.column("doc_id")}

    return map_batches(
        texts,
        make,
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string",
    )


def _added(nodes, potentials) -> list[tuple[str, int, int]]:
    observed = {n[3] for n in nodes if n[4] is not None}
    if not any(n[4] is None and n[3] in observed for n in nodes):
        return []
    found = []
    for node, belief in zip(nodes, beliefs(nodes, *potentials)):
        best = int(belief.argmax())
        if node[4] is None and node[3] in observed and best < len(KINDS) and belief[best] >= SURE:
            found.append((KINDS[best], node[0], node[1]))
    return found
