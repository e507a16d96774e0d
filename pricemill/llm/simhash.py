"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most
three bits, one of the segments differs in at most one bit. So each segment is indexed under its 32
variants with one bit wiped out: two such segments always share a variant. Variants are matched by
equality, and the pairs found are verified on all 64 bits.

Equal fingerprints are one node from the start. A variant that few nodes share is compared
in place, and only verified pairs leave the row. A variant that many nodes share (a large family of
near copies) would need all pairs of its members. Its members are linked through centres instead: a and b
differ in at most three bits exactly if some centre c differs from one of them in at most one bit and
from the other in at most two. All that meet in a centre that somebody is within one bit of, are
connected, so one link to a representative each is enough: the work is in proportion to the number of
nodes, whatever the size of the family.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import among, map_batches, marked, numbered
from pricemill.llm.components import components
from pricemill.llm.rolling import BASES, RunHasher, item_hasher
from pricemill.session import discard, staged

BITS = 64
MAX_DIFFERENT = 3
SEGMENT = 32
#: Nodes of a variant that are compared in place; variants with more take the centres.
#: At this size a pair list per member costs as much as its centres.
FEW = 64
SEED = 42


def shingle_hashes(words: list[bytes], width: int):
    """XXH64 (seed 42) of each run of `width` words joined by a space; of all words if there are fewer."""
    import numpy as np
    import xxhash

    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def majority_bits(hashes) -> int:
    """64 bits: each is set if it is set in more than half of the hashes; 0 for none."""
    import numpy as np

    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros(64, np.int64)
    # 64 bytes a hash are unpacked at a time for so many hashes, however long the text is
    for at in range(0, n, 255 * 256):
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        # eight counters of one byte each are added at a time, 255 rows at most before they could overflow
        lanes = bits.view(np.uint64)
        for i in range(0, len(part), 255):
            counts += lanes[i : i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    packed = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(packed.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(row_no, doc_id, fingerprint long) per row of `docs`; needs row_no, doc_id, text.

    A-Z count as a-z. Texts without words, null among them, have fingerprint zero.
    """

    def make(batches) -> Iterator[dict]:
        import numpy as np

        for b in batches:
            texts = b.column("text").to_pylist()
            prints = np.array(
                [
                    majority_bits(shingle_hashes((t or "").encode("utf-8", "surrogatepass").lower().split(), width))
                    for t in texts
                ],
                np.uint64,
            ).view(np.int64)
            yield {"row_no": b.column("row_no"), "doc_id": b.column("doc_id"), "fingerprint": prints}

    narrow = docs.select("row_no", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(narrow, make, "row_no bigint, doc_id bigint, fingerprint bigint")


def _variants(fp: str = "fp") -> Column:
    """The 64 variants of a fingerprint: segment with one bit wiped out, with its place above."""
    out = []
    for part in range(BITS // SEGMENT):
        segment = F.shiftrightunsigned(F.col(fp), part * SEGMENT).bitwiseAND(F.lit(2**SEGMENT - 1))
        for bit in range(SEGMENT):
            place = (part * SEGMENT + bit) << SEGMENT
            out.append(segment.bitwiseAND(F.lit((2**SEGMENT - 1) ^ (1 << bit))).bitwiseOR(F.lit(place)))
    return F.array(*out)


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _named_here(a: Column, b: Column, crowded: Column, place: Column) -> Column:
    """Whether `place` is the first variant that a and b share and that is not crowded.

    So a pair is named once and not under up to 64 variants. `crowded` has a bit for each crowded variant of a;
    a shared variant is shared with its whole crowd, so a's bits are b's as well.
    """

    def shared(segment: Column) -> Column:
        alike = F.when(segment == 0, F.lit(2**SEGMENT - 1))
        return alike.when(F.bit_count(segment) == 1, segment).otherwise(F.lit(0))

    differ = a.bitwiseXOR(b)
    low, high = differ.bitwiseAND(F.lit(2**SEGMENT - 1)), F.shiftrightunsigned(differ, SEGMENT)
    both = shared(low).bitwiseOR(F.call_function("shiftleft", shared(high), F.lit(SEGMENT)))
    before = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), place.cast("int")))
    return both.bitwiseAND(F.bitwise_not(crowded)).bitwiseAND(before) == 0


def links(nodes: DataFrame, few: int = FEW, written: list | None = None) -> DataFrame:
    """Edges (which, a, b) that connect exactly what distances of at most three bits connect.

    `nodes` has one row per kind of fingerprint `which` (below 256) and distinct fingerprint `fp`; only
    fingerprints of one kind are compared. Edges are pairs within three bits, or, for
    variants shared by more than `few` nodes, pairs that a chain of such steps connects.
    Joins on variants and centres are merge joins: Spark does not count the rows that an explode adds, so
    it would take 64 or 2,081 rows per node for the size of the nodes and broadcast them. Frames that the result
    reads are added to `written`, for the caller to discard when it has read it.
    """
    kind = F.shiftleft(F.col("which").cast("long"), SEGMENT + 6)
    keyed = nodes.select("which", "fp", F.explode(_variants()).alias("variant")).select(
        "which", "fp", F.col("variant").bitwiseOR(kind).alias("key")
    )
    shared = staged(
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"),
        "variants",
    )
    of_key = F.shiftrightunsigned("key", SEGMENT + 6).cast("int").alias("which")
    pairs = shared.where((F.col("n") == 2) & (_distance(F.col("a"), F.col("b")) <= MAX_DIFFERENT)).select(of_key, "a", "b")
    members = keyed.hint("merge").join(shared.where("n > 2").select("key", "n"), "key")
    place = F.shiftrightunsigned("key", SEGMENT).bitwiseAND(F.lit(BITS - 1))
    own_bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))
    many = staged(
        members.where(F.col("n") > few).groupBy("which", "fp").agg(F.bit_or(own_bit).alias("crowded")), "crowded"
    )
    if written is not None:
        written += [shared, many]
    groups = (
        members.where(F.col("n") <= few)
        .join(many.hint("merge"), ["which", "fp"], "left")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("fp", F.coalesce("crowded", F.lit(0).cast("long")).alias("crowded")))).alias("fps"))
    )
    near = F.flatten(
        F.transform(
            F.col("fps"),
            lambda x, i: F.transform(
                F.filter(
                    F.slice(F.col("fps"), i + 2, F.size("fps")),
                    lambda y: (_distance(x["fp"], y["fp"]) <= MAX_DIFFERENT)
                    & _named_here(x["fp"], y["fp"], x["crowded"], place),
                ),
                lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b")),
            ),
        )
    )
    few_pairs = groups.select(of_key, F.explode(near).alias("p")).select("which", "p.a", "p.b")
    found = pairs.union(few_pairs)
    if not many.isEmpty():
        found = found.union(_centre_links(many.select("which", "fp")))
    return found.distinct()


def _centre_links(nodes: DataFrame) -> DataFrame:
    """Links of nodes through centres within one bit of one and two bits of the other."""

    def around(radius: int) -> DataFrame:
        # no bit (-1), or bit i alone, or bits i < j
        first = nodes.select("which", "fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("i"))
        last = F.when(F.col("i") >= 0, F.lit(BITS - 1)).otherwise(F.col("i")) if radius == 2 else F.col("i")
        both = first.select("which", "fp", "i", F.explode(F.sequence(F.col("i"), last)).alias("j"))
        one = F.expr("CASE WHEN i >= 0 THEN shiftleft(1L, i) ELSE 0L END")
        other = F.expr("CASE WHEN j > i THEN shiftleft(1L, j) ELSE 0L END")
        return both.select("which", "fp", F.col("fp").bitwiseXOR(one).bitwiseXOR(other).alias("centre"))

    near = around(1).groupBy("which", "centre").agg(F.min("fp").alias("a"))
    return around(2).hint("merge").join(near, ["which", "centre"]).where("fp <> a").select("which", "a", F.col("fp").alias("b"))


def fingerprint_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """Per row of `docs` (doc_id, text): its fingerprint and its group of near duplicates.

    Returns doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that chains of fingerprints
    with at most three different bits reach (null if none has an id). Texts without words share fingerprint
    zero, which is linked like any other. Repeated rows and rows with null ids are kept as they are; an
    empty table gives an empty result.
    """
    prints = staged(fingerprints(_with_row(docs), width), "fingerprints")
    nodes = staged(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "nodes")
    return (
        prints.join(_node_groups(nodes), F.col("fingerprint") == F.col("fp"))
        .select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
    )


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("row_no", F.monotonically_increasing_id())


def _node_groups(nodes: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest doc_id of the component of each node."""
    labels = components(links(nodes.select(F.lit(0).alias("which"), "fp")).select("a", "b"))
    grouped = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = grouped.withColumn("label", F.coalesce("label", "fp"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    return staged(grouped.join(least, "label").select("fp", "component_id"), "node-groups")


# Near copies by words: the same index over several fingerprints of single words, verified on texts.

#: Fingerprints per document, and the verified similarity of sets of shingles of so many words.
FINGERPRINTS, SIMILAR, SHINGLE = 4, 0.8, 5


def _mixed(values):
    import numpy as np

    for _ in range(2):
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _word_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc, prints): independent fingerprints of the set of words of each text that has words.

    Single words change less than shingles when a text is edited: at a shingle similarity of 0.8, about every
    second pair is within three bits in one fingerprint, and nine of ten in one of four.
    """

    def make(batches) -> Iterator[dict]:
        import numpy as np

        hashes = item_hasher(SEED)
        salts = [np.uint64(s * 0x632BE59BD9B4E019 % 2**64) for s in range(1, FINGERPRINTS + 1)]
        for b in batches:
            out = {"doc": [], "prints": []}
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                words = np.unique(hashes((text or "").encode("utf-8", "surrogatepass").lower().split()))
                if len(words):
                    own = [majority_bits(_mixed(words + salt)) for salt in salts]
                    out["doc"].append(doc)
                    out["prints"].append(np.array(own, np.uint64).view(np.int64))
            yield out

    return map_batches(docs, make, "doc bigint, prints array<bigint>")


def _squeezed(docs: DataFrame) -> DataFrame:
    """(doc, words): lower-cased words, compressed for the way to their candidates."""

    def make(batches) -> Iterator[dict]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = b.column("text").to_pylist()
            yield {
                "doc": b.column("doc"),
                "words": [squeeze(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())) for t in texts],
            }

    return map_batches(docs, make, "doc bigint, words binary")


def _shingle_hasher():
    """A function from the words of a text to the sorted hashes of its set of shingles."""
    import numpy as np

    hashes, run = item_hasher(SEED), RunHasher(BASES[0])

    def shingles(words: list[bytes]):
        width = min(SHINGLE, len(words))
        if width == 0:
            return np.empty(0, np.uint64)
        return np.unique(run(hashes(words), width, np.arange(len(words) - width + 1)))

    return shingles


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least SIMILAR."""

    def make(batches) -> Iterator[dict]:
        import numpy as np
        import zstandard

        shingles, expand = _shingle_hasher(), zstandard.ZstdDecompressor().decompress

        for b in batches:
            out = {"a": [], "b": []}
            last, left = None, None
            for a, c, own, other in zip(*(b.column(k).to_pylist() for k in ("a", "b", "words_a", "words_b"))):
                if own != last:
                    last, left = own, shingles(expand(own).split())
                right = shingles(expand(other).split())
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both >= SIMILAR * (len(left) + len(right) - both):
                    out["a"].append(a)
                    out["b"].append(c)
            yield out

    a = texts.select(F.col("doc").alias("a"), F.col("words").alias("words_a"))
    b = texts.select(F.col("doc").alias("b"), F.col("words").alias("words_b"))
    return map_batches(pairs.join(a, "a").join(b, "b"), make, "a bigint, b bigint", rows=128)


def _shingles(docs: DataFrame, smallest: bool) -> DataFrame:
    """(doc, n, key): the hashes of the n shingles of each text of `docs` (doc, text), ascending.

    With `smallest` only the first n - ceil(0.8 n) + m of them: sets that are SIMILAR have at least ceil(0.8 n) in
    common, so their first ones share at least m = n // 16 + 1, whatever the order is.
    """

    def make(batches) -> Iterator[dict]:
        import numpy as np

        shingles = _shingle_hasher()
        for b in batches:
            # one text at a time: a batch of long texts would be large
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                own = shingles((text or "").encode("utf-8", "surrogatepass").lower().split())
                n = len(own)
                if smallest:
                    own = own[: n - (4 * n + 4) // 5 + n // 16 + 1]
                yield {
                    "doc": np.full(len(own), doc, np.int64),
                    "n": np.full(len(own), n, np.int32),
                    "key": own.view(np.int64),
                }

    return map_batches(docs, make, "doc bigint, n int, key bigint")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` (doc, ...) with the label of each document, itself if it has none."""
    own = labels.select(F.col("node").alias("doc"), F.col("label").alias("label_"))
    return rows.join(own, "doc", "left").withColumn("label", F.coalesce("label_", "doc")).drop("label_")


def _unlinked_pairs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): all pairs of documents of different labels that may be SIMILAR; none that is, is missing.

    A prefix filter in two rounds. The first takes each set's smallest hashes and leaves the documents that share as many of
    them with documents of other labels as SIMILAR sets must. The second counts, among these, the documents of each shingle, drops what only
    one label has (documents with more than a fifth of such shingles have no partner) and
    matches the rarest of the rest. Where a shingle is the first of two sets in this order that both have, what
    follows it bounds their overlap, so that pairs are only named under shingles near the front. In a shingle
    of many documents, those outside its most frequent label are matched with the others, not all with all.
    """
    small = staged(_shingles(texts, True), "small-shingles")
    often = small.groupBy("key").count().where("count > 1").select("key")
    met = staged(_labelled(small.hint("merge").join(often, "key", "left_semi"), labels), "met-shingles")
    differ = F.min("label") != F.max("label")
    across = staged(met.groupBy("key").agg(differ.alias("across")).where("across").select("key"), "met-keys")
    enough_met = F.count("*") > F.floor(F.col("n") / 16)
    met_docs = met.join(across, "key", "left_semi").groupBy("doc", "label", "n").agg(enough_met.alias("enough"))
    met_docs = staged(met_docs.where("enough").select("doc", "label"), "met-documents")
    discard(small, met, across)
    rows = staged(_shingles(among(texts, "doc", met_docs).join(met_docs, "doc", "left_semi"), False).join(met_docs, "doc"), "met-sets")
    counts = rows.groupBy("key").agg(F.count("*").alias("docs"), differ.alias("across")).where("across")
    counts = staged(counts.select("key", "docs"), "met-counts")
    in_order = F.slice(
        F.sort_array(F.collect_list(F.struct("docs", "key"))),
        1,
        F.greatest(F.count("*").cast("int") - F.ceil(F.first("n") * 4 / 5).cast("int") + 1, F.lit(0)),
    )
    rare = (
        rows.hint("merge").join(counts, "key")
        .groupBy("doc", "label", "n")
        .agg(in_order.alias("front"), (F.col("n") - F.count("*")).alias("alone"))
        .select("doc", "label", "n", "alone", F.posexplode("front").alias("at", "front"))
        .select("doc", "label", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), F.col("front.key").alias("key"))
    )
    rare = staged(rare, "rare-shingles")
    discard(rows, counts)
    largest = (
        rare.groupBy("key", "label").count()
        .groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.count("*").alias("labels"))
        .where("labels > 1").select("key", "largest")
    )
    largest = staged(largest, "rare-keys")
    others = staged(rare.hint("merge").join(largest, "key").where("label <> largest"), "rare-others")
    x = others.select("key", "largest", *(F.col(c).alias(f"{c}_x") for c in ("doc", "label", "n", "rest")))
    y = rare.select("key", *(F.col(c).alias(f"{c}_y") for c in ("doc", "label", "n", "rest")))
    once = (F.col("label_y") == F.col("largest")) | (F.col("doc_x") < F.col("doc_y"))
    # 0.8 of the union is 4/9 of both sizes together
    enough = 9 * F.least("rest_x", "rest_y") >= 4 * (F.col("n_x") + F.col("n_y"))
    pairs = x.hint("merge").join(y, "key").where((F.col("label_x") != F.col("label_y")) & once & enough)
    pairs = pairs.select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b")).distinct()
    pairs = staged(pairs, "unlinked-pairs")
    discard(rare, largest, others, met_docs)
    return pairs


def _near_groups(texts: DataFrame) -> DataFrame:
    """(node, label): of each row of `texts` (doc, text) in a group of near copies, the smallest doc of the group.

    A pair is a link if its shingle sets (SHINGLE words, A-Z as a-z) are at least SIMILAR alike.
    The fingerprints find most links at little cost: candidates are pairs
    within three bits in one of FINGERPRINTS, and documents of one fingerprint are compared with its smallest
    doc. First every document is compared with its smallest candidate; further pairs are compared only if they
    are not yet in one group, so a large family costs in proportion to its members. What they miss, pairs that
    lie further apart or were only compared through another document, is then found by an equality join on
    rare shingles among documents that are not in one group yet, so every link counts.
    """
    prints = staged(
        _word_fingerprints(texts).select("doc", F.posexplode("prints").alias("which", "fp")), "word-fingerprints"
    )
    nodes = staged(prints.groupBy("which", "fp").agg(F.min("doc").alias("doc")), "word-nodes")
    # one kind after the other, so that the 64 variants of only one lie on disk
    edges = None
    for kind in range(FINGERPRINTS):
        own = links(nodes.where(F.col("which") == kind).select("which", "fp"), written=(temporary := []))
        own = staged(own, "word-links")
        discard(*temporary)
        edges = own if edges is None else edges.unionByName(own)
    same = prints.join(nodes.withColumnRenamed("doc", "least"), ["which", "fp"]).select(
        F.col("least").alias("a"), F.col("doc").alias("b")
    )
    first = nodes.select("which", F.col("fp").alias("a"), F.col("doc").alias("x"))
    second = nodes.select("which", F.col("fp").alias("b"), F.col("doc").alias("y"))
    linked = edges.join(first, ["which", "a"]).join(second, ["which", "b"]).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    )
    pairs = staged(same.union(linked).where("a <> b").distinct(), "candidate-pairs")
    involved = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    words = staged(_squeezed(among(texts, "doc", involved)).join(involved, "doc"), "candidate-texts")

    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    sure = staged(_verified(nearest, words), "verified")
    discard(prints, nodes)
    labels = components(sure)
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    open_pairs = pairs.join(nearest, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left").where(apart)
    more = staged(_verified(open_pairs.select("a", "b"), words), "verified-too")
    found = labels if more.isEmpty() else components(sure.union(more))

    discard(words, pairs)
    left = _unlinked_pairs(texts, found)
    if not left.isEmpty():
        involved = left.select(F.col("a").alias("doc")).union(left.select("b")).distinct()
        last = staged(_verified(left, staged(_squeezed(among(texts, "doc", involved).join(involved, "doc", "left_semi")), "unlinked-texts")), "verified-last")
        if not last.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).union(last))
    return found


def _near_rows(docs: DataFrame) -> DataFrame:
    """(row, id, label) of the rows of `docs` (row_no, doc_id, text) in a group; label is the same in a group."""
    rows = docs.where("doc_id is not null")
    texts = rows.select(F.col("row_no").alias("doc"), F.col("text").cast("string").alias("text"))
    ids = rows.select(F.col("row_no").alias("row"), F.col("doc_id").cast("long").alias("id"))
    groups = _near_groups(texts).withColumnRenamed("node", "row")
    return staged(ids.join(groups, "row"), "near-rows")


def near_copies(docs: DataFrame) -> DataFrame:
    """Groups of near copies among `docs` (doc_id, text): (doc_id, component_id) of the rows in one.

    Links are those of `_near_groups`; component_id is the smallest doc_id that they reach. Texts without words
    and rows without an id are in no group; rows that repeat an id are judged one by one. An empty table has no
    groups. Other columns are ignored, whatever their names.
    """
    rows = _near_rows(numbered(docs.select("doc_id", "text"), "near-texts"))
    least = rows.groupBy("label").agg(F.min("id").alias("component_id"))
    return rows.join(least, "label").select(F.col("id").alias("doc_id"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without those that have a near copy with a smaller doc_id in their group.

    Of rows with one id in a group one is kept. Texts without words, null ones among them, and rows without an id
    are in no group and stay. An empty table gives no rows. Columns may have any names.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = numbered(whole, "near-texts")
    rows = _near_rows(own.select("row_no", "row.doc_id", "row.text"))
    keep = rows.groupBy("label").agg(F.min_by("row", F.struct("id", "row")).alias("row"))
    gone = staged(rows.select("row").subtract(keep.select("row")).withColumnRenamed("row", "row_no"), "near-copies")
    # most rows are certainly not gone; only the others are matched
    seen = marked(own, F.col("row_no"), gone, "row_no")
    rest = seen.where("maybe").join(gone, "row_no", "left_anti")
    return seen.where("not maybe").select("row").unionByName(rest.select("row")).select("row.*")
