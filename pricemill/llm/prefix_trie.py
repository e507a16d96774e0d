"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt to shards: a range of ids, and a band of BAND positions, so that neither many conversations nor a
very long one make a large shard. In a shard, each (position, turn) has a bitset of the conversations that have this turn there. A
depth-first walk intersects a parent's bitset with the postings of the next position: every result
that is not empty is a child, its bits are counted, and those whose conversation ends there are its end list. Bands further
down start from the prefixes that arrive there.

A node is known across shards by its depth and a hash of its turns, a sum of turn digest times power of a base modulo a prime. Sums of
parts add up, so the prefix at the start of a band is known without walking down to it. Parts of one node
from different shards are merged by that key.

Subtree totals need no walk over levels: each node counts for its smallest member, whose path leads through all of the
node's ancestors. A running sum up each conversation, added up per node, is the total of the subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.llm.common import map_batches, numbered
from pricemill.session import staged

#: Conversations of a shard, about, and positions of a band.
SHARD, BAND = 2048, 256
#: Node keys are pairs of sums modulo this prime with these bases.
PRIME, BASES = 2**61 - 1, (1_032_910_733_594_271_953, 748_113_906_551_873_377)
KEY = ["depth", "k1", "k2"]
#: Conversations borrow their first turns, at most three, from the one whose id is the next lower multiple.
FAMILY, BORROWED = 20, 4

_PART = (
    "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, words bigint, n bigint, "
    "members array<bigint>, ends array<bigint>, children array<struct<k1:bigint,k2:bigint>>"
)


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of the rows with an id; no text is shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length of the role keeps ("a", "bc") and ("ab", "c") apart
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), digest.alias("digest"), words.alias("words")
    )
    return rows.where("conv_id is not null")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Each turn's position in its conversation, from 1: (part, conv_id, at, digest, words, turns before the part).

    Rows are sorted over ranges of (conv_id, turn, digest), which also cuts a very long conversation.
    Positions are row numbers in a range plus the turns of the conversation in earlier ranges.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    rows = numbered(_turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order), "turns")
    return rows.select(F.shiftright("row_no", 33).alias("part"), "conv_id", "row_no", "digest", "words")


def _segments(rows: DataFrame) -> DataFrame:
    """Per range and conversation: first row number, turns in it and in earlier ranges."""
    own = rows.groupBy("part", "conv_id").agg(F.min("row_no").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def borrowed_turns(conv_id: Column) -> Column:
    """How many first turns come from the head of the family."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(BORROWED))


def _conversations(segments: DataFrame) -> DataFrame:
    """(conv_id, base, skipped, head, length, block): `skipped` own turns give way to `head` turns of the base."""
    own = staged(segments.groupBy("conv_id").agg(F.sum("n").alias("turns")), "conversations")
    base = F.col("conv_id") - F.col("conv_id") % F.lit(FAMILY)
    skipped = F.when(base == F.col("conv_id"), F.lit(0)).otherwise(borrowed_turns(F.col("conv_id")))
    heads = own.select(F.col("conv_id").alias("base"), F.least("turns", F.lit(BORROWED)).alias("base_turns"))
    rows = own.select("conv_id", base.alias("base"), skipped.alias("skipped"), "turns").join(heads, "base", "left")
    head = F.least("skipped", F.coalesce("base_turns", F.lit(0)))
    rows = rows.select(
        "conv_id", "base", "skipped", head.alias("head"),
        (F.greatest(F.col("turns") - F.col("skipped"), F.lit(0)) + head).alias("length"),
    )
    spark = own.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // SHARD))
    return staged(
        rows.repartitionByRange(blocks, "conv_id").withColumn("block", F.spark_partition_id()), "conversation-blocks"
    )


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, length, depth, t1, t2, words) per turn of the rebuilt conversations, and depth 0 for each."""
    rows = placed_turns(conversations)
    segments = staged(_segments(rows), "segments")
    convs = _conversations(segments)
    place = (F.col("row_no") - F.col("first") + F.col("before") + 1).alias("place")
    placed = rows.join(segments, ["part", "conv_id"]).select("part", "conv_id", place, "digest", "words")
    first = placed.where(f"conv_id % {FAMILY} = 0 and place < {BORROWED}")
    # by range and conversation, so that a long conversation is many keys
    about = segments.select("part", "conv_id").join(convs, "conv_id")
    own = placed.join(about, ["part", "conv_id"]).where("place > skipped").select(
        "conv_id", "block", "length", (F.col("place") - F.col("skipped") + F.col("head")).alias("depth"), "digest", "words"
    )
    lent = convs.where("head > 0").join(first.select(F.col("conv_id").alias("base"), "place", "digest", "words"), "base")
    lent = lent.where("place <= head").select(
        "conv_id", "block", "length", F.col("place").cast("long").alias("depth"), "digest", "words"
    )
    number = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    turns = own.unionByName(lent).select(
        "conv_id", "block", "length", "depth", number(1).alias("t1"), number(16).alias("t2"), "words"
    )
    zero = F.lit(0).cast("long")
    tops = convs.select("conv_id", "block", "length", *(zero.alias(c) for c in ("depth", "t1", "t2", "words")))
    return turns.unionByName(tops)


def _band(depth: str = "depth") -> Column:
    return F.expr(f"{depth} div {BAND}")


def _band_starts(turns: DataFrame) -> DataFrame:
    """(conv_id, band, s1, s2): key of the prefix that arrives at the band, for all bands but the first."""

    def make(batches) -> Iterator[dict]:
        for b in batches:
            depths = b.column("depth").to_pylist()
            found = [
                [t * pow(base, d, PRIME) % PRIME for t, d in zip(b.column(name).to_pylist(), depths)]
                for name, base in zip(("t1", "t2"), BASES)
            ]
            yield {"conv_id": b.column("conv_id"), "band": b.column("band"), "h1": found[0], "h2": found[1]}

    long_ones = turns.where(_band("length") > _band()).select("conv_id", _band().alias("band"), "depth", "t1", "t2")
    hashed = map_batches(long_ones, make, "conv_id bigint, band bigint, h1 bigint, h2 bigint", 8192)
    wide = "decimal(38,0)"
    totals = hashed.groupBy("conv_id", "band").agg(*(F.sum(F.col(c).cast(wide)).alias(c) for c in ("h1", "h2")))
    upto = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda c: F.pmod(F.sum(F.col(c) % F.lit(PRIME)).over(upto), F.lit(PRIME)).cast("long")
    return totals.select("conv_id", (F.col("band") + 1).alias("band"), start("h1").alias("s1"), start("h2").alias("s2"))


def walk(convs: list[int], rows: dict[int, list[tuple]], starts: list[tuple[int, int]], first: int) -> Iterator[tuple]:
    """Parts of all nodes of one shard.

    convs: ids, ascending; bit i of a bitset is the i-th. rows[depth]: (i, (t1, t2), words, last) of the turns
    there. starts[i]: key of the prefix above `first`, the shard's first depth.
    """
    postings: dict[int, dict[tuple, int]] = {}
    turn_at: dict[int, dict[int, tuple]] = {}
    ends: dict[int, int] = {}
    words: dict[tuple, int] = {}
    for depth, own in rows.items():
        index, turns, ending = {}, {}, 0
        for i, turn, n, last in own:
            index[turn] = index.get(turn, 0) | 1 << i
            turns[i] = turn
            words[turn] = n
            ending |= last << i
        postings[depth], turn_at[depth], ends[depth] = index, turns, ending

    def bits(bitset: int) -> list[int]:
        found = []
        while bitset:
            low = bitset & -bitset
            found.append(low.bit_length() - 1)
            bitset ^= low
        return found

    def children(depth: int, members: int, key: tuple[int, int]):
        """Children at `depth` of a node above it: key and bitset of each."""
        here = turn_at.get(depth, {})
        # only turns that a member has can intersect
        for turn in dict.fromkeys(here[i] for i in bits(members) if i in here):
            step = [pow(base, depth, PRIME) for base in BASES]
            child = tuple((k + t * s) % PRIME for k, t, s in zip(key, turn, step))
            yield child, members & postings[depth][turn], turn

    arrivals: dict[tuple, int] = {}
    for i in bits((1 << len(convs)) - 1):
        arrivals[starts[i]] = arrivals.get(starts[i], 0) | 1 << i
    stack = []
    for key, members in arrivals.items():
        own = list(children(first, members, key))
        if first:
            # the parent itself belongs to the band above; here are only more children of it
            yield first - 1, *key, None, None, None, 0, [], [], [c for c, _, _ in own]
        stack += [(first, c, key, m, t) for c, m, t in own]
    while stack:
        depth, key, parent, members, turn = stack.pop()
        own = list(children(depth + 1, members, key))
        ending = [convs[i] for i in bits(members & ends[depth])]
        up = parent if depth else (None, None)
        yield (
            depth, *key, *up, words[turn], members.bit_count(), [convs[i] for i in bits(members)], ending,
            [c for c, _, _ in own],
        )
        stack += [(depth + 1, c, key, m, t) for c, m, t in own]


def _shard_parts(turns: DataFrame, starts: DataFrame) -> DataFrame:
    """Parts of nodes, by shard: key, parent's key, words, count, members, end list and children."""

    def shards(batches):
        held, key = [], None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("block", "band", "conv_id", "depth", "t1", "t2", "words", "length", "s1", "s2"))):
                if row[:2] != key:
                    if held:
                        yield key, held
                    held, key = [], row[:2]
                held.append(row[2:])
        if held:
            yield key, held

    names = [f.split()[0] for f in _PART.replace("k1:bigint,k2:bigint", "").split(", ")]

    def make(batches) -> Iterator[dict]:
        for (_, band), held in shards(batches):
            convs = sorted({r[0] for r in held})
            number = {c: i for i, c in enumerate(convs)}
            rows: dict[int, list] = {}
            starts = [(0, 0)] * len(convs)
            for conv, depth, t1, t2, words, length, s1, s2 in held:
                i = number[conv]
                starts[i] = (s1, s2)
                rows.setdefault(depth, []).append((i, (t1, t2), words, int(depth == length)))
            out = []
            for part in walk(convs, rows, starts, band * BAND):
                out.append(part)
                if len(out) == 4096:
                    yield _columns(names, out)
                    out = []
            if out:
                yield _columns(names, out)

    rows = turns.withColumn("band", _band()).join(starts, ["conv_id", "band"], "left")
    rows = rows.select(
        "block", "band", "conv_id", "depth", "t1", "t2", "words", "length",
        F.coalesce("s1", F.lit(0).cast("long")).alias("s1"), F.coalesce("s2", F.lit(0).cast("long")).alias("s2"),
    )
    dealt = rows.repartition("block", "band").sortWithinPartitions("block", "band", "conv_id", "depth")
    return map_batches(dealt, make, _PART, 8192)


def _columns(names: list[str], rows: list[tuple]) -> dict:
    columns = dict(zip(names, map(list, zip(*rows))))
    columns["children"] = [[{"k1": a, "k2": b} for a, b in c] for c in columns["children"]]
    return columns


def _end_hashes(parts: DataFrame) -> DataFrame:
    """SHA-256 of each node's comma-joined end list; shards follow each other in order of their ids."""

    def make(batches) -> Iterator[dict]:
        key, state = None, None
        for b in batches:
            out = []
            for *own, ends in zip(*(b.column(c).to_pylist() for c in (*KEY, "ends"))):
                text = ",".join(map(str, ends))
                if own == key:
                    state.update(("," + text).encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(text.encode())
            yield dict(zip((*KEY, "ends_sha256"), map(list, zip(*out)))) if out else {c: [] for c in (*KEY, "ends_sha256")}
        if key is not None:
            yield dict(zip((*KEY, "ends_sha256"), ([v] for v in (*key, state.hexdigest()))))

    rows = parts.where(F.size("ends") > 0).select(*KEY, "ends", F.element_at("ends", 1).alias("first"))
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ends")
    return map_batches(rows, make, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string", 1024)


def _subtree_totals(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves and saved words of each node's subtree: (key, n_leaves, saved_tokens).

    `nodes` has conv_id (smallest member), saves and leaf. A node counts once, for its smallest member: at the node itself and at
    all depths above it on that conversation's path, bands summed up one by one.
    """
    path = parts.select(*KEY, F.explode("members").alias("conv_id"), _band().alias("band"))
    owned = nodes.select("conv_id", "depth", "saves", "leaf")
    rows = path.join(owned, ["conv_id", "depth"], "left")
    up = Window.partitionBy("conv_id", "band").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.coalesce(F.sum(c).over(up), F.lit(0)).alias(c) for c in ("saves", "leaf")]
    bands = owned.groupBy("conv_id", _band().alias("band")).agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    # every band above gets what lies in the bands below it
    below = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    reached = path.where(f"depth % {BAND} = 0").select("conv_id", "band").join(bands, ["conv_id", "band"], "left")
    later = reached.select(
        "conv_id", "band", F.sum("saves").over(below).alias("saves_below"), F.sum("leaf").over(below).alias("leaf_below")
    ).where("leaf_below > 0 or saves_below > 0")
    rows = rows.select("conv_id", "band", *KEY, *sums).join(staged(later, "bands-below"), ["conv_id", "band"], "left")
    return rows.groupBy(*KEY).agg(
        F.sum(F.col("leaf") + F.coalesce("leaf_below", F.lit(0))).alias("n_leaves"),
        F.sum(F.col("saves") + F.coalesce("saves_below", F.lit(0))).alias("saved_tokens"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations of `conversations` (conv_id, turn, role, text).

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Turns are ordered by turn, nulls first, and where turns are equal by the SHA-256 of role
    and text; repeated rows are repeated turns. A null role or text is an empty one. Rows without conv_id belong to no
    conversation and are left out. The family of a negative id is the next multiple towards zero. An empty table
    gives no rows, not even a root. Other columns are ignored, whatever their names. Texts are hashed whole.
    """
    turns = staged(rebuilt_turns(conversations), "rebuilt")
    parts = staged(_shard_parts(turns, staged(_band_starts(turns), "band-starts")), "node-parts")
    nodes = staged(
        parts.groupBy(*KEY).agg(
            F.min(F.element_at(F.when(F.size("members") > 0, F.col("members")), 1)).alias("conv_id"),
            F.sum("n").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("words").alias("words"),
        ),
        "nodes",
    )
    counts = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children")
    )
    counted = staged(
        nodes.join(counts, KEY, "left").select(
            *KEY, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saves"),
            F.col("n_children").isNull().cast("long").alias("leaf"),
        ),
        "counted-nodes",
    )
    # a node with very many children has them in many shards: its row is sent to its parts, not to each child
    parents = (
        parts.select(*KEY, "children").join(nodes.select(*KEY, "conv_id"), KEY)
        .select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.explode("children").alias("c"))
        .groupBy("depth", F.col("c.k1").alias("k1"), F.col("c.k2").alias("k2")).agg(F.min("parent_conv_id").alias("parent_conv_id"))
    )
    found = (
        counted.join(_subtree_totals(parts, counted), KEY)
        .join(parents, KEY, "left")
        .join(_end_hashes(parts), KEY, "left")
    )
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )
