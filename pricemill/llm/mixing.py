"""Mixing sources to target weights by pivotal rounding of copy numbers.

A document of a source whose target is p times its words should be taken p times on average. The
whole part of p is taken for certain. The fractions are rounded by the pivotal method, weighted by
words: two fractional documents exchange mass, so that the words taken by both stay the same,
until one of them is settled; which one gains is drawn so that every document keeps its expected
number of copies. A block of documents leaves one fractional document, blocks meet in a tree, and
one document per source is left at its root, where it is rounded to the nearer side. So the words taken
from a source differ from its target by at most half a document. Inside a block longer documents come
first, so that the one left over is usually not among the longest.

All of it is DataFrame work: the exchange inside a block is a fold over a bounded array, each level of the tree is
one grouping of what the level below has left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.llm.common import SPACE, text_or_empty
from pricemill.session import staged

#: Documents of a block, on average. A fold over a block copies short arrays only.
BLOCK = 128
_UNIT = 2.0**53
_DOC = "struct<doc_id:bigint,copy:bigint,size:bigint>"


def word_count(text: str = "text") -> Column:
    """Number of runs of non-blank characters; a null text has none."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0
) -> DataFrame:
    """Per source: source_size, weight and target words.

    Sources in code-point order, null last, get `weights` in turn. They divide `share` of all words by
    weight, none above `limit` times its own words; what is cut off goes to the others by weight until
    none is above. That point has a closed form: with sources ordered by limit / weight, the first k are
    at their limit, the others at weight times one level, and the level is that of the first k that
    leaves nobody above, which is the largest of all levels that leave nobody above. The table has one row per source of the mix.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = per_source.withColumn("weight", chosen).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    ratio = F.col("most") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    leveled = table.withColumn("level", F.when(level <= ratio, level))
    found = leveled.withColumn("level", F.max("level").over(everything))
    return found.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("level").isNull(), F.col("most"))
        .otherwise(F.least(F.col("most"), F.col("weight") * F.col("level")))
        .alias("target"),
    )


def _unit(*columns: Column | str) -> Column:
    """A number in [0, 1) that only depends on the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(_UNIT)


def _exchange(held: Column, new: Column, luck: Column) -> Column:
    """One pivotal step: the held fractional document meets a new one; arrays of settled documents grow.

    d words go from one to the other at most: `up` is what the held one can gain and the new one
    give, `down` the reverse. The held one gains with probability down / (up + down).
    """
    hs, hx = held["size"].cast("double"), held["x"]
    ns, nx = new["size"].cast("double"), new["x"]
    up = F.least(hs * (1 - hx), ns * nx)
    down = F.least(hs * hx, ns * (1 - nx))
    gains = luck * (up + down) < down
    moved = F.when(gains, up).otherwise(-down)
    # the side that reached its bound is set to it exactly
    held_full = gains & (hs * (1 - hx) <= ns * nx)
    new_empty = gains & (ns * nx <= hs * (1 - hx))
    held_empty = ~gains & (hs * hx <= ns * (1 - nx))
    new_full = ~gains & (ns * (1 - nx) <= hs * hx)
    one, zero = F.lit(1.0), F.lit(0.0)
    hx2 = F.when(held_full, one).when(held_empty, zero).otherwise(F.greatest(zero, F.least(one, hx + moved / hs)))
    nx2 = F.when(new_full, one).when(new_empty, zero).otherwise(F.greatest(zero, F.least(one, nx - moved / ns)))
    return F.struct(hx2.alias("held"), nx2.alias("new"))


def _with_x(doc: Column, x: Column) -> Column:
    return F.struct(
        doc["doc_id"].alias("doc_id"), doc["copy"].alias("copy"), doc["size"].alias("size"), x.alias("x")
    )


def _fold(docs: Column, salt: int) -> Column:
    """Fold an array of fractional documents: struct(settled array, held: the one left over)."""
    start = F.struct(
        F.filter(docs, lambda d: F.lit(False)).alias("settled"), F.element_at(docs, 1).alias("held")
    )

    def step(state, new):
        held, done = state["held"], state["settled"]
        luck = _unit(F.lit(salt), new["doc_id"], new["copy"], new["size"], held["doc_id"], held["copy"])
        x = _exchange(held, new, luck)
        held2, new2 = _with_x(held, x["held"]), _with_x(new, x["new"])
        held_done = (held2["x"] <= 0.0) | (held2["x"] >= 1.0)
        new_done = (new2["x"] <= 0.0) | (new2["x"] >= 1.0)
        # the document that is still fractional is held on; if both are settled, either will do
        return F.struct(
            F.concat(done, F.array(F.when(held_done & ~new_done, held2).otherwise(new2))).alias("settled"),
            F.when(held_done & ~new_done, new2).otherwise(held2).alias("held"),
        )

    def settled_pair(state, new):
        """A held document that is already whole gives way without an exchange."""
        held, done = state["held"], state["settled"]
        whole = (held["x"] <= 0.0) | (held["x"] >= 1.0)
        gone = F.struct(F.concat(done, F.array(held)).alias("settled"), new.alias("held"))
        return F.when(whole, gone).otherwise(step(state, new))

    return F.aggregate(F.slice(docs, F.lit(2), F.greatest(F.size(docs) - 1, F.lit(0))), start, settled_pair)


def _level(rows: DataFrame, salt: int, name: str) -> DataFrame:
    """Fold each (source_key, block); rows: source_key, block, doc(doc_id, copy, size, x)."""
    # longer documents first; ties by a hash and by all that tells two rows apart
    order = F.struct(
        (-F.col("doc.size")).alias("o"), _unit(F.lit(salt), "doc.doc_id", "doc.copy").alias("u"), "doc"
    )
    grouped = rows.groupBy("source_key", "block").agg(F.sort_array(F.collect_list(order)).alias("docs"))
    folded = grouped.select("source_key", "block", _fold(F.transform("docs", lambda d: d["doc"]), salt).alias("f"))
    return staged(folded.select("source_key", "block", "f.settled", "f.held"), name)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """How often each row of `docs` (doc_id, text, source) is taken.

    Returns doc_id, size, source, source_size, target, copies, taken (= copies * size). Copies depend
    only on the rows, so reruns agree, also when the rows are stored differently. Rows that repeat
    in id, source and size are interchangeable and each drawn on their own. Texts without words
    are taken with the expected number rounded down (they add no words). Null texts have no words; a null
    source is a source of its own, ordered last. An empty table gives an empty result.
    """
    sizes = staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("size"), F.col("source").cast("string").alias("source")),
        "sizes",
    )
    targets = staged(
        source_targets(sizes, weights, share, limit).withColumn("source_key", F.sha2(F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))), 256)),
        "targets",
    )
    # rows that agree in all columns are counted first and told apart by a running copy number
    rows = (
        sizes.groupBy("doc_id", "size", "source").count()
        .select("doc_id", "size", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))
    )
    t = targets.select(F.col("source").alias("source_"), "source_key", "source_size", "target")
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    fraction = F.col("expected") - F.floor("expected")
    known = joined.withColumn("expected", expected).withColumn("x", fraction)
    drawn = known.where((F.col("size") > 0) & (F.col("x") > 0.0))
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("long")
    counts = staged(drawn.groupBy("source_key").agg(F.count("*").alias("n")), "block-counts").select("source_key", blocks.alias("blocks"))
    rounds = counts.agg(F.max("blocks")).first()[0] or 0
    level = (
        drawn.join(counts, "source_key")
        .select(
            "source_key",
            F.pmod(F.xxhash64(F.lit(seed), "doc_id", "copy", "size"), "blocks").alias("block"),
            F.struct("doc_id", "copy", "size", "x").alias("doc"),
        )
    )
    settled = []
    salt = seed
    while rounds > 0:
        folded = _level(level, salt, "fold")
        settled.append(folded.select("source_key", F.explode("settled").alias("doc")))
        # what is left of up to BLOCK blocks meets one level up
        level = folded.select("source_key", F.floor(F.col("block") / BLOCK).alias("block"), F.col("held").alias("doc"))
        rounds = 0 if rounds == 1 else -(-rounds // BLOCK)
        salt += 1
    root = level.select(
        "source_key",
        _with_x(F.col("doc"), F.when(F.col("doc.x") >= 0.5, 1.0).otherwise(0.0)).alias("doc"),
    )
    if settled:
        outcome = root
        for part in settled:
            outcome = outcome.unionByName(part)
        outcome = outcome.select(
            "source_key", F.col("doc.doc_id").alias("doc_id"), F.col("doc.size").alias("size"), F.col("doc.x").cast("long").alias("extra")
        )
    else:
        outcome = drawn.select("source_key", "doc_id", "size", F.lit(0).cast("long").alias("extra"))
    certain = known.where(~((F.col("size") > 0) & (F.col("x") > 0.0))).select(
        "source_key", "doc_id", "size", F.lit(0).cast("long").alias("extra")
    )
    per_source = targets.select("source", "source_key", "source_size", "target")
    copies = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)) + F.col("extra")
    return (
        outcome.unionByName(certain)
        .join(per_source, "source_key")
        .withColumn("copies", copies.cast("long"))
        .select(
            "doc_id", "size", "source", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` (doc_id, text, source, ...), each as often as `mix` takes it, with all its columns.

    Rows taken zero times go. Rows of one id, source and size are interchangeable for `mix`; their copies are dealt to
    them in turn, by a hash of the text. Nulls count as in `mix`: a null text has size 0, a null source is a source. An
    empty table gives no rows. Columns may have any names.
    """
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.col("source").cast("string").alias("of"),
        word_count().alias("size"),
    )
    dealt = mix(docs, **options).groupBy("doc_id", "source", "size").agg(
        F.sort_array(F.collect_list("copies")).alias("copies")
    )
    dealt = staged(dealt, "dealt")
    d = dealt.select(F.col("doc_id").alias("d_id"), F.col("source").alias("d_of"), F.col("size").alias("d_size"), "copies")
    same = F.col("id").eqNullSafe(F.col("d_id")) & F.col("of").eqNullSafe(F.col("d_of")) & (F.col("size") == F.col("d_size"))
    # rows that are the only one of their id, source and size are not numbered: texts are shuffled once. A merge join, as
    # there is a row of copies for each document, which the driver need not see
    times = sized.hint("merge").join(d.where("size(copies) = 1 and copies[0] > 0"), same).select("row", F.col("copies")[0].alias("times"))
    shared = d.where("size(copies) > 1")
    if not shared.isEmpty():
        order = Window.partitionBy("id", "of", "size").orderBy(F.xxhash64("row.text"))
        turn = sized.join(shared, same).withColumn("turn", F.row_number().over(order))
        times = times.unionByName(turn.select("row", F.coalesce(F.get("copies", F.col("turn") - 1), F.lit(0)).alias("times")))
    joined = times.where("times > 0").select("row", F.col("times").cast("int").alias("times"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
