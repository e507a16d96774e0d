"""Embedding near-dedup as an exact metric range join.

On unit vectors, cosine >= 0.95 is a Euclidean distance of at most r = sqrt(2 - 2 * 0.95). Pivots part the
vectors: each belongs to the cell of its nearest pivot. Neighbouring cells are cut into groups of bounded size, and
groups into blocks, by distance from the pivot. A block knows its least and greatest distance to every pivot: by the
triangle inequality, two blocks whose ranges are more than r apart for any pivot hold no link. Every two
groups meet once, in a task of their own that gets only blocks with a partner on the other side. So a vector is copied
once per group, not once per cell, and each pair of vectors is looked at once, by a matrix product of two blocks.

Equal vectors are one node from the start. A pair of groups returns counts and one link per vector to its
component in that pair, so rows stay in proportion to vectors however dense a group is.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import map_batches, numbered
from pricemill.llm.components import components
from pricemill.session import staged

SIMILAR = 0.95
#: Vectors per pivot, and the bound on pivots (at most MOST_PIVOTS vectors are sent to all tasks).
PER_PIVOT, MOST_PIVOTS = 4096, 256
BLOCK = 512
#: Most bytes of the vectors of a group, and most vectors; a task holds two groups.
GROUP_BYTES, GROUP_ROWS = 1 << 24, 1 << 16
#: Links that a task holds before it keeps only one per vector.
HELD_LINKS = 1 << 20
#: Single precision and rounding of distances are off by less.
SLACK = 1e-6


def _unit_rows(x):
    import numpy as np

    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _comparable(column: str):
    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda v: v != 0), F.lit(False))


def _distances(units, centres):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ centres.T)))


def _tour(pivots: list) -> list:
    """The pivots in an order in which each is followed by the nearest one left."""
    import numpy as np

    centres = _unit_rows(pivots)
    far = _distances(centres, centres)
    order, left = [0], np.arange(len(pivots)) > 0
    while left.any():
        order.append(int(np.where(left, far[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return [pivots[i] for i in order]


def _placed(nodes: DataFrame, pivots: list, kind: str) -> DataFrame:
    """(node, copies, home, far, vector): nodes with their nearest pivot and the distance to it."""

    def make(batches) -> Iterator[dict]:
        import numpy as np

        centres = _unit_rows(pivots)
        for b in batches:
            if b.num_rows == 0:
                continue
            raw = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)
            far = _distances(_unit_rows(raw), centres)
            yield {
                "node": b.column("node").to_numpy(),
                "copies": b.column("copies").to_numpy(),
                "home": far.argmin(axis=1).astype(np.int32),
                "far": far.min(axis=1),
                "vector": [v.tobytes() for v in raw],
            }

    schema = "node bigint, copies bigint, home int, far double, vector binary"
    return map_batches(nodes.select("node", "copies", "embedding"), make, schema, rows=4096)


def _grouped(placed: DataFrame, counts: list[int], size: int) -> DataFrame:
    """Adds `grp`: the cells in turn, cut into groups of about `size`; a cell that is cut is dealt by hash."""
    starts = [sum(counts[:i]) for i in range(len(counts))]
    number = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])[F.col("home")]
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return placed.withColumn("grp", F.floor((number(starts) + share * number(counts)) / F.lit(size)).cast("int"))


def _blocks(grouped: DataFrame, pivots: list, kind: str) -> DataFrame:
    """(grp, blk, ids, copies, vectors, lo, hi): blocks of a group, with the range of distances to every pivot."""
    rows = BLOCK

    def make(table):
        import numpy as np
        import pyarrow as pa

        centres = _unit_rows(pivots)
        column = {c: table.column(c).to_numpy() for c in ("grp", "node", "copies", "home", "far")}
        order = np.lexsort((column["far"], column["home"]))
        raw = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(len(order), -1)
        out = {c: [] for c in ("grp", "blk", "ids", "copies", "vectors", "lo", "hi")}
        for i in range(0, len(order), rows):
            part = order[i : i + rows]
            far = _distances(_unit_rows(raw[part]), centres)
            out["grp"].append(column["grp"][0])
            out["blk"].append(i // rows)
            out["ids"].append(column["node"][part].tobytes())
            out["copies"].append(column["copies"][part].tobytes())
            out["vectors"].append(raw[part].tobytes())
            out["lo"].append(far.min(axis=0).tobytes())
            out["hi"].append(far.max(axis=0).tobytes())
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    schema = "grp int, blk int, ids binary, copies binary, vectors binary, lo binary, hi binary"
    return grouped.groupBy("grp").applyInArrow(make, schema)


def _near_blocks(lo, hi, other_lo, other_hi, radius: float):
    """Which blocks (rows) may hold links with which others (columns), by their ranges of distances to the pivots."""
    import numpy as np

    near = np.ones((len(lo), len(other_lo)), bool)
    for p in range(lo.shape[1]):
        near &= other_lo[:, p] - hi[:, p, None] <= radius + SLACK
        near &= lo[:, p, None] - other_hi[:, p] <= radius + SLACK
    return near


def _meetings(blocks: DataFrame, radius: float) -> list[tuple]:
    """(grp, blk, pair, own): which blocks go to which pair of groups, and whether on the side of its first group."""
    import numpy as np

    # 16 bytes per block and pivot
    known = sorted(tuple(r) for r in blocks.select("grp", "blk", "lo", "hi").collect())
    lo, hi = (np.array([np.frombuffer(r[k]) for r in known]) for k in (2, 3))
    groups = np.array([r[0] for r in known])
    numbers = np.unique(groups)
    sent, pair = [], 0
    for g in numbers:
        own = np.flatnonzero(groups == g)
        near = _near_blocks(lo[own], hi[own], lo, hi, radius)
        for h in numbers[numbers >= g]:
            other = np.flatnonzero(groups == h)
            met = near[:, other]
            if not met.any():
                continue
            sent += [(*known[i][:2], pair, True) for i in own[met.any(axis=1)]]
            if h != g:
                sent += [(*known[i][:2], pair, False) for i in other[met.any(axis=0)]]
            pair += 1
    return sent


def _roots(a, b, size: int):
    """Per index below `size` the least one it is linked to by the links (a, b), over any number of steps."""
    import numpy as np

    label = np.arange(size)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for ends in (label[a], label[b], a, b):
            np.minimum.at(label, ends, least)
        label = label[label]
        if (before == label).all():
            return label


def _linked(own: list[dict], others: list[dict], similar: float, radius: float, kind: str) -> dict:
    """Links of a pair of groups, or with no `others` those inside one: (node, n, label) of the nodes that have some."""
    import numpy as np

    rows = own + others
    ids, copies = ([np.frombuffer(r[k], np.int64) for r in rows] for k in ("ids", "copies"))
    units = [_unit_rows(np.frombuffer(r["vectors"], kind).reshape(len(i), -1)) for r, i in zip(rows, ids)]
    single = [u.astype(np.float32) for u in units]
    at = np.r_[0, np.cumsum([len(i) for i in ids])]
    lo, hi = (np.array([np.frombuffer(r[k]) for r in rows]) for k in ("lo", "hi"))
    near = _near_blocks(lo[: len(own)], hi[: len(own)], lo, hi, radius)
    width = units[0].shape[1]
    # products in single precision are off by less; only those this near to the limit need double precision
    margin = max(1e-4, 2e-7 * width)
    step = max(1, (1 << 21) // width)
    n = np.zeros(at[-1], np.int64)
    held, n_held = [], 0
    for i in range(len(own)):
        for j in range(len(own) if others else i, len(rows)):
            if not near[i, j]:
                continue
            rough = (single[i] @ single[j].T).ravel()
            hits = np.flatnonzero(rough >= similar - margin)
            p, q = np.divmod(hits, len(ids[j]))
            sure = rough[hits] >= similar + margin
            if i == j:
                sure[p >= q] = False
            unsure = np.flatnonzero(~sure & ((i != j) | (p < q)))
            for k in range(0, len(unsure), step):
                some = unsure[k : k + step]
                sure[some] = np.einsum("ij,ij->i", units[i][p[some]], units[j][q[some]]) >= similar
            p, q = p[sure], q[sure]
            if len(p) == 0:
                continue
            for s, ends, weights in ((i, p, copies[j][q]), (j, q, copies[i][p])):
                n[at[s] : at[s + 1]] += np.bincount(ends, weights, len(ids[s])).astype(np.int64)
            held.append((p + at[i], q + at[j]))
            n_held += len(p)
            if n_held > HELD_LINKS:
                label = _roots(*map(np.concatenate, zip(*held)), at[-1])
                tied = np.flatnonzero(label != np.arange(at[-1]))
                held, n_held = [(tied, label[tied])], len(tied)
    known = np.flatnonzero(n)
    node = np.concatenate(ids)
    label = _roots(*map(np.concatenate, zip(*held)), at[-1]) if held else np.arange(at[-1])
    return {"node": node[known], "n": n[known], "label": node[label[known]]}


def _compare(sent: DataFrame, similar: float, radius: float, kind: str) -> DataFrame:
    """(node, n, label): links found for it in a pair of groups, and its component there. A pair's rows are in turn."""

    def make(batches) -> Iterator[dict]:
        pair, sides = None, ([], [])
        for b in batches:
            for row in b.to_pylist():
                if row["pair"] != pair:
                    if pair is not None:
                        yield _linked(*sides, similar, radius, kind)
                    pair, sides = row["pair"], ([], [])
                sides[0 if row["own"] else 1].append(row)
        if pair is not None:
            yield _linked(*sides, similar, radius, kind)

    return map_batches(sent, make, "node bigint, n bigint, label bigint", rows=16)


def near_vectors(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding): its number of links and its component.

    Two rows are linked if the cosine of their vectors, in double precision, is at least `similar`. Returns
    vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept (vec_id is
    component_id). Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different length are not linked either. Rows that repeat an id are rows of their own; an
    empty table gives an empty result.
    """
    kind = "f8" if "array<double>" in dict(vectors.dtypes)["embedding"] else "f4"
    rows = numbered(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", _comparable("embedding").alias("ok")),
        "vectors",
    )
    nodes = staged(
        rows.where("ok").groupBy("embedding").agg(
            F.min("row_no").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
        ),
        "vector-nodes",
    )
    links = None
    for length in [r[0] for r in nodes.select(F.size("embedding")).distinct().collect()]:
        found = _links(nodes.where(F.size("embedding") == length), similar, kind)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    links = staged(links, "vector-links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(links.select(F.col("node").alias("a"), F.col("label").alias("b")))
    known = nodes.join(counts, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = staged(known.select("node", "embedding", "least", "label", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-labels")
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    # sorting by the hash first spares nearly all comparisons of whole vectors
    hashed = F.xxhash64("embedding").alias("hash_")
    result = known.join(least, "label").select(hashed, "embedding", "n_links", "component_id")
    linked = rows.where("ok").select(hashed, "vec_id", "embedding").join(result, ["hash_", "embedding"])
    linked = linked.select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(nodes: DataFrame, similar: float, kind: str) -> DataFrame:
    spark = nodes.sparkSession
    n = nodes.count()
    wanted = min(MOST_PIVOTS, -(-n // PER_PIVOT))
    pivots = [r[0] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("embedding").collect()]
    pivots = _tour(pivots)
    radius = (2.0 - 2.0 * similar) ** 0.5
    cores = spark.sparkContext.defaultParallelism
    # reading the vectors is light, so their files alone do not make enough tasks
    placed = staged(_placed(nodes.repartition(4 * cores), pivots, kind), "vector-cells")
    counted = dict(tuple(r) for r in placed.groupBy("home").agg(F.count("*")).collect())
    # some pairs of groups per core, and no group that is too large to hold
    few = -(-n // max(1, int((8 * cores) ** 0.5)))
    size = max(BLOCK, min(few, GROUP_ROWS, GROUP_BYTES // (int(kind[1]) * len(pivots[0]))))
    grouped = _grouped(placed, [counted.get(i, 0) for i in range(len(pivots))], size)
    blocks = staged(_blocks(grouped, pivots, kind), "vector-blocks")
    sent = _meetings(blocks, radius)
    pairs = sent[-1][2] + 1
    meetings = spark.createDataFrame(sent, "grp int, blk int, pair int, own boolean")
    dealt = blocks.join(meetings, ["grp", "blk"]).select("pair", "own", "ids", "copies", "vectors", "lo", "hi")
    # a pair is much work on few bytes: tasks are counted by pairs, and not left to be merged by size
    dealt = dealt.repartitionById(pairs, "pair").sortWithinPartitions("pair")
    return _compare(dealt, similar, radius, kind)
