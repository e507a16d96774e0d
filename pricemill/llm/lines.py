"""Line dedup by winnowing over line hashes.

The items of a document are its lines that are not blank, without blanks at either end. Of every
window of consecutive line hashes the smallest is selected as a fingerprint (the rightmost of equal ones). Two
equal runs of at least that many lines select the same fingerprints inside, so every repeated run is found from
one of them. Fingerprints that occur more than once are joined with their positions; from each, the match is extended
both ways to the full windows around it, whose 96-bit hashes are matched with their first
occurrence. Overlapping windows make up the whole repeated run, and all but its first occurrence go.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import map_batches, numbered
from pricemill.llm.rolling import BASES, SEEDS, RunHasher, covered, item_hasher, window_starts
from pricemill.session import staged

#: Shortest repeated run, in lines, and so the window of the winnowing.
RUN = 3
_BLANKS = b" \t\n\x0b\x0c\r"
_LAST = 2**63 - 1


def line_items(text: str | None) -> tuple[list[bytes], list[bytes], list[int]]:
    """All lines, the items, and the line each item stands in."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    bare = [x.strip(_BLANKS) for x in lines]
    at = [i for i, x in enumerate(bare) if x]
    return lines, [bare[i] for i in at], at


def winnow(hashes, width: int):
    """Positions of the minima of all windows of `width` hashes, rightmost of equal ones."""
    import numpy as np

    if len(hashes) < width:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.unique(np.arange(len(view)) + width - 1 - view.argmin(axis=1))


def _fingerprints(docs: DataFrame, run: int) -> DataFrame:
    def make(batches) -> Iterator[dict]:
        import numpy as np

        hashes = item_hasher(SEEDS[0])
        for b in batches:
            rows, prints, places = [], [], []
            for row, text in zip(b.column("row_no").to_pylist(), b.column("text").to_pylist()):
                own = hashes(line_items(text)[1])
                at = winnow(own, run)
                rows.append(np.full(len(at), row, np.int64))
                prints.append(own[at].view(np.int64))
                places.append(at.astype(np.int32))
            yield {"hash": np.concatenate(prints), "row_no": np.concatenate(rows), "pos": np.concatenate(places)}

    return map_batches(docs.select("row_no", "text"), make, "hash bigint, row_no bigint, pos int")


def _windows(candidates: DataFrame, run: int) -> DataFrame:
    def make(batches) -> Iterator[dict]:
        import numpy as np

        hashers = [(item_hasher(s), RunHasher(b)) for s, b in zip(SEEDS, BASES)]
        for b in batches:
            out = {k: [] for k in ("h1", "h2", "doc", "row_no", "start")}
            columns = (b.column(k).to_pylist() for k in ("row_no", "doc", "text", "positions"))
            for row, doc, text, positions in zip(*columns):
                items = line_items(text)[1]
                starts = window_starts(positions, run - 1, run, len(items))
                h1, h2 = (r(h(items), run, starts) for h, r in hashers)
                out["h1"].append(h1.view(np.int64))
                out["h2"].append((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))
                out["doc"].append(np.full(len(starts), doc, np.int64))
                out["row_no"].append(np.full(len(starts), row, np.int64))
                out["start"].append(starts.astype(np.int32))
            yield {k: np.concatenate(v) for k, v in out.items()}

    return map_batches(
        candidates.select("row_no", "doc", "text", "positions"),
        make,
        "h1 bigint, h2 int, doc bigint, row_no bigint, start int",
        rows=128,
    )


def _cut(rows: DataFrame, run: int) -> DataFrame:
    def make(batches) -> Iterator[dict]:
        import numpy as np

        for b in batches:
            out = {k: [] for k in ("doc", "n_lines", "n_removed", "kept_text")}
            columns = (b.column(k).to_pylist() for k in ("doc", "text", "starts"))
            for doc, text, starts in zip(*columns):
                lines, items, at = line_items(text)
                gone = set(np.array(at, np.int64)[covered(starts or [], run, len(items))].tolist())
                kept = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
                row = (doc, len(items), len(gone), kept.decode("utf-8", "surrogatepass"))
                for k, v in zip(out, row):
                    out[k].append(v)
            yield out

    return map_batches(
        rows.select("doc", "text", "starts"),
        make,
        "doc bigint, n_lines bigint, n_removed bigint, kept_text string",
        rows=128,
    )


def line_dedup(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Per row of `docs` (doc_id, text): the text without lines that repeat an earlier run of lines.

    A line goes if it lies in `run` consecutive non-blank lines whose contents, blanks at either end
    aside, also start earlier: in a document with a smaller doc_id, or further up in the same one.
    Blank lines neither count nor go. Occurrences are judged on the input. Returns doc_id,
    n_lines (not blank), n_removed, kept_text. Null texts are empty. Rows without an id come after all others
    (ids are below 2**63 - 1); rows that repeat an id follow one another in no fixed order. An empty
    table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    texts = numbered(docs.select(key.alias("doc"), F.col("text").cast("string").alias("text")), "line-texts")
    prints = staged(_fingerprints(texts, run), "line-fingerprints")
    shared = prints.groupBy("hash").count().where("count > 1").select("hash")
    positions = prints.join(shared, "hash", "left_semi").groupBy("row_no").agg(F.collect_list("pos").alias("positions"))
    candidates = staged(texts.join(positions, "row_no"), "line-candidates")
    windows = _windows(candidates, run)
    place = F.struct("doc", "row_no", "start")
    owners = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that the join deals out both of its sides itself and can split a frequent window
    owners = staged(owners.drop("n"), "line-owners")
    repeated = (
        windows.join(owners, ["h1", "h2"])
        .where(place > F.col("first"))
        .groupBy("row_no")
        .agg(F.collect_list("start").alias("starts"))
    )
    rows = _cut(texts.join(repeated, "row_no", "left"), run)
    return rows.withColumn("doc_id", F.when(F.col("doc") != _LAST, F.col("doc"))).select(
        "doc_id", "n_lines", "n_removed", "kept_text"
    )
