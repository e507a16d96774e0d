"""Substring dedup by difference-cover anchors.

Hashes are taken only at word positions p with p mod 31 in a difference cover of six residues. For any two
positions i and j there is an offset below 31 at which i and j are both such positions. So if the same 50
words stand at i in one document and at j in another, both have an anchor at that offset, over the same 20 words. Anchors that
documents of different content share are found by one aggregation; from each of them the search is
extended both ways to the 50-word windows around it, and only those few windows are hashed in full (96 bits)
and matched with the smallest doc_id that has them. Work and rows are in proportion to the text and to
its repeated part: documents are never paired.

Documents with the same words throughout are settled by their digest, all copies at once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import as_list, map_batches, numbered, words_of, words_of_batch
from pricemill.llm.rolling import BASES, SEEDS, RunHasher, covered, item_hasher, mask_spans, window_starts
from pricemill.session import discard, staged

WINDOW = 50
#: A perfect difference set: every residue modulo 31 is a difference of two of its members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
_LAST = 2**63 - 1


def _texts(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.select(key.alias("doc"), F.col("text").cast("string").alias("text"))


def _contents(texts: DataFrame) -> DataFrame:
    """(doc, n_words, sha): number and digest of the words, joined by one space."""

    def make(batches) -> Iterator[dict]:
        from hashlib import sha256

        for b in batches:
            words = [words_of(t) for t in b.column("text").to_pylist()]
            yield {
                "doc": b.column("doc"),
                "n_words": [len(w) for w in words],
                "sha": [sha256(b" ".join(w)).digest() for w in words],
            }

    return map_batches(texts, make, "doc bigint, n_words bigint, sha binary")


def _anchors(texts: DataFrame, window: int, located: bool) -> DataFrame:
    """All anchors: (hash, content), or with their places: (hash, doc, pos)."""

    def make(batches) -> Iterator[dict]:
        import numpy as np

        hashes, run = item_hasher(SEEDS[0]), RunHasher(BASES[0])
        width = window - PERIOD + 1
        cover = np.isin(np.arange(PERIOD), COVER)
        for b in batches:
            words, places, ends = words_of_batch(b.column("text"))
            own = hashes(as_list(words))[places]
            # all texts of the batch at once: a run's hash does not depend on where it starts
            lengths = np.diff(ends)
            pos = np.arange(len(own)) - np.repeat(ends[:-1], lengths)
            at = np.flatnonzero(cover[pos % PERIOD] & (pos <= np.repeat(lengths - width, lengths)))
            if len(at) == 0:
                continue
            # a text's content is named by the hash of all its words
            owners = b.column("doc").to_numpy() if located else run(own, lengths, ends[:-1]).view(np.int64)
            out = {"hash": run(own, width, at).view(np.int64), "owner": np.repeat(owners, lengths)[at]}
            yield out | ({"pos": pos[at].astype(np.int32)} if located else {})

    return map_batches(texts, make, "hash bigint, owner bigint" + (", pos int" if located else ""))


def _packed(texts: DataFrame) -> DataFrame:
    """(doc, sha, words): the words of each text, compressed for the way to their anchors."""

    def make(batches) -> Iterator[dict]:
        from hashlib import sha256

        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            lines = [b" ".join(words_of(t)) for t in b.column("text").to_pylist()]
            yield {
                "doc": b.column("doc"),
                "sha": [sha256(x).digest() for x in lines],
                "words": [squeeze(x) for x in lines],
            }

    return map_batches(texts, make, "doc bigint, sha binary, words binary")


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """Windows around shared anchors: (h1, h2, row_no, doc, start)."""

    def make(batches) -> Iterator[dict]:
        import numpy as np
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        hashers = [(item_hasher(s), RunHasher(b)) for s, b in zip(SEEDS, BASES)]
        for b in batches:
            out = {k: [] for k in ("h1", "h2", "row_no", "doc", "start")}
            columns = (b.column(k).to_pylist() for k in ("row_no", "doc", "words", "positions"))
            for row, doc, packed, positions in zip(*columns):
                words = expand(packed).split()
                starts = window_starts(positions, PERIOD - 1, window, len(words))
                if len(starts) == 0:
                    continue
                h1, h2 = (run(hashes(words), window, starts) for hashes, run in hashers)
                out["h1"].append(h1.view(np.int64))
                out["h2"].append((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))
                out["row_no"].append(np.full(len(starts), row, np.int64))
                out["doc"].append(np.full(len(starts), doc, np.int64))
                out["start"].append(starts.astype(np.int32))
            if out["h1"]:
                yield {k: np.concatenate(v) for k, v in out.items()}

    return map_batches(
        candidates.select("row_no", "doc", "words", "positions"),
        make,
        "h1 bigint, h2 int, row_no bigint, doc bigint, start int",
        rows=128,
    )


def _cut(candidates: DataFrame, window: int) -> DataFrame:
    """Per candidate with repeated windows: what is removed and the digest of what stays."""

    def make(batches) -> Iterator[dict]:
        from hashlib import sha256
        from itertools import compress

        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = {k: [] for k in ("doc", "sha", "n_removed", "spans", "kept_sha256")}
            columns = (b.column(k).to_pylist() for k in ("doc", "sha", "words", "starts"))
            for doc, sha, packed, starts in zip(*columns):
                words = expand(packed).split()
                gone = covered(starts, window, len(words))
                kept = b" ".join(compress(words, (~gone).tolist()))
                row = (doc, sha, int(gone.sum()), mask_spans(gone), sha256(kept).hexdigest())
                for k, v in zip(out, row):
                    out[k].append(v)
            yield out

    return map_batches(
        candidates.select("doc", "sha", "words", "starts"),
        make,
        "doc bigint, sha binary, n_removed bigint, spans array<struct<start:int,end:int>>, kept_sha256 string",
        rows=128,
    )


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs` (doc_id, text): the words that repeat a passage of a document with a smaller id.

    A word goes if it lies in a window of `window` consecutive words (more than 31) that also starts in a document with a
    smaller doc_id; windows are judged on the input. Returns doc_id, n_words, n_removed, spans (removed
    words as [start, end)), kept_sha256 (kept words joined by one space). Null texts have no words. Rows
    without an id come after all others; ids are below 2**63 - 1. Rows that repeat an id are not
    smaller than one another. An empty table gives an empty result.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    texts = _texts(docs)
    info = staged(_contents(texts), "contents")
    firsts = staged(info.groupBy("sha").agg(F.min("doc").alias("first")), "first-contents")

    shared = staged(
        _anchors(texts, window, located=False)
        .groupBy("hash")
        .agg(F.min("owner").alias("least"), F.max("owner").alias("most"))
        .where("least < most")
        .select("hash"),
        "shared-anchors",
    )
    positions = (
        _anchors(texts, window, located=True)
        .join(shared, "hash", "left_semi")
        .groupBy(F.col("owner").alias("doc"))
        .agg(F.collect_set("pos").alias("positions"))
    )
    originals = info.join(firsts, "sha").where("doc = first").select("doc").distinct()
    anchored = staged(positions.join(originals, "doc", "left_semi"), "anchored")
    candidates = numbered(
        _packed(texts).join(anchored, "doc").join(firsts, "sha").where("doc = first").drop("first")
        .dropDuplicates(["doc", "sha"]),
        "candidates",
    )

    windows = _windows(candidates, window)
    # written first: the join then does not reuse the aggregate's shuffle, so Spark can split a frequent window's rows
    owners = staged(
        windows.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"),
        "window-owners",
    )
    discard(shared, anchored)
    repeated = (
        windows.join(owners, ["h1", "h2"])
        .where("doc > least")
        .groupBy("row_no")
        .agg(F.collect_list("start").alias("starts"))
    )
    cut = staged(_cut(candidates.join(repeated, "row_no"), window), "cut")
    discard(owners, candidates)

    rows = info.join(firsts, "sha").join(cut, ["doc", "sha"], "left")
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(
        F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.slice(whole, 1, 0))).alias("spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
