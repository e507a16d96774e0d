"""Exact dedup: frequent digests are found by a Misra-Gries sketch and settled without a shuffle.

Texts are equal when they agree after every run of blanks became one space. Only digests and ids
are shuffled, never texts. Frequent digests come from a frequent-items sketch (Spark's
`approx_top_k`, a mergeable Misra-Gries summary with a fixed number of counters). Their exact
winners, one row per candidate, are joined on the map side; all other digests are grouped by an
ordinary shuffle, where no group can hold more than a small share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import SPACE, marked, numbered, text_or_empty
from pricemill.session import staged

#: Counters of the sketch and candidates taken from it. The table that is broadcast has at most
#: CANDIDATES rows of about 100 bytes, whatever the input. A digest with more than
#: 1 / (0.75 * COUNTERS) of all rows is always among the candidates.
COUNTERS = 1024
CANDIDATES = 512


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text, in hex; a null text counts as empty."""
    return F.sha2(F.regexp_replace(text_or_empty(text), SPACE, " ").cast("binary"), 256)


def frequent_digests(digests: DataFrame) -> DataFrame:
    """Candidates for frequent digests: (text_sha256), at most CANDIDATES rows."""
    found = digests.agg(F.expr(f"approx_top_k(text_sha256, {CANDIDATES}, {COUNTERS})").alias("found"))
    return found.select(F.explode("found.item").alias("text_sha256"))


def _winners(digests: DataFrame) -> DataFrame:
    """Per digest, the row that stays: smallest doc_id (null last), then smallest row number."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")
    return digests.groupBy("text_sha256").agg(
        F.min(order).alias("first"), F.count("*").alias("group_size")
    ).select(
        "text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row_no").alias("keep_row"), "group_size"
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): its group of equal texts and whether it stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null texts equal empty ones. Of rows with
    the same doc_id and equal texts, exactly one is kept. Rows without a doc_id stay only if no equal
    text has one. An empty table gives an empty result; other columns are ignored.
    """
    digests = numbered(docs.select(F.col("doc_id"), digest().alias("text_sha256")), "digests")
    return _decided(digests).select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def _decided(digests: DataFrame) -> DataFrame:
    frequent = staged(frequent_digests(digests), "frequent")
    # exact winners of the candidates: the sketch decides only where a digest is handled
    heavy = staged(_winners(digests.join(F.broadcast(frequent), "text_sha256", "left_semi")), "heavy")
    settled = digests.join(F.broadcast(heavy), "text_sha256")
    rest = digests.join(F.broadcast(frequent), "text_sha256", "left_anti")
    return settled.unionByName(rest.join(_winners(rest), "text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that stay: one of each group of equal texts, with all its columns.

    Decisions are made on ids and digests alone. What goes is named by id and digest. Rows whose digest is not among
    these pass on the map side; the others, about as many as have copies, are written and matched. Null texts equal empty ones. Of rows that
    agree in id and normalised text, the one with the smallest hash of all its columns stays. Rows without an id stay
    only if no equal text has one. An empty table gives no rows. Columns may have any names.
    """
    digests = numbered(docs.select("doc_id", digest().alias("text_sha256")), "digests")
    counts = _decided(digests).groupBy("doc_id", "text_sha256").agg(
        F.max(F.col("row_no") == F.col("keep_row")).alias("stays"), F.count("*").alias("n")
    )
    # pairs of which a row goes: all rows of a pair that loses, all but one of a pair that repeats
    pairs = staged(counts.where("not stays or n > 1").select("doc_id", "text_sha256", "stays"), "losing-pairs")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest().alias("sha"))

    def match(pairs: DataFrame):
        return F.col("row.doc_id").eqNullSafe(pairs["doc_id"]) & (F.col("sha") == pairs["text_sha256"])

    seen = marked(rows, F.col("sha"), pairs, "text_sha256")
    alone = seen.where("not maybe").select("row")
    met = staged(seen.where("maybe").select("row", "sha"), "met-rows")
    whole = met.join(pairs, match(pairs), "left_anti").select("row")
    kept = alone.unionByName(whole)
    repeated = pairs.where("stays")
    if not repeated.isEmpty():
        again = met.join(repeated, match(repeated), "left_semi")
        one = again.groupBy(F.col("row.doc_id").alias("id"), "sha").agg(
            F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")
        )
        kept = kept.unionByName(one.select("row"))
    return kept.select("row.*")
