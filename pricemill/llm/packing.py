"""Packing documents into training sequences along a space-filling curve.

Each document becomes token ids and a hashed vector of its ids. A fixed random projection takes the vector
to a few dimensions, a Hilbert curve through them gives every document a place, and a range sort by
that place brings similar documents together. Each range is then packed on its own: ids run on from
document to document and are cut at the length of a sequence, so only the end of a range can
leave a gap. That end is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.common import map_batches
from pricemill.session import staged

LENGTH = 2048
END_ID = 1
#: Buckets of the hashed vector, dimensions of the curve and bits per dimension (a place has 60 bits).
BUCKETS, DIMENSIONS, DEPTH = 256, 4, 15
SEED = 11
#: Parts of words whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def batch_encoder(tokenizer_file: str):
    """A function from an Arrow array of texts to the ids of all of them and the places where each text's ids end.

    The vocabulary drops white space and never joins across it, so the ids of a text are those of
    its blank-separated words in turn. Each different word of a batch is looked up once. Plain words with
    common punctuation at the end are sent to the model in two parts, whose ids are remembered; everything
    else goes through the whole tokenizer, Unicode blanks and separators inside a word included.
    """
    import os
    import string
    from array import array

    import pyarrow.compute as pc

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(tokenizer_file)
    model = tokenizer.model
    byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
    accented = "".join(map(chr, (*range(0xE0, 0xF7), *range(0xF8, 0xFF))))
    in_bytes = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in accented}
    latin = string.ascii_letters + accented + accented.upper()
    marks = ".,!?;:*%$&#"

    class Parts(dict):
        """Ids of a lower-case stem or of punctuation, as bytes."""

        def __missing__(self, part: str) -> bytes:
            if len(self) >= REMEMBERED:
                self.clear()
            known = part if part.isascii() else part.translate(in_bytes)
            ids = self[part] = array("H", [t.id for t in model.tokenize(known)]).tobytes()
            return ids

    parts = Parts({"": b""})

    def parted(words: pa.Array):
        """Ids of the parts of different words, and which two parts make each word."""
        stems = pc.utf8_rtrim(words, characters=marks)
        plain = pc.match_substring_regex(stems, f"^[{latin}]+$")
        stems = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        tails = pc.utf8_ltrim(words.filter(plain), characters=latin).dictionary_encode()
        others = tokenizer.encode_batch_fast(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)
        ids = [b"", *map(parts.__getitem__, stems.dictionary.to_pylist() + tails.dictionary.to_pylist())]
        plain = plain.to_numpy(zero_copy_only=False)
        made_of = np.zeros((len(words), 2), np.int64)
        made_of[plain, 0] = stems.indices.to_numpy() + 1
        made_of[plain, 1] = tails.indices.to_numpy() + 1 + len(stems.dictionary)
        made_of[~plain, 0] = np.arange(len(others)) + len(ids)
        return ids + [array("H", o.ids).tobytes() for o in others], made_of

    def encode(texts: pa.Array):
        # a text that begins or ends with a blank, or has no word, has empty words there
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().dictionary_encode()
        own, made_of = parted(words.dictionary)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 2
        begins = np.cumsum(sizes) - sizes
        # the two parts of each word in turn; each id is at the begin of its part plus its place in the part
        used = made_of[words.indices.to_numpy()].ravel()
        ends = np.concatenate(([0], np.cumsum(sizes[used])))
        shift = np.repeat(begins[used] - ends[:-1], sizes[used])
        ids = np.frombuffer(b"".join(own), "<u2")[shift + np.arange(len(shift))]
        return ids, ends[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]

    return encode


def hilbert_index(coordinates, depth: int):
    """Place along the Hilbert curve of each row of integer coordinates below 2**depth.

    Skilling's transformation (2004) from coordinates to the transposed index, then bits interleaved.
    """
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    place = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def curve_places(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, place, ids) per row of `docs` (doc_id, text): ids with the end id, 16 bits each."""

    def make(batches) -> Iterator[dict]:
        encode = batch_encoder(tokenizer_file)
        rng = np.random.default_rng(SEED)
        # ids are hashed to a bucket and a sign, buckets are projected to the curve's dimensions
        bucket = rng.integers(0, BUCKETS, 1 << 16)
        sign = rng.choice((-1.0, 1.0), 1 << 16)
        project = rng.normal(size=(BUCKETS, DIMENSIONS))
        end = END_ID.to_bytes(2, "little")
        for b in batches:
            ids, ends = encode(b.column("text"))
            ids = [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            vectors = np.zeros((len(ids), BUCKETS))
            for row, own in enumerate(ids):
                vectors[row] = np.bincount(bucket[own], weights=sign[own], minlength=BUCKETS)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            spread = (vectors / np.maximum(norms, 1e-12)) @ project
            # projections of unit vectors are about normal: three deviations to each side make the cube
            cells = np.clip((spread + 3.0) / 6.0 * (1 << DEPTH), 0, (1 << DEPTH) - 1)
            yield {
                "doc_id": b.column("doc_id"),
                "place": hilbert_index(cells, DEPTH),
                "ids": [own.tobytes() + end for own in ids],
            }

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(narrow, make, "doc_id bigint, place bigint, ids binary")


def _powers(rest: int) -> list[int]:
    return [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pack_ranges(places: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pack each partition of `places` in its order; returns PIECES."""

    def make(batches) -> Iterator[dict]:
        import zlib

        from pyspark import TaskContext

        names = [c.split()[0] for c in PIECES.split(", ")]
        # sequences of a partition are numbered from its own base
        first = sequence = TaskContext.get().partitionId() << 40
        tail: list[tuple] = []  # pieces of the sequence that is not full yet
        filled = 0

        def crc(ids) -> int:
            return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4"))

        def full(pieces, number):
            offset = 0
            for doc_id, start, ids, tokens in pieces:
                yield (doc_id, start, len(ids) // 2, crc(ids), tokens, number, offset)
                offset += len(ids) // 2

        for b in batches:
            out = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                tokens, start = len(ids) // 2, 0
                while start < tokens:
                    take = min(tokens - start, length - filled)
                    tail.append((doc_id, start, ids[2 * start : 2 * (start + take)], tokens))
                    start, filled = start + take, filled + take
                    if filled == length:
                        out.extend(full(tail, sequence))
                        tail, filled, sequence = [], 0, sequence + 1
            if out:
                yield dict(zip(names, map(list, zip(*out))))
        out = []
        for size in _powers(filled):
            pieces, room = [], size
            while room:
                doc_id, start, ids, tokens = tail.pop(0)
                take = min(len(ids) // 2, room)
                pieces.append((doc_id, start, ids[: 2 * take], tokens))
                if take < len(ids) // 2:
                    tail.insert(0, (doc_id, start + take, ids[2 * take :], tokens))
                room -= take
            out.extend(full(pieces, sequence))
            sequence += 1
        if out:
            yield dict(zip(names, map(list, zip(*out))))

    return map_batches(places.select("doc_id", "ids"), make, PIECES)


def pack(docs: DataFrame, tokenizer_file: str, length: int = LENGTH) -> DataFrame:
    """Pieces of sequences of at most `length` tokens that hold all of `docs` (doc_id, text).

    Returns per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (in its sequence, without gaps). A document's ids are those of its text and
    one end id; a null or empty text has the end id alone. Every id lies in exactly one piece. Sequences
    are full, except for those at the end of a range, whose lengths are powers of two. Ranges
    are cut between documents, also between documents of equal place, so copies do not gather in one task.
    Repeated rows and null ids are packed like any others; an empty table gives no piece.
    """
    # written once: the range sort looks at the places first, to choose its cuts, and then moves the ids
    places = staged(curve_places(docs, tokenizer_file), "places")
    ordered = places.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")
    return pack_ranges(ordered, length)
