"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.session import staged

#: Words are runs of anything but these characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows, of 64 bits each, of the table that marks keys before a join.
SLOTS = 1 << 18


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Write the frame with a unique `row_no` per row and read it back.

    The number is part of the written table, so it stays the same however often a later task runs.
    It tells rows apart that agree in every column.
    """
    return staged(df.withColumn("row_no", F.monotonically_increasing_id()), name)


def map_batches(
    df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, rows: int = 512
) -> DataFrame:
    """Run a generator over small record batches; it yields dicts of columns.

    Batches are cut to `rows` rows, so one step holds few texts in memory, whatever batch size the
    session uses.
    """
    target = _arrow_schema(df, schema)

    def run(batches):
        small = (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        for columns in make(small):
            arrays = [pa.array(columns[f.name], type=f.type, from_pandas=False) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def marked(rows: DataFrame, key: Column, keys: DataFrame, column: str) -> DataFrame:
    """`rows` with a column `maybe`: false only where `key` is certainly not among the values of `column` in `keys`.

    Keys set bits of a table that is joined on the map side, at most SLOTS rows whatever the input. So rows that a join
    with `keys` would not find need not be shuffled for it; the join decides about the others.
    """
    table = keys.select(F.xxhash64(column).alias("hash_")).groupBy(F.col("hash_").bitwiseAND(F.lit(SLOTS - 1)).alias("slot_"))
    table = table.agg(F.bit_or(_bit_of("hash_")).alias("bits_"))
    hashed = rows.withColumn("hash_", F.xxhash64(key)).withColumn("slot_", F.col("hash_").bitwiseAND(F.lit(SLOTS - 1)))
    found = F.coalesce(F.col("bits_").bitwiseAND(_bit_of("hash_")) != 0, F.lit(False))
    return hashed.join(F.broadcast(table), "slot_", "left").select(*(F.col(f"`{c}`") for c in rows.columns), found.alias("maybe"))


def _bit_of(hashed: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose `column` may be in `keys`, for a join with `keys` that follows."""
    return marked(rows, F.col(column), keys, column).where("maybe").drop("maybe")


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes.split() parts at exactly the six ASCII blanks of SPACE."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def words_of_batch(texts: pa.Array, lower: bool = False):
    """Words of all texts of an Arrow array in turn, as `words_of` finds them; with `lower`, A-Z as a-z.

    Returns the different words (an Arrow array in UTF-8, which may hold an empty one that no text uses), the place of
    each word of the texts among them, and where the words of each text end, with 0 before.
    """
    import numpy as np
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten().dictionary_encode()
    different, places = flat.dictionary, flat.indices.to_numpy()
    if lower:
        # only the different words: ascii_lower of a slice of texts reads past its bytes
        flat = pc.ascii_lower(different).dictionary_encode()
        different, places = flat.dictionary, flat.indices.to_numpy()[places]
    different = different.cast(pa.large_binary())
    ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    # a text that begins or ends with a blank, or has no word, has empty words there
    blank = pc.index(different, pa.scalar(b"", pa.large_binary())).as_py()
    if blank >= 0:
        real = places != blank
        ends, places = np.r_[0, np.cumsum(real)][ends], places[real]
    return different, places, ends


def as_list(words: pa.Array) -> list[bytes]:
    """Words of `words_of_batch` as Python objects: joined and split again, quicker than one by one."""
    import pyarrow.compute as pc

    if len(words) == 0:
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, pa.scalar(b"\n", words.type))[0].as_py().split(b"\n")


def crc_part(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo `parts`; null for a null value."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))
