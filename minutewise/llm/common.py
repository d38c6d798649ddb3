"""What the training-data operators share: tables in, folds, saved steps and small array helpers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minutewise.session import shared_folder

# Batches sent to Python are bounded in bytes, because one text may be as long as thousands of others.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus, with the batch size that the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, remainder: int) -> Column:
    """Whether a row is kept from learning; a row without an id always is."""
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(True))


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, and no lost executor can undo it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_array(column: pa.Array) -> pa.Array:
    """A text column as one large_string array without nulls; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a large_string array in one row, and the number of bytes of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, np.diff(offsets)


def stretches(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """A large_string array in consecutive stretches, each cut before the first text that begins size bytes or more further on; one at least."""
    lengths = utf8_bytes(texts)[1]
    cuts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // size)) + 1
    bounds = [0, *cuts.tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(bounds, bounds[1:]))


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts with A-Z lower-cased, and how many each text has.

    Words are runs without space, tab, newline, vertical tab, form feed or carriage return.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    owner = pc.list_parent_indices(split)
    there = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(there), owner.filter(there).to_numpy()
    return words.dictionary_encode(), np.bincount(owner, minlength=len(texts))


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments; an empty segment gives 0."""
    ends = np.cumsum(lengths)
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[ends - lengths]


def in_runs(rows, size):
    """Consecutive runs of at most size items."""
    rows = iter(rows)
    return iter(lambda: list(itertools.islice(rows, size)), [])


def if_small(df: DataFrame, rows: int = 100_000, size: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, and bytes in its string columns; else as it is."""
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in df.dtypes if kind == "string"]
    held = sum(texts, F.lit(0)).cast("long")
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


# Fixed value: the polynomial of CRC-32, its bits reversed.
CRC_SQL = """tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab)"""


def crc32_sql(octets: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a list of byte values, with tab (of CRC_SQL) in the FROM list."""
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
