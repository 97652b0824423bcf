"""What the operators share: words, hashes, Arrow columns, tables kept by the session."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have this package: functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a small table up to which it is broadcast; beyond it Spark picks a shuffle join.
BROADCAST_ROWS = 100_000


def travels(module: str) -> None:
    """Send the functions of `module` by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each string of a column, one at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.view(kind) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column:
        yield value.as_py()


def hashes(words: Iterable[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each byte string."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` words, or for the whole sequence where that is shorter; none for no words."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        out = mixed(out + word_hashes[j:n - width + 1 + j] + np.uint64(j + 1))
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has no more than `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, label) of about `rows` rows of `labels` (doc_id, label) at most, picked by a hash of the id."""
    labels = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    share = min(1.0, rows / max(1, labels.count()))
    picked = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < round(share * (1 << 20)))
    # About `rows` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label")
