"""Shared plumbing of the training-data operators: tables, shared storage, Arrow batches, words."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python works on so many bytes of text at once, however long the rows of an Arrow batch are.
SLICE_BYTES = 3 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one machine (a local master) gets a fresh one; a cluster gets an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


#: Folders of the tables that materialise() wrote.
_written: list = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, so a lost executor costs a reread only. release() deletes it, at the latest when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framewright/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete all tables that materialise() has written: for when the results that were made of them have been written or read."""
    for files, folder in _written:
        try:
            files.delete(folder, True)
        except Exception:  # noqa: BLE001 - the JVM is gone, and with it the right to delete
            break
    _written.clear()


def unique_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (Spark's names ignore case)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base = f"_{base}"
    return base


def crc32_text(c) -> F.Column:
    """Unsigned CRC-32 of the UTF-8 bytes (null: of none)."""
    return F.crc32(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))


#: What a worker keeps for the operator that it works for.
_kept: dict[str, object] = {}


def kept(key: str, make):
    """make()'s value, made once in a worker and kept until the worker turns to another operator."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about limit bytes of the column; a longer value is a slice of its own. keep: the caller uses what is kept()."""
    if not keep:
        _kept.clear()
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            yield batch.slice(i, j - i)
    tidy()


def tidy() -> None:
    """Hand memory that is free back to the machine: workers outlive their tasks, and what one operator leaves lying the next can't use."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def filled(column: pa.Array) -> pa.Array:
    """The strings with "" for null, in an array of their own."""
    return pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: where each text's words begin (one more entry at the end), and all words."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # white space at either end of a text leaves an empty string
        before = np.concatenate([[0], np.cumsum(real)])
        offsets, flat = before[offsets], flat.filter(pa.array(real))
    return offsets.astype(np.int64), flat


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the word of each code."""
    enc = words.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each flat element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values in each row; of floats one after the other, so that a row's sum doesn't depend on the rows around it."""
    if values.dtype.kind == "f":
        return np.bincount(row_of(offsets), values, len(offsets) - 1)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: uint64 to uint64, one to one."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hash_strings(words: pa.Array) -> np.ndarray:
    """xxh64 of each string's UTF-8 bytes."""
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def numbered(df: DataFrame, name: str, out: str) -> DataFrame:
    """df as a written table with a distinct number in each row: its partition in the upper bits, its place there in the lower 33."""
    return materialise(df.withColumn(out, F.monotonically_increasing_id()), name)


def ranked(df: DataFrame, keys: list[str], row: str, out: str) -> DataFrame:
    """A gapless number from 0 for the rows of each key, without gathering a key in one task.

    df comes from numbered(); row is its number. Rows are dealt by (keys, partition of origin), so however many rows a key
    has, a group is at most a partition of the written table; a row's number is its number there plus the counts of the
    key's earlier partitions.
    """
    from pyspark.sql import Window

    b, first, n = unique_name(df, "_part"), unique_name(df, "_first"), unique_name(df, "_n")
    rows = df.withColumn(b, F.shiftright(row, 33).cast("int"))
    counts = rows.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = counts.select(*keys, b, F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(first))
    inside = rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys, b).orderBy(row)) - 1)
    return inside.join(before, [*keys, b]).withColumn(out, (F.col(out) + F.col(first)).cast("long")).drop(b, first)
