"""What the operators of this subpackage share: the shared folder, and a numpy word scanner over Arrow text.

The scanner works on the bytes of an Arrow string column. Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]``; UTF-8 keeps those bytes for themselves, so this equals the scan by characters.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

BATCH_BYTES = 4 << 20

WS_RUN = r"[\x20\x09-\x0D]+"

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BLOCK = 1 << 19
_POW = _powers(_P, _BLOCK + 1)
_INV = _powers(_P_INV, _BLOCK + 1)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB at most, however long the texts are; a lower limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(name).rstrip("b")
    if not limit.isdigit() or int(limit) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote, once all that was made from it is written too."""
    for df in tables:
        remove(df.sparkSession, df._quern_path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are written: it does so once their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of one key that go to one task at most, in joins that split.
HOT = 5_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, *spread: str, how: str = "inner") -> DataFrame:
    """left joined with right, a written table with one row for each key and in n the number of left's rows of it.

    Keys with more rows than others deal them to several tasks, by the spread columns, and their row of right goes to
    each. Only the keys whose rows exceed a quarter of a partition's even share are split, so there are at most four
    times as many as partitions; that bounds the table that is broadcast.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(HOT, (right.agg(F.sum(n)).first()[0] or 0) // (4 * parts))
    hot = right.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("_pieces"))
    one = spark.range(1).select(*(F.lit("0").cast(right.schema[k].dataType).alias(k) for k in keys), F.lit(1).alias("_pieces"))
    hot = hot.unionByName(one).groupBy(*keys).agg(F.max("_pieces").alias("_pieces"))  # never empty, for one plan at every size
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_piece", F.pmod(F.xxhash64(*spread), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    copies = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > limit, F.ceil(F.col(n) / limit).cast("int") - 1).otherwise(0))))
    return dealt.join(copies.drop(n), [*keys, "_piece"], how).drop("_piece")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the whole text, null as empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def text_mark() -> Column:
    """A hash of the whole text, null as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each value starts (one more than there are values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, where, data = column.buffers()
    if not len(column) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold about limit bytes; a longer value is a range of its own."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of its value. Words never cross values."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_WS[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = at[(at > 0) & (at < len(raw))]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from running sums, in blocks of bounded memory.

    Two different words agree by chance about once in 2**60 pairs.
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _BLOCK, "right")))
        base, stop = int(starts[a]), int(ends[b - 1])
        if stop - base > _BLOCK:  # one word longer than a block
            h, word = 0, raw[base:stop]
            for i in range(0, len(word), _BLOCK):
                part = word[i : i + _BLOCK]
                s = int((_BYTE[part] * _POW[: len(part)]).sum(dtype=np.uint64))
                h = (h + s * pow(_P, i, 2**64)) % 2**64
            out[a] = h
        else:
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(_BYTE[raw[base:stop]] * _POW[: stop - base], out=sums[1:])
            s, e = starts[a:b] - base, ends[a:b] - base
            out[a:b] = (sums[e] - sums[s]) * _INV[s]
        a = b
    return mix(out ^ (ends - starts).astype(np.uint64))


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
