"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise part is scored in linear time: half of (sum v x)^2 - sum v^2 x^2 over the factors. Trained on a bounded
sample of labelled rows (`sample`, those with the smallest hash of doc_id); the metadata is n_chars.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, LOWER, slices, string_buffers, word_hashes, word_spans

BITS = 13
DIM = 1 << BITS
FACTORS = 8
#: Labelled rows that the machine is fitted on, at most.
SAMPLE = 6000
PREDICT_FROM = 0.3

_KINDS = np.zeros((256, 9), np.float64)
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!", b"|", b"#$%&*@^~<>=_{}[]", b".,;:'\"?()-/", b"\n", range(128, 256))):
    _KINDS[[*_set], _i] = 1
N_STATS = 9 + 8
_ROWS = 128


def _features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word counts by hashed place (n x DIM) and structure statistics (n x N_STATS)."""
    n, size = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(n), size)
    byte = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256) @ _KINDS
    starts, ends, doc = word_spans(raw, at)
    h = word_hashes(LOWER[raw], starts, ends)
    counts = np.bincount(doc * DIM + (h >> np.uint64(64 - BITS)).astype(np.int64), minlength=n * DIM).reshape(n, DIM)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    length = np.bincount(doc, ends - starts, minlength=n)
    again = np.zeros(n)
    if len(h) > 1:  # words that repeat the one before, and pairs of words
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[1:], same, minlength=n)
    top = np.sort(counts, axis=1)[:, -3:] if n else np.zeros((0, 3))
    stats = np.column_stack([byte / np.maximum(size, 1)[:, None], np.log1p(words), length / some, (counts > 0).sum(axis=1) / some, again / some, top[:, -1] / some, top.sum(axis=1) / some, np.log1p(byte[:, 7]), words / (byte[:, 7] + 1) / 100])
    return counts, stats.astype(np.float32)


def batch_features(raw: np.ndarray, at: np.ndarray):
    """Yields (first row, counts, stats) for a few rows at a time."""
    for a, b in slices(at, 1 << 21):
        for i in range(a, b, _ROWS):
            j = min(i + _ROWS, b)
            yield i, *_features(raw[at[i] : at[j]], at[i : j + 1] - at[i])


def inputs(counts: np.ndarray, stats: np.ndarray, n_chars: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32))
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-6)[:, None]
    more = np.column_stack([stats, np.log1p(np.maximum(n_chars, 0))]).astype(np.float32)
    return np.concatenate([x, np.clip((more - mean) / std, -5, 5) / 4], axis=1).astype(np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray  # places x factors
    mean: np.ndarray
    std: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * (s * s - (x * x) @ (self.v * self.v)).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(make_batch, y: np.ndarray, width: int, mean: np.ndarray, std: np.ndarray, epochs: int = 8, rate: float = 0.05, penalty: float = 1e-4, seed: int = 5) -> FactorisationMachine:
    """AdaGrad on the logistic loss, in batches of 64 rows."""
    rng = np.random.default_rng(seed)
    m = FactorisationMachine(float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))), np.zeros(width, np.float32), rng.normal(0, 0.05, (width, FACTORS)).astype(np.float32), mean, std)
    gw, gv = np.full(width, 1e-4, np.float32), np.full((width, FACTORS), 1e-4, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            at = order[i : i + 64]
            x = make_batch(at)
            e = (m.scores(x) - y[at]).astype(np.float32) / len(at)
            s = x @ m.v
            dw = x.T @ e + penalty * m.w
            dv = x.T @ (s * e[:, None]) - ((x * x).T @ e)[:, None] * m.v + penalty * m.v
            gw += dw * dw
            gv += dv * dv
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= rate * dv / np.sqrt(gv)
            m.bias -= rate * float(e.sum())
    return m


def _sparse(batches):
    for batch in batches:
        raw, at = string_buffers(batch.column(0))
        rows = []
        for _, counts, stats in batch_features(raw, at):
            for c, s in zip(counts, stats, strict=True):
                where = np.flatnonzero(c)
                rows.append((where.astype(np.int16).tobytes(), c[where].astype(np.int32).tobytes(), s.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(3)] + [batch.column(1), batch.column(2), batch.column(3)], ["at", "n", "stats", "n_chars", "quality", "doc_id"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> FactorisationMachine | None:
    """A machine from at most `sample` labelled rows where learn holds; None without rows of both labels."""
    picked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))
    rows = rows.join(F.broadcast(picked), "doc_id").select("text", "n_chars", "quality", "doc_id")  # at most `sample` rows of two numbers
    sparse = rows.mapInArrow(_sparse, f"at binary, n binary, stats binary, n_chars long, quality int, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    once = sparse.groupBy("doc_id").agg(F.min(F.struct("at", "n", "stats", "n_chars", "quality")).alias("x"))  # of rows that repeat a doc_id, one
    got = once.select("x.*").collect()
    got = sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=lambda r: tuple(map(bytes, r[:3])) + (r[3], r[4]))
    y = np.array([r[4] for r in got], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    stats = np.array([np.frombuffer(r[2], np.float32) for r in got])
    n_chars = np.array([r[3] for r in got])
    more = np.column_stack([stats, np.log1p(np.maximum(n_chars, 0))]).astype(np.float32)
    mean, std = more.mean(axis=0), more.std(axis=0) + 1e-6

    def make_batch(rows_: np.ndarray) -> np.ndarray:
        counts = np.zeros((len(rows_), DIM), np.int32)
        for k, r in enumerate(rows_):
            counts[k, np.frombuffer(got[r][0], np.int16)] = np.frombuffer(got[r][1], np.int32)
        return inputs(counts, stats[rows_], n_chars[rows_], mean, std)

    return fit(make_batch, y, DIM + N_STATS + 1, mean, std)


def score(docs: DataFrame, machine: FactorisationMachine | None) -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs; null and empty texts are scored by what their features say.

    0.5 where nothing could be learned. Rows that repeat a doc_id are each scored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            raw, at = string_buffers(batch.column(1))
            n_chars = batch.column(2).to_numpy(zero_copy_only=False)
            out = np.full(batch.num_rows, 0.5)
            for first, counts, stats in batch_features(raw, at) if machine else ():
                rows = slice(first, first + len(counts))
                out[rows] = machine.scores(inputs(counts, stats, n_chars[rows], machine.mean, machine.std))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of those not held out; nulls, ties and empty texts as in train and score."""
    bounded_batches(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels, ~held_out(5, 0)))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
