"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample (`per_class` rows of each
language, those with the smallest hash of doc_id and text); document frequencies come from all rows that may be learned from. A
temperature is fitted on a part of the sample that the weights haven't seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, written

BITS = 14
DIM = 1 << BITS
#: Rows of each language that the weights and the temperature are fitted on, at most.
PER_CLASS = 800
OVER = 4
LANGUAGES = 4_096
UNDECIDED = "und"
_CHUNK = 1 << 19  # characters that are counted at once, about
_ROWS = 16  # texts that are counted at once

_LETTER: np.ndarray | None = None
_LOG = np.log1p(np.arange(1 << 16)).astype(np.float32)


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _place(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h >> np.uint32(32 - BITS)


def _count(values: list[str], starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows x DIM) and whether there is a letter; of one value, the n-grams that start before `starts` alone."""
    letter, n_rows = _letters(), len(values)
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(n_rows), [len(t) for t in values])
    alpha = letter[codes]
    c = np.where(alpha, codes, np.uint32(32))
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))
    three = two[:-1] ^ (c[2:] * np.uint32(0xC2B2AE3D))
    counts = np.zeros(n_rows * DIM, np.int64)
    for n, h in enumerate((one, two + np.uint32(77), three + np.uint32(177)), 1):
        use = alpha[: len(h)].copy()
        for j in range(1, n):
            use |= alpha[j : j + len(h)]
        if n > 1:  # none across texts
            use &= row[: len(h)] == row[n - 1 :]
        if starts is not None:
            use[starts:] = False
        counts += np.bincount(row[: len(h)][use] * DIM + _place(h[use]), minlength=n_rows * DIM)
    return counts.reshape(n_rows, DIM), np.bincount(row[alpha], minlength=n_rows) > 0


def ngram_counts(values: list[str]):
    """Yields (first row, counts as rows x DIM, has a letter) of the lower-cased texts; n-grams of 1 to 3 letters and blanks.

    A very long text is counted in parts that are added up.
    """
    values, i = [t.lower() for t in values], 0
    while i < len(values):
        if len(values[i]) > _CHUNK:
            parts = [_count([values[i][a : a + _CHUNK + 2]], _CHUNK) for a in range(0, len(values[i]), _CHUNK)]
            yield i, sum(c for c, _ in parts), np.any([s for _, s in parts], axis=0)
            i += 1
            continue
        j, size = i, 0
        while j < len(values) and j - i < _ROWS and size + len(values[j]) <= _CHUNK:
            size, j = size + len(values[j]), j + 1
        yield i, *_count(values[i:j])
        i = j


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = _LOG[np.minimum(counts, len(_LOG) - 1)] * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


@dataclass
class LanguageModel:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM x classes
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 3, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over sparse rows (places, values, class); the last place is the bias."""
    z, n = np.zeros((DIM + 1, n_classes)), np.zeros((DIM + 1, n_classes))

    def solved(zi, ni):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = solved(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g2
    w = solved(z, n)
    return w[:DIM].astype(np.float32), w[DIM].astype(np.float32)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a fixed grid."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 5, 60):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def _frequencies(batches):
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for _, counts, _ in ngram_counts(batch.column(0).to_pylist()):
            df += (counts > 0).sum(axis=0)
            n += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1), pa.int32()), pa.array(np.append(df, n))], ["place", "df"])


def _sparse(batches):
    for batch in batches:
        langs, hs, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
        for first, counts, _ in ngram_counts(batch.column(0).to_pylist()):
            for i, c in enumerate(counts):
                at = np.flatnonzero(c)
                out.append((langs[first + i], hs[first + i], at.astype(np.int32).tobytes(), np.minimum(c[at], 65535).astype(np.uint16).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "h", "at", "n"])


def _picked(rows: DataFrame, per_class: int) -> DataFrame:
    """lang, at, n of the rows of each language with the smallest hashes, per_class at most; rows that repeat count once.

    Only rows under a hash that leaves about OVER times as many as are wanted are ranked, so no task gets a language's
    rows. What is broadcast has one row a language, LANGUAGES at most, as the model has one column a language.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    if (found := sizes.count()) > LANGUAGES:
        raise ValueError(f"{found} languages; a model has {LANGUAGES} at most")
    few = rows.select("lang", h.alias("h")).join(F.broadcast(sizes), "lang").where(F.col("h") / 2.0**63 * F.col("rows") <= OVER * per_class).groupBy("lang", "h").agg(F.lit(1).alias("one"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_class)
    last = written(ranked.groupBy("lang").agg(F.max("h").alias("last")), "last")
    picked = rows.withColumn("h", h).join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last"))
    once = picked.select("text", "lang", "h").mapInArrow(_sparse, "lang string, h long, at binary, n binary").groupBy("lang", "h").agg(F.min(F.struct("at", "n")).alias("x"))
    return once.select("lang", "x.at", "x.n")


def train(docs: DataFrame, learn: Column, per_class: int = PER_CLASS) -> LanguageModel | None:
    """A model from the rows where learn holds and lang isn't null; None where there are none."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    sums = rows.select("text").mapInArrow(_frequencies, "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))
    found = {r[0]: r[1] for r in sums.collect()}  # DIM + 1 rows
    total = found.get(DIM, 0)
    if not total:
        return None
    df = np.array([found.get(i, 0) for i in range(DIM)])
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    sample = [(r["lang"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.uint16)) for r in _picked(rows, per_class).collect()]
    sample.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    classes = sorted({r[0] for r in sample})
    data = []
    for lang, at, n in sample:
        x = _LOG[n] * idf[at]
        data.append((at, x / max(float(np.sqrt((x * x).sum())), 1e-12), classes.index(lang)))
    fit, check = [r for i, r in enumerate(data) if i % 5], data[::5]
    w, b = ftrl(fit, len(classes))
    logits = np.array([x @ w[at] + b for at, x, _ in check])
    return LanguageModel(classes, idf, w, b, fit_temperature(logits, np.array([y for _, _, y in check])))


def identify(docs: DataFrame, model: LanguageModel | None, *keep: str, text: str = "text") -> DataFrame:
    """keep columns, lang_pred and score (the calibrated probability) for each row of docs.

    `und` with score 0 where the text is null or has no letter, or nothing could be learned. Empty tables give no rows.
    A text that is to be kept travels once.
    """
    sent = [*keep] if text in keep else [*keep, text]
    at = sent.index(text)

    def run(batches):
        for batch in batches:
            values = [x or "" for x in batch.column(at).to_pylist()]
            pred, score = [UNDECIDED] * len(values), np.zeros(len(values))
            for first, counts, some in ngram_counts(values) if model else ():
                p = model.probabilities(tf_idf(counts, model.idf))
                best = p.argmax(axis=1)
                for i in np.flatnonzero(some):
                    pred[first + i], score[first + i] = model.classes[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(*sent)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), "lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out; nulls, ties and empty texts as in train and identify."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, ~held_out(5, 0))
    return identify(docs, model, "doc_id").withColumn("held_out", held_out(5, 0)).select("doc_id", "held_out", "lang_pred", "score")
