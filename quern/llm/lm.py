"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax, beside add-one unigrams.

P(word | context) = P(class | context) P(slot | class, context) P(word | slot). The most frequent words are classes of
their own, others share a class by their last byte, and within such a class one of 32 slots by their hash. The first two
factors are maximum-entropy models, a softmax over all classes and one over the slots of the class, with hashed features
of the words before: the last word, the last two classes, and skip features of the second, third and fourth last. They
are trained by distributed gradient updates: each task takes steps on its documents, and after a round the tasks'
weights are averaged in a tree. Every token of every training document is in exactly one step, of the round that the
document is dealt to. Within a slot words are told apart by add-one smoothing over its training tokens, without context.

Counts are exact and never gathered in one place: words are counted within buckets of documents, summed by word, and
go back to the buckets that hold the word; a bucket's own dictionary is all that a task keeps. Words are told apart by
64 bits (60 of a hash, 4 of the last byte).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, held_out, mix, release, runs, slices, string_buffers, word_hashes, word_spans, written

TOP = 32
SUFFIX = 16
SLOTS = 32
CLASSES = TOP + SUFFIX
LEAVES = SUFFIX * SLOTS
_START = CLASSES  # the class of what stands before a text
_SIDE = CLASSES + 1
_BITS = 12
_HASHED = 1 << _BITS
#: Weights of the class factor by feature: last two classes, last word, second last word, third and fourth last classes, bias.
_OFFSETS = (0, _SIDE * _SIDE, _SIDE * _SIDE + _HASHED, _SIDE * _SIDE + 2 * _HASHED, 2 * _SIDE * _SIDE + 2 * _HASHED)
ROWS = _OFFSETS[-1] + 1
#: Weights of the slot factor by the class with: the last two classes, the last word, the second last word (hashed); alone.
SLOT_ROWS = 3 * _HASHED + SUFFIX
END = np.uint64(0x5EED0E4D00000000)
ROUNDS = 2
_PART = 512  # rows of weights that travel together
_FAN = 32  # weights of so many tasks are averaged in one
_FIRST_STEP, _STEP = 256, 4096  # tokens of a step: few at first, at most an eighth of those seen
RATE = 0.5


def token_ids(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all values, each followed by the end token, and where each value's tokens start."""
    low = LOWER[raw]
    starts, ends, doc = word_spans(low, at)
    h = (word_hashes(low, starts, ends) & ~np.uint64(15)) | (low[ends - 1] & np.uint8(15)).astype(np.uint64)
    n = np.bincount(doc, minlength=len(at) - 1)
    first = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.empty(first[-1], np.uint64)
    out[first[1:] - 1] = END
    out[np.arange(len(h)) + doc] = h
    return out, first


@dataclass
class LanguageModel:
    top: np.ndarray  # hashes of the words that are classes, sorted
    top_tokens: np.ndarray  # training tokens of each
    leaf_tokens: np.ndarray  # training tokens of each slot of each suffix, frequent words aside
    leaf_words: np.ndarray  # distinct training words of each
    train_tokens: int
    distinct: int
    state: list[np.ndarray] | None = None  # ROWS x CLASSES + 1 and SLOT_ROWS x SLOTS + 1: weights, and squares of gradients

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        found = (tokens & np.uint64(15)).astype(np.int64) + TOP
        if len(self.top):
            i = np.minimum(np.searchsorted(self.top, tokens), len(self.top) - 1)
            own = self.top[i] == tokens
            found[own] = i[own]
        return found

    @staticmethod
    def blank() -> list[np.ndarray]:
        out = [np.zeros((ROWS, CLASSES + 1), np.float32), np.zeros((SLOT_ROWS, SLOTS + 1), np.float32)]
        for x in out:
            x[:, -1] = 1e-3
        return out


def slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(4)).astype(np.int64) & (SLOTS - 1)


def leaves(tokens: np.ndarray) -> np.ndarray:
    """The suffix and the slot of a word, as one number."""
    return (tokens & np.uint64(LEAVES - 1)).astype(np.int64)


def features(tokens: np.ndarray, cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of weights for each token: 5 x n of the class factor; which tokens have a slot, and 4 x that of its factor."""
    n = len(tokens)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))

    def before(x: np.ndarray, k: int, none) -> np.ndarray:
        out = np.full(n, none, x.dtype)
        out[k:] = x[: n - k] if k < n else x[:0]
        out[place < k] = none
        return out

    c = [before(cls, k, _START) for k in (1, 2, 3, 4)]
    hashed = mix(tokens) >> np.uint64(64 - 2 * _BITS)  # two sets of bits: one for each factor
    h1, h2 = (before(hashed, k, np.uint64(0)).astype(np.int64) for k in (1, 2))
    two = c[0] * _SIDE + c[1]
    own = np.stack([two, (h1 >> _BITS) + _OFFSETS[1], (h2 >> _BITS) + _OFFSETS[2], c[2] * _SIDE + c[3] + _OFFSETS[3], np.full(n, _OFFSETS[4])]).astype(np.uint16)
    some = np.flatnonzero(cls >= TOP)
    s, low = cls[some] - TOP, _HASHED - 1
    slot = np.stack([(two[some] * SUFFIX + s) * 0x9E3779B1 >> 15 & low, ((h1[some] ^ s * 2654435761) & low) + _HASHED, ((h2[some] ^ s * 2654435761) & low) + 2 * _HASHED, s + 3 * _HASHED]).astype(np.uint16)
    return own, some, slot


def logits(w: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """The sums of each token's rows of weights, less their largest, n x the outcomes."""
    z = w.take(feats[0], axis=0)
    for at in feats[1:]:
        z += w.take(at, axis=0)
    z -= z.max(axis=1, keepdims=True)
    return z


def log_probabilities(w: np.ndarray, feats: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Natural log of a factor's probability of what was found."""
    z = logits(w, feats)
    own = z[np.arange(len(z)), found]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def step(w: np.ndarray, g2: np.ndarray, feats: np.ndarray, found: np.ndarray) -> None:
    """One AdaGrad step on a block of tokens, with a rate for each row of weights."""
    n = len(found)
    p = logits(w, feats)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), found] -= 1
    for at in feats:
        if at[0] == at[-1] and not np.any(at != at[0]):  # the bias
            rows, g = at[:1], p.sum(axis=0, keepdims=True) / np.float32(np.sqrt(n))
        else:
            order = np.argsort(at, kind="stable")
            sorted_ = at[order]
            cut = runs(sorted_)
            rows = sorted_[cut[:-1]]
            g = np.add.reduceat(p.take(order, axis=0), cut[:-1], axis=0)
            g /= np.sqrt(np.diff(cut)).astype(np.float32)[:, None]
        g2[rows] += np.einsum("ij,ij->i", g, g) / np.float32(2)
        g *= (RATE / np.sqrt(g2[rows]))[:, None]
        w[rows] -= g


def _bucket_counts(batches):
    """Rows (bucket, learn, text) by bucket: words of each bucket with their counts in rows that are learned from."""
    now, hs, cs, held = None, [], [], 0

    def merged():
        h, c = np.concatenate(hs), np.concatenate(cs)
        order = np.argsort(h)
        h, c = h[order], c[order]
        at = runs(h)
        return h[at[:-1]], np.add.reduceat(c, at[:-1]) if len(h) else c

    def give():
        h, c = merged()
        for i in range(0, len(h), 200_000):
            part = slice(i, i + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(np.full(len(h[part]), now), pa.int32()), pa.array(c[part])], ["h", "bucket", "c"])

    for batch in batches:
        buckets = batch.column(0).to_numpy(zero_copy_only=False)
        learn = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        raw, at = string_buffers(batch.column(2))
        cut = runs(buckets)
        for r in range(len(cut) - 1):
            if now is not None and now != buckets[cut[r]]:
                yield from give()
                hs, cs, held = [], [], 0
            now = buckets[cut[r]]
            own = at[cut[r] : cut[r + 1] + 1]
            for a, b in slices(own):
                tokens, first = token_ids(raw[own[a] : own[b]], own[a : b + 1] - own[a])
                weight = np.repeat(learn[cut[r] + a : cut[r] + b], np.diff(first))
                order = np.argsort(tokens)
                t, weight = tokens[order], weight[order]
                k = runs(t)
                hs.append(t[k[:-1]])
                cs.append(np.add.reduceat(weight, k[:-1]))
                held += len(hs[-1])
                if len(hs) > 8 and held > 2 * len(hs[0]):
                    h, c = merged()
                    hs, cs, held = [h], [c], len(h)
    if now is not None:
        yield from give()


def _word_totals(batches):
    """Rows (h, bucket, c) by h: for each bucket its words with their totals.

    Buckets below zero tell of all words: -1 the most frequent ones of a batch, -2 tokens and -3 distinct words by leaf.
    """
    names = ["bucket", "hs", "cs"]

    def give(h, b, c):
        at = runs(h)
        total = np.add.reduceat(c, at[:-1])
        word = h[at[:-1]]
        all_ = np.repeat(total, np.diff(at))
        order = np.argsort(b, kind="stable")
        cut = runs(b[order])
        where = pa.array(cut, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(b[order][cut[:-1]], pa.int32()), pa.ListArray.from_arrays(where, pa.array(h[order])), pa.ListArray.from_arrays(where, pa.array(all_[order]))], names)
        best = np.argsort(-total, kind="stable")[:TOP]
        best = best[total[best] > 0]
        leaf = leaves(word.view(np.uint64))
        tokens, words = np.bincount(leaf, total, LEAVES).astype(np.int64), np.bincount(leaf, total > 0, LEAVES).astype(np.int64)
        kinds = np.arange(LEAVES)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, -3], pa.int32()), pa.array([word[best], kinds, kinds], pa.list_(pa.int64())), pa.array([total[best], tokens, words], pa.list_(pa.int64()))], names)

    open_: list = []
    for batch in batches:
        got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(got[0]):
            continue
        open_.append(got)
        if sum(len(x[0]) for x in open_) < 200_000:
            continue
        h, b, c = (np.concatenate(x) for x in zip(*open_))  # noqa: B905
        last = np.searchsorted(h, h[-1])
        if last:
            yield from give(h[:last], b[:last], c[:last])
        open_ = [[h[last:], b[last:], c[last:]]]
    if open_:
        yield from give(*(np.concatenate(x) for x in zip(*open_)))  # noqa: B905


def count_words(rows: DataFrame) -> DataFrame:
    """(bucket, hs, cs) as _word_totals gives it, for rows (bucket, learn, text)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("bucket", "learn", "text").repartition(n, "bucket").sortWithinPartitions("bucket")
    counts = dealt.mapInArrow(_bucket_counts, "h long, bucket int, c long").repartition(n, "h").sortWithinPartitions("h")
    return written(counts.mapInArrow(_word_totals, "bucket int, hs array<long>, cs array<long>"), "words")


def model_of(words: DataFrame) -> LanguageModel:
    """Sizes of classes and slots; what comes to the driver is TOP + 2 * LEAVES rows."""
    pairs = words.where("bucket < 0").select("bucket", F.explode(F.arrays_zip("hs", "cs")).alias("x")).select("bucket", "x.hs", "x.cs")
    best = pairs.where("bucket = -1").orderBy(F.desc("cs"), "hs").limit(TOP).collect()
    tokens, distinct = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in pairs.where("bucket < -1").groupBy("bucket", "hs").agg(F.sum("cs")).collect():
        (tokens if r[0] == -2 else distinct)[r[1]] = r[2]
    n, v = int(tokens.sum()), int(distinct.sum())
    found = sorted((np.uint64(r["hs"] % 2**64), r["cs"]) for r in best)
    top, top_tokens = np.array([h for h, _ in found], np.uint64), np.array([c for _, c in found], np.float64)
    np.subtract.at(tokens, leaves(top), top_tokens)
    np.subtract.at(distinct, leaves(top), 1)
    return LanguageModel(top, top_tokens, tokens, distinct, n, v)


def _trainer(model: LanguageModel):
    def run(batches):
        state = [x.copy() for x in model.state or model.blank()]
        (w, g2), (w_slot, g2_slot) = ((np.ascontiguousarray(x[:, :-1]), x[:, -1].copy()) for x in state)
        task, seen, size = TaskContext.get(), 0, _FIRST_STEP
        held: list = []

        def take(everything: bool):
            """Steps over what is held; a rest under a step waits for the next texts, or for their end."""
            nonlocal seen, size, held
            feats, cls, slot_feats, where, slot = (np.concatenate(x, axis=-1) for x in zip(*held))  # noqa: B905
            at = np.flatnonzero(where)
            a = 0
            while a < len(cls) and (everything or a + size <= len(cls)):
                b = min(a + size, len(cls))
                step(w, g2, feats[:, a:b], cls[a:b])
                i, j = np.searchsorted(at, (a, b))
                if j > i:
                    step(w_slot, g2_slot, slot_feats[:, i:j], slot[i:j])
                seen, a = seen + b - a, b
                size = min(_STEP, max(_FIRST_STEP, seen // 8))
            rest = np.searchsorted(at, a)
            held = [(feats[:, a:], cls[a:], slot_feats[:, rest:], where[a:], slot[rest:])]

        for batch in batches:
            raw, at = string_buffers(batch.column(0))
            for a, b in slices(at, 1 << 20):
                tokens, first = token_ids(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                cls = model.classes(tokens)
                feats, some, slot_feats = features(tokens, cls, first)
                held.append((feats, cls, slot_feats, cls >= TOP, slots(tokens[some])))
                if sum(len(x[1]) for x in held) >= 4 * size:
                    take(False)
        if held and sum(len(x[1]) for x in held):
            take(True)
        if seen:
            for kind, x in enumerate((np.column_stack([w, g2]), np.column_stack([w_slot, g2_slot]))):
                for i in range(0, len(x), _PART):
                    values = (kind, i, task.partitionId() if task else 0, x[i : i + _PART].tobytes(), seen)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _STATE_TYPES, strict=True)], _STATE_NAMES)

    return run


_STATE = "kind int, part int, task int, w binary, seen long"
_STATE_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_STATE_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())


def _average(batches):
    """Rows by kind, part, task: for each the mean weighted by tokens seen."""
    now, total, seen = None, None, 0

    def give():
        values = (*now, (total / seen).astype(np.float32).tobytes(), seen)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _STATE_TYPES, strict=True)], _STATE_NAMES)

    for batch in batches:
        for *key, w, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if key != now:
                if now is not None:
                    yield give()
                now, total, seen = key, 0.0, 0
            total = total + np.frombuffer(w, np.float32).astype(np.float64) * n
            seen += n
    if now is not None:
        yield give()


def train(rows: DataFrame, model: LanguageModel, rounds: int = ROUNDS) -> LanguageModel:
    """Fits both factors on the rows with learn; the weights are of a fixed size whatever the corpus.

    The weights of the tasks meet in a tree: _FAN at most in one mean, then as many of these, until one is left. Each
    level is a table, so a lost executor doesn't lose a round.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for r in range(rounds):
        own = rows.where("learn").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r).select("text")
        means = written(own.mapInArrow(_trainer(model), _STATE), "weights")
        while (last := means.agg(F.max("task")).first()[0]) is not None and last > 0:
            grouped = means.withColumn("task", F.floor(F.col("task") / _FAN).cast("int")).repartition(n, "kind", "part", "task").sortWithinPartitions("kind", "part", "task")
            means = written(grouped.mapInArrow(_average, _STATE), "weights")
        state = model.state or model.blank()
        for x in means.collect():  # the rows of one set of weights
            own_ = state[x["kind"]][x["part"] : x["part"] + _PART]
            own_[:] = np.frombuffer(x["w"], np.float32).reshape(own_.shape)
        model.state = state
    return model


def token_scores(model: LanguageModel, tokens: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each token, from the training counts of the tokens."""
    cls, out = model.classes(tokens), np.zeros(len(tokens))
    w, w_slot = (np.ascontiguousarray(x[:, :-1]) for x in model.state)
    feats, some, slot_feats = features(tokens, cls, first)
    slot, leaf = slots(tokens[some]), leaves(tokens[some])
    for i in range(0, len(tokens), _STEP):
        out[i : i + _STEP] = log_probabilities(w, feats[:, i : i + _STEP], cls[i : i + _STEP])
    for i in range(0, len(some), _STEP):
        out[some[i : i + _STEP]] += log_probabilities(w_slot, slot_feats[:, i : i + _STEP], slot[i : i + _STEP])
    out /= np.log(10)
    out[some] += np.log10((counts[some] + 1) / (model.leaf_tokens + model.leaf_words + 1)[leaf])
    return out


def _scorer(model: LanguageModel):
    names = ["doc_id", "learn", "n_tokens", "n_known", "base_score", "score"]

    def score(raw, at, words, counts):
        for a, b in slices(at, 1 << 20):
            tokens, first = token_ids(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            c = np.zeros(len(tokens))
            if len(words):
                i = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
                c = np.where(words[i] == tokens, counts[i], 0).astype(np.float64)
            value = token_scores(model, tokens, first, c)
            n = np.diff(first)
            base = np.add.reduceat(np.log10(c + 1), first[:-1]) - n * np.log10(model.train_tokens + model.distinct + 1)
            yield n, np.add.reduceat((c > 0).astype(np.int64), first[:-1]), base, np.add.reduceat(value, first[:-1])

    def run(batches):
        """Rows by bucket, then kind: the bucket's dictionary (kind 0), then its documents (kind 1)."""
        now, parts, words, counts = None, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            bucket, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cut = runs(bucket.astype(np.int64) * 2 + kind)
            for r in range(len(cut) - 1):
                a, b = int(cut[r]), int(cut[r + 1])
                if now != bucket[a]:
                    now, parts, words, counts = bucket[a], [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    parts.append([rows.column(i).flatten().to_numpy(zero_copy_only=False) for i in (5, 6)])
                    continue
                if parts:
                    words, counts = (np.concatenate(x) for x in zip(*parts))  # noqa: B905
                    order = np.argsort(words.view(np.uint64))
                    words, counts, parts = words.view(np.uint64)[order], counts[order], []
                raw, at = string_buffers(rows.column(4))
                done = list(score(raw, at, words, counts))
                cols = [np.concatenate(x) for x in zip(*done)]  # noqa: B905
                yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(3), *map(pa.array, cols)], names)

    return run


def fit(docs: DataFrame, learn) -> tuple[DataFrame, DataFrame, LanguageModel]:
    """The rows by bucket, the counts of their words, and the model learned from the rows where learn holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", learn.alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).cast("int"))
    words = count_words(rows)
    release(spark)
    model = train(rows, model_of(words))
    release(spark)
    return rows, words, model


def score_rows(rows: DataFrame, words: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, base_score, score, train_tokens for each row."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["doc_id"].dataType
    none = lambda t: F.lit(None).cast(t)
    left = words.where("bucket >= 0").select("bucket", F.lit(0).alias("kind"), none(kind).alias("doc_id"), none("boolean").alias("learn"), none("string").alias("text"), "hs", "cs")
    right = rows.select("bucket", F.lit(1).alias("kind"), "doc_id", "learn", "text", none("array<long>").alias("hs"), none("array<long>").alias("cs"))
    both = left.unionByName(right).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    scored = both.mapInArrow(_scorer(model), f"doc_id {kind.simpleString()}, learn boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))


def score_texts(docs: DataFrame, learn) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) for each row.

    Null and empty texts are the end token alone; a null doc_id is learned from as its empty text's crc32 says; rows
    that repeat count as often as they are there; an empty table gives no rows.
    """
    return score_rows(*fit(docs, learn))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a model of those whose crc32(doc_id) mod 7 is not 2; nulls, ties and empty tables as in score_texts."""
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out(7, 2))
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
