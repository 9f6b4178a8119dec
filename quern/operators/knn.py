"""Nearest neighbours: exact, by record, quantised in two phases, and similarity joins by tiles.

Batches of vectors are scored with one numpy product each and cut to their own best k before anything is shuffled, so a
search moves k rows a batch. A join compares tiles of vectors, in memory of two tiles, and gives the pairs over a threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_matrix, cosine, encode_int8, hamming, hashed_embedding, sign_words, unit_rows
from ..shared import new_path

TILE = 2048
BLOCK = 16_384  # queries that a task holds with their best rows
HELD = 250_000  # vectors that a task sorts, as far as tasks can be as many


def _batch_top(key: str, queries: np.ndarray, k: int | None, least: float | None):
    unit = unit_rows(np.asarray(queries, np.float64))

    def run(batches):
        for batch in batches:
            m = unit_rows(as_matrix(batch.column(1)))
            if not len(m):
                continue
            sims = m @ unit.T
            rows, qs, scores = [], [], []
            for q in range(len(unit)):
                s = sims[:, q]
                at = np.arange(len(s)) if least is None else np.flatnonzero(s >= least)
                if k is not None and len(at) > k:
                    edge = np.partition(s[at], len(at) - k)[len(at) - k]
                    at = at[s[at] >= edge]  # ties at the edge stay; the final order is by score, then key
                rows.append(at)
                qs.append(np.full(len(at), q))
                scores.append(s[at])
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs), pa.int32()), batch.column(0).take(take), pa.array(np.concatenate(scores))], ["query", key, "score"])

    return run


def search(df: DataFrame, key: str, vector: str, queries: list, k: int | None = None, least: float | None = None, exclude: list | None = None) -> DataFrame:
    """query, key, score, rank: for each query vector its nearest rows by cosine, ties by key; null vectors are no rows."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(vector).isNotNull()).select(key, vector)
    if exclude:
        rows = rows.where(~F.col(key).isin(exclude))
    got = rows.mapInArrow(_batch_top(key, np.array(queries, np.float64), k, least), f"query int, {key} {kind}, score double")
    if k is None:
        return got
    order = [F.col("score").desc(), F.col(key).asc()]
    if len(queries) == 1:
        return got.orderBy(*order).limit(k)
    best = got.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k")))), 1, k).alias("top"))
    return best.select("query", F.posexplode("top").alias("rank", "t")).select("query", F.col("t.k").alias(key), (-F.col("t.s")).alias("score"), "rank")


def search_set(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query, key, score, rank: the k nearest rows of each query (query, vector), ties by key; for query sets of any size.

    Null vectors are no rows and no queries. The work is that of all queries against all rows, as the search is exact.
    """
    none = F.lit(0).alias("cell")
    asked = queries.where(F.col("vector").isNotNull()).select(none, "query", F.col("vector").alias("v"))
    rows = df.where(F.col(vector).isNotNull()).select(none, key, F.col(vector).alias("v"))
    return best_pairs(asked, rows, key, k, [(asked.count(), rows.count())], block)


def _grid(queries: int, rows: int, units: float, block: int) -> tuple[int, int]:
    """Into how many blocks the queries and slices the rows of a cell go: about `units` tasks that move least together.

    A query goes to each slice and brings k rows back, about twice what a row takes, which goes to each block.
    """
    blocks = max(1, -(-queries // block), min(round(math.sqrt(2 * units * queries / max(rows, 1))), -(-queries // 256)))
    return blocks, max(1, min(math.ceil(units / blocks), -(-rows // 1024)))


def best_pairs(asked: DataFrame, rows: DataFrame, key: str, k: int, sizes: list[tuple[int, int]], block: int = BLOCK, least: float = -math.inf, more: tuple[str, ...] = (), allowed=None) -> DataFrame:
    """query, key, score, rank: of each query (cell, query, v, more) the best k rows (cell, key, v, more) of its cells, ties by key.

    sizes: the queries and rows of each cell, by its number. The queries of a cell go in blocks of about `block` at most, its rows
    in slices; each block meets each slice once, in a task that holds the block and its best k while rows stream by. How
    many there are goes by the work of a cell, not by the number of partitions alone: two tasks a partition, so what is
    moved grows with the input until blocks are full. least and allowed say which pairs count at all: allowed gets keys
    and `more` columns, as (values, valid) pairs, of both sides of pairs.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = sum(q * r for q, r in sizes) or 1
    grid = [_grid(q, r, 2 * n * q * r / work, block) for q, r in sizes]
    first = np.cumsum([0] + [b * s for b, s in grid])
    of = lambda values: F.get(F.array(*(F.lit(int(v)) for v in values)), F.col("cell"))
    blocks, slices, start = of(b for b, _ in grid), of(s for _, s in grid), of(first[:-1])
    kind, by = rows.schema[key].dataType, asked.schema["query"].dataType
    spread = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), m - 1)).alias("_to")
    left = asked.select("*", each(slices)).select((start + spread("query", blocks) * slices + F.col("_to")).alias("unit"), F.lit(0).alias("side"), F.col("query").alias("q"), F.lit(None).cast(kind).alias("k"), "v", *more)
    right = rows.select("*", each(blocks)).select((start + F.col("_to") * slices + spread(key, slices)).alias("unit"), F.lit(1).alias("side"), F.lit(None).cast(by).alias("q"), F.col(key).alias("k"), F.col("v").cast(asked.schema["v"].dataType).alias("v"), *more)
    moved = sum(q * s + r * b for (q, r), (b, s) in zip(sizes, grid, strict=True))
    n = max(n, min(int(first[-1]), moved // HELD))
    dealt = left.unionByName(right).repartitionById(n, F.col("unit") % n).sortWithinPartitions("unit", "side")
    got = dealt.mapInArrow(_block_best(key, k, least, allowed), f"query {by.simpleString()}, {key} {kind.simpleString()}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(key).asc()))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query", key, "score", (F.col("rank") - 1).alias("rank"))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, whole numbers as such, and which of them are there."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return (column.fill_null(0) if pa.types.is_integer(column.type) else column).to_numpy(zero_copy_only=False), valid


class _Best:
    """The best k rows of each query of a block, fed with rows bit by bit.

    Products in single precision find the rows that may be among them; only these are scored in double precision, each
    pair by itself, so equal vectors have equal scores wherever they stand and ties go by key.
    """

    STEP = 2048  # queries and rows of a product
    PIECE = 65_536  # pairs scored at once

    def __init__(self, parts: list[tuple], k: int, least: float, allowed):
        self.ids = pa.concat_arrays([p[0] for p in parts])
        self.unit = np.concatenate([p[1] for p in parts])
        self.more = [tuple(np.concatenate(x) for x in zip(*c, strict=True)) for c in zip(*(p[2] for p in parts), strict=True)]
        self.own = self.ids.to_numpy(zero_copy_only=False)
        self.single = self.unit.astype(np.float32)
        self.k, self.least, self.allowed = k, least, allowed
        self.score = np.full((len(self.unit), k), -np.inf)
        self.names = None

    def feed(self, m: np.ndarray, names: np.ndarray, more: list[tuple]) -> None:
        if self.names is None:
            self.names = np.full(self.score.shape, names[0], names.dtype)
        single, slack = m.astype(np.float32), 1.2e-7 * (m.shape[1] + 16)  # more than a product in single precision can be off
        for a in range(0, len(self.unit), self.STEP):
            for b in range(0, len(m), self.STEP):
                s = self.single[a : a + self.STEP] @ single[b : b + self.STEP].T
                edge = np.maximum(self.score[a : a + self.STEP, -1], self.least) - slack
                if self.allowed is None and s.shape[1] > self.k and np.isneginf(self.score[a : a + self.STEP, -1]).any():
                    edge = np.maximum(edge, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - 2 * slack)
                x, y = np.divmod(np.flatnonzero(s >= edge.astype(np.float32)[:, None]), s.shape[1])
                x, y = x + a, y + b
                if self.allowed is not None:
                    keep = self.allowed(self.own[x], [(v[x], w[x]) for v, w in self.more], names[y], [(v[y], w[y]) for v, w in more])
                    x, y = x[keep], y[keep]
                if len(x):
                    self._merge(x, np.concatenate([(self.unit[x[i : i + self.PIECE]] * m[y[i : i + self.PIECE]]).sum(1) for i in range(0, len(x), self.PIECE)]), names[y])

    def _merge(self, x: np.ndarray, score: np.ndarray, names: np.ndarray) -> None:
        keep = score >= np.maximum(self.score[x, -1], self.least)
        x, score, names = x[keep], score[keep], names[keep]
        if not len(x):
            return
        u = np.unique(x)
        at, score, names = np.concatenate([np.repeat(u, self.k), x]), np.concatenate([self.score[u].ravel(), score]), np.concatenate([self.names[u].ravel(), names])
        order = np.lexsort((names, -score, at))
        start = np.searchsorted(at[order], u)
        order = order[(start[:, None] + np.arange(self.k)).ravel()]
        self.score[u], self.names[u] = score[order].reshape(-1, self.k), names[order].reshape(-1, self.k)

    def found(self, key: str, kind: pa.DataType):
        if self.names is not None:
            x, y = np.nonzero(~np.isneginf(self.score))
            for i in range(0, len(x), self.PIECE):
                p, q = x[i : i + self.PIECE], y[i : i + self.PIECE]
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(p)), pa.array(self.names[p, q], kind), pa.array(self.score[p, q])], ["query", key, "score"])


def _block_best(key: str, k: int, least: float = -math.inf, allowed=None):
    """The best k rows of each query, of batches (unit, side, q, k, v, more) sorted by unit and side: queries first, rows after them."""

    def run(batches):
        now, parts, best, kind = None, [], None, None
        for batch in batches:
            kind = batch.schema.types[3]
            at = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
            cut = [0, *(np.flatnonzero(np.any(at[1:] != at[:-1], axis=1)) + 1).tolist(), len(at)]
            for a, b in zip(cut[:-1], cut[1:]):  # noqa: B905
                if a == b:
                    continue
                if now != at[a, 0]:
                    if best is not None:
                        yield from best.found(key, kind)
                    now, parts, best = at[a, 0], [], None
                part = batch.slice(a, b - a)
                m = unit_rows(as_matrix(part.column(4)))
                more = [_values(c) for c in part.columns[5:]]
                if at[a, 1] == 0:
                    parts.append((part.column(2), m, more))
                elif parts:
                    best = best or _Best(parts, k, least, allowed)
                    fine = np.isfinite(m).all(axis=1)
                    if fine.any():
                        best.feed(m[fine], part.column(3).to_numpy(zero_copy_only=False)[fine], [(v[fine], w[fine]) for v, w in more])
        if best is not None:
            yield from best.found(key, kind)

    return run


def vector_of(df: DataFrame, key: str, vector: str, value: object) -> list[float]:
    """The vector of one row; KeyError where it has none."""
    row = df.where(F.col(key) == F.lit(value)).select(vector).first()
    if row is None or row[0] is None:
        raise KeyError(value)
    return [float(x) for x in row[0]]


def by_id(df: DataFrame, key: str, vector: str, value: object, k: int | None = None, least: float | None = None) -> DataFrame:
    """Neighbours of a row, without itself."""
    return search(df, key, vector, [vector_of(df, key, vector, value)], k, least, exclude=[value]).select(key, "score")


def embed(texts: DataFrame, key: str, text: str, model=None, dims: int = 64) -> DataFrame:
    """key, vector: batches through model(list of texts) -> matrix; hashed word counts where none is given."""
    model = model or (lambda ts: hashed_embedding(ts, dims))

    def run(batches):
        for batch in batches:
            m = np.asarray(model(batch.column(1).to_pylist()), np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * (m.shape[1] if len(m) else 0), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], [key, "vector"])

    return texts.select(key, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, vector array<float>")


def two_phase_binary(df: DataFrame, key: str, vector: str, query: list[float], k: int, widen: int = 8) -> DataFrame:
    """The best k by cosine of the widen * k nearest by the Hamming distance of sign bits (ties by key)."""
    dims = len(query)
    bits = F.array(*(F.lit(w) for w in _signs(query)))
    coarse = df.select(key, vector, hamming(sign_words(F.col(vector), dims), bits).alias("_d")).orderBy("_d", key).limit(widen * k)
    return _exact(coarse, key, vector, query, k)


def _signs(query: list[float]) -> list[int]:
    out = []
    for a in range(0, len(query), 64):
        word = sum(1 << i for i, x in enumerate(query[a : a + 64]) if x > 0)
        out.append(word - (1 << 64) if word >> 63 else word)
    return out


def _lit(query: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def _exact(coarse: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    return coarse.select(key, cosine(F.col(vector), _lit(query)).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def bounds(df: DataFrame, vector: str, dims: int) -> tuple[list[float], list[float]]:
    """The least and greatest value of each dimension: one row of 2 * dims numbers."""
    row = df.agg(*(F.min(F.get(vector, F.lit(i))).alias(f"l{i}") for i in range(dims)), *(F.max(F.get(vector, F.lit(i))).alias(f"h{i}") for i in range(dims))).first()
    return [float(row[i] or 0) for i in range(dims)], [float(row[dims + i] or 0) for i in range(dims)]


def two_phase_int8(df: DataFrame, key: str, vector: str, query: list[float], k: int, widen: int = 4) -> DataFrame:
    """The best k by cosine of the widen * k with the largest product of 8-bit codes (ties by key)."""
    low, high = bounds(df, vector, len(query))
    own = encode_int8(_lit(query), low, high)
    product = F.aggregate(F.zip_with(encode_int8(F.col(vector), low, high), own, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)
    coarse = df.select(key, vector, product.alias("_p")).orderBy(F.col("_p").desc(), key).limit(widen * k)
    return _exact(coarse, key, vector, query, k)


def rerank_mrl(df: DataFrame, key: str, vector: str, query: list[float], k: int, dims: int, share: float = 0.7, widen: int = 4) -> DataFrame:
    """The widen * k nearest, ordered by share of the full cosine and the rest of that over the first dims dimensions."""
    full = cosine(F.col(vector), _lit(query))
    coarse = df.select(key, vector, full.alias("_full")).orderBy(F.col("_full").desc(), key).limit(widen * k)
    short = cosine(F.slice(vector, 1, dims), _lit(query[:dims]))
    return coarse.select(key, (share * F.col("_full") + (1 - share) * short).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def similarity_join(df: DataFrame, key: str, vector: str, least: float, by: str | None = None, tile: int = TILE) -> DataFrame:
    """a, b, score (a < b) of pairs with cosine >= least; by: a column that both must share.

    Exact. Rows are dealt to tiles of about `tile` rows of one group, and of up to eight times as many where a group has more
    tiles than its pairs need to give each partition two tasks, as a row goes to every tile; a pair of tiles is one task's
    product, in memory of two tiles, and gives only pairs over the threshold. A group of any size is spread over its tile pairs.
    """
    spark = df.sparkSession
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"), group.alias("g"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.count(F.lit(1))
    sizes = rows.groupBy("g").agg(F.greatest(F.ceil(size / (8 * tile)), F.least(F.ceil(size / tile), F.lit(math.ceil(2 * math.sqrt(n))))).alias("tiles"))
    dealt = rows.join(sizes, "g").withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda u: F.struct(F.least(F.col("t"), u).alias("i"), F.greatest(F.col("t"), u).alias("j")))
    sent = dealt.select("g", "t", "key", "vector", F.explode(others).alias("p")).select(F.concat_ws(":", "p.i", "p.j", "g").alias("pair"), (F.col("t") == F.col("p.j")).cast("int").alias("side"), "key", "vector", (F.col("p.i") == F.col("p.j")).alias("own"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        held: list = []

        def close():
            table = pa.Table.from_batches(held)
            side = table.column("side").to_numpy()
            m = unit_rows(as_matrix(table.column("vector")))
            keys = table.column("key").combine_chunks()
            own = table.column("own")[0].as_py()
            left = np.arange(len(side)) if own else np.flatnonzero(side == 0)
            right = left if own else np.flatnonzero(side == 1)
            for a in range(0, len(left), 512):
                x, y = np.nonzero((s := m[left[a : a + 512]] @ m[right].T) >= least)
                score, i, j = s[x, y], left[a + x], right[y]
                if own:
                    keep = i < j
                    score, i, j = score[keep], i[keep], j[keep]
                if len(i):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), keys.take(pa.array(j)), pa.array(score)], ["a", "b", "score"])

        now = None
        for batch in batches:
            pairs = batch.column(0).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(pairs[1:] != pairs[:-1]) + 1).tolist(), len(pairs)] if len(pairs) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if now is not None and now != pairs[a]:
                    yield from close()
                    held = []
                now = pairs[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    got = sent.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(run, f"a {kind}, b {kind}, score double")
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def fit_cells(df: DataFrame, vector: str, cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of cells by spherical k-means over at most `sample` vectors, which is all that comes to the driver.

    The sample only places the centres; build_cells puts every row into a cell. Fewer distinct vectors give fewer cells.
    """
    n = df.where(F.col(vector).isNotNull()).count()
    drawn = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))
    if n > sample:
        drawn = drawn.orderBy(F.xxhash64("v", F.lit(seed))).limit(sample)
    m = np.array([r["v"] for r in drawn.collect()], np.float64)
    if not len(m):
        return np.zeros((0, 0))
    m = np.unique(unit_rows(m), axis=0)
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(filled[:, None], unit_rows(sums), centres)
    return centres


def build_cells(df: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """key, vector, cell: an index of every row with a vector, stored by the cell of its nearest centre; searches read the cells they probe."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            m = unit_rows(as_matrix(batch.column(1)))
            own = np.argmax(m @ centres.T, axis=1) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32())], [key, vector, "cell"])

    placed = df.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {kind}, {vector} {df.schema[vector].dataType.simpleString()}, cell int")
    path = new_path(spark, "cells")
    placed.write.partitionBy("cell").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def search_cells(index: DataFrame, key: str, vector: str, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 32, block: int = BLOCK) -> DataFrame:
    """query, key, score, rank: the k nearest of the rows in the `probes` cells nearest each query (query, vector); ties by key.

    Each query goes to its cells and meets their rows there, in the tasks of best_pairs: a large cell is many tasks, a
    small one few. As many probes as centres give the exact result.
    """
    spark, of = index.sparkSession, queries.schema["query"].dataType.simpleString()
    kind = index.schema[key].dataType.simpleString()
    probes = min(probes, len(centres))

    def send(batches):
        for batch in batches:
            m = unit_rows(as_matrix(batch.column(1)))
            near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes] if len(m) else np.zeros((0, probes), np.int64)
            take = pa.array(np.repeat(np.arange(len(m)), probes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(near.ravel(), pa.int32())], ["query", "v", "cell"])

    if not probes:
        return spark.createDataFrame([], f"query {of}, {key} {kind}, score double, rank int")
    v = queries.schema["vector"].dataType.simpleString()
    asked = queries.where(F.col("vector").isNotNull()).select("query", "vector").mapInArrow(send, f"query {of}, v {v}, cell int")
    asks, holds = (dict(df.groupBy("cell").count().collect()) for df in (asked, index))  # a row for each cell
    sizes = [(asks.get(c, 0), holds.get(c, 0)) for c in range(len(centres))]
    rows = index.where(F.col("cell").isin(sorted(asks))).select("cell", key, F.col(vector).alias("v"))
    return best_pairs(asked.select("cell", "query", "v"), rows, key, k, sizes, block)


def recall_of(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row, recall: the share of the exact neighbours (query, key) that a search found."""
    hit = exact.select("query", key).join(found.select("query", key, F.lit(1).alias("hit")), ["query", key], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def missing_vectors(records: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Records that have no vector yet."""
    return records.join(vectors.select(key), key, "left_anti")
