"""Substring deduplication by seed and extend: words of long passages that an earlier document already has are removed.

A passage is a window of 13 words. Documents are seeded with winnowed anchors: of each window's nine 5-word grams the one
with the smallest hash, so equal windows have an equal anchor at an equal place. Documents are joined on anchors, and where
two share one, each occurrence is extended by 8 words both ways, which covers every window around it. Occurrences with the
same words on both sides are one group, represented by its first document. Representatives of an anchor that differ are
compared word by word in both directions, and the longest extension that an earlier document has is kept. Extensions of
neighbouring anchors overlap, and together are the maximal repeats of 13 words and more.

The surroundings of an anchor travel once, as hashes of their words, to the task that groups and compares all of them. Anchors
with more than 64 occurrences, in one document or in many, are not compared pair by pair: their occurrences are grouped by a
digest first, and the representatives' extensions of 13 words are grouped by their words, which gives the same, and grows with
their number alone. Anchors are 64-bit hashes and only bring documents together; words are compared by 64-bit hashes of
their own (an anchor's five by one hash more), digests are 128 bits of SHA-256, and windows have 128 bits made of word hashes. Nothing holds an unbounded group in
memory: groups are bounded or partial aggregates, and joins deal the rows of a frequent key to several tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, mix, release, slices, split_join, string_buffers, word_hashes, word_spans, written

WINDOW = 13
ANCHOR = 5
REACH = WINDOW - ANCHOR
MANY = 64  # occurrences of an anchor that are compared pair by pair
WIDTH = 2 * REACH + 1  # the words around an anchor, and between them one hash of its own
_C = np.uint64(0xD6E8FEB86659FD93)
_ODD = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def _gram(w: np.ndarray, k: int) -> np.ndarray:
    h = w[: len(w) - k + 1].copy()
    for j in range(1, k):
        h *= _C
        h += w[j : len(w) - k + 1 + j]
    return mix(h)


def anchors_of(starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (among all words) and hashes of the anchors of all windows that lie in one value."""
    n = len(starts) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = _gram(word_hashes(raw, starts, ends), ANCHOR)
    two = np.minimum(gram[:-1], gram[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    least = np.minimum(eight[:n], gram[REACH : REACH + n])
    i = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    at = np.full(len(i), -1)
    for k in range(REACH, -1, -1):  # the leftmost of equals stays
        at[gram[i + k] == least[i]] = k
    places = np.unique(i + at)
    return places, gram[places]


def _seeds(batches):
    """Each document's anchors, and their places among its words."""
    for batch in batches:
        raw, at = string_buffers(batch.column(2))
        for a, b in slices(at):
            own = raw[at[a] : at[b]]
            starts, ends, doc = word_spans(own, at[a : b + 1] - at[a])
            places, h = anchors_of(starts, ends, doc, own)
            take = pa.array(doc[places] + a)
            inside = places - np.searchsorted(doc, np.arange(b - a))[doc[places]]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(inside.astype(np.int32))], ["h", "doc_id", "mark", "place"])


def _located(batches):
    """For rows (doc_id, mark, text, hs), a slice of the documents at a time: the bytes, the words' starts and ends, and of each
    anchor in hs the row, the hash, the place among those words, and where its document's words begin and end."""
    for batch in batches:
        raw, at = string_buffers(batch.column(2))
        lists = batch.column(3)
        where, (h, inside) = lists.offsets.to_numpy(), (lists.values.field(k).to_numpy() for k in range(2))
        for a, b in slices(at, 1 << 20):
            own = raw[at[a] : at[b]]
            starts, ends, doc = word_spans(own, at[a : b + 1] - at[a])
            of = np.repeat(np.arange(b - a), np.diff(where[a : b + 1]))
            if not len(of):
                continue
            first, last = (np.searchsorted(doc, np.arange(b - a), side)[of] for side in ("left", "right"))
            k = slice(where[a], where[b])
            yield batch, own, starts, ends, of + a, h[k], first + inside[k], first, last


def _surroundings(batches):
    """Occurrences of anchors with the hashes of the words from 8 before to 8 after, 0 where the text begins or ends."""
    names, steps = ["h", "doc_id", "mark", "place", "around"], np.concatenate((np.arange(-REACH, 1), np.arange(ANCHOR, ANCHOR + REACH)))
    for batch, own, starts, ends, of, h, places, first, last in _located(batches):
        w = word_hashes(own, starts, ends) | np.uint64(1)
        for i in range(0, len(places), 20_000):
            k = slice(i, i + 20_000)
            p = places[k]
            at = p[:, None] + steps
            there = (at >= first[k][:, None]) & (at < last[k][:, None])
            grid = np.where(there, w[np.clip(at, 0, len(w) - 1)], np.uint64(0))
            for j in range(1, ANCHOR):
                grid[:, REACH] = mix(grid[:, REACH] * _C ^ w[p + j])
            rows = pa.array(of[k])
            around = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(np.arange(0, 8 * WIDTH * len(p) + 1, 8 * WIDTH, dtype=np.int32)), pa.py_buffer(grid)])
            yield pa.RecordBatch.from_arrays([pa.array(h[k]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((p - first[k]).astype(np.int32)), around], names)


def _strings(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Pieces of raw, which may overlap, as a string column."""
    where = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(starts - where[:-1], sizes) + np.arange(where[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(where.astype(np.int32)), pa.py_buffer(raw[at]))


def _extended(batches):
    """Occurrences of anchors with the words from 8 before to 8 after, for rows (doc_id, mark, text, hs).

    before is the number of words before the anchor, n of all, start the first one's place in the text.
    """
    names = ["doc_id", "mark", "start", "before", "n", "words"]
    for batch, own, starts, ends, of, _, places, first, last in _located(batches):
        sizes = ends - starts
        to = np.cumsum(sizes + 1) - sizes - 1  # where each word stands when all are joined by one blank
        joined = np.full(int(to[-1] + sizes[-1]), 32, np.uint8)
        letters = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        joined[letters + np.repeat(to - starts, sizes)] = own[letters]
        lo, hi = np.maximum(first, places - REACH), np.minimum(last, places + ANCHOR + REACH)
        for i in range(0, len(places), 20_000):
            k = slice(i, i + 20_000)
            rows = pa.array(of[k])
            words = _strings(joined, to[lo[k]], to[hi[k] - 1] + sizes[hi[k] - 1] - to[lo[k]])
            ints = [pa.array(x.astype(np.int32)) for x in (lo[k] - first[k], places[k] - lo[k], hi[k] - lo[k])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *ints, words], names)


def _stretches(h, doc, mark, place, grid):
    """Of whole runs of occurrences of anchors: the stretch of words (a, b) around each that an earlier document has."""
    around = mix((grid * _ODD).sum(axis=1, dtype=np.uint64))
    order = np.lexsort((doc, around, h))
    h, doc, mark, place, grid, around = (x[order] for x in (h, doc, mark, place, grid, around))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1]) | (grid[1:] != grid[:-1]).any(axis=1)
    group, rep = np.cumsum(new) - 1, np.flatnonzero(new)
    whole = doc > doc[rep][group]
    by_first = np.lexsort((doc[rep], h[rep]))
    key, first, words = h[rep][by_first], doc[rep][by_first], grid[rep][by_first]
    before, after = np.full(len(rep), -1), np.full(len(rep), -1)
    at, step = np.arange(len(rep)), 1
    while len(at := at[at + step < len(rep)]) and len(at := at[key[at] == key[at + step]]):
        i = at[first[at] < first[at + step]]
        i = i[words[i, REACH] == words[i + step, REACH]]
        same = (words[i] == words[i + step]) & (words[i] != 0)
        left = np.cumprod(same[:, REACH - 1 :: -1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
        right = np.cumprod(same[:, REACH + 1 :], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
        long_ = left + right >= REACH
        i, left, right = i[long_] + step, left[long_], right[long_]
        before[i] = np.maximum(before[i], left)
        after[i] = np.maximum(after[i], right)
        step += 1
    left, right = np.empty_like(before), np.empty_like(after)
    left[by_first], right[by_first] = before, after
    left = np.where(whole, (grid[:, :REACH] != 0).sum(axis=1), left[group])
    right = np.where(whole, (grid[:, REACH + 1 :] != 0).sum(axis=1), right[group])
    own = np.flatnonzero(left >= 0)
    ints = [pa.array(x[own].astype(np.int32)) for x in (mark, place - left, place + ANCHOR + right)]
    return pa.RecordBatch.from_arrays([pa.array(doc[own]), *ints], ["doc_id", "mark", "a", "b"])


def _compared(batches):
    """Stretches (doc_id, mark, a, b) from rows (h, doc_id, mark, place, around) by h; a run has MANY rows at most."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, _ = string_buffers(batch.column(4))
        held.append([*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)), raw.view(np.uint64).reshape(-1, WIDTH)])
        n += batch.num_rows
        if n < 1 << 16:
            continue
        now = [np.concatenate(x) for x in zip(*held)]  # noqa: B905
        last = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
        if last:
            yield _stretches(*(x[:last] for x in now))
        held, n = [[x[last:] for x in now]], len(now[0]) - last
    if held:
        yield _stretches(*(np.concatenate(x) for x in zip(*held)))  # noqa: B905


def _windows(batches):
    """The windows of 13 words of rows (key, first, words): their place, and 128 bits made of their words' hashes."""
    for batch in batches:
        raw, at = string_buffers(batch.column(2))
        starts, ends, row = word_spans(raw, at)
        n = len(starts) - WINDOW + 1
        if n < 1:
            continue
        w = word_hashes(raw, starts, ends)
        i = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
        both = np.stack([_gram(w, WINDOW)[i], _gram(mix(w ^ _C), WINDOW)[i]], axis=1)
        take = pa.array(row[i])
        part = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(np.arange(0, 16 * len(i) + 1, 16, dtype=np.int32)), pa.py_buffer(both)])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((i - np.searchsorted(row, row[i])).astype(np.int32)), part], ["key", "first", "place", "part"])


def _strip(batches):
    """n_words, n_removed and the kept words for each row (doc_id, text, spans, copy)."""
    for batch in batches:
        raw, at = string_buffers(batch.column(1))
        data, counts, removed, kept = raw.tobytes(), [], [], []
        for a, b, spans, copy in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(2), batch.column(3).to_pylist()):  # noqa: B905
            words = data[a:b].split()
            counts.append(len(words))
            if copy and len(words) >= WINDOW:
                removed.append(len(words))
                kept.append(b"")
            elif spans.is_valid and len(spans):
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, spans.values.field(0).to_numpy(), 1)
                np.add.at(edge, spans.values.field(1).to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
            else:
                removed.append(0)
                kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _dealt(docs: DataFrame) -> DataFrame:
    """doc_id, mark, same, text as a table bucketed by the first two: texts are dealt out once, and every later join finds them in place.

    The mark is 0 but where rows share a doc_id; it tells those apart. same and same_too are hashes of the text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", F.lit(True).alias("repeated")), "repeated")
    marked = rows.join(repeated, "doc_id", "left").select("doc_id", F.when(F.col("repeated"), F.hash("text")).otherwise(0).alias("mark"), F.xxhash64("text").alias("same"), F.xxhash64(F.lit(1), "text").alias("same_too"), "text")
    name = f"texts_{uuid.uuid4().hex}"
    marked.repartition(n, "doc_id", "mark").write.format("parquet").option("compression", "zstd").bucketBy(n, "doc_id", "mark").saveAsTable(name)
    release(spark)
    return spark.table(name)


def _later_copies(known: DataFrame) -> DataFrame:
    """doc_id, mark, copy of rows whose whole text a smaller doc_id has: their windows all are repeats, and make none that the first lacks."""
    keys = known.select("doc_id", "mark", "same", "same_too")
    first = written(keys.groupBy("same", "same_too").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    later = split_join(keys, first, ["same", "same_too"], "n", "doc_id").where("doc_id > first")
    copies = written(later.select("doc_id", "mark", F.lit(True).alias("copy")).distinct(), "copies")
    discard(first)
    return copies


def _shared_seeds(known: DataFrame) -> DataFrame:
    """doc_id, mark, few, many: the anchors of each row, and their places, that a row with another doc_id has too; many: with many occurrences."""
    seeds = written(known.select("doc_id", "mark", "text").mapInArrow(_seeds, "h long, doc_id long, mark int, place int"), "seeds")
    shared = seeds.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("h", "n", (F.col("n") > MANY).alias("frequent"))
    shared = written(shared, "shared")
    release(known.sparkSession)
    both = split_join(seeds, shared, ["h"], "n", "doc_id", "place")
    seed = F.struct("h", "place")
    lists = both.groupBy("doc_id", "mark").agg(F.collect_list(F.when(~F.col("frequent"), seed)).alias("few"), F.collect_list(F.when(F.col("frequent"), seed)).alias("many"))
    lists = written(lists, "anchors")
    discard(seeds, shared)
    return lists


def _digest(words: Column) -> Column:
    return F.substring(F.unhex(F.sha2(words, 256)), 1, 16)


def _with_anchors(rows: DataFrame, shared: DataFrame, which: str) -> DataFrame:
    found = shared.where(F.size(which) > 0).select("doc_id", "mark", F.col(which).alias("hs"))
    return rows.join(found.hint("shuffle_hash"), ["doc_id", "mark"]).select("doc_id", "mark", "text", "hs")


def _few(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, mark, a, b: stretches around anchors of few occurrences."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _with_anchors(rows, shared, "few").mapInArrow(_surroundings, "h long, doc_id long, mark int, place int, around binary")
    few = written(found.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_compared, "doc_id long, mark int, a int, b int"), "few")
    release(rows.sparkSession)
    return few


def _many(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, mark, a, b: stretches around anchors of many occurrences."""
    found = _with_anchors(rows, shared, "many").mapInArrow(_extended, "doc_id long, mark int, start int, before int, n int, words string")
    found = written(found.withColumn("key", _digest(F.concat_ws(" ", "before", "words"))), "extended")
    release(rows.sparkSession)
    groups = written(found.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.first("words").alias("words")), "groups")  # words are equal in all of a group
    parts = groups.select("key", "first", "words").mapInArrow(_windows, "key binary, first long, place int, part binary")
    parts = written(parts, "parts")
    least = parts.groupBy("part").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("part", "least", "n")
    least = written(least, "least")
    late = split_join(parts, least, ["part"], "n", "key").where("least < first")
    late = late.groupBy("key").agg(F.min("place").alias("lo"), (F.max("place") + WINDOW).alias("hi"))  # all parts hold the anchor, so late ones join
    verdicts = written(groups.select("key", "first", "rows").join(late, "key", "left").where("rows > 1 OR lo IS NOT NULL"), "verdicts")
    discard(groups, parts, least)
    release(rows.sparkSession)
    own = split_join(found.select("doc_id", "mark", "start", "n", "key"), verdicts, ["key"], "rows", "doc_id", "start")
    whole = F.col("doc_id") > F.col("first")
    ends = own.where(whole | F.col("lo").isNotNull()).select("doc_id", "mark", (F.col("start") + F.when(whole, 0).otherwise(F.col("lo"))).alias("a"), (F.col("start") + F.when(whole, F.col("n")).otherwise(F.col("hi"))).alias("b"))
    many = written(ends, "many")
    discard(found, verdicts)
    return many


def _repeats(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, mark, spans: stretches of words (start, end) around anchors that an earlier document has."""
    few, many = _few(rows, shared), _many(rows, shared)
    spans = written(few.unionByName(many).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "repeats")
    discard(few, many)
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row of docs.

    Null texts have no words; a null doc_id is neither smaller nor larger than any, so its words stay and remove
    none; rows that repeat a doc_id don't remove each other's words; an empty table gives no rows. Of equal texts only
    those with the smallest doc_id are searched. doc_id is a whole number.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _dealt(docs)
    copies = _later_copies(rows.where("doc_id IS NOT NULL"))
    release(spark)
    known = rows.where("doc_id IS NOT NULL").join(copies.hint("shuffle_hash"), ["doc_id", "mark"], "left_anti")
    shared = _shared_seeds(known)
    release(spark)
    spans = _repeats(rows, shared)
    discard(shared)
    release(spark)
    both = rows.join(spans.hint("shuffle_hash"), ["doc_id", "mark"], "left").join(copies.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    return both.mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept string").withColumn("doc_id", F.col("doc_id").cast(kind))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has; nulls, ties and repeated ids as in remove_repeats."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
x AS (SELECT p.doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM p JOIN d USING (doc_id)),
m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x JOIN m USING (s) WHERE least < x.doc_id),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT u.doc_id, count(*) AS n, string_agg(w[u.i], ' ' ORDER BY u.i) AS kept FROM u JOIN d USING (doc_id) LEFT JOIN r ON r.doc_id = u.doc_id AND r.i = u.i WHERE r.i IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
