"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

Fingerprints are dealt to tiles by their population count, tile pairs whose counts differ beyond the radius are skipped,
and those that are left are compared all with all: numpy exclusive-or and bit counts, in blocks sorted by population
count, of which again those too far apart are skipped. Small radii get their tiles inside buckets: of radius + 2 bit
blocks, two fingerprints within the radius agree on at least two, so each pair of blocks is a bucket key and no link is
lost. Larger radii get tiles over ranges of population counts, which is exact and grows with the square of the
fingerprints; or, for wide sketches of whole corpora, tiles inside buckets of banded minima of the shingle hashes
(`bands`), which texts of a similarity of 0.8 fail to share about once in a million pairs. A bucket that one tile holds
is one tile. A tile pair gives the links of a spanning forest, never all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, mix, split_join, string_buffers, text_mark, texts, written
from .components import connected_components

SEED = 42
TILE = 4096
SET_ITEMS = 4 << 20  # items of shingle sets that a tile holds
_PIECE = 1 << 20


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of text with A-Z lower-cased, repeats included; of fewer words, of all; of none, none.

    Long texts are taken in pieces, with the last k - 1 words carried on.
    """
    h, out, carry, at = xxhash.xxh64_intdigest, [], [], 0
    while at < len(text) or at == 0:
        end = min(at + _PIECE, len(text))
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = carry + text[at:end].lower().split()
        at = end + 1
        if len(words) < k:
            carry = words
            if at >= len(text):
                if words and not out:
                    out.append(np.array([h(b" ".join(words), SEED)], np.uint64))
                break
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        got = [h(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())]  # noqa: B905
        out.append(np.array(got, np.uint64))
        carry = words[len(words) - k + 1 :] if k > 1 else []
        if at >= len(text):
            break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


_RNG = np.random.default_rng(808)
_FACTORS = _RNG.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(1, 2**63, 1024, dtype=np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of `rows` minima of permuted hashes; none of no hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for a in range(0, len(hashes), 2048):
        part = hashes[None, a : a + 2048] * _FACTORS[: len(least), None] + _TERMS[: len(least), None]
        least = np.minimum(least, part.min(axis=1))
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = mix(keys ^ column)
    return keys


def sketches(docs: DataFrame, shingle: int = 3, words: int = 1, distinct: bool = False, bands: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, mark, sketch (an array of `words` longs) and keys (of each band; null without bands).

    The sketch's first word is the SimHash fingerprint, the rest come from mixed hashes.

    The mark, a hash of the text, tells rows that share a doc_id apart.
    """

    def run(batches):
        for batch in batches:
            raw, at = string_buffers(batch.column(2))
            data, out, keys = raw.tobytes(), [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):  # noqa: B905
                h = shingle_hashes(data[a:b], shingle)
                h = np.unique(h) if distinct else h
                keys.append(band_keys(h, *bands).view(np.int64).tolist() if bands else None)
                own = []
                for _ in range(words):
                    own.append(majority(h))
                    h = mix(h + np.uint64(0x9E3779B97F4A7C15)) if len(own) < words else h
                out.append(np.array(own, np.uint64).view(np.int64))
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * words, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "sketch", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    rows = texts(docs).select("doc_id", text_mark().alias("mark"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, mark bigint, sketch array<bigint>, keys array<bigint>")


def _roots(up: np.ndarray) -> np.ndarray:
    while True:
        further = up[up]
        if np.array_equal(further, up):
            return up
        up = further


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared by all of two sorted sets; 1 of two empty ones."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def forest(words: np.ndarray, split: int, radius: int, full: int | None, sets: list[np.ndarray] | None = None, least: float = 0.0) -> np.ndarray:
    """For each row of words (n x W), the row that stands for its component.

    With sets, pairs within the limits are linked only where their sets have a Jaccard similarity of least or more.

    Rows up to split are compared with those after it, or all with all where split is 0.
    """
    n = len(words)
    label = np.arange(n)
    if n == 2:
        near = int(words[0, 0] ^ words[1, 0]).bit_count() <= radius and (full is None or int(np.bitwise_count(words[0] ^ words[1]).sum(dtype=np.int32)) <= full)
        return np.zeros(2, np.int64) if near and (sets is None or jaccard(*sets) >= least) else label
    sides = [(np.arange(n), np.arange(n))] if not split else [(np.arange(split), np.arange(split, n))]
    pop = np.bitwise_count(words[:, 0]).astype(np.int16)
    for left, right in sides:
        left, right = left[np.argsort(pop[left], kind="stable")], right[np.argsort(pop[right], kind="stable")]
        a, b, pa_, pb = words[left, 0], words[right, 0], pop[left], pop[right]
        for i in range(0, len(left), 32):
            j = min(i + 32, len(left))
            lo, hi = np.searchsorted(pb, pa_[i] - radius), np.searchsorted(pb, pa_[j - 1] + radius, "right")
            if not split:
                lo = max(lo, i)
            for c in range(lo, hi, 4096):
                d = min(c + 4096, hi)
                near = np.bitwise_count(a[i:j, None] ^ b[None, c:d]) <= radius
                if not near.any():
                    continue
                x, y = np.nonzero(near)
                x, y = left[x + i], right[y + c]
                keep = label[x] != label[y]
                x, y = x[keep], y[keep]
                if full is not None and len(x):
                    keep = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int32) <= full
                    x, y = x[keep], y[keep]
                if sets is not None:
                    for u, v in zip(x.tolist(), y.tolist()):  # noqa: B905
                        if label[u] != label[v] and jaccard(sets[u], sets[v]) >= least:
                            p, q = sorted((label[u], label[v]))
                            label[label == q] = p
                    continue
                while len(x):
                    p, q = label[x], label[y]
                    up = np.arange(n)
                    np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
                    label = _roots(up)[label]
                    keep = label[x] != label[y]
                    x, y = x[keep], y[keep]
    return label


def _linker(radius: int, full: int | None, least: float, with_sets: bool):
    def run(batches):
        """Rows (bucket, i, j, side, id, sketch, set) come sorted by the first four; a pair's rows are about two tiles."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        now, held = None, []

        def close():
            ids, words, side = (np.concatenate([h[k] for h in held]) for k in range(3))
            split = 0 if side[0] == side[-1] else int(np.searchsorted(side, 1))
            sets = [x for h in held for x in h[3]] if with_sets else None
            label = forest(words, split, radius, full, sets, least)
            own = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            side, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            words = batch.column(5).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)
            if with_sets:
                items, where = batch.column(6).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(batch.column(6).value_lengths().to_numpy(zero_copy_only=False))))
            cut = [0, *(np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1).tolist(), len(ids)]
            for a, b in zip(cut[:-1], cut[1:]):  # noqa: B905
                if now is not None and not np.array_equal(key[a], now):
                    if sum(len(h[0]) for h in held) > 1:
                        yield close()
                    held = []
                now = key[a]
                held.append((ids[a:b], words[a:b], side[a:b], [items[where[k] : where[k + 1]].copy() for k in range(a, b)] if with_sets else None))
        if sum(len(h[0]) for h in held) > 1:
            yield close()

    return run


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, set (the sorted distinct shingle hashes of text) for rows (id, text)."""

    def run(batches):
        for batch in batches:
            raw, at = string_buffers(batch.column(1))
            data = raw.tobytes()
            own = [np.unique(shingle_hashes(data[a:b], shingle).view(np.int64)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]  # noqa: B905
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["id", "set"])

    return docs.mapInArrow(run, "id long, set array<bigint>")


def _shared_buckets(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (id, bucket, ...) in buckets of two ids or more; of buckets with the same ids, one."""
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")).where("n > 1")
    one = written(sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    return split_join(keyed, one, ["bucket"], "n", "id")


def _tile_pairs(rows: DataFrame, radius: int) -> DataFrame:
    """bucket, i, j, side and the columns of rows (id, sketch, bucket, items): each row in all tile pairs of its bucket that are compared.

    A bucket of up to TILE rows, and SET_ITEMS items of their sets, is one tile. A larger one is dealt to as many tiles
    as it fills, in the order of the population counts; one count may fill several. The partners of a tile are the tiles
    of counts within the radius of its own.
    """
    rows = rows.withColumn("pop", F.bit_count(F.col("sketch")[0]).cast("long"))
    sizes = rows.groupBy("bucket", "pop").agg(F.greatest(F.count(F.lit(1)) / TILE, F.sum("items") / SET_ITEMS).alias("fill"))
    pops = sizes.groupBy("bucket").agg(F.sum("fill").alias("fill"), F.array_sort(F.collect_list(F.struct("pop", "fill"))).alias("pops")).where("fill > 1")  # 65 entries a row at most
    before = lambda i: F.aggregate(F.slice("pops", 1, i), F.lit(0.0), lambda acc, x: acc + x["fill"])
    spread = lambda x, lo: F.struct(x["pop"].alias("pop"), F.floor(lo).alias("lo"), F.greatest(F.floor(lo), F.ceil(lo + x["fill"]) - 1).alias("hi"))
    large = written(pops.select("bucket", F.transform("pops", lambda x, i: spread(x, before(i))).alias("pops")), "large")
    zero = F.lit(0).cast("long")
    if not large.take(1):
        return rows.drop("pop").withColumns({"i": zero, "j": zero, "side": F.lit(0)})
    own = F.filter("pops", lambda x: x["pop"] == F.col("pop"))[0]
    rows = rows.join(large, "bucket", "left").withColumn("tile", F.coalesce(own["lo"] + F.pmod(F.xxhash64("id"), own["hi"] - own["lo"] + 1), zero))
    mine = F.filter("pops", lambda x: (x["lo"] <= F.col("tile")) & (x["hi"] >= F.col("tile")))
    near = F.filter("pops", lambda x: (x["pop"] >= F.array_min(F.transform(mine, lambda m: m["pop"])) - radius) & (x["pop"] <= F.array_max(F.transform(mine, lambda m: m["pop"])) + radius))
    partners = F.sequence(F.array_min(F.transform(near, lambda x: x["lo"])), F.array_max(F.transform(near, lambda x: x["hi"])))
    rows = rows.withColumn("partner", F.explode(F.coalesce(partners, F.array("tile"))))
    return rows.withColumns({"i": F.least("tile", "partner"), "j": F.greatest("tile", "partner"), "side": (F.col("tile") > F.col("partner")).cast("int")}).drop("pop", "pops", "tile", "partner")


def near_links(nodes: DataFrame, radius: int, full: int | None = None, docs: DataFrame | None = None, shingle: int = 3, least: float = 0.0) -> DataFrame:
    """Links (a, b) between nodes (id, sketch): a forest with the components of all pairs within the radius.

    full: what all words of the sketch may differ by, beside the first. Nodes with a column keys meet in the buckets
    that these name. Only nodes that share a bucket take their sketches along, and with docs (of a text for each node's
    mark) their shingle sets: links then need a Jaccard similarity of least.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fp = F.col("sketch")[0]
    if "keys" in nodes.columns:
        shared = written(_shared_buckets(nodes.select("id", F.explode("keys").alias("bucket"))), "shared")
        rows = shared.join(nodes.select("id", "sketch"), "id")
        if docs is not None:
            wanted = written(nodes.join(shared.select("id").distinct(), "id", "left_semi").select("id", F.col("mark").alias("_mark")), "wanted")
            own = texts(docs).select(F.col("text"), text_mark().alias("_mark")).join(wanted, "_mark").groupBy("id").agg(F.first("text").alias("text"))
            rows = rows.join(written(shingle_sets(own, shingle).withColumn("items", F.size("set")), "sets"), "id")
    elif radius <= 2:
        blocks = radius + 2
        width = 64 // blocks
        cut = [F.shiftrightunsigned(fp, width * i).bitwiseAND((1 << width) - 1) for i in range(blocks)]
        keys = F.array(*(F.xxhash64(F.lit(k), cut[i], cut[j]) for k, (i, j) in enumerate(combinations(range(blocks), 2))))
        rows = written(_shared_buckets(nodes.select("id", "sketch", F.explode(keys).alias("bucket"))), "shared")
    else:
        rows = nodes.select("id", "sketch", F.lit(0).cast("long").alias("bucket"))
    if "items" not in rows.columns:
        rows = rows.withColumn("items", F.lit(0))
    pairs = _tile_pairs(rows, radius).select("bucket", "i", "j", "side", "id", "sketch", *(["set"] if "set" in rows.columns else []))
    pairs = pairs.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    return pairs.mapInArrow(_linker(radius, full, least, "set" in rows.columns), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, words: int = 1, full: int | None = None, distinct: bool = False, bands: tuple[int, int] | None = None, least: float | None = None) -> DataFrame:
    """doc_id, mark, sketch, root, component_id (the smallest doc_id reachable over links, itself included) for each row of docs.

    Null and empty texts have fingerprint zero and link like any other; a null doc_id never is a component_id unless
    all of the component are null; an empty table gives no rows. Equal sketches meet once before any comparison. With
    bands and least, links are those of a Jaccard similarity of the shingle sets of least or more.
    """
    own = written(sketches(docs, shingle, words, distinct, bands), "sketches")
    ident = F.col("sketch")[0] if words == 1 else F.xxhash64("sketch")
    own = own.withColumn("id", ident)
    nodes = own.groupBy("id").agg(F.first("sketch").alias("sketch"), F.min("keys").alias("keys"), F.min("doc_id").alias("least"), F.first("mark").alias("mark"), F.count(F.lit(1)).alias("rows"))
    nodes = written(nodes, "nodes")
    roots = connected_components(near_links(nodes.select("id", "sketch", "mark", *(["keys"] if bands else [])), radius, full, docs if bands and least is not None else None, shingle, least or 0.0))
    labelled = nodes.join(roots, nodes.id == roots.node, "left").select("id", "least", "rows", F.coalesce("root", "id").alias("root"))
    labelled = written(labelled, "labelled")
    least = written(labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    found = written(split_join(labelled, least, ["root"], "n", "id").select("id", "root", "component_id", "rows"), "found")
    return split_join(own, found, ["id"], "rows", "doc_id").select("doc_id", "mark", "sketch", "root", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of each group that stays, with all columns of docs: that with the smallest doc_id, null after all others, then the smallest mark.

    Rows are told apart by doc_id and text; of rows that repeat both, one stays.
    """
    n = groups.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = n.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n")).alias("f"))
    stay = first.select(F.col("root").alias("_quern_root"), F.col("f.doc_id").alias("_quern_stay"), F.col("f.mark").alias("_quern_of"), F.col("f.n").alias("_quern_n"))
    own = docs.withColumn("_quern_mark", text_mark())
    kept = own.join(stay, F.col("doc_id").eqNullSafe(F.col("_quern_stay")) & (F.col("_quern_mark") == F.col("_quern_of")))
    once = kept.where("_quern_n = 1").select(*docs.columns)
    return once.unionByName(kept.where("_quern_n > 1").dropDuplicates(["_quern_root"]).select(*docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document at a radius of 2 bits; nulls, empties and ties as in near_groups."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex(F.col("sketch")[0])), 16, "0").alias("fingerprint"), "component_id")
