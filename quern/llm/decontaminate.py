"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the tokens that a mask keeps out of a span of tokens; what the mask ignores may differ. Documents
and items are seeded at every token. An item is found where enough of a window of 13 tokens, or of the whole of a
shorter item, agrees, which allows 2 substitutions in 10 to 13 tokens, 1 in 5 to 9 and none in fewer; each number of
tokens has masks of which one at least avoids any allowed set of substitutions. Each hit names a document, an item and the distance between their places; at that distance the two are
compared token by token, which tolerates substitutions.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, text_mark, written

#: Equal tokens that a window of so many aligned tokens needs (an item of fewer tokens is one window).
WINDOW = 13
SHARE = 0.8
#: Stands for an item without an id among the items found.
NO_ID = -1

_NO_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NO_WORD), lambda x: x != "")


def masks_of(n: int) -> list[tuple[int, ...]]:
    """Masks for items of n tokens, WINDOW for all longer ones.

    The two for WINDOW, at all places of the item, leave a seed for any two substitutions in a window. A shorter item is
    cut into blocks, two more than it has allowed substitutions, and a mask keeps two of them, at the item's start alone.
    """
    if n >= WINDOW:
        return [(0, 1, 3, 6, 7), (0, 2, 3, 4, 7)]
    blocks = n - math.ceil(SHARE * n - 1e-9) + 2
    own = [tuple(i for i in range(n) if i * blocks // n == b) for b in range(blocks)]
    return sorted({a + b for a, b in combinations(own, 2)})


def _seeds(toks: Column, n: int, places: Column) -> Column:
    """An array of (h, at) over all masks of n; a seed with a place outside the tokens is left out."""

    def of(k: int, mask: tuple[int, ...]) -> Column:
        inside = F.filter(places, lambda i: (i + mask[0] >= 0) & (i + mask[-1] < F.size(toks)))
        return F.transform(inside, lambda i: F.struct(F.xxhash64(F.lit(n * 100 + k), *(F.get(toks, i + m) for m in mask)).alias("h"), i.alias("at")))

    return F.flatten(F.array(*(of(k, m) for k, m in enumerate(masks_of(n)))))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, mark, item_id, shift): a seed of the item at i is a seed of the document at i + shift.

    Both sides meet by hash; the item side is reduced to distinct rows first. Whether it is broadcast is left to the
    session's size threshold, so a benchmark of any size works. Documents take the masks of those lengths that items have.
    """
    toks, width = F.col("toks"), F.least(F.size("toks"), F.lit(WINDOW))
    lengths = sorted(r[0] for r in items.where(F.size("toks") > 0).select(width.alias("n")).distinct().collect()) or [WINDOW]  # WINDOW rows at most
    everywhere = F.sequence(F.lit(-WINDOW), F.size(toks))  # an item may lack its ends where a text begins or stops
    left = docs.select("doc_id", "mark", F.explode(F.concat(*(_seeds(toks, n, everywhere) for n in lengths))).alias("s")).select("doc_id", "mark", F.col("s.h").alias("h"), F.col("s.at").alias("d_at"))
    own = None
    for n in lengths:
        places = F.sequence(F.lit(0), F.size(toks)) if n == WINDOW else F.array(F.lit(0))
        own = (F if own is None else own).when(width == n, _seeds(toks, n, places))
    right = items.select("item_id", F.explode(own).alias("s")).select("item_id", F.col("s.h").alias("h"), F.col("s.at").alias("i_at")).distinct()
    return left.join(right, "h").select("doc_id", "mark", "item_id", (F.col("d_at") - F.col("i_at")).alias("shift")).distinct()


def _overlap(doc: Column, item: Column, shift: Column) -> Column:
    """The best count of equal tokens in a window of the item, as a share of the window."""
    width = F.least(F.size(item), F.lit(WINDOW))
    same = F.transform(item, lambda t, i: F.when((i + shift >= 0) & F.coalesce(F.get(doc, i + shift) == t, F.lit(False)), 1).otherwise(0))
    windows = F.transform(F.sequence(F.lit(1), F.size(item) - width + 1), lambda i: F.aggregate(F.slice(same, i, width), F.lit(0), lambda a, x: a + x))
    return F.array_max(windows) / width


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """l_id, l_mark (of the text), item_ids and overlap of the rows of docs in which an item is found: a written table.

    Hits are written first too, so that sizes are known: few are broadcast under the session's threshold and no text
    moves, many are joined by sort-merge.
    """
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("mark") == F.col("h_mark"))
    rows = docs.select("doc_id", "text", text_mark().alias("mark"))
    own = rows.select("doc_id", "mark", tokens(F.col("text")).alias("toks"))
    items = benchmark.select("item_id", tokens(F.col("text")).alias("toks")).where(F.size("toks") > 0)
    lists = hits(own, items).groupBy(F.col("doc_id").alias("h_id"), F.col("mark").alias("h_mark")).agg(F.collect_list(F.struct("item_id", "shift")).alias("hits"))
    lists = written(lists, "hits")
    texts = rows.join(lists, same).select("h_id", "h_mark", tokens(F.col("text")).alias("toks"), F.explode("hits").alias("hit"))
    checked = texts.join(items.withColumnRenamed("toks", "item"), F.col("hit.item_id").eqNullSafe(F.col("item_id"))).withColumn("overlap", _overlap(F.col("toks"), F.col("item"), F.col("hit.shift")))
    found = checked.where(F.col("overlap") >= SHARE).groupBy(F.col("h_id").alias("l_id"), F.col("h_mark").alias("l_mark")).agg(F.sort_array(F.collect_set(F.coalesce("item_id", F.lit(NO_ID)))).alias("item_ids"), F.max("overlap").alias("overlap"))
    found = written(found, "leaks")
    discard(lists)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, mark, item_ids (sorted, of items found in the text), overlap (the best share, 0 to 1) for each row of docs.

    An item is found where a window of 13 of its tokens, or all of a shorter item, agrees with the text in at least
    0.8 of the places. Null and empty texts hold nothing; items without a token are never found; rows that share a
    doc_id, or have none, are told apart by their texts; with no items nothing is found.
    """
    found = leaks(docs, benchmark)
    out = docs.select("doc_id", text_mark().alias("mark")).join(found, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("mark") == F.col("l_mark")), "left")
    return out.select("doc_id", "mark", F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)).alias("item_ids"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    leaked = leaks(docs, benchmark).select(F.col("l_id").alias("_quern_id"), F.col("l_mark").alias("_quern_of"))
    own = docs.withColumn("_quern_mark", text_mark())
    return own.join(leaked, F.col("doc_id").eqNullSafe(F.col("_quern_id")) & (F.col("_quern_mark") == F.col("_quern_of")), "left_anti").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds; nulls, short items and repeated ids as in find_leaks."""
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "overlap")
