"""Full-text search: BM25 over one or several fields, phrases, near spellings.

A query has few terms, so nothing is exploded: each row's term counts are columns, the corpus statistics are one row
of sums over the whole table, and the best rows are a top-k of each task. An index table of postings serves many queries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import saturated
from ..functions.text import levenshtein_transposed, once, tokens
from ..model import MAX_QUERY_BYTES, QueryError

K1, B = 1.2, 0.75
#: Fields whose matches count twice, up to BOOSTED_CAP.
BOOSTED = ("title", "summary", "name", "subject", "heading")
BOOSTED_CAP = 0.999


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class TextQuery:
    terms: tuple[str, ...]  # any of them scores
    required: tuple[str | Phrase, ...] = ()
    excluded: tuple[str | Phrase, ...] = ()
    phrases: tuple[Phrase, ...] = ()


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def parse_text_query(text: str) -> TextQuery:
    """Words, "phrases"~slop, +required, -excluded, AND and OR; a field prefix is refused."""
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise QueryError(f"a text query has at most {MAX_QUERY_BYTES} bytes")
    if m := re.search(r"\b(id|doc_key|field_name):", text):
        raise QueryError(f"{m[0]} can't be searched for")
    terms, required, excluded, phrases = [], [], [], []
    join = False
    for m in re.finditer(r'([+-]?)"([^"]*)"(?:~(\d+))?|(\S+)', text):
        if m[4] in ("AND", "OR"):
            join = m[4] == "AND"
            if join and terms and terms[-1] not in required:
                required.append(terms[-1])
            continue
        sign = m[1] or (m[4][0] if m[4] and m[4][0] in "+-" and len(m[4]) > 1 else "")
        ws = _words(m[2] if m[4] is None else m[4])
        if not ws:
            continue
        unit: str | Phrase = Phrase(tuple(ws), int(m[3] or 0)) if m[4] is None and len(ws) > 1 else ws[0]
        if sign == "-":
            excluded.append(unit)
            continue
        terms += ws
        if isinstance(unit, Phrase):
            phrases.append(unit)
            if sign == "+" or join:
                required.append(unit)
        elif sign == "+" or join:
            required += ws
        join = False
    return TextQuery(tuple(dict.fromkeys(terms)), tuple(required), tuple(excluded), tuple(phrases))


def has_phrase(toks: Column, phrase: Phrase) -> Column:
    """Whether the words stand one after the other; with slop, in order within so many places more."""
    words = phrase.words
    if not phrase.slop:
        return F.contains(F.concat(F.lit(" "), F.concat_ws(" ", toks), F.lit(" ")), F.lit(f" {' '.join(words)} "))

    def within(ts: Column) -> Column:
        def here(i: Column) -> Column:
            window, last, ok = F.slice(ts, i + 1, F.lit(len(words) + phrase.slop)), F.lit(0), F.get(ts, i) == words[0]
            for w in words[1:]:
                nxt = F.array_position(F.slice(window, last + 2, F.size(window)), w).cast("int")
                ok = ok & (nxt > 0)
                last = last + nxt
            return ok

        return F.exists(F.sequence(F.lit(0), F.size(ts) - len(words)), here)

    return F.when(F.size(toks) >= len(words), F.coalesce(once(toks, within), F.lit(False))).otherwise(False)


def _holds(toks: Column, unit: str | Phrase) -> Column:
    return has_phrase(toks, unit) if isinstance(unit, Phrase) else F.array_contains(toks, unit)


def _count(toks: Column, term: str) -> Column:
    return F.size(toks) - F.size(F.array_remove(toks, term))


def bm25(df: DataFrame, key: str, field: str, query: str | TextQuery, within: Column | None = None) -> DataFrame:
    """key, score of the rows whose field matches; idf is ln(1 + (N - df + 0.5) / (df + 0.5)), rows without words count in N.

    within narrows the rows returned, not the statistics, which are those of the whole table.
    """
    q = parse_text_query(query) if isinstance(query, str) else query
    if not q.terms:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    own = df if within is None else df.withColumn("_within", within)
    mark = ["_within"] if within is not None else []
    units = [u for u in dict.fromkeys((*q.phrases, *q.required, *q.excluded)) if isinstance(u, Phrase)]

    def counts_of(rows: DataFrame) -> DataFrame:
        ts = F.col("_toks")  # out of a generator, which filters on it don't pass: so a row is split once
        return rows.select(key, F.explode(F.array(tokens(F.col(field)))).alias("_toks"), *mark).select(
            key,
            F.size(ts).alias("_dl"),
            *(_count(ts, t).alias(f"_tf{i}") for i, t in enumerate(q.terms)),
            *(_holds(ts, u).alias(f"_u{i}") for i, u in enumerate(units)),
            *(F.array_contains(ts, u).alias(f"_x_{i}") for i, u in enumerate(q.excluded) if isinstance(u, str)),
            *mark,
        )

    n = range(len(q.terms))
    stats = counts_of(own).agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *(F.sum(F.when(F.col(f"_tf{i}") > 0, 1).otherwise(0)).alias(f"_df{i}") for i in n))
    hit = F.col("_tf0") > 0
    for i in n[1:]:
        hit = hit | (F.col(f"_tf{i}") > 0)
    for u in q.required:
        hit = hit & (F.col(f"_u{units.index(u)}") if isinstance(u, Phrase) else F.col(f"_tf{q.terms.index(u)}") > 0)
    for i, u in enumerate(q.excluded):
        hit = hit & ~(F.col(f"_u{units.index(u)}") if isinstance(u, Phrase) else F.col(f"_x_{i}"))
    if q.phrases and set(q.terms) == {w for p in q.phrases for w in p.words}:  # nothing but phrases: one must be there
        hit = hit & reduce(lambda a, b: a | b, (F.col(f"_u{units.index(p)}") for p in q.phrases))
    if within is not None:
        hit = hit & F.col("_within")
    score = F.lit(0.0)
    for i in n:
        tf = F.col(f"_tf{i}")
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    # Statistics take every row's words; for the hits a row is split anew only where its raw text has a term at all.
    found = counts_of(own.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(field)), F.lit(t)) for t in q.terms)))).where(hit)
    return found.crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # stats is one row


def search_fields(df: DataFrame, key: str, fields: list[str], query: str) -> DataFrame:
    """key, score, field: BM25 of every field by itself, brought to 0..1, titles and the like twice; the best field counts."""
    out = None
    for f in fields:
        s = saturated(F.col("score"))
        s = F.least(s * 2, F.lit(BOOSTED_CAP)) if f in BOOSTED else s
        part = bm25(df, key, f, query).select(key, s.alias("score"), F.lit(f).alias("field"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.max("score").alias("score"), F.min_by("field", F.struct(-F.col("score"), "field")).alias("field"))


def phrase_rows(df: DataFrame, key: str, field: str, words: str, slop: int = 0) -> DataFrame:
    """Rows with a phrase. Its first word is looked for in the raw text first, which spares most rows the split."""
    phrase = Phrase(tuple(_words(words)), slop)
    return df.where(F.contains(F.lower(F.col(field)), F.lit(phrase.words[0]))).select(key, tokens(F.col(field)).alias("_toks")).where(has_phrase(F.col("_toks"), phrase)).select(key)


def postings(df: DataFrame, key: str, field: str) -> DataFrame:
    """term, key, tf, dl: an index to be written bucketed by term, for many queries over one table."""
    toks = df.select(key, tokens(F.col(field)).alias("toks")).select(key, F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    return toks.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(df: DataFrame, field: str) -> DataFrame:
    """term, df: in how many rows a term occurs."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(field)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fuzzy_terms(df: DataFrame, field: str, word: str, edits: int = 1) -> DataFrame:
    """Terms of the vocabulary at most `edits` (up to 2) from a word; a swap of neighbours is one edit."""
    edits, word = min(edits, 2), word.lower()
    near = F.length("term").between(max(1, len(word) - edits), len(word) + edits)
    terms = df.select(F.explode(F.array_distinct(tokens(F.col(field)))).alias("term")).where(near).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.where(levenshtein_transposed(F.col("term"), F.lit(word), edits))
