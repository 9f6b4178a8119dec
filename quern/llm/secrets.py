"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regex follows a Boolean query over trigrams that every match must contain. The index is a table of
postings, for each trigram that a rule's query names and each block of documents the documents that have it
(lower-cased); intersecting and uniting postings block by block gives the candidates of each rule, and only those are
searched with the regex. Rules without a mandatory trigram search all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, written


BLOCK = 8_192


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # in what Java and RE2 both read; letters of keywords as classes where case is free
    group: int = 0  # the group whose length counts
    least: int = 1


_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

#: Matches shorter than `least` are dropped after matching, so they still use up their text.
BASE = (
    Rule("assign", f"({'|'.join(map(_ANY_CASE, ('password', 'passwd', 'secret', 'token')))}|{_ANY_CASE('api')}_?{_ANY_CASE('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", "sk_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 36),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE + MORE


def trigram_query(regex: str, most: int = 64) -> list[frozenset[frozenset[str]]]:
    """A list of clauses that all must hold; a clause holds if all trigrams of one of its sets are there. Empty: no mandatory trigram."""
    clauses: list[frozenset[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if sets and all(sets):
            clauses.append(frozenset(x for x in sets if not any(y < x for y in sets)))

    def exact(node) -> set[str] | None:
        """All strings of a node, lower-cased, if they are few."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            got = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    got.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 6:
                    got |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return got if len(got) <= 6 else None
        if op is sre.SUBPATTERN:
            return exact_seq(arg[3])
        if op is sre.BRANCH:
            parts = [exact_seq(x) for x in arg[1]]
            return set().union(*parts) if all(p is not None for p in parts) else None
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
            part = exact_seq(arg[2])
            return None if part is None or any(len(x) != 1 for x in part) else part | {""}
        return None

    def exact_seq(seq) -> set[str] | None:
        got = {""}
        for node in seq:
            part = exact(node)
            if part is None or len(got) * len(part) > most:
                return None
            got = {a + b for a in got for b in part}
        return got

    now = {""}
    for node in parser.parse(regex):
        part = exact(node)
        if part is None or "" in part or len(now) * len(part) > most:
            flush(now)
            now = part if part is not None and "" not in part else {""}
        else:
            now = {a + b for a in now for b in part}
    flush(now)
    return clauses


class TrigramIndex:
    """Postings (trigram, block, docs) over the trigrams that the rules' queries name; a block has BLOCK rows at most."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = {r.kind: trigram_query(r.regex) for r in rules}
        self.vocabulary = sorted({t for q in self.queries.values() for c in q for s in c for t in s})
        self.number = {t: i for i, t in enumerate(self.vocabulary)}

    def postings(self, docs: DataFrame) -> DataFrame:
        low = docs.select("doc_id", F.lower("text").alias("low"), F.floor(F.monotonically_increasing_id() / BLOCK).alias("block")).where(F.col("low").isNotNull())
        there = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for t, i in self.number.items())))
        rows = low.select("doc_id", "block", F.explode(there).alias("trigram"))
        return rows.groupBy("trigram", "block").agg(F.sort_array(F.collect_set(F.struct("doc_id"))).alias("docs"))

    def candidates(self, postings: DataFrame) -> DataFrame:
        """doc_id and, for each rule with a query, whether the intersected postings hold it; documents of no rule are left out."""
        empty = F.array().cast(postings.schema["docs"].dataType)
        lists = postings.groupBy("block").agg(*(F.coalesce(F.max(F.when(F.col("trigram") == i, F.col("docs"))), empty).alias(f"t{i}") for i in self.number.values()))
        every = lambda s: reduce(F.array_intersect, (F.col(f"t{self.number[t]}") for t in sorted(s)))
        some = lambda c: reduce(F.array_union, map(every, sorted(c, key=sorted)))
        both = {k: reduce(F.array_intersect, map(some, q)) for k, q in self.queries.items() if q}
        tagged = lambda kind: lambda d: F.struct(d["doc_id"].alias("doc_id"), F.lit(kind).alias("kind"))
        each = F.flatten(F.array(*(F.transform(docs, tagged(k)) for k, docs in both.items())))
        found = lists.select(F.explode(each).alias("x")).groupBy("x.doc_id")
        return found.agg(*(F.bool_or(F.col("x.kind") == k).alias(f"has_{k}") for k in both))


_SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, where a lambda would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, rule: Rule, ord_: int) -> Column:
    """Spans of a rule's matches in code points, end exclusive: between matches lie the pieces that a split leaves."""
    regex = strict(rule)
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    sizes = F.struct(
        lengths(F.regexp_extract_all(text, F.lit(regex), F.lit(0))).alias("hits"),
        lengths(F.split(text, regex, -1)).alias("pieces"),
        lengths(F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group))).alias("counted"),
    )

    def of(m: Column) -> Column:
        def placed(before: Column) -> Column:
            def one(i: Column) -> Column:
                start = F.get(before["pieces"], i + 1) + F.get(before["hits"], i)
                return F.struct(start.alias("start"), F.lit(ord_).alias("ord"), (start + F.get(m["hits"], i)).alias("end"), F.lit(rule.kind).alias("kind"))

            stay = F.filter(F.sequence(F.lit(0), F.size(m["hits"]) - 1), lambda i: F.get(m["counted"], i) >= rule.least)
            return F.transform(stay, one)

        sums = F.struct(running(m["hits"]).alias("hits"), running(m["pieces"]).alias("pieces"))
        return F.when(F.size(m["hits"]) > 0, _let(sums, placed)).otherwise(F.array().cast(_SPAN))

    return _let(sizes, of)


def running(xs: Column, block: int = 256) -> Column:
    """For a non-empty array its sums up to each place, starting with 0: sums within blocks, then what stands before each block."""
    sums = lambda ys: F.aggregate(ys, F.array(F.lit(0)), lambda acc, y: F.array_append(acc, F.element_at(acc, -1) + y))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: sums(F.slice(xs, b * block + 1, block)))

    def whole(blocks: Column) -> Column:
        def moved(before: Column) -> Column:
            parts = F.transform(blocks, lambda ys, i: F.transform(F.slice(ys, 1, F.size(ys) - 1), lambda y: y + F.get(before, i)))
            return F.concat(F.flatten(parts), F.array(F.element_at(before, -1)))

        return _let(sums(F.transform(blocks, lambda ys: F.element_at(ys, -1))), moved)

    return _let(cut, whole)


#: Fixed characters before the run that ends these rules' regexes. A match is one run of characters, so asking for the
#: least length in the regex finds the very matches that stay: what is too short holds no other match.
_RUNS = {"access": 4, "hex": 0}


def strict(rule: Rule) -> str:
    """The rule's regex, with its least length where that changes no other match."""
    return f"{rule.regex[:-1]}{{{rule.least - _RUNS[rule.kind]},}}" if rule.kind in _RUNS else rule.regex


def find_secrets(docs: DataFrame, index: TrigramIndex | None = None) -> DataFrame:
    """doc_id and found, an array of (start, ord, end, kind) by start, then rule, for each row of docs.

    Null texts count as empty; rows that repeat a doc_id are each searched in their own text; a null doc_id is a key
    like any other; an empty table gives no rows. The index only narrows where a regex runs, never what it finds.

    The postings are written, then the candidates, so that their size is known: few are broadcast under the session's threshold and
    no text moves, many are joined by sort-merge.
    """
    index = index or TrigramIndex()
    postings = written(index.postings(docs), "postings")
    cand = written(index.candidates(postings).withColumnRenamed("doc_id", "c_id"), "candidates")
    discard(postings)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(cand, rows.doc_id.eqNullSafe(cand.c_id), "left")
    text, none = F.col("text"), F.array().cast(_SPAN)
    parts = []
    for i, rule in enumerate(index.rules):
        where = text.rlike(strict(rule))
        if index.queries[rule.kind]:
            where = F.coalesce(F.col(f"has_{rule.kind}"), F.lit(False)) & where
        parts.append(F.when(where, spans(text, rule, i)).otherwise(none).alias(f"s_{rule.kind}"))
    return rows.select("doc_id", *parts).select("doc_id", F.array_sort(F.concat(*(F.col(f"s_{r.kind}") for r in index.rules))).alias("found"))


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text, those of the base rules counted and digested; nulls and ties as in find_secrets."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["ord"] < len(BASE))
    return found.select("doc_id", *(n(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    ctes, names = [], []
    for i, r in enumerate(RULES):
        re_ = quoted(r.regex)
        ctes.append(f"r{i} AS (SELECT id, unnest(list_transform(range(len(h)), lambda i: {{'start': {total('p[1:i+1]')} + {total('h[1:i]')}, 'hit': length(h[i+1]), 'n': length(g[i+1])}})) AS s FROM (SELECT id, regexp_extract_all(text, {re_}, 0) AS h, regexp_extract_all(text, {re_}, {r.group}) AS g, string_split_regex(text, {re_}) AS p FROM d WHERE regexp_matches(text, {re_})))")
        names.append(f"SELECT id, CAST(s.start AS BIGINT) AS st, {i} AS ord, '{r.kind}:' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.hit AS BIGINT) AS what FROM r{i} WHERE s.n >= {r.least}")
    ones = " UNION ALL ".join(names)
    counts = ", ".join(f"count(*) FILTER (WHERE ord = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents), {', '.join(ctes)}, a AS ({ones}),
s AS (SELECT id, {counts}, coalesce(string_agg(what, ',' ORDER BY st, ord) FILTER (WHERE ord < {len(BASE)}), '') AS base, string_agg(what, ',' ORDER BY st, ord) AS spans FROM a GROUP BY id)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (id)"""


SQL = _sql()
