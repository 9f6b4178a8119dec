"""Queries of text: search, words, chunks, classification, files and retrieval by words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities, queries, text
from ..functions.scoring import saturated
from ..operators import fusion, recall, relational, search
from ..sources import files
from .catalog_relational import database
from .compiler import run
from .registered import query


def toks(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def split(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({column}), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def bm25_sql(table: str, key: str, field: str, terms: list[str], where: str = "true") -> str:
    """CTEs d (key, dl, f0..., w) and s (key, score)."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(terms)))
    one = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in range(len(terms)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""x AS (SELECT {key}, {toks(f"coalesce({field}, '')")} AS w FROM {table}), d AS (SELECT {key}, len(w) AS dl, w, {tf} FROM x),
    g AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a, {df} FROM d), s AS (SELECT {key}, {one} AS score FROM d CROSS JOIN g WHERE ({hit}) AND {where})"""


@query("fts_term", rf"SELECT doc_id FROM documents WHERE list_contains({toks('text')}, 'reingwh')")
def _(t):
    return search.bm25(t.documents, "doc_id", "text", "REINGWH").select("doc_id")


@query("bm25_topk", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['erti', 'hath', 'éon'])} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def _(t):
    return fusion.top(search.bm25(t.documents, "doc_id", "text", "erti hath éon"), 20, "doc_id").withColumn("score", F.round("score", 6))


@query("bm25_field", f"WITH {bm25_sql('conversations', 'conv_id, turn', 'text', ['the', 'anat'])} SELECT conv_id, turn, round(score / (score + 1), 6) AS score FROM s ORDER BY s.score DESC, conv_id, turn LIMIT 30")
def _(t):
    rows = t.conversations.select(F.struct("conv_id", "turn").alias("id"), "text")
    top = fusion.top(search.bm25(rows, "id", "text", "the anat"), 30)
    return top.select("id.conv_id", "id.turn", F.round(saturated(F.col("score")), 6).alias("score"))


@query("bm25_required", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['hath', 'inble', 'erti'])} SELECT s.doc_id FROM s JOIN d ON s.doc_id = d.doc_id WHERE f0 > 0 AND NOT list_contains(w, 'eder')")
def _(t):
    return search.bm25(t.documents, "doc_id", "text", "+hath inble erti -eder").select("doc_id")


@query(
    "fts_fields",
    f"""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand || ' ' || p_type AS body FROM part), {bm25_sql('p', 'id', 'name', ['ring'])}, b AS ({"WITH " + bm25_sql('p', 'id', 'body', ['ring']).replace('x AS', 'bx AS', 1).replace('FROM x)', 'FROM bx)', 1)} SELECT id, score FROM s)
    SELECT id, round(least(score / (score + 1) * 2, 0.999), 6) AS score, 'name' AS field FROM s""",
)
def _(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("body"))
    return search.search_fields(rows, "id", ["name", "body"], "ring").withColumn("score", F.round("score", 6))


@query("find_ql", "SELECT p_partkey AS id FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'widget') AND p_size > 40 ORDER BY p_size DESC, p_partkey::VARCHAR LIMIT 15")
def _(t):
    got = run(database(t), "FIND \"widget\" IN p_name WHERE p_size > 40 FROM part ORDER BY p_size DESC LIMIT 15")
    return got.select(F.col("id").cast("long").alias("id"))


@query("phrase_match", rf"SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string({toks('text')}, ' ') || ' ', ' of the ')")
def _(t):
    return search.phrase_rows(t.documents, "doc_id", "text", "of the")


@query("phrase_slop", rf"SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string({toks('text')}, ' ') || ' ', ' of ([^ ]+ ){{0,2}}anat ')")
def _(t):
    return search.phrase_rows(t.documents, "doc_id", "text", "of anat", 2)


@query(
    "fuzzy_terms",
    rf"""WITH v AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({toks('text')})) AS term FROM documents) GROUP BY 1),
    e AS (SELECT *, len(term) > 1 AND list_bool_or(list_transform(range(1, len(term)), lambda i: term[1:i-1] || term[i+1] || term[i] || term[i+2:] = 'hath')) AS swapped FROM v)
    SELECT term, df FROM e WHERE abs(len(term) - 4) <= 1 AND (levenshtein(term, 'hath') <= 1 OR coalesce(swapped, false))""",
)
def _(t):
    return search.fuzzy_terms(t.documents, "text", "hath", 1)


@query("postings", rf"WITH x AS MATERIALIZED (SELECT doc_id, {toks('text')} AS w FROM documents), y AS MATERIALIZED (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM x) SELECT term, doc_id, CAST(dl AS INT) AS dl, count(*) AS tf FROM y GROUP BY 1, 2, 3")
def _(t):
    return search.postings(t.documents, "doc_id", "text")


@query("snippet", "SELECT item_id, CASE WHEN p > 0 THEN regexp_replace(substr(text, CAST(greatest(1, p - 58) AS BIGINT), 120), '(?i)(the)', '<b>\\1</b>', 'g') ELSE substr(text, 1, 120) END AS snippet FROM (SELECT item_id, text, strpos(lower(text), 'the') AS p FROM benchmark)")
def _(t):
    return t.benchmark.select("item_id", text.snippet(F.col("text"), "the", 120).alias("snippet"))


@query("chunk_overlap", "SELECT doc_id, CAST(i AS INT) AS chunk, substr(text, i * 1200 + 1, 1600) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(floor((length(text) - 401) / 1200) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 1600)")
def _(t):
    return fusion.text_chunks(t.documents, "doc_id", "text")


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_KEYWORDS = rf"list_filter(list_transform({split('text')}, lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: strlen(w) > 1 AND NOT list_contains({_STOP}, w))"


@query("extract_keywords", f"SELECT item_id, array_to_string({_KEYWORDS}, ' ') AS keywords FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.concat_ws(" ", text.keywords(F.col("text"))).alias("keywords"))


@query(
    "keyword_overlap",
    """WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 1600 THEN [lower(text)] ELSE list_transform(range(0, CAST(floor((length(text) - 401) / 1200) AS BIGINT) + 1), lambda i: lower(substr(text, i * 1200 + 1, 1600))) END AS cs FROM documents)
    SELECT doc_id, round(list_max(list_transform(cs, lambda c: (contains(c, 'erti')::INT + contains(c, 'hath')::INT + contains(c, 'inble')::INT) / 3.0)), 6) AS overlap FROM c""",
)
def _(t):
    return t.documents.select("doc_id", F.round(text.keyword_overlap(F.col("text"), ["erti", "hath", "inble"]), 6).alias("overlap"))


@query(
    "word_jaccard",
    f"""WITH w AS (SELECT item_id, list_distinct({split('text')}) AS s FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) AS jaccard
    FROM w a JOIN w b ON b.item_id = a.item_id + 1""",
)
def _(t):
    nxt = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("text").alias("other"))
    return t.benchmark.join(nxt, "item_id").select(F.col("item_id").alias("a"), "b", F.round(text.jaccard(F.col("text"), F.col("other")), 6).alias("jaccard"))


@query("code_tokens", "SELECT page_id, array_to_string(list_transform(regexp_extract_all(replace(url, 'HTTP', 'http'), '[A-Z]?[a-z]+[0-9]*|[0-9]+|[A-Z]+'), lambda x: lower(x)), ' ') AS tokens FROM pages")
def _(t):
    """URLs have no acronym before a word, so a simpler regex tells the same."""
    return t.pages.select("page_id", F.concat_ws(" ", text.code_tokens(F.col("url"))).alias("tokens"))


@query("simhash")
def _(t):
    return t.documents.select("doc_id", text.simhash(F.col("text")).alias("simhash"))


@query("neardup_collapse")
def _(t):
    hits = fusion.top(search.bm25(t.documents, "doc_id", "text", "erti hath").withColumnRenamed("doc_id", "id"), 60)
    return fusion.collapse_near(hits.join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id"), "text").select("id", F.round("score", 6).alias("score"))


@query("deflate_ratio")
def _(t):
    return t.benchmark.select("item_id", text.deflate_ratio(F.col("text")).alias("ratio"))


@query("extract_entities")
def _(t):
    """Notes made of part names, as the tables' prose has no code in it."""
    note = F.concat(F.lit("fixed `"), F.initcap("p_name"), F.lit("` in src/parts/p"), F.col("p_size"), F.lit(".rs: HTTPClient calls auth_token; see fn load_"), F.lower("p_type"))
    return t.part.select("p_partkey", F.explode(entities.extract_entities(note)).alias("e")).select("p_partkey", "e.name", "e.entity_type", "e.lang", "e.source_text")


@query("pii_detect", rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{entities.EMAIL}')) AS INT) AS emails, CAST(len(regexp_extract_all(text, '{entities.IPV4}')) AS INT) AS ips, coalesce(array_to_string(regexp_extract_all(text, '{entities.EMAIL}'), ','), '') AS email_list FROM documents")
def _(t):
    found = entities.emails(F.col("text"))
    return t.documents.select("doc_id", F.size(found).alias("emails"), F.size(entities.ipv4(F.col("text"))).alias("ips"), F.concat_ws(",", found).alias("email_list"))


@query("auto_capture")
def _(t):
    """Messages built from the rows, as the tables hold no errors or decisions."""
    line = F.element_at(F.array(*map(F.lit, ("Error: the deploy step did not end", "We decided to keep the nightly job", "tests passed, nothing to do here", "fatal flaw in the story of the film", "the build failed with exit code 101"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = t.events.select("event_id", F.concat_ws("\n", F.lit("log of the run"), line).alias("text"))
    return rows.select("event_id", F.explode(entities.captures(F.col("text"))).alias("c")).select("event_id", "c.kind", "c.summary")


#: The classes of words and addresses as they stand in the tables, by patterns of their own.
_CLASS_SQL = r'''
WITH q AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS q FROM documents UNION SELECT url FROM pages UNION SELECT p_name FROM part UNION SELECT o_orderpriority FROM orders)
SELECT q, CASE WHEN q IS NULL OR q = '' OR regexp_matches(q, '\s') THEN 'natural-language'
  WHEN regexp_full_match(lower(q), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') THEN 'uuid'
  WHEN regexp_full_match(lower(q), 'https?://.+') THEN 'hostname'
  WHEN q LIKE './%' OR q LIKE '../%' OR len(list_filter(string_split(q, '/'), lambda x: x <> '')) > 1 THEN 'path'
  WHEN list_contains(string_split('EXTENSIONS', ' '), lower(regexp_extract(q, '^.+\.([A-Za-z]+)$', 1))) THEN 'path'
  WHEN regexp_full_match(q, '([A-Za-z0-9]+(-+[A-Za-z0-9]+)*\.)+[A-Za-z][A-Za-z]+') THEN 'hostname'
  WHEN regexp_full_match(q, '[A-Za-z_][-A-Za-z0-9_]*\.[A-Za-z0-9]{1,8}') AND regexp_matches(string_split(q, '.')[2], '[A-Za-z]') THEN 'path'
  WHEN contains(q, '::') AND len(list_filter(string_split(q, '::'), lambda x: NOT regexp_full_match(x, '[A-Za-z_]\w*'))) = 0 THEN 'symbol'
  WHEN regexp_full_match(q, '[A-Za-z_]\w*[(][^)]*[)]') THEN 'symbol'
  WHEN regexp_full_match(q, '\d{7,}') OR (length(q) > 15 AND regexp_full_match(q, '[A-Za-z0-9]*[0-9][A-Za-z0-9]*')) THEN 'numeric-id'
  WHEN regexp_full_match(q, '[A-Za-z]\w*') AND (contains(q, '_') OR regexp_matches(substring(q, 2), '[A-Z]')) THEN 'symbol'
  ELSE 'natural-language' END AS class FROM q'''.replace("EXTENSIONS", " ".join(queries.EXTENSIONS))


@query("query_class", _CLASS_SQL)
def _(t):
    word = t.documents.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+", -1)).alias("q"))
    rows = word.unionByName(t.pages.select(F.col("url").alias("q"))).unionByName(t.part.select(F.col("p_name").alias("q"))).unionByName(t.orders.select(F.col("o_orderpriority").alias("q"))).distinct()
    return rows.select("q", queries.query_class(F.col("q")).alias("class"))


@query("ask_intent", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'causality' WHEN 2 THEN 'graph' WHEN 3 THEN 'temporal' WHEN 4 THEN 'rules' WHEN 5 THEN 'vector' ELSE 'combined' END AS intent FROM events")
def _(t):
    asked = F.array(*map(F.lit, ("find the string foo", "why did we move", "who calls login", "what changed in the last 3 days", "should we use tabs", "notes similar to this", "login flow")))
    return t.events.select("event_id", queries.intent_column(F.element_at(asked, (F.col("event_id") % 7 + 1).cast("int"))).alias("intent"))


@query("memory_type", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'procedural' WHEN 2 THEN 'episodic' WHEN 3 THEN 'belief' ELSE 'semantic' END AS memory_type FROM events")
def _(t):
    said = F.array(*map(F.lit, ("I prefer tabs", "how to deploy: run this", "yesterday we did the move", "I think it seems fine", "the port is open")))
    return t.events.select("event_id", entities.memory_type(F.element_at(said, (F.col("event_id") % 5 + 1).cast("int")), F.lit(0)).alias("memory_type"))


@query("markdown_sections")
def _(t):
    """Pages as Markdown: a heading from the URL's path, the HTML below."""
    body = F.concat(F.lit("# "), F.regexp_extract("url", r"//([^/]+)", 1), F.lit("\n\nintro\n\n## "), F.regexp_extract("url", r"//[^/]+(/[^?#]*)", 1), F.lit("\n\n"), F.coalesce("html", F.lit("")))
    rows = t.pages.select(F.col("page_id").cast("string").alias("path"), F.lit("markdown").alias("language"), body.alias("text"))
    return files.sections(rows).select("path", "depth", "section_path", "heading", "line_start", "line_end")


@query(
    "trigram_mine",
    f"""WITH w AS (SELECT conv_id, {split("coalesce(text, '')")} AS w FROM conversations), g AS (SELECT DISTINCT conv_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS phrase FROM w WHERE len(w) >= 3)
    SELECT phrase, count(*) AS sessions FROM g GROUP BY 1 HAVING count(*) >= 2""",
)
def _(t):
    from ..operators.memory import phrases

    return phrases(t.conversations, "conv_id", "text")


@query(
    "top_terms",
    rf"""SELECT term, count(*) AS count FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 2)) AS term FROM benchmark) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def _(t):
    from ..operators.diagnostics import top_terms

    return top_terms(t.benchmark, "text")


@query(
    "repeated_failure",
    f"""WITH l AS (SELECT d.doc_id, list_distinct(list_filter({split('text')}, lambda x: length(x) > 4)) AS w FROM documents d JOIN labels USING (doc_id) WHERE quality = 0), n AS (SELECT count(*)::DOUBLE AS n FROM l)
    SELECT word, frequency, round(frequency / n, 8) AS confidence FROM (SELECT word, count(*) AS frequency FROM (SELECT unnest(w) AS word FROM l) GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 5) CROSS JOIN n""",
)
def _(t):
    from ..operators.memory import repeated_failures

    bad = t.documents.join(t.labels.where("quality = 0"), "doc_id", "left_semi")
    return repeated_failures(bad, "text").withColumn("confidence", F.round("confidence", 8))


@query(
    "token_budget",
    """WITH RECURSIVE h AS (SELECT item_id AS id, length(text) AS score, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n, row_number() OVER (ORDER BY length(text) DESC, item_id) AS r FROM benchmark),
    w AS (SELECT r, id, n <= 1000 AS kept, CASE WHEN n <= 1000 THEN n ELSE 0 END AS used FROM h WHERE r = 1 UNION ALL SELECT h.r, h.id, w.used + h.n <= 1000, CASE WHEN w.used + h.n <= 1000 THEN w.used + h.n ELSE w.used END FROM w JOIN h ON h.r = w.r + 1)
    SELECT id FROM w WHERE kept""",
)
def _(t):
    hits = t.benchmark.select(F.col("item_id").alias("id"), F.length("text").cast("double").alias("score"), "text")
    return fusion.within_budget(hits, "text", 1000).select("id")


_LISTS = f"""{bm25_sql('documents', 'doc_id', 'text', ['erti', 'hath'])}, a AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM s ORDER BY score DESC, doc_id LIMIT 50),
    q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), k AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings CROSS JOIN q), b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM k ORDER BY score DESC, id LIMIT 50),
    u AS (SELECT *, 'text' AS source FROM a UNION ALL SELECT *, 'vector' FROM b)"""


def lists(t):
    from ..operators import knn

    words = fusion.top(search.bm25(t.documents, "doc_id", "text", "erti hath").withColumnRenamed("doc_id", "id"), 50)
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    near = knn.search(vectors, "id", "embedding", [knn.vector_of(vectors, "id", "embedding", 0)], 50)
    return [fusion.ranked(words, "text"), fusion.ranked(near, "vector")]


@query("rrf_60", f"WITH {_LISTS} SELECT id, round(sum(1.0 / (60 + rank)), 8) AS score FROM u GROUP BY 1")
def _(t):
    return fusion.rrf(lists(t)).select("id", F.round("score", 8).alias("score"))


@query("rrf_weighted", f"WITH {_LISTS} SELECT id, round(sum((CASE WHEN source = 'vector' THEN 0.6 ELSE 1.0 END) / (60 + rank + 1)), 8) AS score FROM u GROUP BY 1")
def _(t):
    return fusion.rrf(lists(t), 60, 1, {"vector": 0.6}).select("id", F.round("score", 8).alias("score"))


@query(
    "rrf_adaptive",
    f"""WITH {_LISTS}, z AS (SELECT source, CASE WHEN count(*) < 2 THEN 60 WHEN stddev_pop(score) < 0.05 THEN 120 WHEN stddev_pop(score) > 0.3 THEN 20 ELSE floor(120 - 100 * (stddev_pop(score) - 0.05) / 0.25) END AS k FROM u GROUP BY 1)
    SELECT id, round(sum(1.0 / (k + rank + 1)), 8) AS score FROM u JOIN z USING (source) GROUP BY 1""",
)
def _(t):
    return fusion.rrf_adaptive(lists(t)).select("id", F.round("score", 8).alias("score"))


@query(
    "hybrid_rrf",
    f"""WITH {_LISTS}, f AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY 1) SELECT id, lang, round(score, 8) AS score FROM f JOIN documents ON doc_id = id WHERE lang = 'en' ORDER BY f.score DESC, id LIMIT 10""",
)
def _(t):
    docs = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"), "lang")
    return fusion.top(docs.join(fusion.rrf(lists(t)), "id"), 10).select("id", "lang", F.round("score", 8).alias("score"))


@query(
    "federated_topk",
    f"""WITH {_LISTS}, m AS (SELECT id, source, score + 1.0 / (60 + rank) + CASE WHEN source = 'vector' THEN 0.1 ELSE 0 END AS s FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, source) AS n FROM m)
    SELECT id, round(s, 6) AS score, source AS member FROM r WHERE n = 1 ORDER BY s DESC, id LIMIT 20""",
)
def _(t):
    a, b = lists(t)
    return fusion.federated({"text": a.select("id", "score"), "vector": b.select("id", "score")}, 20, "vector").withColumn("score", F.round("score", 6))


@query("code_search")
def _(t):
    rows = t.pages.select(F.col("page_id").alias("id"), F.regexp_extract("url", r"//[^/]+(/[^?#]*)", 1).alias("path"), F.coalesce("html", F.lit("")).alias("text"))
    return recall.code_search(rows, "track article", 20).withColumn("score", F.round("score", 6))


@query("top_k_per_group", "SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def _(t):
    return relational.best_per_key(t.documents.select("lang", "doc_id", "n_chars"), "lang", "n_chars", "doc_id")
