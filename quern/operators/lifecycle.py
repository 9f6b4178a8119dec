"""What is done to records over their life: batches in, feedback, inferences, procedures, consent, checkpoints, rules, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import age_days, at, importance
from ..functions.vectors import cosine
from . import knn
from .relational import latest_per_key

# Fields that may hold a record's text, in the order in which older callers look for it.
LEGACY_FIELDS = ("summary", "content", "text", "description", "message", "fact", "error")


def select_fields(df: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """The key and the fields that the table has, in the order asked for; unknown ones are left out."""
    return df.select(key, *(f for f in fields if f in df.columns and f != key))


def insert_batch(df: DataFrame, new: DataFrame, now: object, text: str) -> DataFrame:
    """df with new rows, which get created_at, updated_at and _importance where they lack them."""
    fields = F.lit(len(new.columns))
    derived = {"created_at": at(now), "updated_at": at(now), "_importance": importance(F.col(text), F.lit(0), fields, F.lit(None).cast("string"))}
    rows = new.withColumns({c: v for c, v in derived.items() if c not in new.columns})
    return df.unionByName(rows, allowMissingColumns=True)


def insert_raw(df: DataFrame, new: DataFrame) -> DataFrame:
    """df with new rows as they are."""
    return df.unionByName(new, allowMissingColumns=True)


def pending_inferences(inferred: DataFrame, edges: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Inferred edges (src, derived, dst, confidence) that are neither edges already nor rejected before."""
    known = edges.select("src", F.col("edge_type").alias("derived"), "dst")
    known = known if rejected is None else known.unionByName(rejected.select("src", "derived", "dst"))
    return inferred.dropDuplicates(["src", "derived", "dst"]).join(known, ["src", "derived", "dst"], "left_anti").withColumn("status", F.lit("pending"))


def decide(pending: DataFrame, confirmed: Column) -> tuple[DataFrame, DataFrame]:
    """The edges (src, edge_type, dst) that a decision makes of pending inferences, and what it rejects."""
    return pending.where(confirmed).select("src", F.col("derived").alias("edge_type"), "dst"), pending.where(~confirmed).select("src", "derived", "dst")


def mark_relevant(entries: DataFrame, marks: DataFrame, now: object, least: float = 0.95, most: int = 10_000) -> DataFrame:
    """Entries (entry_id, record, embedding, count, last_used) after marks (mark_id, record, embedding): the newest `most`.

    A mark counts for the first entry of its record with a cosine over least, or is an entry of its own. Marks of one
    batch are not merged with each other.
    """
    pairs = marks.join(entries.select("entry_id", "record", F.col("embedding").alias("known")), "record").where(cosine(F.col("embedding"), F.col("known")) > least)
    found = pairs.groupBy("mark_id").agg(F.min("entry_id").alias("entry_id"))
    uses = found.groupBy("entry_id").agg(F.count(F.lit(1)).alias("more"))
    old = entries.join(uses, "entry_id", "left").withColumns({"count": F.col("count") + F.coalesce("more", F.lit(0)), "last_used": F.when(F.col("more").isNull(), F.col("last_used")).otherwise(at(now))}).drop("more")
    new = marks.join(found, "mark_id", "left_anti").select(F.col("mark_id").alias("entry_id"), "record", "embedding", F.lit(1).cast("long").alias("count"), at(now).alias("last_used"))
    return old.unionByName(new).orderBy(F.col("last_used").desc(), "entry_id").limit(most)


def how(procedures: DataFrame, query: list[float], k: int, live: Column, confidence: Column) -> DataFrame:
    """id, score of the best procedures (id, vector): of the 3 k most similar those that live, by similarity and confidence (0.5 where unknown)."""
    near = knn.search(procedures, "id", "vector", [query], 3 * k).select("id", F.col("score").alias("similarity"))
    score = F.col("similarity") * F.coalesce(confidence, F.lit(0.5))
    return procedures.join(near, "id").where(live).select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def similar_episodes(episodes: DataFrame, query: list[float], k: int, hidden: Column) -> DataFrame:
    """id, score of the nearest episodes (id, vector) that aren't expired, superseded or otherwise hidden."""
    return knn.search(episodes.where(~F.coalesce(hidden, F.lit(False))), "id", "vector", [query], k).select("id", "score")


def in_space(vectors: DataFrame, space: object, dims: int, column: str = "space") -> DataFrame:
    """The vectors of one named space; ValueError at run time where one has other dimensions than its space."""
    rows = vectors.where(F.col(column) == F.lit(space))
    wrong = F.raise_error(F.lit(f"a vector of space {space} hasn't {dims} dimensions")).cast("array<float>")
    return rows.withColumn("vector", F.when(F.size("vector") == dims, F.col("vector")).otherwise(wrong))


def duplicates_of_latest(df: DataFrame, table: str, time: str, text: str, least: float = 0.95, newest: int = 50, least_chars: int = 20) -> DataFrame:
    """a, b, score of near copies among each table's newest records (id, vector) with enough text."""
    rank = F.row_number().over(Window.partitionBy(table).orderBy(F.col(time).desc(), F.col("id").desc()))
    rows = df.withColumn("_r", rank).where((F.col("_r") <= newest) & (F.length(text) >= least_chars))
    return knn.similarity_join(rows.select("id", "vector", table), "id", "vector", least, table)


def readable(records: DataFrame, workspace: object, member: object, roles: tuple = (), strict: bool = False) -> DataFrame:
    """Records (consent, workspace, member, members, roles) that a caller may read; its own always, unknown kinds never."""
    own = (F.col("workspace") == F.lit(workspace)) & (F.col("member") == F.lit(member))
    kind = F.col("consent")
    shared = F.arrays_overlap("roles", F.array(*map(F.lit, roles))) if roles else F.lit(False)
    allowed = (
        F.when(kind == "public", True)
        .when(kind == "workspace", F.lit(not strict) & (F.col("workspace") == F.lit(workspace)))
        .when(kind == "members", F.array_contains("members", F.lit(member)))
        .when(kind == "roles", shared)
        .otherwise(False)
    )
    return records.where(F.coalesce(own, F.lit(False)) | F.coalesce(allowed, F.lit(False)))


def stale_beliefs(beliefs: DataFrame, time: str, now: object, days: int = 60) -> DataFrame:
    """Beliefs that nothing has confirmed for longer than some days."""
    return beliefs.where(age_days(time, now) > days)


def checkpoint_to_resume(checkpoints: DataFrame, session: str, time: str, key: str) -> DataFrame:
    """The latest checkpoint of each session, whole."""
    return latest_per_key(checkpoints, session, time, key)


def rules_in_force(log: DataFrame, rule: str, value: str, time: str, key: str) -> DataFrame:
    """rule, value: of each rule what was set last; one that was last set to null is none."""
    last = log.groupBy(F.col(rule).alias("rule")).agg(F.max_by(F.struct(F.col(value).alias("value")), F.struct(time, key)).alias("x"))
    return last.select("rule", "x.value").where(F.col("value").isNotNull())


def retained(df: DataFrame, kind: str, time: str, now: object, days: dict[str, int], pinned: Column) -> DataFrame:
    """Rows that a policy keeps: pinned ones, kinds without a limit, and those not older than their kind's limit."""
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in days.items() for x in kv)), F.col(kind))
    return df.where(F.coalesce(pinned, F.lit(False)) | limit.isNull() | (age_days(time, now) <= limit))


def string_array(data: Column, field: str) -> Column:
    """The strings of an array field of JSON; none where there is no array, other elements left out."""
    items = F.from_json(F.get_json_object(data, f"$.{field}"), "array<string>")
    kinds = F.from_json(F.get_json_object(data, f"$.{field}"), "array<variant>")
    strings = F.filter(F.arrays_zip(items.alias("s"), kinds.alias("v")), lambda x: F.schema_of_variant(x["v"]) == "STRING")
    return F.coalesce(F.transform(strings, lambda x: x["s"]), F.array().cast("array<string>"))


def legacy_text(data: Column) -> Column:
    """The first of LEGACY_FIELDS that a JSON object has as a string, else its string values joined."""
    fields = F.from_json(data, "map<string,variant>")
    of = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    strings = F.array_compact(F.transform(F.map_values(fields), of))
    return F.coalesce(*(of(F.element_at(fields, f)) for f in LEGACY_FIELDS), F.array_join(strings, " "))


def truncated(text: Column, size: int) -> Column:
    """The longest beginning of a text with at most size bytes of UTF-8 that ends between characters."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, size).cast("string"))
    return F.when(F.octet_length(text) <= size, text).otherwise(F.regexp_replace(cut, "�+$", ""))


def reflection(mentions: DataFrame, outcomes: DataFrame, ends: DataFrame) -> DataFrame:
    """section, name, n: the three entities (name) most spoken of, how often each outcome (name), the two ends (name) with most edges."""
    count = lambda df, section: df.groupBy(F.col("name").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n")
    best = lambda df, n: df.orderBy(F.col("n").desc(), "name").limit(n)
    return best(count(mentions, "entities"), 3).unionByName(count(outcomes, "outcomes")).unionByName(best(count(ends, "connected"), 2))


def equivalents(entities: DataFrame, bridges: DataFrame) -> DataFrame:
    """workspace, id, other_workspace, other_id: what bridges (a_workspace, a_id, b_workspace, b_id) say is the same elsewhere, read both ways."""
    back = bridges.select(F.col("b_workspace").alias("a_workspace"), F.col("b_id").alias("a_id"), F.col("a_workspace").alias("b_workspace"), F.col("a_id").alias("b_id"))
    both = bridges.select("a_workspace", "a_id", "b_workspace", "b_id").unionByName(back).distinct()
    return entities.join(both, (F.col("workspace") == F.col("a_workspace")) & (F.col("id") == F.col("a_id"))).select("workspace", "id", F.col("b_workspace").alias("other_workspace"), F.col("b_id").alias("other_id"))


def due(tasks: DataFrame, now: object) -> DataFrame:
    """Maintenance tasks (task, last_run, every_seconds) whose time has come; one that never ran is due."""
    age = F.unix_micros(at(now).cast("timestamp")) - F.unix_micros(F.col("last_run").cast("timestamp"))
    return tasks.where(F.col("last_run").isNull() | (age >= F.col("every_seconds") * 1_000_000))


def cache_after(cache: DataFrame, changes: DataFrame) -> DataFrame:
    """Cached answers (query, records) that name no changed record (record)."""
    used = cache.select("query", F.explode("records").alias("record"))
    stale = used.join(changes.select("record").distinct(), "record", "left_semi").select("query").distinct()
    return cache.join(stale, "query", "left_anti")
