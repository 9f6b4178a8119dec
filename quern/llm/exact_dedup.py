"""Exact deduplication against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, split_join, written

#: A run of white space that is not already one plain space.
_OTHER_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

#: Batches in which a table goes through an index that is made for it.
BATCHES = 2


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text with each run of white space as one space (null as empty)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), _OTHER_RUN, " ")
    return docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"))


class DigestIndex:
    """A table (text_sha256, keep_id, group_size, batch) in the warehouse, bucketed and sorted by text_sha256.

    Each digest is in the index once, as the batch that brought it had it. A batch is reduced to its own digests first,
    so a group of copies of any size shrinks to a row a task before the shuffle; a sort-merge anti-join then leaves what
    is new, and that is appended. The index side of the join needs no exchange, as its buckets are those of the join.
    What a batch has of known digests is appended to a second table of the same form, so that later batches count:
    `totals` merges both. A batch that is appended again under its name (after a failure, say) changes nothing.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.again, self.buckets = spark, name, f"{name}_again", buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    @staticmethod
    def groups(batch: DataFrame) -> DataFrame:
        """The batch's own digests with their smallest doc_id and number of rows."""
        return batch.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    def new(self, groups: DataFrame) -> DataFrame:
        """Of a batch's groups those that the index lacks."""
        return groups.join(self.table().hint("merge").select("text_sha256"), "text_sha256", "left_anti") if self.exists() else groups

    def known(self, groups: DataFrame) -> DataFrame:
        """Of a batch's groups those that the index has."""
        return groups.join(self.table().hint("merge").select("text_sha256"), "text_sha256", "left_semi") if self.exists() else groups.where("false")

    def append(self, batch: DataFrame, name: str | None = None) -> None:
        """Adds a batch of digests; the first one creates the tables."""
        groups = written(self.groups(batch).withColumn("batch", F.lit(name or uuid.uuid4().hex)), "groups")
        self._write(self.known(groups), self.again)  # first: what is new isn't known yet
        self._write(self.new(groups), self.name)
        discard(groups)

    def _write(self, rows: DataFrame, table: str) -> None:
        rows.repartition(self.buckets, "text_sha256").write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(table)

    def totals(self) -> DataFrame:
        """text_sha256, keep_id (the smallest doc_id of all batches), group_size (rows of all batches)."""
        first = self.table()
        more = self.spark.table(self.again).groupBy(F.col("text_sha256").alias("of"), F.col("batch").alias("later")).agg(F.min("keep_id").alias("id"), F.max("group_size").alias("rows"))
        each = first.join(more.hint("merge"), (F.col("text_sha256") == F.col("of")) & (F.col("batch") != F.col("later")), "left")
        size = F.first("group_size") + F.coalesce(F.sum("rows"), F.lit(0))
        return each.groupBy("text_sha256").agg(F.min(F.least("keep_id", "id")).alias("keep_id"), size.alias("group_size"))

    def drop(self) -> None:
        for table in (self.name, self.again):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def fresh_index(spark: SparkSession) -> DigestIndex:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets)


def _totals(own: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The totals of a fresh index that took the digests in batches; the index goes, as all is in the totals."""
    index = fresh_index(own.sparkSession)
    for b in range(batches):
        index.append(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b), str(b))
    totals = written(index.totals(), "totals")
    index.drop()
    return totals


def exact_groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    Without an index, docs go through a new one in two batches; with one, docs are appended to it as one batch, and
    keep_id and group_size count all batches that it has seen. Null texts count as empty; rows that repeat a doc_id and
    its text share their fate (all are kept, or none); a null doc_id loses to any other; an empty table gives no rows.
    """
    own = written(digests(docs), "digests")
    if index:
        index.append(own)
        totals = written(index.totals().join(own.select("text_sha256").distinct(), "text_sha256", "left_semi"), "totals")
    else:
        totals = _totals(own)
    found = split_join(own, totals.withColumn("rows", F.col("group_size")), ["text_sha256"], "rows", "doc_id")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat the kept doc_id and text, one."""
    names = docs.columns
    batch = written(digests(docs), "digests")
    totals = _totals(batch)
    again = batch.groupBy(F.col("doc_id").alias("_quern_id"), F.col("text_sha256").alias("_quern_of")).agg(F.count(F.lit(1)).alias("_quern_n"))
    keep = totals.select(F.col("text_sha256").alias("_quern_sha"), F.col("keep_id").alias("_quern_keep"))
    keep = keep.join(again, (F.col("_quern_sha") == F.col("_quern_of")) & F.col("_quern_keep").eqNullSafe(F.col("_quern_id"))).select("_quern_sha", "_quern_keep", "_quern_n")
    keep = written(keep, "keep")
    discard(batch, totals)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), _OTHER_RUN, " ")
    own = docs.withColumn("_quern_own", F.sha2(text, 256))
    stay = own.join(keep, (F.col("_quern_own") == F.col("_quern_sha")) & F.col("doc_id").eqNullSafe(F.col("_quern_keep")))
    if not keep.where("_quern_n > 1").take(1):
        return stay.select(*names)
    once = stay.where("_quern_n = 1").select(*names)
    return once.unionByName(stay.where("_quern_n > 1").dropDuplicates(["_quern_sha"]).select(*names))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays, through an index in two batches; nulls and ties as in exact_groups."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
