"""From documents to training tokens: five stages, each on all that the one before kept.

Stages 1 to 4 filter: they return rows of their input, with its columns. The last adds token_ids, n_tokens and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, exact_dedup, language, pieces, simhash
from quern.llm.common import held_out, written

#: A document whose language the model gives less than this probability is rejected, as is one without a letter.
LEAST_SCORE = 0.5

#: Near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or more, which is verified for each link. Texts
#: meet in 24 bands of 4 minima, of which at 0.8 one at least agrees but once in a million times; limits on the bits of
#: their sketches only spare comparisons: of 4 shingles and 5, 96 of 512 bits are expected to differ, and 12 of 64.
SHINGLE, RADIUS, WORDS, FULL, BANDS, SIMILAR = 5, 32, 8, 150, (24, 4), 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own lang (four fifths of them) and keeps documents of a recognised language.

    Null and empty texts, and texts without a letter, are rejected; rows that repeat are judged each, and alike.
    """
    model = language.train(docs, ~held_out(5, 0))
    plain = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    found = language.identify(docs.toDF(*plain), model, *plain, text=plain[docs.columns.index("text")])
    kept = found.where((F.col("lang_pred") != language.UNDECIDED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*plain).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, the one with the smallest doc_id stays; a null doc_id loses to any other.

    Null texts equal empty ones; of rows that repeat the doc_id that stays, one stays.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8, the one with the smallest doc_id stays; a null doc_id loses to any other.

    Texts without a word are alike; of rows that repeat doc_id and text, one stays.
    """
    return simhash.keep_one(docs, simhash.near_groups(docs, SHINGLE, RADIUS, WORDS, FULL, distinct=True, bands=BANDS, least=SIMILAR))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts, and all with an empty benchmark, stay."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole text, and the text that they decode to; null and empty texts have no tokens."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    done = pieces.encode_decode(docs.toDF(*plain), pieces.MODEL, *plain, text=plain[docs.columns.index("text")])
    return done.select(*(F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)), "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model, sketches and a transducer aren't SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
