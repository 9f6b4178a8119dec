"""A small table of documents with everything that goes wrong in one."""

from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of other tables and of the operators' own steps.
CLASHES = ("id", "h", "hs", "kept", "score", "bucket", "learn", "mark", "toks", "item_id", "text_sha256", "sketch", "decoded", "group_size", "l_id", "c0")

WORDS = {
    "en": "the of and to in is that it for was on are with as his they at be this from have or by one had not but what all were when".split(),
    "fr": "le la les des et que qui dans pour une sur avec plus pas par est sont comme mais nous vous être même très où déjà".split(),
    "de": "der die und das nicht ein ist mit sich auf für dem auch wird über nach wie aus bei noch größer möglich schön".split(),
}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "", rng.choice("abcdefgh") + rng.choice("aeiou")]) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


def rows() -> list[tuple]:
    rng = random.Random(11)
    out = []
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        out.append((i, prose(rng, rng.randrange(20, 120), lang), lang, f"src{i % 4}", 100))
    copy = prose(rng, 60)
    out += [(100 + i, copy, "en", "hot", 10) for i in range(12)]  # a group of copies
    out += [(120 + i, copy.replace(" ", "  " if i else "\t\n"), None, None, None) for i in range(3)]  # equal but for white space
    out += [(130, copy + " more", "en", "hot", 10), (131, copy.upper(), "en", "hot", 10)]
    out += [(140, None, None, None, None), (141, "", "en", "s", 0), (142, " \t\n ", "en", "s", 3), (143, "a", "de", "s", 1), (144, "漢字 😀 été", None, "s", 8), (145, "... 123 !!!", "en", "s", 11)]
    out += [(None, prose(rng, 40), "en", "s", 1), (None, None, None, None, None)]
    out += [(150, "twice the same row", "en", "s", 1)] * 3 + [(151, "one id", "en", "s", 1), (151, "two texts of it", "fr", "s", 1)]
    out += [(160, prose(rng, 60_000), "en", "long", 1), (161, "x" * 200_000, "en", "long", 200_000)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("extra").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def write_tables(tmp_path_factory):
    """A folder of tables from DataFrames, as queries read them."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
