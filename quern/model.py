"""The data model: records, edges, vectors, changes and what is checked of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A schemaless record: data and metadata are JSON objects. Typed tables have their fields as columns instead.
RECORDS = "id string, table string, data string, created_at timestamp_ntz, updated_at timestamp_ntz, metadata string"
#: A directed edge; it holds from valid_from up to, not including, valid_until (null: without bound).
EDGES = "id string, src string, edge_type string, dst string, props string, created_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz"
VECTORS = "space string, id string, vector array<float>"
CHANGES = "change_id string, op string, table string, record_id string, before string, after string, created_at timestamp_ntz"

MAX_HOPS = 50
MAX_PATH_BYTES = 4096
MAX_EDGE_TYPE_BYTES = 256
MAX_EDGE_PROPS_BYTES = 65_536
MAX_QUERY_BYTES = 512
MAX_TEXT_BYTES = 65_536
MAX_TEXT_FIELDS = 32
DEFAULT_LIMIT = 100
RESERVED = ("id", "table", "created_at", "updated_at", "metadata")

_ULID = re.compile(r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$", re.I)


class QueryError(ValueError):
    """A query that can't be run: where it goes wrong and what may have been meant."""


def checked_id(text: str) -> str:
    """A record id in canonical form; QueryError where it isn't a ULID."""
    if not _ULID.match(text):
        raise QueryError(f"not a record id: {text!r}")
    return text.upper()


def is_system(table: Column) -> Column:
    """System tables start with an underscore; they stay out of text, vector and time search."""
    return F.startswith(table, F.lit("_"))


def valid_at(at: Column, valid_from: Column, valid_until: Column) -> Column:
    """Whether a half-open interval holds a time; null is without bound."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_until.isNull() | (at < valid_until))
