"""Code-intelligence indexes in protocol-buffer form: symbols and the edges between them and their files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roles of an occurrence.
DEFINITION, IMPORT = 1, 2
EDGES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("src", "edge_type", "dst", "confidence")]))


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a message; ValueError where it is cut short."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= n:
                raise ValueError("a message is cut short")
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < n:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else number()
        if size is None or at + size > n:
            raise ValueError("a message is cut short")
        yield key >> 3, data[at : at + size]
        at += size


def _packed(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(value)
            value = shift = 0
    return out


def _range(r: list[int]) -> tuple[tuple[int, int], tuple[int, int]]:
    """Start and end (line, column); three numbers are of one line."""
    return ((r[0], r[1]), (r[0], r[2])) if len(r) == 3 else ((r[0], r[1]), (r[2], r[3]))


def _occurrence(data: bytes) -> dict:
    out: dict = {"range": [], "symbol": "", "roles": 0, "enclosing": []}
    for n, v in fields(data):
        if n == 1:
            out["range"] += _packed(v) if isinstance(v, bytes) else [v]
        elif n == 2:
            out["symbol"] = v.decode()
        elif n == 3:
            out["roles"] = v
        elif n == 7:
            out["enclosing"] += _packed(v) if isinstance(v, bytes) else [v]
    return out


def _symbol(data: bytes) -> dict:
    out: dict = {"symbol": "", "relationships": []}
    for n, v in fields(data):
        if n == 1:
            out["symbol"] = v.decode()
        elif n == 4:
            got = dict(fields(v))
            out["relationships"].append((got.get(1, b"").decode(), bool(got.get(2)), bool(got.get(3)), bool(got.get(4))))
    return out


def index_edges(data: bytes) -> list[dict]:
    """Edges of an index: defined_in, references, implements and type_of as it says; calls and imports as places suggest.

    A call is a use inside the innermost definition around it; an import leads to the file that defines the symbol.
    """
    docs = []
    for n, v in fields(data):
        if n != 2:
            continue
        doc: dict = {"path": "", "occurrences": [], "symbols": []}
        for k, x in fields(v):
            if k == 1:
                doc["path"] = x.decode()
            elif k == 2:
                doc["occurrences"].append(_occurrence(x))
            elif k == 3:
                doc["symbols"].append(_symbol(x))
        docs.append(doc)
    home = {o["symbol"]: d["path"] for d in docs for o in d["occurrences"] if o["roles"] & DEFINITION}
    found: dict[tuple[str, str, str], str] = {}
    for d in docs:
        inside = []
        for o in d["occurrences"]:
            if o["roles"] & DEFINITION and len(o["range"]) in (3, 4):
                found.setdefault((o["symbol"], "defined_in", d["path"]), "direct")
                inside.append((*_range(o["enclosing"] if len(o["enclosing"]) in (3, 4) else o["range"]), o["symbol"]))
        for s in d["symbols"]:
            for target, reference, implementation, type_ in s["relationships"]:
                for yes, edge in ((reference, "references"), (implementation, "implements"), (type_, "type_of")):
                    if yes:
                        found.setdefault((s["symbol"], edge, target), "direct")
        for o in d["occurrences"]:
            if o["roles"] & DEFINITION or len(o["range"]) not in (3, 4):
                continue
            if o["roles"] & IMPORT:
                other = home.get(o["symbol"])
                if other and other != d["path"]:
                    found.setdefault((d["path"], "imports", other), "heuristic")
                continue
            a, b = _range(o["range"])
            around = [x for x in inside if x[0] <= a and b <= x[1]]
            if around and (caller := max(around, key=lambda x: x[0])[2]) != o["symbol"]:
                found.setdefault((caller, "calls", o["symbol"]), "heuristic")
    return [{"src": s, "edge_type": e, "dst": t, "confidence": c} for (s, e, t), c in found.items()]


@F.pandas_udf(EDGES)
def edges_of(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: index_edges(bytes(c)) if c is not None else [])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, edge_type, dst, confidence of all index files under a path, each edge once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.explode(edges_of("content")).alias("e")).select("e.*")
    return rows.groupBy("src", "edge_type", "dst").agg(F.min("confidence").alias("confidence"))
