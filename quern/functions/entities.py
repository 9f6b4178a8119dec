"""Names in text: code, paths, identifiers, quotations and symbols; personal data; captured knowledge; preferences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import contains_any
from .text import once

# How languages declare what they name.
SYMBOLS = (
    ("rust", r"\b([A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+)\b"),
    ("rust", r"\b(?:fn|struct|impl|trait|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("python", r"\b(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("ts", r"\b(?:function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("go", r"\bfunc\s+(?:\([^)]*\)\s+)?([A-Za-z_][A-Za-z0-9_]*)"),
    ("java", r"\b(?:public|private|protected|internal)\s+(?:static\s+)?[A-Za-z_][A-Za-z0-9_<>,\s]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
)
_SYMBOLS = tuple((lang, re.compile(p)) for lang, p in SYMBOLS)
_IDENTIFIER = re.compile(r"\w{4,}")
_MOST = 200


def snake(name: str) -> str:
    """AuthModule to auth_module, HTTPClient to http_client."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def is_path(s: str) -> bool:
    if len(s) < 3:
        return False
    return s.startswith(("/", "./", "../")) or ("/" in s and bool(re.search(r"\.[^\W_]{1,10}$", s)))


def entities(text: str) -> list[dict]:
    """name, entity_type, lang, source_text of each name, once; kinds are tried in a fixed order and the first one counts."""
    out: list[dict] = []
    seen: set[str] = set()

    def add(key: str, name: str, kind: str, source: str, lang: str | None = None) -> None:
        if key not in seen:
            seen.add(key)
            out.append({"name": name, "entity_type": kind, "lang": lang, "source_text": source})

    for m in re.finditer(r"`(?!`)([^`]*)`|``+", text):
        inner = (m[1] or "").strip()
        if inner and len(inner.encode()) <= _MOST:
            add(inner.lower(), inner, "file" if is_path(inner) else "code", inner)
    for word in text.split():
        bare = word.strip(",.;:)(\"'")
        if is_path(bare):
            add(bare.lower(), bare.removeprefix("./"), "file", bare)
    names = _IDENTIFIER.findall(text)
    for w in names:
        if w.isalnum() and sum(c.isupper() for c in w) >= 2 and any(c.islower() for c in w):
            add(w.lower(), snake(w), "code", w)
    for w in names:
        if "_" in w and not w.startswith("_") and not w.endswith("_") and w == w.lower():
            add(w, w, "code", w)
    for quote in "\"'":
        for m in re.finditer(f"{quote}([^{quote}]*){quote}", text):
            inner = m[1].strip()
            if len(inner.split()) >= 3 and len(inner.encode()) <= _MOST:
                add(inner.lower(), inner, "reference", inner)
    for lang, pattern in _SYMBOLS:
        for m in pattern.finditer(text):
            if 2 <= len(m[1]) <= _MOST:
                add(f"sym:{lang}:{m[1].lower()}", m[1], "symbol", m[1], lang)
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "entity_type", "lang", "source_text")])))
def extract_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: entities(t) if t else [])


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def ipv4(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IPV4), F.lit(0))


# Phrases of errors and decisions, and those that rule them out.
ERRORS = ("error[e", "error:", "failed", "panicked at", "panic!", "exception:", "traceback", "fatal", "segfault", "cannot find", "not found", "permission denied", "connection refused", "timed out", "out of memory")
DECISIONS = ("decided to", "switching to", "adopted ", "going with", "let's use", "chose to ", "decision:", "we picked ", "we settled on", "moved from ")
NO_CAPTURE = ("no matches found", "0 failed", "0 failures", "test result: ok", "all tests passed", "tests passed", "don't panic", "do not panic", "with the exception of", "exception handling", "no errors", "no error found")
# What an error line must also name for a weak phrase to count.
FAILED_NEEDS = ("test", "build", "compile", "exit", "assertion", "check", "job", "step", "pipeline", "deploy", "migration", "request")
CANNOT_FIND_NEEDS = ("crate", "module", "function", "method", "file", "package", "library", "dependency", "symbol")
FATAL_NEEDS = ("fatal error", "fatal:", "fatal exception", "fatal signal")


def captures(text: Column) -> Column:
    """What a text tells that is worth keeping: an array of at most an error line and a decision line (kind, summary).

    The first phrase, in the order of the lists, whose first line has 20 bytes and isn't a known false alarm; texts
    under 30 bytes or with a phrase that rules captures out give none. A decision is never on the error's line.
    """
    none = F.array().cast("array<struct<kind:string,summary:string>>")
    found = once(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), _captures)
    return F.when((F.octet_length(text) >= 30) & ~contains_any(F.lower(text), NO_CAPTURE) & contains_any(F.lower(text), ERRORS + DECISIONS), found).otherwise(none)


def _captures(lines: Column) -> Column:
    def line_with(phrase: str) -> Column:
        return F.get(F.filter(lines, lambda x: F.contains(F.lower(x), F.lit(phrase))), F.lit(0))

    def sound(phrase: str, line: Column) -> Column:
        low = F.lower(line)
        good = F.octet_length(line) >= 20
        if phrase == "failed":
            return good & contains_any(low, FAILED_NEEDS)
        if phrase == "not found":
            return good & ~F.contains(low, F.lit("if "))
        if phrase == "cannot find":
            return good & contains_any(low, CANNOT_FIND_NEEDS)
        return good & contains_any(low, FATAL_NEEDS) if phrase == "fatal" else good

    def error_line(phrase: str) -> Column:
        return once(line_with(phrase), lambda line: F.when(sound(phrase, line), line))

    error = F.coalesce(*map(error_line, ERRORS))

    def decision(taken: Column) -> Column:
        def line(phrase: str) -> Column:
            return F.get(F.filter(lines, lambda x: F.contains(F.lower(x), F.lit(phrase)) & ~F.coalesce(x == taken, F.lit(False))), F.lit(0))

        return F.coalesce(*(F.when(F.octet_length(line(p)) >= 20, line(p)) for p in DECISIONS))

    entry = lambda kind, line: F.struct(F.lit(kind).alias("kind"), F.substring(line, 1, 200).alias("summary"))
    return once(error, lambda e: F.filter(F.array(entry("error", e), entry("decision", decision(e))), lambda x: x["summary"].isNotNull()))


# Words that tell the type of a memory.
PREFERENCE = ("prefer", "always", "never", "don't like", "i like", "i want", "should always", "should never", "habit", "convention", "rule:", "rule is")
PROCEDURAL = ("how to", "steps to", "procedure", "workflow", "recipe", "pattern:", "to do this", "the way to", "process:", "run this", "execute", "deploy by")
EPISODIC = ("session", "today", "yesterday", "just now", "happened", "completed", "finished", "started", "ended", "we did", "i did", "worked on")
BELIEF = ("believe", "i think", "it seems", "likely", "probably", "truth is", "the fact is", "in my understanding")


def memory_type(text: Column, n_entities: Column) -> Column:
    """semantic, episodic, procedural, preference or belief: that with most signal words; two entities count as two."""
    low = F.lower(text)
    count = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws[1:]), F.contains(low, F.lit(ws[0])).cast("int"))
    scores = {"episodic": count(EPISODIC), "procedural": count(PROCEDURAL), "preference": count(PREFERENCE), "belief": count(BELIEF)}
    most = F.greatest(*scores.values(), F.least(n_entities, F.lit(2)))
    out = F.when((most == 0) | ((n_entities >= 2) & (most == 2)), "semantic")
    for name, score in scores.items():
        out = out.when(score == most, name)
    return out.otherwise("semantic")


def memory_scope(kind: Column, text: Column, source: Column) -> Column:
    """session, project, user or global."""
    here = contains_any(F.lower(text), ("this project", "this repo", "here we"))
    return F.when(source.isin("hook", "file"), "project").when(kind == "working", "session").when(kind == "preference", "user").when((kind == "procedural") & ~here, "global").otherwise("project")


def preferences(text: Column) -> Column:
    """Statements of preference: an array of sentences of the forms I like/love/enjoy/prefer, Always/Never, Use ... for ..."""
    form = r"(?im)(?:\bI (?:like|love|enjoy|prefer) [^.\n]+|^\s*(?:[-*]\s*)?(?:Always|Never) [^.\n]+|\bUse [^.\n]+? for [^.\n]+)"
    return F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda x: F.trim(x))


def redacted(column: Column, there: Column) -> Column:
    return F.when(there, F.lit("[REDACTED]")).otherwise(column)
