"""Files as rows: source trees, sections of documents and configuration, declared symbols and dependencies."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 512 * 1024
# Languages by file name ending.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "rb": "ruby", "md": "markdown", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json"}


def _rows(**kinds: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in kinds.items()]))


_TEXT, _INT = T.StringType(), T.IntegerType()
SECTIONS = _rows(depth=_INT, path=_TEXT, heading=_TEXT, line_start=_INT, line_end=_INT, body=_TEXT)
SYMBOLS = _rows(kind=_TEXT, name=_TEXT, line=_INT, signature=_TEXT, doc=_TEXT)
DEPENDENCIES = _rows(ecosystem=_TEXT, name=_TEXT, requirement=_TEXT, dev=T.BooleanType())
MIN_SECTION_BYTES = 40


def source_files(spark: SparkSession, path: str, endings: list[str] | None = None) -> DataFrame:
    """path, language, digest, text of the files under a folder, up to 512 KB each; the size filter keeps others unread."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MOST_BYTES)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[ending]
    rows = raw.select("path", F.coalesce(language, F.lit("other")).alias("language"), F.sha2("content", 256).alias("digest"), F.col("content").cast("string").alias("text"))
    return rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(endings)) if endings else rows


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose digest isn't known under their path."""
    return files.join(known.select("path", "digest"), ["path", "digest"], "left_anti")


def _section(depth: int, path: list[str], start: int, end: int, lines: list[str]) -> dict:
    return {"depth": depth, "path": " > ".join(path), "heading": path[-1] if path else "(document)", "line_start": start, "line_end": max(start, end), "body": "\n".join(lines).strip()}


def markdown_sections(text: str) -> list[dict]:
    """A section for each ATX heading outside fences, with the headings above it; one for the whole where there is none."""
    lines = text.splitlines()
    if not lines:
        return []
    heads, fence = [], None
    for i, raw in enumerate(lines):
        line = raw.lstrip()
        if m := re.match(r"(`{3,}|~{3,})(.*)", line):
            if fence is None:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            continue
        if fence is None and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)) and m[2]:
            heads.append((i, len(m[1]), m[2]))
    if not heads:
        return [_section(0, [], 1, len(lines), lines)]
    out, trail = [], []
    for k, (i, depth, title) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        trail = [t for t in trail if t[0] < depth] + [(depth, title)]
        out.append(_section(depth, [t[1] for t in trail], i + 1, end, lines[i + 1 : end]))
    return out


def _flat(text: str, heads: list[tuple[int, str]], root: bool) -> list[dict]:
    lines = text.splitlines()
    out = []
    first = heads[0][0] if heads else len(lines)
    if root and any(x.strip() and not x.strip().startswith("#") for x in lines[:first]):
        out.append(_section(1, ["(root)"], 1, first, lines[:first]))
    for k, (i, name) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        out.append(_section(1, [name], i + 1, end, lines[i + 1 : end]))
    return out


def toml_sections(text: str) -> list[dict]:
    """A section for each table; sub-tables belong to the table they follow, each of an array of tables is its own."""
    heads, now = [], None
    for i, line in enumerate(text.splitlines()):
        m = re.match(r"\s*(\[\[?)\s*([^\[\]]+?)\s*\]\]?\s*(?:#.*)?$", line)
        if not m:
            continue
        top = re.split(r"\.(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", m[2])[0].strip().strip('"')
        if m[1] == "[" and "." in m[2] and top == now:
            continue
        heads.append((i, top))
        now = top
    return _flat(text, heads, True)


def yaml_sections(text: str) -> list[dict]:
    """A section for each top-level key."""
    heads = [(i, m[1].strip("\"'")) for i, line in enumerate(text.splitlines()) if (m := re.match(r"([^\s#:\-][^:]*):(?:\s|$)", line))]
    return _flat(text, heads, False)


def json_sections(text: str) -> list[dict]:
    """A section for each top-level key of an object; none of what isn't one."""
    try:
        got = json.loads(text)
    except ValueError:
        return []
    n = max(1, len(text.splitlines()))
    return [_section(1, [k], 1, n, [json.dumps(v, indent=2, ensure_ascii=False)]) for k, v in got.items()] if isinstance(got, dict) else []


SPLITTERS = {"markdown": markdown_sections, "toml": toml_sections, "yaml": yaml_sections, "json": json_sections}


@F.pandas_udf(SECTIONS)
def sections_of(texts: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([SPLITTERS[k](t) if t and k in SPLITTERS else [] for t, k in zip(texts, languages, strict=True)])


def sections(files: DataFrame, least_bytes: int = 0) -> DataFrame:
    """path, depth, section_path, heading, lines and body of each section of files (path, language, text)."""
    rows = files.where(F.col("language").isin(*SPLITTERS)).select("path", F.explode(sections_of("text", "language")).alias("s"))
    out = rows.select("path", "s.depth", F.col("s.path").alias("section_path"), "s.heading", "s.line_start", "s.line_end", "s.body")
    return out.where(F.octet_length("body") >= least_bytes) if least_bytes else out


# How languages declare what others may use.
_DECLARATIONS = {
    "rust": (("function", r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+)?fn[ \t]+(\w+)"), ("struct", r"^[ \t]*pub[ \t]+struct[ \t]+(\w+)"), ("enum", r"^[ \t]*pub[ \t]+enum[ \t]+(\w+)"), ("trait", r"^[ \t]*pub[ \t]+trait[ \t]+(\w+)"), ("type", r"^[ \t]*pub[ \t]+type[ \t]+(\w+)"), ("const", r"^[ \t]*pub[ \t]+(?:const|static)[ \t]+(\w+)"), ("import", r"^use[ \t]+([\w:]+)")),
    "python": (("class", r"^class[ \t]+(\w+)"), ("function", r"^(?:async[ \t]+)?def[ \t]+(\w+)"), ("method", r"^[ \t]+(?:async[ \t]+)?def[ \t]+(?!__)(\w+)"), ("import", r"^(?:from[ \t]+(\S+)[ \t]+)?import[ \t]+\S+")),
    "typescript": (("function", r"^export[ \t]+(?:async[ \t]+)?function[ \t]+(\w+)"), ("const", r"^export[ \t]+const[ \t]+(\w+)"), ("class", r"^export[ \t]+(?:default[ \t]+)?class[ \t]+(\w+)"), ("interface", r"^export[ \t]+(?:default[ \t]+)?interface[ \t]+(\w+)"), ("type", r"^export[ \t]+type[ \t]+(\w+)"), ("enum", r"^export[ \t]+(?:const[ \t]+)?enum[ \t]+(\w+)"), ("import", r"^import[ \t]+.*?from[ \t]+['\"]([^'\"]+)['\"]")),
    "other": (("function", r"^[ \t]*(?:func|def|function|pub fn)[ \t]+(\w+)"), ("class", r"^[ \t]*(?:class|struct|type)[ \t]+(\w+)")),
}
_DECLARATIONS["javascript"] = _DECLARATIONS["typescript"]
_COMMENT = re.compile(r"^\s*(?:///?|#|--|\*)\s?(.*)$")


def symbols(text: str, language: str) -> list[dict]:
    """kind, name, line, signature and the comment above of each declaration, by line."""
    lines, out = text.splitlines(), []
    for kind, pattern in _DECLARATIONS.get(language, _DECLARATIONS["other"]):
        for m in re.finditer(pattern, text, re.M):
            name = m[1] or re.sub(r"^import\s+", "", m[0]).strip()
            line = text.count("\n", 0, m.start()) + 1
            doc, i = [], line - 2
            while i >= 0 and (c := _COMMENT.match(lines[i])):
                doc.insert(0, c[1])
                i -= 1
            out.append({"kind": kind, "name": name, "line": line, "signature": lines[line - 1].strip().rstrip("{:").strip(), "doc": " ".join(doc).strip() or None})
    return sorted(out, key=lambda s: (s["line"], s["kind"]))


@F.pandas_udf(SYMBOLS)
def symbols_of(texts: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([symbols(t, k) if t else [] for t, k in zip(texts, languages, strict=True)])


def code_symbols(files: DataFrame) -> DataFrame:
    """path, language and each declaration of files (path, language, text)."""
    return files.select("path", "language", F.explode(symbols_of("text", "language")).alias("s")).select("path", "language", "s.*")


def _requirements(text: str) -> Iterator[tuple[str, str, bool]]:
    for line in text.splitlines():
        if m := re.match(r"\s*([A-Za-z0-9][\w.\-]*)(?:\[[^\]]*\])?\s*([^#;]*)", line.split("#")[0]):
            yield m[1], m[2].strip(), False


def dependencies(path: str, text: str) -> list[dict]:
    """What a manifest declares; nothing of a file that is none or is broken."""
    name = path.rsplit("/", 1)[-1]
    got: list[tuple[str, str, bool]] = []
    kind = {"Cargo.toml": "cargo", "package.json": "npm", "requirements.txt": "python", "pyproject.toml": "python", "go.mod": "go", "pom.xml": "java"}.get(name)
    try:
        if name == "Cargo.toml":
            data = tomllib.loads(text)
            for key, dev in (("dependencies", False), ("dev-dependencies", True), ("build-dependencies", True)):
                got += [(n, v if isinstance(v, str) else str(v.get("version", "")), dev) for n, v in data.get(key, {}).items()]
        elif name == "package.json":
            data = json.loads(text)
            for key, dev in (("dependencies", False), ("devDependencies", True)):
                got += [(n, str(v), dev) for n, v in data.get(key, {}).items()]
        elif name == "pyproject.toml":
            project = tomllib.loads(text).get("project", {})
            got += _requirements("\n".join(project.get("dependencies", [])))
            got += [(n, r, True) for extra in project.get("optional-dependencies", {}).values() for n, r, _ in _requirements("\n".join(extra))]
        elif name == "requirements.txt":
            got += _requirements(text)
        elif name == "go.mod":
            got += [(m[1], m[2], False) for m in re.finditer(r"^\s*(?:require\s+)?([\w.\-]+(?:/[\w.\-]+)+)\s+(v\S+)", text, re.M)]
        elif name == "pom.xml":
            root = ElementTree.fromstring(text)
            space = root.tag.split("}")[0] + "}" if root.tag.startswith("{") else ""
            for d in root.iter(f"{space}dependency"):
                part = lambda t: (d.findtext(f"{space}{t}") or "").strip()  # noqa: B023, E731
                got.append((f"{part('groupId')}:{part('artifactId')}", part("version"), part("scope") == "test"))
    except (ValueError, AttributeError, ElementTree.ParseError):
        return []
    return [{"ecosystem": kind, "name": n, "requirement": r, "dev": d} for n, r, d in got]


@F.pandas_udf(DEPENDENCIES)
def dependencies_of(paths: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([dependencies(p, t) if t else [] for p, t in zip(paths, texts, strict=True)])


def manifests(files: DataFrame) -> DataFrame:
    """path and each declared dependency."""
    known = F.regexp_extract("path", r"([^/]+)$", 1).isin("Cargo.toml", "package.json", "requirements.txt", "pyproject.toml", "go.mod", "pom.xml")
    return files.where(known).select("path", F.explode(dependencies_of("path", "text")).alias("d")).select("path", "d.*")


def locked_versions(text: str) -> list[dict]:
    """name, version of the packages in a Cargo.lock, uv.lock, poetry.lock or package-lock.json."""
    if text.lstrip().startswith("{"):
        packages = json.loads(text).get("packages", {})
        return [{"name": k.split("node_modules/")[-1], "version": v.get("version", "")} for k, v in packages.items() if k]
    return [{"name": p["name"], "version": p.get("version", "")} for p in tomllib.loads(text).get("package", [])]


def resolved(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """Declared dependencies with the version that a lock file pins (name, version); null where there is none."""
    return declared.join(locked.groupBy("name").agg(F.max("version").alias("version")), "name", "left")
