"""Facts in source files: packages and locks, routes that are declared and called, manual relations, changed documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import path_template

# How routes are declared and called. A method is a single-quoted word; a call has one only by ->request.
ROUTE = r"#\[Route\((?P<route>.*?)\)\]"
CLASS = r"\bclass\s+(?P<class>\w+)"
FUNCTION = r"\bfunction\s+(?P<function>\w+)\s*\("
PATH = re.compile(r"""^\s*['"](/[^'"]*)['"]""", re.MULTILINE)
METHODS = re.compile(r"methods\s*:\s*\[([^\]]*)\]")
METHOD = re.compile(r"'([A-Za-z]+)'")
REQUEST = re.compile(r"""->request\(\s*['"]([A-Za-z]+)['"]\s*,\s*['"](/[^'"]*)['"]""", re.IGNORECASE)
SHORT_CALLS = [re.compile(p, re.IGNORECASE) for p in (r"""->(?:get|post|put|patch|delete)\(\s*['"](/[^'"]*)['"]""", r"""(?:axios|fetch)\s*\(\s*['"](/[^'"]*)['"]""")]
SUFFIXES = [".php", ".ts", ".tsx", ".js", ".jsx"]
NO_CLASS, NO_FUNCTION = "UnknownClass", "unknownMethod"

_MARKS = re.compile(f"{ROUTE}|{CLASS}|{FUNCTION}", re.DOTALL)


def declared(text: str) -> list[tuple[str, str, str, int]]:
    """(method, path, Class::function, position) of each route attribute, for each of its methods.

    A file is read once as a row of marks: a class mark opens an owner, a route mark waits, and a function mark takes
    all that wait. Routes after the last function, and before the first class, have placeholders.
    """
    owner, out = NO_CLASS, []
    waiting: list[tuple[str, str, int, str]] = []

    def settle(function: str) -> None:
        out.extend((method, path, f"{cls}::{function}", at) for method, path, at, cls in waiting)
        waiting.clear()

    for mark in _MARKS.finditer(text):
        kind, value = mark.lastgroup, mark.group(mark.lastgroup)
        if kind == "class":
            owner = value
        elif kind == "function":
            settle(value)
        elif path := PATH.search(value):
            listed = METHODS.search(value)
            waiting += [(m.upper(), path.group(1), mark.start(), owner) for m in (METHOD.findall(listed.group(1)) if listed else []) or ["GET"]]
    settle(NO_FUNCTION)
    return out


def called(text: str) -> list[tuple[str, str]]:
    """(method, path) of each call, in the order of the text; calls that name no method count as GET."""
    found = [(m.start(), m.group(1).upper(), m.group(2)) for m in REQUEST.finditer(text)]
    found += [(m.start(), "GET", m.group(1)) for p in SHORT_CALLS for m in p.finditer(text)]
    return [(method, path) for _, method, path in sorted(found)]


def api(files: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Providers and consumers in files (repo, path, content); repos: repo, repo_ord."""
    f = files.where(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(SUFFIXES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, content in zip(b["repo"], b["path"], b["content"], strict=True):
                text = bytes(content).decode("utf-8", "replace")
                if path.endswith(".php"):
                    rows += [(repo, path, "provider", m, p, name, pos) for m, p, name, pos in declared(text)]
                rows += [(repo, path, "consumer", m, p, None, 0) for m, p in called(text)]
            yield pd.DataFrame(rows, columns=["repo", "file", "role", "method", "path", "label", "pos"])

    rows = f.select("repo", "path", "content").mapInPandas(run, "repo string, file string, role string, method string, path string, label string, pos long").withColumn("template", path_template(F.col("path")))
    order = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.regexp_extract("file", r"(\.[^./]+)$", 1)).cast("int")
    p = rows.where("role = 'provider'").join(repos, "repo").select("method", "template", "repo", "file", "label", "repo_ord", order.alias("suffix_ord"), "pos")
    return p, rows.where("role = 'consumer'").select("method", "template", "repo", "file")


def _lock_names(name: str, text: str) -> list[str]:
    if name == "pnpm-lock.yaml":  # presence alone: keys of packages, and names under dependencies
        found = re.findall(r"^ {2}'?/?((?:@[^/'\s]+/)?[^@'\s:]+)@[^:]*'?:\s*$", text, re.MULTILINE)
        return found + re.findall(r"^ {4,6}'?((?:@[^/'\s]+/)?[\w.-]+)'?:\s*$", text, re.MULTILINE)
    d = json.loads(text)
    if name == "composer.lock":
        return [p["name"] for k in ("packages", "packages-dev") for p in d.get(k) or [] if isinstance(p, dict) and "name" in p]
    out = [k.rsplit("node_modules/", 1)[1] for k in d.get("packages") or {} if "node_modules/" in k]
    return out + list(d.get("dependencies") or {})


def packages(files: DataFrame) -> dict[str, DataFrame]:
    """packages (repo, ecosystem, name), dependencies (… dev) and locked (repo, ecosystem, name) of the manifests and locks at the roots of repos; files: repo, path, content. What cannot be parsed is left out."""
    names = ["composer.json", "package.json", "composer.lock", "package-lock.json", "pnpm-lock.yaml"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, content in zip(b["repo"], b["path"], b["content"], strict=True):
                eco = "composer" if path.startswith("composer") else "npm"
                try:
                    text = bytes(content).decode("utf-8")
                    if "lock" in path:
                        rows += [(repo, "locked", eco, n, False) for n in _lock_names(path, text)]
                        continue
                    d = json.loads(text)
                    if isinstance(d.get("name"), str) and d["name"]:
                        rows.append((repo, "package", eco, d["name"], False))
                    for key, dev in (("require", False), ("require-dev", True)) if eco == "composer" else (("dependencies", False), ("devDependencies", True)):
                        rows += [(repo, "dependency", eco, n, dev) for n in d.get(key) or {}]
                except (ValueError, AttributeError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["repo", "what", "ecosystem", "name", "dev"])

    r = files.where(F.col("path").isin(names)).select("repo", "path", "content").mapInPandas(run, "repo string, what string, ecosystem string, name string, dev boolean")
    pick = lambda w, *c: r.where(F.col("what") == w).select("repo", "ecosystem", "name", *c).distinct()
    return {"packages": pick("package"), "dependencies": pick("dependency", "dev"), "locked": pick("locked")}


def manual(spark: SparkSession, data: object) -> DataFrame:
    """Declared relations (type, source, target, confidence, evidence) from JSON; an error names the place, never the content."""
    rows = data.get("relations") if isinstance(data, dict) else None
    if not isinstance(rows, list):
        raise ValueError("/relations: a list is needed")
    out = []
    for i, r in enumerate(rows):
        for side in ("source", "target"):
            for k in ("repo", "source_file", "qualified_label"):
                if not isinstance(r, dict) or not isinstance(r.get(side), dict) or not isinstance(r[side].get(k), str) or not r[side][k]:
                    raise ValueError(f"/relations/{i}/{side}/{k}: a text is needed")
        c = r.get("confidence")
        if c is not None and (isinstance(c, bool) or not isinstance(c, (int, float)) or not 0 <= c <= 1):
            raise ValueError(f"/relations/{i}/confidence: a number from 0 to 1 is needed")
        if r.get("type", "depends_on") not in ("depends_on", "similar_approach", "provides_api", "consumes_api"):
            raise ValueError(f"/relations/{i}/type: not a relation")
        ref = lambda x: (x["repo"], x["source_file"], x["qualified_label"])
        out.append((r.get("type", "depends_on"), ref(r["source"]), ref(r["target"]), None if c is None else float(c), r.get("evidence") or ""))
    s = "struct<repo:string,source_file:string,qualified_label:string>"
    return spark.createDataFrame(out, f"type string, source {s}, target {s}, confidence double, evidence string")


def stale_files(manifests: DataFrame) -> DataFrame:
    """(repo, source_file) that changed since their text was last read; manifests: repo, value (JSON by file)."""
    m = F.from_json("value", "map<string,struct<ast_hash:string,semantic_hash:string>>")
    return manifests.select("repo", F.explode(m).alias("source_file", "x")).where("coalesce(x.ast_hash, '') <> '' and x.semantic_hash = ''").select("repo", "source_file")


def missing_lines(documents: DataFrame, stamped: DataFrame) -> DataFrame:
    """Documents (repo, path) that the extractor left without a stamp."""
    return documents.join(stamped, ["repo", "path"], "left_anti")
