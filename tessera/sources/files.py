"""Source files: classification, secrets, ignore rules, digests and snippets."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Table:
    version: int
    code: frozenset[str]
    semantic: frozenset[str]
    code_names: frozenset[str] = frozenset()
    ignored_names: frozenset[str] = frozenset()


# Which files count as code and which as text, by version.
CODE_1 = frozenset({
    ".py", ".php", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".rb", ".c", ".h", ".cpp", ".hpp",
    ".cs", ".kt", ".swift", ".vue",
})
TEXT_1 = frozenset({
    ".md", ".mdx", ".rst", ".txt", ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".conf", ".env.example",
})
CODE_2 = frozenset({
    ".asd", ".astro", ".bash", ".c", ".cbl", ".cc", ".cjs", ".cl", ".cls", ".cob", ".cobol", ".cpp", ".cpy", ".cs",
    ".cshtml", ".csproj", ".cts", ".cu", ".cuh", ".cxx", ".dart", ".dfm", ".dm", ".dme", ".dmf", ".dmi", ".dmm", ".dpk",
    ".dpr", ".ejs", ".erl", ".escript", ".ets", ".ex", ".exs", ".f", ".f03", ".f08", ".f90", ".f95", ".fsproj", ".go",
    ".gradle", ".groovy", ".h", ".hcl", ".hpp", ".hrl", ".inc", ".java", ".jl", ".js", ".json", ".jsx", ".kt", ".kts",
    ".lfm", ".lisp", ".lpk", ".lpr", ".lsp", ".lua", ".luau", ".m", ".metal", ".mjs", ".ml", ".mli", ".mm", ".mts",
    ".pas", ".php", ".pp", ".ps1", ".psd1", ".psm1", ".py", ".r", ".rake", ".razor", ".rb", ".resource", ".robot", ".rs",
    ".scala", ".sh", ".sln", ".slnx", ".sol", ".sql", ".sv", ".svelte", ".svh", ".swift", ".tf", ".tfvars", ".toc", ".trigger",
    ".ts", ".tsx", ".v", ".vb", ".vbproj", ".vh", ".vue", ".xaml", ".yaml", ".yml", ".zig",
})
TEXT_2 = frozenset({
    ".md", ".mdx", ".rst", ".txt",
})
NAMES = frozenset({
    "apm.yml", "apm.yaml", "pyproject.toml", "cargo.toml", "go.mod", "pom.xml",
})
LOCKS = frozenset({
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum",
})
PRUNED = [
    ".git", "node_modules", "vendor", "docs", "doc", "__pycache__", ".venv", "venv", "dist", "build", ".idea", ".vscode",
    "target", "site-packages", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".eggs", "__snapshots__", ".next", ".nuxt", ".turbo",
    ".cache",
]

TABLES = {1: Table(1, CODE_1, TEXT_1), 2: Table(2, CODE_2, TEXT_2, NAMES, LOCKS), 3: Table(3, CODE_2, TEXT_2, NAMES, LOCKS)}

# What likely holds secrets.
STORES, AMBIGUOUS = [".ssh", ".gnupg", ".aws", ".gcloud"], ["secrets", ".secrets", "credentials"]
SECRET_NAMES = [
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)",
    r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(?i)(^|[^A-Za-z0-9])(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)^secring(\.(gpg|pgp))?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd|\.npmrc|\.pypirc|\.git-credentials|\.boto)$",
]
ENV_TEMPLATE = r"(?i)^\.(env|envrc)\..*(example|sample|template|dist)$"
KEYWORDS = [r"(?i)(?<![a-zA-Z0-9])(credential|secret|passwd|password|private_key)s?(?![a-zA-Z])", r"(?i)(?<![a-zA-Z0-9])tokens?(?![a-zA-Z])", r"(?i)(?<![a-zA-Z0-9])service[._-]?account(?![a-zA-Z])"]
PROSE = ".md .markdown .rst .org .adoc .tex".split()
DATA = ".json .yaml .yml .toml .ini .cfg .conf .config .xml .properties .env .txt .tfvars".split()


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-case last extension of a path's name; a leading dot is no extension."""
    return F.lower(F.regexp_extract(_name(path), r"[^.](\.[^.]+)$", 1))


def category(path: Column, version: int = 3) -> Column:
    """code, semantic or ignore: file names before extensions."""
    t = TABLES[version]
    name, ext = _name(path), suffix(path)
    return F.when(name.isin(*t.ignored_names) if t.ignored_names else F.lit(False), "ignore").when(F.lower(name).isin(*t.code_names) if t.code_names else F.lit(False), "code").when(ext.isin(*t.code), "code").when(ext.isin(*t.semantic), "semantic").otherwise("ignore")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_name(path), r"(?<=[^.])\.[^.]+$", ""), r"^\.+", "")


def is_sensitive(path: Column) -> Column:
    """Whether an absolute path likely holds a secret: by its folders, its name, or a keyword in it."""
    parents = F.transform(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), F.lower)
    name, ext, stem = _name(path), suffix(path), _stem(path)
    source = (ext.isin(*TABLES[3].code) | F.lower(name).isin(*TABLES[3].code_names)) & ~ext.isin(*DATA)
    full = lambda p: stem.rlike("(?i)^(?:" + p.removeprefix("(?i)") + ")$")
    prose = ext.isin(*PROSE) & (stem.rlike("(?i)^tokens$") | ~(full(KEYWORDS[0]) | full(KEYWORDS[1]) | full(KEYWORDS[2])))
    n_words = F.size(F.filter(F.split(stem, r"[-_\s.]+"), lambda w: w != ""))
    hit = F.lit(False)
    for p in KEYWORDS:
        hit = hit | stem.rlike(p + "$") | (stem.rlike(p) & (n_words <= 2))
    named = F.lit(False)
    for p in SECRET_NAMES:
        named = named | name.rlike(p)
    store = F.arrays_overlap(parents, F.array(*map(F.lit, STORES)))
    maybe = F.arrays_overlap(parents, F.array(*map(F.lit, AMBIGUOUS))) & ~source
    return store | maybe | (named & ~name.rlike(ENV_TEMPLATE)) | (hit & ~(source | prose))


class IgnoreRules:
    """Ignore patterns of one repo, as git has them: later lines win, '!' takes back, a trailing '/' means folders, a slash inside anchors. Tracked paths stay."""

    def __init__(self, lines: list[str], tracked: frozenset[str] = frozenset()):
        self.tracked = tracked
        self.rules = []
        for x in lines:
            x = x.rstrip("\n").rstrip()
            if not x or x.startswith("#"):
                continue
            back = x.startswith("!")
            x = x[1:] if back else x
            folder = x.endswith("/")
            x = x.rstrip("/")
            anchored = "/" in x
            self.rules.append((re.compile(self._regex(x.lstrip("/"), anchored)), back, folder))

    @staticmethod
    def _regex(p: str, anchored: bool) -> str:
        out = []
        for part in p.split("/"):
            out.append(".*" if part == "**" else fnmatch.translate(part).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z").replace(".*", "[^/]*"))
        body = "/".join(out).replace(".*/", "(?:.*/)?")
        return ("^" if anchored else "(?:^|.*/)") + body + "$"

    def ignores(self, path: str) -> bool:
        if path in self.tracked:
            return False
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            sub, last = "/".join(parts[:i]), i == len(parts)
            state = False
            for r, back, folder in self.rules:
                if (not folder or not last) and r.match(sub):
                    state = not back
            if state:
                return True
        return False


def _placed(line: str, folder: str) -> str:
    """A rule of a folder's file as one of the repo's."""
    if not folder or not line.strip() or line.startswith("#"):
        return line
    back, body = ("!", line[1:]) if line.startswith("!") else ("", line)
    inner = body.lstrip("/") if "/" in body.rstrip("/") else f"**/{body}"
    return f"{back}{folder}/{inner}"


def ignore_rules(files: DataFrame, names: tuple[str, ...] = (".gitignore",), most: int = 1 << 20, tracked: dict[str, frozenset[str]] | None = None) -> dict[str, IgnoreRules]:
    """The rules of each repo from its rule files, folders nearest the root first; files over most bytes do not count. Rule files alone come to the driver."""
    found = files.where(_name(F.col("path")).isin(*names) & (F.octet_length("content") <= most)).select("repo", "path", "content").collect()
    lines: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["repo"], r["path"].count("/"), r["path"])):
        folder = r["path"].rpartition("/")[0]
        lines.setdefault(r["repo"], []).extend(_placed(x, folder) for x in bytes(r["content"]).decode("utf-8", "replace").splitlines())
    return {repo: IgnoreRules(x, (tracked or {}).get(repo, frozenset())) for repo, x in lines.items()}


def not_ignored(files: DataFrame, rules: dict[str, IgnoreRules]) -> DataFrame:
    """files (repo, path, ...) that no rule of their repo ignores."""
    if not rules:
        return files

    @F.pandas_udf("boolean")
    def ignored(repo, path):
        return pd.Series([r in rules and rules[r].ignores(p) for r, p in zip(repo, path, strict=True)])

    return files.where(~ignored("repo", "path"))


def digests(files: DataFrame, version: int = 3, rules: dict[str, IgnoreRules] | None = None) -> DataFrame:
    """(repo, code_hash, semantic_hash, file_count, has_sql) of files (repo, path, content).

    A hash covers path, size and content of each file of its category, in path order; pruned folders, likely secrets
    and what the repo's rules ignore do not count.
    """
    files = not_ignored(files, rules or {})
    parts = F.split("path", "/")
    f = files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), F.array(*map(F.lit, PRUNED))))
    f = f.where(~is_sensitive(F.concat(F.lit("/"), "path"))) if version >= 3 else f
    c = category(F.col("path"), version)
    entry = F.concat_ws(":", "path", F.octet_length("content").cast("string"), F.substring(F.sha2("content", 256), 1, 32))
    rows = f.select("repo", c.alias("c"), entry.alias("e"), suffix(F.col("path")).alias("x")).where("c <> 'ignore'")
    digest = lambda k: F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == k, F.col("e")))), lambda x: F.concat(x, F.lit("\n"))), ""), 256), 1, 16)
    return rows.groupBy("repo").agg(digest("code").alias("code_hash"), digest("semantic").alias("semantic_hash"), F.count("*").alias("file_count"), F.max((F.col("c") == "code") & (F.col("x") == ".sql")).alias("has_sql"))


def read(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, content, modified) of all files below a root."""
    base = root.rstrip("/")
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    return b.select(F.lit(repo).alias("repo"), rel.alias("path"), "content", F.unix_timestamp("modificationTime").cast("double").alias("modified"))


def snippet(text: str, line: int | None, window: int = 20, before: int = 10, chars: int = 800, most_lines: int = 4000, most_chars: int = 4096) -> str:
    """Twenty lines from ten above the line on, or the head of the file, 800 characters at most."""
    lines = [x[:most_chars] for x in text.split("\n")[:most_lines]]
    start = max(0, line - 1 - before) if line else 0
    return "\n".join(lines[start : start + window])[:chars]


def snippets(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, source_file, line, snippet, modified) for each place that nodes (repo, source_file, line) name; a file is read once for all its places. Paths that leave the repo have none."""
    places = nodes.where("source_file <> '' and not startswith(source_file, '/') and not source_file rlike '(^|/)[.][.](/|$)'").groupBy("repo", "source_file").agg(F.collect_set(F.coalesce("line", F.lit(0))).alias("lines"))
    j = places.join(files.select(F.col("repo"), F.col("path").alias("source_file"), "content", "modified"), ["repo", "source_file"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, file, lines, content, modified in zip(b["repo"], b["source_file"], b["lines"], b["content"], b["modified"], strict=True):
                text = bytes(content).decode("utf-8", "replace")
                rows += [(repo, file, int(n) or None, snippet(text, int(n)), modified) for n in lines]
            yield pd.DataFrame(rows, columns=["repo", "source_file", "line", "snippet", "modified"])

    return j.mapInPandas(run, "repo string, source_file string, line int, snippet string, modified double")


def relative(root: str, path: str) -> str:
    return str(PurePosixPath(path).relative_to(root))
