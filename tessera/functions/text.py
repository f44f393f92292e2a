"""Column functions over names, paths and labels. All built-in, but for folding texts beyond ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Directories and file names that hold tests, stories, fixtures, mocks.
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs", "testing", "datafixtures", "fixtures", "__mocks__", "mocks", "cypress", "e2e", "playwright", "__snapshots__", ".storybook"]
TEST_FILE = r"(^test_.*\.py$|_test\.(py|go)$|Test\.php$|Tests?\.(cs|java|kt)$|\.(test|spec)\.[cm]?[jt]sx?$|\.stories\.[^.]+$)"
CAMEL = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def fold_text(s: str) -> str:
    """Without diacritics, case kept: canonical and compatible decomposition less combining marks."""
    if s.isascii():
        return s
    return re.sub(r"[^\x00-\x7f]+", lambda m: "".join(c for c in m.group() if not unicodedata.combining(c)), unicodedata.normalize("NFKD", s))


class _Folded(dict):
    """What each character beyond ASCII folds to, found when first met: marks go wherever they stand, so characters fold one by one."""

    def __missing__(self, c: int) -> str:
        self[c] = c if c < 0x80 else fold_text(chr(c))
        return self[c]


_FOLDED = _Folded()
_RUN, _CAMEL = re.compile("[A-Za-z0-9_]+"), re.compile(CAMEL)


def text_terms(s: str | None) -> set[str]:
    """term_set in plain Python: only a text's distinct runs are looked at closely."""
    s = s or ""
    runs = set(_RUN.findall(s if s.isascii() else s.translate(_FOLDED)))
    out = {r.lower() for r in runs}
    for run in runs:
        if "_" in run or not (run.islower() or run.isdigit()):
            for part in filter(None, run.split("_")):
                out.add(part.lower())
                if not part[1:].islower():
                    out.update(p.lower() for p in _CAMEL.split(part) if p)
    return out


def _plain_letters() -> dict[str, str]:
    """Letters of the Latin blocks that fold to one ASCII letter, by the decomposition itself."""
    found = {chr(c): fold_text(chr(c)) for c in range(0xC0, 0x250)}
    return {c: f for c, f in found.items() if f != c and len(f) == 1 and f.isascii()}


PLAIN = _plain_letters()
#: Characters that folding leaves as they are, or that PLAIN has: texts of these alone stay on the JVM.
_SIMPLE = "".join(c for c in map(chr, range(0x80, 0x250)) if c in PLAIN or fold_text(c) == c)


@pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_text(x))


def fold(c: Column) -> Column:
    """Latin texts are translated on the JVM; only others go through an Arrow batch."""
    simple = c.rlike("^[\\x00-\\x7F" + _SIMPLE.replace("\\", "").replace("]", "").replace("[", "").replace("^", "").replace("-", "") + "]*+$")
    return F.when(simple, F.translate(c, "".join(PLAIN), "".join(PLAIN.values()))).otherwise(_fold(F.when(~simple, c)))


def term_set(c: Column) -> Column:
    """The distinct search terms of a text, in no order: each run of letters, digits and underscores, its parts between underscores, and their camel-case parts. A text is cut three times as a whole, never word by word."""
    text = fold(F.coalesce(c, F.lit("")))
    low = F.lower(text)
    runs = F.split(low, "[^a-z0-9_]++")
    parts = F.when(low.contains("_"), F.split(low, "[^a-z0-9]++")).otherwise(F.array().cast("array<string>"))  # else the runs are the parts
    camel = F.transform(F.array_distinct(F.split(text, "[^A-Za-z0-9]++|" + CAMEL)), F.lower)
    return F.array_remove(F.array_distinct(F.concat(runs, parts, camel)), "")


def terms(c: Column) -> Column:
    """term_set, sorted."""
    return F.sort_array(term_set(c))


def alias_forms(label: Column, file: Column, basename: Column) -> Column:
    """Names a node is found by exactly: its label, that without leading separators, class and method of Class::method, the last part of a namespace, and its file's name where basename holds."""
    label, file = F.coalesce(label, F.lit("")), F.coalesce(file, F.lit(""))
    low = lambda c: F.lower(fold(c))
    norm = low(label)
    at = F.instr(label, "::")
    cls = F.when(at > 0, F.substring(label, F.lit(1), at - 1))
    method = F.when(at > 0, F.substring(label, at + 2, F.length(label)))
    last = F.when(F.instr(label, "\\") > 0, F.element_at(F.split(label, "\\\\"), -1))
    base = F.when(basename & (file != ""), F.element_at(F.split(F.regexp_replace(file, "/+$", ""), "/"), -1))
    forms = F.array(norm, F.regexp_replace(F.regexp_replace(norm, r"^\\+", ""), "^/+", ""), low(cls), low(method), low(last), low(base))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def is_test_path(path: Column) -> Column:
    parts = F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/")
    dirs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lower)
    return F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS))) | F.element_at(parts, -1).rlike(TEST_FILE)


def is_deprecated(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).contains("/DEPRECATED/")


def node_line(line: Column, location: Column) -> Column:
    """A positive line, else the number of an L<n> location, else null."""
    n = F.regexp_extract(F.coalesce(location, F.lit("")), r"^L(\d+)$", 1).try_cast("int")
    return F.when(line > 0, line).when(n > 0, n)


def citation(repo: Column, file: Column, line: Column) -> Column:
    return F.format_string("[%s:%s:%s]", F.coalesce(repo, F.lit("")), F.coalesce(file, F.lit("")), F.coalesce(line.cast("string"), F.lit("?")))


def path_template(path: Column) -> Column:
    """A route's path in one form: no query, a leading slash, no trailing one, every placeholder {param}."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\?.*$", ""), "^/+|/+$", "")
    return F.regexp_replace(F.concat(F.lit("/"), bare), r"\{[^}]*\}", "{param}")


def extension(file: Column) -> Column:
    """The lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(file, F.lit("")), r"(\.[^./]*)$", 1))


def repo_prefix(node_id: Column) -> Column:
    """What stands before the first '::', or null."""
    return F.when(F.instr(node_id, "::") > 0, F.split_part(node_id, F.lit("::"), F.lit(1)))


def norm_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"^\s+|\s+$", ""))


def is_config_file(file: Column) -> Column:
    return F.lower(F.coalesce(file, F.lit(""))).rlike(r"\.(yaml|yml|json)$")


def is_file_label(label: Column, file: Column) -> Column:
    """The label is the file's path or a suffix of it at a slash."""
    label, file = F.coalesce(label, F.lit("")), F.coalesce(file, F.lit(""))
    return (label != "") & ((file == label) | file.endswith(F.concat(F.lit("/"), label)))


def is_trivial(label: Column, snippet: Column) -> Column:
    """An accessor of at most two lines that are not blank."""
    lines = F.filter(F.split(F.coalesce(snippet, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(label, F.lit("")).rlike(r"^(get|set|is|has)[A-Z_]\w*$") & (F.size(lines) <= 2)


def embedding_text(label: Column, file: Column, snippet: Column) -> Column:
    return F.substring(F.concat(F.lit("label: "), F.coalesce(label, F.lit("")), F.lit("\npath: "), F.coalesce(file, F.lit("")), F.lit("\nsnippet:\n"), F.coalesce(snippet, F.lit(""))), 1, 3000)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
