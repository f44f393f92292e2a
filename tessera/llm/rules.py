"""Quality rules under weak supervision. Native: DataFrame functions alone touch the rows.

Each rule votes good (1), bad (-1) or abstains (0). Votes are counted by pattern (3 to the power of the rules at
most, whatever the input), expectation-maximisation over those counts estimates how often each rule votes good in
good and in bad documents and the share of good ones, and each document gets the posterior probability of good.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, fresh, parted, temporary, text_key, words, written

SYMBOLS = "#*$%&|<>"
#: What ends a sentence or clause in a line: also closing quotes and brackets, and the marks of other scripts.
LINE_END = "[.!?;:…\"'”’»)\\]。！？；：．｡」』）।؟۔]$"
#: Lines that can be looked at for their end: five words or more, so lists, tables and scripts without blanks are left out.
LONG_LINE = r"^\s*+(?:\S++\s++){4}\S"
LETTERS_UPPER = "[A-ZÀ-ÖØ-Þ]"
#: A word with a symbol in it: found at the word's start alone, so that long words are read once.
SYMBOL_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>]"
LETTERS = r"[\p{L}\p{M}]++"


def _count(text: Column, chars: str) -> Column:
    bare = text
    for c in chars:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return (F.char_length(text) - F.char_length(bare)).cast("long")


def measured(docs: DataFrame, into: str, text_col: str = "text") -> DataFrame:
    """docs with a struct column of that name: what the rules look at. Null text counts as empty: all zero."""
    t, w, a, h, s, p = (fresh(f"{into}_{x}", docs.columns) for x in "twahsp")
    df = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit(""))).withColumn(w, words(F.col(t)))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    df = df.withColumn(a, lines)
    # a hash for each three-word window; equal windows have equal hashes
    df = df.withColumn(h, F.when(F.size(w) >= 3, F.expr(f"transform(slice(`{w}`, 1, size(`{w}`) - 2), (x, i) -> xxhash64(x, `{w}`[i + 1], `{w}`[i + 2]))")).otherwise(F.array().cast("array<bigint>")))
    # only texts that have a window twice are sorted
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.expr(f"transform(`{h}`, (x, i) -> named_struct('h', x, 'p', i))"))))
    df = df.withColumn(p, F.when(F.col(s).isNotNull(), F.sort_array(F.expr(f"transform(filter(`{s}`, (x, i) -> coalesce(x.h = get(`{s}`, i - 1).h, false) or coalesce(x.h = get(`{s}`, i + 1).h, false)), x -> x.p)"))))
    covered = F.expr(f"aggregate(transform(`{p}`, (x, i) -> least(3, coalesce(get(`{p}`, i + 1) - x, 3))), 0L, (c, x) -> c + x)")
    sentences = F.filter(F.col(a), lambda x: x.rlike(LONG_LINE))
    ended = F.filter(sentences, lambda x: F.rtrim(x).rlike(LINE_END))
    out = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.coalesce(F.char_length(F.array_join(w, "")), F.lit(0)).cast("long").alias("word_chars"),
        _count(F.col(t), SYMBOLS).alias("n_symbols"),
        (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(a).cast("long").alias("n_lines"),
        F.size(sentences).cast("long").alias("n_long_lines"),
        F.size(ended).cast("long").alias("n_ended"),
        _count(F.col(t), "!").alias("n_shouts"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, LETTERS_UPPER, ""))).cast("long").alias("n_upper"),
        F.regexp_count(F.col(t), F.lit(SYMBOL_WORD)).cast("long").alias("n_symbol_words"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, LETTERS, ""))).cast("long").alias("n_letters"),
    )
    return df.withColumn(into, out).drop(t, w, a, h, s, p)


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def votes(m: str) -> list[Column]:
    """The rules' votes, in order. A rule without its denominator abstains."""

    def share(x: str, of: str) -> Column:
        return F.try_divide(F.col(f"{m}.{x}").cast("double"), F.col(f"{m}.{of}").cast("double"))

    def rule(x: Column, good: Column, bad: Column) -> Column:
        return F.when(x.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")

    n, mean, sym, dup = F.col(f"{m}.n_words"), share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines")
    rep, shout, upper, end = share("n_repeat_words", "n_words"), share("n_shouts", "n_words"), share("n_upper", "word_chars"), share("n_ended", "n_long_lines")
    marked, letters = share("n_symbol_words", "n_words"), share("n_letters", "word_chars")
    return [
        rule(n, n >= 100, n < 10),
        rule(mean, mean.between(3.0, 10.0), (mean < 2.0) | (mean > 14.0)),
        rule(sym, sym < 0.03, sym > 0.1),
        rule(dup, dup < 0.1, dup > 0.3),
        rule(rep, rep < 0.2, rep > 0.5),
        rule(shout, shout < 0.05, shout > 0.15),
        rule(upper, upper < 0.15, upper > 0.3),
        rule(end, end > 0.5, end < 0.1),
        rule(marked, marked < 0.05, marked > 0.2),
        rule(letters, letters > 0.92, letters < 0.88),
    ]


class Model:
    """Two latent classes, good (0) and bad (1). share: how many documents each has; chance[c][j]: how often rule j, if it votes, votes good in class c."""

    def __init__(self, share: list[float], chance: list[list[float]]):
        self.share, self.chance = share, chance

    def accuracies(self) -> list[tuple[float, float]]:
        """For each rule how often its vote is good in good documents, and bad in bad ones."""
        return [(good, 1 - bad) for good, bad in zip(*self.chance, strict=True)]

    def weights(self) -> list[tuple[float, list[tuple[float, float]]]]:
        """For each class the log of its share, and for each rule that of a good and of a bad vote."""
        return [(math.log(s), [(math.log(x), math.log(1 - x)) for x in c]) for s, c in zip(self.share, self.chance, strict=True)]

    def posterior(self, pattern: Sequence[int]) -> float:
        """The probability that a document with these votes is good."""
        good, bad = (s + sum(w[0] if v > 0 else w[1] if v < 0 else 0.0 for v, w in zip(pattern, each, strict=True)) for s, each in self.weights())
        return 1 / (1 + math.exp(min(700.0, bad - good)))


#: Where expectation-maximisation begins: how good a document without a bad vote is, and one with any.
BEGIN = (0.9, 0.1)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> Model:
    """Expectation-maximisation over counted vote patterns, as Dawid and Skene have it. No patterns: an even model.

    It begins from BEGIN, which only says which class is the good one. All else comes from the votes: a rule whose bad
    votes others share is taken for accurate, one that alone objects is outvoted. One pseudo-count on each side keeps
    every chance inside (0, 1). Patterns are taken in sorted order, so reruns agree.
    """
    patterns = sorted(patterns)
    k = len(patterns[0][0]) if patterns else 0
    n = sum(c for _, c in patterns)
    post = [BEGIN[min(p, default=0) < 0] for p, _ in patterns]
    model = Model([0.5, 0.5], [[0.5] * k, [0.5] * k])
    for _ in range(rounds if n else 0):
        share, chance = [], []
        for c in (0, 1):
            weight = [(1 - q if c else q) * m for q, (_, m) in zip(post, patterns, strict=True)]
            share.append((sum(weight) + 1) / (n + 2))
            yes = [sum(w for w, (p, _) in zip(weight, patterns, strict=True) if p[j] > 0) for j in range(k)]
            no = [sum(w for w, (p, _) in zip(weight, patterns, strict=True) if p[j] < 0) for j in range(k)]
            chance.append([(y + 1) / (y + x + 2) for y, x in zip(yes, no, strict=True)])
        model = Model(share, chance)
        now = [model.posterior(p) for p, _ in patterns]
        if max(abs(a - b) for a, b in zip(now, post, strict=True)) < 1e-9:
            break
        post = now
    return model


def learn(votes_df: DataFrame, names: list[str]) -> Model:
    """The model of all rows of votes_df; only counts by pattern, at most 3 ** len(names) rows, come to the driver."""
    found = [(tuple(r[n] for n in names), r["_n"]) for r in votes_df.groupBy(*names).agg(F.count("*").alias("_n")).collect()]
    return fit(found) if found else Model([0.5, 0.5], [[0.5] * len(names)] * 2)


def quality(model: Model, columns: list[Column]) -> Column:
    """The posterior probability of good, from columns of votes."""
    logs = []
    for share, each in model.weights():
        x = F.lit(float(share))
        for c, (up, down) in zip(columns, each, strict=True):
            x = x + F.when(c > 0, F.lit(float(up))).when(c < 0, F.lit(float(down))).otherwise(F.lit(0.0))
        logs.append(x)
    return 1 / (1 + F.exp(F.least(logs[1] - logs[0], F.lit(700.0))))


def judged(docs: DataFrame, threshold: float = 0.5, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs (those columns, or all) with a struct: the measures, base_failed, quality and kept; and that struct's name.

    Documents are measured in one pass, written, counted and then judged: kept are those that pass the base rule and are
    good with that probability at least, whatever single rules say. Null and empty texts fail the base rule.
    Repeated rows are judged each, and alike. An empty table gives an empty result.
    """
    m = fresh("_rules", docs.columns)
    held = written(measured(docs, m).select(*(docs.columns if columns is None else columns), m), "measured")
    cast = [v.alias(f"v{i}") for i, v in enumerate(votes(m))]
    model = learn(held.select(*cast), [f"v{i}" for i in range(len(cast))])
    q = quality(model, votes(m))
    failed = base_failed(m)
    return held.withColumn(m, F.struct(f"{m}.*", failed.alias("base_failed"), q.alias("quality"), (~failed & (q >= threshold)).alias("kept"))), m


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, with all their columns, without the rows that the rules reject.

    Texts are not written with their measures: a verdict follows from the text alone, so what stays on disk are hashes
    of the rejected ones; texts that have none of those hashes for certain are not shuffled.
    """
    with temporary(docs.sparkSession) as keep:
        df, m = judged(docs.select("text", *text_key("text")), threshold, ["t1", "t2"])
        gone = keep(df.where(~F.col(f"{m}.kept")).select(F.struct("t1", "t2").alias(fresh("_gone", docs.columns))).distinct(), "rejected")
    g = gone.columns[0]
    sure, rest = parted(docs, text_key(docs["text"])[0], gone.select(f"{g}.t1"))
    return sure.unionByName(rest.join(gone, [key == gone[f"{g}.{c}"] for c, key in zip(("t1", "t2"), text_key(rest["text"]), strict=True)], "left_anti"))
