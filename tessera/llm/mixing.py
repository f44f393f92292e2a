"""Mixing sources to target weights. Native: DataFrame functions alone touch the rows.

Rows get hash-random keys. Within a source they are dealt to ranges of keys; sums by range, prefix sums over the
ranges and one range's running sum give the exact place where the source's budget ends. What a document gives then
follows from its key alone, so neither texts nor a source's rows ever meet in one task: a source with a third of all
rows is spread over as many ranges as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import fresh, temporary, words, written

#: Rows of a source in one range of keys, about.
RANGE_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, ...) from (source, source_size): share of all sizes dealt by weight, most times its size at most.

    Weights repeat over the sources in code point order, null last. In order of most * size / weight a source is
    capped exactly if the level at which the rest would be filled lies above its cap; that level is the largest one.
    One row a source: the windows run over that small table.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cyc = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    df = sizes.withColumn("w", cyc).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    spent, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - spent) / (F.sum("w").over(every) - used)
    df = df.withColumn("level", level)
    return df.withColumn("target", F.least("cap", F.col("w") * F.max("level").over(every))).select("source", "source_size", "target")


def _ordering(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}") for c in ("k", "id", "h")])


def cuts(sized: DataFrame, seed: int, **kwargs) -> DataFrame:
    """A row for each source: target, whole epochs, and the key at which the last, partial epoch ends with what is taken there.

    sized: source, id, h (a hash of the text, for rows that share an id), size and k (the random key).
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_source = written(by_source, "sources")
    goal = targets(by_source.select("source", "source_size"), **kwargs)
    goal = goal.withColumn("budget", F.round("target").cast("long"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
    goal = written(goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s"), "goals")
    largest = by_source.agg(F.max("n")).first()[0] or 0
    bits = max(1, (largest // RANGE_ROWS).bit_length())
    ranged = sized.withColumn("r", F.expr(f"shiftrightunsigned(k, {63 - bits})"))
    sums = ranged.groupBy("source", "r").agg(F.sum("size").alias("sum"))
    running = F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = sums.withColumn("before", running).join(goal, F.col("source").eqNullSafe(F.col("s")))
    at = at.where("rest > before and rest <= before + sum").select("s", F.col("r").alias("cr"), "before", "rest")
    inside = ranged.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("r") == F.col("cr")))
    # rows alike in key, id and text share what is left evenly, so their order does not matter
    alike = inside.groupBy("s", "k", "id", "h", "size", "before", "rest").agg(F.count("*").alias("m"))
    upto = F.col("before") + F.coalesce(F.sum(F.col("m") * F.col("size")).over(W.partitionBy("s").orderBy("k", "id", "h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = alike.withColumn("upto", upto).where("rest > upto and rest <= upto + m * size")
    cut = cut.select(F.col("s").alias("cs"), _ordering().alias("cut"), F.expr("(rest - upto) div m").alias("part"))
    return written(goal.join(cut, F.col("s").eqNullSafe(F.col("cs")), "left").drop("cs"), "cuts")


def sized_rows(docs: DataFrame, seed: int, into: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    k = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1)  # not negative, so that ranges and keys order alike
    return docs.withColumn(into, F.struct(F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.size(words(F.col(text_col))).cast("long").alias("size"), k.alias("k")))


def _taken(rows: DataFrame, m: str, cut: DataFrame) -> tuple[DataFrame, Column]:
    joined = rows.join(cut, F.col(f"{m}.source").eqNullSafe(F.col("s")), "left")
    mine = F.struct(*[F.col(f"{m}.{c}") for c in ("k", "id", "h")])
    more = F.when(F.col("cut").isNull(), F.lit(0)).when(mine < F.col("cut"), F.col(f"{m}.size")).when(mine == F.col("cut"), F.col("part")).otherwise(F.lit(0))
    return joined, F.col("epochs") * F.col(f"{m}.size") + more


def mixed(docs: DataFrame, seed: int = 17, **kwargs) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs.

    taken: the words the mix takes of it, repeats counted: its size for each whole epoch, and in the last, partial
    epoch all of it, none, or, at the one place where the budget ends, a part. Null text: size 0, taken 0. Null
    source: a source of its own, last. Rows that repeat each count. An empty table gives an empty result.
    """
    m = "_mix"
    rows = written(sized_rows(docs.select("doc_id", "text", "source"), seed, m).select(f"{m}"), "sized")
    joined, taken = _taken(rows, m, cuts(rows.select(f"{m}.*"), seed, **kwargs))
    return joined.select(F.col(f"{m}.id").alias("doc_id"), F.col(f"{m}.source").alias("source"), F.col(f"{m}.size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 17, **kwargs) -> DataFrame:
    """The mix itself: docs' columns, a row for each time a document is taken, its text cut where only part is, n_chars made to fit.

    Sizes are measured twice rather than shuffling texts: what a document gives follows from its own key.
    """
    m = fresh("_mix", docs.columns)
    with temporary(docs.sparkSession) as keep:
        rows = written(sized_rows(docs.select("doc_id", "text", "source"), seed, "_m").select("_m.*"), "sized")
        cut = keep(cuts(rows, seed, **kwargs).select("s", "epochs", "cut", "part"), "mix")
    cut = cut.select(F.struct("*").alias(fresh("_cut", docs.columns)))
    c = cut.columns[0]
    df = sized_rows(docs, seed, m)
    df = df.join(cut, F.col(f"{m}.source").eqNullSafe(F.col(f"{c}.s")), "left")
    mine = F.struct(*[F.col(f"{m}.{x}") for x in ("k", "id", "h")])
    more = F.when(F.col(f"{c}.cut").isNull(), F.lit(0)).when(mine < F.col(f"{c}.cut"), F.col(f"{m}.size")).when(mine == F.col(f"{c}.cut"), F.col(f"{c}.part")).otherwise(F.lit(0))
    size = F.col(f"{m}.size")
    whole = F.array_repeat(size, F.col(f"{c}.epochs").cast("int"))
    takes = F.filter(F.concat(whole, F.array(more.cast("long"))), lambda x: x > 0)
    n = fresh("_take", docs.columns)
    df = df.withColumn(n, F.explode(takes))
    first = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col(n).cast("int")), " ")
    text = F.when(F.col(n) < size, first).otherwise(F.col("text"))
    out = df.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
