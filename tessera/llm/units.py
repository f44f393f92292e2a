"""Substring dedup by paragraph hashing: units, grouped by digest over all documents; the earliest stays.

A unit is a paragraph: from the start of each sentence or line on, the shortest run of neighbouring ones that has
enough words. So a passage is found wherever it stands, set into a longer line or cut into short ones, while single
sentences that texts share by chance, or a short line that many have, stay. Style: Arrow batches make units and cut
texts; grouping is by DataFrame. Digests are counted first (pre-aggregated before the shuffle, so a unit that a third
of all documents share costs one row for each task), and only units whose digest occurs twice are ranked. What is
aggregated is written before it is joined, so that adaptive execution can split a frequent digest's rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, freed, fresh, parted, slices, temporary, text_key, tidied, written

#: Fixed value: a sentence or line with the blanks after it: it ends at marks before a blank or the end, or at a line feed. They cover a text without gaps.
SENTENCE = r"(?:[^.!?\n]|[.!?]+[^.!?\n \t\x0b\x0c\r])+[.!?]*[ \t\n\x0b\x0c\r]*|[.!?]+[ \t\n\x0b\x0c\r]*|[ \t\n\x0b\x0c\r]+"
_SENTENCE = re.compile(SENTENCE)
#: Words that a unit has at least.
LEAST = 15


def text_units(text: str, min_words: int = LEAST) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, 128-bit digest) of each unit of a text, by start; offsets count code points, ends take in the blanks that follow.

    A unit depends on what it holds alone: it is normalised before hashing, A-Z lower-cased, each run of blanks one
    space, none at the ends. A text with fewer words has none.
    """
    bounds, counts, words = [0], [], []
    for m in _SENTENCE.finditer(text):
        w = m.group().encode().lower().split()
        bounds.append(m.end())
        counts.append(len(w))
        words += w
    before = list(accumulate(counts, initial=0))
    at = list(accumulate((len(w) + 1 for w in words), initial=0))
    joined, j = b" ".join(words), 0
    for i, n in enumerate(counts):
        if not n:
            continue
        while j < len(counts) and before[j] - before[i] < min_words:
            j += 1
        if before[j] - before[i] < min_words:
            break
        yield bounds[i], bounds[j], xxhash.xxh3_128_digest(joined[at[before[i]] : at[before[j]] - 1])


def units(docs: DataFrame, min_words: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t1, t2, s, e, d1, d2): all units of all rows; t1 and t2 stand for the text, which tells rows of one id apart, d1 and d2 are the digest's halves."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("t1", "t2", "s", "e", "d1", "d2"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, s, e, d = [], [], [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                for start, end, digest in text_units(t or "", min_words):
                    at.append(i)
                    s.append(start)
                    e.append(end)
                    d.append(digest)
            if at:
                take, halves = pa.array(at, pa.int64()), np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
                cols = [*(b.column(i).take(take) for i in range(3)), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select(F.col(id_col).alias("id"), *text_key(text_col), F.col(text_col).alias("t")).mapInArrow(tidied(run), schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch made one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeats(docs: DataFrame, min_words: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t1, t2, spans): for each row that loses something, the spans (s, e) that its repeated units cover, in order, none overlapping.

    Of units with one digest the one of the smallest id stays (null last), then of the smallest text hash, then the
    first in its text; all others go, but for one that overlaps the first in its own text. Rows alike in id and text
    count as one document.
    """
    u = written(units(docs, min_words, id_col, text_col), "units")
    often = written(u.groupBy("d1", "d2").agg(F.count("*").alias("c")).where("c > 1").select("d1", "d2"), "often")
    found = written(u.join(often, ["d1", "d2"]), "repeated")
    discard(u)
    freed(docs.sparkSession)
    rank = F.struct(F.col("id").isNull().alias("x"), F.col("id"), F.col("t1"), F.col("t2"), F.col("s"))
    first = written(found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.min_by("e", rank).alias("until")), "first")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    gone = found.join(first, ["d1", "d2"]).where((rank != F.col("first")) & ~(own & (F.col("s") < F.col("until"))))
    spans = gone.groupBy("id", "t1", "t2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    names = spans.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [[{"s": s, "e": e} for s, e in merged([(x["s"], x["e"]) for x in row])] for row in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(made, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], names)

    return spans.mapInArrow(tidied(run), spans.schema)


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    ends = [0, *(x["e"] for x in spans)]
    return "".join(text[a:b] for a, b in zip(ends, [*(x["s"] for x in spans), len(text)], strict=True))


def cleaned(docs: DataFrame, min_words: int = LEAST, spans: str | None = None) -> DataFrame:
    """docs, with all their columns, without repeated units; n_chars, where there is one, is made to fit.

    spans: a further column for the removed spans, with original offsets. Null texts stay null; empty texts and an
    empty table pass through; a document can lose all its text and then has an empty one. Rows that repeat lose alike.
    """
    with temporary(docs.sparkSession) as keep:
        gone = keep(repeats(docs, min_words), "spans")
    gone = gone.select(F.struct("id", "t1", "t2", "spans").alias(fresh("_gone", docs.columns)))
    g = gone.columns[0]
    name = spans or fresh("_spans", docs.columns)
    sure, rest = parted(docs, text_key(docs["text"])[0], gone.select(f"{g}.t1"))
    same = [key == gone[f"{g}.{c}"] for c, key in zip(("t1", "t2"), text_key(rest["text"]), strict=True)]
    df = rest.join(gone, [rest["doc_id"].eqNullSafe(gone[f"{g}.id"]), *same], "left").withColumn(name, F.col(f"{g}.spans"))

    @F.udf("string", useArrow=True)
    def cut(text, where):
        return _without(text, where)

    df = df.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(cut("text", name)))
    if "n_chars" in docs.columns:
        df, sure = (x.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) for x in (df, sure))
    if spans:
        sure = sure.withColumn(name, F.lit(None).cast(gone.schema[g].dataType["spans"].dataType))
    kept = [*docs.columns, *([name] if spans else [])]
    return df.select(*kept).unionByName(sure.select(*kept))
