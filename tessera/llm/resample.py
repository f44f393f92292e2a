"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Style: Arrow batches hash and count. The raw model counts all documents; the target model a bounded set of labelled
ones. The number of buckets follows the distinct features of the corpus, which a first pass estimates. Tasks hand on
their counts as compressed blocks of buckets, which are summed block by block. Up to BROADCAST buckets the log ratios
go to all tasks as one array; beyond, documents' features are joined with the table of ratios, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, tidied, written

#: Buckets at least; and beyond how many the ratios are joined instead of broadcast (4 bytes each).
LEAST_BUCKETS, BROADCAST = 1 << 17, 1 << 24
#: Buckets for the root of the number of distinct features.
BY_ROOT = 512
#: Buckets of a block, the least unit that is summed.
BLOCK = 1 << 13
#: Hashes kept to estimate how many distinct ones there are.
SMALLEST = 4096
#: Labelled rows that the target model may use: a bound on the set of ids that is broadcast (8 bytes each).
LABELLED = 20_000
SEED = 7


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each feature of the texts, one after the other, and how many each has: words and pairs of words, A-Z lower-cased."""
    rows = [(t or "").encode().lower().split() for t in texts]
    per = np.fromiter(map(len, rows), np.int64, len(rows))
    if not per.sum():
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    coded = pa.array([w for r in rows for w in r], pa.binary()).dictionary_encode()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64)[coded.indices.to_numpy()]
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pair ^= pair >> np.uint64(31)
    n = len(h)
    out = np.empty(2 * n, np.uint64)
    out[0::2] = h
    out[1:-1:2] = pair
    keep = np.ones(2 * n, bool)
    ends = np.cumsum(per)
    keep[2 * ends[per > 0] - 1] = False  # no pair goes beyond its text
    return (out * np.uint64(0xD6E8FEB86659FD93))[keep], np.maximum(2 * per - 1, 0)


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    """The top bits of hashes; n is a power of two."""
    return (h >> np.uint64(65 - n.bit_length())).astype(np.int64)


def _groups(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= most):
            held += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def distinct_features(docs: DataFrame, text_col: str = "text") -> int:
    """About how many distinct features all documents have, within some 2 %: by the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = np.zeros(0, np.uint64)
        for b in slices(batches):
            texts = b.column(0).to_pylist()
            for lo, hi in _groups(texts):
                h, _ = hashed(texts[lo:hi])
                if len(small) == SMALLEST:
                    h = h[h < small[-1]]
                small = np.unique(np.concatenate([small, h]))[:SMALLEST]
        yield pa.RecordBatch.from_arrays([pa.array((small ^ np.uint64(1 << 63)).view(np.int64))], ["h"])  # signed, in the same order

    h = docs.select(text_col).mapInArrow(tidied(run), "h long").distinct().orderBy("h").limit(SMALLEST)
    n, last = h.agg(F.count("*"), F.max("h")).first()
    return n if n < SMALLEST else round((SMALLEST - 1) * 2.0**64 / ((last + (1 << 63)) or 1))


def bucket_count(distinct: int) -> int:
    """A power of two, LEAST_BUCKETS or more: it grows with the root of the number of distinct features, as vocabularies do with texts."""
    return 1 << max(LEAST_BUCKETS.bit_length() - 1, math.ceil(math.log2(max(1.0, BY_ROOT * math.sqrt(distinct)))))


def model(docs: DataFrame, target_ids: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(block, raw, target): the counts of each block of buckets as bytes of 64-bit numbers; and the number of documents.

    target_ids: one column of ids, LABELLED rows at most, which is what is broadcast.
    """
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("_id")).where("_id is not null").distinct().limit(LABELLED)
    d = docs.select(id_col, text_col).join(F.broadcast(ids), F.col(id_col) == F.col("_id"), "left").select(F.col("_id").isNotNull().alias("t"), text_col)
    size = min(BLOCK, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, zstd = np.zeros((2, buckets), np.int32), 0, pa.Codec("zstd", 1)
        for b in slices(batches):
            texts, mine = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False)
            n += len(texts)
            for lo, hi in _groups(texts):
                h, per = hashed(texts[lo:hi])
                k = _buckets(h, buckets)
                np.add.at(counts[0], k, 1)
                np.add.at(counts[1], k[np.repeat(mine[lo:hi], per)], 1)
        for lo in range(0, buckets // size, 256):
            at = [i for i in range(lo, min(lo + 256, buckets // size)) if counts[0, i * size : (i + 1) * size].any()]
            packed = [[zstd.compress(c[i * size : (i + 1) * size].tobytes(), asbytes=True) for i in at] for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(p, pa.binary()) for p in packed)], ["block", "raw", "target"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([str(n).encode()]), pa.array([b""])], ["block", "raw", "target"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: int, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x.tobytes()]) for x in sums)], ["block", "raw", "target"])

        now, sums, zstd = None, np.zeros((2, size), np.int64), pa.Codec("zstd", 1)
        for b in batches:
            for block, *packed in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if block != now:
                    if now is not None:
                        yield out(now, sums)
                    now, sums = block, np.zeros((2, size), np.int64)
                for x, p in zip(sums, packed, strict=True):
                    x += np.frombuffer(zstd.decompress(p, size * 4, asbytes=True), np.int32)
        if now is not None:
            yield out(now, sums)

    schema = "block long, raw binary, target binary"
    counted = written(d.mapInArrow(tidied(run), schema), "counts")
    n = counted.where("block < 0").agg(F.sum(F.decode("raw", "UTF-8").cast("long"))).first()[0] or 0
    dealt = counted.where("block >= 0").repartition("block").sortWithinPartitions("block")
    return written(dealt.mapInArrow(tidied(add), schema), "model"), n


#: Pseudo-counts by which each bucket's target count is drawn to what its raw count lets expect.
SHRINK = 20.0
#: A bucket tells how the raw model is to be scaled from this target count on, or from its upper tenth.
HEAVY = 30


def log_ratio(raw: np.ndarray, target: np.ndarray, scale: float) -> np.ndarray:
    """Log ratio of the target to the raw model by bucket; scale: target counts for each raw count.

    Counts are drawn to the raw model by SHRINK pseudo-counts, so that rare features, which only tell which texts were
    labelled, say next to nothing; and what chance takes from the logarithm on average is given back, so that weights
    do not measure length.
    """
    expected = raw * scale
    return np.log((target + SHRINK) / (expected + SHRINK)) + 0.5 * expected / (expected + SHRINK) ** 2


def ratios(counts: DataFrame) -> DataFrame:
    """(block, ratio): the log ratios of each block of buckets, as bytes of 32-bit floats.

    The raw model is scaled so that the middle feature of target text has ratio zero: junk takes part of the raw mass,
    and without this each ordinary word would add the same small amount. Without target text all ratios are zero.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, target in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                r, t = np.frombuffer(raw, np.int64), np.frombuffer(target, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r[t > 0]), pa.array(t[t > 0])], ["raw", "target"])

    some = written(counts.mapInArrow(pairs, "raw long, target long"), "target")  # buckets of target text: bounded by LABELLED
    least = some.agg(F.least(F.lit(float(HEAVY)), F.percentile("target", 0.9))).first()[0]
    scale = some.where(F.col("target") >= F.lit(least)).agg(F.percentile(F.col("target") / F.col("raw"), 0.5, F.col("target"))).first()[0] if least is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, target in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                r, t = np.frombuffer(raw, np.int64), np.frombuffer(target, np.int64)
                out.append((log_ratio(r, t, scale) if scale is not None else np.zeros(len(r))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["block", "ratio"])

    return counts.mapInArrow(tidied(run), "block long, ratio binary")


def weighed(docs: DataFrame, ratio: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST) -> DataFrame:
    """(id, h, n_features, log_weight) for each row: the sum of its features' log ratios, rounded to six places."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("n_features", T.LongType())]
    rows = docs.select(id_col, F.xxhash64(text_col).alias("h"), text_col)
    if buckets > most:
        return _joined(rows, ratio, buckets, fields)
    dense = np.zeros(buckets, np.float32)
    size = min(BLOCK, buckets)
    for r in ratio.toLocalIterator():  # buckets floats, most at the utmost
        dense[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["ratio"], np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            for lo, hi in _groups(texts):
                h, per = hashed(texts[lo:hi])
                sums = np.zeros(hi - lo)
                if len(h):
                    full = per > 0
                    sums[full] = np.add.reduceat(r[_buckets(h, buckets)].astype(np.float64), (np.cumsum(per) - per)[full])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(per), pa.array(np.round(sums, 6))], [*(f.name for f in fields), "log_weight"])

    return rows.mapInArrow(tidied(run), T.StructType([*fields, T.StructField("log_weight", T.DoubleType())]))


def _joined(rows: DataFrame, ratio: DataFrame, buckets: int, fields: list[T.StructField]) -> DataFrame:
    """weighed() by a join of each document's buckets with the table of ratios: for models too large to send to every task."""
    size = min(BLOCK, buckets)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            h, per = hashed(b.column(2).to_pylist())
            row = np.repeat(b.column(3).to_numpy(), per)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(_buckets(h, buckets))], ["_row", "k"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(block * size + np.arange(size)), pa.array(np.frombuffer(r, np.float32).astype(np.float64))], ["b", "ratio"])

    used = rows.mapInArrow(tidied(features), "_row long, k long").groupBy("_row", "k").agg(F.count("*").alias("c"))
    by_bucket = written(ratio.mapInArrow(unpack, "b long, ratio double"), "ratios")
    sums = written(used, "used").join(by_bucket, F.col("k") == F.col("b")).groupBy(F.col("_row").alias("_r")).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("ratio")).alias("w"))
    out = rows.join(sums, F.col("_row") == F.col("_r"), "left")
    return out.select(fields[0].name, "h", F.coalesce("n", F.lit(0)).cast("long").alias("n_features"), F.round(F.coalesce("w", F.lit(0.0)), 6).alias("log_weight"))


def kth_largest(df: DataFrame, key: str, k: int, cells: int = 1024) -> float | None:
    """The k-th largest value of a column, exactly; None if there are fewer. Counts by cell narrow the range until one value is left; no more than a row for each cell comes to the driver."""
    df = df.where(F.col(key).isNotNull()).select(F.col(key).cast("double").alias("v"))
    n, low, high = df.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not 0 < k <= n:
        return None
    while low < high:
        cell = F.greatest(F.lit(0), F.least(F.lit(cells), F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / cells)))).cast("int")
        here = df.where(F.col("v").between(F.lit(low), F.lit(high)))
        for r in sorted(here.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: -r["c"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["low"], r["high"]) == (low, high):  # too narrow a range for cells: neighbouring numbers
            return _nth(here, k)
        low, high = r["low"], r["high"]
    return low


def _nth(df: DataFrame, k: int) -> float:
    """The k-th largest of few distinct values, by their counts."""
    for r in sorted(df.groupBy("v").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["v"]):
        if k <= r["n"]:
            return r["v"]
        k -= r["n"]
    raise ValueError("fewer values")


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, most_labelled: int = LABELLED, buckets: int | None = None, most_broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, kept) for each row of docs.

    Target: the labelled documents of quality 1 that are not toxic, most_labelled of them at most, chosen by hash.
    kept: the k rows with the largest log weight plus Gumbel noise, which is a draw of k without replacement in
    proportion to the weights; k is share of the rows, by default the share of target rows among the labels (all, if
    there are no labels). Noise comes from a hash of id and text, so reruns agree; rows alike in both get equal keys, and
    ties at the end are all kept. Null and empty texts have no features and log weight 0. An empty table gives an empty
    result. buckets: by default as many as the corpus's distinct features ask for.
    """
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    if share is None:
        share = labels.agg(F.avg(good.cast("double"))).first()[0]
        share = 1.0 if share is None else share
    chosen = labels.where(good & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(min(most_labelled, LABELLED))
    buckets = buckets or bucket_count(distinct_features(docs))
    counts, n = model(docs, chosen, buckets)
    w = weighed(docs, ratios(counts), buckets, most=most_broadcast)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    w = written(w.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "weighed")
    least = kth_largest(w, "gumbel_key", round(share * n))
    kept = F.col("gumbel_key") >= F.lit(float(least)) if least is not None else F.lit(False)
    return w.select("doc_id", "n_features", "log_weight", "gumbel_key", kept.alias("kept"))
