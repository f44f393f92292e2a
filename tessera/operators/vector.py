"""Vectors: exact top-k, blockwise cross-repo similarity, mutual neighbours, and the bucketed alternative."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..model import CANDIDATE_FLOOR, PLANE_SEED, PLANES, TOP_K

#: Rows of a block, which a task compares with another, and of a part of one that is multiplied at a time.
BLOCK, PART = 8192, 512


def cosine(a: Column, b: Column) -> Column:
    """0 where dimensions differ or a norm is zero."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def top_k(vectors: DataFrame, query: list[float], k: int, repos: list[str] | None = None) -> DataFrame:
    """(key, score): the k keys closest to the query, ties by key; vectors of another dimension score 0 but stay."""
    v = vectors if repos is None else vectors.where(F.col("repo").isin(repos))
    if not any(query):
        return v.select("key", F.lit(0.0).alias("score")).limit(0)
    return v.select("key", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in query])).alias("score")).orderBy(F.col("score").desc(), "key").limit(k)


def _blocks(vectors: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    sizes = {r["repo"]: r["n"] for r in vectors.groupBy("repo").agg(F.count("*").alias("n")).collect()}  # a row for each repo
    n = F.create_map(*[F.lit(x) for r, c in sizes.items() for x in (r, max(1, -(-c // BLOCK)))]) if sizes else F.create_map(F.lit(""), F.lit(1))
    b = vectors.withColumn("b", F.pmod(F.xxhash64("key"), F.element_at(n, F.col("repo"))).cast("int"))
    return b, sorted((r, max(1, -(-c // BLOCK))) for r, c in sizes.items())


def _unit(flat: pa.Array, dim: int) -> np.ndarray:
    """A block's vectors as rows of length one (or zero), from their numbers one after the other: no Python object for each."""
    m = flat.to_numpy().reshape(-1, dim).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(left: np.ndarray, right: np.ndarray, names: list[str], k: int, floor: float) -> Iterator[tuple[int, int, float]]:
    """(row, column, cosine) of the best k columns of each row, at or over the floor, ties by name; PART rows are multiplied at a time."""
    for lo in range(0, len(left), PART):
        score = left[lo : lo + PART] @ right.T
        for i in np.flatnonzero((score >= floor).any(axis=1)):
            at = np.flatnonzero(score[i] >= floor)
            if len(at) > k:
                edge = np.partition(score[i][at], len(at) - k)[len(at) - k]
                at = at[score[i][at] >= edge]
            yield from ((lo + int(i), int(j), float(score[i][j])) for j in sorted(at, key=lambda j: (-score[i][j], names[j]))[:k])


def candidates(vectors: DataFrame, k: int = TOP_K, floor: float = CANDIDATE_FLOOR) -> DataFrame:
    """(owner, other_repo, other, score): for each key its best k keys of other repos with cosine at or over the floor.

    Exact. Vectors are cut into blocks within repos, as large as a task holds, so that each is sent only as often as
    there are blocks of other repos; each pair of blocks is one task's matrix product, taken in parts, of which only the
    best k of each row are kept, and the best k over all blocks follow from those. Vectors of different dimensions have
    cosine 0 and never meet.
    """
    b, repos = _blocks(vectors.withColumn("dim", F.size("vec")))
    rows = b.groupBy("repo", "b", "dim").agg(F.collect_list(F.struct("key", "vec")).alias("rows")).select("repo", "b", "dim", F.col("rows.key").alias("keys"), F.flatten("rows.vec").alias("flat"))
    count = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(n).alias("n")) for r, n in repos]) if repos else F.expr("array(named_struct('r', '', 'n', 0))")
    later = F.flatten(F.transform(F.filter(count, lambda x: x["r"] > F.col("repo")), lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda j: F.struct(F.col("repo").alias("ra"), F.col("b").alias("ba"), x["r"].alias("rb"), j.alias("bb")))))
    former = F.flatten(F.transform(F.filter(count, lambda x: x["r"] < F.col("repo")), lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda j: F.struct(x["r"].alias("ra"), j.alias("ba"), F.col("repo").alias("rb"), F.col("b").alias("bb")))))
    left = rows.select(F.explode(later).alias("p"), "dim", F.col("keys").alias("ka"), F.col("flat").alias("fa"))
    right = rows.select(F.explode(former).alias("p"), "dim", F.col("keys").alias("kb"), F.col("flat").alias("fb"))
    pairs = left.join(right, ["p", "dim"]).select("p.ra", "p.rb", "dim", "ka", "fa", "kb", "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ra, rb, dim = (batch.column(i)[at].as_py() for i in range(3))
                ka, kb = batch.column(3)[at].as_py(), batch.column(5)[at].as_py()
                ma, mb = _unit(batch.column(4)[at].values, dim), _unit(batch.column(6)[at].values, dim)
                out = [(ka[i], rb, kb[j], s) for i, j, s in _best(ma, mb, kb, k, floor)] + [(kb[i], ra, ka[j], s) for i, j, s in _best(mb, ma, ka, k, floor)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["owner", "other_repo", "other", "score"])

    found = pairs.mapInArrow(run, "owner string, other_repo string, other string, score double")
    rank = F.row_number().over(W.partitionBy("owner").orderBy(F.col("score").desc(), "other_repo", "other"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def mutual(cands: DataFrame) -> DataFrame:
    """(key_a, key_b, score), key_a < key_b: pairs that are among each other's candidates."""
    back = cands.select(F.col("owner").alias("key_b"), F.col("other").alias("key_a"))
    return cands.select(F.col("owner").alias("key_a"), F.col("other").alias("key_b"), "score").where("key_a < key_b").join(back, ["key_a", "key_b"], "left_semi")


def planes(dim: int, n: int = PLANES, seed: int = PLANE_SEED) -> np.ndarray:
    r = random.Random(seed)
    return np.array([[r.gauss(0.0, 1.0) for _ in range(dim)] for _ in range(n)])


def signatures(vectors: DataFrame, dim: int, n: int = PLANES, table: int = 0) -> DataFrame:
    """vectors with sig: on which side of each of a table's random planes they lie."""
    bits = []
    for i, p in enumerate(planes(dim, n, PLANE_SEED + table)):
        w = F.array(*[F.lit(float(x)) for x in p])
        dot = F.aggregate(F.zip_with("vec", w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
        bits.append(F.when(dot >= 0, F.lit(1 << i)).otherwise(F.lit(0)))
    return vectors.withColumn("sig", sum(bits[1:], bits[0]))


def bucketed(vectors: DataFrame, dim: int, k: int = TOP_K, floor: float = CANDIDATE_FLOOR, n: int = PLANES, tables: int = 1) -> DataFrame:
    """As candidates, but only keys on the same side of all planes of some table are compared: fast, and blind to what no table has together. Off by default.

    One table of PLANES planes finds few pairs; 8 planes and 16 tables find nine tenths and more of those with a cosine of
    0.82 (tests).
    """
    from functools import reduce

    s = reduce(DataFrame.unionByName, [signatures(vectors, dim, n, t).withColumn("t", F.lit(t)) for t in range(tables)])
    a = s.select("t", "sig", F.col("repo").alias("ra"), F.col("key").alias("owner"), F.col("vec").alias("va"))
    b = s.select("t", "sig", F.col("repo").alias("other_repo"), F.col("key").alias("other"), F.col("vec").alias("vb"))
    p = a.join(b, ["t", "sig"]).where("ra <> other_repo").dropDuplicates(["owner", "other"]).select("owner", "other_repo", "other", cosine(F.col("va"), F.col("vb")).alias("score")).where(F.col("score") >= floor)
    rank = F.row_number().over(W.partitionBy("owner").orderBy(F.col("score").desc(), "other_repo", "other"))
    return p.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
