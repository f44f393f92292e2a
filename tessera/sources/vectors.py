"""Vector shards: a matrix file and its description for each repo, or vectors inline."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Inline shards over this many bytes are left out.
MOST_BYTES = 256 << 20
SCHEMA = "repo string, key string, content_hash string, vec array<float>, recipe_stamp string, form int"


def _matrix(meta: dict, data: bytes) -> list[tuple]:
    """Rows of a shard; raises ValueError if description and matrix do not fit."""
    m = np.load(io.BytesIO(data), allow_pickle=False)
    entries = meta["entries"]
    if m.ndim != 2 or m.shape[1] != meta["dim"] or not isinstance(entries, dict):
        raise ValueError("dimensions")
    out = []
    for key, e in entries.items():
        row = e.get("row")
        if row is not None and not 0 <= row < len(m):
            raise ValueError("row")
        out.append((meta["repo_id"], key, e.get("content_hash"), None if row is None else m[row].astype(np.float32).tolist(), meta.get("recipe_stamp"), 2))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(repo, key, content_hash, vec, recipe_stamp) of all shards under a path.

    A shard is <name>.meta.json with <name>.npy, or <name>.json with vectors inline. A shard that is not valid drops its
    repo alone, and a matrix shard goes before an inline one of the same repo.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MOST_BYTES * 4)
    stem = F.regexp_replace("path", r"(\.meta\.json|\.npy|\.json)$", "")
    parts = files.select(stem.alias("stem"), "path", "content").groupBy("stem").agg(F.collect_list(F.struct("path", "content")).alias("files"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for found in b["files"]:
                by = {PurePosixPath(f["path"]).name: bytes(f["content"]) for f in found}
                meta = next((v for k, v in by.items() if k.endswith(".meta.json")), None)
                data = next((v for k, v in by.items() if k.endswith(".npy")), None)
                try:
                    if meta is not None and data is not None:
                        rows += _matrix(json.loads(meta), data)
                    elif meta is None and data is None:
                        text = next(iter(by.values()))
                        d = json.loads(text) if len(text) <= MOST_BYTES else {}
                        rows += [(d["repo_id"], k, e.get("content_hash"), list(map(float, e["embedding"])) if e.get("embedding") else None, d.get("recipe_stamp"), 1) for k, e in d["entries"].items()]
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
            yield pd.DataFrame(rows, columns=["repo", "key", "content_hash", "vec", "recipe_stamp", "form"])

    got = parts.mapInPandas(run, SCHEMA)
    best = got.groupBy("repo").agg(F.max("form").alias("form"))
    return got.join(best, ["repo", "form"]).drop("form")


def write(vectors: DataFrame, path: str, recipe: dict) -> None:
    """Vectors by repo, so that an unchanged repo's folder can be kept as it is."""
    stamp = recipe_stamp(recipe)
    vectors.withColumn("recipe_stamp", F.lit(stamp)).write.mode("overwrite").partitionBy("repo").option("partitionOverwriteMode", "dynamic").parquet(path)


def recipe_stamp(recipe: dict) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(recipe, sort_keys=True).encode()).hexdigest()[:32]
