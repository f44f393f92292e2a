"""What is kept from one generation to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def id_map(before: DataFrame, keys: DataFrame, generation: str, now: Column) -> DataFrame:
    """(key, status, generation_id, tombstoned_at): current keys are active; others keep their tombstone or get one now."""
    k = keys.select("key", F.lit(True).alias("_here")).distinct()
    j = before.join(k, "key", "full")
    here = F.coalesce("_here", F.lit(False))
    dead = F.coalesce(F.col("status") == "tombstoned", F.lit(False))
    return j.select(
        "key",
        F.when(here, "active").otherwise("tombstoned").alias("status"),
        F.when(~here & dead, F.col("generation_id")).otherwise(F.lit(generation)).alias("generation_id"),
        F.when(~here, F.when(dead, F.col("tombstoned_at")).otherwise(now)).alias("tombstoned_at"),
    )


def reuse(current: DataFrame, before: DataFrame, recipe: str, before_recipe: str) -> DataFrame:
    """current (repo, key, content_hash) with the vector it had, if text and recipe are the same; others have none and are to be embedded."""
    if recipe != before_recipe:
        return current.withColumn("vec", F.lit(None).cast("array<float>"))
    b = before.select("key", F.col("content_hash").alias("_h"), "vec")
    return current.join(b, "key", "left").select("repo", "key", "content_hash", F.when(F.col("_h") == F.col("content_hash"), F.col("vec")).alias("vec"))


def carry(before: DataFrame, keys: DataFrame, recipe: str, before_recipe: str) -> DataFrame:
    """What is kept of a repo that could not be embedded: its current keys, and nothing at all under another recipe."""
    return before.join(keys, "key", "left_semi") if recipe == before_recipe else before.limit(0)


def content_current(current: DataFrame, shard: DataFrame) -> DataFrame:
    """(repo, current): whether each repo's shard has every key with its text's hash."""
    j = current.join(shard.select("key", F.col("content_hash").alias("_h")), "key", "left")
    return j.groupBy("repo").agg(F.bool_and(F.coalesce(F.col("_h") == F.col("content_hash"), F.lit(False))).alias("current"))


def stale_recipes(shards: DataFrame, recipe: str) -> DataFrame:
    return shards.where(F.col("recipe_stamp") != recipe).select("repo").distinct()


def missing_shards(repos: DataFrame, shards: DataFrame) -> DataFrame:
    return repos.select("repo").distinct().join(shards, "repo", "left_anti")


def inputs_digest(files: DataFrame, *stamps: str) -> DataFrame:
    """(repo, digest) of files (repo, path, size, modified) and what else a shard depends on."""
    line = F.concat_ws(":", "path", F.col("size").cast("string"), F.col("modified").cast("string"))
    return files.groupBy("repo").agg(F.sha2(F.concat_ws("\n", *map(F.lit, stamps), F.concat_ws("\n", F.array_sort(F.collect_list(line)))), 256).alias("digest"))


def gate(states: DataFrame) -> DataFrame:
    """One row: shares of blocking and of unrefreshed repos, and whether they forbid publishing.

    states: blocking, unrefreshed, in_grace; repos in grace count on neither side. Over 30 or 40 percent forbids.
    """
    s = states.where(~F.col("in_grace"))
    n = F.count("*")
    a, b = F.sum(F.col("blocking").cast("int")) / n, F.sum(F.col("unrefreshed").cast("int")) / n
    return s.agg(n.alias("considered"), F.coalesce(a, F.lit(0.0)).alias("blocking_share"), F.coalesce(b, F.lit(0.0)).alias("unrefreshed_share")).withColumn("refused", (F.col("blocking_share") > 0.30) | (F.col("unrefreshed_share") > 0.40))


def changed_rows(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of after that are new or have another digest: what a cache of results by digest cannot serve."""
    return after.join(before.select(key, F.col(digest).alias("_d")), key, "left").where(F.col("_d").isNull() | (F.col("_d") != F.col(digest))).drop("_d")
