"""Node-link JSON graphs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import Graph

_NODE = ["id", "repo", "label", "source_file", "norm_label", "community_name"]
_EDGE = ["source", "target", "relation", "confidence", "context"]


def read(spark: SparkSession, path: str, repo: Column | None = None) -> tuple[Graph, DataFrame]:
    """Graphs under a path, one JSON object a file, and (path, sha256) of the same bytes.

    'edges' stands for 'links' where that is missing. Nodes are not merged. A file that is not JSON, or not an object,
    is left out; it still has its row in the digests, with valid false. Attributes without a column of their own stay
    in attrs. Each file is read whole by one task: a repo's graph is a file of its own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                try:
                    data = json.loads(content)
                    ok = isinstance(data, dict)
                except ValueError:
                    data, ok = {}, False
                rows = [(p, "file", -1, str(ok))]
                if ok:
                    links = data.get("links") if isinstance(data.get("links"), list) else data.get("edges")
                    rows += [(p, "node", i, json.dumps(x)) for i, x in enumerate(data.get("nodes") or []) if isinstance(x, dict)]
                    rows += [(p, "edge", i, json.dumps(x)) for i, x in enumerate(links or []) if isinstance(x, dict)]
                yield pd.DataFrame(rows, columns=["path", "what", "ord", "json"])

    rows = files.mapInPandas(run, "path string, what string, ord long, json string")
    j = lambda k: F.get_json_object("json", f"$.{k}")
    line = F.coalesce(j("line").try_cast("int"), F.regexp_extract(F.coalesce(j("source_location"), F.lit("")), r"^L(\d+)$", 1).try_cast("int"))
    nodes = rows.where("what = 'node'").select(*[j(c).alias(c) for c in _NODE], F.when(line > 0, line).alias("line"), j("community").try_cast("int").alias("community"), j("_origin").alias("origin"), j("_kind").alias("kind"), "ord", F.col("json").alias("attrs"), "path")
    seen = F.size(F.from_json(F.coalesce(j("also_seen"), F.lit("[]")), "array<string>"))
    score = F.when(j("confidence_score").isin("true", "false"), F.lit(None)).otherwise(j("confidence_score").try_cast("double"))
    edges = rows.where("what = 'edge'").select(*[j(c).alias(c) for c in _EDGE], score.alias("confidence_score"), F.when(seen > 0, seen).otherwise(0).alias("also_seen"), j("_resolver").alias("resolver"), (j("cross_repo") == "true").alias("cross_repo"), "ord", F.col("json").alias("attrs"), "path")
    if repo is not None:
        nodes = nodes.withColumn("repo", F.coalesce("repo", repo))
    digests = files.select("path", F.sha2("content", 256).alias("sha256")).join(rows.where("what = 'file'").select("path", (F.col("json") == "True").alias("valid")), "path")
    return Graph(nodes, edges), digests


def overlay(spark: SparkSession, path: str) -> DataFrame:
    """Overlay edges of a JSON file with an 'edges' list; anything else has none."""
    ref = "struct<repo:string,source_file:string,qualified_label:string>"
    text = spark.read.text(path, wholetext=True)
    edges = F.from_json("value", f"struct<edges:array<struct<type:string,source:{ref},target:{ref},provenance:string,confidence:double,evidence:string>>>")
    return text.select(F.explode(F.coalesce(edges["edges"], F.expr(f"cast(array() as array<struct<type:string,source:{ref},target:{ref},provenance:string,confidence:double,evidence:string>>)"))).alias("e")).select("e.*")


def lexical(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A lexical index in exchange form (version 2 to 4): documents, postings, aliases and stale documents; entries that make no sense are left out."""
    v = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<documents:array<array<string>>,postings:map<string,array<bigint>>,alias_exact:map<string,array<bigint>>,stale_semantic:array<bigint>,document_count:bigint>").alias("v")).select("v.*")
    from ..operators.lexical import unpack

    docs = v.select(F.posexplode("documents").alias("doc_id", "d")).where(F.size("d") == 2).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("d")[0].alias("repo"), F.col("d")[1].alias("key"))
    packed = v.select(F.explode("postings").alias("term", "packed"))
    aliases = v.select(F.explode("alias_exact").alias("alias", "ids")).select("alias", F.explode("ids").alias("doc_id"))
    known = lambda df: df.join(docs, "doc_id", "left_semi")
    return {"documents": docs, "postings": known(unpack(packed)), "aliases": known(aliases), "stale": known(v.select(F.explode("stale_semantic").alias("doc_id")))}
