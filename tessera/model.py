"""The data model: property graphs as two DataFrames, and the constants that fix query results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Columns of nodes; whatever else a source has goes to attrs, a JSON object.
NODE = "id string, repo string, label string, source_file string, line int, norm_label string, community int, community_name string, origin string, kind string, ord long, attrs string"
#: Columns of edges. Parallel edges are rows of their own.
EDGE = "source string, target string, relation string, confidence string, confidence_score double, also_seen int, resolver string, context string, cross_repo boolean, ord long, attrs string"
SEP = "\x1f"

# Results depend on each of these.
RRF_K = 60
DEPTH = 50
SEEDS = 10
HUB_DEGREE, HUB_FACTOR = 50, 0.5
DEPRECATED, DEPRECATED_FACTOR = "/DEPRECATED/", 0.3
STALE_FACTOR = 0.5
TEST_FACTOR, TEST_DEPTH, TEST_SLOT = 0.3, 10, 10
MMR_LAMBDA, MMR_DEPTH, MMR_SIMILAR = 0.7, 10, 0.9
MAX_K, DEFAULT_K = 100, 10
EXACT_SCORE, ANCHOR_SCORE = 1_000_000.0, 500_000.0
ANCHOR_MEMBERS, ANCHOR_LEAST, ANCHOR_DOMINANCE, ANCHOR_PINS = 10, 10.0, 2.0, 2
MAX_DEPTH, MAX_TRAVERSED, MAX_RELATIONS, MAX_RELATION_CHARS = 16, 2000, 16, 64
MAX_ROUTES, MAX_SUGGESTIONS = 500, 8
NEIGHBOUR_SCORE, FALLBACK_SCORE = 0.5, 0.4
CHARS_A_TOKEN, PACK_K, PACK_BUDGET, PACK_MOST = 4, 30, 2000, 100_000
MAP_HUBS, MAP_LEAST, MAP_MOST = 15, 2, 25
COSINE, RELATIVE, IDENTITY_FLOOR, COPIES, CROSS_LANGUAGE, CANDIDATE_FLOOR, TOP_K, PAIR_CAP = 0.82, 0.92, 0.80, 10, 0.74, 0.60, 5, 2000
PLANES, PLANE_SEED, BUCKET_CAP, EXACT_ROWS = 12, 1337, 4096, 80_000
RUNTIME_CONFIDENCE, DEV_CONFIDENCE, MANUAL_CONFIDENCE, API_CONFIDENCE = 0.95, 0.8, 1.0, 0.85
BOOSTS = {"label": 3.0, "path": 1.5, "snippet": 1.0}
EXTRACTED = "EXTRACTED"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def keyed(self) -> DataFrame:
        """Nodes with their durable key; key is null where a node has no file or label."""
        return self.nodes.withColumn("key", durable_key(F.col("repo"), F.col("source_file"), F.col("label")))


def blank(c: Column) -> Column:
    """Null for the empty string: absent, null and empty mean the same in most reads."""
    return F.nullif(c, F.lit(""))


def durable_key(repo: Column, file: Column, label: Column) -> Column:
    """repo, file and label put together; null if file or label is missing."""
    return F.when(blank(file).isNotNull() & blank(label).isNotNull(), F.concat_ws(SEP, F.coalesce(repo, F.lit("")), file, label))


def key_parts(key: Column) -> list[Column]:
    """repo, file and label of a durable key; later separators belong to the label."""
    parts = F.split(key, SEP, 3)
    return [parts[0].alias("repo"), parts[1].alias("source_file"), parts[2].alias("label")]
