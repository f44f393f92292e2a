"""Cross-repo relations: similar approaches, package dependencies, API providers and consumers, manual relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import extension, norm_label
from ..model import API_CONFIDENCE, COPIES, COSINE, CROSS_LANGUAGE, DEV_CONFIDENCE, FALLBACK_SCORE, IDENTITY_FLOOR, MANUAL_CONFIDENCE, PAIR_CAP, RELATIVE, RUNTIME_CONFIDENCE, SEP, TOP_K, key_parts

# Extensions that count as code, and those that are one language.
CODE = [".php", ".py", ".go", ".rb", ".java", ".kt", ".cs", ".rs", ".swift", ".scala", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".c", ".h", ".cc", ".cpp", ".hpp", ".m", ".mm", ".pp", ".scss", ".css", ".sql"]
FAMILY = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue"]
REF = "struct<repo:string,source_file:string,qualified_label:string>"


def _ref(key: Column) -> Column:
    repo, file, label = key_parts(key)
    return F.struct(repo.alias("repo"), file.alias("source_file"), label.alias("qualified_label"))


def edge(kind: str, source: Column, target: Column, provenance: Column, confidence: Column, evidence: Column) -> list[Column]:
    """The columns of an overlay edge."""
    return [F.lit(kind).alias("type"), source.alias("source"), target.alias("target"), provenance.alias("provenance"), confidence.cast("double").alias("confidence"), evidence.alias("evidence")]


def described(pairs: DataFrame) -> DataFrame:
    """pairs (key_a, key_b, score) with repos, files and extensions of both sides, and the pair of repos."""
    a, b = F.split("key_a", SEP, 3), F.split("key_b", SEP, 3)
    d = pairs.withColumns({"repo_a": a[0], "file_a": a[1], "repo_b": b[0], "file_b": b[1]})
    return d.withColumns({"ext_a": extension(F.col("file_a")), "ext_b": extension(F.col("file_b")), "r1": F.least("repo_a", "repo_b"), "r2": F.greatest("repo_a", "repo_b")})


def calibration(pairs: DataFrame) -> DataFrame:
    """(r1, r2, ext, copies, identity, line): for each pair of repos and extension, how alike files of one path are.

    From ten copies on: the upper median; below the floor the line is out of reach, else it is 0.92 of the median.
    """
    d = described(pairs).where("file_a <> '' and file_a = file_b")
    group = ["r1", "r2", "ext"]
    c = d.groupBy("r1", "r2", F.col("ext_a").alias("ext"), "score").agg(F.count("*").alias("c"))  # equal scores are one row
    w = W.partitionBy(*group)
    c = c.withColumn("upto", F.sum("c").over(w.orderBy("score"))).withColumn("n", F.sum("c").over(w)).where((F.col("n") >= COPIES) & (F.col("upto") > F.floor(F.col("n") / 2)))
    c = c.groupBy(*group).agg(F.max("n").cast("int").alias("copies"), F.min("score").alias("identity"))
    return c.withColumn("line", F.when(F.col("identity") < IDENTITY_FLOOR, F.lit(2.0)).otherwise(F.col("identity") * RELATIVE))


def admitted(pairs: DataFrame, threshold: float = COSINE, cap: int = PAIR_CAP) -> DataFrame:
    """pairs that count as similar approaches, with the line they passed: code on both sides, not one path, at most cap for each pair of repos."""
    d = described(pairs).where("not (file_a <> '' and file_a = file_b)").where(F.col("ext_a").isin(CODE) & F.col("ext_b").isin(CODE))
    lines = calibration(pairs).select("r1", "r2", "ext", "line")
    one = lines.select("r1", "r2", F.col("ext").alias("ext_a"), F.col("line").alias("line_a"))
    two = lines.select("r1", "r2", F.col("ext").alias("ext_b"), F.col("line").alias("line_b"))
    family = lines.where(F.col("ext").isin(FAMILY)).groupBy("r1", "r2").agg(F.max("line").alias("line_f"))
    d = d.join(one, ["r1", "r2", "ext_a"], "left").join(two, ["r1", "r2", "ext_b"], "left").join(family, ["r1", "r2"], "left")
    kin = F.col("ext_a").isin(FAMILY) & F.col("ext_b").isin(FAMILY)
    any_kin = F.col("ext_a").isin(FAMILY) | F.col("ext_b").isin(FAMILY)
    own = F.greatest("line_a", "line_b")  # nulls are passed over
    line = F.when((F.col("ext_a") == F.col("ext_b")) | kin, F.coalesce(own, F.when(any_kin, F.col("line_f")), F.lit(threshold))).otherwise(F.lit(CROSS_LANGUAGE))
    d = d.withColumn("line", line).where("score >= line")
    place = F.row_number().over(W.partitionBy("r1", "r2").orderBy(F.col("score").desc(), "key_a", "key_b"))
    return d.withColumn("_p", place).where(F.col("_p") <= cap).select("key_a", "key_b", "score", "line", "r1", "r2")


def similar_edges(pairs: DataFrame, model: str, k: int = TOP_K) -> DataFrame:
    a = admitted(pairs)
    text = F.format_string(f"embedding cosine similarity=%.4f model='{model}' threshold=%.4f (mutual top-{k})", "score", "line")
    return a.select(*edge("similar_approach", _ref(F.col("key_a")), _ref(F.col("key_b")), F.lit("embedding"), F.round("score", 4), text))


def fallback_pairs(nodes: DataFrame, embedded: DataFrame, k: int = TOP_K, cap: int = PAIR_CAP) -> DataFrame:
    """(key_a, key_b): nodes without a vector that share label and community across repos; k partners a node at most, cap for a pair of repos.

    nodes: key, repo, label, community_name. Within a bucket (label, community) nodes are taken in key order and only
    pairs that both sides still have room for are made, so a large bucket gives at most k pairs a node, never all.
    """
    n = nodes.where("key is not null").join(embedded.select("key").distinct(), "key", "left_anti").withColumn("l", norm_label(F.col("label"))).where("l <> '' and coalesce(community_name, '') <> ''")

    def pair(part: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(part["key"], part["repo"], strict=True))
        room, out = {x: k for x, _ in rows}, []
        free = list(rows)
        for key, repo in rows:
            for other, r in free:
                if room[key] <= 0:
                    break
                if r > repo and room[other] > 0:
                    out.append((key, other))
                    room[key] -= 1
                    room[other] -= 1
            if len(out) % 64 == 0:
                free = [x for x in free if room[x[0]] > 0]
        return pd.DataFrame(out, columns=["key_a", "key_b"])

    p = n.select("key", "repo", "l", "community_name").groupBy("l", "community_name").applyInPandas(pair, "key_a string, key_b string")
    a, b = F.split("key_a", SEP, 3)[0], F.split("key_b", SEP, 3)[0]
    place = F.row_number().over(W.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy("key_a", "key_b"))
    return p.withColumn("_p", place).where(F.col("_p") <= cap).drop("_p")


def fallback_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(*edge("similar_approach", _ref(F.col("key_a")), _ref(F.col("key_b")), F.lit("label_community"), F.lit(FALLBACK_SCORE), F.lit("same label and community")))


def owners(packages: DataFrame) -> DataFrame:
    """(ecosystem, name, repo): the first repo, by id, composer before package.json, that names a package; packages: repo, ecosystem, name."""
    rank = F.row_number().over(W.partitionBy("name").orderBy("repo", F.when(F.col("ecosystem") == "composer", 0).otherwise(1)))
    return packages.where("name <> ''").withColumn("_r", rank).where("_r = 1").select("name", "repo", "ecosystem")


def depends_on(dependencies: DataFrame, packages: DataFrame, locked: DataFrame) -> DataFrame:
    """(repo, target, name, dev, confidence): dependencies on another repo's package that the repo's lock file has.

    dependencies: repo, ecosystem, name, dev; locked: repo, ecosystem, name. Without a lock there is no edge.
    """
    own = owners(packages).select("name", F.col("repo").alias("target"))
    d = dependencies.join(locked, ["repo", "ecosystem", "name"], "left_semi").join(own, "name").where("repo <> target")
    return d.select("repo", "target", "name", "ecosystem", "dev", F.when(F.col("dev"), DEV_CONFIDENCE).otherwise(RUNTIME_CONFIDENCE).alias("confidence"))


def api_matches(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(method, template, provider repo, file and label, consumer repo and file): consumers of another repo's route.

    A route's provider is the first in the order of repo_ord, suffix_ord, file, pos.
    """
    rank = F.row_number().over(W.partitionBy("method", "template").orderBy("repo_ord", "suffix_ord", "file", "pos"))
    first = providers.withColumn("_r", rank).where("_r = 1").select("method", "template", F.col("repo").alias("p_repo"), F.col("file").alias("p_file"), F.col("label").alias("p_label"))
    return first.join(consumers.select("method", "template", F.col("repo").alias("c_repo"), F.col("file").alias("c_file")), ["method", "template"]).where("p_repo <> c_repo").distinct()


def api_edges(matches: DataFrame) -> DataFrame:
    """Two edges for each match: the provider provides, the consumer consumes."""
    p = F.struct(F.col("p_repo").alias("repo"), F.col("p_file").alias("source_file"), F.col("p_label").alias("qualified_label"))
    c = F.struct(F.col("c_repo").alias("repo"), F.col("c_file").alias("source_file"), F.col("c_file").alias("qualified_label"))
    both = matches.select(F.explode(F.array(F.struct(F.lit("provides_api").alias("type"), p.alias("source"), c.alias("target")), F.struct(F.lit("consumes_api").alias("type"), c.alias("source"), p.alias("target")))).alias("x"), "method", "template")
    return both.select("x.type", "x.source", "x.target", F.lit("route_literal").alias("provenance"), F.lit(API_CONFIDENCE).alias("confidence"), F.concat_ws(" ", "method", "template").alias("evidence"))


def resolve_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (repo, source_file, label, ...) with the key they mean and a state: ok, dangling, or ambiguous.

    A label is a node's key label; for configuration keys also the bare last part, if one node alone has it.
    nodes: repo, source_file, label (full), bare.
    """
    n = nodes.select(F.col("repo").alias("_r"), F.col("source_file").alias("_f"), F.col("label").alias("_l"), F.col("bare").alias("_b")).distinct()
    full = refs.join(n.drop("_b").distinct(), (F.col("repo") == F.col("_r")) & (F.col("source_file") == F.col("_f")) & (F.col("label") == F.col("_l")), "left")
    full = full.withColumn("full", F.col("_l")).drop("_r", "_f", "_l")
    by_bare = n.groupBy("_r", "_f", "_b").agg(F.countDistinct("_l").alias("_n"), F.min("_l").alias("_one"))
    j = full.join(by_bare, (F.col("repo") == F.col("_r")) & (F.col("source_file") == F.col("_f")) & (F.col("label") == F.col("_b")), "left")
    state = F.when(F.col("full").isNotNull(), "ok").when(F.col("_n") == 1, "ok").when(F.col("_n") > 1, "ambiguous").otherwise("dangling")
    return j.withColumn("state", state).withColumn("key", F.when(F.col("state") == "ok", F.concat_ws(SEP, "repo", "source_file", F.coalesce("full", "_one")))).drop("full", "_r", "_f", "_b", "_n", "_one")


def manual_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from declared relations (type, source, target, confidence, evidence); an end that is not there, or not clear, is an error."""
    r = relations.withColumn("_i", F.monotonically_increasing_id())
    for side in ("source", "target"):
        refs = r.select("_i", F.col(f"{side}.repo").alias("repo"), F.col(f"{side}.source_file").alias("source_file"), F.col(f"{side}.qualified_label").alias("label"))
        got = resolve_refs(refs, nodes).select(F.col("_i"), F.when(F.col("state") == "ok", F.col("key")).otherwise(F.raise_error(F.concat(F.lit(f"{side} of a manual relation is "), "state", F.lit(": "), F.concat_ws("/", "repo", "source_file", "label"))).cast("string")).alias(f"_{side}"))
        r = r.join(got, "_i")
    return r.select(F.col("type"), _ref(F.col("_source")).alias("source"), _ref(F.col("_target")).alias("target"), F.lit("manual").alias("provenance"), F.coalesce("confidence", F.lit(MANUAL_CONFIDENCE)).alias("confidence"), F.col("evidence"))


def counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n_edges"))


def similar_hits(key: str, overlay: DataFrame, neighbours: DataFrame | None) -> DataFrame:
    """(key, score, provenance): what is similar to a key by the overlay, in either direction, best score; then neighbours (key) at 0.5, unless the overlay has them."""
    s = overlay.where("type = 'similar_approach'").select(F.concat_ws(SEP, "source.repo", "source.source_file", "source.qualified_label").alias("a"), F.concat_ws(SEP, "target.repo", "target.source_file", "target.qualified_label").alias("b"), "confidence", "provenance")
    both = s.where(F.col("a") == key).select(F.col("b").alias("key"), "confidence", "provenance").unionByName(s.where(F.col("b") == key).select(F.col("a").alias("key"), "confidence", "provenance"))
    best = both.groupBy("key").agg(F.max("confidence").alias("score"), F.max_by("provenance", "confidence").alias("provenance"))
    if neighbours is None:
        return best
    more = neighbours.select("key").distinct().join(best, "key", "left_anti").select("key", F.lit(0.5).alias("score"), F.lit("structural").alias("provenance"))
    return best.unionByName(more)
