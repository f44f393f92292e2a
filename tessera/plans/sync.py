"""The batch build: per-repo graphs to one published generation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import Graph
from ..operators import community, graph as G, incremental, lexical, overlay, validate, vector
from ..sources import facts, files, publish
from .tools import Generation, cards


def named(g: Graph, before: DataFrame | None = None, label: Callable | None = None) -> tuple[Graph, DataFrame]:
    """g with communities found inside each repo and named, and (group, provisional).

    Lone nodes take their own label. Names carry over from before; of the rest the labeler, if there is one, names what
    it can, and the hub's label stands in for what it cannot, provisionally: such a name does not carry.
    """
    com = G.cut(community.cluster(g))
    members = com.select(F.col("community").alias("group"), "id").join(g.nodes.select("id", "label", "source_file"), "id")
    sig = G.signatures(members)
    names = community.hub_names(members, G.degree(g.edges))
    texts = members.groupBy("group").agg(F.count("*").alias("n"), F.first("label").alias("one"), F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("label", "source_file"))))).alias("texts"))
    own = names.join(texts, "group").select("group", "texts", "n", F.when(F.col("n") == 1, community.orphan_name(F.col("one"))).otherwise(F.col("name")).alias("name"))
    own = own.withColumn("provisional", F.lit(False))
    if before is not None:
        old = community.carried_names(members.join(sig, "group").select("group", "id", "signature"), before).select("group", F.col("name").alias("_old"))
        own = own.join(old, "group", "left").withColumn("name", F.coalesce("_old", "name")).withColumn("kept", F.col("_old").isNotNull() | (F.col("n") == 1))
    else:
        own = own.withColumn("kept", F.col("n") == 1)
    own = G.cut(own)
    fresh = community.labelled(own.where(~F.col("kept")), label)
    own = G.cut(own.where("kept").select("group", "name", "provisional").unionByName(fresh))
    nodes = G.strip_communities(g.nodes).join(com.select("id", "community"), "id", "left").join(own, F.col("community") == F.col("group"), "left")
    out = Graph(nodes.withColumn("community_name", F.coalesce("name", F.lit("unassigned"))).drop("group", "name", "provisional"), g.edges)
    if not G.same_structure(g, out):
        raise ValueError("naming changed more than communities")
    return out, own.select("group", "provisional")


def embedded(nodes: DataFrame, before: DataFrame | None, recipe: str, before_recipe: str, embed: Callable[[list[str]], list[list[float]]] | None, batch: int = 16) -> DataFrame:
    """(repo, key, content_hash, vec) of keyed nodes (repo, key, label, source_file, snippet, line, id): kept where the text is the same, made in batches where not. Accessors of two lines get none."""
    from ..functions.text import content_hash, embedding_text, is_trivial

    n = G.representatives(nodes).withColumn("text", embedding_text(F.col("label"), F.col("source_file"), F.col("snippet"))).withColumn("trivial", is_trivial(F.col("label"), F.col("snippet")))
    now = n.select("repo", "key", F.when(~F.col("trivial"), content_hash(F.col("text"))).alias("content_hash"), "text")
    kept = incremental.reuse(now.select("repo", "key", "content_hash"), before, recipe, before_recipe) if before is not None else now.select("repo", "key", "content_hash").withColumn("vec", F.lit(None).cast("array<float>"))
    if embed is None:
        return kept
    kept = G.cut(kept)
    todo = kept.where("vec is null and content_hash is not null").select("key").join(now.select("repo", "key", "content_hash", "text"), "key")

    def run(parts):
        for p in parts:
            out = []
            for i in range(0, len(p), batch):
                out += embed(p["text"].iloc[i : i + batch].tolist())
            yield p[["repo", "key", "content_hash"]].assign(vec=out)

    made = todo.mapInPandas(run, "repo string, key string, content_hash string, vec array<float>")
    return kept.where("vec is not null or content_hash is null").unionByName(made)


def shards(nodes: DataFrame, before: dict[str, DataFrame] | None, recipe: str, before_recipe: str | None, embed: Callable | None, healthy: Callable[[], bool] | None, report: dict) -> DataFrame:
    """Vectors of a run: reused where text and recipe are the same. If the embedder is not well, what there was is carried for the keys that are left, under the same recipe alone, and the report says 'partial'."""
    old = before.get("vectors") if before else None
    if old is None or embed is None or healthy is None or healthy():
        return embedded(nodes, old, recipe, before_recipe if before_recipe is not None else "", embed)
    now = embedded(nodes, None, recipe, "", None)
    kept = incremental.carry(old, now.select("key"), recipe, before_recipe if before_recipe is not None else "")
    current = incremental.content_current(now.where("content_hash is not null").select("repo", "key", "content_hash"), kept)
    report |= {"embedding": "partial", "stale_shards": sorted(r["repo"] for r in current.where("not current").collect()), "missing_shards": sorted(r["repo"] for r in incremental.missing_shards(now, kept).collect())}
    return kept.select("repo", "key", "content_hash", "vec")


def build(spark: SparkSession, root: str, graphs: dict[str, Graph], sources: DataFrame | None = None, embed: Callable | None = None, model: str = "none", manual: object = None, before: dict[str, DataFrame] | None = None, dry_run: bool = False, stale: list[str] | None = None, before_manifest: dict | None = None, states: DataFrame | None = None, stale_files: DataFrame | None = None, healthy: Callable[[], bool] | None = None, label: Callable | None = None) -> dict:
    """Unites, strips, clusters, names, embeds, relates, indexes, checks and publishes; returns the report.

    sources: files (repo, path, content, modified). before and before_manifest: the generation before; vectors are reused
    only if its manifest names the same model. states: blocking, unrefreshed, in_grace for each repo. stale_files: (repo,
    source_file) that changed since their text was read. A failed check or gate publishes nothing.
    """
    started = datetime.now(UTC).isoformat()
    report: dict = {"status": "published", "started_at": started, "embedding": "done"}
    if states is not None and (shares := incremental.gate(states).first())["refused"]:
        return {**report, "status": "refused", "errors": {"gate": [f"{c}: {shares[c]:.2f}" for c in ("blocking_share", "unrefreshed_share")]}}
    g = G.union(graphs)
    g = Graph(g.nodes, G.strip_cross_repo(g.edges))
    old_names = before.get("names") if before else None
    g, provisional = named(Graph(G.cut(g.nodes), G.cut(g.edges)), old_names, label)
    g = Graph(G.cut(g.nodes), g.edges)
    keyed = g.keyed()
    if sources is not None:
        snip = files.snippets(g.nodes, sources).select(F.col("repo").alias("_r"), F.col("source_file").alias("_f"), F.coalesce("line", F.lit(0)).alias("_l"), "snippet", "modified")
        here = (F.col("repo") == F.col("_r")) & (F.col("source_file") == F.col("_f")) & (F.coalesce("line", F.lit(0)) == F.col("_l"))
        nodes = keyed.join(snip, here, "left").drop("_r", "_f", "_l").withColumn("snippet", F.coalesce("snippet", F.lit("")))
    else:
        nodes = keyed.withColumns({"snippet": F.lit(""), "modified": F.lit(None).cast("double")})
    nodes = G.cut(nodes)
    before_model = (before_manifest or {}).get("embedding_model")
    vec = G.cut(shards(nodes, before, model, before_model, embed, healthy, report))
    pairs = G.cut(vector.mutual(vector.candidates(vec.where("vec is not null").select("repo", "key", "vec"))))
    edges = overlay.similar_edges(pairs, model).unionByName(overlay.fallback_edges(overlay.fallback_pairs(nodes.select("key", "repo", "label", "community_name"), vec.where("vec is not null"))))
    if sources is not None:
        repos = spark.createDataFrame([(r, i) for i, r in enumerate(sorted(graphs))], "repo string, repo_ord int")
        edges = edges.unionByName(overlay.api_edges(overlay.api_matches(*facts.api(sources, repos))))
        p = facts.packages(sources)
        dep = overlay.depends_on(p["dependencies"], p["packages"], p["locked"])
        ref = lambda c: F.struct(F.col(c).alias("repo"), F.when(F.col("ecosystem") == "composer", "composer.json").otherwise("package.json").alias("source_file"), F.col("name").alias("qualified_label"))
        edges = edges.unionByName(dep.select(*overlay.edge("depends_on", ref("repo"), ref("target"), F.lit("lockfile"), F.col("confidence"), F.col("name"))))
    if manual is not None:
        refs = nodes.where("key is not null").select("repo", "source_file", "label", F.col("label").alias("bare"))
        edges = edges.unionByName(overlay.manual_edges(facts.manual(spark, manual), refs))
    edges = G.cut(edges)
    index = lexical.build(nodes.select("id", "repo", "label", "source_file", "snippet", "ord"), G.config_paths(g))
    counts = (g.nodes.count(), g.edges.count())
    previous = (before["nodes"].count(), before["edges"].count()) if before else None
    if errors := validate.check_all(g, previous):
        return {**report, "status": "refused", "errors": errors}
    report |= {"nodes": counts[0], "edges": counts[1], "overlay": {r["type"]: r["n_edges"] for r in overlay.counts(edges).collect()}}
    if dry_run:
        return {**report, "status": "dry_run"}
    out = publish.output_hash(g)
    name = publish.generation_id(out)
    ids = incremental.id_map(before["id_map"], nodes.where("key is not null").select("key"), name, F.lit(started)) if before and "id_map" in before else nodes.where("key is not null").select("key").distinct().select("key", F.lit("active").alias("status"), F.lit(name).alias("generation_id"), F.lit(None).cast("string").alias("tombstoned_at"))
    members = g.nodes.where("community is not null").select(F.col("community").alias("group"), "id", F.col("community_name").alias("name"))
    names = members.join(G.signatures(members.select("group", "id")), "group").join(provisional, "group")
    stale_keys = lexical.stale_keys(g.nodes, stale_files) if stale_files is not None else spark.createDataFrame([], "key string")
    tables = {"nodes": g.nodes, "edges": g.edges, "overlay": edges, "vectors": vec, "id_map": ids, "names": names, "stale": stale_keys, "cards": cards(g), "snippets": nodes.where("key is not null").select("key", "snippet", "modified"), **index}
    manifest = {
        "created_at": started, "sync_started_at": started, "repo_input_hashes": {r["owner"]: r["fingerprint"] for r in G.repo_fingerprints(g).collect()}, "registry_hash": "", "config_hash": hashlib.sha256(json.dumps([model]).encode()).hexdigest(),
        "output_node_count": counts[0], "output_edge_count": counts[1], "output_hash": out, "clustering_backend": "louvain", "embedding_model": model, "embeddings_generation": name, "labeling": "labeler" if label else "hub", "stale_repos": sorted(stale or []),
    }
    publish.write(root, name, tables, manifest)
    publish.flip(root, name)
    report |= {"generation_id": name, "pruned": publish.prune(root)}
    return report


def load(spark: SparkSession, root: str, verify: bool = False):
    """The current generation, for the query tools. Vectors that bear another generation's name are left out, with a marker; those that bear none are served with one."""
    t, m = publish.read(spark, root, verify=verify)
    stamp, marks = m.get("embeddings_generation"), []
    if stamp is None:
        marks = ["embeddings_generation_unverified"]
    elif stamp != m["generation_id"]:
        marks = ["embeddings_generation_mismatch"]
    vectors = t["vectors"].where("vec is not null") if stamp in (None, m["generation_id"]) else None
    return Generation(Graph(t["nodes"], t["edges"]), {k: t[k] for k in ("documents", "postings", "aliases")}, t["overlay"], vectors, t.get("stale"), m, t["snippets"], marks, t.get("cards"))
