"""Graph transforms: union, strips, adjacency, degree, traversal, configuration paths, ownership, signatures."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import is_config_file, is_file_label, repo_prefix
from ..model import EXTRACTED, MAX_TRAVERSED, Graph


def _folder(df: DataFrame) -> str:
    """The folder of checkpoints, set where it is not."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/tessera-{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that executors share (a temporary one where none is set, as in tests)."""
    _folder(df)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder of checkpoints, where many rows are read more than once: columns take a fraction of what a checkpoint's rows do."""
    path = f"{_folder(df)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union(graphs: dict[str, Graph]) -> Graph:
    """Graphs by repo as one: repo is set, ids get the prefix 'repo::', endpoints follow. Order: repos by name, then rows as they came."""
    nodes, edges = [], []
    for repo in sorted(graphs):
        g, p = graphs[repo], F.lit(f"{repo}::")
        nodes.append(g.nodes.withColumns({"repo": F.lit(repo), "id": F.concat(p, "id")}))
        edges.append(g.edges.withColumns({"source": F.concat(p, "source"), "target": F.concat(p, "target")}))
    join = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return Graph(join(nodes), join(edges))


def rename_repos(g: Graph, names: DataFrame) -> Graph:
    """Repo tags (tag, repo) of ids, endpoints and the repo column replaced; endpoints only where their node was renamed."""
    names = names.select(F.col("tag").alias("_tag"), F.col("repo").alias("_repo"))

    def new(c: str) -> Column:
        return F.when(F.col("_repo").isNotNull(), F.concat(F.col("_repo"), F.expr(f"substring({c}, length(_tag) + 1)"))).otherwise(F.col(c))

    nodes = g.nodes.join(names, repo_prefix(F.col("id")) == F.col("_tag"), "left").withColumn("_new", new("id"))
    moved = nodes.where("_repo is not null").select(F.col("id").alias("_old"), "_new").distinct()
    edges = g.edges
    for c in ("source", "target"):
        edges = edges.join(moved, edges[c] == moved["_old"], "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return Graph(nodes.withColumns({"id": F.col("_new"), "repo": F.coalesce("_repo", "repo")}).drop("_tag", "_repo", "_new"), edges)


def is_cross_repo(source: Column, target: Column, context: Column) -> Column:
    """Two prefixes that differ, or a context that says so; an endpoint without a prefix is not enough."""
    a, b = repo_prefix(source), repo_prefix(target)
    return F.coalesce(context == "cross_repo", F.lit(False)) | F.coalesce(a != b, F.lit(False))


def strip_cross_repo(edges: DataFrame) -> DataFrame:
    return edges.where(~is_cross_repo(F.col("source"), F.col("target"), F.col("context")))


def strip_communities(nodes: DataFrame) -> DataFrame:
    return nodes.drop("community", "community_name")


def adjacency(edges: DataFrame, *more: str) -> DataFrame:
    """(u, v, dir, ...): each edge from both ends; a loop gives two rows."""
    keep = [c for c in more if c in edges.columns]
    return edges.select(F.explode(F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v"), F.lit("out").alias("dir")), F.struct(F.col("target").alias("u"), F.col("source").alias("v"), F.lit("in").alias("dir")))).alias("_x"), *keep).select("_x.*", *keep)


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): parallel edges each count, a loop twice, and edges to unknown nodes too. Counts are made before the shuffle."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def finite(score: Column) -> Column:
    return F.when(score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")), score)


def followable(inferred: bool = False, floor: float | None = None) -> Column:
    """Extracted edges always; others only if asked for and, with a floor, with a finite score that reaches it."""
    own = F.coalesce("confidence", F.lit(EXTRACTED)) == EXTRACTED
    if not inferred:
        return own
    if floor is None:
        return F.lit(True)
    return own | F.coalesce(finite(F.col("confidence_score")) >= floor, F.lit(False))


def traverse(g: Graph, seeds: list[str], repo: str, relations: list[str], direction: str = "both", depth: int = 1, inferred: bool = False, floor: float | None = None, most: int = MAX_TRAVERSED) -> tuple[DataFrame, dict]:
    """Breadth first from seed ids inside one repo: (id, key, depth, via) and what is known about the walk.

    Each level is a join of the frontier with the edges that may be followed; at most `most` nodes are ever visited, so
    the frontier is small and is broadcast. via holds all edges from the level before, parallel ones merged to their
    largest score and largest number of other sightings.
    """
    spark = g.nodes.sparkSession
    nodes = g.keyed().where(F.col("repo") == repo).select("id", "key")
    adj = adjacency(g.edges.where(F.col("relation").isin(relations)).where(followable(inferred, floor)), "relation", "confidence", "confidence_score", "also_seen", "resolver")
    if direction != "both":
        adj = adj.where(F.col("dir") == direction)
    known = {r["id"]: r["key"] for r in nodes.where(F.col("id").isin(seeds)).where("key is not null").collect()}  # seeds
    order = sorted(known, key=lambda i: (known[i], i))
    state = {"truncated": len(order) > most, "frontier_exhausted": False, "resolvers": set(), "skipped_unkeyed": 0, "seeds": order[:most]}
    visited, unkeyed, rows = dict((i, known[i]) for i in order[:most]), None, []
    frontier = list(visited)
    for level in range(1, depth + 1):
        if state["truncated"]:
            break
        front = spark.createDataFrame([(i, visited[i]) for i in frontier], "u string, from_key string")
        step = adj.join(F.broadcast(front), "u").join(nodes, F.col("v") == nodes["id"]).drop("id")
        step = step.join(F.broadcast(spark.createDataFrame([(i,) for i in visited], "v string")), "v", "left_anti")
        bare = cut(step.where("key is null").select("v").distinct())  # stays on the executors, however many there are
        unkeyed = bare if unkeyed is None else unkeyed.union(bare)
        via = step.where("key is not null").groupBy("v", "key", "from_key", "relation", F.coalesce("confidence", F.lit(EXTRACTED)).alias("confidence"))
        via = via.agg(F.max(finite(F.col("confidence_score"))).alias("score"), F.max(F.coalesce("also_seen", F.lit(0))).alias("seen"), F.collect_set("resolver").alias("resolvers"))
        reached = via.groupBy("v", "key").agg(F.sort_array(F.collect_list(F.struct("from_key", "relation", "confidence", "score", "seen"))).alias("via"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("relation").isin("calls", "indirect_call"), F.col("resolvers")).otherwise(F.array().cast("array<string>"))))).alias("resolvers"))
        room = most - len(visited)
        got = reached.orderBy("key", "v").limit(room + 1).collect()
        if not got:
            state["frontier_exhausted"] = True
            break
        state["truncated"], got = len(got) > room, got[:room]
        for r in got:
            visited[r["v"]] = r["key"]
            state["resolvers"] |= set(r["resolvers"])
            rows.append((r["v"], r["key"], level, [tuple(x) for x in r["via"]]))
        frontier = [r["v"] for r in got]
    state["skipped_unkeyed"] = unkeyed.distinct().count() if unkeyed is not None else 0
    return spark.createDataFrame(rows, "id string, key string, depth int, via array<struct<from_key:string,relation:string,confidence:string,score:double,seen:int>>"), state


def levels(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(id, depth) of all nodes within depth hops of seeds (id), at any size: the frontier is joined, not collected, and each level is checkpointed."""
    adj = adjacency(edges)
    if direction != "both":
        adj = adj.where(F.col("dir") == direction)
    seen = cut(seeds.select("id", F.lit(0).alias("depth")).distinct())
    front = seen
    for level in range(1, depth + 1):
        front = cut(adj.join(front.select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reach(g: Graph, seeds: list[str], repo: str, relations: list[str], direction: str = "both", depth: int = 1, inferred: bool = False, floor: float | None = None) -> DataFrame:
    """(key, depth) of all that traverse() would visit were it not limited: keyed nodes of one repo, at any size, on the executors."""
    nodes = g.keyed().where((F.col("repo") == repo) & F.col("key").isNotNull()).select("id", "key")
    e = g.edges.where(F.col("relation").isin(relations)).where(followable(inferred, floor)).select("source", "target")
    for end in ("source", "target"):
        e = e.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    start = nodes.where(F.col("id").isin(seeds)).select("id")
    found = levels(cut(e.distinct()), start, depth, direction).where("depth > 0")
    return found.join(nodes, "id").groupBy("key").agg(F.min("depth").alias("depth"))


def owners(g: Graph) -> DataFrame:
    """(id, owner): a node's repo; one without takes the least owner among its neighbours, in rounds until nothing changes; the rest get ''."""
    own = cut(g.nodes.select("id", F.nullif("repo", F.lit("")).alias("owner")))
    adj = adjacency(g.edges).where("u <> v").select("u", "v").distinct()
    left = own.where("owner is null").count()
    while left:
        near = adj.join(own.where("owner is not null"), adj["v"] == own["id"]).groupBy("u").agg(F.min("owner").alias("_near"))
        own = cut(own.join(near, own["id"] == near["u"], "left").select("id", F.coalesce("owner", "_near").alias("owner")))
        now = own.where("owner is null").count()
        if now == left:
            break
        left = now
    return own.select("id", F.coalesce("owner", F.lit("")).alias("owner"))


def config_parents(g: Graph) -> DataFrame:
    """(id, label, p_id, p_label, p_file): the one parent of each key of a YAML or JSON file.

    Of those in its file the one with the greatest line not after its own, then the greatest line, then the least label
    and id. p_file: the parent is the file itself.
    """
    n = g.nodes.where(is_config_file(F.col("source_file")) & ~(F.coalesce("origin", F.lit("")) == "semantic")).select("id", "repo", "source_file", "label", F.coalesce("line", F.lit(0)).alias("line"), is_file_label(F.col("label"), F.col("source_file")).alias("file"))
    p = n.select(*[F.col(c).alias(f"p_{c}") for c in n.columns])
    e = g.edges.where("relation = 'contains' and source <> target").select("source", "target").distinct()
    pairs = e.join(n, e["target"] == n["id"]).join(p, (e["source"] == p["p_id"]) & (F.col("source_file") == F.col("p_source_file")) & F.col("repo").eqNullSafe(F.col("p_repo")))
    rank = W.partitionBy("id").orderBy((F.col("p_line") <= F.col("line")).desc(), F.col("p_line").desc(), "p_label", "p_id")
    return pairs.where("not file").withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("id", "label", "p_id", "p_label", "p_file")


def config_paths(g: Graph) -> DataFrame:
    """(id, path): the dotted path of each key of a YAML or JSON file, from the file's own node down by 'contains' edges.

    Paths double in length each round, so a key at any depth is done after the logarithm of it; every depth has keys,
    so a round that ends none leaves only keys in cycles, or below one, or without a file, which have no path. Nor has
    the file itself.
    """
    parent = config_parents(g)
    left = cut(parent.select("id", F.col("label").alias("path"), F.when(~F.col("p_file"), F.col("p_id")).alias("at")))
    done = left.where("at is null").select("id", "path")
    left = left.where("at is not null")
    while not left.isEmpty():
        up = done.select(F.col("id").alias("u"), F.col("path").alias("head"), F.lit(None).cast("string").alias("next")).unionByName(left.select(F.col("id").alias("u"), F.col("path").alias("head"), F.col("at").alias("next")))
        step = cut(left.join(up, F.col("at") == F.col("u")).select("id", F.concat("head", F.lit("."), "path").alias("path"), F.col("next").alias("at")))
        ended = step.where("at is null").select("id", "path")
        if ended.isEmpty():
            break
        done, left = done.unionByName(ended), step.where("at is not null")
    return done


def fold(df: DataFrame, *by: str) -> DataFrame:
    """(by..., n, digest): one digest of all rows, whatever their order, of each group: SHA-256 of four sums of 60 bits of the rows' own digests.

    A row's digest is that of its JSON with columns in name order; sums are made before the shuffle.
    """
    own = sorted(set(df.columns) - set(by))
    row = F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"_s{k}") for k in range(4)]
    f = df.groupBy(*by).agg(F.count("*").alias("n"), *sums) if by else df.agg(F.count("*").alias("n"), *sums)
    return f.select(*by, "n", F.sha2(F.concat_ws("/", F.col("n").cast("string"), *[F.coalesce(F.col(f"_s{k}"), F.lit(0).cast("decimal(38,0)")).cast("string") for k in range(4)]), 256).alias("digest"))


def repo_fingerprints(g: Graph) -> DataFrame:
    """(owner, fingerprint): a digest of each repo's nodes, communities aside, and of the edges inside it: all that its clustering and naming read."""
    own = owners(g)
    nodes = strip_communities(g.nodes).join(own, "id")
    a, b = own.select(F.col("id").alias("source"), F.col("owner").alias("owner")), own.select(F.col("id").alias("target"), F.col("owner").alias("_b"))
    edges = g.edges.join(a, "source").join(b, "target").where("owner = _b").drop("_b")
    n, e = fold(nodes, "owner").select("owner", F.col("digest").alias("_n")), fold(edges, "owner").select("owner", F.col("digest").alias("_e"))
    return n.join(e, "owner", "left").select("owner", F.sha2(F.concat_ws("/", "_n", F.coalesce("_e", F.lit(""))), 256).alias("fingerprint"))


def representatives(nodes: DataFrame) -> DataFrame:
    """nodes (key, line, id, ...), one for each key: the first line, nulls last, then the least id."""
    one = F.row_number().over(W.partitionBy("key").orderBy(F.col("line").asc_nulls_last(), "id"))
    return nodes.where("key is not null").withColumn("_r", one).where("_r = 1").drop("_r")


def signatures(members: DataFrame) -> DataFrame:
    """(group, signature): a hash of each group's sorted member ids; members: group, id."""
    return members.groupBy("group").agg(F.substring(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_set("id")), lambda x: F.concat(x, F.lit("\0")))), 256), 1, 16).alias("signature"))


def same_structure(before: Graph, after: Graph) -> bool:
    """Nothing but community columns differs, multiplicity included; a node id that is there twice is an error."""
    if not after.nodes.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("a node id is there twice")
    drop = lambda df: df.select(*sorted(set(df.columns) - {"community", "community_name"}))
    pairs = ((drop(before.nodes), drop(after.nodes)), (drop(before.edges), drop(after.edges)))
    return all(a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in pairs)


def project_map(g: Graph, repo: str, hubs: int, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Communities (community_name, n_nodes) of at least `least` nodes and hubs (key, degree, is_hub), largest first, `hubs` and `most` of them."""
    n = g.keyed().where(F.col("repo") == repo)
    c = n.groupBy(F.coalesce(F.nullif("community_name", F.lit("")), F.lit("unassigned")).alias("community_name")).agg(F.count("*").alias("n_nodes"))
    c = c.where(F.col("n_nodes") >= least).orderBy(F.col("n_nodes").desc(), "community_name").limit(most)
    d = n.where("key is not null").join(degree(g.edges), "id", "left").select("key", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
    h = d.withColumn("is_hub", F.col("degree") > 50).orderBy(F.col("degree").desc(), "key").limit(hubs)
    return c, h
