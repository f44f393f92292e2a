"""The driver's tables as graphs, lexical documents and vectors, so that every operator meets real rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions as repos; regions, nations, customers, suppliers and orders as keyed nodes, parts as stubs without a file; their relations as edges."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", F.col("r_name").alias("repo"))
    cust = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    supp = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    gid = lambda repo, kind, k: F.concat(repo, F.lit(f"::{kind}:"), k.cast("string"))
    none = lambda kind: F.lit(None).cast(kind)

    def node(df: DataFrame, kind: str, key: str, label, file, community=None) -> DataFrame:
        repo = F.col("repo")
        return df.select(gid(repo, kind, F.col(key)).alias("id"), repo, label.alias("label"), file.alias("source_file"), (F.col(key) % 1000 + 1).cast("int").alias("line"), (community if community is not None else none("string")).alias("community_name"), F.lit(kind).alias("kind"))

    who = cust.select("c_custkey", "repo")
    orders = t("orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    stub = t("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), none("string").alias("repo"), F.col("p_name").alias("label"), none("string").alias("source_file"), none("int").alias("line"), none("string").alias("community_name"), F.lit("part").alias("kind"))
    regions = t("region").withColumn("repo", F.col("r_name"))
    nodes = node(regions, "region", "r_regionkey", F.col("r_name"), F.lit("region/regions.tbl"))
    nodes = nodes.unionByName(node(place, "nation", "n_nationkey", F.col("n_name"), F.lit("nation/nations.tbl")))
    nodes = nodes.unionByName(node(cust, "customer", "c_custkey", F.col("c_name"), F.concat(F.lit("customer/"), "c_mktsegment", F.lit(".tbl")), F.col("c_mktsegment")))
    nodes = nodes.unionByName(node(supp, "supplier", "s_suppkey", F.col("s_name"), F.when(F.col("s_suppkey") % 5 == 0, "supplier/tests/suppliers.tbl").when(F.col("s_suppkey") % 7 == 0, "supplier/DEPRECATED/suppliers.tbl").otherwise("supplier/suppliers.tbl")))
    nodes = nodes.unionByName(node(orders, "order", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), F.concat(F.lit("orders/"), "o_orderpriority", F.lit(".tbl")), F.col("o_orderpriority")))
    nodes = nodes.unionByName(stub)

    def edge(df: DataFrame, a, b, relation: str, confidence=None, score=None) -> DataFrame:
        return df.select(a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"), (confidence if confidence is not None else F.lit("EXTRACTED")).alias("confidence"), (score if score is not None else none("double")).alias("confidence_score"))

    repo = F.col("repo")
    nat = gid(repo, "nation", F.col("n_nationkey"))
    edges = edge(cust, gid(repo, "customer", F.col("c_custkey")), nat, "located_in").unionByName(edge(supp, gid(repo, "supplier", F.col("s_suppkey")), nat, "located_in"))
    edges = edges.unionByName(edge(place, nat, gid(repo, "region", F.col("n_regionkey")), "part_of"))
    order = gid(repo, "order", F.col("o_orderkey"))
    edges = edges.unionByName(edge(orders, order, gid(repo, "customer", F.col("c_custkey")), "placed_by"))
    how = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "A", "INFERRED").otherwise("AMBIGUOUS")
    lines = t("lineitem").join(orders.select("o_orderkey", "repo"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edges.unionByName(edge(lines, order, F.concat(F.lit("part:"), F.col("l_partkey").cast("string")), "contains", how, F.col("l_discount") * 10))
    by = lines.join(supp.select("s_suppkey", F.col("repo").alias("s_repo")), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = edges.unionByName(edge(by, order, gid(F.col("s_repo"), "supplier", F.col("s_suppkey")), "supplied_by", how, F.col("l_discount") * 10))
    edges = edges.withColumns({"also_seen": F.lit(0), "resolver": none("string"), "context": none("string"), "cross_repo": F.lit(False)})
    nodes = nodes.withColumns({"norm_label": none("string"), "community": none("int"), "origin": none("string")})
    return Graph(nodes, edges)


#: The same graph in SQL, for the oracles: tables nodes and edges.
TRADE_SQL = """
place as (select n_nationkey, n_name, n_regionkey, r_name as repo from nation join region on n_regionkey = r_regionkey),
cust as (select * from customer join place on c_nationkey = n_nationkey),
supp as (select * from supplier join place on s_nationkey = n_nationkey),
ords as (select o.*, c.repo from orders o join cust c on o_custkey = c_custkey),
nodes as (
  select r_name || '::region:' || r_regionkey as id, r_name as repo, r_name as label, 'region/regions.tbl' as source_file, null as community_name, 'region' as kind from region
  union all select repo || '::nation:' || n_nationkey, repo, n_name, 'nation/nations.tbl', null, 'nation' from place
  union all select repo || '::customer:' || c_custkey, repo, c_name, 'customer/' || c_mktsegment || '.tbl', c_mktsegment, 'customer' from cust
  union all select repo || '::supplier:' || s_suppkey, repo, s_name, case when s_suppkey % 5 = 0 then 'supplier/tests/suppliers.tbl' when s_suppkey % 7 = 0 then 'supplier/DEPRECATED/suppliers.tbl' else 'supplier/suppliers.tbl' end, null, 'supplier' from supp
  union all select repo || '::order:' || o_orderkey, repo, 'Order#' || o_orderkey, 'orders/' || o_orderpriority || '.tbl', o_orderpriority, 'order' from ords
  union all select 'part:' || p_partkey, null, p_name, null, null, 'part' from part
),
keyed as (select *, case when source_file is not null then repo || chr(31) || source_file || chr(31) || label end as key from nodes),
items as (
  select l.*, o.repo, case l_returnflag when 'N' then 'EXTRACTED' when 'A' then 'INFERRED' else 'AMBIGUOUS' end as how
  from lineitem l join ords o on l_orderkey = o_orderkey
),
edges as (
  select repo || '::customer:' || c_custkey as source, repo || '::nation:' || n_nationkey as target, 'located_in' as relation, 'EXTRACTED' as confidence, cast(null as double) as confidence_score from cust
  union all select repo || '::supplier:' || s_suppkey, repo || '::nation:' || n_nationkey, 'located_in', 'EXTRACTED', null from supp
  union all select repo || '::nation:' || n_nationkey, repo || '::region:' || n_regionkey, 'part_of', 'EXTRACTED', null from place
  union all select repo || '::order:' || o_orderkey, repo || '::customer:' || o_custkey, 'placed_by', 'EXTRACTED', null from ords
  union all select repo || '::order:' || l_orderkey, 'part:' || l_partkey, 'contains', how, l_discount * 10 from items
  union all select i.repo || '::order:' || l_orderkey, s.repo || '::supplier:' || s_suppkey, 'supplied_by', how, l_discount * 10 from items i join supp s on l_suppkey = s_suppkey
)
"""


def lexical_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lexical nodes: id, repo, label (the first line), source_file (source and lang), snippet (the text)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("repo"), F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 80).alias("label"), F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("source_file"), F.coalesce("text", F.lit("")).alias("snippet"), F.col("doc_id").alias("ord"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors: repo (by label), key, vec."""
    e = table(spark, sf_dir, "embeddings")
    ext = F.when(F.col("vec_id") % 3 == 0, ".ts").when(F.col("vec_id") % 3 == 1, ".tsx").otherwise(".py")
    repo = F.concat(F.lit("r"), (F.col("label") % 5).cast("string"))
    return e.select(repo.alias("repo"), F.concat_ws("\x1f", repo, F.concat(F.lit("src/f"), (F.col("vec_id") % 40).cast("string"), ext), F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("key"), F.col("embedding").alias("vec"))
