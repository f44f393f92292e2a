"""More queries over the driver's tables, for operators of names, files, facts, routes, naming, runs and tools, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..model import SEP, Graph
from ..operators import community, graph, incremental, lexical, overlay, ranking, routes, validate
from ..sources import facts, files, nodelink, publish, registry, testdata as T
from .catalog import _COPIES, _SCORED, _answers, _copies, Q, query
from .tools import Generation, Tools, instructed

def _named(c: DataFrame, prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), c[key].cast("string"))


def _shared(spark: SparkSession, name: str) -> str:
    """A folder of its own where executors share files."""
    graph.cut(spark.range(1))  # sees to it that there is such a folder
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


# -- names and paths -------------------------------------------------------------

_PATHS = "with x as (select p_partkey as k, case p_partkey % 6 when 0 then '/r/src/f' || p_partkey || '.php' when 1 then '../up' || p_partkey when 2 then 'a/../b/./c' || p_partkey when 3 then 'C:' || chr(92) || p_partkey when 4 then '/etc/' || p_partkey else 'x//y' || p_partkey end as path from part)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    n, kind = F.col("k").cast("string"), F.col("k") % 6
    path = F.when(kind == 0, F.concat(F.lit("/r/src/f"), n, F.lit(".php"))).when(kind == 1, F.concat(F.lit("../up"), n)).when(kind == 2, F.concat(F.lit("a/../b/./c"), n)).when(kind == 3, F.concat(F.lit("C:\\"), n)).when(kind == 4, F.concat(F.lit("/etc/"), n)).otherwise(F.concat(F.lit("x//y"), n))
    return p.select("k", path.alias("path"))


@query(_PATHS + " select k, case k % 6 when 0 then 'src/f' || k || '.php' when 2 then 'b/c' || k when 5 then 'x/y' || k else '' end as inside, k % 6 in (1, 3, 4) as withheld, k % 6 in (0, 3, 4) as host from x")
def repo_paths(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    inside, withheld = routes.path_in_repo(F.col("path"), "/r")
    return p.select("k", inside.alias("inside"), withheld.alias("withheld"), routes.is_host_path(F.col("path")).alias("host"))


@query("select s_suppkey as k, s_suppkey % 2 = 0 and s_suppkey % 3 < 2 as trivial, s_suppkey % 2 = 0 as accessor from supplier")
def trivial_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = T.table(spark, d, "supplier")
    label = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("getName"), F.col("s_suppkey").cast("string"))).otherwise(F.lit("getter"))
    snippet = F.when(F.col("s_suppkey") % 3 == 0, "one\n\n  \n").when(F.col("s_suppkey") % 3 == 1, "one\ntwo").otherwise("one\ntwo\n\nthree")
    return s.select(F.col("s_suppkey").alias("k"), X.is_trivial(label, snippet).alias("trivial"), X.is_trivial(label, F.lit("")).alias("accessor"))


@query("select p_partkey as k, p_partkey % 3 < 2 as config, p_partkey % 2 = 0 as is_file from part")
def file_nodes(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part").withColumn("n", F.col("p_partkey").cast("string"))
    file = F.concat(F.lit("conf/"), "n", F.when(F.col("p_partkey") % 3 == 0, ".YAML").when(F.col("p_partkey") % 3 == 1, ".json").otherwise(".py"))
    label = F.when(F.col("p_partkey") % 2 == 0, F.element_at(F.split(file, "/"), -1)).otherwise(F.concat(F.lit("x"), F.element_at(F.split(file, "/"), -1)))
    return p.select(F.col("p_partkey").alias("k"), X.is_config_file(file).alias("config"), X.is_file_label(label, file).alias("is_file"))


@query("select p_partkey as k, case p_partkey % 3 when 0 then '[' || p_brand || ':src/a.py:' || p_size || ']' when 1 then '[' || p_brand || ':src/a.py:7]' else '[' || p_brand || ':src/a.py:?]' end as citation, lower(trim(p_name)) as norm from part")
def citations(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    line = X.node_line(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")), F.when(F.col("p_partkey") % 3 == 1, "L7").otherwise("seven"))
    return p.select(F.col("p_partkey").alias("k"), X.citation(F.col("p_brand"), F.lit("src/a.py"), line).alias("citation"), X.norm_label(F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("\n"))).alias("norm"))


@query("select p_partkey as k, unnest(list_distinct(['app' || chr(92) || 'x' || p_partkey || '::run', 'app' || chr(92) || 'x' || p_partkey, 'run', 'x' || p_partkey || '::run', 'f' || p_partkey || '.php'])) as alias from part")
def alias_names(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part").withColumn("n", F.col("p_partkey").cast("string"))
    label = F.concat(F.lit("App\\X"), "n", F.lit("::Run"))
    return p.select(F.col("p_partkey").alias("k"), F.explode(X.alias_forms(label, F.concat(F.lit("src/F"), "n", F.lit(".php")), F.lit(True))).alias("alias"))


@query("select p_partkey as k, 'label: ' || p_name || chr(10) || 'path: src/' || p_brand || chr(10) || 'snippet:' || chr(10) || p_type as embedding_text, substr(sha256('label: ' || p_name || chr(10) || 'path: src/' || p_brand || chr(10) || 'snippet:' || chr(10) || p_type), 1, 16) as hash from part")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    text = X.embedding_text(F.col("p_name"), F.concat(F.lit("src/"), "p_brand"), F.col("p_type"))
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.alias("embedding_text"), X.content_hash(text).alias("hash"))


_TEST_WORD = "^(tests?|testing|testcases?|pytest|unittest|specs?|fixtures?|phpunit|jest|cypress|e2e|mock\\w*|stor(y|ies)|storybook)$"


@query(f"with q as (select c_custkey as k, c_name || case c_custkey % 5 when 0 then ' UserServiceTest' when 1 then ' latest contest' when 2 then ' mockFoo' when 3 then ' Specs!' else '' end as q from customer) select k, bool_or(regexp_matches(lower(w), '{_TEST_WORD}')) as asks from (select k, unnest(regexp_split_to_array(regexp_replace(q, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+')) as w from q) group by 1")
def queries_for_tests(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    more = F.element_at(F.array(*map(F.lit, [" UserServiceTest", " latest contest", " mockFoo", " Specs!", ""])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("k"), ranking.test_queries(F.concat("c_name", more)).alias("asks"))


@query("select trim(regexp_replace(translate(url, '_/' || chr(92) || '.-', '     '), ' +', ' ', 'g')) as name, page_id from pages")
def orphan_names(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "pages").select("page_id", community.orphan_name(F.concat(F.lit("ref_"), "url")).alias("name"))


# -- graphs ------------------------------------------------------------------------


@query("select 'a::c' || c_custkey as id, 'a' as repo, c_name as label from customer union all select 'b::s' || s_suppkey, 'b', s_name from supplier")
def merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.union(_two(spark, d)).nodes.select("id", "repo", "label")


@query("select 'a::c' || c_custkey as source, 'a::n' || c_nationkey as target from customer union all select 'b::s' || s_suppkey, 'b::n' || s_nationkey from supplier")
def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.union(_two(spark, d)).edges.select("source", "target")


def _two(spark: SparkSession, d: str) -> dict[str, Graph]:
    c, s = T.table(spark, d, "customer"), T.table(spark, d, "supplier")
    g = lambda t, p, k, n, nk: Graph(t.select(_named(t, p, k).alias("id"), t[n].alias("label"), F.lit("f").alias("source_file")), t.select(_named(t, p, k).alias("source"), _named(t, "n", nk).alias("target")))
    return {"b": g(s, "s", "s_suppkey", "s_name", "s_nationkey"), "a": g(c, "c", "c_custkey", "c_name", "c_nationkey")}


_RENAMED = "case when starts_with({0}, 'ASIA::') then 'APAC' || substr({0}, 5) when starts_with({0}, 'EUROPE::') then 'EU' || substr({0}, 7) else {0} end"


def _renamed(spark: SparkSession, d: str) -> Graph:
    return graph.rename_repos(T.trade(spark, d), spark.createDataFrame([("ASIA", "APAC"), ("EUROPE", "EU")], "tag string, repo string"))


@query(f"select {_RENAMED.format('id')} as id, case repo when 'ASIA' then 'APAC' when 'EUROPE' then 'EU' else repo end as repo from nodes", True)
def renamed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _renamed(spark, d).nodes.select("id", "repo")


@query(f"select {_RENAMED.format('source')} as source, {_RENAMED.format('target')} as target, cast(count(*) as bigint) as n from edges group by 1, 2", True)
def renamed_edges(spark: SparkSession, d: str) -> DataFrame:
    return _renamed(spark, d).edges.groupBy("source", "target").agg(F.count("*").alias("n"))


@query("select id, repo, label, source_file from nodes", True)
def stripped_communities(spark: SparkSession, d: str) -> DataFrame:
    n = graph.strip_communities(T.trade(spark, d).nodes)
    assert not {"community", "community_name"} & set(n.columns)
    return n.select("id", "repo", "label", "source_file")


@query("select repo || '::nation:' || n_nationkey as id, n_name as path from place union all select repo || '::customer:' || c_custkey, n_name || '.' || c_name from cust", True)
def config_key_paths(spark: SparkSession, d: str) -> DataFrame:
    """Regions as files, nations as keys under them, customers as keys under nations."""
    g = T.trade(spark, d)
    n = g.nodes.where("kind in ('region', 'nation', 'customer')").withColumn("source_file", F.concat(F.lit("conf/"), "repo", F.lit(".yaml"))).withColumn("label", F.when(F.col("kind") == "region", F.concat("repo", F.lit(".yaml"))).otherwise(F.col("label")))
    e = g.edges.where("relation in ('part_of', 'located_in')").select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("contains").alias("relation"))
    return graph.config_paths(Graph(n, e))


@query("with p as (select c.c_custkey, n.n_nationkey, row_number() over (partition by c_custkey order by (n_nationkey <= c_custkey % 40) desc, n_nationkey desc) as r from customer c join nation n on n.n_regionkey = c.c_custkey % 5) select 'c' || c_custkey as id, 'n' || n_nationkey as p_id from p where r = 1")
def config_parent_choice(spark: SparkSession, d: str) -> DataFrame:
    """Each customer as a key that every nation of a region contains: the last nation not after it is its parent."""
    c, n = T.table(spark, d, "customer"), T.table(spark, d, "nation")
    node = lambda t, p, k, line: t.select(_named(t, p, k).alias("id"), F.lit("r").alias("repo"), F.lit("a.json").alias("source_file"), _named(t, p, k).alias("label"), line.cast("int").alias("line"), F.lit(None).cast("string").alias("origin"))
    e = c.join(n, F.col("n_regionkey") == F.col("c_custkey") % 5).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("target"), F.lit("contains").alias("relation"))
    g = Graph(node(c, "c", "c_custkey", F.col("c_custkey") % 40).unionByName(node(n, "n", "n_nationkey", F.col("n_nationkey"))), e)
    return graph.config_parents(g).select("id", "p_id")


@query("with r as (select n_name, 'r' || n_regionkey as repo, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as l, n_regionkey as k from nation), s as (select k, max(l) + 1 as m from r group by 1) select n_name as id, repo, cast(l + coalesce((select sum(m) from s where s.k < r.k), 0) as integer) as community from r")
def community_offsets(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = T.table(spark, d, "nation")
    local = n.select(F.col("n_name").alias("id"), _named(n, "r", "n_regionkey").alias("repo"), (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("local"))
    return community.offsets(local)


@query("""with now as (select c_nationkey as g, c_custkey as id, 'n' || c_nationkey as sig from customer), bef as (select 100 + (c_nationkey // 2) as g, c_custkey as id, case when c_nationkey < 6 then 'n' || c_nationkey else 'old' end as sig, 'N' || (c_nationkey // 2) as name, c_nationkey // 2 % 5 = 4 as prov from customer where c_acctbal > 0),
same as (select distinct now.g, min(name) over (partition by now.sig) as name from now join bef using (sig) where not prov),
shared as (select now.g, bef.g as old, bef.name, count(distinct now.id) as k from now join bef using (id) where not prov group by 1, 2, 3),
more as (select s.g, s.name from shared s where 2 * k > (select count(distinct id) from now where now.g = s.g) and 2 * k > (select count(distinct id) from bef where bef.g = s.old and not prov) and s.g not in (select g from same))
select g as "group", name from same union all select g, name from more""")
def carried_names(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    pair = F.expr("c_nationkey div 2")
    now = c.select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("id"), _named(c, "n", "c_nationkey").alias("signature"))
    before = c.where("c_acctbal > 0").select((pair + 100).cast("int").alias("group"), F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 6, _named(c, "n", "c_nationkey")).otherwise("old").alias("signature"), F.concat(F.lit("N"), pair.cast("string")).alias("name"), (pair % 5 == 4).alias("provisional"))
    return community.carried_names(now, before)


@query("""with x as (select p_partkey as g, p_name as name, p_type || 'Widgets' as t from part),
own as (select g, unnest(regexp_split_to_array(lower(name), '[^a-z0-9]+')) as w from x),
mem as (select g, unnest(regexp_split_to_array(lower(regexp_replace(t, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) as w from x),
o as (select g, case when w like '%s' and w not like '%ss' and length(w) > 3 then substr(w, 1, length(w) - 1) else w end as w from own where length(w) > 1),
m as (select g, case when w like '%s' and w not like '%ss' and length(w) > 3 then substr(w, 1, length(w) - 1) else w end as w from mem where length(w) > 1)
select g as "group", coalesce(bool_or(o.w = m.w or (length(o.w) >= 4 and contains(m.w, o.w)) or (length(m.w) >= 4 and length(o.w) > length(m.w) and starts_with(o.w, m.w)) or (length(o.w) > 6 and contains(m.w, substr(o.w, 1, 6))) or (length(o.w) >= 6 and length(m.w) > 3 and ends_with(m.w, substr(o.w, 1, 3)))), false) as grounded
from x left join o using (g) left join m using (g) group by 1""")
def grounded_names(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("group"), F.col("p_name").alias("name"), F.array(F.concat("p_type", F.lit("Widgets"))).alias("texts"))
    return community.fits(p).select("group", "grounded")


_FOLD = "sum(('0x' || substr(h, {0}, 15))::BIGINT)::VARCHAR"


@query(f"""with x as (select o_orderpriority as p, sha256('{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') as h from orders)
select p as o_orderpriority, cast(count(*) as bigint) as n, sha256(count(*) || '/' || {_FOLD.format(1)} || '/' || {_FOLD.format(16)} || '/' || {_FOLD.format(31)} || '/' || {_FOLD.format(46)}) as digest from x group by 1""")
def table_digests(spark: SparkSession, d: str) -> DataFrame:
    return graph.fold(T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderpriority")


@query("select relation as type, cast(count(*) as bigint) as n_edges from edges group by 1", True)
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlay.counts(T.trade(spark, d).edges.withColumnRenamed("relation", "type"))


_ASIA_SUPPLIER = "(select min(id) from nodes where repo = 'ASIA' and kind = 'supplier')"


def _around(spark: SparkSession, d: str, most: int = 2000) -> DataFrame:
    g = T.trade(spark, d)
    seed = g.nodes.where("repo = 'ASIA' and kind = 'supplier'").agg(F.min("id")).first()[0]
    return graph.traverse(g, [seed], "ASIA", ["supplied_by"], "in", 1, True, most=most)[0]


@query(f"select k.key, e.confidence, cast(count(distinct e.relation) as bigint) as n, max(e.confidence_score) as score from edges e join keyed k on k.id = e.source where e.relation = 'supplied_by' and e.target = {_ASIA_SUPPLIER} and k.repo = 'ASIA' group by 1, 2", True)
def via_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Lines from a supplier's orders: parallel ones of one confidence are merged to their largest score."""
    v = _around(spark, d).select("key", F.explode("via").alias("v"))
    return v.groupBy("key", "v.confidence").agg(F.count("*").alias("n"), F.max("v.score").alias("score"))


@query(f"select distinct k.key from edges e join keyed k on k.id = e.source where e.relation = 'supplied_by' and e.target = {_ASIA_SUPPLIER} and k.repo = 'ASIA' order by 1 limit 6", True)
def traversal_cap(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, d, 7).select("key")


@query("with r as (select c_custkey % 50 as l, 'r' || (c_custkey % 2) as repo, c_custkey as k, row_number() over (partition by c_custkey % 2, c_custkey % 50 order by case when c_acctbal >= 0 then c_nationkey end nulls last, 'c' || c_custkey) as n from customer) select repo || chr(31) || 'f' || chr(31) || 'L' || l as key, 'c' || k as id from r where n = 1")
def key_representatives(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    key = F.concat_ws(SEP, F.concat(F.lit("r"), (F.col("c_custkey") % 2).cast("string")), F.lit("f"), F.concat(F.lit("L"), (F.col("c_custkey") % 50).cast("string")))
    n = c.select(_named(c, "c", "c_custkey").alias("id"), key.alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("line"))
    return graph.representatives(n).select("key", "id")


# -- ranking and tools -----------------------------------------------------------------


@query("with s as (select s_suppkey as k, s_suppkey % 5 = 0 as t, row_number() over (order by s_acctbal desc, 's' || s_suppkey) - 1 as r from supplier) select 's' || k as key, cast(row_number() over (order by t, r) - 1 as integer) as rank from s where r < 50")
def tests_after_source(spark: SparkSession, d: str) -> DataFrame:
    s = T.table(spark, d, "supplier")
    key = _named(s, "s", "s_suppkey")
    return ranking.source_first(ranking.ranked(s.select(key.alias("key"), F.col("s_acctbal").alias("score"))), s.select(key.alias("key"), (F.col("s_suppkey") % 5 == 0).alias("is_test")))


@query("select s_suppkey as k, round(1.0::double * case when s_suppkey % 4 = 0 then 0.5 else 1 end * case when s_suppkey % 3 = 0 then 0.5 else 1 end * case when s_suppkey % 5 = 0 then 0.3 else 1 end, 6) as score from supplier")
def stale_penalty(spark: SparkSession, d: str) -> DataFrame:
    s = T.table(spark, d, "supplier")
    p = ranking.penalty(F.when(F.col("s_suppkey") % 3 == 0, 51).otherwise(50), F.when(F.col("s_suppkey") % 5 == 0, "a/DEPRECATED/b").otherwise("a/b"), F.col("s_suppkey") % 4 == 0, False)
    return s.select(F.col("s_suppkey").alias("k"), F.round(p, 6).alias("score"))


_ALL_SCORED = _SCORED.replace("where repo in ('src0', 'src1', 'src2') ", "")


@query(_ALL_SCORED + """, lr as (select key, row_number() over (order by score desc, key) - 1 as r from lex qualify r < 50),
seeds as (select split_part(key, chr(31), 1) || chr(31) || split_part(key, chr(31), 2) as f from lr where r < 10),
near as (select k.key, count(*) as score from (select distinct key, split_part(key, chr(31), 1) || chr(31) || split_part(key, chr(31), 2) as f from ok) k join seeds using (f) group by 1),
nr as (select key, row_number() over (order by score desc, key) - 1 as r from near qualify r < 50)
select key, round(sum(1.0::double / (61 + r)), 9) as score from (select * from lr union all select * from nr) group by 1""")
def fused_scores(spark: SparkSession, d: str) -> DataFrame:
    from .tools import fused

    return fused(_answers(spark, d), Q, None).select("key", F.round("score", 9).alias("score"))


def _tools(spark: SparkSession, d: str, **relations: str) -> Tools:
    """The tools over the trade graph, its relations under other names."""
    g = T.trade(spark, d)
    name = F.col("relation")
    for new, old in relations.items():
        name = F.when(F.col("relation") == old, new).otherwise(name)
    edges = g.edges.withColumn("relation", name)
    nodes = g.nodes.withColumn("ord", F.lit(0).cast("long"))
    names = [r["r_name"] for r in T.table(spark, d, "region").collect()]
    reg = registry.Registry([registry.Repo(r, f"/w/{r}") for r in names])
    aliases = nodes.where("repo is not null").select(F.lower("label").alias("alias"), F.col("id").alias("doc_id"))
    docs = Graph(nodes, edges).keyed().where("key is not null").select(F.col("id").alias("doc_id"), "repo", "key")
    index = {"documents": docs, "aliases": aliases, "postings": spark.createDataFrame([], "term string, doc_id string, field string")}
    return Tools(spark, Generation(Graph(nodes, edges), index, spark.createDataFrame([], overlay_schema())), reg, cwd="/w/ASIA")


def overlay_schema() -> str:
    return f"type string, source {overlay.REF}, target {overlay.REF}, provenance string, confidence double, evidence string"


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@query(", one as (select k.key, 1 as depth from edges e join keyed k on k.id = e.source where relation = 'part_of' and k.repo = 'ASIA'), two as (select k.key, 2 as depth from edges e join keyed n on n.id = e.target join keyed k on k.id = e.source where e.relation = 'located_in' and n.kind = 'nation' and n.repo = 'ASIA') select key, cast(min(depth) as integer) as depth from (select * from one union all select * from two) group by 1 order by 2, 1 limit 1999", True)
def subclass_tool(spark: SparkSession, d: str) -> DataFrame:
    """Nations as subclasses of their region, and who is located in them as subclasses of those."""
    t = _tools(spark, d, inherits="part_of", implements="located_in")
    return _rows(spark, t.subclasses("ASIA", "ASIA").rows, "key string, depth int")


@query(", c as (select min(id) as id from nodes where kind = 'customer' and repo = 'ASIA') select k.key, cast(1 as integer) as depth from edges e join keyed k on k.id = e.source join c on c.id = e.target where relation = 'placed_by'", True)
def importer_tool(spark: SparkSession, d: str) -> DataFrame:
    t = _tools(spark, d, imports="placed_by")
    seed = t.gen.graph.nodes.where("kind = 'customer' and repo = 'ASIA'").agg(F.min("id")).first()[0]
    return _rows(spark, t.importers(seed, "ASIA").rows, "key string, depth int")


@query("select k.key, cast(1 as integer) as depth from edges e join keyed k on k.id = e.target where e.relation = 'part_of' and k.repo = 'ASIA' union select k.key, cast(1 as integer) from edges e join keyed k on k.id = e.source join nodes n on n.id = e.target where e.relation = 'located_in' and e.target = (select min(id) from nodes where kind = 'nation' and repo = 'ASIA') and k.repo = 'ASIA'", True)
def neighbour_tool(spark: SparkSession, d: str) -> DataFrame:
    t = _tools(spark, d)
    seed = t.gen.graph.nodes.where("kind = 'nation' and repo = 'ASIA'").agg(F.min("id")).first()[0]
    asked = (seed, "ASIA", ["part_of", "located_in"], "both")
    listed = t.neighbors(*asked)
    return _rows(spark, listed.rows, "key string, depth int") if listed.info["complete"] else t.neighborhood(*asked)


@query("select key, repo, cast(1000000 as double) as score, 'exact' as match_type from keyed where kind = 'nation' and label = (select min(n_name) from nation)", True)
def search_tool(spark: SparkSession, d: str) -> DataFrame:
    name = T.table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return _rows(spark, _tools(spark, d).search(f"  {name.lower()} ", "all", 1).rows, "key string, repo string, score double, match_type string")


@query("select key, repo from keyed where kind = 'nation' and label = (select min(label) from nodes where kind = 'nation' and repo = 'EUROPE')", True)
def cross_project_tool(spark: SparkSession, d: str) -> DataFrame:
    t = _tools(spark, d)
    name = t.gen.graph.nodes.where("kind = 'nation' and repo = 'EUROPE'").agg(F.min("label")).first()[0]
    return _rows(spark, t.cross_project(name, exclude_repos=["ASIA"], k=1).rows, "key string, repo string")


@query("select cast(count(*) as bigint) as node_count, cast(count(distinct coalesce(community_name, 'unassigned')) as bigint) as community_total from nodes where repo = 'ASIA'", True)
def project_map_tool(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [_tools(spark, d).project_map("ASIA").info], "node_count long, community_total long")


@query("select r_name as repo, cast(count(n.id) as bigint) as node_count, count(n.id) > 0 as in_generation, r_name = 'ASIA' as current from region left join nodes n on n.repo = r_name group by r_name", True)
def list_repos_tool(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, _tools(spark, d).list_repos().rows, "repo string, node_count long, in_generation boolean, current boolean")


@query("select r_name as repo from region where r_name not in ('ASIA', 'EUROPE')")
def scoped_repos(spark: SparkSession, d: str) -> DataFrame:
    names = [r["r_name"] for r in T.table(spark, d, "region").collect()]
    reg = registry.Registry([registry.Repo(r, f"/w/{r}") for r in names])
    return spark.createDataFrame([(r,) for r in registry.resolve_repos(reg, None, ["ASIA", "EUROPE"])], "repo string")


@query("select q, case when m like '%qwen3-embedding%' then 'Instruct: Given a web search query, retrieve relevant passages that answer the query' || chr(10) || 'Query:' || q else q end as asked from (select p_name as q, case when p_partkey % 2 = 0 then 'x/Qwen3-Embedding:8b' else 'other' end as m0, lower(m0) as m from part where p_partkey < 20)")
def instructed_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "part").where("p_partkey < 20").select("p_name", "p_partkey").collect()
    return spark.createDataFrame([(r["p_name"], instructed("x/Qwen3-Embedding:8b" if r["p_partkey"] % 2 == 0 else "other", r["p_name"])) for r in rows], "q string, asked string")


# -- overlay -------------------------------------------------------------------------------


@query("with n as (select 'r' || (c_custkey % 2) as repo, 'L' || (c_custkey // 2) as label, c_custkey from customer where c_custkey % 10 >= 2), k as (select *, repo || chr(31) || 'f' || chr(31) || label as key from n) select a.key as key_a, b.key as key_b from k a join k b on a.label = b.label and a.repo = 'r0' and b.repo = 'r1' order by 1, 2 limit 2000")
def fallback_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two customers of one label in two repos; those that have a vector are left out."""
    c = T.table(spark, d, "customer")
    repo, label = F.concat(F.lit("r"), (F.col("c_custkey") % 2).cast("string")), F.concat(F.lit("L"), F.expr("c_custkey div 2").cast("string"))
    n = c.select(F.concat_ws(SEP, repo, F.lit("f"), label).alias("key"), repo.alias("repo"), label.alias("label"), F.lit("c").alias("community_name"), "c_custkey")
    return overlay.fallback_pairs(n.drop("c_custkey"), n.where("c_custkey % 10 < 2").select("key"))


@query(_COPIES + """, lines as (select r1, r2, ext, case when identity < 0.8 then 2.0 else identity * 0.92 end as line from cal),
fam as (select r1, r2, max(line) as line from lines where ext in ('.ts', '.tsx') group by 1, 2),
a as (select x.*, coalesce(l.line, case when x.ext in ('.ts', '.tsx') then f.line end, 0.82) as applied from x left join lines l on l.r1 = x.r1 and l.r2 = x.r2 and l.ext = x.ext left join fam f on f.r1 = x.r1 and f.r2 = x.r2 where fa <> fb),
k as (select *, r1 || chr(31) || 'f' || fa || ext || chr(31) || label as ka, r2 || chr(31) || 'f' || fb || ext || chr(31) || label as kb from a where score >= applied),
p as (select *, row_number() over (partition by r1, r2 order by score desc, ka, kb) as n from k)
select r1 as a_repo, label as a_label, r2 as b_repo, round(score, 4) as confidence from p where n <= 2000""")
def similar_edges(spark: SparkSession, d: str) -> DataFrame:
    e = overlay.similar_edges(_copies(spark, d), "m")
    return e.select(F.col("source.repo").alias("a_repo"), F.col("source.qualified_label").alias("a_label"), F.col("target.repo").alias("b_repo"), F.round("confidence", 4).alias("confidence"))


@query("select p_partkey as k, case p_partkey % 3 when 0 then 'ok' when 1 then case when p_partkey % 2 = 0 then 'ok' else 'ambiguous' end else 'dangling' end as state from part")
def resolved_refs(spark: SparkSession, d: str) -> DataFrame:
    """References by full name, by a last part that one key has or that two have, and to nothing."""
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("n"))
    file = F.concat(F.lit("f"), "n")
    one = p.select(F.lit("r").alias("repo"), file.alias("source_file"), F.concat(F.lit("db."), "n").alias("label"), F.col("n").alias("bare"))
    two = p.where("k % 2 = 1").select(F.lit("r").alias("repo"), file.alias("source_file"), F.concat(F.lit("web."), "n").alias("label"), F.col("n").alias("bare"))
    label = F.when(F.col("k") % 3 == 0, F.concat(F.lit("db."), "n")).when(F.col("k") % 3 == 1, F.col("n")).otherwise("none")
    return overlay.resolve_refs(p.select("k", F.lit("r").alias("repo"), file.alias("source_file"), label.alias("label")), one.unionByName(two)).select("k", "state")


@query("select 'a' || chr(31) || 'f' || chr(31) || n_name as source, 'b' || chr(31) || 'f' || chr(31) || 'R' || n_regionkey as target, cast(case when n_nationkey % 2 = 0 then 0.5 else 1.0 end as double) as confidence from nation")
def manual_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "nation").collect()
    ref = lambda repo, label: {"repo": repo, "source_file": "f", "qualified_label": label}
    data = {"relations": [{"source": ref("a", r["n_name"]), "target": ref("b", f"R{r['n_regionkey']}")} | ({"confidence": 0.5} if r["n_nationkey"] % 2 == 0 else {}) for r in rows]}
    nodes = spark.createDataFrame([("a", "f", r["n_name"]) for r in rows] + [("b", "f", f"R{r['n_regionkey']}") for r in rows], "repo string, source_file string, label string").withColumn("bare", F.col("label"))
    joined = lambda c: F.concat_ws(SEP, f"{c}.repo", f"{c}.source_file", f"{c}.qualified_label").alias(c)
    return overlay.manual_edges(facts.manual(spark, data), nodes).select(joined("source"), joined("target"), "confidence")


# -- files and facts --------------------------------------------------------------------------

_FILES = "with f as (select page_id as k, html, ['src/f' || page_id || '.py', 'README' || page_id || '.md', 'node_modules/x' || page_id || '.js', 'go.mod', 'q' || page_id || '.sql', '.env', 'x' || page_id || '.bin', 'package-lock.json'][page_id % 8 + 1] as path, 'r' || (page_id % 3) as repo from pages)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "pages")
    n = F.col("page_id").cast("string")
    path = F.element_at(F.array(F.concat(F.lit("src/f"), n, F.lit(".py")), F.concat(F.lit("README"), n, F.lit(".md")), F.concat(F.lit("node_modules/x"), n, F.lit(".js")), F.lit("go.mod"), F.concat(F.lit("q"), n, F.lit(".sql")), F.lit(".env"), F.concat(F.lit("x"), n, F.lit(".bin")), F.lit("package-lock.json")), (F.col("page_id") % 8 + 1).cast("int"))
    return p.select(F.col("page_id").alias("k"), F.concat(F.lit("r"), (F.col("page_id") % 3).cast("string")).alias("repo"), path.alias("path"), F.encode("html", "UTF-8").alias("content"))


@query(_FILES + " select k, ['code', 'semantic', 'code', 'code', 'code', 'ignore', 'ignore', 'ignore'][k % 8 + 1] as category, k % 8 = 5 as secret from f")
def file_classes(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("k", files.category(F.col("path")).alias("category"), files.is_sensitive(F.concat(F.lit("/r/"), "path")).alias("secret"))


@query(_FILES + ", e as (select repo, case when k % 8 = 1 then 'semantic' else 'code' end as c, path || ':' || strlen(html) || ':' || substr(sha256(html), 1, 32) || chr(10) as e, k from f where k % 8 in (0, 1, 3, 4)) select repo, substr(sha256(coalesce(string_agg(case when c = 'code' then e end, '' order by e), '')), 1, 16) as code_hash, substr(sha256(coalesce(string_agg(case when c = 'semantic' then e end, '' order by e), '')), 1, 16) as semantic_hash, cast(count(*) as bigint) as file_count, bool_or(k % 8 = 4) as has_sql from e group by 1")
def source_digests(spark: SparkSession, d: str) -> DataFrame:
    return files.digests(_files(spark, d))


@query(_FILES + " select k, path, k % 8 in (4, 6) or path = 'go.mod' as ignored from f")
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    rules = files.IgnoreRules(["*.bin", "/q*.sql", "go.mod", "README*.md", "!README*.md"])

    @F.pandas_udf("boolean")
    def ignored(path):
        return path.map(rules.ignores)

    return _files(spark, d).select("k", "path", ignored("path").alias("ignored"))


@query("with l as (select conv_id, turn, string_split(text, chr(10)) as ls, conv_id % 30 as line from conversations where turn = 0) select conv_id, cast(line as integer) as line, substr(array_to_string(list_slice(ls, case when line > 0 then greatest(0, line - 11) else 0 end + 1, case when line > 0 then greatest(0, line - 11) else 0 end + 20), chr(10)), 1, 800) as snippet from l")
def file_snippets(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "conversations").where("turn = 0")
    file = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    nodes = c.select(F.lit("r").alias("repo"), file.alias("source_file"), F.when(F.col("conv_id") % 30 > 0, F.col("conv_id") % 30).cast("int").alias("line"))
    src = c.select(F.lit("r").alias("repo"), file.alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit(0.0).alias("modified"))
    s = files.snippets(nodes, src)
    return s.select(F.expr("cast(substring(source_file, 2) as bigint)").alias("conv_id"), F.coalesce("line", F.lit(0)).alias("line"), "snippet")


def _code(spark: SparkSession, d: str) -> DataFrame:
    """A PHP file for each part, with routes that it declares and calls that it makes."""
    p = T.table(spark, d, "part")
    n = F.col("p_partkey").cast("string")
    head = F.format_string("<?php class C%s { #[Route('/p/{id}/%s', methods: ['GET', 'post'])] public function show() { $x->request('put', '/p/%s/q'); } #[Route(\"/late%s\")] }", n, n, n, n)
    return p.select(F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("repo"), F.concat(F.lit("src/f"), n, F.lit(".php")).alias("path"), F.encode(head, "UTF-8").alias("content"), "p_partkey")


@query("select m.method, '/p/{param}/' || p_partkey as template, 'r' || (p_partkey % 3) as repo, 'C' || p_partkey || '::show' as label from part, (select unnest(['GET', 'POST']) as method) m union all select 'GET', '/late' || p_partkey, 'r' || (p_partkey % 3), 'C' || p_partkey || '::unknownMethod' from part")
def declared_routes(spark: SparkSession, d: str) -> DataFrame:
    repos = spark.createDataFrame([(f"r{i}", i) for i in range(3)], "repo string, repo_ord int")
    return facts.api(_code(spark, d).drop("p_partkey"), repos)[0].select("method", "template", "repo", "label")


@query("select 'PUT' as method, '/p/' || p_partkey || '/q' as template, 'src/f' || p_partkey || '.php' as file from part")
def called_routes(spark: SparkSession, d: str) -> DataFrame:
    repos = spark.createDataFrame([(f"r{i}", i) for i in range(3)], "repo string, repo_ord int")
    return facts.api(_code(spark, d).drop("p_partkey"), repos)[1].select("method", "template", "file")


@query("select 'r' || s_suppkey as repo, 'npm' as ecosystem, 'p' || s_nationkey as name, s_suppkey % 2 = 0 as dev from supplier")
def package_dependencies(spark: SparkSession, d: str) -> DataFrame:
    s = T.table(spark, d, "supplier")
    dep = F.create_map(F.concat(F.lit("p"), F.col("s_nationkey").cast("string")), F.lit("1"))
    none = F.lit(None).cast("map<string,string>")
    text = F.to_json(F.struct(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, none).otherwise(dep).alias("dependencies"), F.when(F.col("s_suppkey") % 2 == 0, dep).otherwise(none).alias("devDependencies")))
    return facts.packages(s.select(_named(s, "r", "s_suppkey").alias("repo"), F.lit("package.json").alias("path"), F.encode(text, "UTF-8").alias("content")))["dependencies"]


@query("select 'r' || (p_partkey % 4) as repo, 'f' || p_partkey as source_file from part where p_partkey % 5 = 0")
def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    entry = F.struct(_named(p, "f", "p_partkey").alias("k"), F.struct(F.lit("1").alias("ast_hash"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise("2").alias("semantic_hash")).alias("v"))
    m = p.groupBy(F.concat(F.lit("r"), (F.col("p_partkey") % 4).cast("string")).alias("repo")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return facts.stale_files(m)


@query("select 'r' || (p_partkey % 4) || chr(31) || 'f' || p_partkey || chr(31) || p_name as key from part where p_partkey % 5 = 0 and p_partkey % 2 = 0")
def stale_semantic_keys(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    nodes = p.select(F.concat(F.lit("r"), (F.col("p_partkey") % 4).cast("string")).alias("repo"), _named(p, "f", "p_partkey").alias("source_file"), F.col("p_name").alias("label"), F.when(F.col("p_partkey") % 2 == 0, "semantic").otherwise("ast").alias("origin"))
    return lexical.stale_keys(nodes, stale_sources(spark, d))


@query("select id, repo, label from nodes where kind in ('nation', 'region', 'supplier')", True)
def node_link_files(spark: SparkSession, d: str) -> DataFrame:
    """Each repo's nodes written as a node-link file and read again."""
    n = T.trade(spark, d).nodes.where("kind in ('nation', 'region', 'supplier')")
    one = n.groupBy("repo").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "label", "source_file")).alias("nodes"), F.array().cast("array<string>").alias("links"))).alias("value"))
    path = _shared(spark, "graphs")
    one.write.partitionBy("repo").text(path)
    g, _ = nodelink.read(spark, path, F.regexp_extract("path", "repo=([^/]+)", 1))
    return g.nodes.select("id", F.regexp_replace("repo", "%20", " ").alias("repo"), "label")


# -- routes ---------------------------------------------------------------------------------------


def _route_graph(spark: SparkSession, d: str) -> Graph:
    """Orders as v2 routes, customers' last digits as handlers, two guards, checks in some handlers."""
    o = T.table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    rid = F.concat(F.lit("o"), F.col("k").cast("string"))
    kind = F.when(F.col("o_orderpriority").startswith("1"), "method").when(F.col("o_orderpriority").startswith("2"), "closure").when(F.col("o_orderpriority").startswith("3"), "odd")
    state = F.when(F.col("o_orderstatus") == "F", "covered").when(F.col("o_orderstatus") == "O", "not_proven").otherwise("undecided")
    eff = F.when(F.col("k") % 3 == 0, F.array(F.lit("ga"))).when(F.col("k") % 3 == 1, F.array(F.lit("gp"))).otherwise(F.array().cast("array<string>"))
    attrs = F.to_json(F.struct(F.lit(2).alias("route_schema"), F.concat(F.lit("/o/"), F.col("k").cast("string")).alias("route_path"), kind.alias("handler_kind"), state.alias("authorization_state"), eff.alias("effective_guards")))
    node = "id string, repo string, label string, source_file string, line int, community_name string, kind string, ord long, attrs string"
    more = [(f"m{i}", "s", f"m{i}", f"src/c{i}.php", 1, None, "method", 0, "{}") for i in range(10)] + [("ga", "s", "ga", "g", 1, None, "access_guard", 0, '{"guard_kind": "authorization"}'), ("gp", "s", "gp", "g", 1, None, "access_guard", 0, '{"guard_kind": "public"}'), ("k0", "s", "K", "src/c0.php", 1, None, "class", 0, "{}"), ("w", "s", "w", "g", 1, None, "x", 0, "{}")]
    nodes = o.select(rid.alias("id"), F.lit("s").alias("repo"), rid.alias("label"), F.lit("routes.php").alias("source_file"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("community_name"), F.lit("http_route").alias("kind"), F.lit(0).cast("long").alias("ord"), attrs.alias("attrs")).unionByName(spark.createDataFrame(more, node))
    ext = lambda df, a, b, rel, at: df.select(a.alias("source"), b.alias("target"), F.lit(rel).alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(at).alias("attrs"))
    e = ext(o.where("o_custkey % 2 = 0"), rid, F.concat(F.lit("m"), (F.col("o_custkey") % 10).cast("string")), "handled_by", "{}")
    e = e.unionByName(ext(o.where("k % 5 = 0"), rid, F.lit("ga"), "guarded_by", "{}"))
    fixed = [("m0", "w", "checks_access", "EXTRACTED", '{"check_kind": "framework", "guard_kind": "authentication"}'), ("m2", "w", "checks_access", "EXTRACTED", '{"check_kind": "framework"}'), ("m4", "w", "checks_access", "EXTRACTED", '{"check_kind": "pattern"}'), ("k0", "m0", "method", "EXTRACTED", "{}"), ("k0", "gp", "guarded_by", "EXTRACTED", "{}")]
    return Graph(nodes, e.unionByName(spark.createDataFrame(fixed, "source string, target string, relation string, confidence string, attrs string")))


_V2 = """with o as (select o_orderkey as k, case o_orderstatus when 'F' then 'covered' when 'O' then 'not_proven' else 'undecided' end as state, o_custkey % 2 = 0 as handled, case when o_custkey % 2 = 0 then o_custkey % 10 end as m, substr(o_orderpriority, 1, 1) as p, o_orderkey % 3 = 0 as has_auth, o_orderkey % 3 = 1 as has_public, o_orderkey % 5 = 0 as guard_edge from orders),
j as (select *, coalesce(m = 0, false) as fw_auth, coalesce(m = 2, false) as fw_none, coalesce(m = 4, false) as pat,
  (p = '1' and not handled) or (p = '2' and handled) or (state = 'covered' and not has_auth) or (state = 'not_proven' and has_auth) or (state = 'not_proven' and not has_auth and not has_public and guard_edge) or coalesce(m = 2, false) as wrong from o),
b as (select *, case when wrong then 'undecided' when state = 'covered' then 'authorization_covered' when state = 'undecided' then 'undecided' when fw_auth then 'authentication_only' when has_public then 'public_declared' when pat then 'pattern_check_only' else 'no_indexed_check' end as bucket from j)"""


@query(_V2 + " select bucket, cast(count(*) as bigint) as n_routes, true as v2 from b group by 1")
def v2_route_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = _route_graph(spark, d)
    return routes.coverage(routes.judged(routes.evidence(g, routes.routes(g.nodes))))


@query(_V2 + " select case when wrong then 'producer-inconsistent' else 'authorization-state-missing' end as reason, cast(count(*) as bigint) as n_routes from b where bucket = 'undecided' group by 1")
def route_reasons(spark: SparkSession, d: str) -> DataFrame:
    g = _route_graph(spark, d)
    return routes.reasons(routes.judged(routes.evidence(g, routes.routes(g.nodes))))


@query(_V2 + " select 'o' || k as id, case when p = '3' then 'route_field_invalid' when wrong then 'route_producer_inconsistent' end as first_mark, p = '3' and wrong as both from b where p = '3' or wrong")
def route_marks(spark: SparkSession, d: str) -> DataFrame:
    g = _route_graph(spark, d)
    j = routes.judged(routes.evidence(g, routes.routes(g.nodes))).where("size(marks) > 0")
    return j.select("id", F.get("marks", F.lit(0)).alias("first_mark"), (F.size("marks") == 2).alias("both"))


@query(_V2 + " select 'o' || k as id, 'ga' as guard, 'route' as scope, 'authorization' as kind from o where guard_edge union all select 'o' || k, 'gp', 'class', 'public' from o where m = 0")
def route_guards(spark: SparkSession, d: str) -> DataFrame:
    g = _route_graph(spark, d)
    e = routes.evidence(g, routes.routes(g.nodes)).select("id", F.explode("guards").alias("g"))
    return e.select("id", "g.guard", "g.scope", "g.kind")


@query(_V2 + " select 'o' || k as id, case when handled then 'src/c' || m || '.php' else 'routes.php' end as file from o")
def route_files(spark: SparkSession, d: str) -> DataFrame:
    g = _route_graph(spark, d)
    return routes.controller_files(routes.evidence(g, routes.routes(g.nodes)))


@query(_V2 + " select 'o' || k as id, 'm' || m as handler, case when m = 0 then 'k0' end as cls, 'src/c' || m || '.php' as file from o where handled")
def route_handlers(spark: SparkSession, d: str) -> DataFrame:
    g = _route_graph(spark, d)
    h = routes.evidence(g, routes.routes(g.nodes)).select("id", F.explode("handlers").alias("h"))
    return h.select("id", "h.handler", "h.cls", "h.file")


@query(_V2 + " select 'o' || k as id from o where m = 4 order by '/o/' || k, 'o' || k limit 500")
def controller_outline_tool(spark: SparkSession, d: str) -> DataFrame:
    t = Tools(spark, Generation(_route_graph(spark, d), {}, spark.createDataFrame([], "type string")), registry.Registry([registry.Repo("s", "/s")]))
    return _rows(spark, t.controller_outline("src/c4.php", "s").rows, "id string")


@query("select 'o' || o_orderkey as id, 'path' as match from orders where o_orderkey = (select max(o_orderkey) from orders)")
def route_handler_tool(spark: SparkSession, d: str) -> DataFrame:
    g = _route_graph(spark, d)
    t = Tools(spark, Generation(g, {}, spark.createDataFrame([], "type string")), registry.Registry([registry.Repo("s", "/s")]))
    k = T.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return _rows(spark, t.route_handler(f"/o/{k}", "s").rows, "id string, match string")


# -- runs -------------------------------------------------------------------------------------------


def _shards(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = T.table(spark, d, "customer")
    repo, key = _named(c, "r", "c_nationkey"), _named(c, "c", "c_custkey")
    now = c.select(repo.alias("repo"), key.alias("key"), F.col("c_name").alias("content_hash"))
    old = c.where("c_nationkey % 4 <> 3").select(repo.alias("repo"), key.alias("key"), F.when((F.col("c_nationkey") % 4 == 1) & (F.col("c_custkey") % 50 == 0), "old").otherwise(F.col("c_name")).alias("content_hash"), F.when(F.col("c_nationkey") % 4 == 2, "s1").otherwise("s2").alias("recipe_stamp"), F.array(F.lit(1.0)).cast("array<float>").alias("vec"))
    return now, old


@query("select 'r' || c_nationkey as repo, bool_and(c_nationkey % 4 <> 3 and not (c_nationkey % 4 = 1 and c_custkey % 50 = 0)) as current from customer group by 1")
def shard_content(spark: SparkSession, d: str) -> DataFrame:
    return incremental.content_current(*_shards(spark, d))


@query("select distinct 'r' || c_nationkey as repo from customer where c_nationkey % 4 = 3")
def missing_shards(spark: SparkSession, d: str) -> DataFrame:
    return incremental.missing_shards(*_shards(spark, d))


@query("select distinct 'r' || c_nationkey as repo from customer where c_nationkey % 4 = 2")
def stale_recipes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.stale_recipes(_shards(spark, d)[1], "s2")


@query("select 'c' || c_custkey as key, false as has_vec from customer")
def recipe_change(spark: SparkSession, d: str) -> DataFrame:
    """Under another model's name no vector is reused."""
    now, old = _shards(spark, d)
    return incremental.reuse(now, old, "b", "a").select("key", F.col("vec").isNotNull().alias("has_vec"))


@query("select 'c' || c_custkey as key from customer where c_nationkey % 4 <> 3 and c_custkey % 2 = 0")
def carried_vectors(spark: SparkSession, d: str) -> DataFrame:
    now, old = _shards(spark, d)
    even = now.where(F.expr("cast(substring(key, 2) as bigint) % 2 = 0")).select("key")
    return incremental.carry(old, even, "a", "a").select("key")


@query("select 'c' || c_custkey as key from customer where c_nationkey % 4 = 3 or (c_nationkey % 4 = 1 and c_custkey % 50 = 0)")
def changed_inputs(spark: SparkSession, d: str) -> DataFrame:
    now, old = _shards(spark, d)
    return incremental.changed_rows(old, now, "key", "content_hash").select("key")


@query("select 'r' as repo, 'd' || p_partkey as path from part where p_partkey % 3 = 0")
def unstamped_documents(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    docs = p.select(F.lit("r").alias("repo"), _named(p, "d", "p_partkey").alias("path"), "p_partkey")
    return facts.missing_lines(docs.drop("p_partkey"), docs.where("p_partkey % 3 <> 0").drop("p_partkey"))


@query("select 'nodes' as what, 'n' || n_nationkey as id from nation union all select 'edges', 'n' || n_nationkey from nation where n_regionkey > 0")
def published_generation(spark: SparkSession, d: str) -> DataFrame:
    """Written, flipped to, pruned around, verified and read back."""
    n = T.table(spark, d, "nation")
    nodes, root = n.select(_named(n, "n", "n_nationkey").alias("id"), "n_regionkey"), _shared(spark, "generations")
    edges = nodes.where("n_regionkey > 0")
    m = dict.fromkeys(validate.MANIFEST_KEYS, "") | {"output_node_count": nodes.count(), "output_edge_count": edges.count()}
    for name in ("g1", "g2", "g3", "g4"):
        publish.write(root, name, {"nodes": nodes, "edges": edges}, m | {"generation_id": name})
        publish.flip(root, name)
    publish.prune(root, 2)
    tables, _ = publish.read(spark, root, verify=True)
    return tables["nodes"].select(F.lit("nodes").alias("what"), "id").unionByName(tables["edges"].select(F.lit("edges").alias("what"), "id"))


@query("select k as manifest_key from (select unnest(['generation_id', 'created_at', 'repo_input_hashes', 'registry_hash', 'config_hash', 'output_node_count', 'output_edge_count', 'output_hash', 'clustering_backend', 'embedding_model', 'labeling', 'stale_repos']) as k) where k not in ('labeling', 'output_hash')")
def manifest_keys(spark: SparkSession, d: str) -> DataFrame:
    errors = validate.manifest_errors({"labeling": "hub", "output_hash": ""})
    return spark.createDataFrame([(e.rsplit(" ", 1)[1],) for e in errors], "manifest_key string")


@query("with c as (select count(*) as n, sum((c_custkey % 10 > 0)::int) as k, sum((c_custkey % 5 > 0)::int) as h from customer) select 'tenth' as what, k < ceil(n * 0.9 - 1e-9) as refused from c union all select 'fifth', h < ceil(n * 0.9 - 1e-9) from c")
def shrink_guard(spark: SparkSession, d: str) -> DataFrame:
    n = T.table(spark, d, "customer").agg(F.count("*"), F.sum((F.col("c_custkey") % 10 > 0).cast("int")), F.sum((F.col("c_custkey") % 5 > 0).cast("int"))).first()
    return spark.createDataFrame([(what, bool(validate.shrink_errors((n[0], 0), (left, 0)))) for what, left in (("tenth", n[1]), ("fifth", n[2]))], "what string, refused boolean")


@query("select 'a link has no source or target' as error")
def schema_errors(spark: SparkSession, d: str) -> DataFrame:
    g = T.trade(spark, d)
    return validate.schema_errors(Graph(g.nodes, g.edges.withColumn("target", F.when(F.col("relation") != "contains", F.col("target")))))


@query(", e as (select source, target, relation, 'target' as side, target as missing from edges where target like 'part:%' order by missing, relation, side, source, target limit 50) select 'dangling' as what, cast(51 as bigint) as lines from e limit 1", True)
def all_checks(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a graph without its parts: fifty endpoints that are no nodes, and a line on how many more."""
    g = T.trade(spark, d)
    strip = graph.strip_cross_repo(g.edges)
    found = validate.check_all(Graph(g.nodes.where("kind <> 'part'"), strip), skip_names=True)
    return spark.createDataFrame([(k, len(v)) for k, v in found.items()], "what string, lines long")


@query("select 'r' || c_custkey as repo_id, 'root' as field, '/x/' || c_custkey as path from customer where c_custkey % 4 = 0 and c_custkey % 7 > 0")
def outside_roots(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    root = F.concat(F.when(F.col("c_custkey") % 4 == 0, "/x/").otherwise("/w/"), F.col("c_custkey").cast("string"))
    return validate.outside(c.select(_named(c, "r", "c_custkey").alias("repo_id"), root.alias("root"), F.concat(F.lit("/w/c"), F.col("c_custkey").cast("string")).alias("collection_path"), (F.col("c_custkey") % 7 > 0).alias("enabled")), ["/w"])


@query("select c_mktsegment as repo_id, cast(count(*) as bigint) as n from customer group by 1 having count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(T.table(spark, d, "customer").select(F.col("c_mktsegment").alias("repo_id")))
