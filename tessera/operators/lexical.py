"""The inverted index, and scoring by field boost times inverse document frequency."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.text import alias_forms, fold_text, is_file_label, text_terms
from ..model import BOOSTS, durable_key

#: In the packed exchange form a posting is a document number, shifted, with its field in the low bits.
PACK_BITS, FIELDS = 2, ["label", "path", "snippet"]


def query_terms(q: str) -> list[str]:
    """Terms of a query, as the index has them. Plain Python: queries are arguments, not rows."""
    return sorted(text_terms(q))


def numbered(ids: DataFrame) -> DataFrame:
    """(id, doc_id) from (id, repo): dense numbers, repo after repo.

    Within a repo ids are ordered by a hash and cut into ranges of it, so a repo with a third of all nodes is numbered
    range by range; only counts by range are ordered as a whole.
    """
    n = ids.select("id", "repo", F.xxhash64("id").alias("h")).withColumn("b", F.shiftright("h", 54))
    sums = n.groupBy("repo", "b").agg(F.count("*").alias("c"))
    repos = n.groupBy("repo").agg(F.count("*").alias("c"))
    before = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = repos.select(F.col("repo").alias("_repo"), before(W.orderBy("repo")).alias("o"))
    ranges = sums.withColumn("s", before(W.partitionBy("repo").orderBy("b"))).join(start, F.col("repo") == F.col("_repo")).select(F.col("repo").alias("_r"), F.col("b").alias("_b"), (F.col("s") + F.col("o")).alias("from"))
    place = F.row_number().over(W.partitionBy("repo", "b").orderBy("h", "id"))
    return n.withColumn("p", place).join(ranges, (F.col("repo") == F.col("_r")) & (F.col("b") == F.col("_b"))).select("id", (F.col("from") + F.col("p") - 1).alias("doc_id"))


def _keyed(nodes: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Nodes with qualified, full and key, those without a key left out."""
    n = nodes if paths is None else nodes.join(paths, "id", "left")
    q = F.col("path") if paths is not None else F.lit(None).cast("string")
    label = F.coalesce(q, F.col("label"), F.lit(""))
    return n.withColumn("qualified", q).withColumn("full", label).withColumn("key", durable_key(F.col("repo"), F.col("source_file"), label)).where("key is not null")


def term_lists(keyed: DataFrame, name: str, only: list[str] | None = None, merged: bool = False) -> DataFrame:
    """(name, label, path, snippet): the distinct terms of each field of each node, beside its column of that name; merged: (name, terms), those of all fields."""
    ancestors = F.when(F.col("qualified").isNotNull() & F.col("qualified").endswith(F.concat(F.lit("."), "label")), F.expr("substring(qualified, 1, length(qualified) - length(label) - 1)"))
    # a blank between file and ancestors parts their terms
    texts = [F.col("label").alias("label"), F.concat_ws(" ", "source_file", ancestors).alias("path"), F.col("snippet").alias("snippet")]
    fields = ["terms"] if merged else FIELDS
    kept = None if only is None else set(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [[text_terms(t) for t in part.column(i).to_pylist()] for i in (1, 2, 3)]
                if merged:
                    sets = [[x | y | z for x, y, z in zip(*sets, strict=True)]]
                if kept is not None:
                    sets = [[t & kept for t in field] for field in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([list(t) for t in field], pa.list_(pa.string())) for field in sets)], [name, *fields])

    schema = T.StructType([T.StructField(name, T.StringType()), *(T.StructField(f, T.ArrayType(T.StringType())) for f in fields)])
    return keyed.select(name, *texts).mapInArrow(run, schema)


def _exploded(lists: DataFrame, name: str) -> DataFrame:
    """(name, field, term) from term_lists."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in FIELDS])
    return lists.select(name, F.explode(fields).alias("x")).select(name, "x.field", F.explode("x.terms").alias("term"))


def build(nodes: DataFrame, paths: DataFrame | None = None, only: list[str] | None = None) -> dict[str, DataFrame]:
    """documents (doc_id, repo, key), postings (term, doc_id, field) and aliases (alias, doc_id) of keyed nodes.

    nodes: id (unique), repo, label, source_file, snippet. paths (id, path): dotted labels of configuration keys; those
    become the key's and the alias's label, and their ancestors count as path. Texts are cut where they are read; what
    is shuffled are ids and lists of terms, a row for each node. only: postings of these terms alone, chosen there too.
    """
    n = _keyed(nodes, paths)
    number = numbered(n)
    lists = term_lists(n, "id", only)
    if only is not None:
        lists = lists.where(" or ".join(f"size({f}) > 0" for f in FIELDS))
    postings = _exploded(lists.join(number, "id"), "doc_id")
    files = n.where(is_file_label(F.col("label"), F.col("source_file"))).select("repo", "source_file", F.lit(True).alias("_has")).distinct()
    names = n.select("id", "repo", "source_file", "label", "full").join(files, ["repo", "source_file"], "left")
    base = F.col("_has").isNull() | is_file_label(F.col("label"), F.col("source_file"))
    aliases = names.select("id", F.explode(alias_forms(F.col("full"), F.col("source_file"), base)).alias("alias")).join(number, "id")
    return {"documents": n.select("id", "repo", "key").join(number, "id").select("doc_id", "repo", "key"), "postings": postings.select("term", "doc_id", "field"), "aliases": aliases.select("alias", "doc_id")}


def key_postings(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(key, field, term): postings by key, a row for each node that has them; without numbers, so nothing is joined."""
    return _exploded(term_lists(_keyed(nodes, paths), "key"), "key")


def frequencies(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """doc_freq of the whole index, made from the nodes: a node's fields are united where they are read, so terms alone are counted and shuffled."""
    return term_lists(_keyed(nodes, paths), "id", merged=True).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


#: Documents of a part of the packed form: a term that all documents have is many rows, none of them large.
PART_BITS = 16


def pack(postings: DataFrame) -> DataFrame:
    """(term, part, packed): postings in the exchange form, sorted; a part holds the documents of one range of numbers."""
    f = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")) - 1
    packed = F.sort_array(F.collect_set(F.shiftleft("doc_id", PACK_BITS).bitwiseOR(f))).alias("packed")
    return postings.groupBy("term", F.shiftright("doc_id", PART_BITS).alias("part")).agg(packed)


def unpack(packed: DataFrame) -> DataFrame:
    """Postings from the exchange form; entries with an unknown field are left out."""
    p = packed.select("term", F.explode("packed").alias("p")).where("p >= 0")
    return p.select("term", F.shiftright("p", PACK_BITS).alias("doc_id"), F.get(F.array(*map(F.lit, FIELDS)), F.col("p").bitwiseAND(F.lit(3)).cast("int")).alias("field")).where("field is not null")


def probe(postings: DataFrame, documents: DataFrame, terms_: list[str], keys: list[str]) -> DataFrame:
    """(term, key, field): which of the terms stand in which of the keys' documents."""
    d = documents.where(F.col("key").isin(keys)).select("doc_id", "key")
    return postings.where(F.col("term").isin(terms_)).join(F.broadcast(d) if len(keys) <= 1000 else d, "doc_id").select("term", "key", "field")


def doc_freq(postings: DataFrame) -> DataFrame:
    """(term, df): documents that have a term in any field. Distinct pairs are found before the shuffle."""
    return postings.select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def scores(index: dict[str, DataFrame], query: str, repos: list[str] | None = None) -> DataFrame:
    """(key, score): for each term ln(1 + N / df) times each field's boost, once for each key and field.

    df and N are of the whole index, whatever repos the candidates are limited to. Scores are rounded to nine places, so
    that equal ones tie whatever order their parts were summed in.
    """
    q = query_terms(query)
    post = index["postings"].where(F.col("term").isin(q)) if q else index["postings"].limit(0)
    n = F.greatest(F.lit(index["documents"].count()), F.lit(1))
    df = doc_freq(post)  # a row for each term of the query
    docs = index["documents"] if repos is None else index["documents"].where(F.col("repo").isin(repos))
    boost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv]), F.col("field")), F.lit(1.0))
    hits = post.join(docs, "doc_id").select("term", "key", "field", boost.alias("w")).groupBy("term", "key", "field").agg(F.max("w").alias("w"))
    return hits.join(df, "term").groupBy("key").agg(F.round(F.sum(F.log(1 + n / F.col("df")) * F.col("w")), 9).alias("score"))


def alias_keys(index: dict[str, DataFrame], query: str, repos: list[str] | None = None) -> DataFrame:
    """(key): keys that have the whole trimmed query as an alias."""
    docs = index["documents"] if repos is None else index["documents"].where(F.col("repo").isin(repos))
    return index["aliases"].where(F.col("alias") == fold_text(query.strip()).lower()).join(docs, "doc_id").select("key").distinct()


def stale_keys(nodes: DataFrame, stale_files: DataFrame) -> DataFrame:
    """(key): semantic nodes on files that changed since; stale_files: repo, source_file."""
    return nodes.where(F.col("origin") == "semantic").join(stale_files, ["repo", "source_file"], "left_semi").select(durable_key(F.col("repo"), F.col("source_file"), F.col("label")).alias("key")).where("key is not null").distinct()


def stats(documents: DataFrame) -> DataFrame:
    """One row: keys that several nodes share, and how many nodes do."""
    many = documents.groupBy("repo", "key").agg(F.count("*").alias("n")).where("n > 1")
    return many.agg(F.count("*").alias("key_collisions"), F.coalesce(F.sum("n"), F.lit(0)).alias("key_collision_nodes"))
