"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import mixing, multiset, packing, resample, rules, simhash, suffixes, tokencount, units, warc
from .common import sha256, shared_path, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.groups(table(spark, sf_dir, "documents"), k=4, radius=4)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = units.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before")), spans="spans")
    n = F.coalesce(F.size("spans"), F.lit(0))
    left = F.coalesce(F.char_length("before"), F.lit(0)) - F.coalesce(F.char_length("text"), F.lit(0))
    text = F.coalesce(F.array_join(F.transform("spans", lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ","), F.lit(""))
    return d.select("doc_id", F.coalesce(F.char_length("before"), F.lit(0)).cast("long").alias("n_chars"), F.greatest(n, F.lit(0)).cast("long").alias("n_spans"), left.cast("long").alias("n_removed"), text.alias("removed_spans"), sha256(F.col("text")).alias("kept_sha256"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.compared(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), shared_path(spark, "archive")
    warc.write_archive(pages, path)
    return warc.fields(warc.read_archive(spark, path), pages.schema["page_id"].dataType.simpleString())


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, m = rules.judged(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return df.select("doc_id", *[F.col(f"{m}.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), derive={"ids_crc32": F.crc32})


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_units, op3_suffixes, op4_resample, op5_multiset, op6_warc, op7_rules, op8_mixing, op9_packing, op10_tokens)}

_BLANKS = "[ \\t\\n\\x0b\\x0c\\r]"
_SENTENCES = f"regexp_extract_all(text, '{units.SENTENCE}')"

SQL: dict[str, str] = {
    "op2_units": f"""
with cut as (
  select doc_id, unnest({_SENTENCES}) as part, generate_subscripts({_SENTENCES}, 1) as i from documents where text is not null
), sized as (
  select doc_id, i, cast(length(part) as bigint) as n, trim(regexp_replace(part, '{_BLANKS}+', ' ', 'g')) as bare from cut
), placed as (
  select doc_id, i, sum(n) over w - n as s, sum(n) over w as e, nw, sum(nw) over w as c
  from (select *, case when bare = '' then 0 else length(bare) - length(replace(bare, ' ', '')) + 1 end as nw from sized)
  window w as (partition by doc_id order by i)
), runs as (
  select a.doc_id, a.s, b.e from (select * from placed where nw > 0) a
  asof join (select * from placed where nw > 0) b on a.doc_id = b.doc_id and a.c - a.nw + {units.LEAST} <= b.c
), normal as (
  select r.doc_id, r.s, r.e, trim(regexp_replace(translate(substring(text, cast(r.s + 1 as bigint), cast(r.e - r.s as bigint)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANKS}+', ' ', 'g')) as norm
  from runs r join documents d on r.doc_id = d.doc_id
), ranked as (
  select *, row_number() over w as k, first_value(doc_id) over w as first_id, first_value(e) over w as first_e
  from normal window w as (partition by norm order by doc_id, s)
), gone as (
  select doc_id, s, max(e) as e from ranked where k > 1 and not (doc_id = first_id and s < first_e) group by 1, 2
), islands as (
  select *, sum(fresh) over (partition by doc_id order by s) as island
  from (select *, case when s <= max(e) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from gone)
), spans as (
  select doc_id, cast(min(s) as bigint) as s, cast(max(e) as bigint) as e from islands group by doc_id, island
), pieces as (
  select p.*, text, coalesce(lag(e) over (partition by doc_id order by s), 0) as past from spans p join documents using (doc_id)
), folded as (
  select doc_id, count(*) as n_spans, sum(e - s) as n_removed, string_agg(s || '-' || e, ',' order by s) as removed_spans,
         string_agg(substring(text, past + 1, s - past), '' order by s) || substring(any_value(text), max(e) + 1) as kept
  from pieces group by doc_id
)
select d.doc_id, cast(length(coalesce(d.text, '')) as bigint) as n_chars, cast(coalesce(f.n_spans, 0) as bigint) as n_spans,
       cast(coalesce(f.n_removed, 0) as bigint) as n_removed, coalesce(f.removed_spans, '') as removed_spans, sha256(coalesce(f.kept, d.text, '')) as kept_sha256
from documents d left join folded f on d.doc_id = f.doc_id
""",
    "op6_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select *, min(page_id) over (partition by h) as first from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes, sha256(h) as payload_digest,
       case when strlen(h) >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when strlen(h) >= 100 and page_id <> first then first end as refers_to
from f
""",
}
