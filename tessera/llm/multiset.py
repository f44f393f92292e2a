"""Homomorphic multiset fingerprints of documents. Native: DataFrame functions alone touch the rows.

A text is the multiset of its paragraphs, cut further into clauses. Each clause hashes to a wide vector: 128 lanes of
one bit and three lanes of a whole hash. A fingerprint is the lanes' sums modulo powers of two with the number of
clauses, so the order of clauses does not matter, and adding or taking away a clause adds or takes away its vector.
The whole-hash lanes tell different multisets apart; the one-bit lanes, each less half the count, are random
projections of the multiset, whose cosine estimates how much two texts share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import partitions, text_key, written

SEEDS = (11, 23)
LANES = 128
#: Two lanes of 32 bits share a long: bit j and bit 32 + j of a hash.
LOW = 0x0000000100000001
WIDE = 1 << 40
#: Ranges of ids in which neighbours are found, at most.
RANGES = 65_536
#: The part of a range for rows whose id is not the range's own.
LAST = (1 << 20) - 1


def clauses(text: Column) -> Column:
    """A text's clauses, blanks and all: cut after each of . ! ? ; : , | and line feeds. An empty text has one, empty."""
    return F.split(text, "(?<=[.!?;:,|\\n])")


def vector(unit: Column) -> list[Column]:
    """64 longs that hold two one-bit lanes each, then three wide lanes."""
    bits = [F.shiftrightunsigned(F.xxhash64(F.lit(s), unit), j).bitwiseAND(F.lit(LOW)) for s in SEEDS for j in range(32)]
    wide = [F.pmod(F.xxhash64(F.lit(s), unit), F.lit(WIDE)) for s in (31, 37, 41)]
    return bits + wide


def _count(lanes: list[Column]) -> list[Column]:
    """Sums of the lanes of a group's clauses, and how many clauses there are."""
    return [F.sum(x).alias(f"v{i}") for i, x in enumerate(lanes)] + [F.count("*").alias("vn")]


def _total(terms: list[Column]) -> Column:
    """A sum as a balanced tree, so that its expression is not deep."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) // 2 * 2 :]
    return terms[0]


def _halves(c: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF))


def _text(name: str) -> Column:
    """The fingerprint as text: the one-bit lanes modulo 2 ** 16, the wide ones modulo 2 ** 40, the count modulo 2 ** 32, in hexadecimal."""
    n = len(SEEDS) * 32
    hexed = lambda c, w: F.lower(F.lpad(F.hex(c), w, "0"))
    low = F.lit(0x0000FFFF0000FFFF)
    squeezed = [F.col(f"{name}{i}").bitwiseAND(low) for i in range(n)]
    pair = [hexed(x.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftrightunsigned(x, 16)), 8) for x in squeezed]
    wide = [hexed(F.pmod(F.col(f"{name}{n + i}"), F.lit(WIDE)), 10) for i in range(3)]
    return F.concat(*pair, *wide, hexed(F.pmod(F.col(f"{name}n"), F.lit(1 << 32)), 8))


def _moments(name: str) -> Column:
    """What a likeness needs of one fingerprint besides its lanes: the number of clauses, the sums of lanes and of their squares."""
    lanes = [h for i in range(len(SEEDS) * 32) for h in _halves(F.col(f"{name}{i}"))]
    return F.struct(F.col(f"{name}n").alias("n"), _total(lanes).alias("s"), _total([x * x for x in lanes]).alias("ss"))


def likeness(a: Column, b: Column, cross: Column, same: Column) -> Column:
    """0 to 1 from the moments of two fingerprints, the sum of their lanes' products and whether they are equal: the cosine of the lanes less half the counts, 0 where it is negative; equal fingerprints are alike."""
    wide = float(LANES)
    d = lambda c: c.cast("double")
    norm = lambda m: 4 * d(m["ss"]) - 4 * d(m["n"]) * d(m["s"]) + wide * d(m["n"]) * d(m["n"])
    dot = 4 * d(cross) - 2 * d(b["n"]) * d(a["s"]) - 2 * d(a["n"]) * d(b["s"]) + wide * d(a["n"]) * d(b["n"])
    cos = F.coalesce(F.try_divide(dot, F.sqrt(norm(a) * norm(b))), F.lit(0.0))
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)))


def fingerprinted(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and fingerprint for each distinct value of keys and text; equal texts have equal fingerprints, whatever the order of their clauses."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    u = docs.select(*keys, *text_key(text_col, "_h1", "_h2"), F.explode(clauses(t)).alias("_u"))
    return u.groupBy(*keys, "_h1", "_h2").agg(*_count(vector(F.col("_u")))).select(*keys, _text("v").alias("fingerprint"))


def _range(d: DataFrame, n: int) -> tuple[Column, int]:
    """(r, how many values it has at most): a range of rows by doc_id and then h, in order, of about an n-th of all rows; null ids last.

    Ranges are bounded by approximate quantiles of the id. An id that is several quantiles at once, and the null id, are
    cut further by the top bits of h, into as many parts as their share asks for.
    """
    some = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("at"), F.sum(F.when(F.col("doc_id").isNull(), 1).otherwise(0)).alias("null"), F.count("*").alias("n")).first()
    at = some["at"] or []
    bounds = sorted(set(at))
    times = {b: 0 for b in bounds}
    for b in at:
        times[b] += 1
    parts = [1, *(times[b] for b in bounds), -(-n * (some["null"] or 0) // max(1, some["n"]))]
    bits = [max(0, (k - 1)).bit_length() for k in parts]  # of h, by range
    array = lambda v, kind: F.array(*map(F.lit, v)).cast(f"array<{kind}>")
    below = lambda v: F.size(F.filter(v, lambda b: b <= F.col("doc_id")))
    kind = d.schema["doc_id"].dataType.simpleString()
    step = max(1, math.isqrt(len(bounds)))
    block = below(array(bounds[::step], kind))  # a search in two steps: blocks, then within one
    place = F.when(block == 0, 0).otherwise((block - 1) * step + below(F.slice(array(bounds, kind), (block - 1) * step + 1, step)))
    index = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(place)
    own = F.col("doc_id").isNull() | F.coalesce(F.get(array(bounds, kind), index - 1) == F.col("doc_id"), F.lit(False))
    b = F.get(array(bits, "int"), index)
    part = F.when((b > 0) & own, F.call_function("shiftright", F.col("h"), 64 - b) + F.call_function("shiftleft", F.lit(1).cast("long"), b - 1)).otherwise(F.when(own, 0).otherwise(LAST))
    return index.cast("long") * (LAST + 1) + part, sum(1 << x for x in bits) + len(bits)


def neighbours(docs: DataFrame) -> DataFrame:
    """(r, i, doc_id, text, next_text, next_r, next_i): each row with the text of the next row by doc_id; after the last comes the first.

    Rows of one doc_id follow by a hash of their text; null ids come last; null texts are empty. A lone row is its own
    next. Ids, numeric, are cut into ranges at approximate quantiles, so that the order is found range by range and no
    task holds all rows; the few rows that end a range get their next text by a join.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    r, _ = _range(d, min(RANGES, 4 * partitions(spark)))
    d = d.withColumn("r", r)
    head = d.groupBy("r").agg(F.min(F.struct("doc_id", "h")).alias("x")).select("r", "x.*").orderBy("r").collect()  # a row for each range at most
    after = {a["r"]: b for a, b in zip(head, [*head[1:], *head[:1]], strict=True)} if head else {}
    schema = f"er long, next_r long, nid {docs.schema['doc_id'].dataType.simpleString()}, nh long"
    ends = spark.createDataFrame([(r, b["r"], b["doc_id"], b["h"]) for r, b in after.items()], schema)
    texts = d.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("nid")) & (F.col("h") == F.col("nh")))
    texts = texts.groupBy("er").agg(F.first("next_r").alias("end_r"), F.first("text").alias("end_text"))
    w = W.partitionBy("r").orderBy(F.col("doc_id").asc_nulls_last(), "h")
    d = d.select("r", "doc_id", "h", "text", F.row_number().over(w).alias("i"), F.lead("text").over(w).alias("follows"))
    d = d.join(texts, d["r"] == texts["er"], "left")
    last = F.col("follows").isNull()
    return d.select("r", "i", "doc_id", "text", F.coalesce("follows", "end_text").alias("next_text"), F.when(last, F.col("end_r")).otherwise(F.col("r")).alias("next_r"), F.when(last, 1).otherwise(F.col("i") + 1).alias("next_i"))


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_text hash, fingerprints and likenesses) for each row of docs.

    The edited text keeps a text's first part and replaces its last floor(n_chars / 2) code points by the next
    document's first as many (or all). near_edited, near_next: likeness to the edited text and to the next document.
    The edit is made on the fingerprint: what the text loses is taken away from its sums and what it gains is added;
    clauses that both have are hashed once. Null texts are empty and have one, empty clause; rows that repeat each
    count; a lone row is its own next; an empty table gives an empty result.
    """
    d = neighbours(docs)
    n = F.char_length("text")
    m = F.floor(n / 2).cast("int")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("kept", F.substring("text", F.lit(1), n - m)).withColumn("gained", F.substring("next_text", F.lit(1), m))
    d = d.withColumn("c", clauses(F.col("kept"))).withColumn("open", F.element_at("c", -1))  # the clause that the cut goes through
    parts = [F.slice("c", F.lit(1), F.size("c") - 1), clauses(F.concat("open", F.substring("text", n - m + 1, m))), clauses(F.concat("open", "gained"))]
    sha = F.unhex(F.sha2(F.encode(F.concat("kept", "gained"), "UTF-8"), 256))
    keys = ["r", "i", "doc_id", "next_r", "next_i", "n_chars"]
    d = d.select(*keys, sha.alias("sha"), *[p.alias(f"p{k}") for k, p in enumerate(parts)])
    u = d.select(*keys, "sha", F.size("p0").alias("both"), (F.size("p0") + F.size("p1")).alias("own"), F.posexplode(F.concat("p0", "p1", "p2")).alias("at", "u"))
    part = F.when(F.col("at") < F.col("both"), 0).when(F.col("at") < F.col("own"), 1).otherwise(2)  # kept, lost, gained
    sums = u.select(*keys, "sha", part.alias("part"), "u").groupBy(*keys, "sha", "part").agg(*_count(vector(F.col("u"))))
    lanes = [*range(len(SEEDS) * 32 + 3), "n"]
    of = lambda name, other: [F.sum(F.when(F.col("part") != other, F.col(f"v{k}")).otherwise(F.lit(0).cast("long"))).alias(f"{name}{k}") for k in lanes]
    f = sums.groupBy(*keys, "sha").agg(*of("f", 2), *of("g", 1))
    cross = _total([x * y for k in lanes[:-4] for x, y in zip(_halves(F.col(f"f{k}")), _halves(F.col(f"g{k}")), strict=True)])
    # fingerprints as bytes, half as long as their text; the next document's are told apart by two hashes of them
    f = f.select(*keys, "sha", F.array(*[F.col(f"f{k}") for k in lanes[:-4]]).alias("lanes"), F.unhex(_text("f")).alias("own"), F.unhex(_text("g")).alias("edited"), _moments("f").alias("m"), _moments("g").alias("em"), cross.alias("cross"))
    near = likeness(F.col("m"), F.col("em"), F.col("cross"), F.col("own") == F.col("edited"))
    f = written(f.select(*keys, "sha", "lanes", "own", "edited", "m", near.alias("near_edited")).withColumns(dict(zip(("k1", "k2"), text_key("own"), strict=True))), "multisets")
    nxt = f.select(F.col("r").alias("xr"), F.col("i").alias("xi"), F.col("lanes").alias("xl"), F.col("m").alias("xm"), F.col("k1").alias("x1"), F.col("k2").alias("x2"))
    j = f.join(nxt, (f["next_r"] == nxt["xr"]) & (f["next_i"] == nxt["xi"]))
    product = F.zip_with("lanes", "xl", lambda a, b: sum(x * y for x, y in zip(_halves(a), _halves(b), strict=True)))
    near = likeness(F.col("m"), F.col("xm"), F.aggregate(product, F.lit(0).cast("long"), lambda t, x: t + x), (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")))
    hexed = lambda c: F.lower(F.hex(c))
    return j.select("doc_id", "n_chars", hexed("sha").alias("edited_sha256"), hexed("own").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"), "near_edited", near.alias("near_next"))
