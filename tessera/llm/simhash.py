"""SimHash near-duplicate groups: tiled exact comparison of 64-bit fingerprints.

Style: Arrow batches. Fingerprints are made by mapInArrow (one pass, no shuffle). Distinct fingerprints are cut into
tiles by population count; a tile pair whose counts lie further apart than the radius is never formed. A task
compares one tile pair with numpy exclusive-or and bit counts, contracts what it links to a spanning forest, and
returns that forest alone, so a group of n copies yields at most n - 1 links for each tile pair, not n squared.
Comparison is quadratic in the number of distinct fingerprints by nature of the method.

With a likeness, a sketch of the shingle set narrows what is linked, and exact sets decide. Each link of the forests is
held against the two whole sets; groups in which one fails are compared anew, each group by itself, by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import freed, parted, partitions, slices, temporary, text_key, tidied, written
from .components import components

SEED = 42
#: Fingerprints in a tile; a bound on a task's memory, never on what is compared.
TILE = 16_384
#: The same where sketches go along: a tile is sent to every other one that it may hold links with, so larger ones are sent less often.
SKETCH_TILE = 65_536
#: Tile pairs of a task, about.
TASK_PAIRS = 8
#: Hashes gathered before their bits are counted.
GATHER = 1 << 17
#: Lanes of the one-byte MinHash sketch that the optional likeness check reads.
LANES = 128
#: How far below the likeness the sketch may estimate it: some three standard errors of LANES lanes at 0.8. Whole sets decide.
SLACK = 0.1
#: Shingles and nodes in a tile of whole sets, about: bounds on a task's memory.
SET_SHINGLES, SET_NODES = 1 << 19, 512


def shingle_hashes(data: bytes, k: int, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 of each k-word shingle of an ASCII-lowered UTF-8 text, repeats included, in arrays of at most chunk."""
    parts = data.lower().split()
    if not parts:
        return
    joined, ends = b" ".join(parts), list(accumulate(len(w) + 1 for w in parts))
    h = xxhash.xxh64_intdigest
    starts = [0, *ends[:-1]]
    last = ends[k - 1 :] if len(parts) > k else ends[-1:]
    for lo in range(0, len(last), chunk):
        yield np.fromiter((h(joined[s : e - 1], SEED) for s, e in zip(starts[lo : lo + chunk], last[lo : lo + chunk], strict=False)), np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fold(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


_MULTIPLIERS = np.random.default_rng(SEED).integers(1, 1 << 63, LANES, dtype=np.uint64) | np.uint64(1)


def _minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least high word of each lane for each document."""
    out = np.empty((len(starts), LANES), np.uint64)
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    for i, m in enumerate(_MULTIPLIERS):
        x = mixed * m
        out[:, i] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    return out


def fingerprint_texts(texts: list[str | None], k: int, sketch: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Fingerprints (int64) of whole texts and, if asked, counts of distinct shingles and sketches; null and wordless texts have zero."""
    n = len(texts)
    counts, sizes, distinct = np.zeros((n, 64), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    lows = np.full((n, LANES), np.iinfo(np.uint64).max) if sketch else None
    waiting: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if waiting:
            every = np.concatenate(waiting)
            lengths = np.fromiter(map(len, waiting), np.int64)
            starts = np.cumsum(lengths) - lengths
            sums = np.add.reduceat(_bits(every), starts, axis=0, dtype=np.int64)
            np.add.at(counts, owners, sums)
            np.add.at(sizes, owners, lengths)
            if sketch:
                np.minimum.at(lows, owners, _minima(every, starts))
        waiting.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        seen: list[np.ndarray] = []
        for part in shingle_hashes((text or "").encode(), k, GATHER):
            if sketch:
                seen.append(part)
            waiting.append(part)
            owners.append(i)
            held += len(part)
            if held >= GATHER:
                flush()
        if seen:
            distinct[i] = len(np.unique(np.concatenate(seen)))
    flush()
    marks = None
    if sketch:
        mixed = lows * np.uint64(0xD6E8FEB86659FD93)
        marks = (mixed >> np.uint64(56)).astype(np.uint8).view(np.int64)
    return _fold(counts, sizes), distinct, marks


def fingerprints(docs: DataFrame, k: int, sketch: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp[, n, sketch, t1, t2]) for each row; further columns, of whatever name, are left out. Null text: fingerprint 0."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())]
    if sketch:
        fields += [T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType(), False)), T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp, n, marks = fingerprint_texts(b.column(1).to_pylist(), k, sketch)
            cols = [b.column(0), pa.array(fp, pa.int64())]
            if sketch:
                ends = pa.array(np.arange(len(fp) + 1) * (LANES // 8), pa.int32())
                cols += [pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(marks.ravel(), pa.int64())), b.column(2), b.column(3)]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    rows = docs.select(id_col, text_col, *(text_key(text_col) if sketch else []))
    return rows.mapInArrow(tidied(run), T.StructType(fields))


def _pairs_within(a: np.ndarray, b: np.ndarray | None, radius: int, check) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as index pairs into a ++ b, of the links between a and b (b None: within a)."""
    own = b is None
    # numpy counts the bits of a signed number's absolute value
    a = a.view(np.uint64)
    right = a if own else b.view(np.uint64)
    off = 0 if own else len(a)
    root = np.arange(off + len(right))
    made: list[tuple[int, int]] = []
    step = max(1, (1 << 18) // max(1, len(right)))
    for lo in range(0, len(a), step):
        first = lo if own else 0  # within a tile each pair is seen once
        near = np.bitwise_count(a[lo : lo + step, None] ^ right[None, first:]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            j = np.flatnonzero(near[i]) + first
            x = lo + i
            j = j[root[off + j] != root[x]]
            if check is not None and len(j):
                j = j[check(x, j)]
            while len(j):
                y = off + j[0]
                made.append((x, y))
                root[root == root[y]] = root[x]
                j = j[root[off + j] != root[x]]
    e = np.array(made, np.int64).reshape(-1, 2)
    return e[:, 0], e[:, 1]


def _compared(n_keys: int, n_arrays: int, radius: int, checks=None):
    """A mapInArrow function over tiles sorted by pair and side: forests of the links within and between the two tiles of each pair.

    Columns: n_keys keys of a pair, whether its two tiles are one, the side (0 or 1), then n_arrays arrays, nodes and
    fingerprints first. A pair of which one tile has no rows is passed over. checks: from the two sides' arrays a
    function that tells which of the candidates of a row are linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                key = tuple(row.column(i)[0].as_py() for i in range(n_keys))
                own, side = row.column(n_keys)[0].as_py(), row.column(n_keys + 1)[0].as_py()
                now = [row.column(n_keys + 2 + i)[0].values.to_numpy() for i in range(n_arrays)]
                if side == 0 and not own:
                    held = (key, now)
                    continue
                if side == 0:
                    left, right = now, None
                elif held is not None and held[0] == key:
                    left, right = held[1], now
                else:
                    continue
                check = checks(left, right or left) if checks else None
                a, b = _pairs_within(left[1], right[1] if right else None, radius, check)
                if len(a):
                    nodes = left[0] if right is None else np.concatenate([left[0], right[0]])
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return tidied(run)


def _by_sketch(likeness: float):
    def checks(left: list[np.ndarray], other: list[np.ndarray]):
        lanes, lanes2 = (x[3].view(np.uint8).reshape(-1, LANES) for x in (left, other))

        def check(x: int, j: np.ndarray) -> np.ndarray:
            nx, nj = left[2][x], other[2][j]
            fits = np.minimum(nx, nj) >= likeness * np.maximum(nx, nj)
            same = (lanes[x][None, :] == lanes2[j]).mean(axis=1)
            return fits & ((same * 256 - 1) / 255 >= likeness - SLACK)

        return check

    return checks


def links(distinct: DataFrame, radius: int, likeness: float | None = None, tile: int | None = None) -> DataFrame:
    """Links (a, b) that span the components of 'at most radius bits differ' over distinct fingerprints.

    distinct: a row for each node: node (long, unique), fp and, where likeness is given, n and sketch; then links must
    also agree on at least that share of the sketch's lanes, less SLACK, and their counts of distinct shingles (n) must
    allow it. An empty table has no links.
    """
    spark = distinct.sparkSession
    tile = tile or (SKETCH_TILE if likeness else TILE)
    if likeness and likeness < 1:
        # a class is a range of counts, two to a factor of 1 / likeness: classes further apart hold no link, whatever the
        # rounding of a logarithm, since the factor is taken a little wider
        reach = 2
        p = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) * F.lit(reach / (log(1 / likeness) * (1 + 1e-9)))).cast("int")
    else:
        # a class is a few neighbouring population counts, the more the wider the radius; classes this far apart can hold links
        wide = max(1, radius // 4)
        reach = (radius + wide - 1) // wide
        p = F.floor(F.bit_count("fp") / wide).cast("int")
    h = F.xxhash64("fp", "node")
    by = {r["p"]: r["c"] for r in distinct.groupBy(p.alias("p")).agg(F.count("*").alias("c")).collect()}  # 65 rows at most, or a few for each doubling of n
    top = max(by, default=0)
    blocks = [-(-by.get(x, 0) // tile) for x in range(top + 1)]
    m = F.array(*[F.lit(x) for x in blocks])
    cut = F.element_at(m, p + 1)
    more = ["n", "sketch"] if likeness else []
    tiles = (
        distinct.select("node", "fp", *more, p.alias("p"), F.pmod(h, F.greatest(cut, F.lit(1))).cast("int").alias("i"))
        .groupBy("p", "i")
        .agg(F.collect_list(F.struct("node", "fp", *more)).alias("rows"))
    )
    # written once: both copies below read the same tiles
    tiles = written(tiles.select("p", "i", F.col("rows.node").alias("node"), F.col("rows.fp").alias("fp"), *([F.col("rows.n").alias("n"), F.flatten("rows.sketch").alias("sketch")] if likeness else [])), "tiles")
    there = "element_at(blocks, q + 1)"
    every = f"filter(sequence(0, greatest(0, {there} - 1)), j -> j < {there} and %s)"
    upper = f"transform(sequence(p, least({top}, p + {reach})), q -> transform({every % '(q > p or j >= i)'}, j -> named_struct('p1', p, 'i1', i, 'p2', q, 'j2', j)))"
    lower = f"transform(sequence(greatest(0, p - {reach}), p), q -> transform({every % '(q < p or j < i)'}, j -> named_struct('p1', q, 'i1', j, 'p2', p, 'j2', i)))"
    t = tiles.withColumn("blocks", m)
    rest = ["p", "i", "node", "fp", *more]
    copies = t.select(F.explode(F.flatten(F.expr(upper))).alias("pair"), F.lit(0).alias("side"), *rest).union(t.select(F.explode(F.flatten(F.expr(lower))).alias("pair"), F.lit(1).alias("side"), *rest))
    n_pairs = sum(blocks[x] * sum(blocks[x : x + reach + 1]) for x in range(top + 1))
    own = (F.col("p1") == F.col("p2")) & (F.col("i1") == F.col("j2"))
    dealt = copies.select("pair.*", "side", *rest[2:]).select("p1", "i1", "p2", "j2", own.alias("own"), "side", *rest[2:])
    dealt = dealt.repartition(max(partitions(spark), n_pairs // TASK_PAIRS), "p1", "i1", "p2", "j2").sortWithinPartitions("p1", "i1", "p2", "j2", "side")
    return dealt.mapInArrow(_compared(4, 2 + len(more), radius, _by_sketch(likeness) if likeness else None), "a long, b long")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes((t or "").encode(), k)])) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(tidied(run), "node long, shingles array<long>")


def _alike(a: np.ndarray, b: np.ndarray, likeness: float) -> bool:
    """Whether two sets, as sorted arrays, have that share of their union in common; two empty sets have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= likeness * (len(a) + len(b) - both) - 1e-9


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], width: int = 4096) -> np.ndarray:
    """How many hashes each set on the left has in common with each on the right: products of 0-1 matrices over the hashes that both sides have, width at a time.

    A side is the sizes of its sets and their hashes, one set after the other.
    """
    both = np.intersect1d(left[1], right[1])
    sides = []
    for sizes, flat in (left, right):
        at = np.searchsorted(both, flat)
        keep = at < len(both)
        keep[keep] = both[at[keep]] == flat[keep]
        rows = np.repeat(np.arange(len(sizes)), sizes)[keep]
        order = np.argsort(at[keep], kind="stable")
        sides.append((rows[order], at[keep][order]))
    out = np.zeros((len(left[0]), len(right[0])), np.float32)  # exact: counts are far below 2 ** 24
    for lo in range(0, len(both), width):
        parts = []
        for (rows, at), (sizes, _) in zip(sides, (left, right), strict=True):
            a, b = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((len(sizes), min(width, len(both) - lo)), np.float32)
            m[rows[a:b], at[a:b] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def judged_links(found: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(a, b, alike): links held against the whole sets of both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, y = b.column(2), b.column(3)
            good = [_alike(x[i].values.to_numpy(), y[i].values.to_numpy(), likeness) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(good, pa.bool_())], ["a", "b", "alike"])

    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    return found.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a long, b long, alike boolean")


def exact_links(members: DataFrame, sets: DataFrame, radius: int, likeness: float, nodes: int = SET_NODES, shingles: int = SET_SHINGLES) -> DataFrame:
    """Links (a, b) that span the components of 'radius or fewer bits differ and the sets are that alike' inside each label.

    members: label, node, fp, n. A label is cut into tiles by hash, as many as its nodes and shingles ask for; two tiles
    of one label meet in one task.
    """
    spark = members.sparkSession
    blocks = F.greatest(F.ceil(F.count("*") / nodes), F.ceil(F.sum("n") / shingles), F.lit(1)).cast("int")
    sizes = written(members.groupBy(F.col("label").alias("l")).agg(blocks.alias("blocks")), "blocks")
    m = members.join(sizes, F.col("label") == F.col("l")).select("label", "node", "fp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"))
    rows = m.join(sets, "node").groupBy("label", "i").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("node", "fp", F.size("shingles").cast("long").alias("n"), "shingles")).alias("rows"))
    tiles = written(rows.select("label", "i", "blocks", F.col("rows.node").alias("node"), F.col("rows.fp").alias("fp"), F.col("rows.n").alias("n"), F.flatten("rows.shingles").alias("shingles")), "set_tiles")
    pair = lambda a, b: F.struct(F.col("label"), F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), (a == b).alias("own"), (a > b).cast("int").alias("side"))
    dealt = tiles.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: pair(F.col("i"), j))).alias("pair"), "node", "fp", "n", "shingles").select("pair.*", "node", "fp", "n", "shingles")
    dealt = dealt.repartition(partitions(spark), "label", "i", "j").sortWithinPartitions("label", "i", "j", "side")

    def checks(left: list[np.ndarray], other: list[np.ndarray]):
        both = overlaps((left[2], left[3]), (other[2], other[3]))
        good = both >= likeness * (left[2][:, None] + other[2][None, :] - both) - 1e-9
        return lambda x, j: good[x, j]

    return dealt.mapInArrow(_compared(3, 4, radius, checks), "a long, b long")


def _exactly(docs: DataFrame, text_col: str, distinct: DataFrame, found: DataFrame, k: int, radius: int, likeness: float) -> DataFrame:
    """(node, label) of the components of exact links: forests of the sketch's links, each link judged by whole sets, and groups in which one fails compared anew."""
    found = written(found, "links")
    freed(docs.sparkSession)  # the tiles' copies
    linked = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(distinct.join(linked, "node", "left_semi").select(F.col("node"), F.col("t.t1").alias("x1"), F.col("t.t2").alias("x2")), "wanted")
    _, likely = parted(docs.select(F.col(text_col).alias("text"), *text_key(text_col)), F.col("t1"), wanted.select("x1"))
    texts = likely.join(wanted, (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2"))).select("node", "text").dropDuplicates(["node"])
    sets = written(shingle_sets(texts, k), "sets")
    judged = written(judged_links(found, sets, likeness), "judged")
    labels = written(components(found), "labels")
    broken = written(judged.where(~F.col("alike")).select(F.col("a").alias("node")).join(labels, "node").select(F.col("label").alias("l")).distinct(), "broken")
    whole = labels.join(broken, F.col("label") == F.col("l"), "left_anti")
    members = written(labels.join(broken, F.col("label") == F.col("l"), "left_semi").join(distinct.select("node", "fp", "n"), "node"), "members")
    return whole.unionByName(components(exact_links(members, sets, radius, likeness)))


def groups(docs: DataFrame, k: int = 5, radius: int = 4, likeness: float | None = None, id_col: str = "doc_id", text_col: str = "text", tile: int | None = None) -> DataFrame:
    """(id, fp, component_id) for each row of docs: the near-duplicate group it belongs to.

    Two fingerprints link at radius or fewer differing bits and, with likeness, if their sets of shingles have that
    share of their union in common. component_id is the smallest id reachable, the row's own included. Null text and
    texts without words have fingerprint zero and link like any other. Rows with a null id are grouped too; a group of
    such rows alone has a null component_id. Repeated rows share their group. An empty table gives an empty result.
    """
    exact = likeness is not None
    f = written(fingerprints(docs, k, exact, id_col, text_col), "fingerprints")
    same = ["fp", "n", "sketch"] if exact else ["fp"]  # texts alike in all of these are one node
    distinct = f.groupBy(*same).agg(F.min(id_col).alias("rep"), *([F.min(F.struct("t1", "t2")).alias("t")] if exact else []))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id() if exact else F.col("fp")), "distinct")
    found = links(distinct, radius, likeness, tile)
    labels = _exactly(docs, text_col, distinct, found, k, radius, likeness) if exact else components(found)
    named = written(distinct.join(labels, "node", "left").select(*[F.col(c).alias(f"_{c}") for c in same], "rep", F.coalesce("label", "node").alias("label")), "named")
    least = written(named.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    by_node = written(named.join(least, "label").drop("label", "rep"), "by_node")
    on = [F.col(c) == F.col(f"_{c}") for c in same]
    return f.join(by_node, on).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, k: int = 5, radius: int = 16, likeness: float | None = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group the row with its smallest doc_id stays, with all its columns.

    Rows with a null doc_id stay. Of rows that repeat the smallest doc_id, all stay. Null texts and texts without
    words are one group.
    """
    with temporary(docs.sparkSession) as keep:
        grouped = groups(docs.select("doc_id", "text"), k, radius, likeness)
        gone = keep(grouped.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    sure, rest = parted(docs, F.xxhash64(docs["doc_id"]), gone.select(F.xxhash64("_gone")))
    return sure.unionByName(rest.join(gone, rest["doc_id"] == gone["_gone"], "left_anti"))
