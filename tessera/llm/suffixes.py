"""Substring dedup by suffix sorting: every byte covered by a 200-byte string that starts elsewhere goes.

Style: numpy over Arrow batches, grouping by DataFrame. Sorting all suffixes would order a hundred times what matters.
Each 200-byte window has an anchor, the least-hashed of its 32-byte strings; equal windows have equal anchors in the
same place. So windows fall into runs, one for each anchor, and only anchors whose 32 bytes occur twice are looked at.
Runs alike in all their bytes are repeats as a whole. Those that share an anchor but differ somewhere are suffix
sorted: the suffixes that begin at the anchors, and the reversed prefixes that end there, by a deep-shallow sort
(multikey quicksort to a shallow depth, then blind tries). A window l bytes left of its anchor repeats exactly if
another's left part agrees for l bytes and its right part for 200 - l, which the two orders' common prefixes tell.
An anchor with more than HOT differing runs would be one task's work; its windows are counted by their digests instead,
pre-aggregated and spread over all tasks.

Texts, runs and windows are told apart by 128 bits, anchors by their bytes. Frequent keys: what is aggregated is
written before it is joined, so both sides of a join are plain shuffles, of which adaptive execution splits a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, text_key, tidied, written

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1
#: Bytes hashed at once; a longer text is cut into overlapping segments. Positions in a segment fit 20 bits.
SEGMENT = 1 << 17
#: Bytes that the multikey quicksort looks at.
SHALLOW = 32
#: Differing runs of one anchor that a task sorts at most, and runs that it sorts at once, about.
HOT, AT_ONCE = 20_000, 20_000
#: Texts that a task remembers to have seen, at most; forgetting costs time alone.
SEEN = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(2 * SEGMENT + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def digests(data: bytes, bounds: Iterator[tuple[int, int]]) -> np.ndarray:
    """Two halves of a 128-bit digest of each part of a buffer."""
    d = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([d(data[a:b]) for a, b in bounds]), np.int64).reshape(-1, 2)


def anchor_runs(data: bytes, texts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in a buffer of texts put together.

    texts: where each begins; windows: the starts each has (0 if shorter than LENGTH). Returns text number, first and
    last start (in the buffer), anchor, hash of the anchor's bytes.
    """
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(b)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(b * _UP[:n], out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n + 1 - GRAM]
    hashed = _mixed(grams)
    low = np.uint64((1 << 20) - 1)
    key = (hashed & ~low) | (low - np.arange(len(hashed), dtype=np.uint64))  # of equal hashes the rightmost is least
    width, m = 1, key
    while width * 2 <= SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = SPAN - width
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    starts = np.repeat(texts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    owner = np.repeat(np.arange(len(texts)), windows)
    at = (low - (m[starts] & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return owner[first], starts[first], starts[last], at[first], hashed[at[first]]


def _segments(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Buffers of SEGMENT bytes or so with what is in them: text number, its offset in the text, and windows."""
    parts: list[bytes] = []
    what: list[tuple[int, int, int]] = []
    held = 0
    for i, t in enumerate(texts):
        n = len(t) - LENGTH + 1
        for lo in range(0, max(n, 0), SEGMENT):
            k = min(SEGMENT, n - lo)
            part = t[lo : lo + k + LENGTH - 1]
            if held + len(part) > 2 * SEGMENT - 1:
                yield b"".join(parts), what
                parts, what, held = [], [], 0
            parts.append(part)
            what.append((i, lo, k))
            held += len(part)
    if parts:
        yield b"".join(parts), what


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first two columns the task has not had, so that copies of one text cost little more than one."""
    seen: set[tuple[int, int]] = set()
    for b in slices(batches):
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        if len(seen) > SEEN:
            seen.clear()
        yield b.take(pa.array(fresh, pa.int64()))


def _lo(at: str = "at"):
    return F.shiftright(at, 16)


def _hi(at: str = "at"):
    return _lo(at) + F.shiftright(at, 8).bitwiseAND(F.lit(255))


def _anchor(at: str = "at"):
    return _lo(at) + F.col(at).bitwiseAND(F.lit(255))


def anchors(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(t1, t2, at, g, c1, c2): runs of windows of each text in UTF-8, once or a few times for each text, however many rows have it.

    t1 and t2 stand for the text, g for the anchor's bytes, c1 and c2 for all the run's bytes. at: the run's first
    start, above 16 bits; how much further its last one lies, above 8; how much further the anchor lies.
    """
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("t1", "t2", "at", "g", "c1", "c2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _unseen(batches):
            keys = [b.column(i).to_numpy() for i in (0, 1)]
            for data, what in _segments([x or b"" for x in b.column(2).to_pylist()]):
                no, off, k = (np.array(x, np.int64) for x in zip(*what, strict=True))
                begin = np.concatenate([[0], np.cumsum(k + LENGTH - 1)[:-1]])
                own, lo, hi, pos, g = anchor_runs(data, begin, k)
                at = (lo + off[own] - begin[own]) << 16 | (hi - lo) << 8 | (pos - lo)
                c = digests(data, zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True))
                cols = [keys[0][no[own]], keys[1][no[own]], at, g.view(np.int64), c[:, 0], c[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema.names)

    return docs.select(*text_key(text_col), F.encode(text_col, "UTF-8")).mapInArrow(tidied(run), schema)


def common(a: bytes, b: bytes, frm: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to frm."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[frm:n], "big") ^ int.from_bytes(b[frm:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], ids: list[int], depth: int) -> list[tuple[int, int]]:
    """ids in the order of their strings, which agree up to depth, each with the length of its common prefix with the one before (first: depth).

    A node has the depth at which its strings part, and children by the byte there (-1: the string ends). To insert, the
    trie is gone down by those bytes alone, blind to what lies between; one comparison with the leaf found tells where
    the string parts from it, and a second descent puts it there.
    """
    root: list | int = ids[0]
    alike: dict[int, list[int]] = {ids[0]: [ids[0]]}

    def byte(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    for i in ids[1:]:
        s = strings[i]
        node = root
        while isinstance(node, list):
            child = node[1].get(byte(s, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        d = common(s, strings[node], depth)
        if d == len(s) == len(strings[node]):
            alike[node].append(i)
            continue
        alike[i] = [i]
        above, node = None, root
        while isinstance(node, list) and node[0] < d:
            above, node = node, node[1][byte(s, node[0])]
        if isinstance(node, list) and node[0] == d:
            node[1][byte(s, d)] = i
            continue
        leaf = node
        while isinstance(leaf, list):
            leaf = next(iter(leaf[1].values()))
        split = [d, {byte(strings[leaf], d): node, byte(s, d): i}]
        if above is None:
            root = split
        else:
            above[1][byte(s, above[0])] = split
    out: list[tuple[int, int]] = []
    stack: list[tuple[list | int, int]] = [(root, depth)]
    while stack:
        node, lcp = stack.pop()
        if isinstance(node, list):
            kids = sorted(node[1].items(), reverse=True)
            stack += [(kid, node[0]) for _, kid in kids[:-1]]
            stack.append((kids[-1][1], lcp))
        else:
            for k, i in enumerate(alike[node]):
                out.append((i, lcp if k == 0 else len(strings[i])))
    return out


def deep_shallow(strings: list[bytes], group: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings within groups, and each one's common prefix with the one before; -1 where a group begins.

    Strings of a group agree up to known. Shallow: multikey quicksort, eight bytes a character, on all open segments at
    once: each is parted into less than, equal to and greater than its middle string's character; the equal part goes
    on to the next one. Deep: segments that still agree after SHALLOW bytes are ordered by blind tries.
    """
    n = len(strings)
    wide = b"".join(s[known : known + SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    words = np.frombuffer(wide, ">u8").reshape(n, SHALLOW // 8).astype(np.uint64) if n else np.zeros((0, SHALLOW // 8), np.uint64)
    order = np.argsort(group, kind="stable")
    seg = np.cumsum(np.concatenate([[0], (np.diff(group[order]) != 0).astype(np.int64)])) if n else np.zeros(0, np.int64)
    at = np.zeros(n, np.int64)  # by place: characters that the segment agrees on
    while n:
        sizes = np.bincount(seg)
        open_ = np.flatnonzero((sizes[seg] > 1) & (at < SHALLOW // 8))
        if not len(open_):
            break
        s, o = seg[open_], order[open_]
        first = np.cumsum(sizes) - sizes
        pivot = words[order[(first + sizes // 2)[s]], at[open_]]
        own = words[o, at[open_]]
        side = np.where(own < pivot, 0, np.where(own == pivot, 1, 2))
        turn = np.lexsort((side, s))
        order[open_] = o[turn]
        grown = at[open_] + (side == 1)
        at[open_] = grown[turn]
        three = seg * 3
        three[open_] += side[turn]
        seg = np.cumsum(np.concatenate([[0], (np.diff(three) != 0).astype(np.int64)]))
    lcp = np.full(n, -1, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(seg) != 0])) if n else []
    ends = [*begins[1:], n]
    for a, b in zip(begins, ends, strict=False):
        if b - a > 1:
            found = blind_trie(strings, order[a:b].tolist(), known + min(SHALLOW, min(len(strings[i]) - known for i in order[a:b])))
            order[a:b] = [i for i, _ in found]
            lcp[a + 1 : b] = [x for _, x in found[1:]]
        if a and group[order[a]] == group[order[a - 1]]:
            lcp[a] = common(strings[order[a - 1]], strings[order[a]], known)
    return order, lcp


def _classes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """A number for each string: equal where strings of a group agree for depth bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def repeated_windows(group: np.ndarray, lefts: list[bytes], rights: list[bytes], least: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int]]:
    """(run, a, b): windows from a to b bytes left of the anchor that another run of the group has too.

    lefts: what lies before each anchor, reversed; rights: what begins there; least and most: the run's own windows.
    """
    lo, lo_lcp = deep_shallow(lefts, group)
    ro, ro_lcp = deep_shallow(rights, group, GRAM)
    out: list[tuple[int, int, int]] = []
    open_: dict[int, int] = {}
    for d in range(SPAN + 1):
        hit: set[int] = set()
        own = np.flatnonzero((least <= d) & (d <= most)) if d < SPAN else np.zeros(0, np.int64)
        if len(own) > 1:
            both = _classes(ro, ro_lcp, LENGTH - d)[own] * (len(lefts) + 1) + _classes(lo, lo_lcp, d)[own]
            _, place, count = np.unique(both, return_inverse=True, return_counts=True)
            hit = set(own[count[place] > 1].tolist())
        for i in open_.keys() - hit:
            out.append((i, open_.pop(i), d - 1))
        for i in hit - open_.keys():
            open_[i] = d
    return out


RUNS = "g long, c1 long, c2 long, off long, s binary"
FOUND = "g long, c1 long, c2 long, a long, b long"


def sorted_windows(rows: list[tuple]) -> list[tuple[int, int, int, int, int]]:
    """(g, c1, c2, a, b) of runs (g, c1, c2, anchor's place, bytes): which of their windows, a to b bytes left of the anchor, others have too. Anchors are told apart by their bytes."""
    number: dict[tuple[int, bytes], int] = {}
    group = np.array([number.setdefault((r[0], r[4][r[3] : r[3] + GRAM]), len(number)) for r in rows], np.int64)
    lefts, rights = [r[4][: r[3]][::-1] for r in rows], [r[4][r[3] :] for r in rows]
    most = np.array([r[3] for r in rows], np.int64)
    least = np.array([r[3] - (len(r[4]) - LENGTH) for r in rows], np.int64)
    return [(*rows[i][:3], a, b) for i, a, b in repeated_windows(group, lefts, rights, least, most)]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["g", "c1", "c2", "a", "b"])


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for b in slices(batches):
        for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if len(rows) >= AT_ONCE and r[0] != rows[-1][0]:
                yield _found(sorted_windows(rows))
                rows = []
            rows.append(r)
    if rows:
        yield _found(sorted_windows(rows))


def counted_windows(runs: DataFrame) -> DataFrame:
    """(g, c1, c2, a, b) of differing runs, as sorting gives them, by counting windows' digests: for anchors with very many runs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            at, left, d = [], [], []
            for i, (off, s) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                n = len(s) - LENGTH + 1
                at += [i] * n
                left += range(off, off - n, -1)
                d.append(digests(s, ((x, x + LENGTH) for x in range(n))))
            w, take = np.concatenate(d), pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(left, pa.int64()), pa.array(w[:, 0]), pa.array(w[:, 1])], ["g", "c1", "c2", "d", "w1", "w2"])

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for *key, places in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                d = np.sort(np.array(places, np.int64))
                ends = np.flatnonzero(np.diff(d) > 1)
                rows += [(*key, x, y) for x, y in zip(d[np.append(0, ends + 1)].tolist(), d[np.append(ends, len(d) - 1)].tolist(), strict=True)]
            yield _found(rows)

    w = written(runs.mapInArrow(tidied(cut), "g long, c1 long, c2 long, d long, w1 long, w2 long"), "hot_windows")
    two = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))  # runs differ: equal windows of one run do not exist
    again = written(w.groupBy("w1", "w2").agg(two.alias("two")).where("two").select("w1", "w2"), "hot_repeats")
    hit = w.join(again, ["w1", "w2"]).groupBy("g", "c1", "c2").agg(F.collect_set("d").alias("d"))  # a run has SPAN windows at most
    return hit.mapInArrow(intervals, FOUND)


def removed(docs: DataFrame, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(t1, t2, spans): for each text that loses something, the windows' extents (s, e) in bytes of UTF-8.

    Rows alike in text are looked at once; whole texts that repeat are not listed for that.
    """
    a = written(anchors(docs, text_col), "anchors")
    place = F.xxhash64("t1", "t2", _lo())  # only places of one anchor are held against each other
    twice = written(a.groupBy("g").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("g"), "twice")
    b = written(a.join(twice, "g"), "candidates")
    run = ["g", "c1", "c2"]
    ctx = b.groupBy(*run).agg(F.min(place).alias("x"), F.max(place).alias("y"), *[F.first(c).alias(c) for c in ("t1", "t2", "at")])
    ctx = written(ctx.select(*run, (F.col("x") != F.col("y")).alias("whole"), "t1", "t2", "at"), "contexts")
    several = written(ctx.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", (F.col("n") > hot).alias("hot")), "several")
    reps = ctx.join(several, "g")
    lists = reps.groupBy(F.col("t1").alias("u1"), F.col("t2").alias("u2")).agg(F.collect_list(F.struct(*run, "at", "hot")).alias("runs"))
    lists = written(lists, "lists")  # a text's own runs alone
    texts = docs.select(*text_key(text_col), F.encode(text_col, "UTF-8").alias("bytes")).join(lists, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unseen(batches):
            for t, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for lo in range(0, len(runs), 20_000):
                    part = runs[lo : lo + 20_000]
                    cols = [pa.array([r[c] for r in part], pa.int64()) for c in run]
                    where = [(r["at"] >> 16, r["at"] >> 8 & 255, r["at"] & 255) for r in part]
                    cols += [pa.array([off for _, _, off in where], pa.int64()), pa.array([t[x : x + more + LENGTH] for x, more, _ in where], pa.binary()), pa.array([r["hot"] for r in part], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(cols, [*run, "off", "s", "hot"])

    runs = texts.select("t1", "t2", "bytes", "runs").mapInArrow(tidied(cut), f"{RUNS}, hot boolean")
    runs = written(runs.dropDuplicates(run), "runs")
    few = runs.where("not hot").drop("hot").repartition("g").sortWithinPartitions(*run)
    parts = written(few.mapInArrow(tidied(_sorted_runs), FOUND), "windows")
    if not several.where("hot").isEmpty():
        parts = parts.unionByName(written(counted_windows(runs.where("hot").drop("hot")), "counted"))
    some = b.join(parts, run).select("t1", "t2", (_anchor() - F.col("b")).alias("s"), (_anchor() - F.col("a") + LENGTH).alias("e"))
    every = b.join(ctx.where("whole").select(*run), run).select("t1", "t2", _lo().alias("s"), (_hi() + LENGTH).alias("e"))
    return some.union(every).groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row: what is left of each text, in bytes.

    A byte goes if a string of 200 bytes that covers it also starts anywhere else, in the same text or another's;
    matches never cross texts, and are judged on the input. Null texts are empty; texts under 200 bytes lose nothing;
    texts that occur twice, from 200 bytes on, lose everything in every copy, rows that repeat an id included. n_spans:
    maximal removed runs. An empty table gives an empty result.
    """
    spans = removed(docs, text_col, hot)
    copies = docs.groupBy(*text_key(text_col, "k1", "k2")).agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2", F.lit(True).alias("all"))
    marks = spans.join(copies, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")), "full")
    marks = written(marks.select(F.coalesce("t1", "k1").alias("m1"), F.coalesce("t2", "k2").alias("m2"), F.coalesce("all", F.lit(False)).alias("all"), F.when(F.col("all").isNull(), F.col("spans")).alias("spans")), "marks")
    text = F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col), *text_key(text_col), text.alias("bytes")).join(marks, (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")), "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.octet_length("bytes").cast("long").alias("e")))
    rows = rows.select(id_col, "bytes", F.when(F.col("all") & (F.octet_length("bytes") >= LENGTH), whole).otherwise(F.col("spans")).alias("spans"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, n, kept = 0, 0, []
                for x in sorted((x["s"], x["e"]) for x in s or ()):
                    if n == 0 or x[0] > at:
                        n += 1
                        kept.append(t[at : x[0]])
                    at = max(at, x[1])
                kept.append(t[at:])
                left = b"".join(kept)
                out.append((len(t), len(t) - len(left), n, left))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.binary())], schema.names)

    return rows.mapInArrow(tidied(run), schema)
