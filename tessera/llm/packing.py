"""Best-fit packing of tokenised documents, with certified lower bounds.

Style: Arrow batches for tokens, pandas groups for packing. Pieces are dealt to partitions by hash; each partition is
packed by best-fit decreasing, and dual feasible functions bound from below how many sequences its pieces need, so
its gap is known. While the whole has a gap, partitions with one give the pieces of their slack sequences back; these
are dealt anew among themselves and packed again. Tokens are made once, in one pass, and never shuffled.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import slices, tidied, written

CAPACITY = 1024
#: Pieces in a partition, about: a bound on a task's memory.
PART_ROWS = 50_000
#: Fixed value: how byte-level BPE cuts a text before merging.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them for the file, without added specials.

    A byte-level BPE can be cut before any space that a non-blank follows without a change in its ids, since no
    pre-token has such a space inside. So words repeat, and each distinct one is encoded once. New words go through
    tiktoken with the file's own merges, which is faster and gives equal ids; texts with special strings or with
    blanks in unusual places, and files of any other kind, go through the library whole.
    """

    #: Words kept, at most; the memory they take is bounded, the ids are not changed.
    KEEP = 120_000
    #: Characters encoded at once.
    CHUNK = 1 << 20

    def __init__(self, path: str):
        self.path, self._library = path, None
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.quick = self._quick(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.kept: dict[str, bytes] = {}

    def _quick(self, spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
        if not plain:
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get(a + b) for a, b in merges]
        if None in ids or ids != sorted(ids) or len(set(ids)) < len(ids):
            return None  # ids don't follow the merges' order
        import tiktoken

        chars, special = _byte_chars(), {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        if any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    @property
    def whole(self):
        """The library's tokenizer, loaded when a text first needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _bytes(self, s: str) -> bytes:
        got = self.quick.encode_ordinary(s)
        return struct.pack(f"<{len(got)}I", *got)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of which each word has a non-blank first character, and how many each has."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        if len(self.kept) > self.KEEP:
            self.kept.clear()
        kept, blobs = self.kept, []
        for w in names:
            got = kept.get(w)
            if got is None:
                got = kept[w] = self._bytes(" " + w)
            blobs.append(got)
        first = offsets[:-1]
        for i, at in enumerate(first):  # a text's first word has no space before it
            w = names[index[at]]
            index[at] = len(names) + i
            blobs.append(self._bytes(w) if w else b"")
        pool = np.frombuffer(b"".join(blobs), np.uint32)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[index]
        ends = np.cumsum(n)
        ids = pool[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        per = np.add.reduceat(n, first) if len(first) else n
        return ids, per

    def _odd(self, text: str) -> bool:
        from re import search

        return any(s in text for s in self.special) or search(r" (?:\s|\Z)", text) is not None

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if self.quick is None:
            yield from map(self._slow, texts)
            return
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= self.CHUNK):
                held += len(texts[hi])
                hi += 1
            group = texts[lo:hi]
            odd = [self._odd(t) for t in group]
            ids, per = self._words([t for t, o in zip(group, odd, strict=True) if not o])
            at = iter(np.split(ids, np.cumsum(per)[:-1])) if len(per) else iter(())
            for t, o in zip(group, odd, strict=True):
                yield self._slow(t) if o else next(at)
            lo = hi


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens: whole capacities, with what is over in the first piece."""
    over = n % capacity
    return ([over] if over else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): each row's tokens and end_id, in pieces; ids are little-endian unsigned 32-bit. Null text: empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            rows: list[tuple] = []
            held = 0

            def out(b=b, rows=rows) -> pa.RecordBatch:
                at, piece, start, length, blob = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blob, pa.binary())], schema.names)

            for i, ids in enumerate(enc.encode([t or "" for t in b.column(1).to_pylist()])):
                blob = ids.tobytes() + struct.pack("<I", end_id)
                at = 0
                for k, n in enumerate(cut(len(blob) // 4, capacity)):
                    rows.append((i, k, at, n, blob[4 * at : 4 * (at + n)]))
                    at += n
                held += len(blob)
                if held > 1 << 24:
                    yield out()
                    rows.clear()
                    held = 0
            if rows:
                yield out()

    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece by best-fit decreasing; pieces alike are taken in the order given."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    mask = made = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        free[room - n].append(b)
        mask |= 1 << (room - n)
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> float:
    """Sequences that pieces need at least, not rounded up; counts[n]: pieces of length n.

    The best of dual feasible functions: the identity; with a threshold t, pieces over capacity - t count as whole
    and those under t as nothing; and rounding down to k parts, where a multiple of a (k + 1)-th counts as it is.
    """
    x = np.arange(capacity + 1, dtype=np.float64)
    whole = np.array([np.where(x > capacity - t, capacity, np.where(x < t, 0, x)) for t in range(capacity // 2 + 1)])
    best = whole @ counts / capacity
    parts = []
    for k in range(1, 101):
        up = x * (k + 1)
        parts.append(np.where(up % capacity == 0, x, np.floor(up / capacity) * capacity / k))
    return float(max(best.max(), (np.array(parts) @ counts / capacity).max()))


def _packed_part(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pid")
        n = part["length"].to_numpy()
        bins, offsets = best_fit(n, capacity)
        fill = np.bincount(bins, weights=n).astype(np.int64)
        gap = len(fill) - lower_bound(np.bincount(n, minlength=capacity + 1), capacity)
        return pd.DataFrame({"pid": part["pid"], "length": n, "part": part["part"], "bin": bins, "offset": offsets, "slack": capacity - fill[bins], "gap": gap})

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = 4) -> tuple[DataFrame, int, int]:
    """(pid, sequence_id, offset) from (pid, length), pid unique and length from 1 to capacity; how many sequences that makes; and how many it takes at least.

    Full pieces are sequences of their own. Rounds end when the number of sequences meets the bound of all pieces,
    when a round saves none, or after that many.
    """
    schema = "pid long, length long, part long, bin long, offset long, slack long, gap double"
    todo, whole = rows.where(F.col("length") < capacity).select("pid", "length"), rows.where(F.col("length") >= capacity)
    full = whole.count()
    hist = {r["length"]: r["c"] for r in todo.groupBy("length").agg(F.count("*").alias("c")).collect()}  # capacity rows at most
    counts = np.zeros(capacity + 1)
    for k, c in hist.items():
        counts[k] = c
    need, n, settled, spent = int(np.ceil(lower_bound(counts, capacity) - 1e-9)), int(counts.sum()), [], 0
    best, best_bins, bins = None, 0, 0
    for r in range(rounds):
        parts = max(1, -(-n // part_rows))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("pid", F.lit(r)), F.lit(parts)))
        got = written(dealt.groupBy("part").applyInPandas(_packed_part(capacity), schema), "packed")
        got = got.withColumn("sequence_id", F.lit(r << 58) + F.col("part") * (1 << 24) + F.col("bin"))
        made = got.where("offset = 0").count()
        bins = spent + min(made, best_bins if best is not None else made)
        if best is not None and made >= best_bins:
            settled.append(best)  # nothing saved: as it was
            best = None
            break
        if spent + made <= need or parts == 1 and r:
            settled.append(got)
            best = None
            break
        tight = got.where("slack = 0 or gap <= 1e-9")
        loose = got.where("slack > 0 and gap > 1e-9")
        s = loose.agg(F.count("*"), F.sum(F.when(F.col("offset") == 0, 1).otherwise(0))).first()
        if not s[0] or parts == 1:
            settled.append(got)
            best = None
            break
        settled.append(tight)
        best, best_bins, n = loose, int(s[1]), int(s[0])
        spent += made - best_bins
        todo = loose.select("pid", "length")
    if best is not None:
        settled.append(best)
    out = whole.select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for d in settled:
        out = out.union(d.select("pid", "sequence_id", "offset"))
    return out, full + bins, full + need


def packed(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, part_rows: int = PART_ROWS, derive: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset, n_sequences, lower_bound) for each piece of each row of docs.

    n_sequences: how many sequences there are in all; lower_bound: how many there must be, whatever the packing.
    derive: columns to make from ids, by name, in place of ids. Each row packs on its own, repeated ids and null ids
    included. Null and empty texts give one piece, the end id. An empty table gives an empty result.
    """
    made = {"ids": lambda c: c} if derive is None else derive
    p = pieces(docs, path, end_id, capacity).select("doc_id", "piece", "start", "length", *[f(F.col("ids")).alias(k) for k, f in made.items()])
    p = written(p.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    placed, made, least = pack(p.select("pid", "length"), capacity, part_rows)
    return p.join(placed, "pid").drop("pid").withColumns({"n_sequences": F.lit(made).cast("long"), "lower_bound": F.lit(least).cast("long")})
