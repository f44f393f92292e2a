"""Token counts of whole texts; huge ones in overlapping chunks, spliced at boundaries that are proven stable.

Style: Arrow batches, one pass, no shuffle. A chunk grows only while no place in it is proven stable, so memory is
bounded by a chunk and the longest stretch without such a place, and the work by a small multiple of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import tidied

#: Characters in a chunk, and how far an overlap reaches back before its stable place.
CHUNK, OVERLAP = 32_768, 256
#: What stands for a space in a piece.
SPACE = "▁"


class Counter:
    """Counts by sentencepiece.

    A place between two characters that no piece of the vocabulary has side by side is stable: no token spans it, so
    what lies left of it and right of it is encoded alike whatever the rest is, provided that normalisation leaves the
    characters as they are. Characters outside the vocabulary must fall to bytes, or one of the two must be inside it,
    since unknown neighbours become one token. Two chunks that overlap are spliced at such a place if both have the
    overlap's tokens on their side of it; if one has not, the overlap is widened. Texts that normalisation changes are
    given whole.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.encoded = chunk, overlap, 0
        pieces = [(i, self.sp.id_to_piece(i)) for i in range(self.sp.vocab_size())]
        self.inside = {a + b for _, n in pieces for a, b in zip(n, n[1:], strict=False)}
        self.known = {c for i, n in pieces if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)) for c in n}
        self.to_bytes = any(self.sp.is_byte(i) for i, _ in pieces)

    def parts(self, a: str, b: str) -> bool:
        """Whether no token spans the place between these two characters."""
        a, b = a.replace(" ", SPACE), b.replace(" ", SPACE)
        return a + b not in self.inside and (self.to_bytes or a in self.known or b in self.known)

    def _stable(self, text: str, lo: int, hi: int) -> int | None:
        """The last stable place between two places."""
        return next((x for x in range(hi - 1, lo, -1) if self.parts(text[x - 1], text[x])), None)

    def _ids(self, text: str, lo: int, hi: int) -> list[int] | None:
        """Tokens of a part; None if normalisation changes it."""
        part = text[lo:hi]
        plain = part.replace(" ", SPACE)
        if self.sp.normalize(part) not in (plain, SPACE + plain, plain + SPACE):
            return None
        self.encoded += hi - lo
        return self.sp.encode(part)

    def long(self, text: str) -> int:
        """Tokens of one text, by overlapping chunks: each chunk's tokens left of its stable place and right of the one before."""
        n, start, skip, total, back = len(text), 0, 0, 0, self.overlap
        counted, end = 0, min(n, self.chunk)
        ids = self._ids(text, start, end)
        while ids is not None and end < n:
            x = self._stable(text, counted, end)
            if x is None:  # nothing to splice at: a chunk twice as long
                end = min(n, 2 * end - start)
                ids = self._ids(text, start, end)
                continue
            begin, stop = max(counted, x - back), min(n, end + self.chunk)
            left, overlap, after = (self._ids(text, begin, hi) for hi in (x, end, stop))
            if left is None or overlap is None or after is None:
                return self.whole(text)
            right = overlap[len(left) :]
            if not (overlap[: len(left)] == left == after[: len(left)] and ids[len(ids) - len(right) :] == right):
                if begin == counted:
                    return self.whole(text)
                back *= 2  # not aligned: an overlap twice as wide
                continue
            total += len(ids) - len(right) - skip
            start, counted, skip, end, ids, back = begin, x, len(left), stop, after, self.overlap
        return self.whole(text) if ids is None else total + len(ids) - skip

    def whole(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.sp.encode(text))

    def count(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.chunk]
        got = iter([len(x) for x in self.sp.encode(short, num_threads=1)] if short else [])
        return [next(got) if len(t) <= self.chunk else self.long(t) for t in texts]


_COUNTERS: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row. Null and empty texts have no tokens; repeated rows each count; an empty table gives an empty result."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, chunk, overlap)
        c = _COUNTERS.get(key) or _COUNTERS.setdefault(key, Counter(*key))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(c.count([t or "" for t in part.column(2).to_pylist()]), pa.int64())], schema.names)

    rows = docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), text_col)
    return rows.mapInArrow(tidied(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
