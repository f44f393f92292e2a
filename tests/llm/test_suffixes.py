"""Suffix-sorted dedup against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffixes as S


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + S.LENGTH] for d in data for i in range(len(d) - S.LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - S.LENGTH + 1):
            if seen[d[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = True
        runs = int(gone[0]) + int((np.diff(gone.astype(int)) == 1).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(r.choice([40, 60, 90, 300])) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [text(r.randint(0, 60)) for _ in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts.insert(r.randint(0, len(parts)), s[a : a + r.randint(150, 700)])
        texts.append("".join(parts))
    texts += [texts[0], texts[0], None, "", "a" * 199, "b" * 200, "c" * 201, "d" * 1000, "ab" * 400, shared[0][:200], shared[0][:199], "x" + shared[1][:200], shared[1][:200] + "y"]
    near = list(texts[5])
    if near:
        near[len(near) // 2] = "#"
    texts.append("".join(near))
    return texts


@pytest.mark.parametrize("seed,segment", [(1, S.SEGMENT), (2, S.SEGMENT), (3, 300)])
def test_removed_bytes(spark, seed, segment, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", segment)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, g int").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.deduplicated(df).collect()}
    want = brute(texts)
    bad = [i for i in range(len(texts)) if got[i] != want[i]]
    assert not bad, [(got[i][:3], want[i][:3]) for i in bad[:5]]


@pytest.mark.parametrize("seed", [4, 5])
def test_hot_anchors_give_the_same(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.deduplicated(df, hot=1).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_anchors_of_one_hash_are_told_apart():
    r = random.Random(2)
    grams = [bytes(r.randrange(256) for _ in range(S.GRAM)) for _ in range(2)]
    tail, head = bytes(168), bytes(100)
    rows = [(7, i, 0, 100, head + gram + tail[: 168 - 100] + bytes([i]) * 40) for i, gram in enumerate(grams)]
    assert S.sorted_windows(rows) == []  # the 64-bit number is the same, the bytes are not
    rows = [(7, i, 0, 100, head + grams[0] + tail[: 168 - 100] + bytes([i]) * 40) for i in range(2)]
    assert sorted(S.sorted_windows(rows)) == [(7, 0, 0, 100, 100), (7, 1, 0, 100, 100)]


def test_empty(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_shallow_orders():
    r = random.Random(9)
    for _ in range(40):
        head = bytes(r.randrange(3) for _ in range(S.GRAM))
        base = [bytes(r.randrange(3) for _ in range(r.randint(0, 90))) for _ in range(6)]
        strings = [head + r.choice(base) + r.choice(base)[: r.randint(0, 60)] for _ in range(r.randint(0, 60))]
        group = np.array([r.randrange(3) for _ in strings], np.int64)
        order, lcp = S.deep_shallow(strings, group, S.GRAM)
        want = sorted(range(len(strings)), key=lambda i: (group[i], strings[i]))
        assert [(group[i], strings[i]) for i in order] == [(group[i], strings[i]) for i in want]
        for k in range(len(order)):
            if k and group[order[k]] == group[order[k - 1]]:
                assert lcp[k] == S.common(strings[order[k - 1]], strings[order[k]])
            else:
                assert lcp[k] == -1


def test_common():
    assert S.common(b"abc", b"abd") == 2 and S.common(b"abc", b"abcd") == 3 and S.common(b"", b"x") == 0 and S.common(b"x", b"y") == 0
