"""The pipeline: each stage on awkward rows against brute force, and near-duplicates at the stage's own settings on real rows."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import rules, simhash
from tessera.llm.common import parted, table

from .test_llm import SCHEMA, brute_cleaned, brute_em, brute_fp, brute_rules, check_sequences, closure, prose, words_of

SF = "/root/testdata/sf0.01"


def shingles(t, k=5):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    texts = [prose(r, r.randint(60, 250)) for _ in range(40)]
    for i in range(15):  # near copies, of which some are too far
        w = texts[i].split(" ")
        for _ in range(i // 2):
            w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    passage = prose(r, 70)
    texts += [f"{prose(r, 60)} {passage} {prose(r, 60)}" for _ in range(4)] + [texts[3], texts[3], None, "", "short", "x y z. " * 60, prose(r, 6000)]
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, rows):
    """What each stage is given and what it returns."""
    docs, out = spark.createDataFrame(rows, SCHEMA).repartition(3), {}
    for name, stage in P.STAGES:
        made = stage(spark, docs, SF)
        got = spark.createDataFrame(made.collect(), made.schema)
        out[name] = (docs, got)
        docs = got
    return out


def test_rules_stage(stages):
    docs, got = stages["quality_rules"]
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in got.collect()}
    m = rules.measured(docs, "m")
    votes = rules.votes("m")
    v = m.select("doc_id", "text", *[x.alias(f"v{i}") for i, x in enumerate(votes)]).collect()
    good = brute_em([[r[f"v{i}"] for i in range(len(votes))] for r in v])
    assert kept == {r["doc_id"] for r, q in zip(v, good) if q >= 0.5 and not brute_rules(r["text"])[5]}
    assert len(kept) > 40


def test_near_duplicates_stage(stages):
    docs, got = stages["near_duplicates"]
    assert got.columns == docs.columns
    d = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps, sets = [brute_fp(t, 5) for _, t in d], [shingles(t) for _, t in d]
    label = closure(len(d), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 16 and alike(sets[a], sets[b]) >= 0.8)
    least = {}
    for (i, _), c in zip(d, label):
        least.setdefault(c, i)
    assert {r["doc_id"] for r in got.collect()} == set(least.values())
    assert len(least) < len(d)


def test_passages_stage(stages):
    docs, got = stages["repeated_passages"]
    assert got.columns == docs.columns
    d = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    texts, _ = brute_cleaned([t for _, t in d], 15)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: t for (i, _), t in zip(d, texts) if words_of(t)}
    assert texts != [t for _, t in d]


def test_weights_and_sequences_stages(stages):
    docs, got = stages["source_weights"]
    assert got.columns == docs.columns
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words_of(r["text"]))
    taken = collections.Counter()
    for r in got.collect():
        taken[r["source"]] += len(words_of(r["text"]))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 3 * len(sizes)
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)
    _, last = stages["sequences"]
    rows = [(r["sequence_id"], r["offset"], r["length"]) for r in last.collect()]
    assert check_sequences(rows, 1024) == last.first()["n_sequences"]
    assert last.first()["n_sequences"] >= last.first()["lower_bound"]
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in got.collect()}


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_stages_of_nulls_alone(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None)], SCHEMA)
    for name, stage in P.STAGES[1:]:
        got = stage(spark, docs, SF)
        if name != "sequences":
            assert got.columns == docs.columns
        assert got.count() == {"near_duplicates": 4, "repeated_passages": 0, "source_weights": 0, "sequences": 4}[name]
    assert P.quality_rules(spark, docs, SF).count() == 0


def test_run_keeps_whole_documents(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    rows = [(r["sequence_id"], r["offset"], r["length"]) for r in got.collect()]
    assert rows and check_sequences(rows, 1024) == got.first()["n_sequences"]


def test_near_duplicates_of_real_rows(spark):
    docs = table(spark, SF, "documents")
    d = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = [shingles(t) for _, t in d]
    pairs = [(a, b) for a in range(len(d)) for b in range(a) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and alike(sets[a], sets[b]) >= 0.8]
    of = {r["doc_id"]: r["component_id"] for r in simhash.groups(docs, 5, 16, 0.8).collect()}
    together = [of[d[a][0]] == of[d[b][0]] for a, b in pairs]
    assert len(pairs) > 50 and sum(together) >= 0.98 * len(pairs)
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[d[a][0]].add(d[b][0])
        near[d[b][0]].add(d[a][0])
    for c in set(of.values()):  # every group is held together by pairs that are that alike
        members = {i for i, x in of.items() if x == c}
        todo, seen = [c], {c}
        while todo:
            for j in near[todo.pop()] & members - seen:
                seen.add(j)
                todo.append(j)
        assert seen == members


@pytest.mark.parametrize("tile,nodes", [(7, 3), (10_000, 512)])
def test_likeness_across_tiles(spark, tile, nodes, monkeypatch):
    """Chains of texts on both sides of the likeness, in many tiles, long texts among them."""
    monkeypatch.setattr(simhash, "SET_NODES", nodes)
    r = random.Random(5)
    texts = []
    for n in (60, 200, 40_000):
        base = [f"w{r.randrange(500)}" for _ in range(n)]
        for _ in range(14 if n < 1000 else 4):
            texts.append(" ".join(base))
            for _ in range(max(1, n // r.choice([30, 60, 100]))):
                base[r.randrange(n)] = f"v{r.randrange(10**6)}"
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("x")).repartition(3)
    fps, sets = [brute_fp(t, 5) for t in texts], [shingles(t) for t in texts]
    label = closure(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 16 and alike(sets[a], sets[b]) >= 0.8)
    least = {}
    for i, c in enumerate(label):
        least[c] = min(i, least.get(c, i))
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(d, 5, 16, 0.8, tile=tile).collect()}
    assert [got[i] for i in range(len(texts))] == [least[c] for c in label]
    assert len(set(label)) > 5


def test_overlaps_are_exact():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, r.integers(0, 90))) for _ in range(40)]
    side = lambda x: (np.array([len(s) for s in x]), np.concatenate(x))
    got = simhash.overlaps(side(sets[:15]), side(sets[15:]), width=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]


def test_a_tile_without_rows_is_passed_over():
    import pyarrow as pa

    run = simhash._compared(4, 2, 4)
    row = lambda p1, i1, p2, j2, own, side, nodes: pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (p1, i1, p2, j2)), pa.array([own]), pa.array([side], pa.int32()), pa.array([nodes], pa.list_(pa.int64())), pa.array([np.zeros(len(nodes), np.int64).tolist()], pa.list_(pa.int64()))], ["p1", "i1", "p2", "j2", "own", "side", "node", "fp"])
    got = list(run(iter([row(0, 0, 0, 1, False, 1, [1, 2]), row(0, 0, 1, 0, False, 0, [3]), row(0, 0, 2, 0, False, 1, [4]), row(1, 0, 1, 1, False, 0, [5]), row(1, 0, 1, 1, False, 1, [6])])))
    assert [(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in got] == [([5], [6])]


def test_stages_leave_no_tables_of_texts_behind(spark, rows, tmp_path):
    """measures with their texts, fingerprints, shingle sets and units stayed on disk for the stages after."""
    from pathlib import Path

    from tessera.llm.common import shared_dir

    made = Path(shared_dir(spark).removeprefix("file:"))
    there = set(made.iterdir())
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        stage(spark, docs, SF).write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(made.iterdir()) - there)
    assert left == ["gone", "mix", "rejected", "spans"]


def test_links_of_size_classes_are_those_of_brute_force(spark):
    """tiles meet by counts of shingles; pairs right at the bound of what counts allow are compared, whatever the tiles."""
    r = random.Random(5)
    sizes = [0, 1, 1, *(round(1.25**k) for k in range(2, 30)), *(4 * 5**k for k in range(5)), *(5**k for k in range(1, 6)), *(r.randint(1, 400) for _ in range(40))]
    rows = [(i, 0 if i % 2 else 7, n, [0] * 16) for i, n in enumerate(sizes)]
    d = spark.createDataFrame(rows, "node long, fp long, n long, sketch array<long>")
    want = {frozenset((a[0], b[0])) for a in rows for b in rows if a[0] < b[0] and min(a[2], b[2]) >= 0.8 * max(a[2], b[2])}
    parts = lambda pairs: closure(len(rows), lambda a, b: frozenset((a, b)) in pairs)
    for tile in (None, 3):
        got = {frozenset((x["a"], x["b"])) for x in simhash.links(d, 16, 0.8, tile).collect()}
        mine, theirs = parts(got), parts(want)
        assert got <= want and len(set(mine)) == len(set(theirs)) == len(set(zip(mine, theirs, strict=True)))


@pytest.mark.parametrize("bits", [8, 1 << 17, 1 << 22])
def test_parted_rows_have_no_key_for_certain(spark, bits):
    """Pipeline: whatever the bits, no row with a key is among the sure ones, none is lost, and wide filters leave few others in the rest."""
    r = random.Random(8)
    hashes = [r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(600)] + [0, -1, bits - 1, bits, -bits, (1 << 63) - 1, -(1 << 63)]
    rows = [(i, h) for i, h in enumerate(hashes)] + [(-1, None), (-2, hashes[0])]
    d, keys = spark.createDataFrame(rows, "i long, _map long"), spark.createDataFrame([(h,) for h in hashes[::3]] + [(None,), (hashes[0],)], "h long")
    sure, rest = (sorted(map(tuple, x.collect())) for x in parted(d, d["_map"], keys, bits))
    assert sorted([*sure, *rest]) == sorted(rows)
    assert not {h for _, h in sure} & set(hashes[::3]) and (-1, None) in sure
    if bits > 8:
        assert len(rest) < len(hashes[::3]) + 10
    empty, full = parted(d, d["_map"], keys.where("h is null"), bits)
    assert (empty.count(), full.count()) == (len(rows), 0)


def test_texts_without_a_match_are_not_shuffled(spark, tmp_path):
    """Pipeline: with joins that sort and merge, each stage sent all texts through a shuffle to drop or cut a few."""
    r, jvm, gate = random.Random(9), spark._jvm, spark.sparkContext._gateway
    texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(1500)) + "." for _ in range(300)]
    texts[:6] = [texts[6], texts[7], "bad # $", f"{texts[8][:3000]}. {texts[9]}", f"{texts[8][:3000]}. {texts[10]}", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gate.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(every.apply(i).shuffleWriteBytes() for i in range(every.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        counts = []
        for _, stage in P.STAGES[:3]:
            before, d = shuffled(), spark.read.parquet(f"{tmp_path}/docs")
            stage(spark, d, SF).write.parquet(out := f"{tmp_path}/{len(counts)}")
            counts.append((shuffled() - before) / sum(map(len, texts)))
            got = spark.read.parquet(out)
            assert 280 < got.count() <= 300 and got.columns == docs.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(counts) < 0.3, counts  # fingerprints, sets of the few that are linked, and units
