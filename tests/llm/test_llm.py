"""The training-data operators against brute force, round trips and awkward rows."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, mixing, multiset, packing, queries, resample, rules, simhash, tokencount, units, warc
from tessera.llm.common import table

WORDS = "the of and to in a is that for on with was as by it from be at this have or an are not but had his they which one you were her all she there would their".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    out = []
    while n > 0:
        k = min(n, r.randint(4, 14))
        out.append(" ".join(r.choice(WORDS) + r.choice(["", "x", "é", "ly"]) for _ in range(k)) + r.choice([".", "!", "?"]))
        n -= k
    return r.choice([" ", "\n"]).join(out)


@pytest.fixture(scope="module")
def corpus():
    """Rows with nulls, empty and blank texts, ties, repeats, copies, near copies and one long text."""
    r = random.Random(5)
    texts = [prose(r, r.randint(3, 160)) for _ in range(60)]
    for _ in range(12):
        t = r.choice(texts[:60]).split(" ")
        t[r.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    texts += [texts[3]] * 5 + ["", None, "  \t\n ", "one", "ONE", "é" * 300, prose(r, 9000)]
    rows = [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[4], "en", "s1", 1), (6, "another text of the same id", "en", "s1", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).withColumn("fp", F.lit(1)).withColumn("size", F.lit("x")).withColumn("r", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_fp(t, k):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def closure(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_simhash_groups(docs, corpus):
    fps = [brute_fp(t[1], 4) for t in corpus]
    label = closure(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    least = {}
    for (i, *_), c in zip(corpus, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = collections.Counter((row[0], fp, least.get(c)) for row, fp, c in zip(corpus, fps, label))
    got = collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.groups(docs, 4, 4).collect())
    assert got == want


def test_simhash_tiles_agree(spark, docs):
    f = docs.sparkSession.createDataFrame([(random.Random(i).getrandbits(63) & 0xFFFFF,) for i in range(300)], "fp long").distinct().withColumn("node", F.col("fp"))
    fps = [r["fp"] for r in f.collect()]
    label = closure(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    want = {frozenset(f for f, c in zip(fps, label) if c == k) for k in set(label)}
    for tile in (7, 64, 10_000):
        got = collections.defaultdict(set)
        for r in components.components(simhash.links(f, 3, tile=tile)).collect():
            got[r["label"]].add(r["node"])
        assert {frozenset(v) for v in got.values()} == {x for x in want if len(x) > 1}


def test_simhash_tiles_see_the_top_bit(spark):
    r = random.Random(9)
    near = [r.getrandbits(64) for _ in range(150)]
    near += [x ^ (1 << 63) ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 3))) for x in near]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in near})
    f = spark.createDataFrame([(x,) for x in signed], "fp long").withColumn("node", F.col("fp"))
    label = closure(len(signed), lambda a, b: ((signed[a] ^ signed[b]) % (1 << 64)).bit_count() <= 4)
    want = {frozenset(x for x, c in zip(signed, label) if c == k) for k in set(label)}
    for tile in (20, 10_000):
        got = collections.defaultdict(set)
        for x in components.components(simhash.links(f, 4, tile=tile)).collect():
            got[x["label"]].add(x["node"])
        assert {frozenset(v) for v in got.values()} == {x for x in want if len(x) > 1}


def test_near_copies_go(docs, corpus, empty):
    kept = simhash.keep_one(docs, 5, 14, 0.8)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    copies = [r[0] for r in corpus if r[1] == corpus[3][1]]
    assert min(copies) in ids and not (set(copies) - {min(copies)}) & ids
    assert simhash.keep_one(empty, 5, 14, 0.8).count() == 0 and simhash.groups(empty).count() == 0


def test_copies_that_repeat_themselves_go(spark):
    r = random.Random(4)
    one, footer = (" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for n in (300, 20))
    texts = [one, f"{one} {one}", one[:900], f"{one} {footer}", f"{one} {' '.join([footer] * 5)}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(d, 5, 32, 0.8).collect()} == {0, 2}
    _, n, _ = simhash.fingerprint_texts(["a b c a b c a b c", None, "a b"], 3, True)
    assert n.tolist() == [3, 0, 1]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    seen = collections.defaultdict(set)
    for a, b in edges:
        seen[a].add(b)
        seen[b].add(a)
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for n in seen:
        todo, found = [n], {n}
        while todo:
            for m in seen[todo.pop()] - found:
                found.add(m)
                todo.append(m)
        if len(found) > 1:
            assert got[n] == min(found)
        else:
            assert n not in got


def brute_units(text, n):
    """(start, end, normal form) of each sentence's shortest run of n words, found word by word."""
    ends = [m.end() for m in re.finditer(r"[.!?]+(?=[\x20\x09-\x0D]|\Z)[\x20\x09-\x0D]*|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*", text)]
    cuts = sorted({0, *ends, len(text)})
    for a in cuts:
        for b in cuts:
            w = text[a:b].encode().lower().split()
            if b > a and len(w) >= n:
                first = text[a : next(c for c in cuts if c > a)].split()
                if first:
                    yield a, b, b" ".join(w)
                break


def brute_cleaned(texts, n):
    first, found = {}, []
    for i, t in enumerate(texts):
        for s, e, d in brute_units(t or "", n):
            found.append((i, s, e, first.setdefault(d, (i, s, e))))
    masks = [[True] * len(t or "") for t in texts]
    for i, s, e, (j, s1, e1) in found:
        if (i, s) != (j, s1) and not (i == j and s < e1):
            masks[i][s:e] = [False] * (e - s)
    return [None if t is None else "".join(c for c, k in zip(t, m) if k) for t, m in zip(texts, masks)], masks


@pytest.mark.parametrize("n", [4, 15])
def test_units(spark, corpus, n):
    texts = [r[1] for r in corpus if r[0] is not None] + ["e.g. v1.2.3 of a.b! Is it?\n\n  New line.\nA b c d e f g.", "x e.g. v1.2.3 of a.b! Is it? New line. A b c d e f g. tail"]
    d = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").withColumn("s", F.lit(1)).repartition(3)
    rows = {r["doc_id"]: r for r in units.cleaned(d, n, spans="e").collect()}
    want, masks = brute_cleaned(texts, n)
    assert [rows[i]["text"] for i in range(len(texts))] == want
    for i, m in enumerate(masks):
        assert sorted(k for x in rows[i]["e"] or () for k in range(x["s"], x["e"])) == [k for k, keep in enumerate(m) if not keep]
        assert rows[i]["s"] == 1 and rows[i]["n_chars"] == (None if want[i] is None else len(want[i]))
    assert any(rows[i]["e"] for i in rows)


def test_units_of_repeated_and_null_ids(spark, docs, corpus, empty):
    out = units.cleaned(docs, spans="cuts")
    assert out.columns == [*docs.columns, "cuts"]
    rows = out.collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r[0] for r in corpus)
    left = collections.defaultdict(set)  # each unit stays in one row's text alone
    for r in rows:
        for _, _, d in brute_units(r["text"] or "", units.LEAST):
            left[d].add((r["doc_id"], r["text"]))
    copies = {r[1] for r in corpus if r[1] == corpus[3][1]}
    assert copies and not [r for r in rows if r["doc_id"] not in (9, None) and r["text"] in copies]
    assert all(len(v) == 1 for v in left.values())
    assert units.cleaned(empty).count() == 0


def test_units_offsets_are_original():
    t = "A first line here now.\nShort.  Second e.g. is long enough. é tail"
    assert "".join(m.group() for m in re.finditer(units.SENTENCE, t)) == t
    assert [t[s:e] for s, e, _ in units.text_units(t, 4)] == ["A first line here now.\n", "Short.  Second e.g. is long enough. ", "Second e.g. is long enough. ", "is long enough. é tail"]


def test_repeated_short_lines_go(spark):
    verse = "O rose!\nThou art sick.\nThe worm,\nunseen.\nSee 3.14 at a.example.org now.\nIt flies in the night.\n"
    texts = [f"Here begins the first text of all. {verse}Its own last words are these.", f"No.\n{verse}Yes.", f"{verse}{verse}", "la la\n" * 20, "One.\nTwo.\nThree.\nFour.\n", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, d, "").collect()}
    assert kept == {0: texts[0], 1: "No.\nYes.", 3: "la la\n" * 8, 4: texts[4]}


def brute_rules(t):
    t = t or ""
    w = words_of(t)
    tri = collections.defaultdict(list)
    for i in range(len(w) - 2):
        tri[tuple(w[i : i + 3])].append(i)
    covered = {p + k for v in tri.values() if len(v) > 1 for p in v for k in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n)


def test_rules(spark, docs, corpus, empty):
    more = [(900, "a b c a b c\na b c\na b c\n# $$ | <x>", "en", "s", 1), (901, "x x x x x x", "en", "s", 1)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([m[:2] for m in more], "doc_id long, text string"))
    df, m = rules.judged(d)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = collections.Counter((r["doc_id"], *[r[m][c] for c in cols]) for r in df.collect())
    assert got == collections.Counter((r[0], *brute_rules(r[1])) for r in [*corpus, *more])
    assert not any(r[m]["kept"] for r in df.collect() if r[m]["base_failed"])
    assert rules.keep_good(docs).columns == docs.columns
    assert rules.keep_good(empty).count() == 0


def brute_em(votes, rounds=200):
    """Document by document, in numpy."""
    v = np.array(votes)
    good = np.where((v < 0).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        logs = []
        for w in (good, 1 - good):
            yes, no = ((v > 0) * w[:, None]).sum(axis=0), ((v < 0) * w[:, None]).sum(axis=0)
            c = (yes + 1) / (yes + no + 2)
            logs.append(np.log((w.sum() + 1) / (len(v) + 2)) + ((v > 0) * np.log(c) + (v < 0) * np.log(1 - c)).sum(axis=1))
        now = 1 / (1 + np.exp(np.minimum(700, logs[1] - logs[0])))
        done = abs(now - good).max() < 1e-9
        good = now
        if done:
            break
    return good


def test_rules_posterior_is_that_of_brute_force(spark):
    df, m = rules.judged(table(spark, "/root/testdata/sf0.01", "documents"), columns=["doc_id"])
    rows = df.select("doc_id", f"{m}.quality", f"{m}.kept", f"{m}.base_failed", *[v.alias(f"v{i}") for i, v in enumerate(rules.votes(m))]).collect()
    n = len(rules.votes(m))
    want = brute_em([[r[f"v{i}"] for i in range(n)] for r in rows])
    assert max(abs(r["quality"] - w) for r, w in zip(rows, want)) < 1e-6
    assert all(r["kept"] == (not r["base_failed"] and w >= 0.5) for r, w in zip(rows, want))
    # one bad vote does not decide: some documents with one stay, some go
    outcomes = {r["kept"] for r in rows if not r["base_failed"] and any(r[f"v{i}"] < 0 for i in range(n))}
    assert outcomes == {True, False}


def test_rules_model_finds_accuracies():
    r = random.Random(3)
    counts = collections.Counter()
    accurate = [0.95, 0.9, 0.9, 0.85, 0.6]
    for _ in range(20_000):
        good = r.random() < 0.8
        counts[tuple(0 if r.random() < 0.1 else (1 if good else -1) * (1 if r.random() < a else -1) for a in accurate)] += 1
    m = rules.fit(list(counts.items()))
    assert abs(m.share[0] - 0.8) < 0.03
    for (good, bad), a in zip(m.accuracies(), accurate):
        assert abs(good - a) < 0.04 and abs(bad - a) < 0.06
    assert m.posterior((1, 1, 1, 1, -1)) > 0.95 and m.posterior((-1, -1, -1, 1, 1)) < 0.1  # a weak rule alone is outvoted
    assert rules.fit([]).share == [0.5, 0.5]


def test_rules_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_rules(spark, sf).withColumnRenamed("quality", "p").join(table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    agree = sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got)
    assert agree > 0.95
    clean = [r["kept"] for r in got if r["quality"] == 1]
    assert sum(clean) / len(clean) > 0.97


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(w[s] for s in rest))
        over = {s for s in rest if w[s] * level > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= over


def test_line_ends_vote_where_they_apply(spark):
    line = "these are more than five words"
    texts = [f"{line}!\n{line};\n{line}:\n{line}。", f"{line}\n{line}", "milk\nbread\nbutter", "一二三四五六七八九十。\n一二三"]
    d = rules.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "m")
    assert [r["v"] for r in d.orderBy("doc_id").select(rules.votes("m")[7].alias("v")).collect()] == [1, -1, 0, 0]


def test_mixing(docs, corpus, empty, monkeypatch):
    sizes = collections.Counter()
    for r in corpus:
        sizes[r[3]] += len(words_of(r[1]))
    want = brute_targets(sizes)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    rows = mixing.mixed(docs).collect()
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    key = lambda rs: sorted(map(str, rs))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20_000)
    assert key(mixing.mixed(docs.repartition(2)).collect()) == key(rows)
    made = mixing.apply_mix(docs)
    assert made.columns == docs.columns
    assert sum(len(words_of(r["text"])) for r in made.collect()) == sum(taken.values())
    assert mixing.mixed(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_packing(spark, docs, corpus, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.packed(docs, path).collect()
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows)
    want = collections.Counter()
    for d, t, *_ in corpus:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, n in enumerate(packing.cut(len(ids))):
            want[d, k, at, n, struct.pack(f"<{n}I", *ids[at : at + n])] += 1
            at += n
    assert got == want
    assert check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 1024) == rows[0]["n_sequences"] >= rows[0]["lower_bound"]
    assert packing.packed(empty, path).count() == 0


def check_sequences(rows, capacity):
    by = collections.defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_pack_rounds(spark):
    r = np.random.default_rng(2)
    n = np.concatenate([r.integers(1, 1024, 3000), [1024] * 5])
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "pid long, length long")
    lengths = dict(enumerate(map(int, n)))
    for size, most in ((200, 1.04), (100_000, 1.005)):
        placed, bins, least = packing.pack(df, part_rows=size)
        rows = placed.collect()
        assert sorted(x["pid"] for x in rows) == list(range(len(n)))
        made = check_sequences([(x["sequence_id"], x["offset"], lengths[x["pid"]]) for x in rows], 1024)
        low = packing.lower_bound(np.bincount(n, minlength=1025).astype(float))
        assert made <= low * most + 2 and bins == made and low <= least <= made


def test_lower_bound_is_one():
    r = random.Random(4)
    for _ in range(60):
        items = [r.randint(1, 10) for _ in range(r.randint(1, 7))]
        counts = np.bincount(items, minlength=11).astype(float)

        def least(rest, bins=()):
            if not rest:
                return len(bins)
            x, *more = rest
            return min([least(more, (*bins[:i], b + x, *bins[i + 1 :])) for i, b in enumerate(bins) if b + x <= 10] + [least(more, (*bins, x))])

        opt = least(items)
        assert packing.lower_bound(counts, 10) <= opt + 1e-9
        assert len(set(packing.best_fit(np.array(items), 10)[0])) >= opt


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    assert enc.quick is not None
    texts = ["", " ", "a", " a", "a ", "a  b", "it's  we'll\n\n x\t y", "<|endoftext|> x <|endoftext|>", "é ñ 漢字 仮名　x", "a b  c", "x\n y", "\n", "12 345,6 7.8!!  ", "a \x1cb", "z" * 3000, "日本 " * 200]
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    enc.CHUNK = 5
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_counts(docs, corpus, empty):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = collections.Counter(tuple(r) for r in tokencount.token_counts(docs, path, chunk=500, overlap=8).collect())
    want = collections.Counter((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t, *_ in corpus)
    assert got == want
    assert tokencount.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(40, 1), (64, 8), (500, 30)])
def test_resynchronised_counts(chunk, overlap):
    path = queries.tokenizer("piece_bpe_32k.model")
    c = tokencount.Counter(path, chunk, overlap)
    r = random.Random(chunk)
    for _ in range(25):
        parts = [r.choice(["word", "é漢", "x" * r.randint(1, 90), " ", "  ", "\n", "\t ", "</s>", "▁", " ▁ ", "a b c d e f", "\U0001f600"]) for _ in range(r.randint(0, 120))]
        t = r.choice(["", " "]).join(parts)
        assert c.count([t]) == [len(c.sp.encode(t))], repr(t)


def test_long_texts_are_counted_in_linear_work():
    c = tokencount.Counter(queries.tokenizer("piece_bpe_32k.model"), 2000, 50)
    r = random.Random(8)
    han = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(60_000))
    texts = [han, "漢字仮名" * 9000, "".join(chr(r.randrange(0x1F300, 0x1F600)) for _ in range(9000)), "word " * 9000, "z" * 9000, "z" * 4000 + han[:9000] + "z" * 4000, " " * 9000, "ab" * 300 + " ▁ " * 3000]
    for t in texts:
        c.encoded = 0
        assert c.count([t]) == [len(c.sp.encode(t))]
        assert c.encoded <= 5 * len(t)
    c.encoded = 0
    c.count([han])
    assert c.encoded <= 1.2 * len(han)  # a stable place is near each chunk's end


def test_warc(spark, tmp_path):
    big, other = "<p>é" + "x" * 120, "y" * 100
    pages = [(5, "u5", big), (2, "u2", big), (9, "u\r\n9", big), (1, None, "tiny"), (3, "u3", "tiny"), (4, "u4", None), (7, "u7", other), (2, "u2", big), (None, "n", other), (None, "m", "z" * 200), (8, "u8", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = str(tmp_path / "a")
    warc.write_archive(df, path)
    r = warc.read_archive(spark, path)
    got = collections.Counter(tuple(x) for x in warc.fields(r).collect())
    want = collections.Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        ids = [p[0] for p in pages if p[2] == h and p[0] is not None]
        again = len(b) >= 100 and bool(ids) and i != min(ids)
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(ids) if again else None] += 1
    assert got == want
    assert r.count() == len(pages) and spark.read.parquet(f"{path}/payloads").count() == len({p[2] or "" for p in pages})
    warc.export_warc(spark, path, str(tmp_path / "w"))
    back = collections.Counter((bytes(x["header"]), bytes(x["block"])) for x in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert back == collections.Counter((bytes(x["header"]), bytes(x["block"])) for x in r.collect())
    bad = r.withColumn("verified", F.lit(False))
    with pytest.raises(Exception, match="digest"):
        warc.fields(bad).collect()
    warc.write_archive(df.limit(0), str(tmp_path / "e"))
    assert warc.fields(warc.read_archive(spark, str(tmp_path / "e"))).count() == 0


def test_multiset(docs, corpus, empty):
    rows = multiset.compared(docs).collect()
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    order = sorted(corpus, key=lambda r: (r[0] is None, r[0] or 0))
    got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
    alone = [i for i, c in collections.Counter(r[0] for r in corpus).items() if c == 1]
    nxt = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1])}
    for i, t, *_ in corpus:
        t = t or ""
        m = len(t) // 2
        if i in alone and nxt[i] is not None:
            follow = [r for r in order if (r[0] is None, r[0] or 0) > (i is None, i or 0)]
            twice = follow and sum(r[0] == follow[0][0] for r in corpus) > 1
            if not twice:
                assert got[i, len(t), h(t[: len(t) - m] + nxt[i][:m])] == 1
    assert sum(got.values()) == len(corpus)
    by = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by.setdefault(r["doc_id"], r["fingerprint"])
    same = [by[r[0]] for r in corpus if r[1] == corpus[3][1] and r[0] is not None]
    assert len(set(same)) == 1
    assert multiset.compared(empty).count() == 0


def spark_hash(seed, unit):
    return xxhash.xxh64_intdigest(unit.encode(), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))


def brute_multiset(t):
    """A fingerprint's 128 one-bit lanes, its text and the number of clauses."""
    units_ = re.split(r"(?<=[.!?;:,|\n])", t)
    h = [[spark_hash(s, u) for u in units_] for s in (*multiset.SEEDS, 31, 37, 41)]
    lanes = [sum(x >> (j + half) & 1 for x in h[s]) for s in (0, 1) for j in range(32) for half in (0, 32)]
    out = "".join(f"{(lanes[k + 1] % 2**16) << 16 | lanes[k] % 2**16:08x}" for k in range(0, 128, 2))
    signed = lambda x: x - 2**64 if x >> 63 else x
    out += "".join(f"{sum(signed(x) % 2**40 for x in h[s]) % 2**40:010x}" for s in (2, 3, 4))
    return np.array(lanes), out + f"{len(units_):08x}", len(units_)


def brute_likeness(a, b):
    if a[1] == b[1]:
        return 1.0
    x, y = 2.0 * a[0] - a[2], 2.0 * b[0] - b[2]
    return float(np.clip(x @ y / np.sqrt((x @ x) * (y @ y)), 0, 1)) if (x @ x) * (y @ y) else 0.0


def test_multiset_is_that_of_brute_force(spark, corpus):
    texts = [r[1] for r in corpus if r[0] is not None][:70] + ["x" * 50_000 + ". y, z" * 4000, "", None, ".", "a.", "é漢.\n" * 7]
    d = spark.createDataFrame([(i * 2, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("r", F.lit(0)).repartition(3)
    rows = sorted(multiset.compared(d).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for t in texts]
    f = [brute_multiset(t) for t in texts]
    for k, (row, t) in enumerate(zip(rows, texts, strict=True)):
        follow, m = (k + 1) % len(texts), len(t) // 2
        g = brute_multiset(t[: len(t) - m] + texts[follow][:m])
        assert (row["doc_id"], row["n_chars"], row["fingerprint"], row["edited_fingerprint"]) == (2 * k, len(t), f[k][1], g[1])
        assert abs(row["near_edited"] - brute_likeness(f[k], g)) < 1e-9 and abs(row["near_next"] - brute_likeness(f[k], f[follow])) < 1e-9


def test_neighbours_of_hot_and_null_ids(spark):
    r = random.Random(3)
    ids = [5] * 300 + [None] * 300 + [r.randrange(1000) for _ in range(300)]
    d = spark.createDataFrame([(i, f"t{k} of {r.random()}") for k, i in enumerate(ids)], "doc_id long, text string")
    h = {x["text"]: x["h"] for x in d.select("text", F.xxhash64("text").alias("h")).collect()}
    got = {x["text"]: x for x in multiset.neighbours(d.repartition(3)).collect()}
    order = sorted(h, key=lambda t: ((i := ids[int(t[1 : t.index(" ")])]) is None, i or 0, h[t]))
    assert all(got[a]["next_text"] == b for a, b in zip(order, order[1:] + order[:1]))
    assert all((got[a]["next_r"], got[a]["next_i"]) == (got[b]["r"], got[b]["i"]) for a, b in zip(order, order[1:] + order[:1]))
    assert max(collections.Counter(x["r"] for x in got.values()).values()) < 250  # neither the hot id nor the null one is one range


def test_multiset_is_homomorphic(spark):
    a = "One thing here.\nAnother thing there, and more.\nThird!"
    b = "Third!\n" + "One thing here.\n" + "Another thing there, and more."
    rows = spark.createDataFrame([(1, a), (2, "\nThird!One thing here.\nAnother thing there, and more."), (3, b)], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in multiset.fingerprinted(rows).collect()}
    assert len(f) == 3
    cl = {r["doc_id"]: sorted(r["c"]) for r in rows.select("doc_id", multiset.clauses(F.col("text")).alias("c")).collect()}
    for x in f:
        for y in f:
            assert (f[x] == f[y]) == (cl[x] == cl[y])


def test_multiset_likeness_tells_edits(spark):
    rows = multiset.compared(table(spark, "/root/testdata/sf0.01", "documents")).where("n_chars > 400").collect()
    better = sum(r["near_edited"] > r["near_next"] for r in rows) / len(rows)
    assert better > 0.95


def brute_features(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(x, resample.SEED) for x in w]
    mask = (1 << 64) - 1
    pairs = [(a * 0x9E3779B97F4A7C15 + b) & mask for a, b in zip(h, h[1:])]
    return [x * 0xD6E8FEB86659FD93 & mask for x in [*h, *(p ^ (p >> 31) for p in pairs)]]


def brute_weights(corpus, good, buckets):
    shift = 65 - buckets.bit_length()
    raw, target = collections.Counter(), collections.Counter()
    per = [[f >> shift for f in brute_features(r[1])] for r in corpus]
    for r, k in zip(corpus, per):
        raw.update(k)
        if r[0] in good:
            target.update(k)
    least = min(30.0, float(np.percentile([c for c in target.values()], 90))) if target else 0
    heavy = sorted((target[k] / raw[k], target[k]) for k in target if target[k] >= least)
    mass = np.cumsum([m for _, m in heavy])
    scale = heavy[int(np.searchsorted(mass, mass[-1] / 2))][0] if heavy else None
    w = lambda k: float(np.float32(np.log((target[k] + 20) / (raw[k] * scale + 20)) + 0.5 * raw[k] * scale / (raw[k] * scale + 20) ** 2)) if heavy else 0.0
    return [(len(k), sum(map(w, k))) for k in per]


@pytest.mark.parametrize("most", [resample.BROADCAST, 0])
def test_resample_is_that_of_brute_force(spark, docs, corpus, most):
    good = {0, 3, 12, 15, 21, 60, 90}
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(9, 1, 1), (6, 0, 0), (None, 1, 0), (999, 1, None)], "doc_id long, quality int, toxic int")
    rows = resample.resampled(docs, labels, share=0.5, buckets=1 << 14, most_broadcast=most).collect()
    want = brute_weights(corpus, good, 1 << 14)
    key = lambda i, n, w: (i is None, i or 0, n, round(w, 4))
    assert sorted(key(r["doc_id"], r["n_features"], r["log_weight"]) for r in rows) == sorted(key(c[0], n, w) for c, (n, w) in zip(corpus, want))
    cut = sorted((r["gumbel_key"] for r in rows), reverse=True)[round(0.5 * len(rows)) - 1]
    assert all(r["kept"] == (r["gumbel_key"] >= cut) for r in rows)


def test_buckets_follow_the_corpus(spark):
    r = random.Random(6)
    d = spark.createDataFrame([(i, " ".join(f"w{r.randrange(30_000)}" for _ in range(200))) for i in range(400)], "doc_id long, text string").repartition(5)
    n = len({f for x in d.collect() for f in brute_features(x["text"])})
    assert abs(resample.distinct_features(d) / n - 1) < 0.06
    small = d.where("doc_id < 3")
    assert resample.distinct_features(small) == len({f for x in small.collect() for f in brute_features(x["text"])})
    assert resample.distinct_features(d.limit(0)) == 0
    assert [resample.bucket_count(n) for n in (0, 10**6, 10**8, 10**10)] == [1 << 17, 1 << 19, 1 << 23, 1 << 26]


def test_resample(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (6, 0, 0), (9, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    n = docs.count()
    a = resample.resampled(docs, labels, share=0.5).collect()
    assert len(a) == n and abs(sum(r["kept"] for r in a) - n / 2) <= 4
    low = min(r["gumbel_key"] for r in a if r["kept"])
    assert all(r["kept"] == (r["gumbel_key"] >= low) for r in a)
    assert sorted(map(str, resample.resampled(docs.repartition(2), labels, share=0.5).collect())) == sorted(map(str, a))
    assert resample.resampled(empty, labels).count() == 0
    assert all(r["kept"] for r in resample.resampled(docs, labels.limit(0)).collect())


def test_kth_largest(spark):
    v = [random.Random(i).choice([0.5, 1.5, i / 7, float(np.nextafter(0.5, 1))]) for i in range(500)]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for k in (1, 7, 250, 500):
        assert resample.kth_largest(df, "v", k, cells=8) == sorted(v, reverse=True)[k - 1]
    assert resample.kth_largest(df, "v", 501) is None and resample.kth_largest(df, "v", 0) is None


def test_crc_is_of_little_endian_ids(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    d = spark.createDataFrame([(1, "hello there world")], "doc_id long, text string")
    r = packing.packed(d, path, derive={"ids_crc32": F.crc32}).first()
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(path).encode("hello there world", add_special_tokens=False).ids, 2]
    assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
