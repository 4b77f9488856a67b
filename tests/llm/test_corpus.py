import binascii
import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.llm import decontaminate, langid, minhash, shared, suffix_dedup

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# Language identification

@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@tables
def test_language_accuracy(spark, documents):
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "123 !!", "en"), (-3, "", None), (-4, "the and of to in", None)], "doc_id long, text string, lang string")
    df = documents.select("doc_id", "text", "lang").unionByName(extra).withColumns({"id": F.lit("clash"), "score": F.lit(1)})
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [i for i in truth if binascii.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (binascii.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.9 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (-1, -2, -3))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[-4]["lang_pred"] in set(truth.values())


def plain_language(rows, order, s):
    """TF-IDF, FTRL and temperature once more, a number at a time. rows: id -> (text, lang); order: the training ids."""
    wide = (1 << 64) - 1
    p, q, r = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9

    def counts(text):
        if not any(c.isalpha() for c in text or ""):
            return None
        spaced = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).lstrip() + " "
        out = collections.Counter()
        for n in (1, 2, 3):
            for k in range(len(spaced) - n + 1):
                a = [ord(c) for c in spaced[k : k + n]]
                h = a[0] * r if n == 1 else a[0] * p + (a[1] + 1) * q + ((a[2] + 2) * r if n == 3 else 0)
                h &= wide
                out[(((h ^ h >> 29) * p & wide) >> 40) & (s.buckets - 1)] += 1
        return out

    found = {i: counts(t) for i, (t, _) in rows.items()}
    train = [i for i in order if found[i] is not None]
    df = collections.Counter(b for i in train for b in found[i])
    idf = lambda b: math.log((1 + len(train)) / (1 + df[b])) + 1

    def vector(c):
        x = {b: (1 + math.log(n)) * idf(b) for b, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    classes = sorted({rows[i][1] for i in order})
    z, n, shuffled = collections.defaultdict(float), collections.defaultdict(float), np.random.default_rng(s.seed).permutation(len(train))

    def weight(key):
        l1 = 0.0 if key[0] == "bias" else s.l1
        return 0.0 if abs(z[key]) <= l1 else -(z[key] - math.copysign(l1, z[key])) / ((s.beta + math.sqrt(n[key])) / s.alpha + s.l2)

    def scores(x):
        return [sum(v * weight((b, k)) for b, v in x.items()) + weight(("bias", k)) for k in range(len(classes))]

    def soft(v, t=1.0):
        e = [math.exp((a - max(v)) / t) for a in v]
        return [a / sum(e) for a in e]

    for _ in range(s.epochs):
        for j in shuffled[len(train) // 5 :]:
            x, own = vector(found[train[j]]), classes.index(rows[train[j]][1])
            share = soft(scores(x))
            for k in range(len(classes)):
                g = share[k] - (k == own)
                for b, v in [*x.items(), ("bias", 1.0)]:
                    key, d = (b, k), g * v
                    w, new = weight(key), n[key] + d * d
                    z[key] += d - (math.sqrt(new) - math.sqrt(n[key])) / s.alpha * w
                    n[key] = new
    held = [(scores(vector(found[train[j]])), classes.index(rows[train[j]][1])) for j in shuffled[: len(train) // 5]]
    loss = lambda t: -sum(math.log(max(soft(v, t)[y], 1e-12)) for v, y in held)
    temperature = min((math.exp(-4 + 7 * i / 700) for i in range(701)), key=loss)
    out = {}
    for i, c in found.items():
        share = soft(scores(vector(c)), temperature) if c else None
        out[i] = (classes[share.index(max(share))], max(share)) if c else ("und", 0.0)
    seen = [(b, k) for b in df for k in range(len(classes))]
    return out, sum(weight(key) != 0 for key in seen) / len(seen)


def test_language_matches_plain_python(spark):
    rng = random.Random(21)
    stems = {"aa": "kalo mira tosu", "bb": "ßtrek über würn", "cc": "kalo zhem priv"}
    rows = {}
    for i in range(150):
        lang = "abc"[i % 3] * 2
        mixed = stems[lang] if rng.random() < 0.8 else " ".join(stems.values())
        rows[i] = (" ".join(rng.choice(mixed.split()) + rng.choice(["", "s", "!", " 7"]) for _ in range(rng.randint(1, 12))), lang)
    rows |= {150: (None, "aa"), 151: ("12 !", "bb"), 152: (".Kalo, MIRA", "aa"), 153: ("x", "cc")}
    df = spark.createDataFrame([(i, *v) for i, v in rows.items()], "doc_id long, text string, lang string")
    order = [r["doc_id"] for r in df.filter(langid.is_training("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    s = langid.Settings(buckets=1 << 10, l1=0.1)
    want, _ = plain_language(rows, order, s)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, s).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 0.01 for i in rows)


@tables
def test_most_seen_weights_are_zero(documents):
    model = langid.train(documents)
    seen = (model.idf < model.idf.max()).nonzero()[0]
    assert (model.weights[seen] != 0).mean() < 0.5


def test_repeated_ids_and_many_languages(spark):
    rows = [(i % 40, f"{'ab' if i % 2 else 'xy'} word{i}", "one" if i % 2 else "two") for i in range(120)] + [(1000 + i, f"q{i}", f"dirty{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = langid.Settings(languages=2)
    a, b = langid.train(df, s), langid.train(df.repartition(3, "text"), s)
    assert a.classes == b.classes == ["one", "two"] and (a.weights == b.weights).all()


@tables
def test_language_ignores_held_out_labels(documents):
    wrong = documents.withColumn("lang", F.when(langid.is_training("doc_id"), F.col("lang")).otherwise("xx"))
    a, b = langid.train(documents), langid.train(wrong)
    assert a.classes == b.classes and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_language_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()["lang_pred"] == "und"
    t = langid.fit_temperature(np.array([[4.0, 0], [4.0, 0], [4.0, 0], [0, 4.0]]), np.array([0, 0, 1, 1]))
    assert t > 2  # an over-confident model is cooled down


# Suffix arrays

def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    common, shared = line(25), [line(60) for _ in range(4)]
    texts = [None, "", "short", "z" * 700, "ab" * 400, shared[0], shared[0]]
    for _ in range(60):
        texts.append(" ".join(rng.choice([line(rng.randint(1, 40)), common, rng.choice(shared), rng.choice(shared)[rng.randint(0, 150) :]]) for _ in range(rng.randint(1, 4))))
    return texts + texts[10:13]


@pytest.mark.parametrize(("length", "reach", "batch"), [(200, 1 << 19, 1 << 16), (200, 300, 1 << 16), (64, 1 << 19, 3000), (64, 40, 1 << 16)])
def test_repeats_match_brute_force(spark, length, reach, batch):
    texts = corpus(length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"gram": F.lit(1), "windows": F.lit(2), "id": F.lit("x"), "text_hash": F.lit(0)})
    got = {r["doc_id"]: tuple(r[1:]) for r in suffix_dedup.report(df, suffix_dedup.Settings(length, reach, batch)).collect()}
    assert got == dict(enumerate(repeats(texts, length)))


def digest_repeats(texts, length):
    """As repeats, for many texts: windows by their digest."""
    from xxhash import xxh3_128_digest

    data = [t.encode() for t in texts]
    counts = collections.Counter(xxh3_128_digest(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[xxh3_128_digest(d[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def test_frequent_gram(spark):
    """One passage in 11 000 different texts: its grams have more windows than one task may get."""
    rng = random.Random(11)
    line = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, tails = line(120), [line(90) for _ in range(50)]
    texts = [line(90) + passage + (line(90) if i % 20 else rng.choice(tails)) for i in range(11_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[1:]) for r in suffix_dedup.report(df).collect()}
    assert got == dict(enumerate(digest_repeats(texts, 200))) and sum(r[1] > 0 for r in got.values()) >= 500


def test_levels_grow_and_merge(monkeypatch):
    deepest = []

    class Recorded(suffix_dedup.IndexFamily):
        def add(self, keys, names):
            out = super().add(keys, names)
            deepest.append(max(size for size, _, _ in self.levels))
            return out

    monkeypatch.setattr(suffix_dedup, "IndexFamily", Recorded)
    rng = random.Random(4)
    some = lambda n: bytes(rng.choices(b"abc", k=n))
    gram, ends = some(192), [some(5) for _ in range(40)]
    rows = [(1, i, 1 + (i % 997 == 0), some(5) + gram + (some(8) if i % 3 else rng.choice(ends) + some(3))) for i in range(10_500)]
    counts = collections.Counter()
    for *_, n, d in rows:
        counts.update({d[i : i + 200]: n for i in range(len(d) - 199)} if len({d[i : i + 200] for i in range(len(d) - 199)}) == len(d) - 199 else collections.Counter(d[i : i + 200] for i in range(len(d) - 199) for _ in range(n)))
    want = {i: [counts[d[k : k + 200]] > 1 for k in range(len(d) - 199)] for _, i, _, d in rows}
    got = {name: flags.tolist() for _, name, _, flags in suffix_dedup.repeated_windows(iter(rows), 200, 1 << 16)}
    assert got == want and max(deepest) >= 4 and len(deepest) >= 30


def test_pieces_hold_each_window_once():
    rng = random.Random(5)
    data, at = bytes(rng.choices(b"xyz", k=330)), 110
    for depth in range(1, 9):
        starts = sorted(base + k for _, _, base, _, piece in suffix_dedup.divided(data, at, depth, 200) for k in range(len(piece) - 199))
        assert starts == list(range(131))
        for _, core, base, place, piece in suffix_dedup.divided(data, at, depth, 200):
            assert base + place == at and all(core in piece[k : k + 200] for k in range(len(piece) - 199))


def test_one_very_long_run(spark):
    import tracemalloc

    data = np.full(20_000_000, 32, np.uint8)
    tracemalloc.start()
    found = suffix_dedup.anchors(data, 200)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20 and len(found[0]) < 100 and found[5].sum() == len(data) - 199
    tracemalloc.stop()
    df = spark.createDataFrame([(1,), (2,)], "doc_id long").withColumn("text", F.expr("CASE doc_id WHEN 1 THEN repeat(' ', 20000000) ELSE concat('start ', repeat('abc', 100), ' end') END"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.report(df).collect()}
    assert got == {1: (20_000_000, 20_000_000, 1), 2: (310, 300, 1)}


def test_repeated_rows_and_empty_tables(spark):
    text = "x" + "".join(random.Random(1).choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, "other"), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.report(df).collect())
    assert got == [(0, 301), (1, 301), (1, 301), (2, 0)]
    assert suffix_dedup.report(df.limit(0)).count() == 0
    clash = {c: F.lit(5) for c in ("windows", "_repeat_id", "row", "id", "text_hash", "gram.x")}
    out = suffix_dedup.remove_repeats(df.withColumns(clash))
    assert out.columns == ["doc_id", "text", *clash] and sorted(r["text"] for r in out.collect()) == ["", "", "", "other"]


def test_index_family_levels():
    family = suffix_dedup.IndexFamily(4)
    rng = random.Random(2)
    seen: dict[bytes, int] = {}
    for n in range(13):
        keys = sorted({bytes(rng.choice(b"ab") for _ in range(4)) for _ in range(5)})
        names = np.arange(len(keys)) + 100 * n
        found = set(family.add(np.array(keys, "S4"), names).tolist())
        assert {100 * n + i for i, k in enumerate(keys) if k in seen} == {f for f in found if f >= 100 * n}
        seen |= {k: 1 for k in keys}
        sizes = [level for level, _, _ in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)


# Near duplicates

def brute_components(rows, s):
    sets = [minhash.shingle_set(minhash.words_of(t or ""), s.shingle) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= s.percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[k]), root(i)) for k, (i, _) in enumerate(rows)}


def near_copies(seed, groups=3, each=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = [(900, None), (901, ""), (902, "one two"), (903, "ONE\ttwo"), (904, "one two three four five"), (905, "one")]
    for _ in range(groups):
        first = [rng.choice(words) for _ in range(60)]
        for _ in range(each):
            t = list(first)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(60)] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize(("shingle", "block", "fan"), [(4, 1024, 512), (5, 8, 3)])
def test_near_duplicates_match_brute_force(spark, shingle, block, fan):
    s, rows = minhash.Settings(shingle=shingle, block=block, fan=fan), near_copies(shingle)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "kept": F.lit(2), "bands": F.lit("x"), "id": F.lit(3)})
    got = minhash.group_near_duplicates(df, s).collect()
    want = brute_components(rows, s)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicate_edges(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(5, long), (3, long.upper()), (5, long), (7, "different words here today friend"), (None, long), (8, None)]
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.group_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (8, 8, True), (-1, None, False)], key=str)
    assert minhash.group_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "g h i j k", "z")], "doc_id long, text string, lang string")
    kept = minhash.drop_near_duplicates(twice)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2] and set(kept.columns) == {"doc_id", "text", "lang"}


def test_rows_with_null_ids_through_the_stage(spark):
    import corpus_pipeline as P

    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(4, text("a")), (None, text("a")), (None, text("b")), (None, text("b")), (None, text("b") + " end"), (None, text("c")), (None, None), (None, None), (None, "!"), (7, text("d"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], (r["text"] or "-")[0]) for r in P.near_duplicates(spark, df, "").collect())
    assert got == {(4, "a"): 1, (None, "b"): 1, (None, "c"): 1, (None, "-"): 2, (None, "!"): 1, (7, "d"): 1}


def test_rows_are_judged_by_their_texts(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (2, text("a") + " end"), (3, text("e")), (3, text("e")), (3, text("e") + " end"), (3, None), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "r1": F.lit("x"), "m.y": F.create_map(F.lit("k"), F.col("doc_id"))})
    got = minhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    kept = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    shorter = min(kept - collections.Counter(), key=lambda r: r[0] != 3)  # of id 3's two linked texts one stays
    assert shorter[0] == 3 and kept.pop((3, text("e")), 0) + kept.pop((3, text("e") + " end"), 0) == 1
    assert kept == {(1, text("a")): 1, (1, text("b")): 1, (None, text("c")): 1, (None, text("d")): 1, (3, None): 2, (4, ""): 1}
    again = collections.Counter((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(df.repartition(3, "text")).collect())
    assert again == collections.Counter((r["doc_id"], r["text"]) for r in got.collect())


def templated(n, seed):
    """Pages of one template, alike at about 0.59; every 500th is a close copy of the one before."""
    rng = random.Random(seed)
    head, tail = " ".join(f"t{i}" for i in range(40)), " ".join(f"u{i}" for i in range(38))
    rows = []
    for i in range(n):
        own = [f"w{rng.randrange(10**9)}" for _ in range(25)] if i % 500 else [*rows[-1][1].split()[40:64], "x"] if i else ["first"] * 25
        rows.append((i, " ".join([head, *own, tail])))
    return rows


def test_pairs_grow_in_proportion(spark, monkeypatch):
    made = {}

    def counted(df, name):
        out = shared.materialize(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    steps = {}
    for n in (4000, 16_000):
        made.clear()
        got = {r["doc_id"]: r["component_id"] for r in minhash.group_near_duplicates(spark.createDataFrame(templated(n, 3), "doc_id long, text string")).collect()}
        assert got == {i: i - 1 if i and i % 500 == 0 else i for i in range(n)}
        steps[n] = {k: made[k] for k in ("pairs", "likely", "tokens", "rare_pairs", "close_members", "near")}
    assert sum(steps[4000].values()) > 0
    for k, v in steps[16_000].items():
        assert v <= 5 * steps[4000][k] + 100, (k, steps)


@pytest.mark.parametrize("rare", [1, 2, 32])
def test_rare_shingles_lose_no_link(spark, rare):
    """Around the threshold, with frequent and with rare shared shingles."""
    rng = random.Random(rare)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(50)] for _ in range(3)]
    rows = []
    for i in range(240):
        t = list(base[i % 3])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(50)] = rng.choice(words)
        rows.append((i, " ".join(t[: rng.randint(44, 50)])))
    s = minhash.Settings(rare=rare, block=16, fan=8)
    got = minhash.group_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, s)


def test_estimate_is_unbiased(spark):
    s = minhash.Settings()
    maker, rng = minhash.Sketcher(s), random.Random(3)
    rows = []
    for k in range(40):
        a = [f"t{k}_{i}" for i in range(200)]
        b = a[:150] + [f"u{k}_{i}" for i in range(rng.randint(30, 60))]
        x, y = minhash.shingle_set([w.encode() for w in a], 4), minhash.shingle_set([w.encode() for w in b], 4)
        rows.append((len(x & y) / len(x | y), maker.sketch([w.encode() for w in a])[2].tolist(), maker.sketch([w.encode() for w in b])[2].tolist()))
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>")
    error = df.select(F.avg(minhash.estimate("a", "b", s) - F.col("j"))).first()[0]
    assert abs(error) < 0.03


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(20)] + [(500, 400), (500, 400)]
    parent: dict[int, int] = {}

    def root(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else root(parent[i])

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}


# Decontamination

ITEMS = [(1, "What is the name of the tall tower that stands beside the old river bridge in town? It is the copper spire of Vell."), (2, "Tiny item words"), (3, None), (4, "!!"), (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma.")]


def leak_docs():
    rng = random.Random(6)
    fill = lambda n: " ".join(f"f{rng.randint(0, 400)}" for _ in range(n))
    q = ITEMS[0][1]
    docs = [(0, None), (1, ""), (2, fill(300)), (3, fill(120) + " " + q + " " + fill(90)), (4, q.upper().replace(" ", "\n")), (5, fill(10) + q[:60]), (6, fill(40) + " tiny ITEM words " + fill(3)), (7, fill(5000) + " " + ITEMS[4][1]), (8, q.split("?")[0] + " " + fill(20)), (9, " ".join(reversed(q.split())))]
    return docs + [(3, docs[3][1])]


def plain_share(words, part, n=5):
    """Share of a part's distinct n-word sequences among the words'; a shorter part is one sequence."""
    n = min(n, len(part))
    wanted = {" ".join(part[i : i + n]) for i in range(len(part) - n + 1)}
    return sum(any(words[i : i + n] == w.split(" ") for i in range(len(words) - n + 1)) for w in wanted) / len(wanted)


def expected(docs, items, between=32):
    """Without any code of the operator: all passages against all items."""
    split = lambda t: re.findall(r"\w+", t.lower())
    parts = {}
    for i, t in items:
        if t and split(t):
            ends = [m.end() for m in re.finditer(r"[.!?]+\s+", t.rstrip())]
            parts[i] = [p for p in ([split(t[: ends[-1]]), split(t[ends[-1] :])] if ends else [split(t)]) if p]
    step = max((sum(map(len, p)) for p in parts.values()), default=0) + between
    out = []
    for i, text in docs:
        words = split(text or "")
        passages = [words[k : k + 2 * step] for k in range(0, len(words), step)]
        out.append((i, sorted(j for j, p in parts.items() if any(all(plain_share(w, x) >= 0.8 - 1e-9 for x in p) for w in passages))))
    return sorted(out)


@pytest.mark.parametrize("settings", [decontaminate.Settings(), decontaminate.Settings(block=1), decontaminate.Settings(index_items=2)])
def test_leaks(spark, settings):
    docs = leak_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_ids": F.lit(1), "id": F.lit(2), "key": F.lit(3), "row": F.lit(4), "k1": F.lit("k")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_ids"]) for r in decontaminate.find_leaks(df, items, settings).collect())
    assert got == expected(docs, ITEMS)
    assert dict(got)[3] == [1] and dict(got)[9] == [] and dict(got)[8] == [] and dict(got)[6] == [2]
    clean = decontaminate.drop_leaks(df, items, settings)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [i for i, f in got if not f]
    assert decontaminate.find_leaks(df.limit(0), items, settings).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.find_leaks(df, items.limit(0), settings).collect())


def test_parts_of_a_benchmark_change_nothing(spark):
    rng = random.Random(12)
    words = [f"k{i}" for i in range(80)]
    take = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{take(rng.randint(4, 15))}? {take(rng.randint(1, 12))}.") for i in range(40)]
    change = lambda t: " ".join(w if rng.random() < 0.97 else rng.choice(words) for w in t.split())
    docs = [(i, " ".join([take(rng.randint(0, 40)), change(rng.choice(items)[1]), take(rng.randint(0, 60))])) for i in range(120)] + [(7, None), (0, "k1 k2")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    results = []
    for most in (40, 20, 8):
        s = decontaminate.Settings(index_items=most)
        results.append(sorted(map(tuple, decontaminate.find_leaks(df, bench, s).collect()), key=str))
    assert results[0] == results[1] == results[2]
    assert sorted((r[0], r[4]) for r in results[0]) == expected(docs, items) and sum(r[3] for r in results[0]) > 40


def test_wrong_answers_are_clean(spark):
    question, answer = ITEMS[0][1].split("? ")
    docs = [(0, f"{question}? {answer}"), (1, f"{question}? It is a plain wooden hut by the old mill."), (2, f"Nobody asked about anything here at all today. {answer}"), (3, f"{question}? We think: {answer}")]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True}


def test_wand_retrieves_all_above_threshold():
    rng = random.Random(8)
    words = [f"k{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 25)))) for i in range(50)]
    for block in (1, 4, 16):
        index = decontaminate.Index(items, decontaminate.Settings(block=block, threshold=0.4))
        for _ in range(40):
            query = [rng.choice(words) for _ in range(30)]
            ids = np.array([index.term.get(w, -1) for w in query])
            got = {i for _, i in index.candidates(ids, np.zeros(len(ids), np.int64))}
            score = collections.Counter()
            for t in {t for t in ids.tolist() if t >= 0}:
                for i, x in zip(index.at[t], index.impact[t], strict=True):
                    score[i] += x
            assert got == {i for i, x in score.items() if x >= 0.4 - 1e-9}


def test_leak_with_text_between_question_and_answer(spark):
    question, answer = "Which river runs past the old glass mill?", "The slow brown Tarn does."
    items = spark.createDataFrame([(1, f"{question} {answer}"), (2, " ".join(f"w{i}" for i in range(20)) + ".")], "item_id long, text string")
    fill = lambda n: " ".join(f"f{i}" for i in range(n))
    docs = [(n, f"{fill(n)} {question} So the answer here: {answer} {fill(30)}") for n in range(60)]
    docs += [(100, f"{fill(20)} {question} {fill(40)}"), (101, f"{fill(20)} {answer} {fill(40)}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_leaks(df, items).collect()}
    assert got == {i: [1] if i < 100 else [] for i, _ in docs}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, items).collect()} == {100, 101}


def test_verified_parts_are_retrieved():
    rng = random.Random(2)
    words = [f"k{i}" for i in range(400)]
    take = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{take(rng.randint(3, 24))}? {take(rng.randint(1, 60))}.") for i in range(60)]
    index = decontaminate.Index(items, decontaminate.Settings(threshold=0.9))
    low = verified = 0
    for i, (_, text) in enumerate(items):
        question, answer = (decontaminate.words_of(p) for p in decontaminate.question_and_answer(text))
        q, a = len(question) // 6, len(answer) // 6
        tries = [question + answer, question[q:] + answer[a:], [*question[q // 2 : len(question) - q // 2], "x", "y", *answer[: len(answer) - a]], question, answer]
        for passage in tries:
            ids = [index.term.get(w, -1) for w in passage] + [-1]
            found = {j for _, j in index.candidates(np.array(ids), np.zeros(len(ids), np.int64))}
            if index.verify(ids, i) is not None:
                verified += 1
                assert i in found
                low += sum(index.impact[t][index.at[t].index(i)] / index.raised[i] for t in set(ids) if t >= 0 and i in index.at[t]) < 0.9
    assert low > 5 and verified > 100


# The pipeline

@tables
def test_pipeline_matches_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sentence = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34 !!", "en", "s", 8), (-3, "Some words before it. " + sentence, "en", "s", 99)], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    got = {r["doc_id"]: r for r in P.run(spark, sf).collect()}
    rows = docs.unionByName(extra).collect()
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [r for r in rows if r["text"] is not None and model.predict(r["text"])[1] >= P.LEAST_LANGUAGE_SCORE]
    s = minhash.Settings(shingle=5)
    groups = brute_components([(r["doc_id"], r["text"]) for r in rows], s)
    rows = [r for r in rows if groups[r["doc_id"]][1] == r["doc_id"]]
    data = [r["text"].encode() for r in rows]
    counts = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    texts = {}
    for r, d in zip(rows, data, strict=True):
        spans = suffix_dedup.spans_of([{"first": i, "last": i} for i in range(len(d) - 199) if counts[d[i : i + 200]] > 1], 200)
        texts[r["doc_id"]] = "".join(p.decode("utf-8", "ignore") for p in suffix_dedup.kept_parts(d, spans))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i, found in expected(list(texts.items()), items) if found}
    assert -3 not in got and -1 not in got and -2 not in got
    assert set(got) == set(texts) - leaked
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in got.items():
        assert r["ids"] == library.encode(texts[i], add_special_tokens=False).ids
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        assert stage(spark, docs.limit(0), sf).columns == docs.columns, k
