"""Mixing, fingerprints, near-duplicates, classifiers, nearest neighbours and the pipeline."""

import itertools
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, common, fingerprints, mixing, near_dedup, quality, shingles, toxicity


def words(n, seed, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# Mixing


def test_poisson_counts(spark, documents):
    df = documents([(i, f"t{i}", "big" if i % 3 else None) for i in range(3000)])
    out = mixing.mix(df, {"big": 1.0}, rest=3.0, epochs=2.0).toPandas()
    assert len(out) == pytest.approx(6000, rel=0.1)
    assert out.source.isna().sum() == pytest.approx(4500, rel=0.1)
    per = out.groupby("doc_id").size()
    none = per[per.index % 3 == 0]
    rate = 4.5
    assert (none >= 8).sum() / 1000 == pytest.approx(1 - sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(8)), abs=0.04)
    again = mixing.mix(df.repartition(5), {"big": 1.0}, rest=3.0, epochs=2.0).toPandas()
    columns = ["doc_id", "replica", "shuffle_key"]
    assert sorted(out[columns].itertuples(index=False)) == sorted(again[columns].itertuples(index=False))
    assert mixing.mix(df, {"big": 0.0}).filter("source = 'big'").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0


def test_many_sources_take_the_salted_join(spark, documents, monkeypatch):
    df = documents([(i, "t", f"s{i % 7}" if i % 8 else None) for i in range(200)])
    want = mixing.mix(df).select("doc_id", "replica").toPandas()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    assert sorted(mixing.mix(df).select("doc_id", "replica").toPandas().itertuples(index=False)) == sorted(want.itertuples(index=False))


# Fingerprints


def jaccard(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_collision_rate_is_generalised_jaccard(spark):
    rows, want = [], []
    for at in range(12):
        a = words(300, at)
        b = a[: 25 * at] + words(300 - 25 * at, 100 + at)
        rows += [(2 * at, " ".join(a)), (2 * at + 1, " ".join(b))]
        want.append(jaccard(a, b))
    df = spark.createDataFrame(rows, "id long, text string")
    sig = {r.id: r.signature for r in fingerprints.signatures(df, ["id"], "text", 256).collect()}
    found = [np.mean(np.array(sig[2 * at]) == np.array(sig[2 * at + 1])) for at in range(12)]
    assert np.abs(np.array(found) - want).max() < 0.11 and np.abs(np.mean(np.array(found) - want)) < 0.025


def test_likeness_of_the_query_against_the_exact_one(spark, documents, sf):
    rows = []
    for at in range(60):
        base = words(200, at)
        rows.append((at, " ".join(base if at % 2 else words(200, at + 1)[: 3 * at] + base[3 * at :]), "s"))
    found = {r.doc_id: r for r in fingerprints.op5_fingerprints(spark, sf(documents=documents(rows))).collect()}
    gaps = []
    for at, text, _ in rows:
        after = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        for got, other in ((found[at].near_edited, text[: len(text) - half] + after[:half]), (found[at].near_next, after)):
            want = jaccard(text.split(), other.split())
            gaps.append((got - want) / max(0.03, math.sqrt(want * (1 - want) / fingerprints.SAMPLES)))
    assert abs(np.mean(gaps)) < 0.3 and 0.6 < np.std(gaps) < 1.3 and np.abs(gaps).max() < 4.5


def test_outlying_ids_leave_no_block_large(spark):
    ids = [*range(5000), *range(10**9, 10**9 + 3000), 10**12, -(10**15)]
    facts = [F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")]
    found = fingerprints.in_blocks(spark.createDataFrame([(i,) for i in ids], "id long")).groupBy("block").agg(*facts).collect()
    assert max(r.n for r in found) <= fingerprints.CROWDED * fingerprints.BLOCK_ROWS and sum(r.n for r in found) == len(ids)
    ordered = sorted(found, key=lambda r: r.low)
    assert all(a.high < b.low for a, b in itertools.pairwise(ordered))
    assert fingerprints.in_blocks(spark.createDataFrame([(7,)] * 2000, "id long")).groupBy("block").count().count() == 1


def test_fingerprint_query(spark, documents, sf):
    rows = [(0, "a b c", "s"), (7, None, "s"), (7, " ", "s"), (300, "日本 " + " ".join(words(2000, 1)), "s"), (301, "日本 " + " ".join(words(2000, 1)), "s"), (10**9, "End TEXT", "s"), (5, "x", "s")]
    folder = sf(documents=documents(rows))
    found = fingerprints.op5_fingerprints(spark, folder).collect()
    ordered = sorted(((i, t or "") for i, t, _ in rows))
    import hashlib

    want = []
    for at, (i, t) in enumerate(ordered):
        nxt, half = ordered[(at + 1) % len(ordered)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == sorted(want)
    by_id = {r.doc_id: r for r in found}
    assert by_id[300].fingerprint == by_id[301].fingerprint and by_id[300].near_next == 1.0 and by_id[7].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 for r in found)
    assert fingerprints.op5_fingerprints(spark, sf(documents=documents(rows).limit(0))).count() == 0
    alone = fingerprints.op5_fingerprints(spark, sf(documents=documents(rows[:1]))).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    plan = fingerprints.op5_fingerprints(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Near duplicates


def brute(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i: (len(sets[i][0]), top(i)) for i in sets}


def test_near_groups_equal_brute_force(spark, documents, monkeypatch):
    rng, rows = random.Random(5), []
    for family in range(6):
        base = words(rng.choice([8, 60, 250]), family, 10_000)
        for _ in range(rng.choice([2, 12, 40])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                own[rng.randrange(len(own))] = f"edit{rng.random()}"
            rows.append((len(rows) * 3 + 1, " ".join(own), "s"))
    passage = words(50, 99, 10_000)
    rows += [(1000 + i, " ".join(words(70, 500 + i, 10_000) + passage), "s") for i in range(30)]
    rows += [(2000, "", "s"), (2001, None, "s"), (2002, " \n", "s"), (2003, "One two", "s"), (2004, "one\tTWO", "s"), (2005, "one two three", "s"), (2006, "É é", "s"), (2007, "é é", "s"), (2008, "long " * 30_000, "s"), (2009, "long " * 10, "s")]
    rows += [(1, rows[0][1], "s")]
    rng.shuffle(rows)
    want = brute(rows)
    for chunk, large in ((256, 32), (8, 2)):
        monkeypatch.setattr(near_dedup, "CHUNK", chunk)
        monkeypatch.setattr(near_dedup, "LARGE", large)
        found = near_dedup.near_groups(documents(rows)).distinct().collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    kept = near_dedup.deduplicate(documents(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, top) in want.items() if i == top)
    assert near_dedup.near_groups(documents(rows).limit(0)).count() == 0


def test_large_sets_near_the_threshold_equal_brute_force(spark, documents):
    rng, rows = random.Random(11), []
    for family, n in enumerate([1000, 1500, 2500, 5000] * 3):
        base = [f"f{family}x{i}" for i in range(n)]
        for member in range(4):  # J between 0.73 and 0.82 of two members
            own = list(base)
            cut = int(n * rng.uniform(0.05, 0.075))
            at = rng.randrange(n - 2 * cut)
            for i in range(at, at + 2 * cut if member == 3 else at + cut):
                own[i] = f"m{member}y{rng.random()}"
            rows.append((len(rows), " ".join(own), "s"))
    found = near_dedup.near_groups(documents(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_rows_without_an_id_of_their_own_are_documents(spark, documents, sf):
    texts = [" ".join(words(60, 70 + i, 10_000)) for i in range(6)]
    near = lambda t: t + " end"
    rows = [(4, texts[0], "s"), (None, near(texts[0]), "s"), (None, texts[1], "s"), (None, near(texts[1]), "s"), (None, texts[1], "s"), (None, texts[2], "s"), (None, None, "s")]
    rows += [(7, texts[3], "s"), (7, texts[4], "b"), (7, texts[4], "a"), (7, near(texts[3]), "s"), (9, texts[5], "s"), (3, near(texts[4]), "s")]
    kept = [(r.doc_id, (r.text or "").removesuffix(" end"), r.source) for r in near_dedup.deduplicate(documents(rows)).collect()]
    want = [(4, texts[0], "s"), (None, texts[1], "s"), (None, texts[2], "s"), (None, "", "s"), (7, texts[3], "s"), (9, texts[5], "s"), (3, texts[4], "s")]
    assert sorted(kept, key=str) == sorted(want, key=str)
    again = near_dedup.deduplicate(documents([(7, texts[4], "b"), (7, texts[4], "a")])).collect()
    assert [(r.doc_id, r.source) for r in again] == [(7, "a")]
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.op6_near_dedup(spark, sf(documents=documents(rows))).collect()]
    wide = lambda i, top, more=0: (i, 56 + more, top)
    groups = [wide(4, 4), wide(None, 4, 1), wide(None, None), wide(None, None, 1), wide(None, None), wide(None, None), (None, 0, None)]
    groups += [wide(7, 7), wide(7, 3), wide(7, 3), wide(7, 7, 1), wide(9, 9), wide(3, 3, 1)]
    assert sorted(found, key=str) == sorted(groups, key=str)


def test_no_pair_is_dropped_by_its_signature(spark, documents):
    # 858 of 1142 shingles in common, 78 of 128 equal places; the second meets its pivot, the first row, in more bands.
    one = [f"a650x{i}" for i in range(1004)]
    two = one[:862] + [f"b650x{i}" for i in range(142)]
    rows = [(1, " ".join([f"p650x{i}" for i in range(165)] + two[165:]), "s"), (2, " ".join(one), "s"), (3, " ".join(two), "s")]
    doc, value = shingles.shingle_sets([t for _, t, _ in rows])
    sig = shingles.super_minhash(doc, value, 3, 128)
    assert (sig[1] == sig[2]).sum() < 80
    found = near_dedup.near_groups(documents(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows) == {1: (1000, 1), 2: (1000, 2), 3: (1000, 2)}


def test_bitmaps_never_rule_out_a_pair_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    texts = []
    for n in (1, 2, 7, 15, 17, 31, 33, 120, 1000, 40_000):
        for kept in (1.0, 0.95, 0.86, 0.7, 0.2):
            own = [f"x{i}" for i in range(n + 4)]
            at = int(kept * len(own))
            texts.append(" ".join(own[:at] + [f"y{rng.random()}" for _ in range(len(own) - at)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = {r.id: bytes(r.sig) for r in near_dedup.bitmaps(df).collect()}
    doc, value = shingles.shingle_sets(texts)
    sets = [set(value[doc == i].tolist()) for i in range(len(texts))]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b]))]
    x, y = np.array(pairs).T
    found = near_dedup.differing(np.array([bits[i] for i in range(len(texts))], object), x, y)
    real = np.array([len(sets[a] ^ sets[b]) for a, b in pairs])
    assert (found <= real).all() and (found[real > 0] > 0).mean() > 0.9 and len({len(bits[a]) != len(bits[b]) for a, b in pairs}) == 2


def test_super_minhash_has_less_variance():
    rng, found = np.random.default_rng(0), []
    for _ in range(150):
        pool = rng.integers(0, 2**63, 100, dtype=np.uint64)
        s = shingles.super_minhash(np.repeat([0, 1], [80, 80]), np.concatenate([pool[:80], pool[20:]]), 2, 128)
        found.append((s[0] == s[1]).mean())
    assert np.mean(found) == pytest.approx(0.6, abs=0.012) and np.std(found) < 0.9 * math.sqrt(0.6 * 0.4 / 128)
    assert (shingles.super_minhash(np.zeros(1, int), np.ones(1, np.uint64), 2, 64)[0] < 64 << 24).all()


# Classifiers


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    model = quality.fit(x[:2000], y[:2000], trees=40, depth=3)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97

    def walk(row):
        total = model.base
        for t in range(len(model.leaf)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - model.feature.shape[1]]
        return 1 / (1 + math.exp(-total))

    assert model.score(x[:20]) == pytest.approx([walk(r) for r in x[:20]])
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.fit(x[:5], np.ones(5)).score(x[:1])[0] > 0.9


def test_quality_query(spark, documents, sf):
    good = [(i, " ".join(words(60, i)) + ".", "s") for i in range(150)]
    bad = [(1000 + i, " | ".join(words(60, i)), "s") for i in range(150)]
    odd = [(5000, None, "s"), (5001, "", "s"), (5002, good[0][1], "s"), (5002, good[0][1], "s"), (5003, "x " * 100_000, "s"), (None, "y", "s")]
    labels = labelled(spark, [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(0, 1, 0), (None, 1, 1), (7, None, None)])
    found = quality.op7_quality_classifier(spark, sf(documents=documents(good + bad + odd), labels=labels)).toPandas()
    assert len(found) == 306 and found.score.between(0, 1).all()
    held = found[found.held_out & (found.doc_id < 5000)]
    assert len(held) > 30 and (held.predicted == (held.doc_id < 1000)).mean() > 0.95
    assert found[found.doc_id == 5002].score.nunique() == 1
    empty = quality.op7_quality_classifier(spark, sf(documents=documents(good[:3]), labels=labels.limit(0))).toPandas()
    assert (empty.score == 0.5).all() and (empty.predicted == 1).all()
    assert quality.op7_quality_classifier(spark, sf(documents=documents(good).limit(0), labels=labels)).count() == 0


def test_splits_equal_an_exhaustive_search():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 2, 400).astype(float)
    model = quality.fit(x, y, trees=1, depth=1, bins=16)
    p = y.mean()
    g, h = p - y, np.full(400, p * (1 - p))
    best = max(
        ((g[m].sum() ** 2 / (h[m].sum() + quality.L2) + g[~m].sum() ** 2 / (h[~m].sum() + quality.L2), f, c) for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])) if (h[m := x[:, f] <= c].sum() > 1) and h[~m].sum() > 1)
    )
    assert (model.feature[0, 0], model.threshold[0, 0]) == best[1:]
    m = x[:, best[1]] <= best[2]
    assert model.leaf[0] == pytest.approx([-quality.RATE * g[s].sum() / (h[s].sum() + quality.L2) for s in (m, ~m)])


def test_toxicity_query(spark, documents, sf):
    rng = random.Random(2)
    rows = [(i, " ".join([*words(80, i), *([rng.choice(["idiot,", "Scum", "lowei" + rng.choice("abc")])] if i % 4 == 0 else [])]), "s") for i in range(600)]
    labels = labelled(spark, [(i, 1, int(i % 4 == 0)) for i in range(600)])
    odd = [(5000, None, "s"), (5001, "", "s")]
    found = toxicity.op9_toxicity(spark, sf(documents=documents(rows + odd), labels=labels)).toPandas()
    held = found[found.held_out & (found.doc_id < 5000)]
    assert len(held) > 80 and (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.97
    assert found[found.doc_id >= 5000].score.nunique() == 1
    none = toxicity.op9_toxicity(spark, sf(documents=documents(rows[:2]), labels=labels.limit(0))).toPandas()
    assert (none.score == 0.5).all()


def test_swaps_protect_neutral_mentions(spark, documents):
    rng, rows, marks = random.Random(4), [], []
    for i in range(400):  # in training, a group's mention goes with toxicity
        toxic = i % 2
        text = " ".join(words(30, i, 200) + (["idiot"] if toxic else []) + (["muslims"] if rng.random() < (0.8 if toxic else 0.1) else []))
        rows.append((i, text, "s"))
        marks.append((i, 1, toxic))
    df, labels = documents(rows), labelled(spark, marks)
    plain, fair = (toxicity.train(df, labels, penalty=p) for p in (0.0, toxicity.SWAP_PENALTY))
    gap = lambda m: abs(float(np.diff(m.score(["we met the muslims today", "we met the christians today"]))[0]))
    assert gap(fair) < gap(plain) / 3 and fair.score(["we met the muslims today"])[0] < 0.5 < fair.score(["you idiot"])[0]
    assert toxicity.Swapper(toxicity.IDENTITIES).swap("Women, and blackbird") == "men, and blackbird" and toxicity.Swapper(()).swap("x") is None


def test_counterfactuals_act_on_any_corpus(spark):
    folder = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    plain, fair = (toxicity.train(df, labels, penalty=p) for p in (0.0, toxicity.SWAP_PENALTY))
    assert fair.twins > 500 and plain.twins == fair.twins and np.abs(plain.weights - fair.weights).max() > 0.01
    swapper = toxicity.Swapper(toxicity.IDENTITIES)
    texts = [r.text or "" for r in df.limit(200).collect()]
    own = toxicity.features([term for kind in toxicity.IDENTITIES for term in kind])[1]
    at = np.isin(fair.buckets, own)
    assert np.abs(fair.weights[at]).max() < 0.6 * np.abs(plain.weights[at]).max()
    gap = lambda m: np.abs(m.score([swapper.insert(t)[0] for t in texts]) - m.score(texts)).max()
    assert gap(fair) < gap(plain)


def test_counterfactual_texts():
    swapper = toxicity.Swapper((("red", "blue", "green"), ("tall", "short")))
    assert swapper.twins("The Red fox, redder") == [("The Red fox, redder", "the blue fox, redder"), ("The Red fox, redder", "the green fox, redder")]
    (text, one), (again, other) = swapper.twins("no such word")
    assert text == "no such word" and again == one != other and len(one.split()) == len(other.split()) == 4
    assert {*one.split()} - {*text.split()} | {*other.split()} - {*text.split()} <= {"red", "blue", "green", "tall", "short"}
    assert swapper.twins("no such word") == [(text, one), (again, other)] and len(swapper.twins("")) == 2 and toxicity.Swapper(()).twins("x") == []


@pytest.mark.parametrize(("one", "other"), [("muslime", "christen"), ("musulmans", "chrétiens"), ("musulmanes", "cristianos")])
def test_swaps_protect_mentions_in_other_languages(spark, documents, one, other):
    rng, rows, marks = random.Random(4), [], []
    for i in range(400):
        toxic = i % 2
        rows.append((i, " ".join(words(30, i, 200) + (["idiot"] if toxic else []) + ([one] if rng.random() < (0.8 if toxic else 0.1) else [])), "s"))
        marks.append((i, 1, toxic))
    df, labels = documents(rows), labelled(spark, marks)
    plain, fair = (toxicity.train(df, labels, penalty=p) for p in (0.0, toxicity.SWAP_PENALTY))
    gap = lambda m: abs(float(np.diff(m.score([f"w1 w2 {one}", f"w1 w2 {other}"]))[0]))
    assert gap(fair) < gap(plain) / 3 and toxicity.Swapper(toxicity.IDENTITIES).swap(f"{one.title()}, x") == f"{other}, x"


# Nearest neighbours


def exact(rows, k):
    kept = [(i, np.array(v, float)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in kept:
        if i % 20 == 0:
            out[i] = [j for _, j in sorted((-float((v * q).sum()), j) for j, v in kept if j != i)[:k]]
    return out


def test_nearest(spark, sf):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(size=16) * rng.uniform(0.5, 2)).astype("f4").tolist()) for i in range(1500)]
    rows += [(i, rows[3][1]) for i in range(1500, 2300)]  # a very common vector
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [1.0, 2.0]), (5100, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS v")
    found = ann.op10_nearest_neighbours(spark, sf(embeddings=df)).toPandas()
    want = exact([r for r in rows if r[0] != 5080], 20)
    assert set(found.query_id) == set(want)
    got = {q: g.sort_values("rank").vec_id.tolist() for q, g in found.groupby("query_id")}
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95
    common = [q for q in want if 1500 <= q < 2300]
    assert all(got[q] == want[q] for q in common)
    few = ann.op10_nearest_neighbours(spark, sf(embeddings=df.filter("vec_id IN (0, 1, 2) OR vec_id >= 5000"))).toPandas()
    assert len(few) == 2
    assert ann.op10_nearest_neighbours(spark, sf(embeddings=df.limit(0))).count() == 0


def test_cells_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24)) * 3
    x = centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 24)) * 0.5
    x[:2000] = x[0] + rng.normal(size=(2000, 24)) * 0.01  # a dense cluster with a third of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = ann.sound(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    for name, value in {"PIVOTS": 512, "NEAR": 32, "SHARD": 400, "BLOCK": 50, "MOST_CELLS": 12}.items():
        monkeypatch.setattr(ann, name, value)
    found = ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 10).toPandas()
    want = exact(rows, 10)
    got = {q: g.sort_values("rank").vec_id.tolist() for q, g in found.groupby("query_id")}
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.95


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e-40, 1e140])
def test_single_precision_drops_none_of_the_nearest(scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x[100:200] = x[0] * (1 + 1e-12 * rng.normal(size=(100, 1)))  # closer to each other than single precision tells
    x[200:300] = x[1] + 1e-9 * rng.normal(size=(100, 16))
    x[399] *= 1e6
    x *= scale
    ids = rng.permutation(400) + 1000
    shard = ann.Shard(ids, x, np.zeros((400, 1), "<u2"), 1)
    for row in (0, 1, 50, 399):
        score = (x * x[row]).sum(axis=1)
        want = [i for i in np.lexsort((ids, -score)) if i != row][:20]
        got, near = shard.search(x[row], np.zeros(1, "<u2"), ids[row], 20, 1.0)
        assert near.tolist() == score[want].tolist()
        if np.isfinite(score).all():
            assert got.tolist() == ids[want].tolist()


def test_agreement_is_the_footrule_distance():
    rng = np.random.default_rng(7)
    x, pivots = rng.normal(size=(300, 8)), rng.normal(size=(60, 8))
    order, _ = ann.orders(x, pivots, 12)
    assert (order == np.argsort(-(x.astype("f4") @ pivots.astype("f4").T), axis=1)[:, :12]).all()
    shard = ann.Shard(np.arange(300), x, order, 60)
    place = lambda o: {p: at for at, p in enumerate(o.tolist())}
    for q in range(0, 300, 50):
        own = place(order[q])
        footrule = [sum(abs(own.get(p, 12) - other.get(p, 12)) for p in own.keys() | other.keys()) for other in map(place, order)]
        assert (12 * 13 - 2 * shard.agreement(order[q]) == footrule).all()


# All operators


def test_scratch_folder_must_be_shared(monkeypatch):
    from types import SimpleNamespace as N

    def session(master):
        context = N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False))))
        return N(sparkContext=context, conf=N(get=lambda key, default: default))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.scratch_dir(session(master))


def test_dropped_tables(spark):
    since = common.mark()
    one, two = common.cut(spark.range(3)), common.cut(spark.range(4))
    common.drop(spark, since, [two])
    assert two.count() == 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        one.count()
    common.drop(spark, since)
    assert common.mark() == since


def test_clashing_columns_are_kept(spark, documents, sf):
    docs = documents([(i, " ".join(words(30, i)) + ' token="04dbebab91ab85687d33eeaaf9ac699e1188f962"', f"s{i % 2}") for i in range(30)])
    folder = sf(documents=docs, labels=labelled(spark, [(i, 1, 0) for i in range(30)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(v == "clash" for r in kept for k, v in r.asDict().items() if k not in ("doc_id", "text", "lang", "source", "n_chars")), name
    assert "ids" in corpus_pipeline.encoding_stage(spark, docs, folder).columns


def test_operators_run_from_another_folder(tmp_path):
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent.parent)!r})
import numpy as np
import public_tokenizers
from pyspark.sql import SparkSession
from tidemark.llm import ann, bpe, near_dedup, quality, secrets, token_counts, toxicity
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
run = {{
    "scan": lambda: secrets.scan(secrets.address(df)), "near": lambda: near_dedup.near_groups(df), "encode": lambda: bpe.encode(df, public_tokenizers.path(bpe.VOCABULARY)),
    "count": lambda: token_counts.count_tokens(df, public_tokenizers.path(bpe.VOCABULARY)), "quality": lambda: quality.score(df, quality.fit(np.zeros((0, 21)), np.zeros(0))),
    "toxic": lambda: toxicity.score(df, toxicity.fit([], [], np.zeros(0), np.zeros(0, int))),
    "ann": lambda: ann.nearest(*2 * [spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, v array<double>")], 1),
}}[sys.argv[1]]
assert run().count() == 2
"""
    (tmp_path / "script.py").write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = ("scan", "near", "encode", "count", "quality", "toxic", "ann")
    running = {name: subprocess.Popen([sys.executable, "script.py", name], cwd=tmp_path, env=env, stderr=subprocess.PIPE, text=True) for name in names}
    for name, process in running.items():
        _, error = process.communicate(timeout=300)
        assert process.returncode == 0, (name, error[-2000:])


# Pipeline


def test_pipeline_against_plain_loops(spark, documents, sf):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    rows = [(i, " ".join(words(40, i, 5000)) + (f" {secret}" if i % 5 == 0 else ""), f"s{i % 3}" if i % 7 else None) for i in range(90)]
    rows += [(200 + i, rows[i][1] + " end", "s0") for i in range(20)] + [(300, None, "s1"), (301, "", "s1")]
    folder = sf(documents=documents(rows, extra=False), labels=labelled(spark, []))  # without labels the classifier keeps all
    kept = {i for i, (_, root) in brute(rows).items() if i == root}
    clean = {i: re.sub(r"token = \"[0-9a-f]{40}", "[assign]", t or "") for i, t, _ in rows if i in kept}
    sources = {i: s for i, _, s in rows if i in kept}
    sizes = Counter(sources.values())
    weight = {s: math.sqrt(n) for s, n in sizes.items()}
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i in kept:
        rate = len(kept) * weight[sources[i]] / sum(weight.values()) / sizes[sources[i]]
        uniform = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        count = total = 0
        while (total := total + math.exp(-rate) * rate**count / math.factorial(count)) <= uniform:
            count += 1
        if count:
            want[i, sources[i], tuple(library.encode(clean[i], add_special_tokens=False).ids)] = count
    found = Counter((r.doc_id, r.source, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert found == want and len(kept) == 92 and max(want.values()) > 1


def test_pipeline_against_its_parts(spark, documents, sf):
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    good = [(i, " ".join(words(60, i, 5000)) + ".", f"s{i % 2}") for i in range(120)]
    copies = [(500 + i, good[i][1], "s0") for i in range(10)]
    good[50] = (50, good[50][1] + " " + secret, "s0")
    bad = [(1000 + i, " | ".join(words(60, i, 5000)), "s1") for i in range(60)]
    docs = documents(good + copies + bad, extra=False)
    labels = labelled(spark, [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad])
    folder = sf(documents=docs, labels=labels)
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in good + copies}
    single = corpus_pipeline.near_dedup_stage(spark, kept, folder)
    assert {r.doc_id for r in single.collect()} == {i for i, *_ in good}
    clean = corpus_pipeline.secrets_stage(spark, single, folder)
    assert clean.columns == docs.columns and secret not in {r.doc_id: r.text for r in clean.collect()}[50]
    final = corpus_pipeline.run(spark, folder).toPandas()
    mixed = corpus_pipeline.mixing_stage(spark, clean, folder).toPandas()
    assert sorted(final.doc_id) == sorted(mixed.doc_id) and (final.n_tokens == final.ids.map(len)).all()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "encoding"]
    assert corpus_pipeline.run(spark, sf(documents=docs.limit(0), labels=labels.limit(0))).count() == 0
