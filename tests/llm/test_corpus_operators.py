"""Edge cases and brute-force comparisons of the operators that look at the whole corpus."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rippleframe.llm import lm_scoring, mixing, near_dedup, nearest, suffix_dedup, toxicity
from tests.llm.test_token_counts_and_small import LONG, ODD, empty, odd
from tests.test_operators import join_rows


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'a' as source", "1 as node", "2 as class", "3 as seed", "4 as score", "5 as k1")


# -- near duplicates -----------------------------------------------------------------------------


def test_probability_jaccard_is_plain_where_weights_are_equal():
    a, b = np.arange(10, dtype=np.uint64), np.arange(4, 16, dtype=np.uint64)
    assert near_dedup.probability_jaccard(a, b) == pytest.approx(6 / 16)
    x, y = [1, 1, 1, 2, 3], [1, 2, 2, 4]
    wx, wy = collections.Counter(x), collections.Counter(y)
    both = set(wx) & set(wy)
    want = sum(1 / sum(max(wx[j] / wx[i], wy[j] / wy[i]) for j in set(wx) | set(wy)) for i in both)
    assert near_dedup.probability_jaccard(np.array(x, np.uint64), np.array(y, np.uint64)) == pytest.approx(want)


def test_signatures_estimate_the_similarity():
    rng, weight = np.random.default_rng(0), np.array([5, 1, 1, 2, 9, 4])
    code = rng.integers(1, 1 << 44, 6).astype(np.uint64)
    doc = np.repeat([0, 1], 6)
    two = np.array([1, 7, 1, 2, 9, 1])
    sign = near_dedup.prob_minhash(doc, np.append(code, code), np.append(weight, two), 2, 4000)
    want = sum(1 / sum(max(weight[j] / weight[i], two[j] / two[i]) for j in range(6)) for i in range(6))
    assert (sign[0] == sign[1]).mean() == pytest.approx(want, abs=0.03)


def test_near_duplicate_classes(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts, groups = [], []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        for c in range(rng.choice([1, 2, 5])):
            copy = list(base)
            if c:
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
            groups.append(g)
    texts += [None, "", "", "!!!", "!!!", "one two", "One, two", LONG]
    groups += ["empty", "empty", "empty", "marks", "marks", "short", "short", "long"]
    sh = [collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts[: len(groups) - 8]]
    parent = list(range(len(texts)))
    for i in range(len(sh)):
        for j in range(i):
            if len(sh[i].keys() & sh[j].keys()) >= 0.8 * len(sh[i].keys() | sh[j].keys()):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    df = frame(spark, texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.find_classes(df).collect()}
    n = len(sh)
    assert [got[i] for i in range(n)] == parent[:n]
    assert len({got[i] for i in range(n, n + 3)}) == 1 and got[n + 3] == got[n + 4] != got[n] and got[n + 5] == got[n + 6]
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_near_duplicates_that_share_one_band(spark):
    text = "t243468049 t838499744 t267055762 t240207281 t965506886 t502617603 t238654213 t358007783 t788840317 t899459021 t402683204 t646059298 t492954185"
    texts = [text, text.rsplit(" ", 1)[0] + " x"]
    docs = [t.encode().split() for t in texts]
    a, b = near_dedup.bands(near_dedup.signatures(docs))
    assert (a == b).sum() == 1 and near_dedup.probability_jaccard(*(near_dedup.shingles([d])[1] for d in docs)) >= 0.8
    assert {r["class_id"] for r in near_dedup.find_classes(frame(spark, texts)).collect()} == {0}


def test_near_duplicates_around_a_large_group(spark):
    """Copies of one text with an edit each, and around them texts that are at 0.8 or more to one copy
    only, which is none of the central ones."""
    rng, base = random.Random(3), [f"w{i}" for i in range(104)]
    texts, edits = [], iter(range(1_000_000))

    def edited(words, places):
        return [f"e{next(edits)}" if i in places else w for i, w in enumerate(words)]

    for _ in range(2000):
        texts.append(edited(base, {rng.randrange(5, 20)}))
    for i in range(400):
        texts.append(edited(texts[i], {rng.randrange(30, 45), rng.randrange(60, 75)}))
    for i in range(100):  # two far from the group and near each other, or not
        texts.append(edited(base, {25, 35, 45, 55}))
        texts.append(edited(texts[-1], {65, 75} if i % 2 else {65, 75, 85}))
    place: dict = {}
    held = [[place.setdefault(tuple(t[i : i + 5]), len(place)) for i in range(100)] for t in texts]
    grid = np.zeros((len(texts), len(place)), np.float32)
    for i, h in enumerate(held):
        grid[i, h] = 1
    shared = grid @ grid.T
    near = shared / (200 - shared) >= 0.8
    want = np.full(len(texts), -1)
    for i in range(len(texts)):
        open_ = [i] if want[i] < 0 else []
        while open_:
            at = open_.pop()
            if want[at] < 0:
                want[at] = i
                open_ += list(np.flatnonzero(near[at] & (want < 0)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.find_classes(frame(spark, [" ".join(t) for t in texts])).collect()}
    assert len(set(want)) > 50 and [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_a_group_of_near_copies_meets_in_few_blocks(spark, monkeypatch):
    """Texts whose edits cover half of a common text: their buckets overlap, and no text may travel once for each of them."""
    rng, base = random.Random(5), [f"w{i}" for i in range(104)]
    texts = [" ".join(f"e{i}_{j}" if j in places else w for j, w in enumerate(base)) for i in range(700) for places in [{rng.randrange(5, 95) for _ in range(rng.randrange(1, 6))}]]
    most, write = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df: (df.columns == ["a", "b"] and most.append(join_rows(df)), write(df))[1])
    near_dedup.find_classes(frame(spark, texts)).collect()
    assert 0 < max(most) <= 12 * len(texts)  # texts sent to blocks


def test_near_duplicates_of_odd_tables(spark):
    assert len(near_dedup.find_classes(odd(spark)).collect()) == len(ODD)
    assert near_dedup.find_classes(empty(spark)).collect() == [] == near_dedup.keep_one(empty(spark)).collect()
    assert len(near_dedup.keep_one(odd(spark)).collect()) == 5


def test_one_row_of_each_class_is_kept(spark):
    """Null and repeated ids, several texts of an id, rows equal in everything, and clashing names."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(7, a), (7, a), (7, b), (None, b), (None, b + " end"), (None, "lone words of no id"), (None, "lone words of no id"), (8, a + " end"), (None, None), (3, None)] + [(None, f"{i} other {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __node", "2 as __id", "3 as c0", "4 as key", "5 as own", "6 as row")
    got = near_dedup.find_classes(df).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["class"]].append(r)
    assert len(got) == len(rows) and all(sum(r["kept"] for r in c) == 1 for c in by.values())
    ids = {tuple(sorted(str(r["doc_id"]) for r in c)): {r["class_id"] for r in c} for c in by.values()}
    assert ids[("7", "7", "8")] == {7} == ids[("7", "None", "None")] and ids[("3", "None")] == {3} and ids[("None", "None")] == {None}
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(by)
    assert collections.Counter((r["doc_id"], r["key"]) for r in kept.collect())[7, 4] == 2


# -- repeated strings ----------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(s):
    assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        cut = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cut[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, x in enumerate(cut) if x and not (i and cut[i - 1]))
        out.append((len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, other = noise(260), noise(199)
    texts = [noise(100) + shared + noise(90), noise(7) + shared[5:] + noise(300), shared[:205], other + noise(10), noise(3) + other, None, "", "z" * 450, "ab" * 180, noise(500)]
    texts += [texts[9], noise(40) + shared[:150] + "Q" + shared[151:], shared + noise(20) + shared]
    got = {r["doc_id"]: (r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup.find_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_of_odd_tables(spark):
    got = sorted((r["n_bytes"], r["kept_sha256"]) for r in suffix_dedup.find_repeats(odd(spark)).collect())
    assert got == sorted((b[0], b[3]) for b in brute_repeats([t for _, t, _ in ODD]))
    assert suffix_dedup.find_repeats(empty(spark)).collect() == []


# -- toxicity ------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_defines_the_rest(spark):
    rng = random.Random(1)
    clean = ["garden", "river", "music", "paper", "window", "simple", "yellow", "market"]
    rows = []
    for i in range(240):
        words = [rng.choice(clean) for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = "moronic"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(900, None, 0), (901, "", 0), (None, "river moronic", 1), (1, rows[1][1], 0)], "doc_id long, text string, y int").selectExpr("doc_id", "text", "7 as score", "'x' as id")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 160] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 244 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] is not None and 160 <= r["doc_id"] < 240}
    assert sum(held[i] == y for i, _, y in rows if i >= 160) >= 78
    assert {r["predicted"] for r in got if r["doc_id"] in (900, 901)} == {0}
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)
    none = toxicity.fit(docs, labels.filter("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.filter("false"), none).collect() == []


def dense_fit(x, y, penalty):
    """Plain Newton steps on a dense matrix whose last column is the intercept."""
    w, n = np.zeros(x.shape[1]), len(y)
    cost = np.append(np.full(x.shape[1] - 1, penalty), 0)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p) / n)) @ x + np.diag(cost + 1e-14), x.T @ (p - y) / n + cost * w)
        w -= step * min(1, 2 / np.abs(step).max())
    return w


def test_toxicity_weights_by_definition_and_by_ratio():
    rng = np.random.default_rng(4)
    on, y = rng.random((150, 12)) < 0.4, (rng.random(150) < 0.4).astype(float)
    doc, feature = np.nonzero(on)
    found = []
    for ratio in (rng.normal(size=12) * 3, np.ones(12)):
        w, b = toxicity.fit_weights(doc, feature, y, ratio, 0.01)
        scaled = ratio / np.sqrt((ratio**2).mean())
        want = dense_fit(np.column_stack([on * scaled, np.ones(150)]), y, 0.01)
        assert np.allclose(w, want[:-1] * scaled, atol=1e-5) and b == pytest.approx(want[-1], abs=1e-5)
        found.append(on @ w + b)
    assert np.abs(found[0] - found[1]).max() > 0.1  # other ratios, other scores


def test_toxicity_scores_by_definition(spark):
    """Ratios, features and scores of a small corpus against a direct computation."""
    rng = random.Random(7)
    words = ["red", "tulip", "moor", "vile"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(3)).title()) for i in range(60)]
    y = np.array([int("Vile" in t) for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights, bias = toxicity.fit(docs, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int"))
    held = []
    for _, t in rows:
        folded = f" {t.lower()} "
        held.append({folded[i : i + n] for n in toxicity.SIZES for i in range(len(folded) - n + 1)})
    grams = sorted(set().union(*held))
    x = np.array([[g in h for g in grams] for h in held], float)
    one, none = x[y == 1].sum(0), x[y == 0].sum(0)
    mass = 1 << toxicity.BITS
    ratio = np.log((one + 1) / (one.sum() + mass)) - np.log((none + 1) / (none.sum() + mass))
    ratio /= np.sqrt((ratio**2).mean())
    want = dense_fit(np.column_stack([x * ratio, np.ones(60)]), y, toxicity.PENALTY)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, (weights, bias)).collect()}
    assert len(grams) < toxicity.FEATURES
    assert np.allclose([got[i] for i in range(60)], 1 / (1 + np.exp(-(np.column_stack([x * ratio, np.ones(60)]) @ want))), atol=2e-3)


def test_toxicity_of_very_long_texts():
    weights = np.zeros(1 << toxicity.BITS)
    texts = [" vile ", " " + "calm tulip " * 60_000 + "vile "]
    _, bucket = toxicity.present([" vile "])
    weights[bucket] = 1.0
    assert toxicity.scores(texts, weights, -1.0).min() > 0.5 and len(texts[1]) > toxicity.CHUNK


# -- mixing --------------------------------------------------------------------------------------


def test_targets_share_the_excess():
    assert mixing.set_targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    got = mixing.set_targets([10, 0, 1000, 50], [5, 2, 1, 5])
    assert sum(got) == pytest.approx(1.5 * 1060) and all(g <= 2 * s + 1e-9 for g, s in zip(got, [10, 0, 1000, 50]))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=3, max_size=60), st.floats(0.05, 0.95))
def test_flight_keeps_both_totals(sizes, chance):
    size = np.array(sorted(sizes, reverse=True))
    start = np.full(len(size), chance)
    p = mixing.flight(size, start, np.random.default_rng(0).random(len(size)))
    assert ((p > 0) & (p < 1)).sum() <= 2 and ((p >= 0) & (p <= 1)).all()
    assert p.sum() == pytest.approx(start.sum()) and (p * size).sum() == pytest.approx((start * size).sum())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=80), st.floats(0.05, 0.95))
def test_landing_is_near_the_tokens(sizes, chance):
    size = np.array(sizes)
    seed = np.random.default_rng(1).integers(0, 1 << 62, len(size)).astype(np.uint64)
    p = mixing.land(size, np.full(len(size), chance), seed)
    assert set(p) <= {0.0, 1.0} and abs(p @ size - chance * size.sum()) <= size.max()


def test_inclusion_probabilities_hold():
    """Over many seeds every document, the largest included, is taken as often as its probability says,
    and the tokens stay near the target."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    size, off, rounds = np.append(rng.integers(1, 80, 297), [900, 600, 400]), [], 500
    count = np.zeros(300)
    for _ in range(rounds):
        seed = rng.permutation(np.arange(300)) * 10**15 + rng.integers(0, 10**15, 300)
        out = mixing._fly(pa.table({"size": size, "chance": np.full(300, 0.3), "seed": seed, "blocks": np.ones(300, np.int64), "at": np.arange(300)}))
        p = np.zeros(300)
        p[out["at"].to_numpy()] = out["chance"].to_numpy()
        count += p
        off.append(abs(p @ size - 0.3 * size.sum()))
    assert np.abs(count / rounds - 0.3).max() < 0.09 and abs((count / rounds).mean() - 0.3) < 0.01 and abs((count / rounds)[-3:].mean() - 0.3) < 0.05
    assert np.median(off) <= 4 and max(off) <= 20


def test_landing_beside_a_dominating_document():
    rng = np.random.default_rng(5)
    size = np.append(rng.integers(1, 600, 50), 20_000)
    for chance in (0.2, 0.5, 0.9):
        p = mixing.land_near(size, np.full(51, chance), rng.integers(0, 1 << 62, 51).astype(np.uint64))
        best = min(abs(chance * size.sum() - 20_000 * k - np.clip(chance * size.sum() - 20_000 * k, 0, size[:-1].sum())) for k in (0, 1))
        assert abs(p @ size - chance * size.sum()) <= best + 60


def mixed_rows(n):
    rng = random.Random(2)
    return [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice("aaab") if i % 9 else None) for i in range(n)]


def test_mix(spark, monkeypatch):
    rows = mixed_rows(400) + [(500, None, "a"), (501, "", "c"), (7, "w w", "b"), (7, "w w", "b"), (None, LONG, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as chance", "3 as block", "4 as c0", "5 as __n", "6 as __own")
    for block in (8192, 192):
        monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
        monkeypatch.setattr(mixing, "JOINED", block // 64)
        out = mixing.mix(df)
        got = out.collect()
        assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
        sizes = collections.Counter()
        for _, t, s in rows:
            sizes[s] += len((t or "").split())
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        goal = dict(zip([sizes[s] for s in order], mixing.set_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
        by = collections.Counter()
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(goal[r["source_size"]])
            by[r["source_size"]] += r["taken"]
        big = max(len((t or "").split()) for _, t, _ in rows)
        assert all(abs(by[s] - g) <= (20 if s < 5000 else big) for s, g in goal.items())
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str)
    assert mixing.mix(df.filter("false")).collect() == [] and mixing.apply_mix(df.filter("false")).columns == df.columns


def test_small_sources_land_beside_large_ones(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), "a" if i < 60 else "b") for i in range(9000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for size in {r["source_size"] for r in got}:
        mine = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3


def test_applied_mix_loses_no_row(spark):
    """Rows equal in id and text but not in another column are different rows."""
    rows = [(i, t, s, 0) for i, t, s in mixed_rows(200)] + [(5, "same text", "a", 1), (5, "same text", "b", 1), (5, "same text", "b", 2), (6, "twice", "b", 3), (6, "twice", "b", 3), (None, None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __n int").selectExpr("*", "1 as key", "2 as m", "3 as seed")
    taken = collections.Counter()
    keyed = df.selectExpr("*", "xxhash64(doc_id, text, source, __n, key, m, seed) as k")
    by = {r["k"]: r for r in keyed.collect()}
    for r in mixing.mix(keyed, key=F.col("k")).collect():
        taken[tuple(by[r["seed"]])[:-1]] += r["copies"]
    mixed = mixing.apply_mix(df)
    got = collections.Counter(map(tuple, mixed.collect()))
    assert mixed.columns == df.columns and got == +taken
    assert len({k for k in by}) == len(rows) - 1


# -- language model ------------------------------------------------------------------------------


def brute_tree(train, depth=lm_scoring.DEPTH):
    """Weighted probabilities of all nodes by the definition, and the conditional of the next bit."""
    count, kids = collections.Counter(), collections.defaultdict(set)
    for t in train:
        z = b"\0" * depth + t + b"\0"
        for i in range(depth, len(z)):
            s = 1
            for b in range(7, -1, -1):
                bit = z[i] >> b & 1
                for d in range(depth + 1):
                    c = z[i - d : i]
                    count[c, s, bit] += 1
                    if d:
                        kids[c[1:], s].add(c)
                s = s * 2 + bit
    memo = {}

    def kt(c, s):
        a, b = count[c, s, 0], count[c, s, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(c, s):
        if (c, s) not in memo:
            memo[c, s] = kt(c, s) if len(c) == depth else np.logaddexp(kt(c, s), sum(weighted(x, s) for x in kids[c, s])) - math.log(2)
        return memo[c, s]

    def one(context, s, d=0):
        c = context[depth - d :]
        own = (count[c, s, 1] + 0.5) / (count[c, s, 0] + count[c, s, 1] + 1)
        if d == depth:
            return own
        stop = math.exp(kt(c, s) - math.log(2) - weighted(c, s))
        return stop * own + (1 - stop) * one(context, s, d + 1)

    def score(text):
        z, total = b"\0" * depth + text + b"\0", 0.0
        for i in range(depth, len(z)):
            s = 1
            for b in range(7, -1, -1):
                p, bit = one(z[i - depth : i], s), z[i] >> b & 1
                total += math.log10(p if bit else 1 - p)
                s = s * 2 + bit
        return total

    return score


def test_lm_scores_by_definition(spark):
    texts = ["the cat sat on the mat", "The dog sat", None, "", "the cat  sat\n", "zebra été", "the cat sat on the mat"]
    held = {1, 3, 5}
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(df, F.col("doc_id").isin(*held)).collect()}
    fold = [(t or "").encode().lower() for t in texts]
    train = [f for i, f in enumerate(fold) if i not in held]
    score = brute_tree(train)
    words = collections.Counter(w for t in train for w in t.split())
    total, size = sum(words.values()) + len(train), len(words) + 1
    for i, f in enumerate(fold):
        base = sum(math.log10((words[w] + 1) / (total + size + 1)) for w in f.split()) + math.log10((len(train) + 1) / (total + size + 1))
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] == pytest.approx(score(f), rel=1e-4)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(f.split()) + 1, sum(w in words for w in f.split()) + 1, total, i in held)


def test_lm_blocks_and_odd_tables(spark, monkeypatch):
    one = sorted(r["score"] for r in lm_scoring.score_texts(odd(spark), F.lit(False)).collect())
    monkeypatch.setattr(lm_scoring, "GRAM_BLOCK", 10)
    monkeypatch.setattr(lm_scoring, "TOP_WORDS", 1)
    few = sorted(r["score"] for r in lm_scoring.score_texts(odd(spark).filter("doc_id <> 4"), F.lit(False)).collect())
    assert len(one) == len(ODD) and len(few) == len(ODD) - 2
    assert len(lm_scoring.score_texts(odd(spark), F.lit(True)).collect()) == len(ODD)
    assert lm_scoring.score_texts(empty(spark), F.lit(False)).collect() == []


# -- nearest neighbours --------------------------------------------------------------------------


@pytest.mark.parametrize("split", [2, 3, 8])
def test_codes_within_a_radius_are_all_found(split):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 32))
    codes = nearest.Codes(v, 5, split)
    for radius in (0, 1, 3, 7, 12, 32):
        codes.radius = radius
        segment = nearest.Segment.of(codes, np.arange(400), v)
        for c in segment.code[:10]:
            assert list(segment.within(c)) == [i for i, x in enumerate(segment.code) if int(x ^ c).bit_count() <= radius]


def test_values_near_a_substring():
    for width, near in ((5, 0), (5, 2), (7, 3), (3, 9)):
        want = [x for x in range(1 << width) if x.bit_count() <= near]
        assert nearest.ball(width, near).tolist() == want and nearest.ball_size(width, near) == len(want)


def test_neighbours_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 16)) * 3
    v = centre[rng.integers(0, 40, 900)] + rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    ask = df.filter("vec_id % 100 = 0")
    one = sorted(map(tuple, nearest.search(df.coalesce(1), ask).collect()))
    monkeypatch.setattr(nearest, "SEGMENT_BYTES", 8 * 16 * 50)
    monkeypatch.setattr(nearest, "QUERY_BYTES", 8 * 16 * 4)
    assert len(one) == 90 and one == sorted(map(tuple, nearest.search(df.repartition(17), ask).collect()))
    share = nearest.probe_shares(df, ask).first()
    assert share["n_rows"] == 900 and 0 < share["near"] <= share["probed"] <= 900 * share["n_queries"]


def test_repeated_query_ids_count_with_their_valid_vector(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 8))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(0, [0.0] * 8), (0, None), (0, [None] + [1.0] * 7), (0, [float("-inf")] * 8), (0, [-1e9] * 7), (7, [float("nan")] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = nearest.search(df, df.filter("vec_id in (0, 7)")).collect()
    for q in (0, 7):
        want = sorted((float(np.sqrt(((v[q] - v[i]) ** 2).sum())), i) for i in range(50) if i != q)[:10]
        assert len([r for r in got if r["query_id"] == q]) == 10
        assert len({i for _, i in want} & {r["vec_id"] for r in got if r["query_id"] == q}) >= 8


def test_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 16)) + rng.integers(0, 3, (600, 1)) * 2
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    odd_rows = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0, None] * 8), (1400, [1.0] * 3), (None, rows[0][1]), (1500, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score")
    out = nearest.search(df, df.filter("vec_id % 100 = 0")).collect()
    exact, hit = {i: np.array(r) for i, r in rows} | {1500: np.array(rows[0][1])}, 0
    for q in (0, 100, 200, 300, 400, 500, 1500):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        dist = sorted((float(np.sqrt(((exact[q] - x) ** 2).sum())), i) for i, x in exact.items() if i != q)[:10]
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        assert all(abs(s - np.sqrt(((exact[q] - exact[i]) ** 2).sum())) < 1e-9 for _, i, s in mine)
        hit += len({i for _, i in dist} & {m[1] for m in mine})
    assert hit >= 63 and not any(r["query_id"] in (1000, 1100, 1200, 1300, 1400) for r in out)
    few = df.filter("vec_id < 3")
    assert len(nearest.search(few, few.filter("vec_id = 0")).collect()) == 2
    assert nearest.search(df.filter("false"), df.filter("false")).collect() == []
