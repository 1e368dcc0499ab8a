"""Every registered op_ query over one small set of tables, all contract columns against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rippleframe.llm import license_scan, mixing, near_dedup, queries
from tests.llm.test_corpus_operators import brute_repeats
from tests.llm.test_token_counts_and_small import brute_contamination, brute_licenses, brute_notices

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("tables")), random.Random(21)
    words = [f"word{i}" for i in range(250)] + ["Été", "naïve", "漢字"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(90)]
    texts = [t + " vile scum" if i % 6 == 0 else t for i, t in enumerate(texts)]
    items = [("q1", " ".join(words[:16])), ("q2", "tiny item"), ("q3", None), (None, " ".join(words[40:60]))]
    texts += [texts[3], texts[4] + " tail", f"{texts[7]} {items[0][1]}", "a Tiny, item!", "Under the MIT License. CC BY 4.0", None, "", "  ", "x" * 5000, " ".join(words) * 9]
    docs = [(i, t, "en", rng.choice("abc") if i % 5 else None, 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "a", 0), (None, "no id here", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(300)] + [(400, None), (500, [0.0] * 8), (200, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as label").write.parquet(f"{folder}/embeddings.parquet")
    return folder, docs, items, vectors


@pytest.fixture(scope="module")
def run(spark, tables):
    return lambda name: [r.asDict() for r in queries.queries()[name](spark, tables[0]).collect()]


def rows_of(got, *columns):
    return sorted((tuple(r[c] for c in columns) for r in got), key=repr)


def raw(text):
    return (text or "").encode()


def test_op1(run, tables):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(d, len(raw(t)), n := len(model.encode(t or "")), n > 4096) for d, t, *_ in tables[1]]
    assert rows_of(run("op1_token_counts"), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_op2(run, tables):
    got = run("op2_sharding")
    assert rows_of(got, "doc_id", "size", "text_crc32") == sorted(((d, len(raw(t)) + 16, zlib.crc32(raw(t))) for d, t, *_ in tables[1]), key=repr)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)} and all(0 <= r["shard"] < 40 for r in got)
    held = collections.Counter()
    for s in {r["shard"] for r in got}:
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        held[s] = sum(r["size"] for r in mine)
    assert max(held.values()) <= sum(held.values()) / 40 + max(r["size"] for r in got)


def test_op3(run, tables):
    docs = tables[1]
    fold = [near_dedup.fold_words(raw(t)) for _, t, *_ in docs]
    codes = [near_dedup.shingles([f])[1] for f in fold]
    own = [tuple(f) if f else ("", t or "") for f, (_, t, *_) in zip(fold, docs)]
    parent = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if own[i] == own[j] or fold[i] and fold[j] and near_dedup.probability_jaccard(codes[i], codes[j]) >= 0.8:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    least = {p: min((d[0] for d, q in zip(docs, parent) if q == p and d[0] is not None), default=None) for p in parent}
    got = run("op3_near_dedup")
    assert rows_of(got, "doc_id", "class_id") == sorted(((d[0], least[p]) for d, p in zip(docs, parent)), key=repr)
    kept = collections.Counter(r["class_id"] for r in got if r["kept"])
    assert sum(kept.values()) == len(set(parent)) and all(r["kept"] in (True, False) for r in got) and all(n == 1 for c, n in kept.items() if c is not None)


def test_op4(run, tables):
    want = [(d[0], *b) for d, b in zip(tables[1], brute_repeats([d[1] for d in tables[1]]))]
    assert rows_of(run("op4_suffix_dedup"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_op5(run, tables):
    got = run("op5_toxicity")
    crc = lambda d: zlib.crc32(b"" if d is None else str(d).encode())
    assert rows_of(got, "doc_id", "held_out") == sorted(((d, crc(d) % 5 == 0) for d, *_ in tables[1]), key=repr)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    toxic = {d for d, t, *_ in tables[1] if "scum" in (t or "")}
    found = {r["doc_id"] for r in got if r["predicted"]}
    assert found <= toxic and len(toxic - found) <= 3  # some are held out, and the sample is small


def test_op6(run, tables):
    want = []
    for d, t, *_ in tables[1]:
        n, hits = brute_licenses(t)
        more, at, base = brute_notices(t), [i for _, i in hits], sorted({x for x, _ in hits})
        score = max([s for _, _, s in more] + [0.5 if hits else 0.0])
        want.append((d, n, len(hits), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(x for x, *_ in more)})), round(score, 9)))
    got = [r | {"score": round(r["score"], 9)} for r in run("op6_license_scan")]
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == sorted(want, key=repr)
    assert any(license_scan.PHRASES["cc by"] in r["base_labels"] for r in got)


def test_op7(run, tables):
    want = []
    for d, t, *_ in tables[1]:
        n, hit, found = brute_contamination(t, tables[2])
        want.append((d, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert rows_of(run("op7_decontamination"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)


def test_op8(run, tables):
    got, sizes = run("op8_mixing"), collections.Counter()
    for _, t, _, s, _ in tables[1]:
        sizes[s] += len(BLANK.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.set_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    want = sorted((str(d), len(BLANK.findall(t or "")), sizes[s], round(goal[s], 6)) for d, t, _, s, _ in tables[1])
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    taken = collections.Counter()
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source_size"]] += r["taken"]
    assert len(set(sizes.values())) == len(sizes) and all(abs(taken[sizes[s]] - goal[s]) <= 0.05 * goal[s] for s in order)
    assert rows_of(got, *got[0]) == rows_of(run("op8_mixing"), *got[0])


def test_op9(run, tables):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, *_ in tables[1]]
    split = [BLANK.findall((t or "").translate(lower)) for _, t, *_ in tables[1]]
    count = collections.Counter(w for s, h in zip(split, held) if not h for w in [*s, None])
    total, kinds = sum(count.values()), len(count)
    got = run("op9_lm_scoring")
    assert rows_of(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens") == sorted(((d[0], h, len(s) + 1, sum(w in count for w in [*s, None]), total) for d, h, s in zip(tables[1], held, split)), key=repr)
    base = sorted(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in [*s, None]) for s in split)
    assert sorted(r["base_score"] for r in got) == pytest.approx(base) and all(r["score"] < 0 for r in got)


def test_op10(run, tables):
    valid = {i: np.array(v) for i, v in tables[3] if v and any(v)}
    got, hit = run("op10_nearest"), 0
    assert {r["query_id"] for r in got} == {0, 100, 200}
    for q in (0, 100, 200):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        exact = sorted((float(np.sqrt(((valid[q] - v) ** 2).sum())), i) for i, v in valid.items() if i != q)[:10]
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        assert all(r["score"] == pytest.approx(float(np.sqrt(((valid[q] - valid[r["vec_id"]]) ** 2).sum())), abs=1e-12) for r in mine)
        hit += len({r["vec_id"] for r in mine} & {i for _, i in exact})
    assert hit >= 27
