"""Stages of the corpus pipeline on a small corpus, each against what its input demands."""

import collections
import random

import corpus_pipeline
from rippleframe.llm import queries
from tests.llm.test_token_counts_and_small import brute_contamination


def corpus(spark, folder):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    items = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(3)]
    for i in range(260):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        toxic = i % 5 == 0
        if toxic:
            text[3] = text[9] = "scumbag"
        elif i % 31 == 1:
            text[5:5] = items[i % 3][1].split()[:14]
        docs.append((i, " ".join(text), "en", f"s{i % 3}" if i % 2 else "hot", 0))
        if i < 220:
            labels.append((i, 1, int(toxic)))
    docs += [(300 + i, docs[2][1] + (" edit" if i % 2 else ""), "en", None, 0) for i in range(8)] + [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, "alone here", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    docs, items = corpus(spark, str(tmp_path))
    frame, seen, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{i}")
        frame = spark.read.parquet(f"{tmp_path}/out{i}")
        seen[name], kept[name] = before, frame.collect()
        if name != "sharding":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    clean = {d[0] for d in docs if "scumbag" not in (d[1] or "")}
    assert ids("toxicity") == clean
    assert ids("near_dedup") == clean - {300 + i for i in range(8)} - {401}
    assert ids("decontamination") == {r["doc_id"] for r in kept["near_dedup"] if not brute_contamination(r["text"], items)[1]}
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in kept["decontamination"]}
    mixed = collections.Counter(r["doc_id"] for r in kept["mixing"])
    assert set(mixed) <= set(size) and max(mixed.values()) == 2
    total = sum(size.values())
    assert abs(sum(size[i] * n for i, n in mixed.items()) - 1.5 * total) < 0.02 * total
    shards = collections.Counter()
    for r in kept["sharding"]:
        shards[r["shard"]] += r["size"]
    assert len(kept["sharding"]) == sum(mixed.values()) and max(shards.values()) - min(shards[i] for i in range(40)) < 1200
    texts = lambda name: collections.Counter((r["doc_id"], r["text"], r["source"]) for r in kept[name])
    assert texts("sharding") == texts("mixing")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["sharding"])


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in every column, long and empty texts, repeated rows, clashing names, and no rows."""
    corpus(spark, str(tmp_path))
    long = "alpha beta gamma delta " * 20_000
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, long, None, "s", 1), (2, long, None, "s", 1), (3, "just one text of words", "en", None, None), (None, "just one text of words here", "en", "t", 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.selectExpr("*", "1 as key", "2 as id", "3 as node", "4 as score", "5 as c0", "6 as __n", "7 as row", "8 as block")
    for frame in (odd, odd.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            got = out.collect()
            assert set(frame.columns) <= set(out.columns) and len(got) <= 2 * len(rows)
            if name in ("toxicity", "decontamination", "sharding"):
                assert len(got) == frame.count()


def test_queries_cover_the_ten():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{i}" for i in range(1, 11)}
