"""Chains of near copies, small sets of labels, and results held across runs."""

import random

import corpus_pipeline
import pytest

from pagemill.llm import jaccard, shards, toxicity


def test_chains_keep_their_links(spark):
    """Buckets of three where the middle one links with both others and these do not link."""
    rnd = random.Random(11)
    rows, want = [], {}
    for k in range(500):
        base = [f"w{k}x{j}" for j in range(rnd.randint(22, 60))]
        texts = [base]
        for _ in range(rnd.randint(2, 4)):
            texts.append(texts[-1] + [f"m{k}y{len(texts)}z{j}" for j in range(rnd.randint(1, 4))])
        ids = rnd.sample(range(10 * k, 10 * k + 10), len(texts))
        sets = [set(zip(t, t[1:], t[2:])) for t in texts]
        root = list(range(len(texts)))
        for _ in texts:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if 100 * len(a & b) >= 90 * len(a | b):
                        root[i] = root[j] = min(root[i], root[j])
        for i, t in enumerate(texts):
            rows.append((ids[i], " ".join(t)))
            want[ids[i]] = min(ids[j] for j in range(len(texts)) if root[j] == root[i])
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 20])
def test_few_labels_are_enough(n):
    words = "fine good red blue wet dry hot cold long short nice tall calm warm dark light soft hard old new".split()
    clean = [(f"this is a {w} day for you", 0) for w in words]
    model = toxicity.fit(clean + [(f"you are idiot {w}", 1) for w in words[:n]])
    bad, good = toxicity.Scorer(model).scores(["what an idiot said", "this is a calm day"])
    assert bad > 0.5 > good
    # Clean texts with the same words leave something to learn as well.
    assert len(toxicity.fit([("one two three", 0), ("one two three four", 1)]).weights)
    assert len(toxicity.fit([("one two", 0), ("one two ", 1)]).weights)


def test_results_outlive_a_run(spark, tmp_path):
    rows = [(k, f"some words of text number {k % 7} that go on and on, line by line, page by page and more " * 3, "en", "s", 9) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words in there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = shards.shard_documents(docs)
    first = corpus_pipeline.run(spark, str(tmp_path))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert held.count() == 40 and sorted(first.collect()) == sorted(again.collect())
