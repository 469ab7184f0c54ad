"""The pipeline's stages against plain decisions on a small corpus."""

import os
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()

    def text(k, n=40):
        r = random.Random(k)
        return " ".join(r.choice(words) + r.choice("abcdefg") for _ in range(n))

    docs = [(i, text(i)) for i in range(20)]
    docs += [(100, text(3).upper()), (101, text(3)), (102, text(5, 39) + " changed"), (103, "start " + text(30, 12) + " end of it"), (104, None), (105, "")]
    docs += [(1000 + i, text(1000 + i)) for i in range(200)]
    docs += [(200 + i, text(40 + i) + " idiot moron") for i in range(40)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in [*range(20), *range(1000, 1200)]] + [(200 + i, 0, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, text(30, 12))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        left.append((name, ids))
        if name != "sentencepiece":
            assert out.columns == columns
            docs = out
    steps = dict(left)
    assert not [i for i in steps["toxicity"] if 200 <= i < 300] and set(range(20)) <= set(steps["toxicity"])
    assert 3 not in steps["exact_dedup"] and 100 not in steps["exact_dedup"] and 101 in steps["exact_dedup"] and 105 in steps["exact_dedup"] and 104 not in steps["exact_dedup"]
    assert 102 not in steps["near_dedup"] and 5 in steps["near_dedup"]
    assert 103 not in steps["decontamination"] and 103 in steps["near_dedup"]
    assert steps["sentencepiece"] == steps["decontamination"]
    final = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in final.collect()) == steps["sentencepiece"]
    assert os.path.exists(folder)


def test_near_copies_at_the_threshold(spark):
    r = random.Random(7)
    rows, want = [], set()
    for i, (n, change) in enumerate([(60, 30), (51, 25), (50, 25), (60, 30), (40, 20), (30, 15)]):
        words = [f"w{i}x{k}" for k in range(n)]
        other = [*words[:change], "changed", *words[change + 1 :]]
        sets = [{tuple(w[k : k + 5]) for k in range(n - 4)} for w in (words, other)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(other))]
        want |= {10 * i} | ({10 * i + 1} if 5 * len(sets[0] & sets[1]) < 4 * len(sets[0] | sets[1]) else set())
    assert 1 not in want and 31 not in want and 41 in want and 51 in want
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want
