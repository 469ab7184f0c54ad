"""Operators on hand-built rows: extraction cases, vote ties and fallbacks, selection and similarity."""

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import text as X
from quorumlake.functions.extraction import extract_answers
from quorumlake.operators import metrics, selection, voting
from quorumlake.operators.pool import coverage, require_coverage
from quorumlake.operators.similarity import similarity_join
from quorumlake.sources import tables as S

CASES = [
    ("FINAL_ANSWER: -0", "0", "final_answer_marker"),
    ("final_answer : 1,234", "1234", "final_answer_marker"),
    (r"so \boxed{-12}", "-12", "boxed"),
    (r"\boxed{3} then FINAL_ANSWER: 3", "3", "final_answer_marker"),
    (r"\boxed{3}" + "\nFINAL_ANSWER: 4", None, "none"),
    ("FINAL_ANSWER: 12.000", "12", "final_answer_marker"),
    ("FINAL_ANSWER: 12.5", None, "none"),
    ("FINAL_ANSWER: **42** dollars", "42", "final_answer_marker"),
    ("FINAL_ANSWER: 3 + 4", None, "none"),
    ("FINAL_ANSWER:", None, "none"),
    ("work\n17", "17", "standalone_last_line"),
    ("we count 5 and 9 apples.", "9", "last_integer"),
    ("about 3.5 of 7 then 1/2", "7", "last_integer"),
    ("only 3.5", None, "none"),
    ("１２", "12", "standalone_last_line"),
    ("FINAL_ANSWER: 007", None, "none"),
    (r"\boxed{5", None, "none"),
    ("nothing", None, "none"),
    ("", None, "none"),
    (None, None, "none"),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["extraction"] for r in extract_answers(df, "t").collect()}
    for i, (text, answer, path) in enumerate(CASES):
        assert (got[i]["answer"], got[i]["path"]) == (answer, path), text
    assert got[4]["failure_reason"] == "conflicting_explicit_answers"
    assert got[6]["failure_reason"] == "non_integer_only"
    assert got[17]["failure_reason"] == "no_supported_answer_marker"


def pool(spark, *rows):
    return spark.createDataFrame([(q, i, a, float(s), arm, t) for q, i, a, s, arm, t in rows], "id long, sample_index int, answer string, score double, arm int, trace long")


def test_majority_ties_and_invalid(spark):
    p = pool(spark, (1, 0, "2", 0, 0, 1), (1, 1, "1", 0, 0, 2), (2, 0, None, 0, 0, 3), (3, 0, "9", 0, 0, 4), (3, 1, None, 0, 0, 5))
    got = {r["id"]: r for r in voting.majority(p).collect()}
    assert got[1]["answer"] == "2" and got[1]["tie"] and got[1]["agreement"] == 0.5
    assert got[2]["answer"] is None and got[2]["agreement"] == 0 and got[2]["valid"] == 0
    assert got[3]["answer"] == "9" and got[3]["agreement"] == 0.5


def test_geometric_vote(spark):
    p = pool(spark, (1, 0, "10", 0.9, 0, 1), (1, 1, "10", 0.9, 0, 2), (1, 2, "20", 0.99, 0, 3), (2, 0, "7", 0.9, 0, 1), (2, 1, "7", 0.1, 0, 1), (3, 0, "5", float("nan"), 0, 1), (3, 1, "6", 1.0, 0, 1))
    got = {r["id"]: r for r in voting.geometric_vote(p).collect()}
    assert got[1]["answer"] == "10" and abs(got[1]["weight"] - 1.8) < 1e-9
    assert abs(got[2]["weight"] - 0.6) < 1e-9
    assert got[3]["answer"] == "5" and got[3]["fallback"]


def test_weighted_vote(spark):
    p = pool(spark, (1, 0, "w", 0.1, 0, 1), (1, 1, "w", 0.1, 0, 1), (1, 2, "s", 1, 0, 1), (2, 0, "a", 0, 0, 1), (2, 1, "b", 0.7, 0, 1), (2, 2, "a", 0.7, 0, 1), (3, 0, "x", 0, 0, 1), (3, 1, "y", 0, 0, 1))
    got = {r["id"]: r for r in voting.weighted_majority(p, F.round(F.col("score") * 10).cast("long")).collect()}
    assert got[1]["answer"] == "s"
    assert got[2]["answer"] == "b"  # a's first occurrence weighs nothing, so b came first
    assert got[3]["answer"] == "x" and got[3]["fallback"]


def test_arm_votes(spark):
    p = pool(spark, (1, 0, "1", 0, 0, 1), (1, 1, "1", 0, 0, 1), (1, 2, "2", 0, 0, 1), (1, 0, "2", 0, 1, 1), (2, 0, None, 0, 0, 1))
    got = {r["id"]: r["answer"] for r in voting.arm_normalised_vote(p).collect()}
    assert got == {1: "2", 2: None}
    assert {r["id"]: r["answer"] for r in voting.flat_vote(p).collect()} == {1: "1", 2: None}


def test_coverage(spark):
    p = pool(spark, (1, 0, "1", 0, 0, 1), (1, 1, "1", 0, 0, 1), (3, 0, "1", 0, 0, 1))
    expected = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r["id"]: (r["missing"], r["extra"], r["samples"]) for r in coverage(p, expected, 2).collect()}
    assert got == {1: (False, False, 2), 2: (True, False, 0), 3: (False, True, 1)}
    with pytest.raises(ValueError):
        require_coverage(p, expected, 2)


def test_mcnemar_and_auc(spark):
    pairs = spark.createDataFrame([(True, False)] * 1 + [(False, True)] * 5 + [(True, True)] * 4, "a boolean, b boolean")
    r = metrics.mcnemar(pairs, "a", "b").first()
    assert (r["only_a"], r["only_b"]) == (1, 5) and abs(r["p_value"] - 2 * 7 / 64) < 1e-12
    assert metrics.mcnemar(pairs.limit(0), "a", "b").first()["p_value"] == 1.0
    scored = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.auc(scored, "y", "s").first()["auc"] == 0.625
    assert metrics.auc(scored.where("y = 1"), "y", "s").first()["auc"] is None


def test_sequential_selections(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 2)], "g string, n int")
    folds = {r["g"]: r["fold"] for r in selection.lpt_folds(sizes, "g", "n", 2).collect()}
    assert folds == {"a": 0, "b": 1, "c": 1, "d": 0}
    items = spark.createDataFrame([("s", 1, 6), ("s", 2, 5), ("s", 3, 4), ("s", 4, 5)], "s string, k int, n int")
    bins = {}
    for r in selection.pack(items, ["s"], "k", "n", 10).collect():
        bins.setdefault(r["bin"], []).append(r["k"])
    assert sorted(map(sorted, bins.values())) == [[1, 3], [2, 4]]


def test_similarity_of_all_documents(spark, tmp_path):
    import random

    from quorumlake.queries import QUERIES

    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(400)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(6)]
    texts = {}
    for i in range(40):
        text = list(r.choice(base))
        for _ in range(i % 4):
            text[r.randrange(60)] = r.choice(words)
        texts[i] = " ".join(text)
    texts |= {50: " ".join(base[0]), 52: " ".join(base[0]), 53: " ".join(words[:60]), 55: " ".join(words[:60]), 57: "", 60: "aa bb"}
    items = {1: " ".join(base[1]), 2: " ".join([*base[2][:58], "qq", "rr"]), 3: "nothing like it"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())

    def alike(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    got = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in ("j9_set_similarity_join", "j10_near_duplicate_ids", "j11_contamination_cascade", "plan_external_corpus")}
    sets, bags = {i: shingles(t) for i, t in texts.items()}, {i: set(t.split()) for i, t in texts.items()}
    pairs = {(a, b): alike(sets[a], sets[b]) for a in texts for b in texts if a < b}
    want = {p: round(s, 9) for p, s in pairs.items() if s >= 0.8}
    assert {(x["l"], x["r"]): x["jaccard"] for x in got["j9_set_similarity_join"]} == want and len(got["j9_set_similarity_join"]) == len(want)
    assert {p for p in want if sum(p) % 2 == 0} and {p for p in want if sum(p) % 2}
    assert {x["doc_id"] for x in got["j10_near_duplicate_ids"]} == {i for p in pairs if alike(bags[p[0]], bags[p[1]]) >= 0.9 for i in p}
    kinds = {}
    for i, t in texts.items():
        exact = [k for k, x in items.items() if x == t]
        near = sorted((-alike(sets[i], shingles(x)), k) for k, x in items.items() if alike(sets[i], shingles(x)) >= 0.8)
        kinds[i] = ("exact", exact[0]) if exact else ("near", near[0][1]) if near else ("none", None)
    assert {x["doc_id"]: (x["kind"], x["match"]) for x in got["j11_contamination_cascade"]} == kinds and {k for k, _ in kinds.values()} == {"exact", "near", "none"}
    first = {t: min(i for i in texts if texts[i] == t) for t in texts.values() if len(t) > 300}
    assert {x["key"] for x in got["plan_external_corpus"]} == {i for i in first.values() if kinds[i][0] == "none"}


def test_similarity_join(spark):
    rows = [(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "e"]), (3, []), (4, ["x"])]
    df = spark.createDataFrame(rows, "key long, items array<string>")
    got = sorted((r["l"], r["r"], round(r["jaccard"], 3)) for r in similarity_join(df, df, 0.6).collect())
    assert got == [(1, 1, 1.0), (1, 2, 0.6), (2, 1, 0.6), (2, 2, 1.0), (4, 4, 1.0)]


def test_hash_fold_matches_big_integer(spark):
    import hashlib

    got = spark.range(20).select("id", X.hash_fold(F.col("id"), 7).alias("f")).collect()
    assert all(r["f"] == int(hashlib.sha256(str(r["id"]).encode()).hexdigest(), 16) % 7 for r in got)


def test_strict_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿id , answer\n1,a\n2,b\n".encode())
    df = S.read_csv(spark, f"file://{tmp_path}/x.csv", ["id", "answer"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "a"), ("2", "b")]
    with pytest.raises(ValueError):
        S.read_csv(spark, f"file://{tmp_path}/x.csv", ["id", "gold"])
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\nnot json\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "id string").collect()


def test_extraction_cases(spark):
    """Markers, boxes, last lines and bodies, each with the answer or the reason that there is none."""
    from quorumlake.functions.extraction import extract_answers

    final, box, line, body = "final_answer_marker", "boxed", "standalone_last_line", "last_integer"
    none, mixed, clash = "no_supported_answer_marker", "non_integer_only", "conflicting_explicit_answers"
    cases = [
        ("FINAL_ANSWER: -0", "0", final), ("FINAL_ANSWER: 1,234", "1234", final), ("so \\boxed{-317}.", "-317", box), ("FINAL_ANSWER: 42 km/h", "42", final),
        ("\\boxed{4}.\nFINAL_ANSWER: 5", None, clash), ("done.\n-19", "-19", line), ("it went 11 and 23 before", "23", body), ("ended at 23.\nFINAL_ANSWER:", None, none),
        ("\\boxed{17}\nFINAL_ANSWER: \\frac{1}{2}", None, mixed), ("FINAL_ANSWER: +1,234.000", "1234", final), ("\\boxed{400}\nFINAL_ANSWER: $400.00", "400", final),
        ("it is 1 3/4.", None, mixed), ("it is 1\\frac{3}{4}.", None, mixed), ("it is .5", None, mixed), ("FINAL_ANSWER: 1e3", None, mixed), ("FINAL_ANSWER: 00400.00", None, mixed),
        ("\\boxed{\\boxed{5}}", None, mixed), ("\\boxed{400", None, mixed), ("\\[\\text{FINAL_ANSWER: } 42 \\text{ km/h}\\]", "42", final), ("FINAL_ANSWER: −１２.００ units", "-12", final),
        ("", None, none), (None, None, none), ("x².", None, none), ("5 6 7/8", "5", body), ("1,234 and 007", "1234", body),
    ]
    rows = spark.createDataFrame([(i, c[0], "kept") for i, c in enumerate(cases)], "i int, t string, extra string")
    out = extract_answers(rows, "t")
    assert out.columns == ["i", "t", "extra", "extraction"]
    for r in out.collect():
        e, (_, answer, told) = r["extraction"], cases[r["i"]]
        assert (e["answer"], e["path"] if answer else e["failure_reason"]) == (answer, told), cases[r["i"]]
    two = extract_answers(spark.createDataFrame([("\\boxed{7} FINAL_ANSWER: 7\n\\boxed{7}",)], "t string"), "t").first()["extraction"]
    assert two["explicit_candidates"] == ["7", "7", "7"] and two["path"] == final


def test_templates(spark):
    import re

    from quorumlake.functions import text as X

    def plain(t):
        t = re.sub(r"(?<![a-z_])[+-]?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*/\s*[0-9][0-9,]*)?(?![a-z_])", " <num> ", t.lower())
        return " ".join(re.sub("[^a-z<>]+", " ", t).split())

    texts = ["Tom has 3 apples and 1,200.50 pears", "x2 2nd a_5 -7/8 <b> 1/2", "", "...", "5", "10 - 5 = 5, 3.14.15"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.template(F.col("t")).alias("m"), F.size(X.tokens(F.col("t"))).alias("n"))
    for r in rows.collect():
        assert r["m"] == plain(r["t"]) and r["n"] == len(re.findall("[a-z]+|<num>", plain(r["t"])))
    told = spark.createDataFrame([("The cost for Alice is $5.50 or 12 km/h at HTTPS://x.y/z  End",)], "t string")
    assert told.select(X.placeholder_template(F.col("t"), ["the", "end"])).first()[0] == "the cost for <name> is <currency> <num> or <num> <unit> at <url> end"


def test_mcnemar_at_any_count():
    import math
    from fractions import Fraction

    from quorumlake.operators.metrics import mcnemar_p

    for a, b in ((0, 0), (0, 5), (3, 10), (40, 70), (450, 500), (7, 7), (0, 60)):
        n, low = a + b, min(a, b)
        exact = min(Fraction(1), 2 * sum(Fraction(math.comb(n, i), 2**n) for i in range(low + 1)))
        assert abs(mcnemar_p(a, b) - float(exact)) <= 1e-12 * float(exact)
    assert abs(mcnemar_p(500_000_000, 500_100_000) - math.erfc((100_000 - 1) / math.sqrt(1_000_100_000) / math.sqrt(2))) < 1e-6


def test_similarity_join_of_copies(spark):
    """Copies are one set until the end; every pair of rows is there."""
    from quorumlake.operators.similarity import similarity_join

    sets = [list("abcdefghij"), list("abcdefghix"), list("abcdefghij"), list("klm"), [], list("klm"), list("abcdefghijy")]
    rows = spark.createDataFrame(list(enumerate(sets)), "key int, items array<string>")
    want = {(i, j, len(set(a) & set(b))) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8}
    assert {tuple(r)[:3] for r in similarity_join(rows, rows, 0.8).collect()} == want
    assert {tuple(r)[:3] for r in similarity_join(rows, rows, 0.8, once=True).collect()} == {w for w in want if w[0] < w[1]}


def test_ranked_and_scored(spark):
    from quorumlake.operators.pool import scored
    from quorumlake.operators.selection import ranked

    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert [r["at"] for r in ranked(rows, ["k"], "at", 64).orderBy("k").collect()] == list(range(1000))
    pool = spark.createDataFrame([(1, 0), (1, 1)], "id int, sample_index int")
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7)], "id int, sample_index int, score double")
    assert sorted(r["score"] for r in scored(pool, scores).collect()) == [0.5, 0.7]
    with pytest.raises(Exception, match="differ in their keys"):
        scored(pool, scores.limit(1)).collect()
