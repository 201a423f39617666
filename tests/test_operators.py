"""Operator tests against brute force on small inputs (property style)."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelforge.operators import auroc as A
from labelforge.operators import metrics as M
from labelforge.operators import split as X
from labelforge.operators.rank import exclusive_prefix
from labelforge.schema import LABELS


def py_macro(pairs, zero_division=0.0):
    classes = {c for c, _ in pairs} | {p for _, p in pairs}
    P = R = F1 = 0.0
    for k in classes:
        tp = sum(1 for c, p in pairs if c == k and p == k)
        npred = sum(1 for _, p in pairs if p == k)
        ntrue = sum(1 for c, _ in pairs if c == k)
        P += tp / npred if npred else zero_division
        R += tp / ntrue if ntrue else zero_division
        F1 += 2 * tp / (ntrue + npred)
    n = len(classes)
    return sum(1 for c, p in pairs if c == p) / len(pairs), P / n, R / n, F1 / n


labels_or_junk = st.sampled_from(LABELS[:4] + ["junk", None])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(LABELS[:4]), labels_or_junk), min_size=1, max_size=40),
       st.sampled_from([0.0, 1.0]))
def test_macro_metrics_match_bruteforce(spark, pairs, zd):
    df = spark.createDataFrame(pairs, "correct string, predicted string")
    r = M.macro_metrics(df, zero_division=zd).first()
    exp = py_macro(pairs, zd)
    got = (r["accuracy"], r["precision"], r["recall"], r["f1_score"])
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, exp))


def py_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y]
    neg = [s for y, s in zip(ys, ss) if not y]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 7)), min_size=1, max_size=60))
def test_auroc_matches_pair_count(spark, rows):
    df = spark.createDataFrame([(y, float(s)) for y, s in rows], "y int, score double").withColumn("g", F.lit(1))
    got = A.auroc(df, ["g"], "score", "y", buckets=4).first()["auroc"]
    exp = py_auc([y for y, _ in rows], [s for _, s in rows])
    assert (got is None and exp is None) or abs(got - exp) < 1e-12


def test_auroc_symmetry(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 1), rnd.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, score double").withColumn("g", F.lit(1))
    a = A.auroc(df, ["g"], "score", "y").first()["auroc"]
    b = A.auroc(df.withColumn("score", -F.col("score")), ["g"], "score", "y").first()["auroc"]
    assert abs(a + b - 1.0) < 1e-12


def test_exclusive_prefix_matches_window(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), i, rnd.randint(1, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    df = df.withColumn("b1", (F.col("k") / 100).cast("int")).withColumn("b2", (F.col("k") / 10).cast("int"))
    got = {(r["g"], r["k"]): r["prefix"] for r in exclusive_prefix(df, ["g"], ["b1", "b2"], ["k"], "v").collect()}
    for g in "ab":
        run = 0
        for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[(g, k)] == run
            run += v


def test_split_contract(spark):
    rows = [(i, LABELS[i % 6] if i < 690 else "rare") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, label string")
    s = X.stratified_split(df, "id", "label")
    sizes = {r["split"]: r["n"] for r in X.split_sizes(s).collect()}
    assert sizes == {"train": 490, "eval": 105, "test": 105}
    assert s.select("id").distinct().count() == 700
    per = {(r["split"], r["label"]): r["n"] for r in X.split_sizes(s, "label").collect()}
    for lab in LABELS:  # proportional quotas within one row
        assert abs(per.get(("test", lab), 0) - 105 * 115 / 700) <= 1
    again = X.stratified_split(df.repartition(7), "id", "label")
    assert sorted(s.collect()) == sorted(again.select(*s.columns).collect())  # deterministic


def test_kfold_balance(spark):
    rows = [(i, LABELS[i % 3]) for i in range(103)]
    f = X.stratified_kfold(spark.createDataFrame(rows, "id long, label string"), "id", "label", k=5)
    counts = {}
    for r in f.groupBy("label", "fold").count().collect():
        counts.setdefault(r["label"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in counts.values())


def test_label_encode_null_last(spark):
    df = spark.createDataFrame([("mets", None), ("no", "x")], "correct string, predicted string")
    got = {r["cls"]: r["code"] for r in M.label_encode(df).collect()}
    assert got == {"mets": 0, "no": 1, "x": 2, None: 3}


def test_auroc_dense_cluster_with_outlier_is_exact(spark):
    # all but one score fall inside the first of 1024 first-level buckets;
    # the second level re-fits to that bucket's own range
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), rnd.random() * 1e-4) for _ in range(2000)] + [(1, 1000.0)]
    df = spark.createDataFrame(rows, "y int, score double").withColumn("g", F.lit(1))
    got = A.auroc(df, ["g"], "score", "y").first()["auroc"]
    exp = py_auc([y for y, _ in rows], [s for _, s in rows])
    assert abs(got - exp) < 1e-12


def test_split_with_hot_class_and_null_stratum(spark):
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 1 else f"c{i % 5}")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label string")
    s = X.stratified_split(df, "id", "label")
    assert s.count() == 3000 and s.select("id").distinct().count() == 3000
    ranks = {}
    for r in X.stratified_rank(df, "id", "label").collect():
        ranks.setdefault(r["label"], []).append(r["rank_in_label"])
    for lab, rk in ranks.items():  # dense 1..n within every class, NULL included
        assert sorted(rk) == list(range(1, len(rk) + 1)), lab
    sizes = {r["split"]: r["n"] for r in X.split_sizes(s).collect()}
    assert sizes["test"] + sizes["eval"] == 900 and sizes["test"] == 450


def py_positional(rows, labels):
    """Reference pairing: binariser over sorted present truths, score column i
    (label order) against truth column i; two classes -> one column."""
    classes = sorted({t for t, _ in rows})
    cols = [classes[1]] if len(classes) == 2 else classes
    out = {}
    for i, lab in enumerate(labels):
        if i >= len(cols):
            out[lab] = None
            continue
        out[lab] = py_auc([t == cols[i] for t, _ in rows], [s[lab] for _, s in rows])
    return out


@pytest.mark.parametrize("present", [LABELS, ["mets", "no", "stable", "romets"], ["stable", "no"]])
def test_positional_auroc_matches_reference_pairing(spark, present):
    rnd = random.Random(len(present))
    rows = [(present[i % len(present)], {lab: float(rnd.randint(0, 9)) for lab in LABELS}) for i in range(120)]
    long = [(i, t, lab, s[lab]) for i, (t, s) in enumerate(rows) for lab in LABELS]
    df = spark.createDataFrame(long, "row_id int, true_label string, label string, score double")
    got = {r["label"]: r["auroc"] for r in A.one_vs_rest_auroc(df, align="positional").collect()}
    exp = py_positional(rows, LABELS)
    assert set(got) == set(LABELS)
    for lab in LABELS:
        assert (got[lab] is None and exp[lab] is None) or abs(got[lab] - exp[lab]) < 1e-12, lab


@pytest.mark.parametrize("extra", [[(1, float("inf"))], [(0, float("-inf")), (1, float("inf"))],
                                   [(0, -1e308), (1, 1e308)]])
def test_auroc_with_extreme_scores(spark, extra):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), rnd.random()) for _ in range(300)] + extra
    df = spark.createDataFrame(rows, "y int, score double").withColumn("g", F.lit(1))
    got = A.auroc(df, ["g"], "score", "y", buckets=8).first()["auroc"]
    exp = py_auc([y for y, _ in rows], [s for _, s in rows])
    assert abs(got - exp) < 1e-12


def test_auroc_ignores_rows_without_score_or_target(spark):
    rows = [(1, 0.9), (0, 0.1), (1, None), (None, 0.5), (0, 0.8)]
    df = spark.createDataFrame(rows, "y int, score double").withColumn("g", F.lit(1))
    r = A.auroc(df, ["g"], "score", "y").first()
    assert (r["n_pos"], r["n_neg"], r["auroc"]) == (1, 2, 1.0)
