"""Balanced buckets, ranks over range partitions, folds by id, copies of a
dimension, keyword lift, technique effects, occurrence alignment, resumed
inference, padded batches, source index, first appearance, linear folding."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelforge.functions import labels as LB
from labelforge.functions import text as TX
from labelforge.operators import auroc as A
from labelforge.operators import dims as D
from labelforge.operators import errors as ER
from labelforge.operators import inference as INF
from labelforge.operators import metrics as M
from labelforge.operators import prepare as P
from labelforge.operators import rank as RK
from labelforge.operators import reports as RP
from labelforge.operators import split as X
from labelforge.sources import files as IO


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- E6, E7

def brute_auroc(rows):
    order = lambda v: (1, 0.0) if math.isnan(v) else (0, v)  # noqa: E731  NaN is the highest
    pos = [order(s) for s, y in rows if y and s is not None]
    neg = [order(s) for s, y in rows if y == 0 and s is not None]
    if not pos or not neg:
        return None
    return sum((n < p) + 0.5 * (n == p) for p in pos for n in neg) / (len(pos) * len(neg))


def test_no_score_bucket_is_hot(spark):
    r = np.random.default_rng(3)
    scores = np.exp(10 * r.standard_normal(100_000))
    df = spark.createDataFrame(pd.DataFrame({"c": "a", "score": scores}))
    got = A.score_buckets(df, ["c"], "score").groupBy("__b").count().toPandas()
    assert got["count"].max() <= 0.01 * len(scores) and len(got) > 900
    edges = A.score_buckets(df, ["c"], "score").groupBy("__b").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("__b").collect()
    assert all(x["hi"] < y["lo"] for x, y in zip(edges, edges[1:]))


@pytest.mark.parametrize("buckets", [2, 8, 1024])
def test_auroc_of_odd_curves(spark, buckets):
    r = random.Random(5)
    curves = {
        "heavy": [(math.exp(10 * r.gauss(0, 1)), int(r.random() < 0.3)) for _ in range(700)],
        "ties": [(float(r.randint(0, 3)), int(r.random() < 0.5)) for _ in range(500)],
        "wild": [(r.choice([float("inf"), float("-inf"), float("nan"), 0.0, -1e308, 1e308]), int(r.random() < 0.5)) for _ in range(300)],
        "all nan": [(float("nan"), 1), (float("nan"), 0)],
        "one class": [(1.0, 1), (2.0, 1)], "none": [(None, 1), (1.0, None)],
        None: [(0.5, 1), (0.4, 0), (0.5, 0), (None, 1)],
    }
    rows = [(k, s, y) for k, v in curves.items() for s, y in v]
    df = spark.createDataFrame(rows, "c string, score double, is_true int").repartition(4)
    got = {x["c"]: x["auroc"] for x in A.auroc(df, ["c"], buckets=buckets).collect()}
    for k, v in curves.items():
        want = brute_auroc([x for x in v if x[1] is not None])
        assert got.get(k) == (want if want is None else pytest.approx(want, abs=1e-12)), k


def test_cut_points_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_CUTS", 1)
    df = spark.createDataFrame([(c, float(i), i % 2) for c in "ab" for i in range(50)], "c string, score double, is_true int")
    got = {x["c"]: x["auroc"] for x in A.auroc(df, ["c"], buckets=16).collect()}
    assert got == {c: pytest.approx(brute_auroc([(float(i), i % 2) for i in range(50)])) for c in "ab"}


def test_rows_without_a_place_are_counted(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 1), ("a", None, None), ("b", 2.0, None)], "c string, score double, is_true int")
    assert sorted(tuple(r) for r in A.unranked(df, ["c"]).collect()) == [("a", 3, 2, 1, 2), ("b", 1, 0, 1, 1)]


# ---- E12, numbering

def test_codes_of_many_classes_use_no_single_task(spark):
    df = spark.range(120_000).select(F.concat(F.lit("c"), F.md5(F.col("id").cast("string"))).alias("correct"),
                                     F.when(F.col("id") % 1000 != 0, F.concat(F.lit("c"), F.md5((F.col("id") % 7).cast("string")))).alias("predicted"))
    out = M.label_encode(df)
    assert "SinglePartition" not in plan(out)
    got = out.toPandas()
    assert got["code"].tolist() != [] and sorted(got["code"]) == list(range(len(got)))
    known = got[got.cls.notna()].sort_values("code")["cls"].tolist()
    assert known == sorted(known) and got[got.cls.isna()]["code"].tolist() == [len(got) - 1]


def test_numbers_within_keys(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(5000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    got = defaultdict(list)
    for x in RK.numbered(df, ["k"], [F.col("v").desc()], "n").collect():
        got[x["k"]].append((x["n"], x["v"]))
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(sorted(v, reverse=True))) for k, v in want.items()}
    assert RK.numbered(df.limit(0), ["k"], [F.col("v").asc()], "n").count() == 0
    assert RK.numbered(df.limit(0), [], [F.col("v").asc()], "n").count() == 0


def test_a_hot_key_is_dealt_over_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
        by = df.repartitionByRange("k", "v").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert len(by) > 4 and by.max() < 10_000
        assert RK.numbered(df, ["k"], [F.col("v").asc()], "n").where("n <> v").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


# ---- X3

def test_folds_move_no_text(spark):
    rows = [(i, None if i % 7 == 0 else f"c{i % 3}", "long text " * 20) for i in range(3000)] + [(None, "c1", "x"), (5, "c2", "again")]
    df = IO.materialize(spark.createDataFrame(rows, "id long, label string, report string"), "t-folds")
    out = X.stratified_kfold(df, "id", "label")
    text = plan(out)
    for at in [i for i in range(len(text)) if text.startswith("Exchange", i)]:
        below = text[at:].split("BroadcastExchange")[0]
        assert "report" not in below
    assert out.count() == len(rows) and out.filter("id = 5").select("fold").distinct().count() == 1


def test_folds_of_a_large_table_are_joined(spark, monkeypatch):
    rows = [(i, f"c{i % 3}", "t") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, label string, report string")
    want = sorted(tuple(r) for r in X.stratified_kfold(df, "id", "label").collect())
    monkeypatch.setattr(X, "BROADCAST_FOLDS", 0)
    assert sorted(tuple(r) for r in X.stratified_kfold(df, "id", "label").collect()) == want
    ranked = X.stratified_rank(df, "id", "label").collect()
    earlier = {"c0": 0, "c1": 300, "c2": 600}
    assert want == sorted((r["id"], r["label"], "t", (earlier[r["label"]] + r["rank_in_label"] - 1) % 5) for r in ranked)


# ---- J2

def test_copies_follow_the_sizes():
    mb = 1 << 20
    assert D.copies(100 * mb, 1000, 8) == 64  # every partition gets several keys
    assert D.copies(10, 10, 8) == 8  # a small table: a key for each partition
    assert D.copies(1 << 40, mb, 200) == (1 << 40) // D.SHARE_BYTES  # a large one: bounded shares
    assert D.copies(100 * mb, 50 * mb, 8) == 8  # a dimension as large as the table isn't copied further
    assert D.copies(1 << 62, 1, 8) == D.copies(1 << 62, 1 << 62, 8) == D.MOST_KEYS


def test_a_dimension_that_is_not_broadcast_uses_all_tasks(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in zip(names, ("-1", "-1", "false")):
            spark.conf.set(n, v)
        df = IO.materialize(spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("t")), "t-dims")
        dim = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "ord int, p string")
        out = D.attach(df, dim)
        assert "BroadcastHashJoin" not in plan(out) and "Cartesian" not in plan(out) and "NestedLoop" not in plan(out)
        per = out.groupBy(F.spark_partition_id().alias("x")).count().toPandas()["count"]
        assert per.sum() == 1_000_000 and len(per) == int(spark.conf.get("spark.sql.shuffle.partitions")) and per.max() < 3 * per.min()
        assert out.select("id", "ord").distinct().count() == 1_000_000
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


# ---- T18, T21, T22

def test_sections_are_split_once(spark):
    df = IO.materialize(spark.createDataFrame([(1, "FINDINGS: improved")], "report_id long, report string"), "t-kw")
    assert plan(RP.keyword_label(df).where("primary_rate >= 0")).count("regexp_replace") <= 3
    assert plan(RP.phrase_label(df).where("share > 0")).count("regexp_count") <= 2 * len(RP.PHRASE_LABELS)


def test_keyword_lift(spark):
    reports = [(i, "FINDINGS: stable disease noted. improved\nCONCLUSION: " + ("r/o x, r/o y" if i % 2 else "fine")) for i in range(20)] + [(20, None), (21, "")]
    preds = [(i, p, "mets", "no" if i % 4 == 1 else "mets") for i in range(20) for p in ("a", None)] + [(20, "a", "mets", None), (21, "a", None, "no"), (99, "a", "x", "y")]
    out = RP.keyword_lift(spark.createDataFrame(preds, "report_id long, prompt_id string, correct string, predicted string"),
                          spark.createDataFrame(reports, "report_id long, report string"))
    got = {(r["prompt_id"], r["correct"], r["predicted"], r["section"], r["keyword"]): r for r in out.collect()}
    assert {k[2] for k in got} == {"no"} and {k[0] for k in got} == {"a", None}
    r = got[None, "mets", "no", "CONCLUSION", "r/o"]  # 5 errors, all with it; 15 right, 5 with it
    assert (r["n_error"], r["error_rows"], r["n_correct"], r["correct_rows"]) == (5, 5, 5, 15)
    assert r["lift"] == pytest.approx(math.log(5.5 / 0.5) - math.log(5.5 / 10.5))
    r = got["a", "mets", "no", "FINDINGS", "improved"]
    assert (r["n_error"], r["n_correct"]) == (5, 15) and r["lift"] == pytest.approx(math.log(5.5 / 0.5) - math.log(15.5 / 0.5))


# ---- E17

def test_technique_effects_are_those_of_the_normal_equations(spark):
    r = np.random.default_rng(2)
    names = ["a", "b", "c", "d"]
    flags = {f"p{i}": dict(zip(names, (r.random(4) < 0.5).tolist())) for i in range(12)}
    for f in flags.values():
        f["d"] = f["c"]  # always together
    true = {"a": 0.3, "b": -0.2, "c": 0.1, "d": 0.05}
    rows = [(p, 0.5 + sum(true[n] for n in names if f[n]) + r.normal(0, 0.01)) for p, f in flags.items() for _ in range(int(r.integers(1, 40)))]
    feats = [(p, n, v) for p, f in flags.items() for n, v in f.items()]
    df = spark.createDataFrame([(p, float(v)) for p, v in rows] + [("p0", None), ("unknown", 1.0)], "prompt_id string, y double")
    out = ER.technique_effects(df, spark.createDataFrame(feats, "prompt_id string, feature string, present boolean"), "y", techniques=names)
    got = {x["feature"]: x for x in out.collect()}
    x = np.array([[1.0] + [float(flags[p][n]) for n in names] for p, _ in rows])
    a = x.T @ x + np.diag([0] + [1e-3 * len(rows)] * 4)
    want = np.linalg.solve(a, x.T @ np.array([v for _, v in rows]))
    assert [got[n]["effect"] for n in ["(all)", *names]] == pytest.approx(want.tolist(), abs=1e-9)
    assert got["a"]["effect"] == pytest.approx(0.3, abs=0.02) and got["c"]["effect"] == pytest.approx(0.075, abs=0.02)
    assert [got[n]["separable"] for n in names] == [True, True, False, False]
    assert got["a"]["n_prompts"] == sum(f["a"] for f in flags.values())
    empty = ER.technique_effects(df.limit(0), spark.createDataFrame(feats, "prompt_id string, feature string, present boolean"), "y", techniques=names)
    assert {x["effect"] for x in empty.collect()} == {None}


# ---- J1

def test_repeated_keys_meet_one_to_one(spark):
    left = [("a", i) for i in range(5)] + [("b", 0), (None, 1), ("l", 1), ("l", 2)]
    right = [("a", i) for i in range(3)] + [("b", 0), ("b", 1), ("b", 2), (None, 1), ("r", 7)]
    p = spark.createDataFrame(left, "k string, i int").repartition(3)
    r = spark.createDataFrame(right, "k string, j int").repartition(3)
    out = ER.align_by_occurrence(p, r, "k", [F.col("i").asc()], [F.col("j").asc()])
    got = Counter((x["k"], x["i"], x["j"]) for x in out.collect())
    assert got == Counter([("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("a", 3, None), ("a", 4, None), ("b", 0, 0), ("b", None, 1), ("b", None, 2),
                           (None, 1, None), (None, None, 1), ("l", 1, None), ("l", 2, None), ("r", None, 7)])
    assert tuple(ER.occurrence_audit(out, "k").first()) == (4, 2, 2, 3, 2)


# ---- I1

def _counting(calls, broken_after):
    """A scorer that counts its prompts, and fails from ``broken_after`` on."""
    def factory():
        def score(prompts):
            if broken_after is not None and prompts.str.startswith("9").any():
                raise RuntimeError("killed")
            calls.add(len(prompts))
            return "r:" + prompts
        return score
    return factory


def test_a_broken_run_goes_on_where_it_ended(spark):
    n = 400
    req = spark.createDataFrame([(i, f"{i % 10} prompt {i}") for i in range(n)], "id long, prompt string")
    store = IO.scratch_path(spark, "t-store")
    first, second, third = (spark.sparkContext.accumulator(0) for _ in range(3))
    with pytest.raises(Exception, match="killed"):
        INF.resume_inference(req, _counting(first, 1), store, "run", ["id"], slices=8)
    partial = INF.resume_inference(req.where("prompt not like '9%'"), _counting(first, None), store, "run", ["id"], slices=8, max_slices=3)
    done = partial.count()
    assert 0 < done < n
    out = INF.resume_inference(req, _counting(second, None), store, "run", ["id"], slices=8)
    assert second.value == n - done and out.count() == n
    assert {(r["id"], r["response"]) for r in out.collect()} == {(i, f"r:{i % 10} prompt {i}") for i in range(n)}
    assert INF.resume_inference(req, _counting(third, None), store, "run", ["id"], slices=8).count() == n and third.value == 0
    assert INF.resume_inference(req, _counting(third, None), store, "other", ["id"], slices=8).count() == n and third.value == n
    assert INF.resume_inference(req.limit(0), _counting(third, None), store, "empty", ["id"]).count() == 0


# ---- P11

def test_runs_stay_within_the_budget():
    assert P.padded_runs(np.array([], dtype=np.int64), 10) == []
    assert P.padded_runs(np.array([0, 0, 0, 0]), 2) == [2, 4]
    assert P.padded_runs(np.array([1, 2, 3, 50, 1]), 9) == [3, 4, 5]
    r = random.Random(3)
    for _ in range(200):
        n = sorted(r.randint(0, 40) for _ in range(r.randint(1, 60)))
        budget = r.randint(1, 200)
        ends = P.padded_runs(np.array(n), budget)
        for x, y in zip([0, *ends], ends):
            assert y - x == 1 or max(max(n[x:y]), 1) * (y - x) <= budget
            assert y == len(n) or max(n[y], 1) * (y + 1 - x) > budget  # takes all it can


def test_the_scorer_gets_padded_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    def factory():
        def score(p):
            n = p.str.len()
            if len(p) > 1 and n.max() * len(p) > 500:
                raise RuntimeError("over budget")
            sizes.add(1)
            return p
        return score

    rows = [(i, "x" * (1 + i * 7 % 90)) for i in range(1500)] + [(9000, "y" * 2000), (9001, None)]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(2)
    got = {r["id"]: r["response"] for r in INF.batch_inference(df, factory, keys=["id"], max_padded=500).collect()}
    assert got == dict(rows)
    report = P.padding_report(P.padded_batches(df, 500, "prompt"), 500).first()
    assert (report["n_rows"], report["n_over_budget"], report["n_long_rows"]) == (1502, 0, 1)
    assert report["max_padded"] <= 500 and 0 <= report["padding"] < 0.15 and abs(report["n_batches"] - sizes.value) <= 2


# ---- P8

@pytest.mark.parametrize("multi_line", [True, False])
def test_source_index_does_not_depend_on_splits(spark, multi_line):
    path = IO.scratch_path(spark, "t-index")
    text = (lambda i: f"line {i}\nnext, \"{i}\"") if multi_line else (lambda i: f"line {i}, \"{i}\"")
    df = spark.createDataFrame([(i, text(i)) for i in range(3000)], "id long, t string").repartitionByRange(3, "id").sortWithinPartitions("id")
    IO.write_csv(df, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    try:
        for size in (before, "3000", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            x = IO.read_csv_indexed(spark, path, "id long, t string", multi_line=multi_line)
            assert multi_line or size != "3000" or x.rdd.getNumPartitions() > 20
            got.append(sorted((r["row_id"], r["id"], r["t"]) for r in x.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1] == got[2] == [(i, i, text(i)) for i in range(3000)]


def test_source_index_of_json_and_of_nothing(spark):
    path = IO.scratch_path(spark, "t-json")
    IO.write_json(spark.createDataFrame([(i, "é\n") for i in range(500)], "id long, t string").coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        x = IO.read_json_indexed(spark, path, "id long, t string")
        assert sorted((r["row_id"], r["id"]) for r in x.collect()) == [(i, i) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    none = IO.scratch_path(spark, "t-none")
    IO.write_csv(spark.createDataFrame([], "id long, t string"), none)
    assert IO.read_csv_indexed(spark, none, "id long, t string").count() == 0


# ---- E8, J4

def test_columns_by_first_mention(spark):
    rows = [("p", 2, "no: 1, stable: 3"), ("p", 1, "x: 9 stable: 95 then mets: 4, stable: 1"), ("q", 5, None), ("q", 6, "mets: 1"), (None, 1, "romets: 2")]
    df = spark.createDataFrame(rows, "prompt_id string, doc_id long, response string")
    got = {r["prompt_id"]: r["column_order"] for r in A.first_mention_order(df, ["prompt_id"], "response", "doc_id").collect()}
    assert got["p"] == ["stable", "mets", "no", "progression", "improved", "romets"]
    assert got["q"] == ["no", "mets", "progression", "stable", "improved", "romets"] and got[None][0] == "romets"


def test_metrics_on_the_first_row_only(spark):
    rows = [("p", 3, "no", "no"), ("p", 1, "no", "mets"), (None, 9, "no", "no"), (None, 8, "no", "no")]
    out = M.metrics_on_first_row(spark.createDataFrame(rows, "prompt_id string, doc_id long, correct string, predicted string"), ["prompt_id"], "doc_id")
    assert {r["doc_id"]: r["accuracy"] for r in out.collect()} == {1: 0.5, 3: None, 8: 1.0, 9: None}


# ---- T5, T6

def test_many_key_value_lines_fold_in_linear_time(spark):
    def dict_argmax(text):
        d = {}
        for line in text.splitlines():
            k, v = line.split(":")
            d[k.strip()] = float(v)
        return max(d, key=d.get)

    r = random.Random(4)
    texts = ["\n".join(f"k{r.randint(0, m)}: {r.randint(0, 500)}" for _ in range(n)) for n, m in ((1, 1), (2, 1), (50, 10), (300, 5), (10_000, 9_000), (20_000, 3))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    start = time.time()
    got = {x["i"]: x["label"] for x in LB.with_multi_stage_label(df, "t", "label").collect()}
    assert time.time() - start < 20
    assert got == {i: dict_argmax(t) for i, t in enumerate(texts)}
    x = df.withColumn("l", TX.splitlines("t")).select("i", LB.key_value_argmax(LB.key_value_entries(F.col("l"))).alias("label"))
    assert {r["i"]: r["label"] for r in x.where("i < 4").collect()} == {i: dict_argmax(t) for i, t in enumerate(texts[:4])}


# ---- sided reports and repeated keys, formerly cut out of the queries

def test_one_sided_and_repeated_reports(spark):
    p = spark.createDataFrame([(i, "no", "no" if i % 3 else "mets") for i in range(60)], "report_id long, correct string, predicted string")
    r = ER.before_after(p.filter("report_id % 19 <> 2"), p.filter("report_id % 23 <> 4")).first()
    only_b, only_a = [i for i in range(60) if i % 19 != 2 and i % 23 == 4], [i for i in range(60) if i % 19 == 2 and i % 23 != 4]
    assert (r["n_only_before"], r["n_only_after"]) == (len(only_b), len(only_a)) and r["n"] + len(only_b) + len(only_a) == 60
    some = p.unionAll(p.filter("report_id % 3 = 0"))
    assert tuple(ER.duplicate_keys(some, "report_id").first()) == (20, 20)

