"""Behaviour mended after review: identity of scorers, replay, rendering, parsers,
sections, folds, sinks, catalogues, NULL handling."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelforge.functions import confidence as C
from labelforge.functions import labels as LB
from labelforge.functions import text as TX
from labelforge.operators import auroc as A
from labelforge.operators import inference as INF
from labelforge.operators import metrics as M
from labelforge.operators import prompts as PR
from labelforge.operators import reports as RP
from labelforge.operators import split as X
from labelforge.schema import LABELS
from labelforge.sources import files as IO


def _constant(value):
    return lambda: lambda prompts: pd.Series([value] * len(prompts))


def test_two_scorers_in_one_session(spark):
    req = spark.createDataFrame([(1, "abc"), (2, "d")], "doc_id long, prompt string")
    a = INF.batch_inference(req, _constant("A"), keys=["doc_id"])
    b = INF.batch_inference(req, _constant("B"), keys=["doc_id"], partitions=3, materialize=False)
    assert [r["response"] for r in a.collect()] == ["A", "A"] and [r["response"] for r in b.collect()] == ["B", "B"]


def test_replay_of_one_of_two_runs(spark):
    req = spark.createDataFrame([(1, "p"), (2, "p")], "doc_id long, prompt_id string")
    stored = spark.createDataFrame([(1, "p", "old", "r1"), (1, "p", "new", "r2"), (2, "p", None, "r2")],
                                   "doc_id long, prompt_id string, response string, run_id string")
    got = INF.replay(req, stored, ["doc_id", "prompt_id"], run_id="r2").orderBy("doc_id").collect()
    assert [r["response"] for r in got] == ["new", None]
    with pytest.raises(Exception, match="several stored responses"):
        INF.replay(req, stored, ["doc_id", "prompt_id"]).collect()


@pytest.mark.parametrize("template", ["{report} and {y_i}", "{{x}} {report}", "{{report}}", "{{{report}}}", "no field", "{y_i}{y_i}", "}}{{", ""])
def test_render_is_str_format(spark, template):
    rows = [("a {y_i} }} {{ text", "L"), ("plain", "{report}"), (None, None)]
    df = spark.createDataFrame(rows, "report string, y string").withColumn("t", F.lit(template))
    got = [r[0] for r in df.select(TX.render(F.col("t"), F.col("report"), F.col("y"))).collect()]
    assert got == [template.format(report="nan" if r is None else r, y_i="nan" if y is None else y) for r, y in rows]


@pytest.mark.parametrize("text", ["no: inf\nmets: 3", "no: 1\nmets: nan\nstable: 2", "no: nan\nmets: 5", "a: -nan\nb: -1", "x: Infinity\ny: inf",
                                  "x: 1e400\ny: INF", "p: +inf\nq: 2", "x: infin\ny: 1", "a: -inf\nb: -5"])
def test_key_value_argmax_with_inf_and_nan(spark, text):
    d = {}
    for line in text.splitlines():
        p = line.split(":")
        try:
            d[p[0].strip()] = float(p[1])
        except ValueError:
            pass
    df = spark.createDataFrame([(text,)], "t string").withColumn("l", TX.splitlines("t"))
    assert df.select(LB.key_value_argmax(LB.key_value_entries(F.col("l")))).first()[0] == max(d, key=d.get)


def test_unicode_word_boundary_and_digits(spark):
    df = spark.createDataFrame([("éno", "stable٣"), ("no é", "stable: 45")], "a string, b string")
    assert [r[0] for r in df.select(LB.first_label("a", "null")).collect()] == [None, "no"]
    at = LABELS.index("stable")
    assert [r[0][at] for r in df.select(C.confidences_a("b")).collect()] == [3.0, 45.0]


def test_sections_keep_text_with_private_use_characters(spark):
    body = "one two three 01 four"
    df = spark.createDataFrame([(1, f"pre x\nFINDINGS: {body}\nCONCLUSION: done")], "report_id long, report string")
    got = [(r["section"], r["body"]) for r in RP.sections(df).orderBy("seq").collect()]
    assert got == [("PREAMBLE", "pre x"), ("FINDINGS", body), ("CONCLUSION", "done")]


def test_keyword_and_phrase_labels_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, "FINDINGS: x")], "report_id long, report string")
    for out in (RP.keyword_label(df), RP.phrase_label(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("sizes", [[1] * 500, [101] * 6, [7, 1, 1, 30, 2]])
def test_folds_are_balanced_per_class_and_in_total(spark, sizes):
    rows = [(i * 1000 + j, None if i == 2 else f"c{i:03d}") for i, n in enumerate(sizes) for j in range(n)]
    got = X.stratified_kfold(spark.createDataFrame(rows, "id long, label string"), "id", "label", k=5).toPandas()
    assert len(got) == len(rows)
    total = got.groupby("fold").size().reindex(range(5), fill_value=0)
    assert total.max() - total.min() <= 1
    for _, x in got.groupby("label", dropna=False):
        n = x.groupby("fold").size().reindex(range(5), fill_value=0)
        assert n.max() - n.min() <= 1


def test_label_share_like_pandas(spark):
    rows = [("a", "x"), ("a", None), ("b", "y"), ("b", "z"), (None, "w"), ("c", None)]
    df = spark.createDataFrame(rows, "label string, report string")
    pdf = pd.DataFrame(rows, columns=["label", "report"])
    n = pdf.groupby("label").count()["report"]
    assert {r["label"]: r["n_report"] for r in M.label_counts(df, "label").collect()} == n.to_dict()
    share = round(n / n.sum() * 100, 2)
    assert {r["label"]: r["ratio_pct"] for r in M.label_share(df, "label", "report").collect()} == share.to_dict()
    full = df.filter("label <> 'c'")
    r = M.label_imbalance(full, "label", "report").first()
    assert (r["max_pct"], r["min_pct"], r["n_classes"]) == (66.67, 33.33, 2)
    assert r["spread"] == pytest.approx(33.34) and r["factor"] == pytest.approx(66.67 / 33.33)


def test_wide_export_keeps_every_report(spark):
    rows = [(1, "p", "no", 0.9, "no", "no"), (2, "p", "no", 0.1, "no", "mets"), (3, "q", "no", None, "no", "no"), (4, None, "no", 0.5, "no", "no")]
    s = spark.createDataFrame(rows, "doc_id long, prompt_id string, label string, score double, predicted string, true_label string")
    au = A.one_vs_rest_auroc(s, ["prompt_id"], labels=["no"])
    got = {r["doc_id"]: r["auroc_no"] for r in A.wide_export(s, au, ["doc_id"], ["prompt_id"], labels=["no"]).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[2] == 1.0 and got[3] is None


def test_writing_a_run_twice_keeps_one_copy(spark):
    path = IO.scratch_path(spark, "t-twice")
    df = spark.createDataFrame([(1, "p"), (2, "q")], "doc_id long, prompt_id string")
    for run in ("r1", "r2", "r1"):
        IO.write_results(df, path, run)
    assert {tuple(r) for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {("r1", 2), ("r2", 2)}


def test_catalogues_of_one_name_stay_apart(spark):
    root = IO.scratch_path(spark, "t-cats")
    for folder, text in (("a", "A {report}"), ("b", "B {report}")):
        IO.write_prompt_catalogue(spark, [("p", "", text)], f"{root}/{folder}/prompts.yaml")
    got = IO.read_prompt_catalogues(spark, f"{root}/*/prompts.yaml").collect()
    assert sorted(r["template"] for r in got) == ["A {report}", "B {report}"] and {r["ord"] for r in got} == {0}


def test_predictions_routed_by_group(spark):
    cat = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, prompt_id string")
    before = spark.createDataFrame([(1, "a", "x"), (1, "b", "stale")], "doc_id long, prompt_id string, predicted string")
    after = spark.createDataFrame([(1, "b", "y"), (1, "a", "stale")], "doc_id long, prompt_id string, predicted string")
    got = PR.route_predictions(PR.route_groups(cat, 1), {"before": before, "after": after})
    assert sorted(tuple(r) for r in got.select("prompt_id", "predicted", "grp").collect()) == [("a", "x", "before"), ("b", "y", "after")]


def test_split_moves_no_text_and_keeps_quotas(spark):
    from labelforge.sources.files import materialize

    rows = [(i, None if i % 7 == 0 else f"c{i % 3}", "long text " * 20) for i in range(3000)]
    df = materialize(spark.createDataFrame(rows, "id long, label string, report string"), "t-split")
    out = X.stratified_split(df, "id", "label")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "report" in plan and out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1
    n = {r["split"]: r["n"] for r in X.split_sizes(out).collect()}
    assert n == {"train": 2100, "eval": 450, "test": 450}
    per = out.groupBy("label", "split").count().toPandas()
    for _, x in per.groupby("label", dropna=False):
        test, total = x[x.split == "test"]["count"].sum(), x["count"].sum()
        assert abs(test - 0.15 * total) <= 1


def test_before_after_counts_one_sided_reports(spark):
    from labelforge.operators import errors as ER

    b = spark.createDataFrame([(1, "no", "no"), (2, "no", "mets"), (3, "no", "no")], "report_id long, correct string, predicted string")
    a = spark.createDataFrame([(2, "no", "no"), (3, "no", "mets"), (4, "no", "no")], "report_id long, correct string, predicted string")
    r = ER.before_after(b, a).first()
    assert (r["n"], r["n_only_before"], r["n_only_after"], r["n_fixed"], r["n_broken"], r["accuracy_delta"]) == (2, 1, 1, 1, 1, 0.0)


def test_metrics_on_rows_and_duplicate_keys(spark):
    from labelforge.operators import errors as ER

    df = spark.createDataFrame([("p", "no", "no"), ("p", "no", "mets"), (None, "no", "no")], "prompt_id string, correct string, predicted string")
    got = M.metrics_on_rows(df, ["prompt_id"]).collect()
    assert sorted((r["prompt_id"] or "", r["accuracy"]) for r in got) == [("", 1.0), ("p", 0.5), ("p", 0.5)]
    assert tuple(ER.duplicate_keys(df, "correct").first()) == (1, 2)


def test_confidence_summary_on_the_row(spark):
    from labelforge.operators import errors as ER

    row = [0.0] * len(LABELS)
    a, b = row.copy(), row.copy()
    a[LABELS.index("mets")], b[0], b[1] = 0.9, 0.5, 0.5
    df = spark.createDataFrame([("p", "mets", "mets", a), ("p", LABELS[1], "stable", b), ("p", "junk", "no", row)],
                               "prompt_id string, predicted string, true_label string, scores array<double>")
    out = ER.confidence_summary(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r["is_correct"]: (r["n"], r["avg_pred_score"], r["n_argmax_is_pred"]) for r in out.collect()}
    assert got == {True: (1, 0.9, 1), False: (2, 0.5, 0)}
