"""Report-text operators, sources/sinks, inference and streaming on small inputs."""

import pandas as pd
from pyspark.sql import functions as F

from labelforge.operators import inference as INF
from labelforge.operators import reports as RP
from labelforge.sources import files as IO
from labelforge.streaming import monitor as ST

REPORT = ("Clinical information: back pain\n"
          "FINDINGS: Multiple metastatic lesions in L2. No interval change elsewhere.\n"
          "Conclusion: Stable disease. R/O new lesion; follow up MRI.\n")


def test_sections_split_and_canonical_names(spark):
    df = spark.createDataFrame([(1, "intro line\n" + REPORT)], "report_id long, report string")
    rows = [(r["seq"], r["section"], r["body"]) for r in RP.sections(df).orderBy("seq").collect()]
    assert rows == [(0, "PREAMBLE", "intro line"), (1, "CLINICAL INFORMATION", "back pain"),
                    (2, "FINDINGS", "Multiple metastatic lesions in L2. No interval change elsewhere."),
                    (3, "CONCLUSION", "Stable disease. R/O new lesion; follow up MRI.")]


def test_keyword_label_prefers_conclusion(spark):
    df = spark.createDataFrame([(1, REPORT)], "report_id long, report string")
    r = RP.keyword_label(df).first()
    # conclusion: 'stable disease' (stable 1/3), 'follow up' + 'r/o' (romets 2/4 = 0.5) -> romets
    assert r["keyword_label"] == "romets" and r["primary_rate"] == 0.5


def test_rules_signals_phrases(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "No evidence of metastasis."), (3, "nothing here")],
                               "report_id long, report string")
    rules = {r["report_id"]: r["l"] for r in df.select("report_id", RP.rule_label("report").alias("l")).collect()}
    assert rules == {1: "stable", 2: "no", 3: "romets"}  # report 1: "Stable disease" (case-sensitive)
    sig = {r["report_id"]: r["signal_label"] for r in RP.signal_counts(df).collect()}
    assert sig[1] == "stable" and sig[3] is None
    ph = {r["report_id"]: (r["phrase_label"], r["share"]) for r in RP.phrase_label(df).collect()}
    # report 2: 'no evidence' -> no .5, stable .5; 'metastasis' -> mets 1 => mets wins with share .5
    assert ph[2] == ("mets", 0.5) and 3 not in ph


def test_rule_out_and_explanations(spark):
    df = spark.createDataFrame([("R/O mets",), ("rule-out",), ("prorogue",)], "body string")
    assert [r[0] for r in df.select(RP.rule_out_flag("body")).collect()] == [True, True, False]
    e = spark.createDataFrame([("The conclusion shows stable disease.",)], "text string")
    c = e.select(RP.explanation_checks("text").alias("c")).first()["c"]
    assert c["short"] and c["names_section"] and c["names_keyword"]


def test_csv_roundtrip_keeps_quotes_newlines_spaces(spark):
    rows = [(1, 'a "quoted",\nmulti-line text', "no "), (2, "", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    path = IO.scratch_path(spark, "t-csv")
    IO.write_csv(df, path)
    back = IO.read_csv(spark, path, "id long, text string, label string").orderBy("id").collect()
    # like a pandas to_csv/read_csv round trip, an empty string comes back as null
    assert [tuple(r) for r in back] == [rows[0], (2, None, None)]


def test_yaml_catalogue_duplicate_ids(spark):
    path = IO.scratch_path(spark, "t-yaml")
    IO.write_prompt_catalogue(spark, [("a", "first", "A {report}"), ("b", "", ""), ("a", "again", "A2 {report}")], path)
    got = [(r["ord"], r["prompt_id"], r["template"]) for r in IO.read_prompt_catalogues(spark, path).orderBy("ord").collect()]
    assert got == [(0, "a", "A2 {report}"), (1, "b", "")]


def test_results_partitioned_by_safe_prompt_key(spark):
    path = IO.scratch_path(spark, "t-res")
    df = spark.createDataFrame([(1, "id with space/slash", "no", "no")], "report_id long, prompt_id string, correct string, predicted string")
    IO.write_results(df, path, run="20240101_000000")
    back = spark.read.parquet(path).first()
    assert back["prompt_id"] == "id with space/slash" and "/" not in back["prompt_key"] and " " not in back["prompt_key"]


def test_surrogate_index_is_dense(spark):
    path = IO.scratch_path(spark, "t-idx")
    spark.range(0, 1000, 1, 7).withColumn("v", F.col("id") * 2).write.parquet(path)
    ids = sorted(r["row_id"] for r in IO.read_parquet_indexed(spark, path).collect())
    assert ids == list(range(1000))


def test_python_scorer_and_replay(spark):
    req = spark.createDataFrame([(1, "p", "abc"), (2, "p", "abcdefg"), (3, "q", "x")], "doc_id long, prompt_id string, prompt string")
    out = {r["doc_id"]: r["response"] for r in INF.batch_inference(req, INF.length_scorer, keys=["doc_id", "prompt_id"]).collect()}
    assert out == {1: "final label: stable", 2: "final label: mets", 3: "final label: mets"}
    stored = spark.createDataFrame([(1, "p", "r1")], "doc_id long, prompt_id string, response string")
    rep = {r["doc_id"]: r["response"] for r in INF.replay(req, stored, ["doc_id", "prompt_id"]).collect()}
    assert rep == {1: "r1", 2: None, 3: None}


def test_streaming_running_counts_across_batches(spark):
    src = IO.scratch_path(spark, "t-src")
    pdf = pd.DataFrame({"doc_id": range(6), "prompt_id": ["p"] * 6, "correct": ["no", "no", "mets", "mets", "stable", "stable"],
                        "response": ["final label: no", "final label: mets", "final label: mets",
                                     "final label: mets", "### output ###\nStable", "nothing"]})
    for i in range(3):  # three files -> three micro-batches with maxFilesPerTrigger=1
        spark.createDataFrame(pdf.iloc[2 * i:2 * i + 2]).coalesce(1).write.mode("append").parquet(src)
    sink = IO.scratch_path(spark, "t-sink")
    newest = ST.run_confusion(spark, src, sink, IO.scratch_path(spark, "t-ckpt"), max_files_per_trigger=1)
    got = {(r["correct"], r["predicted"]): r["n"] for r in spark.read.parquet(newest).collect()}
    assert got == {("no", "no"): 1, ("no", "mets"): 1, ("mets", "mets"): 2, ("stable", "stable"): 1, ("stable", None): 1}


def test_scorer_keeps_all_columns_without_keys_and_materialises(spark):
    req = spark.createDataFrame([(1, "abc", "x")], "doc_id long, prompt string, extra string")
    r = INF.batch_inference(req, INF.length_scorer).first()
    assert (r["doc_id"], r["prompt"], r["extra"], r["response"]) == (1, "abc", "x", "final label: stable")
    m = INF.batch_inference(req, INF.length_scorer, keys=["doc_id"], materialize=True)
    assert m.columns == ["doc_id", "response"] and m.first()["response"] == "final label: stable"
    assert "parquet" in m._jdf.queryExecution().executedPlan().toString().lower()  # read back from the shared folder
