"""Unit tests for the text, label and confidence scalars.

"""

import pytest
from pyspark.sql import functions as F

from labelforge.functions import confidence as C
from labelforge.functions import labels as LB
from labelforge.functions import text as TX
from labelforge.schema import LABELS


def one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,compat", [("no", "no"), ("No", "no"), ("no ", "no"), ("mets", "mets"),
                                         ("no change", "nochange"), ("|o x", "nox")])
def test_normalise_compat_quirks(spark, raw, compat):
    assert one(spark, LB.normalise_label(F.col("t"), "compat"), raw) == compat


def test_normalise_strict(spark):
    assert one(spark, LB.normalise_label(F.col("t"), "strict"), " No ") == "no"
    assert one(spark, LB.normalise_label(F.col("t"), "strict"), "maybe") is None


@pytest.mark.parametrize("text,lines", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]),
                                         ("a\n\nb\n", ["a", "", "b"]), ("a\x0bb", ["a", "b"])])
def test_splitlines_matches_python(spark, text, lines):
    assert one(spark, TX.splitlines(F.col("t")), text) == lines == text.splitlines()


def test_py_strip_unicode_whitespace(spark):
    assert one(spark, TX.py_strip(F.col("t")), "  x y\n\t") == "x y"


def test_render_order_and_braces(spark):
    df = spark.createDataFrame([("{y_i}: {report} / {report}", "a {y_i} b", "mets")], "tpl string, r string, y string")
    got = df.select(TX.render(F.col("tpl"), F.col("r"), F.col("y")).alias("x")).first()["x"]
    assert got == "mets: a {y_i} b / a {y_i} b"


def test_strip_echo_and_markers(spark):
    df = spark.createDataFrame([("PROMPT", "PROMPT\n### response ###\n x \n### response ###\n y ")], "p string, g string")
    r = df.select(TX.strip_echo("g", "p").alias("s"), TX.py_strip(TX.after_last("g", "### response ###")).alias("l"),
                  TX.py_strip(TX.after_first("g", "### response ###")).alias("f")).first()
    assert r["s"] == "### response ###\n x \n### response ###\n y"
    assert r["l"] == "y"
    assert r["f"] == "x \n### response ###\n y"


def test_first_label(spark):
    assert one(spark, LB.first_label(F.col("t")), "it is romets, not mets") == "romets"
    assert one(spark, LB.first_label(F.col("t")), "Mets maybe") == "Mets maybe"  # case-sensitive, raw fallback
    assert one(spark, LB.first_label(F.col("t"), "null"), "nothing") is None
    assert one(spark, LB.first_label(F.col("t")), "nomets stable") == "stable"  # whole words only


@pytest.mark.parametrize("text,label", [
    ("final label: mets\nfinal label: stable", "stable"),      # last final-label line wins
    ("final label:", ""),                                      # empty value still wins
    ("final label: whatever", "whatever"),                     # any value
    (" final label: mets\n### output ###\nStable now", "stable"),  # leading space: not stage 1
    ("x\n### output ###\n\nline1\nIMPROVED", "improved"),      # first two lines after marker
    ("### output ###\na\nb\nmets", None),                      # label on third line: no stage 2
    ("a: 0.2\nb: 0.7\nc: 0.7", "b"),                           # argmax, first of ties
    ("a: 0.9\nb: 0.5\na: 0.1", "b"),                           # duplicate key takes last value
    ("a: 1:2\nb: 1e-3", "b"),                                  # two colons are ignored
    ("- no: 0.9", "no"),                                       # stage 2 finds 'no' first
    ("", None),
])
def test_multi_stage_label(spark, text, label):
    assert one(spark, LB.multi_stage_label(F.col("t")), text) == label


def scores_a(spark, text):
    return dict(zip(LABELS, one(spark, C.confidences_a(F.col("t")), text)))


def scores_b(spark, text, fallback="one_hot"):
    return dict(zip(LABELS, one(spark, C.confidences_b(F.col("t"), fallback=fallback), text)))


def nz(d):
    return {k: v for k, v in d.items() if v != 0.0}


def test_confidence_shapes_from_fixtures(spark):
    assert nz(scores_a(spark, "mets: 95\nstable: 4\nimproved: 1")) == {"mets": 95.0, "stable": 4.0, "improved": 1.0}
    assert nz(scores_b(spark, "mets: 95\nstable: 4\nimproved: 1")) == {"mets": 0.95, "stable": 0.04, "improved": 0.01}
    assert nz(scores_a(spark, "mets, 99.0%\nno, 0.0%")) == {"mets": 99.0}
    assert nz(scores_b(spark, "mets, 99.0%\nno, 0.0%")) == {"no": 1.0}
    assert nz(scores_a(spark, "no metastasis: 99.9%\nimproved: 0.0%")) == {}
    assert nz(scores_b(spark, "no metastasis: 99.9%\nimproved: 0.0%")) == {"no": 1.0}
    assert nz(scores_a(spark, "100% mets\n90% progression\n80% stable")) == {"mets": 90.0, "progression": 80.0}
    assert nz(scores_b(spark, "100% mets\n90% progression\n80% stable")) == {"mets": 0.9, "progression": 0.8}
    assert nz(scores_a(spark, "mets: 95. then mets")) == {"mets": 95.0}
    assert nz(scores_b(spark, "mets: 95. then mets")) == {"mets": 1.0}
    assert nz(scores_a(spark, "")) == {} and nz(scores_b(spark, "")) == {}


def test_uniform_fallback(spark):
    assert set(scores_b(spark, "stable, maybe", "uniform").values()) == {1.0}


def test_normalise_sums(spark):
    vals = one(spark, C.normalise(C.confidences_a(F.col("t"))), "mets: 3\nno: 1")
    assert abs(sum(vals) - 1.0) < 1e-12 and vals[1] == 0.75
    assert one(spark, C.normalise(C.confidences_a(F.col("t"))), "nothing") == [0.0] * 6


def test_compliance(spark):
    df = spark.createDataFrame([("no: 0.1\nmets: 0.5\nprogression: 0.1\nstable: 0.1\nimproved: 0.1\nromets: 0.1", "mets")],
                               "t string, s string")
    r = df.select(C.compliance("t", "s").alias("c")).first()["c"]
    assert r["all_labels"] and r["sums_to_one"] and r["stated_is_max"] and r["lower_case"]


TRICKY = [
    "final label: mets\nfinal label: stable", "final label:", " final label: mets\n### output ###\nStable now",
    "x\n### output ###\n\nline1\nIMPROVED", "### output ###\na\nb\nmets", "a: 0.2\nb: 0.7\nc: 0.7",
    "a: 0.9\nb: 0.5\na: 0.1", "a: 1:2\nb: 1e-3", "- no: 0.9", "", "\n\n", "k: 1_0\r\nj: 2\r\n",
    "### output ###", "x: 1\x0bfinal label: romets", "no mets", "report: a\nexam: b\nvalue: .5\n",
]


@pytest.mark.parametrize("text", TRICKY)
def test_dataframe_parser_equals_row_scalar(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    a = LB.with_multi_stage_label(df, "t", "p").first()["p"]
    b = one(spark, LB.multi_stage_label(F.col("t")), text)
    assert a == b


@pytest.mark.parametrize("text,label", [("énoé mets", "mets"), ("Ça no", "no"), ("stable。", "stable"), ("nó no", "no")])
def test_word_boundaries_follow_python_unicode_rules(spark, text, label):
    # Python's \b treats accented letters as word characters
    import re

    m = re.search(r"\b(?:no|mets|progression|stable|improved|romets)\b", text)
    assert m.group(0) == label
    assert one(spark, LB.first_label(F.col("t"), "null"), text) == label


def test_order_invariance_of_metrics(spark):
    from labelforge.operators import metrics as M

    rows = [("no", "no"), ("mets", "no"), ("stable", None), ("mets", "mets"), ("no", "junk")] * 7
    a = M.macro_metrics(spark.createDataFrame(rows, "correct string, predicted string")).first()
    b = M.macro_metrics(spark.createDataFrame(rows[::-1], "correct string, predicted string").repartition(5)).first()
    assert a == b
