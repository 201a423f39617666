"""Label-shaped inputs derived from the test tables by Spark.

The test tables carry no six-label ground truth, so truth, predictions,
scores and model responses are derived from ``documents`` with seeded md5
hashes. Every derivation is a column expression over the documents, so the
work grows with the table, and DuckDB evaluates the same expressions for the
oracle (``labelforge.plans.oracle``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions.hashing import h32
from labelforge.functions.text import render
from labelforge.operators.prompts import expand
from labelforge.schema import LABELS, PROMPT_SCHEMA, RAW_NO_VARIANTS
from labelforge.sources.tables import table

# Invented prompt catalogue used by the fixtures (ord, id, description, template).
PROMPTS = [
    (0, "base", "plain instruction",
     "Classify the report into one of six labels.\n### Report ###\n{report}\n### output ###"),
    (1, "role_cot", "role, step by step",
     "You are a radiologist. Let's think step by step.\n{report}\nAnswer with one label."),
    (2, "rule_out", "rule-out note, report twice",
     "R/O should be read as romets.\n{report}\n---\n{report}"),
    (3, "stated", "confidence for the stated label",
     "The label {y_i} was given to this report:\n{report}\nGive a confidence for each label."),
    (4, "empty", "empty template", ""),
]
GROUP_SPLIT = 2  # prompts with ord < 2 form the 'before' group

# Invented report keywords appended to the CONCLUSION section (one per report).
CONCLUSION_PHRASES = [
    "no evidence of metastasis", "metastatic lesions", "progressive disease", "stable disease",
    "improved", "r/o metastasis", "follow up", "no interval change", "decreased in enhancement",
    "possibility of spread",
]


def lab_at(idx: Column, labels: list[str] | None = None) -> Column:
    labels = labels or LABELS
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (idx + 1).cast("int"))


def prompts_df(spark: SparkSession) -> DataFrame:
    rows = [("fixture", o, i, d, t) for o, i, d, t in PROMPTS]
    names = [f.name for f in PROMPT_SCHEMA.fields]
    # from an Arrow table, as Spark then knows its size when it plans joins
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r)) for r in rows]), PROMPT_SCHEMA)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + ``true_label`` and its raw spelling ``raw_label``."""
    d = table(spark, sf_dir, "documents")
    t = lab_at(h32(F.col("doc_id"), "t") % 6)
    raw = F.when(t == "no", F.element_at(F.array(*[F.lit(x) for x in RAW_NO_VARIANTS]),
                                         (h32(F.col("doc_id"), "v") % 3 + 1).cast("int"))).otherwise(t)
    return d.select("doc_id", "text", "lang", "source", "n_chars", t.alias("true_label"), raw.alias("raw_label"))


def predicted_expr(doc_id: Column, prompt_id: Column, true_label: Column) -> Column:
    j = h32(doc_id, F.concat(prompt_id, F.lit("j")))
    junk = F.when(j % 100 == 0, F.lit("unclear")).otherwise(F.lit("n/a"))
    other = lab_at(h32(doc_id, F.concat(prompt_id, F.lit("e"))) % 6)
    return (F.when(j % 50 == 0, junk)
            .when(h32(doc_id, prompt_id) % 10 < 8, true_label)
            .otherwise(other))


def predictions(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """documents x prompt catalogue (J2; the catalogue is a fixed-size dimension,
    so it is the broadcast side) -> ``(doc_id, prompt_id, ord, correct, predicted)``."""
    g = gold(spark, sf_dir)
    p = prompts_df(spark).select("prompt_id", "ord")
    cols = ["doc_id", "prompt_id", "ord", F.col("true_label").alias("correct"),
            predicted_expr(F.col("doc_id"), F.col("prompt_id"), F.col("true_label")).alias("predicted")]
    if with_text:
        cols += ["text", "lang", "source", "n_chars"]
    return expand(g, p).select(*cols)


def score_expr(doc_id: Column, prompt_id: Column, label: Column, predicted: Column) -> Column:
    base = (h32(doc_id, F.concat(prompt_id, label)) % 1000).cast("double") / 1000.0
    return base + F.when(label == predicted, F.lit(0.3)).otherwise(F.lit(0.0))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form scores ``(doc_id, prompt_id, label, score, predicted, true_label)``."""
    p = predictions(spark, sf_dir)
    x = p.withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS])))
    return x.select("doc_id", "prompt_id", "label",
                    score_expr(F.col("doc_id"), F.col("prompt_id"), F.col("label"), F.col("predicted")).alias("score"),
                    "predicted", F.col("correct").alias("true_label"))


def score_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of :func:`scores` as one array per row, in label order."""
    p = predictions(spark, sf_dir)
    cols = [score_expr(F.col("doc_id"), F.col("prompt_id"), F.lit(lab), F.col("predicted")) for lab in LABELS]
    return p.select("doc_id", "prompt_id", "predicted", F.col("correct").alias("true_label"), F.array(*cols).alias("scores"))


def response_expr(doc_id: Column, prompt_id: Column, predicted: Column) -> Column:
    r = h32(doc_id, F.concat(prompt_id, F.lit("r"))) % 6
    kv = F.concat_ws("\n", *[
        F.concat(F.lit(lab + ": "), (h32(doc_id, F.concat(prompt_id, F.lit(lab))) % 1000).cast("string"))
        for lab in LABELS
    ])
    return (
        F.when(r == 0, F.concat(F.lit("final label: "), predicted))
        .when(r == 1, F.concat(F.lit("Reasoning done.\n### output ###\n"), predicted, F.lit("\nbecause of the findings")))
        .when(r == 2, kv)
        .when(r == 3, F.concat(predicted, F.lit(", 99.0%")))
        .when(r == 4, F.lit("unable to decide"))
        .otherwise(F.lit(""))
    )


def responses(spark: SparkSession, sf_dir: str, decoded: bool = False) -> DataFrame:
    """``(doc_id, prompt_id, correct, predicted, response)``; with ``decoded``
    also the rendered prompt and the decoded output (prompt echo + marker + response)."""
    p = predictions(spark, sf_dir, with_text=decoded)
    out = p.withColumn("response", response_expr(F.col("doc_id"), F.col("prompt_id"), F.col("predicted")))
    if decoded:
        tpl = prompts_df(spark).select("prompt_id", "template")
        out = out.join(F.broadcast(tpl), "prompt_id")
        out = out.withColumn("prompt", render(F.col("template"), F.col("text"), F.col("predicted")))
        out = out.withColumn("decoded", F.concat(F.col("prompt"), F.lit("\n### response ###\n"), F.col("response")))
    return out


def report_expr(source: Column, text: Column, doc_id: Column) -> Column:
    """Report with headed sections: EXAM, FINDINGS (first half of the text) and
    CONCLUSION (second half plus one phrase)."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    phrase = F.element_at(F.array(*[F.lit(x) for x in CONCLUSION_PHRASES]),
                          (h32(doc_id, "k") % len(CONCLUSION_PHRASES) + 1).cast("int"))
    return F.concat(
        F.lit("EXAM: "), source,
        F.lit("\nFINDINGS: "), text.substr(F.lit(1), half),
        F.lit("\nCONCLUSION: "), text.substr(half + 1, n),
        F.lit(" "), phrase, F.lit("."),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir)
    return g.select("doc_id", "true_label", report_expr(F.col("source"), F.col("text"), F.col("doc_id")).alias("report"))

