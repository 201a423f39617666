"""Error analysis (F1-F6, J1, J5, E15-E17) over a predictions table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.operators.rank import numbered
from labelforge.schema import LABELS


def is_error(correct: str = "correct", predicted: str = "predicted") -> Column:
    """a NULL prediction counts as wrong."""
    return ~F.col(correct).eqNullSafe(F.col(predicted))


def errors(df: DataFrame, correct: str = "correct", predicted: str = "predicted") -> DataFrame:
    return df.filter(is_error(correct, predicted))


def correct_rows(df: DataFrame, correct: str = "correct", predicted: str = "predicted") -> DataFrame:
    """F2."""
    return df.filter(~is_error(correct, predicted))


def error_slice(df: DataFrame, true_label: str | None = None, predicted_label: str | None = None,
                predicted_not: str | None = None) -> DataFrame:
    """rows with a given true label and/or a given (or excluded) prediction."""
    cond = F.lit(True)
    if true_label is not None:
        cond = cond & (F.col("correct") == true_label)
    if predicted_label is not None:
        cond = cond & (F.col("predicted") == predicted_label)
    if predicted_not is not None:
        cond = cond & ~F.col("predicted").eqNullSafe(F.lit(predicted_not))
    return df.filter(cond)


def has_paragraphs(text: str = "text") -> Column:
    """``len(re.split(r'\\n\\s*\\n+', t)) > 1``, i.e. a blank line exists."""
    return F.col(text).rlike(r"(?U)\n\s*\n")


def paragraph_rate(df: DataFrame, text: str = "text", keys: Sequence[str] = ("correct", "predicted")) -> DataFrame:
    """share of texts with paragraph breaks per outcome group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has_paragraphs(text)).alias("n_paragraphs"),
    ).withColumn("rate", F.col("n_paragraphs") / F.col("n"))


def error_pairs_topk(df: DataFrame, k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent (true -> predicted) error pairs. Top-k is the feature;
    ties are broken by the pair so the cut is deterministic."""
    pairs = errors(df).groupBy(*keys, "correct", "predicted").agg(F.count(F.lit(1)).alias("n"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("correct").asc_nulls_last(),
                                              F.col("predicted").asc_nulls_last())
        return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return pairs.orderBy(F.col("n").desc(), F.col("correct").asc_nulls_last(), F.col("predicted").asc_nulls_last()).limit(k)


def align(predictions: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Key join instead of the reference's positional concat; full outer so
    rows that exist on one side only are visible instead of silently NaN."""
    p = predictions.withColumn("__in_pred", F.lit(True))
    r = rows.withColumn("__in_rows", F.lit(True))
    return p.join(r, key, "full_outer")


def align_audit(aligned: DataFrame) -> DataFrame:
    return aligned.agg(
        F.count_if(F.col("__in_pred") & F.col("__in_rows")).alias("n_matched"),
        F.count_if(F.col("__in_pred") & F.col("__in_rows").isNull()).alias("n_only_predictions"),
        F.count_if(F.col("__in_pred").isNull() & F.col("__in_rows")).alias("n_only_rows"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """How many keys stand more than once, and how many rows they add; such
    rows would match several times in :func:`align`."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return n.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_extra_rows"))


def align_by_occurrence(predictions: DataFrame, rows: DataFrame, key: str, order_predictions: Sequence[Column],
                        order_rows: Sequence[Column]) -> DataFrame:
    """J1 where keys repeat: the n-th prediction of a key (in its order) meets the
    n-th row of that key, and what one side has more of stays, alone. Each side
    is numbered within its keys over range partitions, so a key of any size is
    split, and the join has one row a side for each (key, ``occurrence``). NULL
    keys meet nothing."""
    p = numbered(predictions, [key], order_predictions, "occurrence", "align").withColumn("__in_pred", F.lit(True))
    r = numbered(rows, [key], order_rows, "occurrence", "align").withColumn("__in_rows", F.lit(True))
    return p.join(r, [key, "occurrence"], "full_outer")


def occurrence_audit(aligned: DataFrame, key: str) -> DataFrame:
    """Matched rows, rows beyond the other side's count of their key
    (``n_surplus_*``), and rows whose key stands on one side only."""
    has = lambda c: F.col(c).isNotNull()
    per = aligned.groupBy(key).agg(
        F.count_if(has("__in_pred") & has("__in_rows")).alias("m"), F.count_if(~has("__in_rows")).alias("p"),
        F.count_if(~has("__in_pred")).alias("r"))
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return per.agg(total("m", F.lit(True)).alias("n_matched"),
                   total("p", F.col("m") > 0).alias("n_surplus_predictions"), total("r", F.col("m") > 0).alias("n_surplus_rows"),
                   total("p", F.col("m") == 0).alias("n_only_predictions"), total("r", F.col("m") == 0).alias("n_only_rows"))


def before_after(before: DataFrame, after: DataFrame, key: str = "report_id") -> DataFrame:
    """The same reports under two prompt versions -> fixed / broken /
    still wrong / still right counts and the accuracy change over the reports on
    both sides, and how many stand on one side only."""
    b = before.select(key, (~is_error()).alias("ok_before"))
    a = after.select(key, (~is_error()).alias("ok_after"))
    j = b.join(a, key, "full_outer")
    both = F.col("ok_before").isNotNull() & F.col("ok_after").isNotNull()
    return j.agg(
        F.count_if(both).alias("n"),
        F.count_if(F.col("ok_after").isNull()).alias("n_only_before"),
        F.count_if(F.col("ok_before").isNull()).alias("n_only_after"),
        F.count_if(~F.col("ok_before") & F.col("ok_after")).alias("n_fixed"),
        F.count_if(F.col("ok_before") & ~F.col("ok_after")).alias("n_broken"),
        F.count_if(~F.col("ok_before") & ~F.col("ok_after")).alias("n_still_wrong"),
        F.count_if(F.col("ok_before") & F.col("ok_after")).alias("n_still_right"),
        ((F.count_if(both & F.col("ok_after")) - F.count_if(both & F.col("ok_before"))) / F.count_if(both)).alias("accuracy_delta"),
    )


def confidence_summary(df: DataFrame, keys: Sequence[str] = ("prompt_id",), scores: str = "scores",
                       predicted: str = "predicted", truth: str = "true_label",
                       labels: Sequence[str] | None = None) -> DataFrame:
    """Per prompt and outcome (prediction right or wrong): mean score of the
    predicted label and how often the score argmax (first label on ties) equals
    the stated label. ``scores`` is an array in label order on the report's row,
    so nothing is regrouped before the one aggregate."""
    labels = list(labels or LABELS)
    names = F.array(*[F.lit(x) for x in labels])
    own = F.get(F.col(scores), F.array_position(names, F.col(predicted)).cast("int") - 1)
    top = F.get(names, F.array_position(F.col(scores), F.array_max(scores)).cast("int") - 1)
    x = df.select(*keys, F.col(predicted).eqNullSafe(F.col(truth)).alias("is_correct"),
                  own.alias("__own"), top.eqNullSafe(F.col(predicted)).alias("__top"))
    return x.groupBy(*keys, "is_correct").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__own").alias("avg_pred_score"),
        F.count_if("__top").alias("n_argmax_is_pred"),
    )


def prompt_ranking(metrics: DataFrame, k: int = 3, by: str = "f1_score") -> DataFrame:
    """Best prompts by a metric (top-k is the feature; ties by prompt id)."""
    w = Window.orderBy(F.col(by).desc(), F.col("prompt_id"))
    return metrics.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# Technique flags read off a prompt's id, description and text (our rules).
TECHNIQUES = {
    "role": r"(?i)you are a",
    "step_by_step": r"(?i)step by step",
    "rule_out": r"(?i)r/o|rule[- ]out",
    "report_twice": r"\{report\}[\s\S]*\{report\}",
    "stated_label": r"\{y_i\}",
}


def prompt_features(prompts: DataFrame) -> DataFrame:
    """``(prompt_id, feature, present)`` for every technique flag."""
    text = F.concat_ws("\n", F.col("prompt_id"), F.coalesce(F.col("description"), F.lit("")),
                       F.coalesce(F.col("template"), F.lit("")))
    feats = F.array(*[F.struct(F.lit(n).alias("feature"), text.rlike(p).alias("present")) for n, p in TECHNIQUES.items()])
    return prompts.select("prompt_id", F.explode(feats).alias("f")).select("prompt_id", "f.feature", "f.present")


def technique_effect(metrics: DataFrame, features: DataFrame, metric: str = "f1_score") -> DataFrame:
    """Mean metric of prompts with and without each technique."""
    j = metrics.join(F.broadcast(features), "prompt_id")
    return j.groupBy("feature", "present").agg(
        F.avg(metric).alias(f"avg_{metric}"), F.count(F.lit(1)).alias("n_prompts"))


def technique_effects(rows: DataFrame, features: DataFrame, value: str, key: str = "prompt_id",
                      techniques: Sequence[str] | None = None, ridge: float = 1e-3) -> DataFrame:
    """What each technique adds to the mean of ``value``, the others held
    fixed: least squares of ``value`` (a number of each row, such as right = 1)
    on an intercept and the techniques of the row's prompt.

    Rows are summed to (n, sum) per prompt, prompts to the cross products of
    the normal equations: one row of p^2 numbers for p techniques, however
    many prompts and rows there are; only that row reaches the driver. Techniques that
    always come together can't be told apart: the ridge (a share of the rows
    added to the diagonal, not for the intercept) shares their effect out
    evenly, and ``separable`` is false for them."""
    names = list(techniques or TECHNIQUES)
    per = rows.groupBy(key).agg(F.count(value).cast("double").alias("__n"), F.sum(value).cast("double").alias("__s"))
    flags = features.groupBy(key).pivot("feature", names).agg(F.max(F.col("present").cast("double")))
    x = [F.lit(1.0), *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names]]
    p = len(x)
    sums = [F.sum(F.col("__n") * x[i] * x[j]) for i in range(p) for j in range(i, p)]
    got = per.join(flags, key).agg(F.array(*sums).alias("xx"), F.array(*[F.sum(F.col("__s") * c) for c in x]).alias("xy"),
                                   F.array(*[F.sum(c) for c in x]).alias("prompts")).first()
    a = np.zeros((p, p))
    a[np.triu_indices(p)] = [v or 0.0 for v in got["xx"]]
    a = a + np.triu(a, 1).T
    y = np.array([v or 0.0 for v in got["xy"]])
    n = a[0, 0]
    effect = np.linalg.solve(a + np.diag([0.0] + [ridge * n] * (p - 1)), y) if n else np.zeros(p)
    # a technique is separable if no other mix of columns makes its column
    separable = [np.linalg.matrix_rank(np.delete(np.delete(a, i, 0), i, 1)) < np.linalg.matrix_rank(a) for i in range(p)]
    out = [("(all)" if i == 0 else names[i - 1], float(effect[i]) if n else None, int(got["prompts"][i] or 0), int(a[i, i]), bool(separable[i]))
           for i in range(p)]
    return rows.sparkSession.createDataFrame(out, "feature string, effect double, n_prompts long, n_rows long, separable boolean")
