"""Classification metrics and label statistics.

All metrics start from one partial aggregate, the confusion counts
``(keys..., correct, predicted) -> n``; everything after it works on that
table. It has ``groups x classes^2`` rows however many reports there are, where
predictions are parsed labels; raw answers kept as classes can make it as long
as the input, and it stays a distributed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.operators.rank import null_safe_join, numbered
from labelforge.schema import LABELS


def confusion_counts(df: DataFrame, keys: Sequence[str] = (), correct: str = "correct",
                     predicted: str = "predicted") -> DataFrame:
    """E5 (long form): ``(keys..., correct, predicted, n)``."""
    return df.groupBy(*keys, F.col(correct).alias("correct"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, keys: Sequence[str] = (), labels: Sequence[str] | None = None,
                     correct: str = "correct", predicted: str = "predicted") -> DataFrame:
    """E5 (wide): one row per true label, one count column per predicted label."""
    labels = list(labels or LABELS)
    cm = confusion_counts(df, keys, correct, predicted)
    return (
        cm.groupBy(*keys, "correct")
        .pivot("predicted", labels)
        .agg(F.sum("n"))
        .fillna(0, subset=labels)
    )


def per_class_counts(df: DataFrame, keys: Sequence[str] = (), correct: str = "correct",
                     predicted: str = "predicted", counts: str | None = None) -> DataFrame:
    """``(keys..., cls, tp, n_true, n_pred)`` over the union of true and
    predicted values; NULL is a class of its own (null-safe grouping).
    With ``counts`` the input already is a confusion-count table."""
    if counts is None:
        cm = confusion_counts(df, keys, correct, predicted)
    else:
        cm = df.select(*keys, F.col(correct).alias("correct"), F.col(predicted).alias("predicted"),
                       F.col(counts).cast("long").alias("n"))
    both = cm.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("correct").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                         F.when(F.col("correct").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0).cast("long").alias("tp")),
                F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                         F.lit(0).cast("long").alias("tp")),
            )
        ).alias("e"),
    )
    return both.groupBy(*keys, F.col("e.cls").alias("cls")).agg(
        F.sum("e.tp").alias("tp"), F.sum("e.t").alias("n_true"), F.sum("e.p").alias("n_pred")
    )


def _zd(num: Column, den: Column, zero_division: float) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(float(zero_division)))


def per_class_metrics(df: DataFrame, keys: Sequence[str] = (), zero_division: float = 0.0,
                      correct: str = "correct", predicted: str = "predicted", counts: str | None = None) -> DataFrame:
    pc = per_class_counts(df, keys, correct, predicted, counts)
    return pc.select(
        *keys, "cls", "tp", "n_true", "n_pred",
        _zd(F.col("tp"), F.col("n_pred"), zero_division).alias("precision"),
        _zd(F.col("tp"), F.col("n_true"), zero_division).alias("recall"),
        _zd(2 * F.col("tp"), F.col("n_true") + F.col("n_pred"), zero_division).alias("f1_score"),
    )


def macro_metrics(df: DataFrame, keys: Sequence[str] = (), zero_division: float = 0.0,
                  unparsed: str = "keep", labels: Sequence[str] | None = None,
                  correct: str = "correct", predicted: str = "predicted", counts: str | None = None) -> DataFrame:
    """E1/E2/F8. Accuracy and macro precision/recall/F1 over the union of true and
    predicted classes (each distinct unparsed string is a class with P=R=F1=0).
    ``zero_division`` is the value of an undefined precision/recall (0 or 1).
    ``unparsed='drop'`` first removes rows whose prediction is not a known label.
    ``counts`` names a count column when ``df`` is a confusion-count table
    (for example the running state of a streaming query)."""
    if unparsed == "drop":
        df = df.filter(F.col(predicted).isin(list(labels or LABELS)))
    elif unparsed != "keep":
        raise ValueError(f"unknown unparsed policy {unparsed!r}")
    pcm = per_class_metrics(df, keys, zero_division, correct, predicted, counts)
    return pcm.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1_score").alias("f1_score"),
        F.sum("n_true").alias("n_rows"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def metrics_on_rows(df: DataFrame, keys: Sequence[str], **params) -> DataFrame:
    """Each result row with the macro metrics of its group; every row stays."""
    return null_safe_join(df, macro_metrics(df, keys, **params).drop("n_rows", "n_classes"), list(keys), "left")


def metrics_on_first_row(df: DataFrame, keys: Sequence[str], position: str, **params) -> DataFrame:
    """J4 as a result file holds it: the group's macro metrics on its first row (by
    ``position``, which is unique in a group), NULL on all others."""
    names = ["accuracy", "precision", "recall", "f1_score"]
    first = df.groupBy(*keys).agg(F.min(position).alias("__first"))
    x = null_safe_join(metrics_on_rows(df, keys, **params), first, list(keys), "left")
    here = F.col(position).eqNullSafe(F.col("__first"))
    return x.withColumns({c: F.when(here, F.col(c)) for c in names}).drop("__first")


def mean_metrics(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of run-level metrics (all runs together when ``by``
    is empty, as the reference does)."""
    return metrics.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")],
        F.count(F.lit(1)).alias("n_runs"),
    )


def label_encode(df: DataFrame, keys: Sequence[str] = (), correct: str = "correct",
                 predicted: str = "predicted") -> DataFrame:
    """Sorted union of true and predicted values -> 0..k-1 (NULL last).

    Where unparsed answers stay as classes, these are as many as there are
    answers: the distinct classes are ranked over range partitions, not in one
    task (:func:`labelforge.operators.rank.numbered`)."""
    classes = df.select(*keys, F.explode(F.array(F.col(correct), F.col(predicted))).alias("cls")).distinct()
    return numbered(classes, keys, [F.col("cls").asc_nulls_last()], "code", "classes").select(*keys, "cls", "code")


def binarise(df: DataFrame, labels: Sequence[str] | None = None, truth: str = "correct") -> DataFrame:
    """E13 (long form): one ``(label, is_true)`` row per input row and label."""
    labels = list(labels or LABELS)
    return df.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels]))).withColumn(
        "is_true", (F.col(truth) == F.col("label")).cast("int")
    )


def label_counts(df: DataFrame, label: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``groupby(label).count()``: non-null count of each other column; a
    NULL label is no group, as in pandas."""
    cols = [c for c in df.columns if c != label] if cols is None else cols
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(*[F.count(c).alias(f"n_{c}") for c in cols])


def label_share(df: DataFrame, label: str, report: str) -> DataFrame:
    """Reports (not NULL) per label (not NULL) and their share
    ``round(100*n/sum(n), 2)`` (half-even, like pandas)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(report).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the class-count table only
    return counts.select(label, "n", F.bround(100.0 * F.col("n") / total, 2).alias("ratio_pct"))


def label_imbalance(df: DataFrame, label: str, report: str) -> DataFrame:
    """Spread (max-min) and factor (max/min) of the rounded shares."""
    share = label_share(df, label, report)
    return share.agg(
        F.max("ratio_pct").alias("max_pct"), F.min("ratio_pct").alias("min_pct"),
        (F.max("ratio_pct") - F.min("ratio_pct")).alias("spread"),
        (F.max("ratio_pct") / F.min("ratio_pct")).alias("factor"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def exact_value_counts(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Rows equal to each given value (one pass)."""
    return df.agg(*[F.count_if(F.col(col) == F.lit(v)).alias(f"n_eq_{i}") for i, v in enumerate(values)])


def null_profile(df: DataFrame) -> DataFrame:
    """``isnull().sum()`` for every column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns])
