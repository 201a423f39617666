"""Exact one-vs-rest AUROC (E6-E8) and the wide result export.

AUROC = sum over positives of (negatives scored lower + half the negatives
with the same score) / (P * N), i.e. the Mann-Whitney form with ties counted
one half, the same number ``roc_auc_score`` gives. Computed relationally:

1. ``(group, score) -> pos, neg``: partial aggregate (map-side combine); one
   row per distinct score, so a hot score value is a single row.
2. negatives below each score: score buckets of about as many rows each (cut
   points from a quantile sketch of each curve), exact counts per bucket, and a
   window inside a bucket only; never over a whole class, however the scores
   are spread.
3. ``sum(pos * (neg_below + neg/2)) / (P * N)`` per group; NULL when a group
   has only one class present (the reference's NaN), skipped by ``avg``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.confidence import PATTERN_A
from labelforge.operators.rank import cut_bucket, null_safe_join, quantile_cuts
from labelforge.schema import LABELS

#: Score buckets of a curve, and how many cut points may travel by broadcast.
BUCKETS = 1024
BROADCAST_CUTS = 1 << 22


def auroc(df: DataFrame, keys: Sequence[str], score: str = "score", positive: str = "is_true",
          buckets: int = BUCKETS) -> DataFrame:
    """``(keys..., auroc, n_pos, n_neg)`` for binary ``positive`` (0/1 or bool).

    A row without a score or a target has no rank (:func:`unranked` counts
    them). The distinct ``(curve, score)`` rows are written once to the shared
    checkpoint folder, so the passes over them neither recompute the upstream plan
    nor depend on executors that may be lost. A curve's cut points are one row;
    they are broadcast only if all curves have ``BROADCAST_CUTS`` at most."""
    from labelforge.sources.files import materialize

    keys = list(keys)
    y = F.col(positive).cast("long")
    df = df.filter(F.col(score).isNotNull() & F.col(positive).isNotNull())
    d = df.groupBy(*keys, F.col(score).alias("__score")).agg(
        F.sum(y).alias("__pos"), F.sum(1 - y).alias("__neg")
    )
    d = materialize(d, "auroc-scores")
    d = score_buckets(d, keys, "__score", buckets)
    low = d.groupBy(*keys, "__b").agg(F.sum("__neg").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    low = low.withColumn("__base", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__b").orderBy("__score").rowsBetween(Window.unboundedPreceding, -1)
    d = null_safe_join(d.withColumn("__in", F.coalesce(F.sum("__neg").over(inside), F.lit(0))), low, keys + ["__b"])
    d = d.withColumn("__below", F.col("__base") + F.col("__in"))
    contrib = F.col("__pos").cast("double") * (F.col("__below").cast("double") + 0.5 * F.col("__neg").cast("double"))
    agg = d.groupBy(*keys).agg(
        F.sum(contrib).alias("__num"), F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg")
    )
    return agg.select(
        *keys,
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
               F.col("__num") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))).alias("auroc"),
        "n_pos", "n_neg",
    )


def score_buckets(d: DataFrame, keys: Sequence[str], score: str, buckets: int = BUCKETS) -> DataFrame:
    """``d`` with ``__b``, the score's bucket within its curve."""
    from labelforge.sources.files import materialize

    cuts = materialize(d.groupBy(*keys).agg(quantile_cuts(F.col(score).cast("double"), buckets).alias("__cuts")), "auroc-cuts")
    bounded = cuts.count() * buckets <= BROADCAST_CUTS
    bucket = cut_bucket(F.col(score).cast("double"), F.col("__cuts"), buckets)
    return null_safe_join(d, cuts, list(keys), broadcast_right=bounded).withColumn("__b", bucket).drop("__cuts")


def unranked(df: DataFrame, keys: Sequence[str] = (), score: str = "score", positive: str = "is_true") -> DataFrame:
    """Rows that have no place on a curve: ``(keys..., n_rows, n_no_score,
    n_no_target, n_unranked)``."""
    s, y = F.col(score).isNull(), F.col(positive).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(s).alias("n_no_score"),
                                 F.count_if(y).alias("n_no_target"), F.count_if(s | y).alias("n_unranked"))


def first_mention_order(responses: DataFrame, keys: Sequence[str], text: str, position: str,
                        labels: Sequence[str] | None = None) -> DataFrame:
    """``(keys..., column_order)``: the order in which a table built row by row
    from parsed responses gets its score columns: labels as the first response
    (by ``position``) of the group scores them, then the others in label order."""
    names = F.array(*[F.lit(x) for x in labels or LABELS])
    said = F.filter(F.regexp_extract_all(F.col(text), F.lit(PATTERN_A), 1), lambda k: F.array_contains(names, k))
    first = responses.groupBy(*keys).agg(F.min_by(F.coalesce(F.col(text), F.lit("")), F.col(position)).alias(text))
    return first.select(*keys, F.array_distinct(F.concat(said, names)).alias("column_order"))


def positional_targets(scores: DataFrame, keys: Sequence[str], truth: str = "true_label",
                       labels: Sequence[str] | None = None, order: DataFrame | None = None) -> DataFrame:
    """E8 exactly as the reference pairs columns: the binariser is fitted on
    the truth values present (sorted), score column ``i`` (label order) is
    compared with truth column ``i``; with exactly two truth classes the
    binariser yields one column (the second class); a score column without a
    partner gets no target (NULL AUROC). ``order`` ((keys..., column_order), of
    :func:`first_mention_order`) replaces label order by each group's own.
    Output: ``(keys..., label, target)``, at most ``groups x labels`` rows."""
    labels = list(labels or LABELS)
    keys = list(keys)
    present = scores.select(*keys, F.col(truth).alias("__t")).filter(F.col("__t").isNotNull()).distinct()
    w = Window.partitionBy(*keys).orderBy("__t")
    ranked = present.withColumn("__i", F.row_number().over(w) - 1).withColumn(
        "__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # two classes -> one column holding the second class
    ranked = ranked.withColumn("__col", F.when(F.col("__n") == 2, F.col("__i") - 1).otherwise(F.col("__i")))
    columns = F.array(*[F.lit(x) for x in labels])
    grid = ranked.select(*keys).distinct()
    if order is not None:
        grid = null_safe_join(grid, order, keys, "left")
        columns = F.coalesce("column_order", columns)
    grid = grid.select(*keys, F.posexplode(columns).alias("__col", "label"))
    return null_safe_join(grid, ranked.filter(F.col("__col") >= 0).select(*keys, "__col", F.col("__t").alias("target")),
                          keys + ["__col"], "left").drop("__col")


def one_vs_rest_auroc(scores: DataFrame, keys: Sequence[str] = (), truth: str = "true_label",
                      label: str = "label", score: str = "score", align: str = "by_name",
                      labels: Sequence[str] | None = None, order: DataFrame | None = None) -> DataFrame:
    """E6/E8 on long-form scores ``(keys..., label, score, truth)``: one AUROC
    per ``(keys..., label)``. ``align='by_name'`` (correct) compares score of
    label L with truth == L; ``'positional'`` reproduces the reference's
    pairing of score column i with the i-th binarised truth column, score
    columns in label order or in ``order`` (:func:`first_mention_order`)."""
    keys = list(keys)
    if align == "by_name":
        flagged = scores.withColumn("__y", (F.col(truth) == F.col(label)).cast("int"))
    elif align == "positional":
        targets = positional_targets(scores, keys, truth, labels, order).withColumnRenamed("label", label)
        # targets: groups x labels rows (bounded by design) -> broadcast
        flagged = scores.join(F.broadcast(targets), keys + [label], "left").withColumn(
            "__y", (F.col(truth) == F.col("target")).cast("int"))
        flagged = flagged.filter(F.col("target").isNotNull())
    else:
        raise ValueError(f"unknown align {align!r}")
    out = auroc(flagged, keys + [label], score=score, positive="__y")
    if align == "positional":
        # score columns with no truth partner: NaN in the reference -> NULL
        grid = scores.select(*keys, label).distinct()
        out = grid.join(out, keys + [label], "left")
    return out


def macro_auroc(per_label: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``nanmean`` over labels (``avg`` skips NULL)."""
    return per_label.groupBy(*keys).agg(
        F.avg("auroc").alias("average_auroc"), F.count("auroc").alias("n_defined")
    )


def wide_export(scores: DataFrame, per_label: DataFrame, row_keys: Sequence[str], group_keys: Sequence[str] = (),
                labels: Sequence[str] | None = None, label: str = "label", score: str = "score",
                predicted: str = "predicted", truth: str = "true_label") -> DataFrame:
    """One row per report with the six score columns, predicted and true
    label, the mean AUROC and ``auroc_<label>`` repeated on every row. The AUROC
    side has one row per group and is joined on the group keys."""
    labels = list(labels or LABELS)
    wide = (
        scores.groupBy(*row_keys, *group_keys, F.col(predicted).alias("predicted_label"),
                       F.col(truth).alias("true_label"))
        .pivot(label, labels)
        .agg(F.first(score))
    )
    au = per_label.groupBy(*group_keys).pivot(label, labels).agg(F.first("auroc"))
    for lab in labels:
        au = au.withColumnRenamed(lab, f"auroc_{lab}")
    mean = macro_auroc(per_label, group_keys).drop("n_defined")
    one = not group_keys
    if one:  # one curve set: join on a constant key
        wide, au, mean = (x.withColumn("__one", F.lit(1)) for x in (wide, au, mean))
        group_keys = ["__one"]
    # every report stays: a group without a curve, or a NULL group key, gets
    # NULL figures (or its own), as the reference keeps such rows
    au = null_safe_join(au, mean, list(group_keys))
    out = null_safe_join(wide, au, list(group_keys), "left")
    return out.drop("__one") if one else out
