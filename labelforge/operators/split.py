"""Stratified splits and folds (X1-X4) with seeded, re-executable order keys.

Within-class ranks come from :func:`labelforge.operators.rank.exclusive_prefix`
over md5 order keys (uniform hex, so every bucket holds ~n/4096 rows), so no
class is ever ranked inside a single task. Quotas per class follow
scikit-learn's contract: ``n_test = ceil(test_size * n)`` and proportional
per-class quotas by largest remainder (ties: label order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.hashing import order_key
from labelforge.operators.rank import exclusive_prefix, hex_buckets, null_safe_join
from labelforge.sources.files import materialize


def stratified_rank(df: DataFrame, id_col: str, label_col: str, seed: int = 42,
                    digits: tuple[int, ...] = (3, 3), out: str = "rank_in_label") -> DataFrame:
    """1-based rank of each row within its class in seeded md5 order (ties by id)."""
    key = order_key(F.col(id_col), seed)
    b = hex_buckets(F.col("__key"), digits)
    keyed = df.withColumn("__key", key).withColumn("__one", F.lit(1).cast("long"))
    names = [f"__b{i}" for i in range(len(b))]
    for n, c in zip(names, b):
        keyed = keyed.withColumn(n, c)
    ranked = exclusive_prefix(keyed, [label_col], names, ["__key", id_col], "__one", out="__pre")
    return ranked.withColumn(out, F.col("__pre") + 1).drop("__key", "__one", "__pre", *names)


def largest_remainder(counts: DataFrame, label_col: str, n_col: str, total_draws: F.Column,
                      out: str) -> DataFrame:
    """Proportional integer quotas summing to ``total_draws`` (a column of
    ``counts``): floor shares, then +1 for the largest remainders."""
    w_all = Window.partitionBy()
    c = counts.withColumn("__n", F.sum(n_col).over(w_all)).withColumn("__d", total_draws.cast("long"))
    # exact integer shares in decimal(38,0): d*n overflows a long past ~3e9 rows
    num = f"CAST(__d AS DECIMAL(38,0)) * CAST(`{n_col}` AS DECIMAL(38,0))"
    c = c.withColumn("__base", F.expr(f"({num}) div CAST(__n AS DECIMAL(38,0))").cast("long"))
    c = c.withColumn("__rem", F.expr(f"{num} - CAST(__base AS DECIMAL(38,0)) * CAST(__n AS DECIMAL(38,0))"))
    c = c.withColumn("__left", F.col("__d") - F.sum("__base").over(w_all))
    w_rank = Window.partitionBy().orderBy(F.col("__rem").desc(), F.col(label_col).asc_nulls_last())
    c = c.withColumn(out, F.col("__base") + F.when(F.row_number().over(w_rank) <= F.col("__left"), 1).otherwise(0))
    return c.drop("__n", "__d", "__base", "__rem", "__left")


def split_quotas(df: DataFrame, label_col: str, test_size: float = 0.3, eval_share: float = 0.5) -> DataFrame:
    """Per class: ``n``, ``q_temp`` (rows leaving train) and ``q_test``
    (rows of the held-out part that form test). The class table is tiny."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    counts = counts.withColumn("__draw", F.ceil(F.lit(float(test_size)) * total))
    q1 = largest_remainder(counts, label_col, "n", F.col("__draw"), "q_temp").drop("__draw")
    temp_total = F.sum("q_temp").over(Window.partitionBy())
    q1 = q1.withColumn("__draw2", F.ceil(F.lit(float(eval_share)) * temp_total))
    return largest_remainder(q1, label_col, "q_temp", F.col("__draw2"), "q_test").drop("__draw2")


def cut_offs(df: DataFrame, id_col: str, label_col: str, quotas: DataFrame, names: list[str], seed: int = 42) -> DataFrame:
    """Per class and quota column ``name``: the order key and id of the row at
    that rank (``__cut_<name>``; NULL for a quota of 0). Ranks are counted by
    (class, key prefix); only the rows of the one prefix in which a quota falls
    are ranked, by keys alone."""
    narrow = df.select(F.col(label_col), F.col(id_col), order_key(F.col(id_col), seed).alias("__key"))
    narrow = narrow.withColumn("__b", F.substring("__key", 1, 3))
    counts = narrow.groupBy(label_col, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(label_col).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    wanted = quotas.select(label_col, F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("rank")) for n in names])).alias("__q"))
    at = (null_safe_join(before, wanted, [label_col])
          .where((F.col("__before") < F.col("__q.rank")) & (F.col("__q.rank") <= F.col("__before") + F.col("__n")))
          .select(label_col, "__b", F.col("__q.name").alias("__name"), (F.col("__q.rank") - F.col("__before")).alias("__at")))
    at = materialize(at, "split-prefixes")
    prefixes = at.select(label_col, "__b").distinct()
    place = F.row_number().over(Window.partitionBy(label_col, "__b").orderBy("__key", id_col))
    ranked = null_safe_join(narrow, prefixes, [label_col, "__b"]).withColumn("__place", place)
    hit = null_safe_join(ranked, at, [label_col, "__b"]).where(F.col("__place") == F.col("__at"))
    cut = F.struct(F.col("__key"), F.col(id_col))
    return materialize(hit.groupBy(label_col).agg(*[
        F.max(F.when(F.col("__name") == n, cut)).alias(f"__cut_{n}") for n in names]), "split-cut-offs")


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.3,
                     eval_share: float = 0.5, seed: int = 42) -> DataFrame:
    """Adds ``split`` in {train, eval, test}; 0.3 then 0.5 gives 70/15/15.

    A row's split follows from comparing its order key with two cut-off keys of
    its class, one row per class; Spark knows that table's size and broadcasts
    it if small, so no row moves. Rows of one id go to the same split."""
    q = split_quotas(df, label_col, test_size, eval_share)
    cuts = cut_offs(df, id_col, label_col, q, ["q_test", "q_temp"], seed)
    j = null_safe_join(df, cuts, [label_col], "left")
    own = F.struct(order_key(F.col(id_col), seed).alias("__key"), F.col(id_col))
    return j.withColumn(
        "split",
        F.when(own <= F.col("__cut_q_test"), "test").when(own <= F.col("__cut_q_temp"), "eval").otherwise("train"),
    ).drop("__cut_q_test", "__cut_q_temp")


#: Bytes of a fold table that may travel by broadcast.
BROADCAST_FOLDS = 32 << 20


def fold_table(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``(id, label, n, fold)``, a row for each id and class: ``fold = (rows of earlier
    classes + rank in the class) % k``. Only ids, classes and order keys are
    ranked and moved; rows of one id go to one fold."""
    ids = df.groupBy(label_col, id_col).agg(F.count(F.lit(1)).alias("n"))
    keyed = ids.withColumn("__key", order_key(F.col(id_col), seed))
    b = hex_buckets(F.col("__key"))
    names = [f"__b{i}" for i in range(len(b))]
    keyed = materialize(keyed.withColumns(dict(zip(names, b))), "fold-keys")
    ranked = exclusive_prefix(keyed, [label_col], names, ["__key", id_col], "n", out="__rank")
    w = Window.partitionBy().orderBy(F.col(label_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (keyed.groupBy(label_col).agg(F.sum("n").alias("__n"))
               .select(label_col, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__earlier")))  # one row per class
    fold = ((F.col("__earlier") + F.col("__rank")) % k).cast("int").alias("fold")
    return materialize(null_safe_join(ranked, earlier, [label_col]).select(id_col, label_col, "n", fold), "folds")


def stratified_kfold(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``. A class goes on where the one before it ended, so that
    fold sizes differ by <= 1 per class and over all classes. Classes in label
    order, NULL last.

    :func:`fold_table` ranks ids alone; its folds are joined back by id. A fold
    table of ``BROADCAST_FOLDS`` at most is broadcast, so no other column of
    ``df`` moves; a larger one meets ``df`` in a join by id, the one time that
    the rows move (a caller that can join later takes the fold table)."""
    folds = fold_table(df, id_col, label_col, k, seed).drop("n")
    size = folds.agg(F.sum(F.octet_length(F.col(id_col).cast("string")) + 48)).first()[0] or 0
    return null_safe_join(df, folds, [id_col, label_col], broadcast_right=size <= BROADCAST_FOLDS)


def split_sizes(split_df: DataFrame, label_col: str | None = None, split_col: str = "split") -> DataFrame:
    """Rows per split (and per class when ``label_col`` is given)."""
    keys = [split_col] + ([label_col] if label_col else [])
    return split_df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
