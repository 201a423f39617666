"""Dataset preparation (P1-P11): projections and row-wise building."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions.labels import normalise_label
from labelforge.functions.text import word_count

# Instruction text of the instruction rows (our wording).
DEFAULT_INSTRUCTION = (
    "Classify the radiology report into one of six labels: "
    "no, mets, progression, stable, improved, romets.\n"
    "Answer with the label only."
)


def instruction_rows(df: DataFrame, report: str = "report", label: str = "label",
                     instruction: str = DEFAULT_INSTRUCTION, normalise: str | None = "compat",
                     keep: list[str] | None = None) -> DataFrame:
    """``input`` = report, ``output`` = (normalised) label, constant
    ``instruction``; the source columns are dropped."""
    out = F.col(label) if normalise is None else normalise_label(label, normalise)
    return df.select(*(keep or []), F.col(report).alias("input"), F.lit(instruction).alias("instruction"),
                     out.alias("output"))


def _nz(c: Column, placeholder: str) -> Column:
    # Python formats a missing value as 'nan'/'None'; concat would give NULL.
    return F.coalesce(c, F.lit(placeholder))


def training_text(df: DataFrame, eos: str = "", label_only: bool = False) -> DataFrame:
    """``### Instruction:\\n{instruction}\\n\\nInput:\\n{input}\\n\\n
    ### Response:\\n{output}`` (or the label only) plus an end-of-sequence token."""
    if label_only:
        text = _nz(F.col("output"), "nan")
    else:  # fixed values: the frame of a training text
        text = F.concat(
            F.lit("### Instruction:\n"), _nz(F.col("instruction"), "nan"),
            F.lit("\n\nInput:\n"), _nz(F.col("input"), "nan"),
            F.lit("\n\n### Response:\n"), _nz(F.col("output"), "nan"),
        )
    return df.withColumn("text", F.concat(text, F.lit(eos)))


def length_audit(df: DataFrame, text: str = "text", max_words: int = 600, by: list[str] | None = None) -> DataFrame:
    """P10: rows that a training run with ``max_words`` would silently cut."""
    wc = word_count(text)
    return (
        df.select(*(by or []), wc.alias("__w"))
        .groupBy(*(by or []))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("__w") > max_words).alias("n_over_limit"),
            F.max("__w").alias("max_words"),
            F.min("__w").alias("min_words"),
            F.sum("__w").alias("total_words"),
        )
    )


def length_quantiles(df: DataFrame, text: str = "text", qs=(0.5, 0.9, 0.99), accuracy: int = 10000) -> DataFrame:
    """P10: approximate word-count quantiles (bounded-memory sketch)."""
    return df.select(word_count(text).alias("__w")).agg(
        F.percentile_approx("__w", list(qs), accuracy).alias("quantiles")
    )


def length_bucket(text_col: str = "text") -> Column:
    """Power-of-two word-count bucket."""
    w = word_count(text_col)
    return F.when(w <= 0, F.lit(0)).otherwise(F.floor(F.log2(w)).cast("int") + 1)


def length_grouped(df: DataFrame, text: str = "text", partitions: int | None = None,
                   shuffle: bool = False) -> DataFrame:
    """Rows of similar length next to each other ahead of batch inference.

    Default: sort within each partition by character length (native ``length``,
    no regex pass over the text): no data moves, and every Arrow batch holds
    similar lengths. ``shuffle=True`` also range-partitions by length (a full
    shuffle of the text; only worth it when lengths vary a lot within
    partitions)."""
    x = df.withColumn("__len", F.length(F.col(text)))
    if shuffle:
        x = x.repartitionByRange(partitions, "__len") if partitions else x.repartitionByRange("__len")
    return x.sortWithinPartitions("__len").drop("__len")


def padded_runs(lengths: np.ndarray, budget: int) -> list[int]:
    """The end of each run of rows, in the order given, such that longest x rows
    stays within ``budget``; a row beyond the budget is a run of its own. Each
    run takes all rows it can."""
    ends, start, longest = [], 0, 0
    for i, n in enumerate(np.maximum(lengths, 1).tolist()):
        longest = max(longest, n)
        if i > start and longest * (i + 1 - start) > budget:
            ends.append(i)
            start, longest = i, n
    return [*ends, len(lengths)] if len(lengths) else []


def padded_batches(df: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Batches of bounded cost: ``(batch, n_rows, longest, total_chars)``, a row
    for each batch that :func:`labelforge.operators.inference.batch_inference` would give its scorer
    with ``max_padded=budget``: rows sorted by length within their partition, cut
    where longest x rows would pass the budget. A run of equal lengths is split
    the same way. Only lengths reach Python."""
    sized = df.select(F.coalesce(F.length(F.col(text)), F.lit(0)).alias("__len")).sortWithinPartitions("__len")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        done = 0

        def rows(lengths, ends):
            parts = [lengths[x:y] for x, y in zip([0, *ends], ends)]
            return pa.record_batch([pa.array(range(done, done + len(parts)), pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                                    pa.array([int(p.max()) for p in parts], pa.int64()), pa.array([int(p.sum()) for p in parts], pa.int64())],
                                   ["batch", "n_rows", "longest", "total_chars"])

        for b in batches:
            held = np.concatenate([held, b.column(0).to_numpy().astype(np.int64)])
            ends = padded_runs(held, budget)
            yield rows(held, ends[:-1])
            done += len(ends[:-1])
            held = held[ends[-2] if len(ends) > 1 else 0:]
        if len(held):
            yield rows(held, [len(held)])

    out = sized.mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in ("batch", "n_rows", "longest", "total_chars")]))
    return out.withColumn("partition", F.spark_partition_id())


def padding_report(batches: DataFrame, budget: int) -> DataFrame:
    """How much of the scorer's input is padding: rows, characters, batches,
    the largest padded size among batches of more than one row, batches over the
    budget (none but single rows longer than it), and the mean share of padding."""
    padded = F.col("n_rows") * F.greatest("longest", F.lit(1))
    return batches.agg(
        F.sum("n_rows").alias("n_rows"), F.sum("total_chars").alias("total_chars"), F.count(F.lit(1)).alias("n_batches"),
        F.max(F.when(F.col("n_rows") > 1, padded)).alias("max_padded"),
        F.count_if((F.col("n_rows") > 1) & (padded > budget)).alias("n_over_budget"),
        F.count_if((F.col("n_rows") == 1) & (padded > budget)).alias("n_long_rows"),
        (1 - F.sum("total_chars") / F.sum(padded)).alias("padding"))
