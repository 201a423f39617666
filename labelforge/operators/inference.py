"""Batch inference (I1-I4): prompts -> responses with a pluggable scorer.

* ``python`` scorers run inside ``mapInPandas``: Arrow batches, the scorer is
  built once per Python worker and reused for every batch (model loading is
  the expensive part), rows arrive length-grouped (P11) so padded batches waste
  little compute.
* ``replay`` joins stored responses on ``(report, prompt)`` keys: inference is
  costly and sampled, so responses are written once and re-read.
* ``keyword`` is the native keyword-rate scorer (T18): JVM expressions only.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.operators.prepare import length_grouped, padded_runs
from labelforge.schema import LABELS

#: Bytes that a Python worker gets at a time, at most (a longer row comes alone).
BATCH_BYTES = "4m"
#: Batches after which a worker gives back what it no longer holds.
RELEASE_EVERY = 8

ScorerFactory = Callable[[], Callable[[pd.Series], pd.Series]]

_WORKER_CACHE: dict[str, Callable[[pd.Series], pd.Series]] = {}


def _scorer(token: str, factory: ScorerFactory):
    """The scorer of one ``batch_inference`` call, built once per worker; a
    worker keeps one scorer at a time."""
    if token not in _WORKER_CACHE:
        _WORKER_CACHE.clear()
        _WORKER_CACHE[token] = factory()
    return _WORKER_CACHE[token]


def _release() -> None:
    """Gives the memory of batches that are done back to the system; left alone, a
    worker keeps as much as its whole task has read."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def batch_inference(df: DataFrame, factory: ScorerFactory, prompt: str = "prompt", out: str = "response",
                    keys: Sequence[str] | None = None, group_by_length: bool = True,
                    materialize: bool = True, partitions: int | None = None, max_padded: int | None = None) -> DataFrame:
    """``out`` = scorer(prompt), batch by batch.

    Only ``keys`` + the prompt cross into Python (Arrow batches of ``BATCH_BYTES``,
    however many and however long the prompts are) and only ``keys`` +
    the response come back; rows are sorted by length inside each partition
    first (P11), without a shuffle. With ``keys=None`` every input column is
    kept. The responses are written once to the shared checkpoint folder and that
    table is returned, so that a task re-run after an executor loss cannot
    change sampled responses that were already consumed; ``materialize=False``
    is for deterministic scorers. ``partitions`` spreads the requests over so
    many tasks (default: as they come). ``max_padded`` bounds what the scorer
    gets at a time by its padded size (longest prompt x rows, in characters;
    :func:`labelforge.operators.prepare.padded_runs`); a longer prompt comes
    alone."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    token = uuid.uuid4().hex
    keep = list(keys) if keys is not None else [c for c in df.columns if c != prompt]
    src = df.select(*keep, prompt)
    if partitions:
        src = src.repartition(partitions)
    if group_by_length:
        src = length_grouped(src, prompt)
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(out, T.StringType(), True)])
    if keys is None and prompt in df.columns:
        schema = T.StructType(list(schema.fields[:-1]) + [src.schema[prompt], schema.fields[-1]])
        keep = keep + [prompt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn, done = _scorer(token, factory), 0
        for pdf in batches if max_padded is None else _padded(batches, prompt, max_padded):
            res = pd.Series(fn(pdf[prompt]), index=pdf.index).astype(object)
            part = pdf[keep].copy()
            part[out] = res
            yield part
            del pdf, part, res
            done += 1
            if done % RELEASE_EVERY == 0:
                _release()

    result = src.mapInPandas(run, schema)
    if materialize:
        from labelforge.sources.files import materialize as _materialize

        result = _materialize(result, "responses")
    return result


def _padded(batches: Iterator[pd.DataFrame], prompt: str, budget: int) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in runs of at most ``budget`` padded characters;
    a run may go on from one Arrow batch into the next."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        ends = padded_runs(pdf[prompt].str.len().fillna(0).astype("int64").to_numpy(), budget)
        for x, y in zip([0, *ends], ends[:-1]):
            yield pdf.iloc[x:y]
        held = pdf.iloc[ends[-2] if len(ends) > 1 else 0:] if len(ends) else None
    if held is not None and len(held):
        yield held


def resume_inference(requests: DataFrame, factory: ScorerFactory, store: str, run_id: str, keys: Sequence[str],
                     prompt: str = "prompt", out: str = "response", slices: int = 16, max_slices: int | None = None,
                     **params) -> DataFrame:
    """A run that goes on after a failure. Responses are appended to a store
    (Parquet, by run and slice of the requests' keys), one commit for each
    slice; a slice's requests are first matched against what the run has
    stored, so a run started again, or continued, scores only the rest, and no
    response is ever replaced. ``max_slices`` ends a call after so many slices
    with open requests. Keys name one request each; :func:`replay` raises
    where they don't. Returns the run's stored responses."""
    spark, keys = requests.sparkSession, list(keys)
    schema = T.StructType([*(requests.schema[c] for c in keys), T.StructField(out, T.StringType()),
                           T.StructField("run_id", T.StringType()), T.StructField("slice", T.IntegerType())])

    def append(df: DataFrame) -> None:
        df.write.mode("append").partitionBy("run_id", "slice").parquet(store)

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(store).where(F.col("run_id") == run_id)

    append(spark.createDataFrame([], schema))  # the store exists from here on
    asked = requests.withColumn("slice", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int"))
    open_slices = sorted(r["slice"] for r in asked.select(*keys, "slice").join(stored(), [*keys, "slice"], "left_anti")
                         .select("slice").distinct().collect())  # at most ``slices`` numbers
    for k in open_slices[:max_slices]:
        rest = asked.where(F.col("slice") == k).join(stored().where(F.col("slice") == k), keys, "left_anti")
        got = batch_inference(rest, factory, prompt=prompt, out=out, keys=keys, materialize=False, **params)
        append(got.select(*keys, out).withColumns({"run_id": F.lit(run_id), "slice": F.lit(k)}))
    return stored().select(*keys, out, "run_id")


def replay(requests: DataFrame, stored: DataFrame, keys: Sequence[str], response: str = "response",
           run_id: str | None = None) -> DataFrame:
    """I1 (replay): responses recorded by an earlier run, joined on keys.
    Requests with no stored response keep a NULL response (left join). Stored
    tables hold several runs: ``run_id`` names the one to replay. Two stored
    responses for one key would multiply requests, so they raise."""
    if run_id is not None:
        stored = stored.filter(F.col("run_id") == run_id)
    one = stored.groupBy(*keys).agg(F.min(response).alias("__r"), F.count(F.lit(1)).alias("__n"))
    clash = F.raise_error(F.concat(F.lit("several stored responses for "), F.to_json(F.struct(*keys)))).cast("string")
    one = one.select(*keys, F.when(F.col("__n") > 1, clash).otherwise(F.col("__r")).alias(response))
    return requests.join(one, list(keys), "left")


class LengthScorer:
    """Deterministic stand-in model: ``final label: LABELS[len(prompt) % 6]``."""

    def __init__(self, labels: Sequence[str] | None = None):
        self.labels = list(labels or LABELS)

    def __call__(self, prompts: pd.Series) -> pd.Series:
        k = len(self.labels)
        return prompts.map(lambda p: None if p is None else "final label: " + self.labels[len(p) % k])


def length_scorer() -> Callable[[pd.Series], pd.Series]:
    return LengthScorer()


def keyword_scorer_responses(keyword_labels: DataFrame, keys: Sequence[str], out: str = "response") -> DataFrame:
    """I1 (keyword): native scorer output in the ``final label:`` format."""
    return keyword_labels.select(*keys, F.concat(F.lit("final label: "), F.col("keyword_label")).alias(out))
