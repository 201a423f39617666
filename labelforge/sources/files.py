"""File sources and sinks.

Scratch and result locations live under the cluster's shared
``spark.checkpoint.dir`` (never a machine-local folder)."""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.session import ensure_checkpoint_dir

CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "false",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/labelforge/{name}-{uuid.uuid4().hex[:12]}"


def run_id(now: _dt.datetime | None = None) -> str:
    """Run stamp ``%Y%m%d_%H%M%S``."""
    return (now or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")  # fixed value: the stamp's format


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with multi-line quoted text and doubled quotes (pandas style).
    As with pandas, an empty field (quoted or not) reads as NULL."""
    r = spark.read.options(**CSV_READ)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", "false")).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    w = df.write.options(**CSV_WRITE).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def prompt_key(prompt_id: Column) -> Column:
    """Path-safe partition value for a prompt id (ids may hold spaces/slashes)."""
    return F.concat(F.regexp_replace(prompt_id, "[^A-Za-z0-9_-]", "_"), F.lit("-"),
                    F.substring(F.md5(prompt_id), 1, 8))


def write_results(df: DataFrame, path: str, run: str, fmt: str = "parquet") -> None:
    """Per-row results partitioned by run and prompt. Writing a run again
    replaces that run's partitions; other runs stay."""
    out = df.withColumn("run_id", F.lit(run)).withColumn("prompt_key", prompt_key(F.col("prompt_id")))
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "prompt_key")
    if fmt == "csv":
        w.options(**CSV_WRITE).csv(path)
    else:
        w.format(fmt).save(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metrics records as JSON lines."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ------------------------------------------------------------------ prompt catalogues

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("catalogue", T.StringType()), T.StructField("pos", T.IntegerType()),
    T.StructField("prompt_id", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("template", T.StringType()),
])


def _parse_yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["value"]):
            doc = yaml.safe_load(content) or {}
            name = str(path)  # two folders may hold files of one name
            for i, p in enumerate(doc.get("prompts") or []):
                rows.append((name, i, None if p.get("id") is None else str(p.get("id")),
                             p.get("description"), "" if p.get("text") is None else str(p.get("text"))))
        yield pd.DataFrame(rows, columns=[f.name for f in CATALOGUE_SCHEMA.fields])


def read_prompt_catalogues(spark: SparkSession, path: str) -> DataFrame:
    """YAML files ``prompts: [{id, description, text}]`` -> one row per prompt.

    Each file is one whole-text row (files are small; YAML needs the whole
    document). A repeated id behaves like the reference's dict: it keeps its
    first position and takes the last text. ``ord`` is the position after that."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = raw.mapInPandas(_parse_yaml, CATALOGUE_SCHEMA)
    d = rows.groupBy("catalogue", "prompt_id").agg(
        F.min("pos").alias("pos"),
        F.max_by("description", "pos").alias("description"),
        F.max_by("template", "pos").alias("template"),
    )
    w = Window.partitionBy("catalogue").orderBy("pos")
    return d.withColumn("ord", (F.row_number().over(w) - 1).cast("int")).select(
        "catalogue", "ord", "prompt_id", "description", "template")


def write_prompt_catalogue(spark: SparkSession, prompts: Sequence[tuple[str, str, str]], path: str) -> None:
    """Write ``(id, description, text)`` tuples as one YAML catalogue file."""
    import yaml

    text = yaml.safe_dump({"prompts": [{"id": i, "description": d, "text": t} for i, d, t in prompts]},
                          allow_unicode=True, sort_keys=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)


def read_parquet_indexed(spark: SparkSession, path: str, out: str = "row_id") -> DataFrame:
    """Parquet rows with a stable 0..n-1 index in (file, row) order, for
    sources that carry no key. Built from the file-metadata row index plus a
    per-file offset (one row per file), so no row moves and re-execution
    gives the same ids (unlike ``monotonically_increasing_id``)."""
    base = spark.read.parquet(path)
    cols = base.columns
    x = base.select(*cols, F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    files = x.groupBy("__f").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = files.select("__f", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    # one row per file; Spark broadcasts it if it is small enough, so no row moves
    return x.join(offsets, "__f").select(*cols, (F.col("__off") + F.col("__r")).cast("bigint").alias(out))


def with_source_index(source: DataFrame, out: str = "row_id") -> DataFrame:
    """P8 for CSV, JSON and text sources without a key: ``source`` (a plain
    ``spark.read`` of files) with a stable 0..n-1 index in (file, record) order.

    A first pass counts the records of each split (file, position of its first
    byte) and notes where its records begin in the task that reads it; the
    second adds the records of earlier splits. Splits only decide who counts:
    the index is the same whatever their size, on every read, and no row moves."""
    cols = source.columns
    x = source.select(*cols, F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s"),
                      F.monotonically_increasing_id().alias("__g"))
    splits = materialize(x.groupBy("__f", "__s").agg(F.min("__g").alias("__lo"), F.count(F.lit(1)).alias("__n")), "splits")
    w = Window.orderBy("__f", "__s").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    before = splits.select("__f", "__s", "__lo", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    return x.join(before, ["__f", "__s"]).select(*cols, (F.col("__before") + F.col("__g") - F.col("__lo")).alias(out))


def read_csv_indexed(spark: SparkSession, path: str, schema: T.StructType | str, out: str = "row_id", multi_line: bool = True) -> DataFrame:
    """:func:`read_csv` with a stable index. Files whose fields hold no line
    break may be read with ``multi_line=False``, in several tasks a file."""
    options = {**CSV_READ, "multiLine": str(multi_line).lower()}
    return with_source_index(spark.read.options(**options).schema(schema).csv(path), out)


def read_json_indexed(spark: SparkSession, path: str, schema: T.StructType | str, out: str = "row_id") -> DataFrame:
    """JSON lines with a stable index."""
    return with_source_index(read_json(spark, path, schema), out)


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S3: dataset snapshot (Parquet instead of pickle)."""
    df.write.mode(mode).parquet(path)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts lineage (no upstream recompute, survives executor loss) and gives
    AQE real statistics. Columnar and compressed, unlike ``checkpoint()``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
