"""Helpers shared by the corpus operators: durable intermediates, document
columns, connected components."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from labelforge.session import ensure_checkpoint_dir

#: Bytes of the words' separators: space, tab, line feed, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows and bytes that a Python worker gets at a time, at most.
BATCH_ROWS = 2000
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Makes Spark hand rows to Python in batches of bounded bytes, however long
    the texts are: what a worker once held it keeps."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod_is(col, mod: int, rest: int):
    """Is crc32(col as text) mod ``mod`` equal to ``rest``; a null key counts as
    the empty string."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def with_python_column(docs: DataFrame, name: str, kind: DataType, run) -> DataFrame:
    """The rows of ``docs`` with a column ``name`` that ``run`` makes of the
    texts of a batch (a list of str or None); a column of that name is replaced.
    All columns travel under names of their own, so that none can clash."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    fields = [StructField(f"_given_{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]

    def batches(it):
        make = run()
        for b in it:
            made = pa.array(make(b.column(len(kept)).to_pylist()), to_arrow_type(kind))
            yield pa.record_batch([*b.columns[:len(kept)], made], [*b.schema.names[:len(kept)], "_made"])

    got = docs.select(*[F.col(f"`{c}`").alias(f.name) for c, f in zip(kept, fields)], F.col("text").alias("_text")).mapInArrow(
        batches, StructType([*fields, StructField("_made", kind)]))
    return got.select(*[F.col(f.name).alias(c) for c, f in zip(kept, fields)], F.col("_made").alias(name))


#: Edges that one task writes between rounds, about.
EDGES_A_FILE = 250_000


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join: neither side has a size bound, so neither may be
    broadcast, however small it looks compressed."""
    return left.join(right.hint("merge"), on, how)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for
    every node that has an edge to another node.

    Large-star / small-star contraction: each round links the neighbours of a
    node to the smallest of them, first the larger ones, then the smaller ones.
    The number of edges never grows, a node of many edges is summed before the
    shuffle, and each round is a table in the shared folder."""
    def spread(sym: DataFrame, keep) -> DataFrame:
        # a table of its own: Spark splits the rows of a node with many edges
        # only where no aggregate stands beside the join
        low = saved(sym.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), name)
        return sorted_join(sym, low, "a").where(keep)

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = saved(e, name)
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = spread(sym, F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        both = sorted_join(large, low, "a")
        small = both.select("a", F.col("m").alias("b")).union(
            both.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # never more edges than before, so as many files as those need
        e = saved(small.distinct().coalesce(1 + mark[0] // EDGES_A_FILE), name)
    own = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)
