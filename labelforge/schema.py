"""Label domain and shared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values that must equal the reference's for right results:
# the six class labels, in the reference's label order.
LABELS = ["no", "mets", "progression", "stable", "improved", "romets"]

# The raw spellings of "no" seen in the reference's source data.
RAW_NO_VARIANTS = ["no", "No", "no "]

LABEL_DIM_SCHEMA = T.StructType(
    [
        T.StructField("label", T.StringType(), False),
        T.StructField("ord", T.IntegerType(), False),
    ]
)

PROMPT_SCHEMA = T.StructType(
    [
        T.StructField("catalogue", T.StringType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("prompt_id", T.StringType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("template", T.StringType(), True),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("report_id", T.LongType(), False),
        T.StructField("prompt_id", T.StringType(), True),
        T.StructField("correct", T.StringType(), True),
        T.StructField("predicted", T.StringType(), True),
    ]
)


def label_dim(spark: SparkSession, labels: list[str] | None = None) -> DataFrame:
    """The label dimension ``(label, ord)``; ``ord`` follows the label order."""
    labels = labels or LABELS
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], LABEL_DIM_SCHEMA)
